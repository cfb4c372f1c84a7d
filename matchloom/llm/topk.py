"""Exact top-k inner products by distributed histogram selection.

Queries and candidates are dealt to blocks; each pair of blocks scores everything.
A pass counts, for every query, its scores per bin of an interval that is known to
hold the k-th highest score; the counts of all blocks together tell in which bin it
lies, and the next pass refines that bin, until an interval is a single score. A
last pass keeps what lies above it, and of the ties as many as are still needed,
smallest vec_id first. A block reports no bin below its own k-th highest score, as
that can't be lower than the k-th of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from matchloom.llm.common import durable, pick, saved
from matchloom.llm.vectors import matrix, usable

K = 10
EVERY = 100
SCALE = 1024
BINS = 2_048
#: Queries and candidates in a block, and the fewest blocks of candidates.
QUERIES = 512
CANDIDATES = 4_096
SPREAD = 64
EXACT = 2.0 ** 53
LONG = 2 ** 63 - 1


def quantised(column) -> np.ndarray:
    return np.floor(matrix(column) * SCALE)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; vectors of other lengths are filled with zeros. Beyond a long they saturate."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if np.abs(a).sum(1).max(initial=0) * np.abs(b).max(initial=0) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in b]
    return np.array([[max(-LONG, min(LONG, sum(int(x) * y for x, y in zip(row, other)))) for other in whole] for row in a], np.int64).reshape(len(a), len(b))


def block_scores(queries: pa.Table, candidates: pa.Table) -> np.ndarray:
    """A row per query; the query's own row has the lowest number there is."""
    s = scores(quantised(queries.column("vector")), quantised(candidates.column("vector")))
    own = queries.column("rid").to_numpy()[:, None] == candidates.column("rid").to_numpy()[None]
    return np.where(own, -LONG - 1, s)


def kth(s: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Each row's k-th highest number (its lowest where it has fewer)."""
    most = int(min(k.max(), s.shape[1]))
    top = -np.sort(-np.partition(s, s.shape[1] - most, axis=1)[:, -most:], axis=1) if most < s.shape[1] else -np.sort(-s, axis=1)
    return top[np.arange(len(s)), np.minimum(k, s.shape[1]) - 1]


def count(queries: pa.Table, candidates: pa.Table) -> pa.Table:
    """Counts per query and bin of its interval, from the block's own k-th highest upwards."""
    names = {"rid": pa.int64(), "bin": pa.int64(), "n": pa.int64()}
    if not len(queries) or not len(candidates):
        return pa.table({c: pa.array([], t) for c, t in names.items()})
    s = block_scores(queries, candidates)
    low, high, width, missing = (queries.column(c).to_numpy() for c in ("low", "high", "width", "missing"))
    inside = (s >= low[:, None]) & (s < high[:, None])
    bound = kth(np.where(inside, s, -LONG - 1), missing)
    q, c = np.nonzero(inside & (s >= bound[:, None]))
    at = (s[q, c] - low[q]) // width[q]
    place, n = np.unique(np.stack([q, at]), axis=1, return_counts=True)
    return pa.table({"rid": pa.array(queries.column("rid").to_numpy()[place[0]]), "bin": pa.array(place[1]), "n": pa.array(n)})


def keep(queries: pa.Table, candidates: pa.Table) -> pa.Table:
    """All candidates above a query's k-th score, and of those with that score the smallest vec_ids that may be needed."""
    names = {"rid": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64(), "other": pa.int64()}
    if not len(queries) or not len(candidates):
        return pa.table({c: pa.array([], t) for c, t in names.items()})
    order = np.argsort(candidates.column("vec_id").fill_null(LONG).to_numpy(), kind="stable")
    candidates = candidates.take(pa.array(order))
    s = block_scores(queries, candidates)
    low, missing = queries.column("low").to_numpy(), queries.column("missing").to_numpy()
    own = s == -LONG - 1
    tie = (s == low[:, None]) & ~own
    q, c = np.nonzero((s > low[:, None]) & ~own | tie & (np.cumsum(tie, axis=1) <= missing[:, None]))
    return pa.table({
        "rid": pa.array(queries.column("rid").to_numpy()[q]), "query_id": queries.column("query_id").take(pa.array(q)).combine_chunks().cast(pa.int64()),
        "vec_id": candidates.column("vec_id").take(pa.array(c)).combine_chunks().cast(pa.int64()), "score": pa.array(s[q, c]),
        "other": pa.array(candidates.column("rid").to_numpy()[c])})


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """Each query's k highest scores: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows
    but the query's own. Vectors that are null, empty or hold null or non-finite
    components take no part. Of two vectors the shorter one counts as filled up with
    zeros. Ties go to the smaller vec_id, null last. Equal rows are queries and
    candidates each on its own. An empty table gives no rows. Columns other than
    vec_id and embedding are not read.
    """
    rows = pick(vectors, "vec_id", "embedding").withColumnRenamed("embedding", "vector")
    rows = rows.filter(usable(F.col("vector"))).select(F.col("vec_id").cast("long").alias("vec_id"), "vector", F.monotonically_increasing_id().alias("rid"))
    rows = saved(rows, "vectors")  # written once, so that the row numbers hold
    size = F.aggregate("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(F.floor(x.cast("double") * SCALE).cast("double"))))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("m"), F.max(size).alias("size"), F.max(F.size("vector")).alias("dims")).first()
    blocks, slices = max(SPREAD, -(-facts.n // CANDIDATES)), max(1, -(-facts.m // QUERIES))
    most = min(LONG // 4, int((facts.size or 0) ** 2 * (facts.dims or 0)) + 1)
    there = rows.toDF(*rows.columns).withColumn("cb", F.pmod(F.xxhash64("rid"), F.lit(blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("qb", F.col("qb").cast("long"))
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("qb", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(slices)))
    state = asked.select("rid", F.lit(-most).cast("long").alias("low"), F.lit(most + 1).cast("long").alias("high"), F.lit(k).cast("long").alias("missing"))
    asked = asked.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("cb", F.col("cb").cast("long")).withColumnRenamed("vec_id", "query_id")

    def meet(state: DataFrame, fn, schema: str) -> DataFrame:
        queries = asked.join(state, "rid").withColumn("width", F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low")) / BINS)).cast("long"))
        return queries.groupBy("qb", "cb").cogroup(there.groupBy("qb", "cb")).applyInArrow(fn, schema)

    wide = 2 * most + 1
    while wide > 1:
        bins = meet(state, count, "rid long, bin long, n long").groupBy("rid", "bin").agg(F.sum("n").alias("n"))
        above = F.coalesce(F.sum("n").over(W.partitionBy("rid").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        hit = bins.withColumn("above", above).join(state, "rid").filter((F.col("above") < F.col("missing")) & (F.col("above") + F.col("n") >= F.col("missing")))
        width = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low")) / BINS)).cast("long")
        hit = hit.select("rid", (F.col("low") + F.col("bin") * width).alias("at"), width.alias("step"), F.col("above").alias("over"))
        # a query with fewer than k candidates has no such bin and keeps them all
        state = durable(state.join(hit, "rid", "left").select(
            "rid", F.coalesce("at", F.lit(-LONG)).alias("low"), F.coalesce(F.col("at") + F.col("step"), F.lit(-LONG + 1)).alias("high"),
            (F.col("missing") - F.coalesce("over", F.lit(0))).alias("missing")))
        wide = max(1, -(-wide // BINS))
    found = meet(state, keep, "rid long, query_id long, vec_id long, score long, other long")
    rank = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
