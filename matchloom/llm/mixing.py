"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words. Its documents stand in a fixed order,
each with the same expected number of copies (target / words of the source); the
running sum of the expected copies, shifted by one random offset per source,
emits a document once for each whole number that it crosses. Documents stand by
size, so that a source's words stay within about one document of the target.

The running sum is the rate times the rank. The rank of a row is its number within
(source, size, two hexadecimal digits of a hash) plus two offsets from tables of
counts, so no source and no size is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from matchloom.llm.common import SPACE, pick, position, saved, surely

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE)).cast("long"), F.lit(0).cast("long"))


def offset(source: Column, seed: str) -> Column:
    """The random offset of a source, in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), source).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(2.0 ** 32)


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to rows (src, nul, source_size), one per source.

    Sharing the excess again and again ends where every source has the least of
    its cap and weight x level. With sources by cap / weight, the level is that of
    the first one that stays below its cap when all before it are capped; further on it only falls.
    """
    everything = W.partitionBy()
    by_name = everything.orderBy("nul", "src")
    by_ratio = everything.orderBy("ratio", "nul", "src")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.lit(most) * F.col("source_size")
    x = sources.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    x = x.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
    x = x.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    final = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)
    x = x.withColumn("final", final)
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("final")))
    return x.select("src", "nul", "source_size", target.alias("target"))


def ranked(rows: DataFrame, seed: str, weights, share: float, most: float) -> DataFrame:
    """Rows with _src, _nul, _size, _hash, _bucket, _tie: adds _source_size, _target, _copies."""
    key = ["_src", "_nul", "_size", "_bucket"]
    # written once: everything but the ranks themselves comes from these counts
    buckets = saved(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    sizes = buckets.groupBy("_src", "_nul", "_size").agg(F.sum("n").alias("n"))
    source = W.partitionBy("_src", "_nul")
    sizes = sizes.select(
        "_src", "_nul", "_size",
        (F.sum("n").over(source.orderBy("_size")) - F.col("n")).alias("before_size"))
    totals = buckets.groupBy("_src", "_nul").agg(F.sum(F.col("_size") * F.col("n")).alias("source_size"))
    goal = targets(totals.select(F.col("_src").alias("src"), F.col("_nul").alias("nul"), "source_size"), weights, share, most)
    goal = goal.select(F.col("src").alias("_src"), F.col("nul").alias("_nul"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    sizes = sizes.join(goal, ["_src", "_nul"])
    within = W.partitionBy("_src", "_nul", "_size").orderBy("_bucket")
    offsets = buckets.withColumn("before_bucket", F.sum("n").over(within) - F.col("n")).join(sizes, ["_src", "_nul", "_size"])
    offsets = offsets.select(*key, (F.col("before_size") + F.col("before_bucket")).alias("_before"), "_source_size", "_target")
    numbered = rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("_hash", "_tie", "_more")))
    out = numbered.join(offsets, key)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    rank = F.col("_before") + F.col("_n")
    u = offset(F.col("_src"), seed)
    copies = F.floor(rate * rank + u) - F.floor(rate * (rank - 1) + u)
    return out.withColumn("_copies", copies.cast("long"))


def prepared(rows: DataFrame, doc_id: str, text: Column, source: str) -> DataFrame:
    name = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return rows.withColumns({
        "_src": F.coalesce(F.col(source), F.lit("")), "_nul": F.col(source).isNull(), "_size": words(text),
        "_hash": name, "_bucket": F.substring(name, 1, 2), "_tie": F.col(doc_id), "_more": F.xxhash64(text)})


def mix(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken.

    A null text has size 0, a null source is a source of its own and comes last,
    an empty source or table takes nothing. Equal rows each have their own rank.
    Columns other than doc_id, text and source are not read.
    """
    rows = prepared(pick(docs, "doc_id", "text", "source"), "doc_id", F.col("text"), "source").drop("text")
    rows = saved(rows, "mix-rows")
    out = ranked(rows, seed, weights, share, most)
    return out.select("doc_id", F.col("_size").alias("size"), "source", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
                      F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def mixed(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mixture itself: every document as often as the mix takes it, with all its columns."""
    names = docs.columns
    rows, text = surely(docs, "text")
    doc_id, source = f"_{position(docs, 'doc_id')}", f"_{position(docs, 'source')}"
    out = ranked(prepared(rows, doc_id, F.col(text), source), seed, weights, share, most)
    out = out.filter(F.col("_copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select(*(F.col(c) for c in rows.columns)).toDF(*names)
