"""Near-duplicate vectors through spherical k-means cells.

Equal vectors of one label are one node that counts as often as it occurs. Nodes go
to the cell of their nearest centre; the centres come from a bounded sample. A node
also visits every earlier cell whose centre is at most MARGIN less similar than its
own, for a close pair may lie on both sides of a border: for unit vectors at cosine
0.93 in 64 dimensions the difference of two such similarities has a deviation of
about 0.07. Within (label, cell) rows are dealt to blocks of about BLOCK nodes, and
each pair of blocks is one product. A product returns counts and a spanning forest
of the links that it found, never the pairs themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchloom.llm.common import durable, pick, saved
from matchloom.llm.components import components
from matchloom.llm.simhash import forest
from matchloom.llm.vectors import matrix, units, usable

COSINE = 0.93
MARGIN = 0.25
BLOCK = 384
#: Sampled nodes per centre; fewest and most centres; rounds of k-means.
SAMPLE = 32
CENTRES = (8, 2_048)
TURNS = 8


def k_means(points: np.ndarray, k: int, turns: int = TURNS) -> np.ndarray:
    centres = points[:k].copy()
    for _ in range(turns):
        nearest = np.argmax(points @ centres.T, axis=1)
        for c in range(len(centres)):
            total = points[nearest == c].sum(axis=0)
            size = np.sqrt((total ** 2).sum())
            if size > 1e-12:
                centres[c] = total / size
    return centres


def cells(centres: np.ndarray, margin: float):
    """Batches (node, label, dims, vector, n) to one row per cell that a node lives in or visits."""
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            near = units(matrix(batch.column("vector"), centres.shape[1])) @ centres.T
            home = np.argmax(near, axis=1)
            own = near[np.arange(len(near)), home]
            row, cell = np.nonzero((near >= own[:, None] - margin) & (np.arange(len(centres))[None] <= home[:, None]))
            rows = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell.astype(np.int32)), pa.array(cell == home[row])],
                                             names=[*batch.schema.names, "cell", "home"])
    return run


def compare(cosine: float):
    """One pair of blocks to rows (node, n, other): links of a node, or an edge of the forest."""
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        nodes, times = table.column("node").to_numpy(zero_copy_only=False), table.column("n").to_numpy()
        x = units(matrix(table.column("vector")))
        left = np.flatnonzero(side == 0)
        alone = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        right = left if alone else np.flatnonzero(side == 1)
        near = x[left] @ x[right].T >= cosine
        if alone:
            np.fill_diagonal(near, False)
        counts = np.zeros(len(nodes), np.int64)
        counts[left] += near @ times[right]
        if not alone:
            counts[right] += times[left] @ near
        a, b = np.nonzero(near)
        a, b = forest([(left[a], right[b])]) if len(a) else (np.zeros(0, int), np.zeros(0, int))
        some = np.flatnonzero(counts)
        return pa.table({
            "node": pa.array(np.concatenate([nodes[some], nodes[a]]), pa.string()),
            "n": pa.array(np.concatenate([counts[some], np.zeros(len(a), np.int64)])),
            "other": pa.array([None] * len(some) + list(nodes[b]), pa.string())})
    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, margin: float = MARGIN, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links join vectors of one label and one dimension. Vectors that are null, zero or
    hold null or non-finite components, and those without a label, link with nothing
    and are components of their own. Equal rows are linked to each other. A null
    vec_id takes part; component_id is the smallest that isn't null, and kept compares
    null with null as equal. An empty table gives no rows. Columns other than vec_id,
    embedding and label are not read.
    """
    rows = pick(vectors, "vec_id", "label", "embedding").withColumnRenamed("embedding", "vector")
    good = usable(F.col("vector")) & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull()
    hashes = [F.lpad(F.hex(F.xxhash64(F.lit(k), F.col("label"), F.transform("vector", lambda x: x + F.lit(0.0)))), 16, "0") for k in (1, 2)]
    rows = saved(rows.withColumn("node", F.when(good, F.concat(*hashes))), "vectors")
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("label").alias("label"), F.min("vector").alias("vector"))
    nodes = saved(nodes.withColumn("dims", F.size("vector")), "nodes")
    total = nodes.count()
    k = int(np.clip(np.sqrt(total) / 4, *CENTRES))
    sample = nodes.select("node", "vector").orderBy("node").limit(SAMPLE * k).toArrow()  # the node is a hash; at most SAMPLE * CENTRES[1] rows
    if total:
        centres = k_means(units(matrix(sample.column("vector"))), min(k, total))
        found = links(nodes, centres, cosine, margin, block)
    else:
        found = nodes.select("node", "n", F.lit(None).cast("string").alias("other")).limit(0)
    joined = components(found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counted = found.groupBy("node").agg(F.sum("n").alias("links"))
    facts = nodes.select("node", "least", "n").join(counted, "node", "left").join(joined, "node", "left")
    facts = durable(facts.select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    least = durable(facts.groupBy("root").agg(F.min("least").alias("component_id")))
    facts = durable(facts.join(least, "root").select("node", "n_links", "component_id"))
    inside = rows.filter("node IS NOT NULL").select("vec_id", "node").join(facts, "node").select("vec_id", "n_links", "component_id")
    outside = rows.filter("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.unionByName(outside).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def links(nodes: DataFrame, centres: np.ndarray, cosine: float, margin: float, block: int) -> DataFrame:
    """Rows (node, n, other) of all block products, saved."""
    spec = nodes.select("node", "label", "dims", "vector", "n")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spec.schema)
    dealt = saved(spec.mapInArrow(cells(centres, margin), f"{kinds}, cell int, home boolean"), "cells")
    key = ["label", "dims", "cell"]
    sizes = dealt.groupBy(*key).agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visits"))
    sizes = durable(sizes.select(*key, F.ceil(F.col("homes") / block).cast("int").alias("h"), F.ceil(F.col("visits") / block).cast("int").alias("v")))
    place = F.when(F.col("home"), F.pmod(F.xxhash64("node"), "h")).otherwise(F.col("h") + F.pmod(F.xxhash64("node"), "v")).cast("int")
    placed = dealt.join(sizes, key).filter("h > 0").withColumn("b", place)
    partner = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("h") + F.col("v")).otherwise(F.col("h")) - 1))
    pairs = placed.withColumn("p", partner).select(
        *key, "node", "n", "vector", F.least("b", "p").alias("i"), F.greatest("b", "p").alias("j"), F.when(F.col("b") <= F.col("p"), 0).otherwise(1).alias("side"))
    return saved(pairs.groupBy(*key, "i", "j").applyInArrow(compare(cosine), "node string, n long, other string"), "links")
