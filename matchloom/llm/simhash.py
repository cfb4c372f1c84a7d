"""SimHash fingerprints and their exact neighbours through a vantage-point tree.

A fingerprint is 64 majority bits of the XXH64 hashes of a text's word shingles.
Equal fingerprints are one node. A tree of vantage points, built from a bounded
sample, deals the nodes to shards by Hamming distance: at most the node's radius
goes left, the rest right. A node lives in one shard and also visits every earlier
shard that the triangle inequality can't exclude, so a pair within the threshold
always meets in the home shard of one of its ends. Inside a shard the same split
goes on in memory until the blocks are small enough to compare directly.

The tree (at most 2 ** DEEPEST nodes) is the only thing sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql import Window as W

from matchloom.llm.common import durable, pick, saved, surely, position
from matchloom.llm.components import components

SHINGLE = 3
BITS = 2
#: Fingerprints from which the tree is built, and the size of a shard that it aims at.
SAMPLE = 20_000
SHARD = 8_192
DEEPEST = 12
#: Shingles hashed at a time, and pairs compared at a time.
SLICE = 1 << 16
BLOCK = 1 << 10


def fingerprint(data: bytes, width: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of UTF-8 text; no words give 0."""
    words = data.lower().split()  # of bytes: A-Z only, and exactly \x20\x09-\x0D
    if not words:
        return 0
    if len(words) < width:
        parts = [b" ".join(words)]
    else:
        parts = None
    total = len(words) - width + 1 if parts is None else 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, SLICE):
        some = parts or map(b" ".join, zip(*(words[at + k:min(at + SLICE, total) + k] for k in range(width))))
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in some), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(x or b"") for x in texts.cast(pa.binary()).to_pylist()], pa.int64())


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def radius(d: np.ndarray) -> int | None:
    """The distance that splits most evenly; None if all are equal."""
    counts = np.cumsum(np.bincount(d, minlength=65))
    best = int(np.argmin(np.abs(counts - len(d) / 2)))
    return best if 0 < counts[best] < len(d) else None


def grow(sample: np.ndarray, depth: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, radius, left, right); a child is a node's place, or -1 - shard."""
    nodes: list = []
    shards = 0

    def build(points: np.ndarray, level: int) -> int:
        nonlocal shards
        for point in points[:8] if level else ():
            mu = radius(d := distance(points, point))
            if mu is not None:
                me = len(nodes)
                nodes.append(None)
                left = build(points[d <= mu], level - 1)
                nodes[me] = (int(point), mu, left, build(points[d > mu], level - 1))
                return me
        shards += 1
        return -shards

    build(sample, depth)
    return nodes


def route(fps: np.ndarray, tree: list, bits: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """For every shard: its number, and the points that live there or have to visit it."""
    def walk(at: int, points: np.ndarray, home: bool):
        if not len(points):
            return
        if at < 0:
            yield -1 - at, points, home
            return
        vantage, mu, left, right = tree[at]
        d = distance(points, np.uint64(vantage))
        yield from walk(left, points[d <= mu], home)
        if home:  # a home point further right visits the left only: earlier shards
            yield from walk(right, points[d > mu], True)
            yield from walk(left, points[(d > mu) & (d <= mu + bits)], False)
        else:
            yield from walk(left, points[d <= mu + bits], False)
            yield from walk(right, points[d > mu - bits], False)
    yield from walk(0 if tree else -1, fps, True)


def links(home: np.ndarray, visitors: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within ``bits`` of two home points, or of a home point and a visitor."""
    if not len(home):
        return
    if len(home) > BLOCK:
        for point in home[:: max(1, len(home) // 8)]:
            mu = radius(d := distance(home, point))
            if mu is not None:
                e = distance(visitors, point)
                yield from links(home[d <= mu], np.concatenate([visitors[e <= mu + bits], home[(d > mu) & (d <= mu + bits)]]), bits)
                yield from links(home[d > mu], visitors[e > mu - bits], bits)
                return
    for i in range(0, len(home), BLOCK):
        block = home[i:i + BLOCK]
        others = np.concatenate([home[i + 1:], visitors])
        for j in range(0, len(others), BLOCK):
            x, y = np.nonzero(distance(block[:, None], others[None, j:j + BLOCK]) <= bits)
            if len(x):
                yield block[x], others[j + y]


def forest(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the smallest point of each group that the pairs connect: as many as points, not as pairs."""
    a, b = (np.concatenate(x) for x in zip(*pairs))
    points, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    label = np.arange(len(points))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    moved = np.flatnonzero(label != np.arange(len(points)))
    return points[moved], points[label[moved]]


def shard_rows(tree: list, bits: int):
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, points, home in route(fps, tree, bits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(points), shard, np.int32)), pa.array(points.view(np.int64)), pa.array(np.full(len(points), home))],
                    names=["shard", "fp", "home"])
    return run


def shard_links(bits: int):
    def run(table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy()
        fps = table.column("fp").to_numpy().view(np.uint64)
        a = b = np.zeros(0, np.uint64)
        found, size = [], 0
        for pair in links(fps[home], fps[~home], bits):
            found.append(pair)
            size += len(pair[0])
            if size > 1 << 20:  # only a forest is kept, however many pairs there are
                found = [forest(found)]
                size = len(found[0][0])
        if found:
            a, b = forest(found)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})
    return run


def neighbours(nodes: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` exactly as all pairs within ``bits`` do."""
    spark = nodes.sparkSession
    sample = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toArrow()
    sample = sample.column(0).to_numpy().view(np.uint64)
    depth = min(DEEPEST, max(0, int(np.ceil(np.log2(max(1, nodes.count()) / shard)))))
    tree = grow(sample, depth)
    dealt = nodes.select("fp").mapInArrow(shard_rows(tree, bits), "shard int, fp long, home boolean")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionByRange(parts, "shard")
    return dealt.groupBy("shard").applyInArrow(shard_links(bits), "a long, b long")


def classes(rows: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """Rows (fp, root, component_id) per distinct fingerprint of saved rows (doc_id, fp)."""
    nodes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(neighbours(nodes, bits, shard))
    joined = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    joined = durable(joined.select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = durable(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    return durable(joined.join(least, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hexadecimal digits), component_id.

    A null text is an empty one: fingerprint zero, linked like any other. Equal
    rows give equal rows. A null doc_id takes part, but component_id is the
    smallest doc_id that isn't null (null if there is none). An empty table gives
    no rows. Columns other than doc_id and text are not read.
    """
    rows = saved(pick(docs, "doc_id", "text").select("doc_id", fingerprints("text").alias("fp")), "simhash")
    return rows.join(classes(rows, bits, shard), "fp").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """The rows of one document per group, with all their columns: the smallest doc_id, once."""
    names = docs.columns
    plain, text = surely(docs, "text")
    ids = f"_{position(docs, 'doc_id')}"
    whole = saved(plain.withColumn("fp", fingerprints(text)), "simhash")
    slim = whole.select(F.col(ids).alias("doc_id"), "fp")
    kept = slim.join(classes(slim, bits, shard), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.groupBy("root", "doc_id").agg(F.min("fp").alias("fp"))
    key = F.coalesce(F.col(ids).cast("string"), F.lit("null"))
    kept = kept.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_key"), "fp")
    rows = whole.withColumn("_key", key).join(kept, ["_key", "fp"], "left_semi")
    first = F.row_number().over(W.partitionBy("_key", "fp").orderBy(F.xxhash64(*plain.columns)))
    return rows.withColumn("_n", first).filter("_n = 1").select(*plain.columns).toDF(*names)
