"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node. Every node keeps a list of its nearest nodes so far; the
lists start from blocks of random partitions of the space, compared within. In a
round of descent the neighbours of a node, and those that have it as a neighbour,
are compared with each other where one of the two is new in a list: neighbours of
neighbours are likely neighbours. What beats the last entry of a list is merged into
it, until few lists change.

Nodes live in cells; a round is a join per cell of its nodes' lists with the nodes
that these lists, forwards and backwards, name: such a node visits a cell once,
however many lists there name it. Search uses the same cells. A query's beam holds
the best nodes so far; those not yet expanded are sent to their cells, which compare
the query with their neighbours and return what beats the beam. It ends when every
node of the beam is expanded. Graph and beams use vectors of one byte a component;
the best of a beam are ranked by cosines of the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from matchloom.llm.common import durable, pick, saved
from matchloom.llm.vectors import matrix, usable

K = 5
EVERY = 50
#: Length of the lists, and most backward neighbours that a node's round or search uses (a sample by hash).
LIST = 16
BACK = 16
#: Random partitions for the start, levels of each, nodes in a block; sampled nodes for their medians.
TREES = 4
LEVELS = 12
LEAF = 2_048
SAMPLE = 4_096
#: Nodes in a cell; candidates per node that a cell returns in a round.
CELL = 16_384
MOST = 8
ROUNDS = 4
#: Descent ends when a smaller share of all entries is new.
SETTLED = 0.02
#: Nodes of a beam, and of these how many are ranked by their original vectors.
BEAM = 256
RANKED = 32
BUCKET = 8_192
QUERIES = 512
SEED = 11
NOTHING = -2.0

GRAPH = "node long, cell int, code binary, nbrs array<long>, cells array<int>, sims array<float>, fresh array<boolean>"
FOUND = "node long, nbrs array<long>, cells array<int>, sims array<float>"


def coded(rows: np.ndarray) -> np.ndarray:
    """Directions in one byte a component."""
    return np.round(rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True, initial=0), 5e-324) * 127).astype(np.int8)


def decoded(column, width: int) -> np.ndarray:
    """Unit rows from codes; shorter ones are filled with zeros."""
    out = np.zeros((len(column), width), np.float32)
    for i, code in enumerate(column.to_pylist()):
        out[i, :len(code)] = np.frombuffer(code, np.int8)
    return out / np.maximum(np.sqrt((out ** 2).sum(axis=1, keepdims=True)), 1e-9)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and how many each row has; a null list has none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = np.array(column.value_lengths().fill_null(0)) if len(column) else np.zeros(0, np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), counts


def best(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Places of each owner's most similar others, each once, in order."""
    one = np.unique(np.stack([owner, other]), axis=1, return_index=True)[1] if len(owner) else np.zeros(0, int)
    order = one[np.lexsort((other[one], -sim[one], owner[one]))]
    group = owner[order]
    start = np.searchsorted(group, group)
    return order[np.arange(len(order)) - start < most]


def listed(ids: np.ndarray, owner, other, sim, cell, at: np.ndarray) -> pa.Table:
    """Rows FOUND of the entries ``at``, which are in order of owner."""
    who, counts = np.unique(owner[at], return_counts=True)
    return pa.table({"node": pa.array(ids[who], pa.int64()), "nbrs": lists(ids[other[at]], counts, pa.int64()),
                     "cells": lists(cell[other[at]], counts, pa.int32()), "sims": lists(sim[at], counts, pa.float32())})


def deal(projections: np.ndarray, medians: np.ndarray, width: int):
    """Batches (node, vector) to the same with a code and the leaf in each random partition."""
    def run(batches):
        for batch in batches:
            rows = matrix(batch.column("vector"), width)
            codes, lengths = coded(rows), batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            side = np.einsum("nd,tdl->ntl", decoded(pa.array([c.tobytes() for c in codes], pa.binary()), width), projections) > medians
            leaf = (side * (1 << np.arange(side.shape[2])[::-1])).sum(axis=2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([c[:n].tobytes() for c, n in zip(codes, lengths)], pa.binary()),
                 lists(leaf.ravel(), np.full(len(leaf), side.shape[1]), pa.int32())], names=["node", "code", "leaves"])
    return run


def within(width: int, most: int):
    """The nodes of one block, all compared: rows FOUND."""
    def run(block: pa.Table) -> pa.Table:
        ids, cell = block.column("node").to_numpy(), block.column("cell").to_numpy()
        x = decoded(block.column("code").combine_chunks(), width)
        take, found = min(most, len(ids) - 1), []
        for i in range(0, len(ids), 512):
            s = x[i:i + 512] @ x.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = NOTHING
            if take > 0:
                near = np.argpartition(-s, take - 1, axis=1)[:, :take]
                found.append((np.repeat(np.arange(i, i + len(s)), take), near.ravel(), np.take_along_axis(s, near, 1).ravel()))
        owner, other, sim = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32))
        return listed(ids, owner, other, sim, cell, best(owner, other, sim, most))
    return run


def merged(size: int):
    """Old lists (with a code) and found entries of many nodes to their new lists: rows GRAPH."""
    def run(rows: pa.Table) -> pa.Table:
        base = rows.filter(rows.column("code").is_valid()).sort_by("node")
        ids = base.column("node").to_numpy()
        nbr, counts = flat(rows.column("nbrs"))
        cell, sim = flat(rows.column("cells"))[0], flat(rows.column("sims"))[0]
        owner = np.repeat(np.searchsorted(ids, rows.column("node").to_numpy()), counts)
        old = np.repeat(np.array(rows.column("code").is_valid()), counts)
        # an entry that both have is the old one: it comes first, and np.unique keeps the first
        first = np.argsort(~old, kind="stable")
        owner, nbr, cell, sim, old = owner[first], nbr[first], cell[first], sim[first], old[first]
        at = best(owner, nbr, sim, size)
        counts = np.bincount(owner[at], minlength=len(ids))
        return pa.table({
            "node": base.column("node"), "cell": base.column("cell"), "code": base.column("code"), "nbrs": lists(nbr[at], counts, pa.int64()),
            "cells": lists(cell[at], counts, pa.int32()), "sims": lists(sim[at], counts, pa.float32()), "fresh": lists(~old[at], counts, pa.bool_())})
    return run


class Cell:
    """A cell's nodes with their lists, forwards and backwards, and the nodes that these name."""

    def __init__(self, points: pa.Table, edges: pa.Table, width: int) -> None:
        points = points.sort_by("node")
        self.ids, self.cell = points.column("node").to_numpy(), points.column("cell").to_numpy()
        self.low, self.x = points.column("low").to_numpy(), decoded(points.column("code").combine_chunks(), width)
        self.home = np.flatnonzero(np.array(points.column("nbrs").is_valid()))
        at = {h: i for i, h in enumerate(self.home)}
        nbr, counts = flat(points.column("nbrs"))
        owner = np.repeat(np.arange(len(points)), counts)
        fresh = flat(points.column("fresh"))[0].astype(bool)
        back = edges.sort_by("node")
        owner = np.concatenate([owner, np.searchsorted(self.ids, back.column("node").to_numpy())])
        other = np.searchsorted(self.ids, np.concatenate([nbr, back.column("other").to_numpy()]).astype(np.int64))
        fresh = np.concatenate([fresh, back.column("fresh").to_numpy(zero_copy_only=False).astype(bool)])
        order = np.argsort(owner, kind="stable")
        owner, other, fresh = owner[order], other[order], fresh[order]
        row = np.array([at[o] for o in owner], int)
        column = np.arange(len(owner)) - np.searchsorted(owner, owner)
        self.near = np.full((len(self.home), int(column.max(initial=-1)) + 1), -1)
        self.fresh = np.zeros(self.near.shape, bool)
        self.near[row, column], self.fresh[row, column] = other, fresh


def local_join(width: int, most: int, batch: int = 128):
    """A cell to what its lists tell about their members: rows FOUND."""
    def run(points: pa.Table, edges: pa.Table) -> pa.Table:
        c = Cell(points, edges, width)
        owner, other, sim = np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
        for i in range(0, len(c.near), batch):
            near, fresh = c.near[i:i + batch], c.fresh[i:i + batch]
            s = c.x[near] @ c.x[near].transpose(0, 2, 1)
            good = (near >= 0)[:, :, None] & (near >= 0)[:, None] & (near[:, :, None] != near[:, None]) & (fresh[:, :, None] | fresh[:, None])
            good &= s > c.low[near][:, :, None]
            r, a, b = np.nonzero(good)
            owner, other, sim = np.concatenate([owner, near[r, a]]), np.concatenate([other, near[r, b]]), np.concatenate([sim, s[r, a, b]])
            if len(owner) > 2_000_000 or i + batch >= len(c.near):
                at = best(owner, other, sim, most)
                owner, other, sim = owner[at], other[at], sim[at]
        return listed(c.ids, owner, other, sim, c.cell, np.arange(len(owner)))
    return run


TABLE = "at int, node long, cell int, code binary, nbrs array<long>"


def settled(width: int):
    """A cell to rows TABLE: its nodes with the lists of both directions, and the visitors."""
    def run(points: pa.Table, edges: pa.Table) -> pa.Table:
        c, points = Cell(points, edges, width), points.sort_by("node")
        nbrs: list = [None] * len(c.ids)
        for h, near in zip(c.home, c.near):
            nbrs[h] = np.unique(c.ids[near[near >= 0]])
        return pa.table({"at": points.column("at"), "node": points.column("node"), "cell": points.column("cell"), "code": points.column("code"),
                         "nbrs": pa.array(nbrs, pa.list_(pa.int64()))})
    return run


def expand(width: int, beam: int):
    """Requests (at, query, code, low, nodes) to a cell: rows (query, nbrs, cells, sims) of what beats the beam."""
    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if len(table) and len(asked):
            table = table.sort_by("node")
            ids, cell, x = table.column("node").to_numpy(), table.column("cell").to_numpy(), decoded(table.column("code").combine_chunks(), width)
            nbr, counts = flat(table.column("nbrs"))
            place, start = np.searchsorted(ids, nbr), np.concatenate([[0], np.cumsum(counts)])
            q, low = decoded(asked.column("code").combine_chunks(), width), asked.column("low").to_numpy()
            nodes = asked.column("nodes").combine_chunks()
            for i, query in enumerate(asked.column("query").to_pylist()):
                here = np.searchsorted(ids, nodes[i].values.to_numpy())
                near = np.unique(np.concatenate([place[start[h]:start[h + 1]] for h in here]).astype(int))
                near = near[ids[near] != query]
                s = x[near] @ q[i]
                good = np.flatnonzero(s > low[i])
                if len(good) > beam:
                    good = good[np.argpartition(-s[good], beam - 1)[:beam]]
                if len(good):
                    for part, value in zip(out, (query, ids[near[good]], cell[near[good]], s[good])):
                        part.append(value)
        return pa.table({"query": pa.array(out[0], pa.int64()), "nbrs": pa.array(out[1], pa.list_(pa.int64())),
                         "cells": pa.array(out[2], pa.list_(pa.int32())), "sims": pa.array(out[3], pa.list_(pa.float32()))})
    return run


STATE = "query long, cell int, code binary, nbrs array<long>, cells array<int>, sims array<float>, due array<boolean>"


def advance(beam: int):
    """Beams and answers of many queries to their new beams; what is new in a beam is due to be expanded."""
    return lambda rows: _beams(merged(beam)(rows.rename_columns(["node", *rows.column_names[1:]])))


def _beams(table: pa.Table) -> pa.Table:
    return table.rename_columns(["query", "cell", "code", "nbrs", "cells", "sims", "due"])


def near_graph(nodes: DataFrame, total: int, width: int, size: int, trees: int, leaf: int, cell: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The lists of all nodes (GRAPH), and points and backward edges by cell as the search needs them."""
    levels = int(np.clip(np.ceil(np.log2(max(total, 1) / leaf)), 0, LEVELS))
    coarse = int(np.clip(np.ceil(np.log2(max(total, 1) / cell)), 0, levels))
    rng = np.random.default_rng(SEED)
    projections = rng.standard_normal((trees, width, levels))
    sample = nodes.select("vector").orderBy("key").limit(SAMPLE).toArrow()  # the key is a hash
    seen = coded(matrix(sample.column("vector"), width)).astype(float)
    seen /= np.maximum(np.sqrt((seen ** 2).sum(axis=1, keepdims=True)), 1e-9)
    medians = np.median(np.einsum("nd,tdl->ntl", seen, projections), axis=0)
    dealt = saved(nodes.select("node", "vector").mapInArrow(deal(projections, medians, width), "node long, code binary, leaves array<int>"), "dealt")
    # a leaf or a cell that holds more than its share is dealt on by hash
    place = dealt.withColumn("part", F.shiftright(F.col("leaves")[0], levels - coarse))
    parts = place.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("h"))  # at most 2 ** LEVELS rows
    place = place.join(F.broadcast(parts), "part").withColumn("cell", (F.col("part") + F.pmod(F.xxhash64("node"), F.col("h")) * (1 << LEVELS)).cast("int"))
    base = saved(place.select("node", "cell", "code", "leaves"), "placed")
    spots = base.select("node", "cell", "code", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = spots.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / leaf).cast("int").alias("h"))  # at most TREES * 2 ** LEVELS rows
    spots = spots.join(F.broadcast(sizes), ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("node", "tree"), F.col("h")))
    start = spots.groupBy("tree", "leaf", "block").applyInArrow(within(width, size), FOUND)
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("nbrs", "array<long>"), ("cells", "array<int>"), ("sims", "array<float>"))]
    buckets = max(8, -(-total // BUCKET))
    bucket = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))

    def merge(old: DataFrame, found: DataFrame) -> DataFrame:
        both = old.select("node", "cell", "code", "nbrs", "cells", "sims").unionByName(found, allowMissingColumns=True)
        return saved(both.groupBy(bucket("node", buckets)).applyInArrow(lambda rows: merged(size)(rows), GRAPH), "lists")

    graph = merge(base.select("node", "cell", "code", *empty), start)
    for _ in range(rounds):
        points, edges = by_cell(graph, size)
        found = points.groupBy("at").cogroup(edges.groupBy("at")).applyInArrow(local_join(width, MOST), FOUND)
        graph = merge(graph, found)
        new = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] or 0
        if new <= SETTLED * size * total:
            break
    return graph, saved((lambda p, e: p.groupBy("at").cogroup(e.groupBy("at")).applyInArrow(settled(width), TABLE))(*by_cell(graph, size)), "cells")


def by_cell(graph: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Points (home nodes with lists, visitors without) and backward edges, by the cell ``at`` where they are needed."""
    graph = graph.withColumn("low", F.when(F.size("sims") >= size, F.element_at("sims", -1)).otherwise(F.lit(NOTHING)).cast("float"))
    pairs = graph.select("node", "cell", F.explode(F.arrays_zip("nbrs", "cells", "fresh")).alias("e"))
    pairs = pairs.select("node", "cell", F.col("e.nbrs").alias("nbr"), F.col("e.cells").alias("nbr_cell"), F.col("e.fresh").alias("fresh"))
    apart = pairs.filter("cell <> nbr_cell")
    visits = apart.select(F.col("nbr").alias("node"), F.col("cell").alias("at")).unionByName(apart.select("node", F.col("nbr_cell").alias("at"))).distinct()
    facts = ["node", "cell", "code", "low"]
    visitors = visits.join(graph.select(*facts), "node").select("at", *facts)
    points = graph.select(F.col("cell").alias("at"), *facts, "nbrs", "fresh").unionByName(visitors, allowMissingColumns=True)
    rank = F.row_number().over(W.partitionBy("at", "node").orderBy(F.xxhash64("node", "other"), "other"))
    edges = pairs.select(F.col("nbr_cell").alias("at"), F.col("nbr").alias("node"), F.col("node").alias("other"), "fresh")
    return points, edges.withColumn("rank", rank).filter(F.col("rank") <= BACK).drop("rank")


def walked(graph: DataFrame, table: DataFrame, asked: DataFrame, queries: int, width: int, beam: int) -> DataFrame:
    """Rows STATE: the beam of every asked node after the greedy search."""
    spark = graph.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    table = table.repartition(tasks, "at").persist()  # dealt once; every wave reads it where it lies
    buckets = max(8, -(-queries // QUERIES))
    state = graph.join(asked, "node", "left_semi").select(F.col("node").alias("query"), "cell", "code")
    first = state.select(F.col("cell").alias("at"), "query", "code", F.lit(NOTHING).cast("float").alias("low"), F.array("query").alias("nodes"))
    state = state.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("nbrs", "array<long>"), ("cells", "array<int>"), ("sims", "array<float>"))])
    requests = first
    while True:
        answers = table.groupBy("at").cogroup(requests.groupBy("at")).applyInArrow(expand(width, beam), "query long, nbrs array<long>, cells array<int>, sims array<float>")
        both = state.select("query", "cell", "code", "nbrs", "cells", "sims").unionByName(answers, allowMissingColumns=True)
        state = saved(both.groupBy(F.pmod(F.xxhash64("query"), F.lit(buckets))).applyInArrow(lambda rows: advance(beam)(rows), STATE), "beams")
        low = F.when(F.size("sims") >= beam, F.element_at("sims", -1)).otherwise(F.lit(NOTHING)).cast("float")
        due = state.select("query", "code", low.alias("low"), F.explode(F.arrays_zip("nbrs", "cells", "due")).alias("e")).filter("e.due")
        requests = due.groupBy(F.col("e.cells").alias("at"), "query").agg(F.first("code").alias("code"), F.first("low").alias("low"), F.collect_list("e.nbrs").alias("nodes"))
        if due.isEmpty():
            break
    table.unpersist()
    return state


def search(vectors: DataFrame, k: int = K, every: int = EVERY, size: int = LIST, trees: int = TREES, leaf: int = LEAF, cell: int = CELL,
           rounds: int = ROUNDS, beam: int = BEAM) -> DataFrame:
    """The k nearest found of each query: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows
    but the query's own; equal rows are queries and candidates each on its own, and
    copies of the query come at cosine 1. Vectors that are null, empty, zero or hold
    null or non-finite components take no part. Of two vectors the shorter one counts
    as filled up with zeros. Equal scores are in order of vec_id, null last. An empty
    table gives no rows. Columns other than vec_id and embedding are not read.
    """
    rows = pick(vectors, "vec_id", "embedding").withColumnRenamed("embedding", "vector")
    rows = rows.filter(usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("vector", lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    hashes = [F.lpad(F.hex(F.xxhash64(F.lit(s), "vector")), 16, "0") for s in (1, 2)]
    rows = saved(rows.select("*", F.concat(*hashes).alias("key"), F.monotonically_increasing_id().alias("rid")), "vectors")
    nodes = rows.groupBy("key").agg(F.min("vector").alias("vector"), F.max((F.col("vec_id") % every == 0).cast("int")).alias("asked"))
    nodes = saved(nodes.select("key", "vector", F.coalesce(F.col("asked") == 1, F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("node")), "nodes")
    facts = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("q"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("width")).first()
    graph, table = near_graph(nodes, facts.n, facts.width, size, trees, leaf, cell, rounds)
    beams = walked(graph, table, nodes.filter("asked").select("node"), facts.q, facts.width, beam)
    hits = beams.select(F.col("query").alias("q"), F.explode(F.concat(F.array("query"), F.coalesce(F.slice("nbrs", 1, RANKED), F.array().cast("array<long>")))).alias("node"))
    one = nodes.select(F.col("node").alias("q"), F.col("vector").alias("a"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, r: F.coalesce(p, F.lit(0.0)) * F.coalesce(r, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    largest = lambda x: F.array_max(F.transform(x, lambda v: F.abs(v)))
    scaled = lambda x: F.transform(x, lambda v: v / largest(x))
    pairs = hits.join(one, "q").join(nodes.select("node", F.col("vector").alias("b")), "node")
    pairs = pairs.withColumn("a", scaled(F.col("a"))).withColumn("b", scaled(F.col("b")))  # so that no square overflows
    pairs = durable(pairs.select("q", "node", (dot("a", "b") / F.sqrt(dot("a", "a")) / F.sqrt(dot("b", "b"))).alias("score")))
    # of a node's rows the k + 1 smallest ids are enough
    at = F.row_number().over(W.partitionBy("key").orderBy(F.asc_nulls_last("vec_id"), "rid"))
    named = rows.select("key", "vec_id", "rid").withColumn("at", at).filter(F.col("at") <= k + 1).join(nodes.select("key", "node"), "key").select("node", "vec_id", "rid")
    queries = rows.filter(F.col("vec_id") % every == 0).join(nodes.select("key", F.col("node").alias("q")), "key")
    queries = queries.select("q", F.col("vec_id").alias("query_id"), F.col("rid").alias("query_rid"))
    found = pairs.join(named, "node")
    order = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid"))
    found = found.withColumn("order", order).filter(F.col("order") <= k + 1).drop("order")  # one of them may be the query itself
    found = queries.join(found, "q").filter("rid <> query_rid")
    rank = F.row_number().over(W.partitionBy("query_rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
