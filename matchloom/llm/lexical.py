"""Ranked lexical search through range-maximum tables over posting lists.

Documents become blocks of an inverted index that hold the terms of any query. Within
a block every posting list has a sparse table: for each power of two the posting of
largest impact in each run of that length, so the largest impact of a term in an
interval of documents is one comparison. The sum of these answers bounds every score
in the interval. A query starts with the whole block as one interval; the intervals
of highest bound are split at their document of maximum impact, which is scored
exactly, and what remains on both sides is bounded again, until no bound reaches the
score of the last place. Only terms that have postings in an interval go on with it.
Intervals of one round are split together, as arrays.

Documents of a block are in order of length, as short ones and long ones have
different impacts, which makes bounds tight. A query keeps its last place from one
block of a task to the next.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from matchloom.llm.common import durable, pick, saved

K = 50
#: Postings and documents in a block of the index; blocks that a task searches; queries in a block.
POSTINGS = 1_000_000
DOCUMENTS = 16_384
TOGETHER = 8
SPREAD = 16
QUERIES = 256
#: Intervals split in a round.
ROUND = 256
#: Bits of the filter that keeps terms of no query out of the index; remembered decisions.
BITS = 1 << 22
CACHE = 1 << 20

SPLIT = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters; only A-Z lower-cased."""
    return (text or "").encode().translate(SPLIT).split()


class Wanted(dict):
    """Whether a term may be one of a query: term -> bool, through a filter of fixed size."""

    def __init__(self, bits: np.ndarray) -> None:
        super().__init__()
        self.bits = bits

    def __missing__(self, term: bytes) -> bool:
        h = xxhash.xxh64_intdigest(term, 42)
        found = all(int(self.bits[p >> 6]) >> (p & 63) & 1 for p in (h & BITS - 1, h >> 32 & BITS - 1))
        if len(self) >= CACHE:
            self.clear()
        self[term] = found
        return found


class Block:
    """Documents on their way into a block of the index."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.n, self.words, self.postings = [], [], 0, 0, 0
        self.lists: dict[bytes, tuple[list[int], list[int]]] = {}

    def add(self, doc_id, text: str, wanted: Wanted) -> None:
        found = terms(text)
        if not found:
            return
        self.n += 1
        self.words += len(found)
        place, some = len(self.ids), False
        for term, tf in Counter(found).items():
            if wanted[term]:
                at = self.lists.get(term)
                if at is None:
                    at = self.lists[term] = [], []
                at[0].append(place)
                at[1].append(tf)
                self.postings += 1
                some = True
        if some:
            self.ids.append(doc_id)
            self.sizes.append(len(found))

    def row(self) -> list:
        """Columns of the block, documents in order of length."""
        order = np.argsort(self.sizes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        names = sorted(self.lists)
        counts = np.array([len(self.lists[t][0]) for t in names], np.int64)
        place = rank[np.fromiter((p for t in names for p in self.lists[t][0]), np.int64, self.postings)]
        tf = np.fromiter((f for t in names for f in self.lists[t][1]), np.int64, self.postings)
        by = np.lexsort((place, np.repeat(np.arange(len(names)), counts)))
        sizes = np.array(self.sizes, np.int64)[order]
        return [self.n, self.words, [self.ids[i] for i in order], sizes, names, counts.astype(np.int32), place[by].astype(np.int32), tf[by].astype(np.int32)]


BLOCK = [("n", pa.int64()), ("words", pa.int64()), ("ids", None), ("sizes", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())),
         ("counts", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))]


def index(bits: np.ndarray, postings: int, documents: int):
    """Batches (doc_id, text) to blocks."""
    def flat(block: Block, kind: pa.DataType) -> pa.RecordBatch:
        values = [pa.array([v], t or pa.list_(kind)) for v, (_, t) in zip(block.row(), BLOCK)]
        return pa.RecordBatch.from_arrays(values, names=[c for c, _ in BLOCK])

    def run(batches):
        wanted, block, kind = Wanted(bits), Block(), None
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(doc_id, text.as_py(), wanted)
                if block.postings >= postings or len(block.ids) >= documents:
                    yield flat(block, kind)
                    block = Block()
        if block.n:
            yield flat(block, kind)
    return run


class Postings:
    """One block with impacts and range-maximum tables."""

    def __init__(self, names: list[bytes], counts, places, tfs, sizes, weights: dict[bytes, int], n: int, words: int) -> None:
        some = np.array([t in weights for t in names], bool)
        inside = np.repeat(some, counts)
        self.slot = {t: i for i, t in enumerate(t for t, s in zip(names, some) if s)}
        counts = np.asarray(counts, np.int64)[some]
        self.place, tf = np.asarray(places, np.int64)[inside], np.asarray(tfs, np.int64)[inside]
        self.start = np.concatenate([[0], np.cumsum(counts)])
        weight = np.repeat(np.array([weights[t] for t in self.slot], np.int64), counts)
        m = 50 + 50 * np.asarray(sizes, np.int64) * n // max(words, 1)
        self.impact = weight * (1_000_000_000 * tf // (1000 * tf + 20 * m[self.place]))
        self.width = len(sizes)
        self.key = np.repeat(np.arange(len(counts)), counts) * self.width + self.place
        self.tables = [np.arange(len(self.place), dtype=np.int32)]
        for k in range(int(counts.max(initial=1)).bit_length() - 1):
            half = self.tables[-1]
            other = np.concatenate([half[1 << k:], half[len(half) - (1 << k):]]) if len(half) > 1 << k else half
            self.tables.append(np.where(self.impact[half] >= self.impact[other], half, other))
        self.tables = np.stack(self.tables)

    def highest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Position of the largest impact in each run a..b of a posting list."""
        k = np.frexp((b - a + 1).astype(float))[1] - 1
        one, two = self.tables[k, a], self.tables[k, b - (1 << k) + 1]
        return np.where(self.impact[one] >= self.impact[two], one, two)

    def intervals(self, owner: np.ndarray, a: np.ndarray, b: np.ndarray):
        """Runs of terms, grouped by interval: first run of each, bound, and split document."""
        top = self.highest(a, b)
        high = self.impact[top]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        bound, most = np.add.reduceat(high, first), np.maximum.reduceat(high, first)
        counts = np.diff(np.append(first, len(owner)))
        best = np.flatnonzero(high == np.repeat(most, counts))
        best = best[np.concatenate([[True], owner[best[1:]] != owner[best[:-1]]])]
        return bound, counts, self.place[top[best]]

    def search(self, query: list[bytes], k: int, least: int, batch: int = ROUND) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of all documents that may be among the best k, given that k elsewhere reach ``least``."""
        slots = np.array(sorted(self.slot[t] for t in query if t in self.slot), np.int64)
        places, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        held, least = np.zeros(0, np.int64), max(least, 1)
        if len(slots):
            a, b = self.start[slots], self.start[slots + 1] - 1
            bound, counts, split = self.intervals(np.zeros(len(slots), np.int64), a, b)
            while len(bound):
                go = bound >= least
                chosen = go
                if go.sum() > batch:
                    chosen = np.zeros(len(bound), bool)
                    chosen[np.argpartition(-bound, batch)[:batch]] = True
                wait = go & ~chosen
                now, later = np.repeat(chosen, counts), np.repeat(wait, counts)
                doc, size = split[chosen], counts[chosen]
                if not len(doc):
                    break
                s, x, y = slots[now], a[now], b[now]
                owner = np.repeat(np.arange(len(doc)), size)
                want = s * self.width + doc[owner]
                at = np.searchsorted(self.key, want)
                hit = self.key[np.minimum(at, len(self.key) - 1)] == want
                first = np.concatenate([[0], np.cumsum(size)[:-1]])
                score = np.add.reduceat(np.where(hit, self.impact[np.minimum(at, len(self.key) - 1)], 0), first)
                good = score >= least
                places.append(doc[good])
                scores.append(score[good])
                held = np.concatenate([held, score[good]])
                if len(held) >= k:
                    held = np.partition(held, len(held) - k)[len(held) - k:]
                    least = max(least, int(held.min()))
                left, right = x <= at - 1, at + hit <= y
                owner = np.concatenate([owner[left], owner[right] + len(doc)])
                s2, a2, b2 = np.concatenate([s[left], s[right]]), np.concatenate([x[left], (at + hit)[right]]), np.concatenate([(at - 1)[left], y[right]])
                if len(owner):
                    bound2, counts2, split2 = self.intervals(owner, a2, b2)
                    fine = bound2 >= least
                    runs = np.repeat(fine, counts2)
                    slots, a, b = np.concatenate([slots[later], s2[runs]]), np.concatenate([a[later], a2[runs]]), np.concatenate([b[later], b2[runs]])
                    bound, counts, split = np.concatenate([bound[wait], bound2[fine]]), np.concatenate([counts[wait], counts2[fine]]), np.concatenate([split[wait], split2[fine]])
                else:
                    slots, a, b, bound, counts, split = slots[later], a[later], b[later], bound[wait], counts[wait], split[wait]
        place, score = np.concatenate(places), np.concatenate(scores)
        fine = score >= least
        return place[fine], score[fine], least


def searched(n: int, words: int, k: int, batch: int):
    """A group of index blocks and a block of queries to rows (rid, item_id, doc_id, score)."""
    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        rid, item, doc, score = [], [], [], []
        asked = queries.select(["rid", "item_id", "terms", "weights"]).to_pylist() if len(blocks) else []
        weights = {t: w for q in asked for t, w in zip(q["terms"], q["weights"])}
        least = [0] * len(asked)
        held = [np.zeros(0, np.int64)] * len(asked)
        kind = blocks.schema.field("ids").type.value_type
        for b in range(len(blocks)):
            values = {c: blocks.column(c)[b].values for c in ("ids", "sizes", "terms", "counts", "places", "tfs")}
            arrays = [values[c].to_numpy(zero_copy_only=False) for c in ("counts", "places", "tfs", "sizes")]
            block = Postings(values["terms"].to_pylist(), *arrays, weights, n, words)
            for i, q in enumerate(asked):
                place, value, _ = block.search(q["terms"], k, least[i], batch)
                held[i] = np.concatenate([held[i], value])
                if len(held[i]) >= k:
                    held[i] = np.partition(held[i], len(held[i]) - k)[len(held[i]) - k:]
                    least[i] = int(held[i].min())
                rid += [q["rid"]] * len(place)
                item += [q["item_id"]] * len(place)
                doc.append(values["ids"].take(pa.array(place)))
                score.append(value)
        return pa.table({
            "rid": pa.array(rid, pa.int64()), "item_id": pa.array(item, queries.schema.field("item_id").type),
            "doc_id": pa.concat_arrays(doc) if doc else pa.array([], kind), "score": pa.array(np.concatenate(score) if score else [], pa.int64())})
    return run


def asked_terms(batches):
    """Batches (rid, text) to batches with the distinct terms of each text."""
    for batch in batches:
        found = [sorted(set(terms(x))) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["rid", "terms"])


def filter_bits(words: DataFrame) -> np.ndarray:
    """A filter of BITS bits with two of each term: BITS / 64 numbers at most come to the driver."""
    h = F.xxhash64("term")
    spots = words.select(F.explode(F.array(h.bitwiseAND(F.lit(BITS - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(BITS - 1)))).alias("p"))
    spots = spots.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS INT)))").alias("bits"))
    out = np.zeros(BITS // 64, np.uint64)
    found = spots.toArrow()
    out[found.column("w").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = K, postings: int = POSTINGS, documents: int = DOCUMENTS, batch: int = ROUND) -> DataFrame:
    """The k documents of highest score above 0 for each item: item_id, rank, doc_id, score.

    Each row of either table is an item or a document of its own, equal rows and null
    ids too; equal scores are in order of doc_id, null last. A null or empty text has
    no terms: such an item has no rows, such a document doesn't count. A text may be of
    any length. An empty table gives no rows. Columns other than item_id, doc_id and
    text are not read.
    """
    queries = saved(pick(items, "item_id", "text").withColumn("rid", F.monotonically_increasing_id()), "items")
    words = saved(queries.select("rid", "text").mapInArrow(asked_terms, "rid long, terms array<binary>"), "terms")
    words = words.select("rid", F.explode("terms").alias("term"))
    bits = filter_bits(words)
    rows = pick(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    spec = f"n long, words long, ids array<{kind}>, sizes array<long>, terms array<binary>, counts array<int>, places array<int>, tfs array<int>"
    blocks = saved(rows.mapInArrow(index(bits, postings, documents), spec), "blocks")
    facts = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("blocks")).first()
    df = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2 * facts.n + 2).cast("double")) / (F.lit(2) * F.col("df") + 1))).cast("long")
    weighted = words.join(df.select("term", weight.alias("w")), "term").groupBy("rid").agg(
        F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights"))
    slices = max(1, -(-queries.count() // QUERIES))
    groups = max(SPREAD, -(-facts.blocks // TOGETHER))
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    weighted = weighted.join(queries.select("rid", "item_id"), "rid").withColumn("qb", slot("rid", slices))
    weighted = durable(weighted).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    there = blocks.withColumn("cb", slot("places", groups)).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    item = queries.schema["item_id"].dataType.simpleString()
    found = there.groupBy("qb", "cb").cogroup(weighted.groupBy("qb", "cb")).applyInArrow(
        searched(facts.n, facts.words, k, batch), f"rid long, item_id {item}, doc_id {kind}, score long")
    rank = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
