"""Repeated passages through a sparse suffix array.

Of every text only the suffixes that start at minimisers are kept: a word position
is kept if the hash of its GRAM words is the smallest (the first of equals) of
PASSAGE - GRAM + 1 neighbouring ones, so any passage of PASSAGE words holds one, at
the same place wherever the passage stands. Suffixes whose first GRAM words occur at
one place only are dropped. The rest are sorted, by a range partition that splits
also a very common beginning, and each is compared with its neighbours: first to
the right, then extended to the left. PASSAGE words to the right and PASSAGE - GRAM
to the left are enough, as longer passages hold more minimisers, whose spans are
then united.

A text that shares less may stand between two occurrences in the sorted order. So
the windows of PASSAGE words around a suffix are hashed too. All occurrences of a
window lie at suffixes of one key, that of its smallest GRAM words: a key that ends
within a batch is settled there, the windows of a key that a batch or a partition
may cut are counted in Spark, once per piece of a batch, and go back to it. Hence every passage of PASSAGE words is found.

Equal texts are one text, compared once; copies of a text repeat all of it.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from matchloom.llm.common import durable, pick, saved

PASSAGE = 50
GRAM = 20
CACHE = 400_000
LONGEST = 64
#: Rows per partition that are sampled for the bounds of the sorted partitions.
SAMPLES = 10
#: Suffixes of a text handled at a time.
SLICE = 1 << 14
#: Suffixes of a cut key whose windows are compared together; small, so that the pieces spread evenly over tasks.
PIECE = 128
BASE = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Hashes of words that a task has met."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = value
        return value


_WORDS = Words()


def hashes(text: str) -> np.ndarray:
    words = text.encode().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, mixed so that their order is as good as random."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * BASE + h[k:len(h) - n + 1 + k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def minimisers(h: np.ndarray, passage: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that are kept, and the hashes of the words that start there."""
    if len(h) < passage:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = grams(h, gram)
    width, found = passage - gram + 1, []
    for at in range(0, len(g) - width + 1, 1 << 16):  # a slice at a time, however long the text
        part = np.lib.stride_tricks.sliding_window_view(g[at:at + (1 << 16) + width - 1], width)
        found.append(np.unique(part.argmin(axis=1) + np.arange(len(part))) + at)
    at = np.unique(np.concatenate(found))
    return at, g[at]


def keep(passage: int, gram: int):
    """Batches (doc_id, text) to one row per document: its text's address, words, minimisers."""
    def run(batches):
        for batch in batches:
            tids, words, at, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                h = hashes(text or "")
                p, g = minimisers(h, passage, gram)
                tids.append(xxhash.xxh3_128_digest((text or "").encode()))
                words.append(len(h))
                at.append(p.astype(np.int32))
                keys.append(g.view(np.int64))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in at])]).astype(np.int32))
            flat = [pa.array(np.concatenate(x) if x else np.zeros(0, t), k) for x, t, k in ((at, np.int32, pa.int32()), (keys, np.int64, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tids, pa.binary()), pa.array(words, pa.int32()), *(pa.ListArray.from_arrays(ends, x) for x in flat)],
                names=["doc_id", "tid", "words", "places", "keys"])
    return run


def contexts(passage: int, gram: int):
    """Batches (tid, text, least, places) to one row per suffix with its words to both sides, as 4-byte hashes."""
    left, right = passage - gram, passage

    def run(batches):
        for batch in batches:
            for tid, text, least, places in zip(*(c.to_pylist() for c in batch.columns)):
                h = hashes(text or "").astype(">u4")
                n = len(h)
                padded = np.concatenate([np.zeros(left, ">u4"), h, np.zeros(right, ">u4")])
                keys, every = grams(hashes(text or ""), gram), np.array(sorted(places), np.int64)
                for at in np.array_split(every, -(-len(every) // SLICE)):  # however long the text
                    after = padded[at[:, None] + left + np.arange(right)]
                    before = padded[at[:, None] + left - 1 - np.arange(left)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[at].view(np.int64)), pa.array([x.tobytes() for x in after], pa.binary()), pa.array([x.tobytes() for x in before], pa.binary()),
                         pa.array([tid] * len(at), pa.binary()), pa.array(at.astype(np.int32)), pa.array(np.minimum(n - at, right).astype(np.int32)),
                         pa.array(np.minimum(at, left).astype(np.int32)), pa.array([least] * len(at), batch.schema.types[2])],
                        names=["key", "after", "before", "tid", "at", "right", "left", "least"])
    return run


def common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows, at most ``most``."""
    differ = np.concatenate([a != b, np.ones((len(a), 1), bool)], axis=1)
    return np.minimum(differ.argmax(axis=1), most)


def neighbours(passage: int, gram: int):
    """Sorted suffixes to spans (tid, start, end, other) that two neighbours share; ends of partitions come out as they are."""
    def spans(t: pa.Table, order: np.ndarray) -> list[pa.RecordBatch]:
        if len(order) < 2:
            return []
        key, at, least = t.column("key").to_numpy(), t.column("at").to_numpy(), t.column("least")
        after, before = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint32).reshape(len(t), -1) for c in ("after", "before"))
        i, j = order[:-1], order[1:]
        same = key[i] == key[j]
        i, j = i[same], j[same]
        right, left = t.column("right").to_numpy(), t.column("left").to_numpy()
        r = common(after[i], after[j], np.minimum(right[i], right[j]))
        lead = common(before[i], before[j], np.minimum(left[i], left[j]))
        good = (r >= gram) & (r + lead >= passage)
        i, j, r, lead = i[good], j[good], r[good], lead[good]
        out = []
        for x, y in ((i, j), (j, i)):
            out.append(pa.RecordBatch.from_arrays(
                [t.column("tid").take(pa.array(x)).combine_chunks(), pa.array((at[x] - lead).astype(np.int32)), pa.array((at[x] + r).astype(np.int32)), least.take(pa.array(y)).combine_chunks()],
                names=["tid", "start", "end", "other"]))
        return out

    def found(t: pa.Table) -> list[pa.RecordBatch]:
        n = len(t)
        # rows come sorted by key, right and left context
        out = spans(t, np.arange(n))
        if n > 2:
            by = [(c, "ascending") for c in ("key", "before", "after")]
            out += spans(t, pc.sort_indices(t.select(["key", "before", "after"]), by).to_numpy())
        return out
    return found


def window_hashes(t: pa.Table, passage: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of ``passage`` words around each suffix (a row of them each), which of them the text has, start of the first."""
    lead = passage - gram
    after, before = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint32).reshape(len(t), -1) for c in ("after", "before"))
    words = np.concatenate([before[:, ::-1], after], axis=1).astype(np.uint64)
    sums = np.zeros((lead + passage + 1, len(t)), np.uint64)
    for k in range(lead + passage):
        sums[k + 1] = sums[k] * BASE + words[:, k]
    power = np.uint64(pow(int(BASE), passage, 1 << 64))
    out = sums[passage:] - sums[:lead + 1] * power
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ out >> np.uint64(32)).T
    place = np.arange(lead + 1)
    has = (place >= lead - t.column("left").to_numpy()[:, None]) & (place <= t.column("right").to_numpy()[:, None] - gram)
    return np.ascontiguousarray(out), has, t.column("at").to_numpy() - lead


def repeated_windows(passage: int, gram: int):
    """Rows of a sorted batch to spans (tid, start, end, other) of windows that occur at two places, other the smallest doc_id of
    all places, for the keys that lie within the batch; for the keys that may go on outside, in pieces of PIECE suffixes,
    (tid, start, key, hashes) per suffix and (other, key, hash, low, high) per window: its smallest doc_id, the least and the largest of its places."""
    def run(t: pa.Table) -> tuple[list, list, list]:
        key, least, tid = t.column("key").to_numpy(), t.column("least"), t.column("tid").combine_chunks()
        hashes, has, first = window_hashes(t, passage, gram)
        n, width = hashes.shape
        outside = (key == key[0]) | (key == key[-1])
        spans, cut, windows = [], [], []
        texts = np.frombuffer(b"".join(x[:8] for x in tid.to_pylist()), np.uint64)
        by_id = pc.sort_indices(least).to_numpy()  # nulls last
        rank = np.empty(n, np.int64)
        rank[by_id] = np.arange(n)
        every = np.flatnonzero(outside & has.any(axis=1))
        for at in (every[i:i + PIECE] for i in range(0, len(every), PIECE)):
            inside, values = has[at], hashes[at].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(inside.sum(axis=1))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values[inside]))
            begin = (first[at] + inside.argmax(axis=1)).astype(np.int32)
            cut.append((tid.take(pa.array(at)), pa.array(begin), pa.array(key[at]), lists))
            # each window of the piece once, with the least and the largest of its places
            row, column = np.nonzero(inside)
            value, row = values[inside], at[row]
            place = (texts[row] * BASE + (first[row] + column).astype(np.uint64)).view(np.int64)
            group = np.lexsort([value, key[row]])
            value, place, row = value[group], place[group], row[group]
            head = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (key[row[1:]] != key[row[:-1]])]))
            lowest = by_id[np.minimum.reduceat(rank[row], head)]
            windows.append((least.take(pa.array(lowest)).combine_chunks(), pa.array(key[row[head]]), pa.array(value[head]),
                            pa.array(np.minimum.reduceat(place, head)), pa.array(np.maximum.reduceat(place, head))))
        has &= ~outside[:, None]
        flat = np.flatnonzero(has)
        if not len(flat):
            return spans, cut, windows
        row = flat // width
        group = np.lexsort([hashes.ravel()[flat], key[row]])
        flat, row = flat[group], row[group]
        value, owner = hashes.ravel()[flat], key[row]
        head = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]))
        place = texts[row] * BASE + (first[row] + flat % width).astype(np.uint64)
        twice = np.minimum.reduceat(place, head) != np.maximum.reduceat(place, head)
        smallest = np.minimum.reduceat(rank[row], head)
        member = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(flat))))
        best = np.full(n * width, n, np.int64)
        best[flat[twice[member]]] = smallest[member[twice[member]]]
        good = (best < n).reshape(n, width)
        if good.any():
            # neighbouring windows of a suffix are one span
            edge = np.zeros((n, 1), bool)
            start = np.flatnonzero((good & ~np.concatenate([edge, good[:, :-1]], axis=1)).ravel())
            end = np.flatnonzero((good & ~np.concatenate([good[:, 1:], edge], axis=1)).ravel())
            lowest, row = by_id[np.minimum.reduceat(best, start)], start // width
            spans.append((tid.take(pa.array(row)), pa.array((first[row] + start % width).astype(np.int32)),
                          pa.array((first[row] + end % width + passage).astype(np.int32)), least.take(pa.array(lowest)).combine_chunks()))
        return spans, cut, windows
    return run


def settled_windows(passage: int):
    """Windows of a piece that occur at two places anywhere (key, hash, first) and the piece's suffixes (tid, start, key,
    hashes) to spans (tid, start, end, other); neighbouring windows of a suffix are one span."""
    def run(again: pa.Table, cut: pa.Table) -> pa.Table:
        kind = again.schema.field("first").type
        lists = cut.column("hashes").combine_chunks() if len(cut) and len(again) else pa.array([], pa.list_(pa.int64()))
        value, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
        row, m = np.repeat(np.arange(len(size)), size), len(again)
        if not len(value):
            return pa.table({"tid": pa.array([], pa.binary()), "start": pa.array([], pa.int32()), "end": pa.array([], pa.int32()), "other": pa.array([], kind)})
        known, hashes = again.column("key").to_numpy(), again.column("hash").to_numpy()
        owner = cut.column("key").to_numpy()[row]
        by_id = pc.sort_indices(again.column("first")).to_numpy()  # nulls last
        rank = np.empty(m, np.int64)
        rank[by_id] = np.arange(m)
        best = np.full(len(value), m, np.int64)
        for k in np.unique(known):  # two at most: the first and the last key of a batch
            of, own = np.flatnonzero(known == k), np.flatnonzero(owner == k)
            of = of[np.argsort(hashes[of])]
            at = np.minimum(np.searchsorted(hashes[of], value[own]), len(of) - 1)
            best[own] = np.where(hashes[of[at]] == value[own], rank[of[at]], m)
        good, edge = best < m, row[1:] != row[:-1]
        start = np.flatnonzero(good & np.concatenate([[True], ~good[:-1] | edge]))
        end = np.flatnonzero(good & np.concatenate([~good[1:] | edge, [True]]))
        row, offset = row[start], np.cumsum(size) - size
        begin = cut.column("start").to_numpy()[row] - offset[row]
        lowest = by_id[np.minimum.reduceat(best, start)] if len(start) else start
        return pa.table({
            "tid": cut.column("tid").take(pa.array(row)), "start": pa.array((begin + start).astype(np.int32)),
            "end": pa.array((begin + end + passage).astype(np.int32)), "other": again.column("first").take(pa.array(lowest))})
    return run


def sorted_spans(passage: int, gram: int, whole: bool = True):
    """Spans of a sorted partition. Its first and last suffix also come out, for the comparison with the next partition,
    and, where ``whole``, the windows of keys that it or a batch may cut."""
    found, met = neighbours(passage, gram), repeated_windows(passage, gram)
    columns = ["key", "after", "before", "right", "left", "at", "least"]
    more = {"hashes": pa.list_(pa.int64()), "piece": pa.int64(), "hash": pa.int64(), "low": pa.int64(), "high": pa.int64()}

    def run(batches):
        last = first = None
        number = TaskContext.get().partitionId() << 32

        def edge(t: pa.Table, place: str) -> pa.RecordBatch:
            row = {c: t.column(c).combine_chunks() for c in ("tid", *columns)}
            null = pa.nulls(1, pa.int32())
            return pa.RecordBatch.from_arrays(
                [row["tid"], null, null, pa.nulls(1, row["least"].type), pa.array([place]), *(row[c] for c in columns), *(pa.nulls(1, k) for k in more.values())],
                names=["tid", "start", "end", "other", "edge", *columns, *more])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not len(t):
                continue
            first = first if first is not None else t.slice(0, 1)
            kinds = {"key": pa.int64(), "after": pa.binary(), "before": pa.binary(), "right": pa.int32(), "left": pa.int32(), "at": pa.int32(), "least": t.schema.field("least").type, **more}
            spans, cut, windows = met(t) if whole else ([], [], [])
            pieces = [(number + i, "cut", tid, start, None, {"key": key, "hashes": hashes}) for i, (tid, start, key, hashes) in enumerate(cut)]
            pieces += [(number + i, "window", None, None, other, {"key": key, "hash": value, "low": low, "high": high})
                       for i, (other, key, value, low, high) in enumerate(windows)]
            number += len(cut)
            for piece, edge_of, tid, start, other, own in pieces:
                n = len(own["key"])
                own["piece"] = pa.array(np.full(n, piece))
                yield pa.RecordBatch.from_arrays(
                    [tid if tid is not None else pa.nulls(n, pa.binary()), start if start is not None else pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()),
                     other if other is not None else pa.nulls(n, kinds["least"]), pa.array([edge_of] * n), *(own.get(c, pa.nulls(n, k)) for c, k in kinds.items())],
                    names=["tid", "start", "end", "other", "edge", *kinds])
            # the last suffix of the batch before stands ahead of this one
            t = pa.concat_tables([last, t]) if last is not None else t
            for b in [*spans, *(b.columns for b in found(t))]:
                n = len(b[0])
                yield pa.RecordBatch.from_arrays([*b, pa.nulls(n, pa.string()), *(pa.nulls(n, k) for k in kinds.values())],
                                                 names=["tid", "start", "end", "other", "edge", *kinds])
            last = t.slice(len(t) - 1, 1)
        if first is not None:
            yield edge(first, "first")
            yield edge(last, "last")
    return run


def repeated(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """Rows (doc_id, start, end, n_words, first_doc_id): maximal spans of words that also stand elsewhere.

    Words are numbered from 0, end is exclusive. Every span is a union of passages of
    at least ``passage`` words, each of which occurs at another place, in this or
    another document; first_doc_id is the smallest doc_id of all that hold one of them.
    A document with nothing repeated has no row. A null text is an empty one. Rows
    with equal doc_id and text are copies like any other and give equal rows; a null
    doc_id takes part but is never first_doc_id. An empty table gives no rows.
    Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    kept = saved(rows.mapInArrow(keep(passage, gram), f"doc_id {kind}, tid binary, words int, places array<int>, keys array<long>"), "minimisers")
    texts = durable(kept.groupBy("tid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.max("words").alias("words")))
    suffixes = kept.select("tid", F.explode(F.arrays_zip("places", "keys")).alias("s")).select("tid", F.col("s.places").alias("at"), F.col("s.keys").alias("key"))
    place = F.xxhash64("tid", "at")
    # written, so that the join below has two plain sides and a very common beginning can be split
    twice = durable(suffixes.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("key"))
    wanted = suffixes.join(twice, "key").groupBy("tid").agg(F.collect_set("at").alias("places"))
    wanted = durable(wanted.join(texts.select("tid", "least"), "tid"))
    # one document of each text stands for it
    read = rows.mapInArrow(addresses, f"doc_id {kind}, tid binary, text string")
    read = read.withColumn("path", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    chosen = wanted.withColumn("path", F.coalesce(F.col("least").cast("string"), F.lit("")))
    read = read.drop("doc_id").join(chosen, ["tid", "path"]).select("tid", "text", "least", "places")
    schema = f"key long, after binary, before binary, tid binary, at int, right int, left int, least {kind}"
    sparse = read.mapInArrow(contexts(passage, gram), schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "after", "before", "tid", "at"]
    array = sparse.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    out = array.mapInArrow(sorted_spans(passage, gram), f"tid binary, start int, end int, other {kind}, edge string, key long, after binary, before binary, right int, left int, at int, least {kind}, hashes array<long>, piece long, hash long, low long, high long")
    with few_samples(spark):
        out = saved(out, "spans")
    # two rows per partition: the last suffix of each and the first of the next, sorted once more
    edges = out.filter("edge IN ('first', 'last')").select("key", "after", "before", "tid", "at", "right", "left", "least").coalesce(1).sortWithinPartitions(*order)
    across = edges.mapInArrow(sorted_spans(passage, gram, False), out.schema).filter("edge IS NULL")
    spans = out.filter("edge IS NULL").unionByName(across).select("tid", "start", "end", "other")
    # the windows of keys that a batch or a partition may have cut
    windows = out.filter("edge = 'window'").select("piece", "key", "hash", "low", "high", "other")
    again = windows.groupBy("key", "hash").agg(F.min("low").alias("a"), F.max("high").alias("b"), F.min("other").alias("first"))
    again = durable(again.filter("a <> b").select("key", "hash", "first"))
    again = windows.select("piece", "key", "hash").join(again, ["key", "hash"])
    cut = out.filter("edge = 'cut'").select(*[F.col(c).alias(c) for c in ("piece", "tid", "start", "key", "hashes")])
    settled = again.groupBy("piece").cogroup(cut.groupBy("piece")).applyInArrow(settled_windows(passage), f"tid binary, start int, end int, other {kind}")
    spans = spans.unionByName(settled)
    whole = texts.filter((F.col("copies") > 1) & (F.col("words") >= passage)).select("tid", F.lit(0).alias("start"), F.col("words").alias("end"), F.col("least").alias("other"))
    spans = united(spans.unionByName(whole).groupBy("tid", "start", "end").agg(F.min("other").alias("other")))
    spans = durable(spans.join(texts.select("tid", "least"), "tid").select("tid", "start", "end", F.least("other", "least").alias("first_doc_id")))
    result = kept.select("doc_id", "tid").join(spans, "tid")
    return result.select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "first_doc_id")


@contextmanager
def few_samples(spark):
    """Fewer sampled rows per partition for range bounds while a table is written: a row holds long contexts."""
    name = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), SAMPLES)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def addresses(batches):
    for batch in batches:
        tids = [xxhash.xxh3_128_digest((x or "").encode()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tids, pa.binary()), batch.column(1)], names=["doc_id", "tid", "text"])


def united(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a text made one; at most as many rows as the text has suffixes."""
    w = W.partitionBy("tid").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = spans.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    return fresh.withColumn("span", F.sum("new").over(w)).groupBy("tid", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other")).drop("span")
