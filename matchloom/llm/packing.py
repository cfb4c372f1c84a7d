"""Packing of token sequences by linear grouping.

Texts become token pieces of at most ``CAPACITY`` ids. How to pack them depends on
the number of pieces of each length alone, a table of at most CAPACITY rows:

1. Lengths above SMALL are cut into GROUPS groups of equal numbers of pieces and
   rounded up to the largest length of their group.
2. The fewest sequences for these few sizes is a linear programme over
   configurations (multisets of sizes that fit), solved by column generation;
   every configuration is used a whole number of times, rounded down.
3. Real lengths replace the rounded sizes. What is left over and the small
   lengths go, largest first, to the fullest sequence that has room.

The plan says, for runs of ranks within a length, where they go; its size follows
from the number of lengths, not of pieces. Every piece gets its rank within its
length from counts per (length, hash bucket), so a length that a third of all
pieces have is not one task.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from itertools import islice
from unicodedata import category

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from matchloom.llm.common import pick, saved

CAPACITY = 4096
SMALL = 512
GROUPS = 64
END = 1
BUCKETS = 1024
TOKENIZER = "word_bpe_49k.json"
#: White-space-free chunks that a task remembers, and the longest that it remembers.
CACHE = 400_000
LONGEST = 64
#: Bytes of text that are encoded together.
TOGETHER = 3_000_000
RUN = [("length", "i8"), ("lo", "i8"), ("n", "i8"), ("sequence", "i8"), ("offset", "i8"), ("each", "i8")]


class Encoder(dict):
    """Token ids of texts through a memory of chunks.

    Where the tokenizer file is of the kind described by KNOWN, it never joins
    characters across white space, so a text's ids are those of its chunks. Arrow
    splits many texts at once and tells their distinct chunks; only these are looked
    up, and the ids of all texts are gathered by numpy from one array. Chunks of Latin
    characters are lower-cased and split here and only their pieces go to the
    vocabulary; all others go to the tokenizer. So do, whole, the texts that hold a
    special token or a control character that is white space to Arrow alone, and all
    texts of tokenizers of another kind.
    """

    #: Normaliser and splitting that allow work by chunks. These are fixed values of the tokenizer format.
    KNOWN = {
        "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    LETTER, NUMBER = ("".join(c for c in map(chr, range(0x250)) if category(c)[0] == kind) for kind in "LN")
    PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|\n|[^\s{LETTER}{NUMBER}]+")
    #: What keeps a chunk from being split here: characters beyond Latin, and the one whose lower case is two characters.
    FOREIGN = r"[^\x00-\x{24F}]|\x{130}"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.pieces: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        told = json.loads(self.whole.to_str())
        self.added = [t["content"] for t in told["added_tokens"]]
        self.by_chunk = (
            (told["normalizer"] or {}).get("normalizers") == self.KNOWN["normalizer"] and (told["pre_tokenizer"] or {}).get("pretokenizers") == self.KNOWN["pretokenizers"]
            and told["model"]["type"] == "BPE" and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"])
            and not any(c.isspace() for t in self.added for c in t))

    def slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            shown = "".join(map(self.letters.__getitem__, piece.encode()))
            found = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            if len(piece) <= LONGEST:
                forget(self.pieces)
                self.pieces[piece] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        ids = self.slow(chunk)
        if len(chunk) <= LONGEST:
            forget(self)
            self[chunk] = ids
        return ids

    def chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks in one array; where each chunk's begin, and how many they are."""
        foreign = np.array(pc.match_substring_regex(chunks, self.FOREIGN), bool)
        low = pc.utf8_lower(chunks)
        plain = np.array(pc.utf8_is_alpha(low), bool) & ~foreign
        mixed = ~plain & ~foreign
        # the chunks that are not letters alone, one a line
        lines = pa.array(self.PIECES.findall("\n".join([*low.filter(pa.array(mixed)).to_pylist(), ""])), pa.string())
        coded = pa.concat_arrays([low.filter(pa.array(plain)), lines]).dictionary_encode()
        known = list(map(self.piece, coded.dictionary.to_pylist()))
        codes = coded.indices.to_numpy()
        line = coded.dictionary.index("\n").as_py()
        if line >= 0:
            known[line] = b""
        ids, sizes = gathered(known, codes)
        ends, alone = np.concatenate([[0], np.cumsum(sizes)]), int(plain.sum())
        last = np.flatnonzero(codes[alone:] == line) + alone + 1
        bounds = ends[np.concatenate([np.arange(alone + 1), last])]
        others = [self[c] for c in chunks.filter(pa.array(foreign)).to_pylist()]
        more = np.fromiter(map(len, others), np.int64, len(others)) // 4
        first, size = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        own = np.concatenate([np.flatnonzero(plain), np.flatnonzero(mixed)])
        first[own], size[own] = bounds[:-1], np.diff(bounds)
        first[foreign], size[foreign] = len(ids) + np.cumsum(more) - more, more
        return np.concatenate([ids, np.frombuffer(b"".join(others), "<u4")]), first, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each ended by END, and where the texts begin (one more than texts)."""
        odd: dict[int, bytes] = {}
        if not self.by_chunk:
            odd = {i: self.slow(t) for i, t in enumerate(texts.to_pylist())}
        split = pc.utf8_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        last = split.offsets.to_numpy() - split.offsets[0].as_py()
        if self.by_chunk:
            special = np.zeros(len(coded.dictionary), bool)
            for token in self.added:
                special |= np.array(pc.match_substring(coded.dictionary, token), bool)
            whole = set((np.searchsorted(last, np.flatnonzero(special[codes]), "right") - 1).tolist())
            bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
            control = np.flatnonzero((data >= 0x1c) & (data <= 0x1f)) + bounds[0]
            whole.update((np.searchsorted(bounds, control, "right") - 1).tolist())
            odd = {i: self.slow(texts[i].as_py()) for i in whole}
            ids, first, size = self.chunks(coded.dictionary)
        else:
            ids, first, size = np.zeros(0, "<u4"), *np.zeros((2, len(coded.dictionary)), np.int64)
        more = [odd[i] for i in sorted(odd)] + [np.array([END], "<u4").tobytes()]
        if odd:  # such a text is one chunk of its own
            keep = np.ones(len(codes), bool)
            for i in odd:
                keep[last[i]:last[i + 1]] = False
            counts = np.add.reduceat(np.append(keep, False), last[:-1]) * (np.diff(last) > 0) if len(last) > 1 else np.zeros(0, int)
            codes, last = codes[keep], np.concatenate([[0], np.cumsum(counts)])
            at = np.array(sorted(odd))
            codes = np.insert(codes, last[at], np.arange(len(first), len(first) + len(at)))
            grown = np.zeros(len(last), int)
            grown[at + 1] = 1
            last = last + np.cumsum(grown)
        codes = np.insert(codes, last[1:], len(first) + len(odd))
        lengths = np.fromiter(map(len, more), np.int64, len(more)) // 4
        first, size = np.concatenate([first, len(ids) + np.cumsum(lengths) - lengths]), np.concatenate([size, lengths])
        ids = np.concatenate([ids, np.frombuffer(b"".join(more), "<u4")])
        n = size[codes]
        ends = np.cumsum(n)
        return ids[np.repeat(first[codes] - (ends - n), n) + np.arange(n.sum())], np.concatenate([[0], ends])[np.concatenate([[0], last[1:] + np.arange(1, len(last))])]


def gathered(known: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all codes one after the other, and how many each has."""
    size = np.fromiter(map(len, known), np.int64, len(known)) // 4
    first, n = np.cumsum(size) - size, size[codes]
    ends = np.cumsum(n)
    return np.frombuffer(b"".join(known), "<u4")[np.repeat(first[codes] - (ends - n), n) + np.arange(n.sum())], n


def forget(memory: dict) -> None:
    """A full memory loses its older half."""
    if len(memory) >= CACHE:
        for k in list(islice(memory, CACHE // 2)):
            del memory[k]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(texts: pa.Array, most: int = TOGETHER):
    """Runs of texts of about ``most`` bytes together."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, to
        at = to


def cut(path: str, capacity: int):
    """Batches of (doc_id, text) to batches of pieces."""
    def run(batches):
        code = encoder(path)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for lo, hi in slices(texts):
                ids, start = code.encode(texts.slice(lo, hi - lo))
                size = np.diff(start)
                n = -(-size // capacity)
                owner = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                at = piece * capacity
                length = np.minimum(capacity, size[owner] - at)
                place = (start[owner] + at).tolist()
                whole = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(whole[4 * p:4 * (p + k)]) for p, k in zip(place, length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner + lo, pa.int64())), pa.array(piece, pa.int32()), pa.array(at, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes within the capacity that is worth most (counts per size)."""
    value, choices = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        new, choice = value.copy(), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            with_it = value[:capacity + 1 - s] + worth[i]
            better = with_it > new[s:] + 1e-12
            new[s:][better] = with_it[better]
            choice[s:][better] = i
        if (choice < 0).all():
            break
        value = new
        choices.append(choice)
    counts, room = np.zeros(len(sizes)), capacity
    for choice in reversed(choices):
        if choice[room] >= 0:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
    return counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and whole numbers of uses that serve at most the demand, near the linear optimum."""
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(20 * len(sizes) + 100):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = best_configuration(sizes, worth, capacity)
        if worth @ column <= 1 + 1e-9:
            break
        uses, step = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(uses, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    uses = np.floor(np.maximum(np.linalg.solve(basis, demand), 0) + 1e-9).astype(np.int64)
    left, out = demand.astype(np.int64).copy(), []
    for column, n in zip(basis.T.astype(np.int64), uses.tolist()):
        some = column > 0
        n = min([n, *(left[some] // column[some]).tolist()])
        if n > 0:
            out.append((column, n))
            left -= n * column
    return out


def plan(counts: np.ndarray, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> np.ndarray:
    """Runs of ranks per length (counts[length] pieces each) with their first sequence and offset there.

    The piece of rank lo + i of a run stands in sequence + i // each at offset + (i % each) * length.
    """
    counts = np.asarray(counts, np.int64)
    runs, opened = [], 0
    used = np.zeros(capacity + 1, np.int64)  # ranks given out so far, by length
    room: dict[int, list[list[int]]] = {}    # free tokens -> [first sequence, number of sequences]
    free: list[int] = []

    def give(length: int, n: int, sequence: int, offset: int, each: int = 1) -> None:
        runs.append((length, int(used[length]), n, sequence, offset, each))
        used[length] += n

    def leave(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in room:
                room[space] = []
                insort(free, space)
            room[space].append([first, n])

    if counts[capacity]:
        give(capacity, int(counts[capacity]), 0, 0)
        opened = int(counts[capacity])
    large = [x for x in range(small + 1, capacity) if counts[x]]
    if large:
        before = np.cumsum(counts[large]) - counts[large]
        group = before * groups // int(counts[large].sum())
        _, group = np.unique(group, return_inverse=True)
        members = [[x for x, g in zip(large, group) if g == k] for k in range(group[-1] + 1)]
        sizes = np.array([m[-1] for m in members])
        demand = np.array([counts[m].sum() for m in members], float)
        for column, n in configurations(sizes, demand, capacity):
            slots = [g for g in np.argsort(-sizes) for _ in range(column[g])]
            done = 0
            while done < n:  # as long as every slot keeps its length; slots of one group take turns
                step, lengths, planned = n - done, [], {}
                for g in slots:
                    x = next(x for x in members[g] if used[x] + planned.get(x, 0) < counts[x])
                    planned[x] = planned.get(x, 0) + 1
                    lengths.append(x)
                for x, k in planned.items():
                    step = min(step, int(counts[x] - used[x]) // k)
                offset = 0
                for x in lengths:
                    give(x, step, opened, offset)
                    offset += x
                leave(capacity - offset, opened, step)
                opened += step
                done += step
    for x in range(capacity - 1, 0, -1):
        n = int(counts[x] - used[x])
        while n:
            at = bisect_left(free, x)
            if at == len(free):
                each = capacity // x
                fresh = max(1, n // each)
                leave(capacity, opened, fresh)
                opened += fresh
                continue
            space = free[at]
            first, have = room[space].pop()
            each = min(space // x, n)
            take = min(have, n // each)
            give(x, take * each, first, capacity - space, each)
            n -= take * each
            if have > take:
                room[space].append([first + take, have - take])
            if not room[space]:
                del room[space]
                free.remove(space)
            leave(space - each * x, first, take)
    return np.array(sorted(runs), RUN)


def place(runs: np.ndarray):
    """Batches of pieces with their rank to the same with sequence and offset."""
    keys = runs["length"] << 48 | runs["lo"]

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = runs[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            i = rank - row["lo"]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row["sequence"] + i // row["each"]), pa.array(row["offset"] + i % row["each"] * length)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and the end id; only a longer one than the capacity
    is cut. A null or empty text is the end id alone. Equal rows are packed each on
    its own, a null doc_id like any other. An empty table gives no rows. Columns
    other than doc_id and text are not read.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    rows = pick(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = rows.mapInArrow(cut(path, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = saved(pieces, "pieces").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    runs = plan(counts, capacity, capacity * SMALL // CAPACITY)
    key = ["length", "bucket"]
    sizes = pieces.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")
    sizes = sizes.select(*key, before.alias("before"))
    order = W.partitionBy(*key).orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("n", F.row_number().over(order)).join(sizes, key)
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("n") - 1).alias("rank"))
    return ranked.mapInArrow(place(runs), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
