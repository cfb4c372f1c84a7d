"""Packing: exact round trip of the tokens, no overlap, near the least number of sequences."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from matchloom.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)
WHOLE = Tokenizer.from_file(PATH)


def ids(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, docs, capacity):
    """Pieces are the documents' ids; sequences are gapless from 0 and not over-full."""
    want = defaultdict(int)
    for doc, text in docs:
        whole = ids(text)
        for k, at in enumerate(range(0, len(whole), capacity)):
            part = np.array(whole[at:at + capacity], "<u4")
            want[doc, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    got, places = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAbz'st ,.\n\t\x1c\x85\xa0é²ß<|>1٣日"), st.characters(codec="utf-8")), max_size=40))
def test_encoder_equals_tokenizer(text):
    same([text, "x", text])


def same(texts, path=PATH, whole=None):
    """Texts of one array, also as part of a longer one, to the tokenizer's own ids."""
    want = [[*(whole or WHOLE).encode(t, add_special_tokens=False).ids, 1] for t in texts]
    array = pa.array(["<|endoftext|> before\x1f", *texts, "after"], pa.string()).slice(1, len(texts))
    got, start = packing.encoder(path).encode(array)
    assert [got[a:b].tolist() for a, b in zip(start, start[1:])] == want


def test_many_texts_of_all_kinds():
    rng = np.random.default_rng(5)
    parts = ["word", "don't", "<|endoftext|>", "x<|startoftext|>", "\x1c", "a\x1fb", "\u3000", "\u00e9t\u00e9", "\u6c49\u5b57", "", "\n\n", "A1B2", "!!", "\u00a0", "\u0085", "y" * 90]
    same(["".join(parts[k] + " " * int(g) for k, g in zip(rng.integers(0, len(parts), n), rng.integers(0, 2, n))) for n in rng.integers(0, 30, 400)])
    same([])
    same([""])


def test_memory_drops_its_older_half(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 8)
    code = packing.Encoder(PATH)
    for _ in range(2):
        got, _ = code.encode(pa.array([" ".join(f"w{k}" for k in range(40))]))
        assert got.tolist() == ids(" ".join(f"w{k}" for k in range(40))) and len(code) <= 9


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_tokenizer_of_another_kind(name):
    """Its texts go to the tokenizer whole."""
    path = public_tokenizers.path(name)
    same(["Two  spaces", "", "don't <|endoftext|> \n x", "\u6c49 \u00e9"], path, Tokenizer.from_file(path))


def test_special_tokens_and_long_chunks():
    same(["a <|endoftext|> b", "x<|startoftext|>y", "y" * 3000, "don't DON'T we'll 'S", "é" * 200 + " ok"])


@pytest.mark.parametrize("capacity", [64, 4096])
def test_round_trip(spark, capacity):
    rng = np.random.default_rng(2)
    docs = [(d, " ".join(f"word{k}" for k in rng.integers(0, 99, rng.integers(0, 90)))) for d in range(150)]
    docs += [(500, None), (501, ""), (None, "a b"), (1, docs[1][1]), (1, docs[1][1]), (600, "long text " * 5000)] + [(700 + k, "same length") for k in range(100)]
    df = spark.createDataFrame([(t, d, 1, "x") for d, t in docs], "text string, doc_id long, bucket int, Length string").repartition(5)
    n = check(packing.pack(df, capacity=capacity).collect(), docs, capacity)
    total = sum(len(ids(t)) for _, t in docs)
    assert -(-total // capacity) <= n <= 1.25 * total / capacity + 2


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def expand(runs, counts, capacity):
    """Every rank of every length placed once; sequences gapless and within the capacity."""
    fill, n = defaultdict(list), defaultdict(int)
    for length, lo, count, sequence, offset, each in runs.tolist():
        assert lo == n[length]
        n[length] += count
        for i in range(count):
            fill[sequence + i // each].append((offset + i % each * length, length))
    assert all(n[x] == c for x, c in enumerate(counts))
    for some in fill.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= capacity
    return len(fill)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 256), st.integers(1, 40)), max_size=40))
def test_plan_is_whole(lengths):
    counts = np.zeros(257, np.int64)
    for x, n in lengths:
        counts[x] += n
    expand(packing.plan(counts, 256, 32, 8), counts, 256)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(4)
    counts = np.bincount(np.clip(rng.lognormal(6.5, 0.9, 40_000).astype(int), 1, 4096), minlength=4097)
    n = expand(packing.plan(counts), counts, 4096)
    assert n <= 1.01 * (counts @ np.arange(4097)) / 4096 + 1
    thirds = np.zeros(4097, np.int64)
    thirds[[1366, 2048, 2731]] = 3000  # 1366 with 2731 is one too many, two 2048 fit exactly
    assert expand(packing.plan(thirds), thirds, 4096) <= 1500 + 3000 + 1500
