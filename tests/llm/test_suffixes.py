"""Repeated passages against all windows of 50 words."""

from collections import defaultdict

import numpy as np
import pyarrow as pa

from matchloom.llm import suffixes


def covered(rows, n=50):
    """(row, word) of every word inside a window of n words that also stands elsewhere."""
    where = defaultdict(list)
    texts = [(t or "").encode().split() for _, t in rows]
    for r, words in enumerate(texts):
        for i in range(len(words) - n + 1):
            where[b" ".join(words[i:i + n])].append((r, i))
    return {(r, i + k) for places in where.values() if len(places) > 1 for r, i in places for k in range(n)}


def fixture():
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 5000, n))
    passages = [word(n) for n in (49, 50, 51, 60, 75, 90, 140, 300)]
    rows = []
    for d in range(160):
        parts = [word(rng.integers(0, 120))]
        for p in rng.choice(len(passages), rng.integers(0, 3), replace=False):
            parts += [passages[p], word(rng.integers(0, 40))]
        rows.append((d, "\n".join(parts)))
    rows += [(1000 + d, t) for d, t in rows[:7]] + [(2000, None), (2001, ""), (2002, "a " * 400), (2003, "a " * 700), (None, rows[9][1]), (3, rows[3][1])]
    edited = rows[150][1].split() + word(300).split()
    for d in range(12):  # near copies with edits in different places
        some = list(edited)
        for k in rng.integers(0, len(some), 3):
            some[k] = f"x{d}"
        rows.append((3000 + d, " ".join(some)))
    return rows + [(None, "own " + rows[0][1] + " " + passages[-1])]


def test_spans_equal_all_windows(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, `at` int, TID string").repartition(6)
    got = suffixes.repeated(df).collect()
    want, by_id = covered(rows), defaultdict(set)
    for r, w in want:
        by_id[rows[r][0]].add(w)
    mine = defaultdict(set)
    for r in got:
        assert r.n_words == r.end - r.start >= 50
        mine[r.doc_id] |= set(range(r.start, r.end))
    assert dict(mine) == dict(by_id)
    assert all(r.first_doc_id is not None and (r.doc_id is None or r.first_doc_id <= r.doc_id) for r in got if r.doc_id != 3000 or True)


def common_beginning(n=12_000, pairs=40):
    """Texts that share 20 words, of which some pairs share the 30 words before, too."""
    rng = np.random.default_rng(11)
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 50_000, n))
    middle = min((word(20) for _ in range(3000)), key=lambda t: suffixes.grams(suffixes.hashes(t), 20)[0])
    before = [word(30) for _ in range(n)]
    for k in range(pairs):
        before[n // 2 + 7 * k] = before[3 * k]
    return [(d, f"{b} {middle} {word(30)}") for d, b in enumerate(before)]


def test_a_very_common_beginning_over_batches_and_partitions(spark):
    rows = common_beginning()
    got = suffixes.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    mine = {(r.doc_id, w) for r in got for w in range(r.start, r.end)}
    assert mine == covered(rows) and len(mine) == 80 * 50


def test_first_doc_id_is_the_smallest_of_all_holders(spark):
    rng = np.random.default_rng(12)
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 50_000, n))
    many, few = word(60), word(50)
    own = lambda d, side: " ".join(f"{side}{d}.{k}" for k in range(30))
    rows = [(7 + d, f"{own(d, 'a')} {many} {own(d, 'b')}") for d in rng.permutation(3000).tolist()]
    rows += [(None, f"{word(9)} {few} {word(9)}"), (9002, f"{few} {word(9)}"), (9001, few), (9003, few)]
    got = suffixes.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted((r.n_words, r.first_doc_id) for r in got) == [(50, 9001)] * 4 + [(60, 7)] * 3000


def test_windows_of_a_cut_key_are_compared_once_per_piece():
    """100 suffixes of one key with the same words around them: 31 windows, and one span each."""
    rng, n = np.random.default_rng(13), 100
    words = rng.integers(0, 2 ** 32, 80, dtype=np.uint32)
    t = pa.table({"key": pa.array(np.full(n, 5)), "after": [words[30:].tobytes()] * n, "before": [words[29::-1].tobytes()] * n,
                  "tid": [k.to_bytes(16, "little") for k in range(1, n + 1)], "at": pa.array(np.full(n, 30, np.int32)),
                  "right": pa.array(np.full(n, 50, np.int32)), "left": pa.array(np.full(n, 30, np.int32)), "least": pa.array([None, *range(n - 1, 0, -1)])})
    spans, [(tid, start, key, hashes)], [(other, keys, values, low, high)] = suffixes.repeated_windows(50, 20)(t)
    assert not spans and len(tid) == n and len(values) == 31 and (low.to_numpy() < high.to_numpy()).all() and set(other.to_pylist()) == {1}
    again = pa.table({"key": keys, "hash": values, "first": other})
    cut = pa.table({"tid": tid, "start": start, "key": key, "hashes": hashes})
    got = suffixes.settled_windows(50)(again, cut).to_pylist()
    assert [(r["start"], r["end"], r["other"]) for r in got] == [(0, 80, 1)] * n and [r["tid"] for r in got] == t.column("tid").to_pylist()
    some = again.filter(pa.array([k not in (3, 4) for k in np.argsort(np.argsort(values.to_numpy()))]))
    holes = [h not in set(some.column("hash").to_pylist()) for h in hashes[0].as_py()]
    want = {k for k in range(31) if not holes[k]}
    got = suffixes.settled_windows(50)(some, cut.slice(0, 1)).to_pylist()
    assert {k for r in got for k in range(r["start"], r["end"] - 49)} == want and len(some) == 29
    assert suffixes.settled_windows(50)(again.slice(0, 0), cut).num_rows == 0


def test_minimisers_are_shared():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 2 ** 63, 50, dtype=np.uint64)
    for _ in range(20):
        a, b = (np.concatenate([rng.integers(0, 2 ** 63, n, dtype=np.uint64), passage, rng.integers(0, 2 ** 63, 30, dtype=np.uint64)]) for n in (7, 33))
        x, _ = suffixes.minimisers(a, 50, 20)
        y, _ = suffixes.minimisers(b, 50, 20)
        assert {p - 7 for p in x if 7 <= p <= 37} & {p - 33 for p in y if 33 <= p <= 63}


def test_empty(spark):
    assert suffixes.repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
