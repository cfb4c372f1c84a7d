"""SimHash near-duplicates against all pairs."""

import re

import numpy as np
import pytest
import xxhash

from matchloom.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    label = list(range(len(fps)))
    for x in range(len(fps)):
        for y in range(x):
            if (fps[x][1] ^ fps[y][1]).bit_count() <= 2:
                low, high = sorted((label[x], label[y]))
                label = [low if v == high else v for v in label]
    least = {}
    for (i, _), v in zip(fps, label):
        if i is not None:
            least[v] = min(i, least.get(v, i))
    return sorted(((i, f"{f:016x}", least.get(v)) for (i, f), v in zip(fps, label)), key=str)


def near(rng, base, bits):
    for k in rng.choice(64, bits, replace=False):
        base ^= 1 << int(k)
    return base


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(300)]
    out = []
    for d in range(120):
        text = [words[k] for k in rng.integers(0, 300, rng.integers(0, 60))]
        out.append((d, " ".join(text)))
        if d % 3 == 0:
            out.append((1000 + d, " ".join(text).upper()))
        if d % 4 == 0:
            long = text * 12
            out += [(2000 + d, "\t".join(long)), (3000 + d, " ".join(long + ["more"]))]
    return out + [(9000, None), (9001, ""), (9002, " \n"), (7, out[20][1]), (7, out[20][1]), (None, "a b c d"), (None, None), (9003, "É é"), (9004, "x" * 200_000)]


def test_classes_equal_all_pairs(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, fp int, root string").repartition(5)
    got = sorted((tuple(r) for r in simhash.near_duplicates(df, shard=16).collect()), key=str)
    assert got == brute_classes(rows)


def test_one_of_each(spark, rows):
    df = spark.createDataFrame([(t, "S", i) for i, t in rows], "Text string, TEXT string, doc_id long").toDF("text", "TEXT", "doc_id")
    got = [(r[2], r[0]) for r in simhash.one_of_each(df, shard=16).collect()]
    want = {c for _, _, c in brute_classes(rows) if c is not None}
    assert {i for i, _ in got if i is not None} == want  # 7 names documents of two groups
    assert len(got) == len(set(got)) == len(want) + 1 + any(i is None for i, _ in got)
    assert {t for _, t in got} <= {t for _, t in rows}


def test_tree_finds_every_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 400, dtype=np.uint64)
    fps = np.unique([near(rng, int(b), int(k)) for b in np.repeat(base, 5) for k in rng.integers(0, 4, 1)]).astype(np.uint64)
    tree = simhash.grow(fps[::3], 5)
    shards = {}
    for shard, points, home in simhash.route(fps, tree, 2):
        shards.setdefault(shard, ([], []))[not home].append(points)
    found = set()
    empty = [np.zeros(0, np.uint64)]
    for home, visitors in shards.values():
        for a, b in simhash.links(np.concatenate(home or empty), np.concatenate(visitors or empty), 2):
            found |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist()) if x != y}
    want = {(int(x), int(y)) for k, x in enumerate(fps) for y in fps[k + 1:] if (int(x) ^ int(y)).bit_count() <= 2}
    assert found == want and len(want) > 100 and len(shards) > 20


def test_empty_and_long(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    text = " ".join(f"t{k % 7919}" for k in range(150_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert simhash.near_duplicates(df).first().fingerprint == f"{brute_fingerprint(text):016x}"
