"""Mixing against a row-by-row version; shard placement against its definition."""

import hashlib
import math
import re
from collections import Counter

import pytest

from matchloom.llm import mixing, sharding


def targets(sizes):
    """Shared by weight, stopped at twice the size, the excess shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, share, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return share | {s: weight[s] * level for s in open_}
        share |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    return share


def rows():
    out = [(d, "w " * (d * 37 % 200), f"s{d % 5}") for d in range(300)]
    out += [(1000 + d, "same words here", "hot") for d in range(400)] + [(5, "a b", None), (6, None, None), (7, "", ""), (None, "x y", "s1")]
    return out + [(2000, "w " * 9, "S1"), (2000, "w " * 9, "S1"), (2001, " \t\n", "blank")]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(s, d, t, 1) for d, t, s in rows()], "source string, doc_id long, text string, size int").repartition(7)


def test_targets_and_copies(df):
    sizes = Counter()
    for d, t, s in rows():
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows())
    largest, taken = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        largest[r.source] = max(largest[r.source], r.size)
        taken[r.source] += r.taken
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s], s
    order = sorted((r for r in got if r.source == "s3"), key=lambda r: (r.size, hashlib.md5(str(r.doc_id).encode()).hexdigest()))
    rate, u = want["s3"] / sizes["s3"], int(hashlib.md5(f"{mixing.SEED}:s3".encode()).hexdigest()[:8], 16) / 2 ** 32
    assert [r.copies for r in order] == [math.floor(rate * (k + 1) + u) - math.floor(rate * k + u) for k in range(len(order))]


def test_reruns_agree_and_rows_come_as_often(df):
    first, again = (sorted(map(tuple, mixing.mix(x).collect()), key=str) for x in (df, df.repartition(3)))
    assert first == again
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == Counter({k: n for k, n in sum((Counter({(r[0], r[2]): r[5]}) for r in first), Counter()).items() if n})


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).collect() == [] and mixing.mixed(none).collect() == []


def test_shards(spark):
    names = sharding.names(10)
    owner = sharding.lookup(names, 1009)
    assert set(Counter(owner).values()) <= {100, 101}
    fewer = sharding.lookup(names[:-1], 1009)
    assert sum(a != b for a, b in zip(owner, fewer) if a != 9) < 0.15 * 1009
    keys = list(range(500)) + [None, 7, 7]
    df = spark.createDataFrame([(k, "x", 1) for k in keys], "key long, Slot string, shard int")
    got = sharding.place(df, "key", names, 1009).collect()
    assert Counter(r.key for r in got) == Counter(keys)
    for r in got:
        slot = int(hashlib.md5(b"" if r.key is None else str(r.key).encode()).hexdigest()[:8], 16) % 1009
        assert (r.slot, r.shard) == (slot, names[owner[slot]])
    assert sharding.place(df.limit(0), "key", names).collect() == []
    for bad in (([], 7), (names, 1000), (names, 7)):
        with pytest.raises(ValueError):
            sharding.lookup(*bad)
