"""Vector near-duplicates and top-k search against all pairs."""

import math

import numpy as np
import pytest

from matchloom.llm import neighbours, topk

ODD = [(900, None, 1), (901, [0.0] * 8, 1), (902, [1.0, float("nan")] + [0.0] * 6, 1), (903, [1.0] * 7 + [None], 1), (904, [float("inf")] * 8, 1), (905, [], 1), (1200, [1.0, 0.5], 1)]


def vectors():
    rng = np.random.default_rng(8)
    out, base = [], rng.standard_normal((40, 8))
    for d in range(300):
        x = base[d % 40] + rng.standard_normal(8) * rng.choice([0.02, 0.15, 0.4])
        out.append((d, [float(v) for v in x.astype(np.float32)], int(d % 3) if d % 11 else None))
    out += [(2000 + k, out[4][1], out[4][2]) for k in range(25)] + [(3000, out[7][1], 2), (None, out[7][1], out[7][2]), (8, out[8][1], out[8][2])]
    return out + ODD


def good(v, zero=False):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def frame(spark, kind="float"):
    return spark.createDataFrame([(l, v, i, "x") for i, v, l in vectors()], f"label int, embedding array<{kind}>, vec_id long, node string").repartition(6)


def test_links(spark):
    rows = vectors()
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good(v) else None for _, v, _ in rows]
    label, count = list(range(len(rows))), [0] * len(rows)
    for x in range(len(rows)):
        for y in range(x):
            if rows[x][2] == rows[y][2] is not None and unit[x] is not None and unit[y] is not None and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= 0.93:
                count[x], count[y] = count[x] + 1, count[y] + 1
                low, high = sorted((label[x], label[y]))
                label = [low if v == high else v for v in label]
    least = {}
    for (i, _, _), v in zip(rows, label):
        if i is not None:
            least[v] = min(i, least.get(v, i))
    want = sorted(((i, n, least.get(v), i == least.get(v)) for (i, _, _), n, v in zip(rows, count, label)), key=str)
    # cells with so wide a margin hold everything: exactly all pairs
    got = neighbours.near_duplicates(frame(spark), margin=3.0, block=20)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()), key=str) == want
    found = sum(r.n_links for r in neighbours.near_duplicates(frame(spark, "double")).collect())
    assert 0.9 * sum(count) <= found <= sum(count)


def test_recall_in_many_dimensions(spark):
    """Pairs at cosines close to the threshold, many cells."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.standard_normal(base.shape)
    off -= (off * base).sum(1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    near = 0.94 * base + math.sqrt(1 - 0.94 ** 2) * off
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(np.concatenate([base, near]))], "vec_id long, embedding array<double>, label int")
    found = sum(r.n_links for r in neighbours.near_duplicates(df).collect())
    assert found >= 0.95 * 6000


def test_top_k(spark):
    rows = vectors()
    q = [[math.floor(1024 * x) for x in v] if good(v, True) else None for _, v, _ in rows]
    want = []
    for x, (i, _, _) in enumerate(rows):
        if q[x] is not None and i is not None and i % 100 == 0:
            all_ = [(-sum(a * b for a, b in zip(q[x], q[y])), rows[y][0] if rows[y][0] is not None else 2 ** 63, rows[y][0]) for y in range(len(rows)) if y != x and q[y] is not None]
            want += [(i, k + 1, v, -s) for k, (s, _, v) in enumerate(sorted(all_, key=lambda t: t[:2])[:10])]
    got = topk.top_k(frame(spark))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    few = frame(spark).filter("vec_id IN (0, 4, 200)")
    assert sorted((r.query_id, r["rank"]) for r in topk.top_k(few).collect()) == [(0, 1), (0, 2), (200, 1), (200, 2)]


def test_large_numbers():
    a, b = np.array([[2.0 ** 40, 1.0], [2.0 ** 60, 0.0]]), np.array([[2.0 ** 20, 3.0], [2.0 ** 60, 0.0]])
    assert topk.scores(a, b).tolist() == [[2 ** 60 + 3, 2 ** 63 - 1], [2 ** 63 - 1, 2 ** 63 - 1]]


@pytest.mark.parametrize("fn", [neighbours.near_duplicates, topk.top_k])
def test_empty(spark, fn):
    assert fn(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
