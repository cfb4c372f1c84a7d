"""Graph search against all cosines."""

import math

import numpy as np
import pytest

from matchloom.llm import descent

ODD = [(9050, None), (9100, [0.0] * 8), (9150, [1.0, float("nan")] + [0.0] * 6), (9200, [1.0] * 7 + [None]), (9250, [float("inf")] * 8), (9300, []), (9350, [1.0, 0.5]),
       (9400, [1e200] * 8), (9450, [1e-200, 0.0] * 4)]


def rows(n=1500, dims=8):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, dims))
    out = [(d, [float(v) for v in (base[d % 60] + 0.5 * rng.standard_normal(dims)).astype(np.float32)]) for d in range(n)]
    return out + [(5000 + k, out[3][1]) for k in range(120)] + [(None, out[5][1]), (7, out[7][1]), (7, out[7][1]), (50, out[50][1])] + ODD


def exact(table, k):
    good = [(i, np.array(v, float)) for i, v in table if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max(len(v) for _, v in good)
    x = np.array([np.pad(v / np.abs(v).max(), (0, width - len(v))) for _, v in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for a, (i, _) in enumerate(good):
        if i is not None and i % 50 == 0:
            s = x @ x[a]
            near = sorted((-round(s[b], 12), good[b][0] is None, good[b][0] or 0) for b in range(len(good)) if b != a)[:k]
            out.append((i, [(-v, None if null else j) for v, null, j in near]))
    return out


def grouped(got):
    out = {}
    for r in got:
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


@pytest.mark.parametrize("settings", [{}, {"leaf": 64, "cell": 100, "trees": 2, "size": 8}])
def test_search_against_all_pairs(spark, settings):
    table = rows()
    df = spark.createDataFrame([(v, i, 1) for i, v in table], "embedding array<double>, vec_id long, node int").repartition(6)
    got, hit, total = grouped(descent.search(df, **settings).collect()), 0, 0
    for query, near in exact(table, 5):
        found = got[query]
        copies = len(found) // 5  # a query id that occurs twice has its neighbours twice
        assert [r for r, _, _ in found] == sorted(list(range(1, 6)) * copies)
        scores = [s for _, _, s in found][::copies]
        assert scores == sorted(scores, reverse=True)
        hit += sum(abs(a - b) < 1e-9 for a, (b, _) in zip(scores, near))
        total += 5
    assert hit >= 0.95 * total
    assert set(got) == {q for q, _ in exact(table, 5)}


def test_ties_and_copies_are_exact(spark):
    table = rows()
    df = spark.createDataFrame([(i, v) for i, v in table], "vec_id long, embedding array<double>")
    got = grouped(descent.search(df).collect())
    # 120 copies of one vector, two of them queries: nearest are the copies of smallest id, but not the row itself
    assert [v for _, v, _ in got[5000]] == [3, 5001, 5002, 5003, 5004]
    assert [v for _, v, _ in got[5050]] == [3, 5000, 5001, 5002, 5003]
    assert all(abs(s - 1) < 1e-12 for _, _, s in got[5050])


def test_descent_finds_neighbours_in_many_dimensions(spark):
    """Descent from two random partitions into small blocks has to find the graph."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4_000, 12)) @ rng.standard_normal((12, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = grouped(descent.search(df, trees=2, leaf=64, cell=1_024, beam=32).collect())
    hit = 0
    for q in range(0, 4_000, 50):
        s = x @ x[q]
        s[q] = -2
        hit += len(set(np.argsort(-s)[:5].tolist()) & {v for _, v, _ in got[q]})
    assert hit >= 0.9 * 5 * 80


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert descent.search(spark.createDataFrame([], schema)).collect() == []
    assert descent.search(spark.createDataFrame([(0, [1.0, 0.0])], schema)).collect() == []
    got = descent.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (50, [1.0, 1.0])], schema)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
