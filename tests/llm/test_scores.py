"""Toxicity and quality scores: kernel against its definition, held-out accuracy."""

import os
import zlib
from itertools import combinations

import numpy as np
import pytest

from matchloom.llm import quality, toxicity

FOLDER = "/root/testdata/sf0.1"
needs = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not present")


def brute_kernel(a, b):
    def phi(s):
        out = {}
        for i, j, k in combinations(range(len(s)), 3):
            if k - i < toxicity.SPAN:
                u = s[i] + s[j] + s[k]
                out[u] = out.get(u, 0.0) + toxicity.DECAY ** (k - i - 2)
        return out
    x, y = phi(a), phi(b)
    dot = lambda p, q: sum(v * q.get(u, 0.0) for u, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel_equals_definition():
    strings = ["^idiot$", "^idxiot$", "^aaaa$", "^banana$", "^closed$", "^disgusting$", "^abcdefghijklmn"]
    got = toxicity.kernel(strings, strings)
    want = [[brute_kernel(a, b) for b in strings] for a in strings]
    np.testing.assert_allclose(got, want, atol=1e-6)


def test_units():
    assert toxicity.units("I.d-i*0t!") == ["^idiot$"]
    assert toxicity.units("108.51") == [] and toxicity.units("") == []
    assert "idiot" in toxicity.chunks("you i d i o t yes")
    long = toxicity.units("x" * 40 + "idiot" + "y" * 40)
    assert all(len(u) <= toxicity.WIDTH for u in long) and any("idiot" in u for u in long)


def confusion(rows, label):
    tp = sum(r.predicted == 1 and label[r.doc_id] == 1 for r in rows)
    fn = sum(r.predicted == 0 and label[r.doc_id] == 1 for r in rows)
    fp = sum(r.predicted == 1 and label[r.doc_id] == 0 for r in rows)
    tn = sum(r.predicted == 0 and label[r.doc_id] == 0 for r in rows)
    return tp, fn, fp, tn


@needs
@pytest.mark.parametrize("module,column,rest,of", [(toxicity, "toxic", 2, 4), (quality, "quality", 0, 5)])
def test_held_out_accuracy(spark, module, column, rest, of):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = module.score(docs.withColumn("label", docs.lang).withColumn("Text2", docs.text), labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    label = {r.doc_id: r[column] for r in labels.collect()}
    tp, fn, fp, tn = confusion([r for r in got if r.held_out and r.doc_id in label], label)
    assert tp / (tp + fn) >= 0.93 and tn / (tn + fp) >= 0.93


@needs
def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER.replace('0.1', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.remainder(labels.doc_id, 4) == 2
    flipped = labels.withColumn("toxic", (labels.toxic if False else labels.toxic) + 0 * labels.doc_id)
    flipped = flipped.withColumn("toxic", toxicity.F.when(held, 1 - flipped.toxic).otherwise(flipped.toxic))
    a, b = (sorted(map(tuple, toxicity.score(docs, x).collect())) for x in (labels, flipped))
    assert a == b


ODD = [(1, None), (2, ""), (3, " \n"), (None, "some text"), (4, "§§§"), (5, "word " * 60_000), (6, "idiot"), (6, "idiot"), (7, "x" * 200_000)]


@pytest.mark.parametrize("module,column", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows_and_labels(spark, module, column):
    docs = spark.createDataFrame([(t, i, "S", 1) for i, t in ODD], "text string, doc_id long, Score string, x int")
    none = spark.createDataFrame([], f"doc_id long, {column} int")
    odd = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0), (5, 0), (6, 1), (None, 1), (7, None), (4, 9), (99, 1)], f"doc_id long, {column} int")
    for labels in (none, odd):
        got = module.score(docs, labels).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 6}) == 1
    assert module.score(docs.limit(0), odd).collect() == []


def test_isotonic():
    x = np.arange(6.0)
    at, y = quality.isotonic(x, np.array([0, 1, 0.5, 0.5, 2, 1]), np.array([1, 1, 1, 2, 1, 3.0]))
    np.testing.assert_allclose(np.interp(x, at, y), [0, 0.625, 0.625, 0.625, 1.25, 1.25])


def test_statistics_are_finite():
    for _, text in ODD:
        values = quality.statistics(text or "")
        assert len(values) == len(quality.NAMES) and np.isfinite(values).all()


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((30, len(quality.NAMES)))
    model = quality.Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), 20_000, 1.5, 1)
    z = model.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) * 1.5 ** 2 / (2 * x.shape[1]))
    assert np.abs(z @ z.T - want).max() < 0.05


SMALL = FOLDER.replace("0.1", "0.01")


@needs
def test_quality_scores_equal_a_fit_in_memory(spark):
    """Least squares on stacked rows instead of summed products, the min-max form of the isotonic fit; every document."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    x = {r.doc_id: quality.statistics(r.text or "") for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 5 != 0}
    train, y = np.array([x[d] for d in known]), np.array(list(known.values()), float)
    model = quality.Model(train.mean(0), np.maximum(train.std(0), 1e-6), quality.FEATURES, quality.BANDWIDTH, quality.SEED)
    z = model.features(train)
    root = np.sqrt([quality.RIDGE * len(y) / quality.FEATURES] * quality.FEATURES + [1e-9])
    weights = np.linalg.lstsq(np.concatenate([z, np.diag(root)]), np.concatenate([y, np.zeros(len(root))]), rcond=None)[0]
    bins = np.minimum((np.clip(z @ weights, 0, 1) * quality.BINS).astype(int), quality.BINS - 1)
    at, where = np.unique(bins, return_inverse=True)
    n, total = np.bincount(where), np.bincount(where, y)
    cn, ct = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(total)])
    mean = lambda a, b: (ct[b + 1] - ct[a]) / (cn[b + 1] - cn[a])
    level = [max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    raw = np.clip(model.features(np.array([x[d] for d in x])) @ weights, 0, 1)
    want = dict(zip(x, np.clip(np.interp(raw, (at + 0.5) / quality.BINS, level), 0, 1)))
    # a document that falls beside the border of a bin by rounding may move one label by a bin
    assert np.mean([abs(got[d] - want[d]) < 1e-3 for d in x]) > 0.99


def plain_examples(docs):
    """Insults, clean strings and pool from (label, strings) in plain Python."""
    toxic, clean = [s for y, s in docs if y == 1], [s for y, s in docs if y == 0]
    often = {1: {}, 0: {}}
    for y, strings in docs:
        for r in set().union(*map(toxicity.runs, strings)):
            often[y][r] = often[y].get(r, 0) + 1
    tells = {r: n * (np.log((n + 0.5) / (len(toxic) + 1)) - np.log((often[0].get(r, 0) + 0.5) / (len(clean) + 1))) for r, n in often[1].items() if n > 1}
    worth = lambda s: sorted(max(0.0, tells.get(r, 0.0)) for r in toxicity.runs(s))[-3:][0]
    count = {}
    for strings in toxic:
        value = {s: worth(s) for s in strings}
        for s, v in value.items():
            if v >= toxicity.LEAST_TOLD and v >= max(value.values()) / 4:
                count[s] = count.get(s, 0) + 1
    elsewhere = {s: sum(s in c for c in clean) for s in count}
    found = {s: n for s, n in count.items() if n * len(clean) > 10 * elsewhere[s] * len(toxic) and (n > 2 or worth(s) >= toxicity.SURELY_TOLD)}
    others = sorted(set().union(*clean) - set(found), key=lambda s: (zlib.crc32(s.encode()), s))
    alike = sorted((s for s in others if worth(s) > 0), key=lambda s: -worth(s))
    return sorted(found, key=lambda s: (-found[s], s)), others, alike


@needs
def test_toxic_examples_equal_a_plain_count(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels, "doc_id").filter("toxic = 1 OR doc_id % 4 = 0").orderBy("doc_id").limit(300)
    rows = toxicity.F.broadcast(some).select("doc_id", toxicity.F.col("toxic").cast("int").alias("label"), "text")
    positives, negatives, pool = toxicity.examples(toxicity.saved(rows, "few"))
    want, others, alike = plain_examples([(r.label, toxicity.strings_of(r.text)) for r in rows.collect()])
    assert positives == want[:toxicity.POSITIVES] and len(positives) > 0
    assert negatives == others[:toxicity.NEGATIVES]
    assert set(pool) == set(alike[:toxicity.POOL]) | set(others[:toxicity.POOL])


def test_machine_equals_plain_descent():
    """The squared-hinge objective over the same kernel features, minimised by plain gradient descent."""
    insults = ["^idiot$", "^idiots$", "^moron$", "^stupid$", "^loser$", "^1d1ot$"]
    clean = ["^window$", "^table$", "^river$", "^idiom$", "^study$", "^closer$", "^morning$", "^garden$", "^paper$", "^stone$", "^light$", "^rather$"]
    strings, landmarks = insults + clean, insults[:4] + clean[:6]
    y = np.array([1.0] * len(insults) + [-1.0] * len(clean))
    machine = toxicity.support_vectors(strings, y, landmarks, ridge=1e-2)
    among = np.array([[brute_kernel(a, b) for b in landmarks] for a in landmarks])
    values, turned = np.linalg.eigh(among)
    half = turned[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    z = np.concatenate([np.array([[brute_kernel(a, b) for b in landmarks] for a in strings]) @ half, np.ones((len(strings), 1))], axis=1)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) / len(y)
    penalty, w = np.array([1e-2] * (z.shape[1] - 1) + [1e-9]), np.zeros(z.shape[1])
    step = 0.5 / (np.linalg.norm(z * np.sqrt(cost)[:, None], 2) ** 2 + 1e-2)
    for _ in range(60_000):
        short = np.maximum(0, 1 - y * (z @ w))
        w -= step * 2 * (penalty * w - z.T @ (cost * y * short))
    np.testing.assert_allclose(machine.decide(strings), np.maximum(toxicity.FLOOR, z @ w), atol=2e-3)
