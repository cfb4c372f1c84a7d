"""The corpus pipeline against a plain version of each stage, and its registration."""

import hashlib
import math
import os
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from matchloom.llm import mixing, packing, toxicity
from tests.llm.test_mixing import targets
from tests.llm.test_packing import check
from tests.llm.test_secrets import plain
from tests.llm.test_simhash import brute_fingerprint

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not present")


def one_of_each(rows):
    """The document of the smallest id of each group of fingerprints within two bits."""
    fps = np.array([brute_fingerprint(r.text) for r in rows], np.uint64)
    label = np.arange(len(rows))
    for x in range(len(rows)):
        for y in np.flatnonzero(np.bitwise_count(fps[x] ^ fps[:x]) <= 2):
            low, high = sorted((label[x], label[y]))
            label[label == high] = low
    first = {}
    for r, v in sorted(zip(rows, label), key=lambda z: z[0].doc_id):
        first.setdefault(v, r)
    return list(first.values())


def masked(text):
    out, at = "", 0
    for a, _, b, _ in plain(text):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def mixture(rows):
    """Copies of each (doc_id, text) by systematic sampling in order of size."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = Counter()
    for _, text, source in rows:
        total[source] += size(text)
    goal, out = targets(total), []
    for source in total:
        own = sorted((size(t), hashlib.md5(str(d).encode()).hexdigest(), d, t) for d, t, s in rows if s == source)
        rate = goal[source] / total[source] if total[source] else 0.0
        u = int(hashlib.md5(f"{mixing.SEED}:{source}".encode()).hexdigest()[:8], 16) / 2 ** 32
        for k, (_, _, d, t) in enumerate(own):
            out += [(d, t)] * (math.floor(rate * (k + 1) + u) - math.floor(rate * k + u))
    return out


def test_run_equals_plain_stages(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    clean = [r for r in docs.collect() if scores[r.doc_id] < toxicity.CUT]
    assert 0.8 * docs.count() < len(clean) < docs.count()
    kept = [(r.doc_id, masked(r.text), r.source) for r in one_of_each(clean)]
    got = corpus_pipeline.run(spark, FOLDER).collect()
    check(got, mixture(kept), packing.CAPACITY)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), FOLDER).schema.names == docs.schema.names
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_every_operator_is_registered():
    names = entry.queries().keys()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
