"""Ranked lexical search against scores of all documents."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from matchloom.llm import lexical
from matchloom.llm.queries import lexical_sql

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, k):
    found = [(i, Counter(words(t))) for i, t in docs]
    full = [(i, c) for i, c in found if c]
    n, total = len(full), sum(sum(c.values()) for _, c in full)
    df = Counter(t for _, c in full for t in c)
    out = []
    for item, text in items:
        query, scored = set(words(text)), []
        for i, c in full:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t in query if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def tables():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)] + ["Été", "ß", "naïve", "汉字", "x_y", "A.B"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(d, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 20, 80, 300])))) for d in range(500)]
    docs += [(1000 + d, "the hot copy W1 w2 w250") for d in range(300)] + [(7, "again w3"), (7, "again w3"), (None, "w3 w9 w100"), (2000, None), (2001, ""), (2002, " .,\n")]
    docs += [(2003, "w1 w77 " * 30_000), (2004, "W1 w2\x7fw3")]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 40])))) for k in range(30)]
    return docs, items + [(50, "hot copy"), (51, None), (52, "absent"), (None, "w3"), (50, "hot copy"), (53, "W1 w1 w1")]


def frames(spark, docs, items):
    return (spark.createDataFrame([(t, "x", i, 3) for i, t in docs], "text string, term string, doc_id long, Score int").repartition(5),
            spark.createDataFrame([(t, i, 1) for i, t in items], "text string, item_id long, rid int").repartition(2))


@pytest.mark.parametrize("postings,batch", [(lexical.POSTINGS, lexical.ROUND), (700, 3)])
def test_search_against_all_scores(spark, postings, batch):
    docs, items = tables()
    got = lexical.search(*frames(spark, docs, items), k=12, postings=postings, batch=batch).collect()
    assert sorted(map(tuple, got), key=str) == expected(docs, items, 12)


def test_query_blocks(spark, monkeypatch):
    docs, items = tables()
    monkeypatch.setattr(lexical, "QUERIES", 5)
    got = lexical.search(*frames(spark, docs, items), postings=2_000).collect()
    assert sorted(map(tuple, got), key=str) == expected(docs, items, 50)


def test_sql_twin():
    docs, items = tables()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(con.execute(lexical_sql("documents", "benchmark")).fetchall(), key=str) == expected(docs, items, 50)


def test_intervals_are_pruned():
    """A rare term is found without splitting down to every document."""
    block, wanted = lexical.Block(), type("All", (dict,), {"__missing__": lambda self, t: True})()
    for d in range(2_000):
        block.add(d, "common " * (1 + d % 7) + ("rare" if d % 400 == 0 else "other"), wanted)
    n, total, _, sizes, names, counts, places, tfs = block.row()
    postings = lexical.Postings(names, counts, places, tfs, sizes, {b"common": 1, b"rare": 5000, b"other": 2}, n, total)
    seen, plain = [], postings.intervals
    postings.intervals = lambda *x: seen.append(len(plain(*x)[0])) or plain(*x)
    place, score, _ = postings.search([b"common", b"rare"], 5, 0, 8)
    assert len(place) >= 5 and sum(seen) < 200


def test_empty(spark):
    docs, items = frames(spark, *tables())
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
