import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators.scan import block_of, choose_width, ema, islands, scan, trailing


def rows(n=400, keys=3, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if rnd.random() < .6 else rnd.randrange(1, keys)
        out.append((key, rnd.randrange(1000), i, rnd.choice([None, 1, 2, 3]), rnd.randrange(50)))
    return out


def by_key(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.mark.parametrize("width,parts", [(7, 1), (90, 5), (5000, 3)])
def test_scan_matches_sequential_pass(spark, width, parts):
    data = rows()
    random.Random(2).shuffle(data)
    df = spark.createDataFrame(data, "k int, t int, seq int, v int, x int").repartition(parts)
    got = scan(df, ["k"], ["t", "seq"], block_of("t", width), total={"tot": F.col("x")}, peak={"top": F.col("x")},
               last={"last": F.col("v")}, ahead={"ahead": F.col("v")}, prev={"pv": F.col("v")}, nxt={"nx": F.col("x")}, rank="rn")
    got = {r.seq: r for r in got.collect()}
    assert len(got) == len(data)
    for group in by_key(data).values():
        tot, seen, top = 0, None, None
        for i, r in enumerate(group):
            g = got[r[2]]
            tot += r[4]
            later = next((q[3] for q in group[i + 1:] if q[3] is not None), None)
            assert (g.tot, g.last, g.top, g.rn, g.ahead) == (tot, seen, top, i + 1, later)
            assert g.pv == (group[i - 1][3] if i else None)
            assert g.nx == (group[i + 1][4] if i + 1 < len(group) else None)
            seen = r[3] if r[3] is not None else seen
            top = r[4] if top is None else max(top, r[4])


@pytest.mark.parametrize("width", [3, 60, 5000])
def test_islands_match_sequential_pass(spark, width):
    data = rows(seed=5)
    df = spark.createDataFrame(data, "k int, t int, seq int, v int, x int")
    got = islands(df, ["k"], ["t", "seq"], block_of("t", width), {"t": F.col("t")}, lambda p, c: c["t"] - p["t"] > 4)
    got = {r.seq: r.island for r in got.collect()}
    for group in by_key(data).values():
        number, before = 0, None
        for r in group:
            number += before is None or r[1] - before > 4
            before = r[1]
            assert got[r[2]] == number


def test_trailing_mean_crosses_chunks(spark):
    data = rows(120, seed=3)
    df = spark.createDataFrame(data, "k int, t int, seq int, v int, x int")
    got = trailing(df, ["k"], ["t", "seq"], block_of("t", 50), 4, {"m": lambda w: F.avg("x").over(w)}, chunk=8)
    got = {r.seq: r.m for r in got.collect()}
    assert len(got) == len(data)
    for group in by_key(data).values():
        for i, r in enumerate(group):
            span = [q[4] for q in group[max(0, i - 3):i + 1]]
            assert got[r[2]] == pytest.approx(sum(span) / len(span))


@pytest.mark.parametrize("keep", [.05, .5, .85, .999])
def test_baseline_crosses_chunks(spark, keep):
    data = rows(1500, seed=4)
    df = spark.createDataFrame(data, "k int, t int, seq int, v int, x int").withColumn("x", F.col("x").cast("double"))
    got = ema(df, ["k"], ["t", "seq"], block_of("t", 100), {"b": "x"}, keep)
    got = {r.seq: r.b for r in got.collect()}
    for group in by_key(data).values():
        base = None
        for r in group:
            assert got[r[2]] == (None if base is None else pytest.approx(base, rel=1e-9, abs=1e-9))
            base = float(r[4]) if base is None else base * keep + r[4] * (1 - keep)


def test_baseline_refuses_rates_that_do_not_fit(spark):
    for keep in (0, 1, 1.5, .9999999):
        with pytest.raises(ValueError):
            ema(spark.range(1), ["id"], ["id"], F.lit(0), {"b": "id"}, keep)


def test_width_follows_the_densest_slot(spark):
    df = spark.createDataFrame([(1, t) for t in range(100)] + [(2, 5)], "k int, t int")
    assert choose_width(df, ["k"], "t", 10, 20, 1000) == 20
    assert choose_width(df, ["k"], "t", 10, 20, 15) == 15
