import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import joins as jj
from matchloom.operators.combat import first_round
from matchloom.operators.intervals import box_pairs, interval_join, iou, overlap_join


def spread(seed=1):
    rnd = random.Random(seed)
    points = [(rnd.choice([1, 1, 1, 2]), i, rnd.randrange(3000)) for i in range(150)]
    ivs = []
    for i in range(80):
        s = rnd.randrange(3000)
        e = None if rnd.random() < .1 else s + rnd.choice([0, 1, 10, 200, 2500])
        ivs.append((rnd.choice([1, 1, 2]), i, s, e))
    return points, ivs


@pytest.mark.parametrize("closed", ["left", "both", "right"])
@pytest.mark.parametrize("width", [1, 40, 100_000])
def test_interval_join_matches_brute_force(spark, closed, width):
    points, ivs = spread()
    p = spark.createDataFrame(points, "k int, pid int, at int")
    i = spark.createDataFrame(ivs, "k int, iid int, s int, e int")
    got = sorted((r.pid, r.iid) for r in interval_join(p, i, ["k"], "at", "s", "e", width, closed, open_ended=True).collect())
    def inside(t, s, e):
        low = t > s if closed == "right" else t >= s
        return low and (e is None or (t < e if closed == "left" else t <= e))
    want = sorted((pid, iid) for k, pid, t in points for k2, iid, s, e in ivs if k == k2 and inside(t, s, e))
    assert got == want and want


def test_overlap_join_matches_brute_force(spark):
    points, ivs = spread(4)
    spans = [(k, i, t, t + (i * 37) % 400) for k, i, t in points]
    a = spark.createDataFrame(spans, "k int, aid int, first int, last int")
    b = spark.createDataFrame(ivs, "k int, bid int, s int, e int")
    got = sorted((r.aid, r.bid) for r in overlap_join(a, b, ["k"], "first", "last", "s", "e", 50).collect())
    want = sorted((i, j) for k, i, f, l in spans for k2, j, s, e in ivs if k == k2 and (f >= s if e is None else f < e and l >= s))
    assert got == want


def test_first_round_prefers_list_order(spark):
    points, _ = spread(7)
    rounds = [(1, 1, 0, 100), (1, 2, 100, None), (1, 3, 500, 900), (2, 1, 50, 60), (2, 2, 1000, None), (2, 3, 1500, None)]
    p = spark.createDataFrame(points, "video_id int, seq int, t int")
    r = spark.createDataFrame(rounds, "video_id int, rid int, s int, e int")
    got = {row.seq: row.rid for row in first_round(p, r, "t", 30).collect()}
    want = {}
    for k, i, t in points:
        hit = next((rid for k2, rid, s, e in rounds if k2 == k and s <= t and (e is None or t < e)), None)
        if hit is not None:
            want[i] = hit
    assert got == want


def test_box_pairs_match_brute_force(spark):
    rnd = random.Random(9)
    boxes = [(rnd.randrange(2), i, x := rnd.uniform(0, 300), y := rnd.uniform(0, 300), x + rnd.uniform(1, 150), y + rnd.uniform(1, 60)) for i in range(80)]
    a = spark.createDataFrame(boxes, "f int, i int, x1 double, y1 double, x2 double, y2 double")
    b = a.select("f", *[F.col(c).alias("b_" + c) for c in a.columns[1:]])
    A, B = ["x1", "y1", "x2", "y2"], ["b_x1", "b_y1", "b_x2", "b_y2"]
    rows = box_pairs(a, b, ["f"], A, B, 40.0).withColumn("v", iou(A, B)).collect()
    got = sorted((r.i, r.b_i) for r in rows)
    want = sorted((p[1], q[1]) for p in boxes for q in boxes if p[0] == q[0] and min(p[4], q[4]) > max(p[2], q[2]) and min(p[5], q[5]) > max(p[3], q[3]))
    assert got == want
    assert all(abs(r.v - 1) < 1e-9 for r in rows if r.i == r.b_i)


def test_refined_frames_win(spark):
    base = spark.createDataFrame([(1, 0, 1, "b"), (1, 10, 2, "b")], "video_id int, frame int, seq int, src string")
    fine = spark.createDataFrame([(1, 5, 3, "r"), (1, 10, 4, "r")], "video_id int, frame int, seq int, src string")
    got = jj.prefer_refined(base, fine, ["video_id", "frame"], "seq").orderBy("frame").collect()
    assert [(r.frame, r.src) for r in got] == [(0, "b"), (5, "r"), (10, "r")]


def test_rejected_events_leave_and_labels_join_once(spark):
    ev = spark.createDataFrame([("k1", 1, 1, "player_kill", 5, .5, "s"), ("s1", 1, 1, "round_start", 0, .9, "s")],
                               "event_id string, video_id int, rid int, type string, t int, confidence double, source string")
    co = spark.createDataFrame([("k1", False), ("s1", False)], "event_id string, accepted boolean")
    assert [r.event_id for r in jj.apply_corrections(ev, co).collect()] == ["s1"]
    rounds = spark.createDataFrame([(1, 1)], "video_id int, rid int")
    labels = spark.createDataFrame([("k1", 1, 1, "player_kill", 5, 1), ("m1", 1, 1, "player_death", 7, 2), ("m1", 1, 1, "player_death", 8, 3),
                                    ("m2", 1, 9, "player_kill", 7, 4), ("m3", 1, 1, "keyframe", 7, 5)],
                                   "event_id string, video_id int, rid int, type string, t int, seq int")
    got = jj.add_manual_events(ev, rounds, labels).orderBy("event_id").collect()
    assert [(r.event_id, r.t, r.confidence) for r in got] == [("k1", 5, .5), ("m1", 7, 1.0), ("s1", 0, .9)]


def test_overlap_counts_pair_no_open_round(spark, monkeypatch):
    """Open rounds count what begins after them; the join sees closed ones alone."""
    import random

    from matchloom.operators import intervals
    rnd = random.Random(8)
    items = [(v, i, t, t + rnd.randrange(1, 60), rnd.choice("ab")) for v in (1, 2) for i, t in enumerate(rnd.randrange(0, 2_000) for _ in range(150))]
    rounds = [(v, r, 100 * r, 100 * r + 80 if r % 3 else None) for v in (1, 2, 3) for r in range(12)]
    joined = []
    monkeypatch.setattr(intervals, "overlap_join", lambda left, right, *x, real=intervals.overlap_join: joined.append(right) or real(left, right, *x))
    a = spark.createDataFrame(items, "video_id int, no int, first_t long, last_t long, kind string")
    b = spark.createDataFrame(rounds, "video_id int, rid long, s long, e long").repartition(3)
    got = intervals.overlap_counts(a, b, ["video_id"], "first_t", "last_t", "s", "e", 50, {"a": F.col("kind") == "a", "every": F.lit(True)})
    meets = lambda x, r: x[0] == r[0] and ((x[2] < r[3] and x[3] >= r[2]) if r[3] is not None else x[2] >= r[2])
    want = {(*r, sum(meets(x, r) and x[4] == "a" for x in items), sum(meets(x, r) for x in items)) for r in rounds}
    assert {tuple(r) for r in got.collect()} == want
    assert joined[0].filter("e IS NULL").isEmpty()
