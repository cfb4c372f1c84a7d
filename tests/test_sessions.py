from pyspark.sql import functions as F

from matchloom.operators import sessions as ss
from matchloom.operators.scan import block_of

KEY, ORDER = ["video_id"], ["t", "seq"]


def events(spark, kinds):
    return spark.createDataFrame([(1, i, t, k) for i, (t, k) in enumerate(kinds)], "video_id int, seq int, t long, type string")


def test_double_start_leaves_the_first_round_open(spark):
    df = events(spark, [(5, "player_kill"), (10, "round_start"), (12, "player_kill"), (20, "round_start"), (25, "player_death"),
                        (30, "round_end"), (35, "player_kill"), (40, "round_end")])
    for width in (4, 1000):
        table = ss.session_table(ss.bracket_sessions(df, KEY, ORDER, block_of("t", width)), KEY)
        got = [(r.rid, r.s, r.e, r.n) for r in table.orderBy("rid").collect()]
        assert got == [(1, 10, None, 2), (2, 20, 30, 3)]


def test_end_and_start_at_one_time_follow_emission_order(spark):
    df = events(spark, [(0, "round_start"), (9, "round_end"), (9, "round_start"), (11, "player_kill")])
    table = ss.session_table(ss.bracket_sessions(df, KEY, ORDER, block_of("t", 3)), KEY)
    assert [(r.s, r.e, r.n) for r in table.orderBy("rid").collect()] == [(0, 9, 2), (9, None, 2)]


def test_windows_clamp_and_merge(spark):
    df = spark.createDataFrame([(1, -1.0, 2.0), (1, 2.5, 6.0), (1, 7.0, 12.0), (1, 4.0, 4.0)], "video_id int, a double, b double")
    got = ss.union_intervals(df, KEY, "a", "b", 3, .75, duration=F.lit(10.0)).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(0.0, 6.0), (7.0, 10.0)]


def test_refinement_triggers_include_lost_health(spark):
    df = spark.createDataFrame([(1, 0, 0, False, True), (1, 1, 10, False, False), (1, 2, 20, True, False), (1, 3, 30, False, False)],
                               "video_id int, seq int, t long, shot boolean, health boolean")
    got = ss.refinement_triggers(df, KEY, ORDER, block_of("t", 15), ["shot"], "health")
    assert [r.t for r in got.orderBy("t").collect()] == [10, 20]


def test_clock_needs_a_consistent_countdown(spark):
    df = spark.createDataFrame([(1, 0, 0, 115), (1, 1, 2, 113), (1, 2, 4, 45), (2, 3, 0, 115), (2, 4, 8, 115)],
                               "video_id int, seq int, t long, clock int")
    got = ss.longest_clock_chain(df, KEY, ORDER, block_of("t", 3), "t", "clock").collect()
    assert [(r.video_id, r.n, r.first_clock) for r in got] == [(1, 2, 115)]


def test_money_needs_two_equal_readings(spark):
    df = spark.createDataFrame([(1, 0, 0, 800), (1, 1, 8, 2750), (1, 2, 16, 2750), (1, 3, 60, 4000), (1, 4, 66, 4000)],
                               "video_id int, seq int, t long, money int")
    got = ss.first_stable_value(df, KEY, ORDER, block_of("t", 10), "t", "money", 10.5).collect()
    assert [(r.value, r.n) for r in got] == [(2750, 2)]


def test_weights_hold_at_mixed_rates(spark):
    rows = [(1, 1, 0, .5, False), (1, 1, 500, .1, True), (1, 1, 600, .1, True), (1, 1, 700, 9.3, False)]
    df = spark.createDataFrame(rows, "video_id int, rid int, t long, w double, flashed boolean").withColumn("motion", F.lit(.05))
    got = ss.weighted_round_summary(df, ["video_id", "rid"], F.col("w"), F.col("flashed"), F.lit(False), F.col("motion")).first()
    assert round(got.flash_time, 6) == .2 and round(got.motion_avg, 6) == .05 and got.stationary_ratio == 1.0


def test_keyframes_skip_repeated_frames(spark):
    df = spark.createDataFrame([(1, 1, 0, 30), (1, 2, 30, None), (1, 3, 31, 31)], "video_id int, rid int, s long, e long")
    got = ss.round_keyframes(df, "video_id", "s", F.coalesce("e", F.lit(60)), 2, F.floor(F.col("at") / 15).cast("long"), 3)
    assert [(r.rid, r.sample_index, r["at"]) for r in got.orderBy("at").collect()] == [(1, 1, 10), (1, 2, 20), (2, 1, 40)]
