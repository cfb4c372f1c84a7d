import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from matchloom.operators import combat as cc
from matchloom.operators.evaluation import regression_diff
from matchloom.operators.sessions import bracket_sessions, session_table
from matchloom.operators.scan import block_of
from matchloom.sources import readers

SEC = 1_000_000
SAMPLES = "video_id int, seq long, t long, highlight_score double, prints array<string>, positions array<double>"
ROUNDS = "video_id int, rid long, s long, e long"
FIGHTS = "video_id int, rid long, episode long, first_shot long, last_t long"
STATUS = ("video_id int, seq long, t long, flashed boolean, health boolean, damage boolean, left_alive boolean, "
          "right_alive boolean, left_score double, right_score double")


def us(seconds):
    return int(seconds * SEC)


def kills(spark, samples, fights=(), rounds=((1, 1, 0, us(60)),), width=us(5)):
    rows = [(1, i, us(t), s, list(p), list(q)) for i, (t, s, p, q) in enumerate(samples)]
    return cc.native_kills(
        spark.createDataFrame(list(rounds), ROUNDS), spark.createDataFrame(rows, SAMPLES),
        spark.createDataFrame([(1, 1, 1, us(a), us(b)) for a, b in fights], FIGHTS), width, float(SEC)).orderBy("t").collect()


def test_same_row_after_a_gap_is_one_kill(spark):
    got = kills(spark, [(22.0, .8, ["a"], [.3]), (26.0, .9, ["a"], [.3])])
    assert [(r.t, r.observations) for r in got] == [(us(22), 2)]


def test_simultaneous_rows_are_two_kills(spark):
    got = kills(spark, [(22.0, .9, ["a", "b"], [.3, .4]), (22.5, .85, ["a", "b"], [.3, .4])])
    assert len(got) == 2


def test_downward_insertions_limit_new_tracks(spark):
    got = kills(spark, [(20.0, .9, ["a"], [.32]), (20.5, .9, ["a", "b"], [.32, .45]), (21.0, .9, ["b"], [.32]),
                        (21.5, .9, ["c", "d"], [.32, .46]), (22.0, .9, ["c", "d"], [.32, .46])])
    assert len(got) == 3


def test_single_sample_needs_support(spark):
    assert kills(spark, [(22.0, .94, [], [])]) == []
    assert len(kills(spark, [(22.0, .99, [], [])])) == 1
    got = kills(spark, [(22.0, .82, [], [])], fights=[(21.0, 22.0)])
    assert got[0].engagement == 1 and got[0].confidence == pytest.approx(min(.96, .80 + .82 * .12 + .04))


def test_open_round_keeps_its_kill(spark):
    assert len(kills(spark, [(70.0, .9, ["z"], [.3]), (70.5, .9, ["z"], [.3])], rounds=((1, 1, 0, us(60)), (1, 2, us(65), None)))) == 1


def deaths(spark, samples, end=10.0):
    rows = []
    for i, s in enumerate(samples):
        d = {"t": i / 2, "flashed": False, "health": True, "damage": False, "la": None, "ra": None, "ls": 0.0, "rs": 0.0, **s}
        rows.append((1, i, us(d["t"]), d["flashed"], d["health"], d["damage"], d["la"], d["ra"], d["ls"], d["rs"]))
    return cc.native_deaths(spark.createDataFrame([(1, 1, 0, us(end))], ROUNDS), spark.createDataFrame(rows, STATUS), us(3), float(SEC)).collect()


def test_sustained_loss_is_one_death(spark):
    got = deaths(spark, [{"health": not 10 <= i <= 11, "damage": i == 10} for i in range(20)])
    assert [(r.t, r.missing, r.method, r.confidence) for r in got] == [(us(5), us(1), "health", .9)]


def test_flash_and_single_samples_are_not_deaths(spark):
    assert deaths(spark, [{"health": not 10 <= i <= 12, "flashed": 10 <= i <= 12} for i in range(20)]) == []
    assert deaths(spark, [{"health": i != 10} for i in range(20)]) == []
    assert len(deaths(spark, [{"health": i != 10, "damage": i == 9} for i in range(20)])) == 1


def test_flash_bridges_and_long_losses_do_not_count(spark):
    got = deaths(spark, [{"flashed": 12 <= i <= 15, "health": not 12 <= i <= 18} for i in range(24)], end=12.0)
    assert [r.flash_bridge for r in got] == [True]
    assert deaths(spark, [{"health": not 10 <= i <= 22} for i in range(28)], end=14.0) == []
    assert deaths(spark, [{"health": False} for _ in range(20)]) == []


def test_selected_card_recovers_a_death(spark):
    got = deaths(spark, [{"la": not 10 <= i <= 13, "ls": .55, "ra": True, "rs": .04} for i in range(20)])
    assert [(r.t, r.method) for r in got] == [(us(5), "card")]


def test_feed_samples_are_derived_once(spark):
    """What follows the written episodes takes the scores from there."""
    rows = [(1, i, us(20 + 4 * i), .8 + i / 100, ["a"], [.3]) for i in range(3)]
    samples = spark.createDataFrame(rows, SAMPLES.replace("highlight_score", "raw_score")).withColumnRenamed("raw_score", "highlight_score")
    got = cc.feed_row_tracks(samples, us(5), us(2.1), us(5.5))
    assert "raw_score" not in got._jdf.queryExecution().analyzed().toString()
    assert sorted((r.seq, r.track_seq, r.highlight_score) for r in got.collect()) == [(i, 0, .8 + i / 100) for i in range(3)]


# Regression: one recording of 18 rounds with 20 kills, 10 deaths and 6 artefacts,
# expanded at two sampling steps.
KILLS = [1, 0, 2, 1, 1, 0, 3, 1, 0, 2, 1, 1, 0, 2, 1, 1, 2, 1]
DIED = [True, False, True, False, True, True, False, True, False, False, True, True, False, True, False, True, True, False]


@pytest.fixture()
def match_file(tmp_path):
    rounds = [{"round_id": f"r{i:02d}", "kills": k, "died": d} for i, (k, d) in enumerate(zip(KILLS, DIED))]
    doc = {"rounds": rounds,
           "sampling_profiles": {"dense": {"sample_step_sec": .1, "sparse_strong_rounds": []},
                                 "sparse": {"sample_step_sec": .5, "sparse_strong_rounds": ["r03", "r09"]}},
           "outline_artifacts": [{"round_id": f"r{i:02d}", "offset_sec": 40.0 + i / 2, "score": .9 + i / 100} for i in (0, 1, 2, 3, 4, 5)],
           "expected": {"rounds": 18, "kills": 20, "deaths": 10, "open_final_round": "r17"}}
    path = tmp_path / "match1.json"
    path.write_text(json.dumps(doc))
    return str(path)


@pytest.mark.parametrize("profile", ["dense", "sparse"])
def test_regression_counts(spark, match_file, profile):
    docs = readers.read_signal_matches(spark, match_file)
    rounds = readers.signal_rounds(docs).withColumn("s", (F.col("rid") - 1) * 70 * SEC).withColumn("vid", F.lit(1))
    ends = rounds.filter("rid < 18").select("vid", F.col("rid").alias("seq"), (F.col("s") + 60 * SEC).alias("t"), F.lit("round_end").alias("type"))
    marks = rounds.select("vid", F.col("rid").alias("seq"), F.col("s").alias("t"), F.lit("round_start").alias("type")).unionByName(ends)
    table = session_table(bracket_sessions(marks.withColumnRenamed("vid", "video_id"), ["video_id"], ["t", "seq"], block_of("t", 200 * SEC)), ["video_id"])
    table = table.select("video_id", "rid", "s", "e")
    assert table.count() == 18 and table.filter("e IS NULL").count() == 1

    spec = docs.select(F.col("sampling_profiles")[profile].alias("p")).first()["p"]
    samples, seq = [], 0
    for i, n in enumerate(KILLS):
        for j in range(n):
            t, mark = 70 * i + 10 + 8 * j, f"r{i}-{j}"
            if f"r{i:02d}" in spec.sparse_strong_rounds and j == 0:
                shots = [(t, .99)]
            else:
                shots = [(t, .90), (t + spec.sample_step_sec, .86)]
            for at, score in shots:
                samples.append((1, seq, us(at), score, [mark], [.3]))
                seq += 1
    for a in docs.select(F.explode("outline_artifacts").alias("a")).select("a.*").collect():
        samples.append((1, seq, us(70 * int(a.round_id[1:]) + a.offset_sec), a.score, [f"artifact{seq}"], [.3]))
        seq += 1
    found = cc.native_kills(table, spark.createDataFrame(samples, SAMPLES), spark.createDataFrame([], FIGHTS), us(300), float(SEC))
    status = [(1, i * 120 + j, us(70 * i + j / 2), False, not (d and 50.0 <= j / 2 <= 50.5), False, None, None, 0.0, 0.0)
              for i, d in enumerate(DIED) for j in range(120)]
    dead = cc.native_deaths(table, spark.createDataFrame(status, STATUS), us(300), float(SEC))
    actual = found.groupBy("video_id").agg(F.count(F.lit(1)).cast("int").alias("kills")).join(
        dead.groupBy("video_id").agg(F.count(F.lit(1)).cast("int").alias("deaths")), "video_id")
    expected = docs.select(F.lit(1).alias("video_id"), "expected.kills", "expected.deaths")
    assert regression_diff(expected, actual, ["video_id"], ["kills", "deaths"]).collect() == []


def feed(silences, n=400):
    rnd, rows, t, episode = random.Random(9), [], 0, 0
    for i in range(n):
        t += 12 if silences and i % 10 == 0 else rnd.choice([1, 1, 2])
        episode += bool(rows) and t - rows[-1][2] > 2
        rows.append((1, i, t, [rnd.choice("abcdef") for _ in range(rnd.choice([1, 1, 2]))], episode, 2))
    return rows


@pytest.mark.parametrize("silences", [True, False])
def test_feed_rows_over_many_blocks(spark, monkeypatch, silences):
    """Stretches between silences are independent: 40 blocks settle in one pass."""
    from types import SimpleNamespace

    from matchloom.operators import blocks
    from matchloom.operators.kernels import RowTracks
    rows, kernel, want = feed(silences), RowTracks(5), []
    state = kernel.fresh()
    for r in rows:
        want += [(1, *o) for o in kernel.step(state, SimpleNamespace(seq=r[1], t=r[2], prints=r[3], episode=r[4], row_limit=r[5]))]
    passes = []
    monkeypatch.setattr(blocks, "durable", lambda df, real=blocks.durable: passes.append("blk_exit" in df.columns) or real(df))
    df = spark.createDataFrame(rows, "video_id int, seq long, t long, prints array<string>, episode long, row_limit int").repartition(3)
    width = rows[-1][2] // 40
    got = cc.follow_rows(df, width, 5)
    assert sorted(tuple(r) for r in got.select("video_id", "seq", "t", "print_no", "track_seq", "track_no").collect()) == sorted(want)
    assert not silences or sum(passes) == 1


def test_medians_against_sorted_values(spark):
    """One group holds nearly all rows; odd and even numbers of values, negatives, nulls, none."""
    from matchloom.operators.selection import medians
    rnd = random.Random(12)
    rows = [(1, rnd.choice([rnd.uniform(-5, 5), rnd.randrange(-3, 4) / 2, None])) for _ in range(2_000)]
    rows += [(2, 1.0), (2, 4.0), (3, -1e9), (3, 2.0), (3, 1e12), (4, None), (5, 0.0)]
    got = {r.g: (r.m, r.twice) for r in medians(spark.createDataFrame(rows, "g int, x double").repartition(5), ["g"], {"m": F.col("x"), "twice": F.col("x") * 2}).collect()}
    for g in range(1, 6):
        own = [x for k, x in rows if k == g and x is not None]
        assert got[g] == ((statistics.median(own), 2 * statistics.median(own)) if own else (None, None))
