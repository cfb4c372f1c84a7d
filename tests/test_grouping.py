"""Running-mean groups against the sequential kernel."""

import random

import pytest

from matchloom.operators import grouping
from matchloom.operators.kernels import RunningMeanGroups

SCHEMA = "video_id int, seq long, value double"


class Row:
    def __init__(self, seq, value):
        self.seq, self.value = seq, value


def sequential(rows, tolerance):
    kernel, states, out = RunningMeanGroups(tolerance), {}, []
    for video, seq, value in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0], r[2], r[1])):
        out += [(video, *o) for o in kernel.step(states.setdefault(video, kernel.fresh()), Row(seq, value))]
    return sorted(out)


def rows(kind):
    rnd = random.Random(7)
    if kind == "even":  # groups all hang on the first value
        return [(v, i, float(i)) for v in (1, 2) for i in range(3_000)]
    if kind == "heavy":  # one value holds a third of the rows, and later values pull the mean along
        return [(1, i, 50.0) for i in range(700)] + [(1, 700 + i, float(i // (1 + i // 40))) for i in range(900)] + [(1, 2_000 + i, 2.0 ** (i % 9)) for i in range(300)]
    return [(rnd.randrange(3), i, rnd.choice([rnd.randrange(60), rnd.randrange(1_000, 9_000)]) / 2) for i in range(2_000)]


@pytest.mark.parametrize("kind", ["even", "heavy", "mixed"])
@pytest.mark.parametrize("piece", [grouping.PIECE, 17])
def test_groups_equal_the_sequential_run(spark, kind, piece):
    data = rows(kind)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = grouping.running_mean_groups(df, ["video_id"], "value", 5.0, piece)
    assert sorted(map(tuple, got.select("video_id", "seq", "value", "group_start").collect())) == sequential(data, 5.0)


def test_one_pass_over_even_values(spark, monkeypatch):
    """Many pieces, one written table of them: nothing runs again."""
    written = []
    monkeypatch.setattr(grouping, "durable", lambda df, real=grouping.durable: written.append(1) or real(df))
    data = rows("even")
    got = grouping.running_mean_groups(spark.createDataFrame(data, SCHEMA), ["video_id"], "value", 5.0, 75)
    assert got.count() == len(data) and written == [1]


def test_null_values_and_empty_input(spark):
    got = grouping.running_mean_groups(spark.createDataFrame([(1, 0, None), (1, 1, 2.0)], SCHEMA), ["video_id"], "value", 1.0)
    assert sorted((r.seq, r.group_start) for r in got.collect()) == [(0, None), (1, 2.0)]
    assert grouping.running_mean_groups(spark.createDataFrame([], SCHEMA), ["video_id"], "value", 1.0).collect() == []
