"""Charted blocks against the sequential run of the kernel."""

import random

import pytest

from matchloom.operators import charts
from matchloom.operators.charts import LowCharts, run_charted
from matchloom.operators.kernels import DebouncedLow
from matchloom.operators.scan import block_of

KEY, ORDER = ["video_id"], ["t", "seq"]


class Row:
    def __init__(self, **kw):
        self.__dict__.update(kw)


def sequential(kernel, rows):
    out, states = [], {}
    for v, seq, t, hp in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        out += [(v, *o) for o in kernel.step(states.setdefault(v, kernel.fresh()), Row(seq=seq, t=t, hp=hp))]
    return sorted(out)


def readings(rnd, n, low):
    t, out = 0, []
    for i in range(n):
        t += rnd.choice([0, 1, 1, 2, 7, 30])
        out.append((i, t, rnd.choice(low)))
    return out


def test_charts_lead_where_the_kernel_leads():
    """Any entry state, any cut of the readings, also joined in pairs."""
    rnd = random.Random(1)
    for _ in range(400):
        kernel = DebouncedLow(20, rnd.randrange(1, 5), rnd.choice([1, 8, 40]))
        c, rows = LowCharts(kernel), readings(rnd, rnd.randrange(1, 30), [5, 5, 90, None])
        cut = rnd.randrange(len(rows) + 1)
        while 0 < cut < len(rows) and rows[cut][1] == rows[cut - 1][1]:
            cut += 1
        one, two = (c.chart([(t, hp) for _, t, hp in part]) for part in (rows[:cut], rows[cut:]))
        for entry in [[n, None] for n in range(kernel.need)] + [[0, -x] for x in range(1, 45, 3)]:
            state = c.state(list(entry))
            for seq, t, hp in rows:
                kernel.step(state, Row(seq=seq, t=t, hp=hp))
            got = c.follow(c.joined(one, two), entry)
            assert got == c.follow(two, c.follow(one, entry))
            last = next((t for _, t, hp in reversed(rows) if hp is not None), None)
            over = lambda fired: None if fired is None or last is None or last - fired >= kernel.cooldown else fired
            assert [got[0], over(got[1])] == [state["n"], over(state["fired"])]


@pytest.mark.parametrize("fan", [3, 64])
def test_charted_runs_equal_the_sequential_run(spark, monkeypatch, fan):
    monkeypatch.setattr(charts, "FAN", fan)
    rnd, kernel = random.Random(2), DebouncedLow(20, 3, 8)
    rows = [(v, *r) for v in (1, 2, 3) for r in readings(rnd, 200, [5, 10, 90, None])] + [(4, 0, 5, 1)]
    df = spark.createDataFrame(rows, "video_id int, seq long, t long, hp int").repartition(5)
    for width in (20, 100_000):
        got = run_charted(df, KEY, ORDER, block_of("t", width), kernel, LowCharts(kernel), ["t", "hp"])
        assert sorted(map(tuple, got.collect())) == sequential(kernel, rows)


def test_a_value_that_stays_low_takes_two_passes(spark, monkeypatch):
    """40 blocks whose firings all hang on the first one."""
    seen = []
    monkeypatch.setattr(charts, "durable", lambda df, real=charts.durable: seen.append(df.columns) or real(df))
    kernel, rows = DebouncedLow(20, 4, 37), [(1, i, i, 5) for i in range(4_000)]
    df = spark.createDataFrame(rows, "video_id int, seq long, t long, hp int")
    got = run_charted(df, KEY, ORDER, block_of("t", 100), kernel, LowCharts(kernel), ["t", "hp"]).collect()
    assert sorted(map(tuple, got)) == sequential(kernel, rows)
    assert sum("seq" in c for c in seen) == 1  # the rows themselves are written once; all else is one row a block


def test_empty(spark):
    kernel = DebouncedLow(20, 4, 37)
    df = spark.createDataFrame([], "video_id int, seq long, t long, hp int")
    assert run_charted(df, KEY, ORDER, block_of("t", 100), kernel, LowCharts(kernel), ["t", "hp"]).collect() == []
