"""Sequential kernels without a loop: every block charts where each entry state leads.

Where the state of a kernel is a choice among few, a block can be run from all of
them at once. Its chart is the exit state of every entry state; charts follow one
another, so those of FAN neighbouring blocks make one chart, those of FAN such groups
another, until a key has one. Going down again, each block gets its true entry state.
The rows are read twice, once for the chart and once for the output, whatever the
number of blocks, and the rounds between grow with its logarithm.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from matchloom.operators.blocks import durable, run_from, tasks_for
from matchloom.operators.kernels import DebouncedLow

FAN = 64


class LowCharts:
    """Charts of ``DebouncedLow``.

    Out of cooldown its state is a count below ``need``; in cooldown the count is 0, and
    what matters is the first reading after its end. So an entry state is a count at the
    first reading, or a count of 0 at a later one. Read from the end of the block, the
    outcome of each follows from a later one: the count that follows, or after firing,
    a count of 0 at the first reading beyond the cooldown.

    A chart is {"free": [state per count], "cool": [[t, state], ...]}: a cooldown that ends
    by ``t`` (and not before the last one) leads to the state. One that ends later
    leads out of the block as it came.
    """

    def __init__(self, kernel: DebouncedLow) -> None:
        self.kernel = kernel

    def chart(self, rows) -> dict:
        """``rows``: (t, hp) in order."""
        k = self.kernel
        read = [(int(t), hp < k.threshold) for t, hp in rows if hp is not None and hp == hp]
        times = [t for t, _ in read]
        free = [[n, None] for n in range(k.need)]
        starts: list = [None] * len(read)  # where a count of 0 at a reading leads
        for i in range(len(read) - 1, -1, -1):
            t, low = read[i]
            before = []
            for n in range(k.need):
                if not low:
                    before.append(free[max(0, n - 1)])
                elif n + 1 < k.need:
                    before.append(free[n + 1])
                else:
                    j = bisect_left(times, t + k.cooldown, i + 1)
                    before.append(starts[j] if j < len(read) else [0, t])
            free = before
            starts[i] = free[0]
        cool, last = [], None
        for t, state in zip(times, starts):
            if last is not None and last >= times[0] + k.cooldown:
                break  # a cooldown from before the block has ended
            if cool and cool[-1][1] == state:
                cool[-1][0] = t
            elif last != t:
                cool.append([t, state])
            last = t
        return {"free": free, "cool": cool}

    def follow(self, chart: dict, state: list) -> list:
        n, fired = state
        if fired is None:
            return chart["free"][n]
        at = bisect_left(chart["cool"], fired + self.kernel.cooldown, key=lambda x: x[0])
        return chart["cool"][at][1] if at < len(chart["cool"]) else state

    def joined(self, one: dict, two: dict) -> dict:
        """The chart of two neighbouring stretches."""
        cool = [[t, self.follow(two, s)] for t, s in one["cool"]]
        end = cool[-1][0] if cool else None
        # what outlasts the first stretch meets the second as it came
        cool += [[t, s] for t, s in two["cool"] if end is None or t > end]
        return {"free": [self.follow(two, s) for s in one["free"]], "cool": cool}

    def first(self) -> list:
        return [0, None]

    def state(self, packed: list) -> dict:
        return {"n": packed[0], "fired": packed[1]}


def run_charted(df: DataFrame, key: Sequence[str], order: Sequence[str], block: Column, kernel, charts, columns: Sequence[str]) -> DataFrame:
    """Run ``kernel`` over every key; returns ``key`` + ``kernel.schema`` columns, equal to the sequential run.

    ``charts`` makes and joins the charts of blocks from the named columns.
    """
    key, order = list(key), list(order)
    spot = [*key, "blk_id"]
    rows = durable(df.withColumn("blk_id", block))
    schema = T.StructType([rows.schema[c] for c in spot] + [T.StructField("chart", T.StringType())])
    lines = rows.select(*spot, *dict.fromkeys([*order, *columns])).repartition(tasks_for(rows), *spot).sortWithinPartitions(*spot, *order)
    found = durable(lines.mapInArrow(_charter(charts, spot, list(columns), to_arrow_schema(schema)), schema))
    entries = _entries(found, key, charts)
    return run_from(rows, key, order, kernel, entries)


def _charter(charts, spot: list[str], columns: list[str], arrow: pa.Schema):
    def run(batches):
        at, held = None, []

        def record():
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*at, json.dumps(charts.chart(held))), arrow)], schema=arrow)

        for batch in batches:
            names = [batch.column(c).to_pylist() for c in [*spot, *columns]]
            for values in zip(*names):
                if values[:len(spot)] != at:
                    if at is not None:
                        yield record()
                    at, held = values[:len(spot)], []
                held.append(values[len(spot):])
        if at is not None:
            yield record()
    return run


def _entries(found: DataFrame, key: list[str], charts) -> DataFrame:
    """The entry state of every block, as JSON: charts joined upwards, states handed down."""
    place = F.row_number().over(W.partitionBy(*key).orderBy("blk_id")) - 1
    level = durable(found.withColumn("at", place.cast("long")))
    levels = [level]
    kinds = {c: found.schema[c] for c in key}
    up_schema = T.StructType([kinds[c] for c in key] + [T.StructField("at", T.LongType()), T.StructField("chart", T.StringType())])

    def joined(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        whole = None
        for text in group.column("chart").to_pylist():
            one = json.loads(text)
            whole = one if whole is None else charts.joined(whole, one)
        head = {c: group.column(c)[:1] for c in key}
        return pa.table(head | {"at": pa.array([group.column("at")[0].as_py() // FAN], pa.int64()), "chart": [json.dumps(whole)]})

    while len(levels) == 1 or not levels[-1].filter(F.col("at") > 0).isEmpty():
        grouped = levels[-1].select(*key, "at", "chart").groupBy(*key, F.floor(F.col("at") / FAN).alias("up"))
        levels.append(durable(grouped.applyInArrow(joined, up_schema)))
    states = levels.pop().select(*key, "at", F.lit(json.dumps(charts.first())).alias("entry"))
    while levels:
        level = levels.pop()
        with_id = ["blk_id"] if "blk_id" in level.columns else []
        down = level.withColumn("up", F.floor(F.col("at") / FAN))
        down = down.join(states.select(*key, F.col("at").alias("up"), "entry"), [*key, "up"])
        out = T.StructType([kinds[c] for c in key] + [T.StructField("at", T.LongType())] + [found.schema[c] for c in with_id] + [T.StructField("entry", T.StringType())])

        def handed(group: pa.Table) -> pa.Table:
            group = group.sort_by("at")
            state, entries = json.loads(group.column("entry")[0].as_py()), []
            for text in group.column("chart").to_pylist():
                entries.append(json.dumps(charts.state(state) if with_id else state, sort_keys=True))
                state = charts.follow(json.loads(text), state)
            return pa.table({c: group.column(c) for c in [*key, "at", *with_id]} | {"entry": entries})

        states = durable(down.groupBy(*key, "up").applyInArrow(handed, out))
    return states.select(*key, "blk_id", F.col("entry").alias("blk_entry"))
