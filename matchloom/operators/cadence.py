"""Rows at a least distance in time; a recording of any length and density is never one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from matchloom.operators.blocks import durable, tasks_for

#: Groups of keys per task and block, so that tasks come out even.
SHARES = 4


def _starts(table: pa.Table, key: Sequence[str]) -> np.ndarray:
    """The first row of every key of a table sorted by key."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in key:
        values = table.column(c).combine_chunks()
        new[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _ends(starts: np.ndarray, n: int) -> np.ndarray:
    """For each row, the end of its key's rows."""
    ends = np.append(starts[1:], n)
    return np.repeat(ends, ends - starts)


def _hops(t: np.ndarray, starts: np.ndarray, step: int) -> np.ndarray:
    """For each row, the first row of its key that is ``step`` later; the end of the key's rows where there is none."""
    ends = np.append(starts[1:], len(t))
    if not len(t):
        return np.zeros(0, np.int64)
    since = t - np.repeat(t[starts], ends - starts)
    room = int(since.max()) + step + 1
    hop, fit = np.empty(len(t), np.int64), max(1, 2**62 // room)
    for i in range(0, len(starts), fit):  # keys follow one another on one axis, as many as it has room for
        a, b = starts[i], ends[min(i + fit, len(starts)) - 1]
        line = since[a:b] + np.repeat(np.arange(len(starts[i:i + fit])), (ends - starts)[i:i + fit]) * room
        hop[a:b] = a + np.searchsorted(line, line + step)
    return hop


def thin(df: DataFrame, key: Sequence[str], order: Sequence[str], block: Column, interval: float) -> DataFrame:
    """Keep the first row of a key and every row ``interval`` after the last kept one: key + order columns.

    What a block does depends on one thing, its first kept row, which lies within one
    interval of its first row. Each block tells for these rows, one by one, where the
    chain from there leaves it; the block that holds the time one interval later tells
    which row of a later block comes next. From a key's first row on, the rows so
    reached are collected by doubling the hops, in as many rounds as the number of
    blocks has binary digits; then every block keeps its own chain. ``order`` starts
    with the time, a whole number, and ``block`` depends on that alone; rows without key or time are left out.

    One group holds the same block of many keys, as most keys have few rows in it and a group of their own
    would cost more than the rows; the number of groups follows from that of rows and blocks.
    """
    key, order = list(key), list(order)
    spot, time, step = [*key, "blk_id"], order[0], max(0, math.ceil(interval))
    rows = df.select(*key, *order, block.alias("blk_id"))
    for c in [*key, time]:
        rows = rows.filter(F.col(c).isNotNull())
    rows = durable(rows)
    parts = F.lit(SHARES * tasks_for(rows))
    group = ["blk_id", F.pmod(F.xxhash64(*key), parts).alias("share")]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    ddl = lambda *names: ", ".join(f"`{c}` {kinds[c]}" for c in names)

    def leave(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in [*key, time]])
        t, starts = table.column(time).to_numpy().astype(np.int64), _starts(table, key)
        ends, hop = _ends(starts, len(t)), _hops(t, starts, step)
        at = np.arange(len(t))
        head = np.repeat(starts, np.diff(np.append(starts, len(t))))
        # the rows up to the first one interval after the first of the key, every time once
        few = at[(at <= hop[head]) & ((at == head) | (t != t[at - 1]))]
        to = np.where(hop < ends, hop, at)
        while not np.array_equal(to, to[to]):
            to = to[to]
        out = table.select(key).take(pa.array(few))
        return out.append_column("at", pa.array(t[few])).append_column("after", pa.array(t[to[few]] + step))

    def land(leaving: pa.Table, table: pa.Table) -> pa.Table:
        marks = leaving.select([*spot, time, "at"]).append_column("row", pa.array(np.zeros(len(leaving), np.int8)))
        rows_here = table.select([*spot, time]).append_column("at", pa.nulls(len(table), pa.int64())).append_column(
            "row", pa.array(np.ones(len(table), np.int8)))
        line = pa.concat_tables([marks, rows_here.cast(marks.schema)]).sort_by([(c, "ascending") for c in [*key, time, "row"]])
        t, row = line.column(time).to_numpy(), line.column("row").to_numpy() == 1
        n = len(t)
        following = np.minimum.accumulate(np.where(row, np.arange(n), n)[::-1])[::-1]
        asked = np.flatnonzero(~row)
        to = following[asked]
        known = to < _ends(_starts(line, key), n)[asked]
        next_one = np.zeros(len(asked), np.int64)
        next_one[known] = t[to[known]]
        return line.select([*spot, "at"]).take(pa.array(asked)).append_column("to", pa.array(next_one, mask=~known))

    def keep(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in [*key, *order]])
        t, entry, starts = table.column(time).to_numpy().astype(np.int64), table.column("entry").to_numpy(), _starts(table, key)
        ends, hop = _ends(starts, len(t)), _hops(t, starts, max(1, step))
        # the first row of every key that is not before the entry, and on from there in all keys at once
        at = np.flatnonzero((t >= entry) & np.append(True, (t[:-1] < entry[:-1]) | (ends[1:] != ends[:-1])))
        chosen = [at]
        while len(at):
            at = hop[at][hop[at] < ends[at]]
            chosen.append(at)
        return table.select([*key, *order]).take(pa.array(np.sort(np.concatenate(chosen))))

    leaving = rows.select(*spot, time).groupBy(*group).applyInArrow(leave, f"{ddl(*key)}, at long, after long")
    leaving = leaving.select(*key, "at", F.col("after").alias(time)).select(*key, "at", time, block.alias("blk_id"))
    times = rows.select(*spot, time).groupBy(*group)
    landed = durable(leaving.groupBy(*group).cogroup(times).applyInArrow(land, f"{ddl(*spot)}, at long, to long"))
    # where that block has no such row, the first one of the next block that has rows
    first = rows.groupBy(*spot).agg(F.min(time).alias("low"))
    seen = first.unionByName(landed.filter("to IS NULL").select(*spot, F.lit(None).cast("long").alias("low"))).groupBy(*spot).agg(F.min("low").alias("low"))
    beyond = W.partitionBy(*key).orderBy(F.desc("blk_id")).rowsBetween(W.unboundedPreceding, -1)
    later = seen.select(*spot, F.last("low", ignorenulls=True).over(beyond).alias("later"))
    hops = landed.join(later, spot, "left").select(*key, "at", F.coalesce("to", "later").alias("to")).filter("to IS NOT NULL")
    reached, hops = durable(rows.groupBy(*key).agg(F.min(time).alias("at"))), durable(hops)
    while not hops.isEmpty():
        reached = durable(reached.unionByName(reached.join(hops, [*key, "at"]).select(*key, F.col("to").alias("at"))))
        ahead = hops.select(*key, F.col("at").alias("to"), F.col("to").alias("far"))
        hops = durable(hops.join(ahead, [*key, "to"]).select(*key, "at", F.col("far").alias("to")))
    entries = reached.select(*key, F.col("at").alias(time)).select(*key, block.alias("blk_id"), F.col(time).alias("entry"))
    return rows.join(entries, spot).groupBy(*group).applyInArrow(keep, ddl(*key, *order))
