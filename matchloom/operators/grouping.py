"""Groups of near values: a value joins the open group while it is near the mean of it.

Equal values enter together, so they are counted first. The distinct values of a key
are sorted over range partitions, which follow their number and not their spread, and
cut into pieces. Which group is open at the end of a piece follows from the value at
which the first new group of the piece starts: two running ends give the next start
of every start, as the mean of a later start is never lower. So a piece is passed in
one step, however its groups fall, and a step above the tolerance ends every group
without a guess.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from matchloom.operators.blocks import durable

#: Distinct values in a piece.
PIECE = 65_536


def next_starts(values: np.ndarray, counts: np.ndarray, tolerance: float) -> np.ndarray:
    """For each value as the first of a group: the first later value that does not join (their number, if all do)."""
    n = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0.0], np.cumsum(values * counts)])
    out, end, v = np.empty(len(values), np.int64), 0, values.tolist()
    n, total = n.tolist(), total.tolist()
    for i in range(len(v)):
        end = max(end, i + 1)
        while end < len(v) and abs(v[end] - (total[end] - total[i]) / (n[end] - n[i])) <= tolerance:
            end += 1
        out[i] = end
    return out


def joining(values: np.ndarray, counts: np.ndarray, total: float, n: int, tolerance: float) -> int:
    """How many of the values join an open group of n values with this total."""
    sums = total + np.concatenate([[0.0], np.cumsum(values * counts)[:-1]])
    sizes = n + np.concatenate([[0], np.cumsum(counts)[:-1]])
    off = np.flatnonzero(np.abs(values - sums / sizes) > tolerance)
    return int(off[0]) if len(off) else len(values)


def _pieces(key: list[str], value: str, tolerance: float, piece: int, arrow: pa.Schema):
    def run(batches):
        part, at, held, no = TaskContext.get().partitionId(), None, [], 0

        def record():
            values, counts = np.array([r[0] for r in held], float), np.array([r[1] for r in held], np.int64)
            following = next_starts(values, counts, tolerance)
            final = np.arange(len(values))
            for i in range(len(values) - 1, -1, -1):
                if following[i] < len(values):
                    final[i] = final[following[i]]
            row = (*at, part, no, values, counts, following, final)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in [*key, value, "count"]]
            for *k, v, n in zip(*columns):
                if k != at or len(held) >= piece:
                    if held:
                        yield record()
                    at, held, no = k, [], no + 1
                held.append((v, n))
        if held:
            yield record()
    return run


def _entries(key: list[str], tolerance: float, arrow: pa.Schema):
    """Pieces of a key in order to the group that is open where each begins: first value, total, number of values."""
    def run(batches):
        at, state = None, None
        for batch in batches:
            out = []
            for i in range(len(batch)):
                k = [batch.column(c)[i].as_py() for c in [*key]]
                values, counts, final = (batch.column(c)[i].values.to_numpy() for c in ("vals", "counts", "final"))
                if k != at:
                    at, state = k, None
                out.append((*k, batch.column("part")[i].as_py(), batch.column("no")[i].as_py(), *(state or (None, None, None))))
                j = joining(values, counts, state[1], state[2], tolerance) if state else 0
                if j == len(values):
                    state = state[0], state[1] + float((values * counts).sum()), state[2] + int(counts.sum())
                else:
                    s = final[j]
                    state = float(values[s]), float((values[s:] * counts[s:]).sum()), int(counts[s:].sum())
            columns = zip(*out) if out else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return run


def _grouped(key: list[str], value: str, tolerance: float, arrow: pa.Schema):
    """Pieces with their entry to every distinct value and the first value of its group."""
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                values, counts, following = (batch.column(c)[i].values.to_numpy() for c in ("vals", "counts", "following"))
                first, total, n = (batch.column(c)[i].as_py() for c in ("first", "total", "n"))
                start = np.empty(len(values))
                j = joining(values, counts, total, n, tolerance) if n else 0
                start[:j] = first if n else 0
                while j < len(values):
                    start[j:following[j]] = values[j]
                    j = following[j]
                heads = [pa.array([batch.column(c)[i].as_py()] * len(values), f.type) for c, f in zip(key, arrow)]
                yield pa.RecordBatch.from_arrays([*heads, pa.array(values), pa.array(start)], schema=arrow)
    return run


def running_mean_groups(df: DataFrame, key: list[str], value: str, tolerance: float, piece: int = PIECE) -> DataFrame:
    """Adds ``group_start``, the first value of the group that a row's value belongs to.

    Values are taken in ascending order; one joins the open group if it is within the
    tolerance of its mean so far, else it opens a group. A null value has no group.
    """
    kinds = [df.schema[c] for c in key]
    counted = df.filter(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias(value)).groupBy(*key, value).count()
    lines = counted.repartitionByRange(*key, value).sortWithinPartitions(*key, value)
    doubles, longs = T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType())
    places = [T.StructField("part", T.IntegerType()), T.StructField("no", T.LongType())]
    schema = T.StructType(kinds + places + [T.StructField("vals", doubles)] + [T.StructField(c, longs) for c in ("counts", "following", "final")])
    found = durable(lines.mapInArrow(_pieces(key, value, tolerance, piece, to_arrow_schema(schema)), schema))
    entry = T.StructType(kinds + places + [T.StructField("first", T.DoubleType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])
    chain = found.select(*key, "part", "no", "vals", "counts", "final").repartition(*key).sortWithinPartitions(*key, "part", "no")
    entries = chain.mapInArrow(_entries(key, tolerance, to_arrow_schema(entry)), entry)
    out = T.StructType(kinds + [T.StructField(value, T.DoubleType()), T.StructField("group_start", T.DoubleType())])
    groups = found.join(entries, [*key, "part", "no"]).mapInArrow(_grouped(key, value, tolerance, to_arrow_schema(out)), out)
    return df.join(groups, [*key, value], "left")
