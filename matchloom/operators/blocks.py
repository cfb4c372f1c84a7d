"""Sequential kernels run block-parallel until their block states agree.

A kernel is a small state machine (``fresh``/``step``/``close``, and ``packed``
where equal states do not look equal as they are).  Every block of
a key's timeline runs at once from a guessed entry state; the exit state of a
block is the true entry state of the next.  Blocks whose guess was wrong run
again, nothing else does.  Every round settles at least one more block per key,
so the result is always that of the sequential run; kernels forget their past
quickly, so two or three rounds are usual.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections import namedtuple
from collections.abc import Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema


ROWS_PER_TASK = 100_000


def durable_folder(spark) -> str:
    """The shared checkpoint folder of the session; on one machine a temporary one where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Materialise on the shared checkpoint folder so lost executors cost no replay."""
    durable_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def passing_shuffles(spark):
    """Shuffles of what is run meanwhile go once it is done."""
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean)
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        spark.conf.set(clean, before)


def written(df: DataFrame) -> DataFrame:
    """Like ``durable``, as Parquet: smaller on the folder, and the shuffles that it took go once it is written."""
    spark = df.sparkSession
    path = f"{durable_folder(spark)}/rows-{uuid.uuid4().hex}"
    with passing_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _walker(kernel, columns: list[str], key: list[str], fields: list[str], arrow: pa.Schema):
    """Stream over sorted rows; each block is preceded by its header row.

    Nothing but the kernel state and one output batch is held, so a block may be
    larger than memory.
    """
    def run(batches):
        Row = namedtuple("Row", columns)
        state = close = used = last = None
        prefix: list = []
        out: list[tuple] = []

        def finish():
            if state is None:
                return
            exit_state = json.dumps(getattr(kernel, "packed", dict)(state), sort_keys=True)
            if close:
                out.extend((*prefix, *r, None, None) for r in kernel.close(state, last))
            out.append((*prefix, *([None] * len(fields)), exit_state, used))

        def flush():
            cols = list(zip(*out)) if out else [[] for _ in arrow]
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)
            out.clear()
            return batch

        for batch in batches:
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                row = Row(*values)
                if row.blk_row == 0:
                    finish()
                    used, close = row.blk_entry or "", row.blk_last
                    state = json.loads(used) if used else kernel.fresh()
                    prefix = [getattr(row, c) for c in [*key, "blk_id"]]
                else:
                    out.extend((*prefix, *r, None, None) for r in kernel.step(state, row))
                    last = getattr(row, "seq", None), getattr(row, "t", None)
            if len(out) > 20_000:
                yield flush()
        finish()
        yield flush()
    return run


def tasks_for(rows: DataFrame) -> int:
    """Small inputs do not need every shuffle partition; large ones get them all."""
    spark = rows.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK)))


def run_blocks(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    block: Column,
    kernel,
    resets: str | None = None,
) -> DataFrame:
    """Run ``kernel`` over every key; returns ``key`` + ``kernel.schema`` columns.

    ``resets`` names a boolean column: at such a row nothing before it matters any
    more, so a block that begins there starts from the fresh state, whatever came before.
    """
    key, order, spot = list(key), list(order), [*key, "blk_id"]
    rows = df.withColumn("blk_id", block)
    fresh = F.lit(False)
    if resets:
        rows, fresh = rows.withColumnRenamed(resets, "blk_reset"), F.min_by("blk_reset", F.struct(*order))
    rows = durable(rows)
    starts = rows.groupBy(*spot).agg(fresh.alias("blk_fresh"))
    starts = durable(starts) if resets else starts
    rows = rows.drop("blk_reset")
    tasks = tasks_for(rows)
    out_type = T.StructType.fromDDL(kernel.schema)
    fields = out_type.fieldNames()
    schema = T.StructType(
        [rows.schema[c] for c in spot] + list(out_type)
        + [T.StructField("blk_exit", T.StringType()), T.StructField("blk_used", T.StringType())])
    walk = _walker(kernel, [*rows.columns, "blk_row", "blk_entry", "blk_last"], key, fields, to_arrow_schema(schema))
    ws = W.partitionBy(*key).orderBy("blk_id")
    entry = rows.select(*spot).distinct().select(
        *spot, F.lit("").alias("blk_entry"), F.lead("blk_id").over(ws).isNull().alias("blk_last"))
    passes: list[DataFrame] = []
    current: DataFrame | None = None
    while True:
        todo = rows if not passes else rows.join(entry.select(*spot), spot, "left_semi")
        lines = todo.withColumn("blk_row", F.lit(1)).unionByName(
            entry.withColumn("blk_row", F.lit(0)), allowMissingColumns=True)
        lines = lines.select(*rows.columns, "blk_row", "blk_entry", "blk_last").repartition(tasks, *spot)
        done = lines.sortWithinPartitions(*spot, "blk_row", *order).mapInArrow(walk, schema)
        done = durable(done.withColumn("blk_pass", F.lit(len(passes))))
        passes.append(done)
        exits = done.filter(F.col("blk_exit").isNotNull()).select(*spot, "blk_exit", "blk_used", "blk_pass")
        if current is not None:
            exits = current.join(exits.select(*spot), spot, "left_anti").unionByName(exits)
        current = exits
        entry = (current.join(starts, spot) if resets else current.withColumn("blk_fresh", F.lit(False))).select(
            *spot, "blk_used", F.when(F.col("blk_fresh"), "").otherwise(F.coalesce(F.lag("blk_exit").over(ws), F.lit(""))).alias("blk_entry"),
            F.lead("blk_id").over(ws).isNull().alias("blk_last"))
        entry = durable(entry.filter(F.col("blk_entry") != F.col("blk_used")).select(*spot, "blk_entry", "blk_last"))
        if entry.isEmpty():
            break
    result = passes[0]
    for p in passes[1:]:
        result = result.unionByName(p)
    if len(passes) > 1:
        result = result.join(current.select(*spot, "blk_pass"), [*spot, "blk_pass"], "left_semi")
    return result.filter(F.col("blk_exit").isNull()).select(*key, *fields)


def run_from(rows: DataFrame, key: Sequence[str], order: Sequence[str], kernel, entry: DataFrame) -> DataFrame:
    """One pass of ``kernel`` over rows with a ``blk_id``, every block from its known entry state (key, blk_id, blk_entry)."""
    key, order, spot = list(key), list(order), [*key, "blk_id"]
    out_type = T.StructType.fromDDL(kernel.schema)
    fields = out_type.fieldNames()
    schema = T.StructType(
        [rows.schema[c] for c in spot] + list(out_type)
        + [T.StructField("blk_exit", T.StringType()), T.StructField("blk_used", T.StringType())])
    walk = _walker(kernel, [*rows.columns, "blk_row", "blk_entry", "blk_last"], key, fields, to_arrow_schema(schema))
    heads = entry.select(*spot, "blk_entry", F.lead("blk_id").over(W.partitionBy(*key).orderBy("blk_id")).isNull().alias("blk_last"))
    lines = rows.withColumn("blk_row", F.lit(1)).unionByName(heads.withColumn("blk_row", F.lit(0)), allowMissingColumns=True)
    lines = lines.select(*rows.columns, "blk_row", "blk_entry", "blk_last").repartition(tasks_for(rows), *spot)
    done = lines.sortWithinPartitions(*spot, "blk_row", *order).mapInArrow(walk, schema)
    return done.filter(F.col("blk_exit").isNull()).select(*key, *fields)
