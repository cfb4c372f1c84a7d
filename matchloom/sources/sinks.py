"""Document sinks: timelines, match reports, corrections, index and markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from matchloom.operators.blocks import passing_shuffles, written
from matchloom.operators.knowledge import upsert


def round_documents(rounds: DataFrame, events: DataFrame) -> DataFrame:
    """One nested row per round with its ordered events.

    A round bounds the nested array; a recording is a folder of round rows, so a
    hot recording stays splittable.
    """
    item = F.struct("t", "seq", "event_id", "type", "confidence", "source")
    nested = events.groupBy("video_id", "rid").agg(F.sort_array(F.collect_list(item)).alias("events"))
    return rounds.join(nested, ["video_id", "rid"], "left")


def write_timeline(rounds: DataFrame, events: DataFrame, path: str, version: str = "2.0") -> None:
    """Nested JSON, one folder per recording."""
    docs = round_documents(rounds, events).withColumn("schema_version", F.lit(version))
    docs.write.mode("overwrite").partitionBy("video_id").json(path)


def write_match_report(overview: DataFrame, findings: DataFrame, path: str, generated_at: Column | None = None) -> None:
    """Overview and findings as two JSON tables stamped with the generation time."""
    stamp = generated_at if generated_at is not None else F.current_timestamp()
    overview.withColumn("generated_at", stamp).write.mode("overwrite").json(f"{path}/overview")
    findings.withColumn("generated_at", stamp).write.mode("overwrite").json(f"{path}/findings")


def write_corrections(rows: DataFrame, path: str) -> None:
    """Correction labels, schema 1.0, one row per correctable event."""
    rows.withColumn("schema_version", F.lit("1.0")).withColumn("exported_at", F.current_timestamp()).write.mode("overwrite").json(path)


#: Buckets of the chunk index; an upsert rewrites those that it touches.
BUCKETS = 64
#: Buckets that are merged at once, so that the shuffle and the new files beside the old ones are of a part of the index.
AT_ONCE = 16


def write_index(chunks: DataFrame, path: str, reset: bool = False, writer: str | None = None, batch: int | None = None) -> None:
    """Upsert chunks by chunk_id; of several in one call the one of largest chunk_index counts.

    The index is partitioned by the bucket of a chunk's id. Only buckets that the
    chunks fall into are read and replaced, each by dynamic partition overwrite, so the
    files of all others stay. A ``writer`` numbers its batches: a row that it has
    already written in this or a later batch is left alone, so a repeated batch
    changes nothing, and one that was broken off is completed. ``reset`` replaces the whole index.
    """
    bucket = F.pmod(F.xxhash64("chunk_id"), F.lit(BUCKETS)).cast("int")
    rows = chunks.withColumn("bucket", bucket).withColumn("writer", F.lit(writer).cast("string")).withColumn("batch", F.lit(batch).cast("long"))
    old = None if reset else _index(chunks.sparkSession, path)
    if old is None:
        _put(upsert(None, rows, "chunk_id", F.col("chunk_index"), within="bucket"), path, "static")
        return
    rows = written(rows)

    def fresh(here: Column) -> DataFrame:
        if writer is None:
            return rows.filter(here)
        done = old.filter(here).filter((F.col("writer") == writer) & (F.col("batch") >= batch)).select("bucket", "chunk_id")
        return rows.filter(here).join(done, ["bucket", "chunk_id"], "left_anti")

    buckets = lambda df: sorted(r.bucket for r in df.select("bucket").distinct().collect())  # noqa: E731  # at most BUCKETS numbers
    touched = buckets(rows)
    if writer is not None:
        touched = buckets(fresh(F.col("bucket").isin(touched)))
    for k in range(0, len(touched), AT_ONCE):
        here = F.col("bucket").isin(touched[k:k + AT_ONCE])
        _put(upsert(old.filter(here), fresh(here), "chunk_id", F.col("chunk_index"), within="bucket"), path, "dynamic")


def _put(merged: DataFrame, path: str, mode: str) -> None:
    """Replace buckets; a dynamic overwrite has read the old files of one before it replaces them."""
    with passing_shuffles(merged.sparkSession):
        merged.write.mode("overwrite").option("partitionOverwriteMode", mode).option("compression", "zstd").partitionBy("bucket").parquet(path)


def _index(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_index(spark, path: str) -> DataFrame:
    """The chunks of an index."""
    return spark.read.option("mergeSchema", True).parquet(path).drop("bucket", "writer", "batch")


def markdown_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A markdown table line per row."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))


def write_markdown(df: DataFrame, columns: Sequence[str], path: str) -> None:
    markdown_rows(df, columns).select("line").write.mode("overwrite").text(path)
