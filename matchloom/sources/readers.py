"""Document, signal-fixture and evaluation-suite sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from matchloom.functions import text as tx

ACCEPTED = (".md", ".txt")


@F.pandas_udf(T.StringType())
def _decode_legacy(data: pd.Series) -> pd.Series:
    def decode(raw):
        try:
            return raw.decode("gb18030")
        except UnicodeDecodeError:
            return raw.decode("utf-8", errors="replace")
    return data.map(decode)


def decode_bytes(df: DataFrame, data: str, out: str = "content") -> DataFrame:
    """UTF-8 (with or without a mark) in the JVM; only other rows go through Python."""
    valid = F.is_valid_utf8(F.col(data).cast("string"))
    good = df.filter(valid).withColumn(out, F.regexp_replace(F.col(data).cast("string"), "^﻿", ""))
    other = df.filter(~valid).withColumn(out, _decode_legacy(F.col(data)))
    return good.unionByName(other)


def load_documents(spark: SparkSession, folder: str, language: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Text documents of a folder and the rejected files with their reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).withColumn(
        "suffix", F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)))
    text = decode_bytes(files.filter(F.col("suffix").isin(*ACCEPTED)), "content", "text").withColumn("text", tx.strip(F.col("text")))
    wrong = files.filter(~F.col("suffix").isin(*ACCEPTED)).select("name", F.lit("unsupported_suffix").alias("reason"))
    empty = text.filter("text = ''").select("name", F.lit("empty").alias("reason"))
    title = tx.title_of(F.col("text"), F.regexp_replace("name", r"\.[^.]+$", ""))
    docs = text.filter("text <> ''").withColumn("title", title).select(
        tx.stable_id(F.col("title"), F.col("text")).alias("document_id"), "title",
        F.concat(F.lit("local://"), "name").alias("source_uri"), F.col("text").alias("content"), F.lit(language).cast("string").alias("language"),
        F.create_map(F.lit("source_name"), F.col("name")).alias("metadata"))
    return docs, wrong.unionByName(empty)


SIGNALS = """rounds ARRAY<STRUCT<round_id: STRING, kills: INT, died: BOOLEAN>>,
 sampling_profiles MAP<STRING, STRUCT<sample_step_sec: DOUBLE, sparse_strong_rounds: ARRAY<STRING>>>,
 outline_artifacts ARRAY<STRUCT<round_id: STRING, offset_sec: DOUBLE, score: DOUBLE>>,
 expected STRUCT<rounds: INT, kills: INT, deaths: INT, open_final_round: STRING>"""


def read_signal_matches(spark: SparkSession, path: str) -> DataFrame:
    """Nested signal documents, one row per recording named after its file."""
    docs = spark.read.schema(SIGNALS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return docs.withColumn("video_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def signal_rounds(docs: DataFrame) -> DataFrame:
    """Rounds in listed order."""
    return docs.select("video_id", F.posexplode("rounds").alias("pos", "r")).select("video_id", (F.col("pos") + 1).cast("long").alias("rid"), "r.*")


SUITE = """schema_version STRING, name STRING, description STRING, cases ARRAY<STRUCT<case_id: STRING, description: STRING, tags: ARRAY<STRING>,
 scenario: MAP<STRING, STRING>, script: ARRAY<STRUCT<kind: STRING, response: STRING, variant: STRING>>,
 expectation: STRUCT<expected_mode: STRING, expected_fallback_reason: STRING, expected_stop_reason: STRING, required_tools: ARRAY<STRING>,
  allowed_tools: ARRAY<STRING>, min_tool_calls: INT, max_tool_calls: INT, expected_tool_failures: INT, expected_invalid_arguments: INT,
  min_accepted_enrichments: INT, min_rejected_enrichments: INT, require_agent_citations: BOOLEAN, expect_llm_called: BOOLEAN,
  expected_output_language: STRING, forbidden_output_patterns: ARRAY<STRING>>>>"""


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases, one row each.

    Malformed documents fail, unknown fields fail, and a repeated ``case_id`` or an
    unknown version fails when the rows are read.
    """
    known = T.StructType.fromDDL(SUITE)
    spark_docs = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    extra = set(spark_docs.json(path).columns) - set(known.fieldNames())
    if extra:
        raise ValueError(f"unknown suite fields: {sorted(extra)}")
    found = spark_docs.json(path).select(F.explode("cases").alias("c")).select("c.*")
    inner = known["cases"].dataType.elementType
    unknown = set(found.columns) - set(inner.fieldNames())
    if "expectation" in found.columns:
        unknown |= set(found.select("expectation.*").columns) - set(inner["expectation"].dataType.fieldNames())
    if unknown:
        raise ValueError(f"unknown case fields: {sorted(unknown)}")
    docs = spark_docs.schema(known).json(path)
    docs = docs.filter(F.assert_true(F.coalesce("schema_version", F.lit("1.0")) == "1.0", "unknown schema_version").isNull())
    cases = docs.select(F.col("name").alias("suite"), F.explode("cases").alias("c")).select("suite", "c.*")
    counts = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
    unique = counts.filter(F.assert_true(F.col("_n") == 1, F.concat(F.lit("duplicate case_id "), "case_id")).isNull())
    return cases.join(unique.select("case_id"), "case_id", "left_semi")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Recording catalogue with its duration."""
    from matchloom.operators.quality import with_duration
    return with_duration(spark.read.parquet(path))


