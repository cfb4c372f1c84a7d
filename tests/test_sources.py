import json

import pytest
from pyspark.sql import functions as F

from matchloom.functions.tables import register
from matchloom.sources import readers, sinks


def test_text_documents_and_rejects(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("﻿# Títle\n\nbody".encode("utf-8"))
    (tmp_path / "b.txt").write_bytes("经济数字".encode("gb18030"))
    (tmp_path / "c.txt").write_bytes(b"  \n ")
    (tmp_path / "d.pdf").write_bytes(b"x")
    docs, rejects = readers.load_documents(spark, str(tmp_path))
    got = {r.source_uri: (r.title, r.content) for r in docs.collect()}
    assert got == {"local://a.md": ("Títle", "# Títle\n\nbody"), "local://b.txt": ("经济数字", "经济数字")}
    assert {(r.name, r.reason) for r in rejects.collect()} == {("c.txt", "empty"), ("d.pdf", "unsupported_suffix")}


def suite(tmp_path, *ids, **extra):
    cases = [{"case_id": i, "description": "case", "tags": [], "expectation": {"expected_mode": "rules"}} for i in ids]
    path = tmp_path / "suite.json"
    path.write_text(json.dumps({"schema_version": "1.0", "name": "s", "cases": cases, **extra}))
    return str(path)


def test_suite_reads_unique_cases(spark, tmp_path):
    assert {r.case_id for r in readers.read_suite(spark, suite(tmp_path, "one", "two")).collect()} == {"one", "two"}


def test_suite_rejects_duplicates_and_unknown_fields(spark, tmp_path):
    with pytest.raises(Exception, match="duplicate case_id"):
        readers.read_suite(spark, suite(tmp_path, "one", "one")).collect()
    with pytest.raises(ValueError, match="unknown suite fields"):
        readers.read_suite(spark, suite(tmp_path, "one", surprise=1))


def test_json_and_markdown_sinks(spark, tmp_path):
    rounds = spark.createDataFrame([(1, 1, 0, 9)], "video_id int, rid int, s int, e int")
    events = spark.createDataFrame([(1, 1, 5, 2, "b", "player_kill", .5, "x"), (1, 1, 0, 1, "a", "round_start", .9, "x")],
                                   "video_id int, rid int, t int, seq int, event_id string, type string, confidence double, source string")
    sinks.write_timeline(rounds, events, str(tmp_path / "tl"))
    doc = spark.read.json(str(tmp_path / "tl")).first()
    assert [e.event_id for e in doc.events] == ["a", "b"] and doc.video_id == 1 and doc.schema_version == "2.0"
    sinks.write_match_report(rounds, rounds, str(tmp_path / "rep"), F.lit("now"))
    assert spark.read.json(str(tmp_path / "rep/overview")).first().generated_at == "now"
    sinks.write_corrections(events, str(tmp_path / "co"))
    assert spark.read.json(str(tmp_path / "co")).filter("schema_version = '1.0'").count() == 2
    sinks.write_markdown(rounds, ["rid", "e"], str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).first().value == "| 1 | 9 |"


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([("# T\n\nsome body text that is long enough to be its own chunk",)], "content string").createOrReplaceTempView("kdocs")
    rows = spark.sql("SELECT c.* FROM kdocs, LATERAL chunk_text(content, '\n\n') c").collect()
    assert [(r.chunk_index, r.heading) for r in rows] == [(0, "T")]
    assert max(spark.sql("SELECT label_ratios('catwlk') AS r").first().r) > .9
