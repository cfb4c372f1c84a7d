import random
from functools import partial
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.operators import context as cx
from matchloom.operators import knowledge as kn
from matchloom.operators.guard import outcome_bias, unsupported_numbers
from matchloom.sources import sinks

MANUAL = ("4. How a round ends\n\nThe side that clears the site first takes the round.\n\n37.2 Prices of the season\n\nversion_sensitive: true\n"
          "last_verified: 2026-03-14\nA helmet costs 350 this season.\n\n79. Last one standing against three\n\n"
          "Leaving with the equipment may be worth more than a fight that is nearly lost.")


def test_numbered_sections_split_and_layer(spark):
    docs = spark.createDataFrame([("m", MANUAL)], "document_id string, content string")
    chunks = kn.chunk_documents(docs, size=400).withColumn("inferred", kn.infer_layer(F.col("heading"), F.col("content")))
    meta = kn.inline_metadata(docs, "document_id", "content")
    assert {(r.key, r.value) for r in meta.collect()} >= {("version_sensitive", "true"), ("last_verified", "2026-03-14")}
    none = F.lit(None).cast("string")
    rows = kn.annotate(chunks, F.col("inferred"), none, none, none).orderBy("chunk_index").collect()
    assert [r.layer for r in rows] == [kn.RULES, kn.DYNAMIC, kn.SITUATIONS]
    assert [r.rule_strength for r in rows] == ["hard_rule", "hard_rule", "contextual_recommendation"]
    assert [r.version_sensitive for r in rows] == [False, True, False]


def test_long_text_overlaps_and_keeps_its_heading():
    got = kn.passages("# Angles\n\n" + "Stand where one door is in view. " * 70, "\n\n", 260, 40, 40)
    assert len(got) > 1 and {g[1] for g in got} == {"Angles"}
    assert all(len(g[2]) <= 260 for g in got) and all(g[2].endswith(".") for g in got[:-1])


def test_spans_match_a_character_scan():
    rnd = random.Random(5)
    for _ in range(40):
        text = "".join(rnd.choice(["a", "b", " ", ". ", "\n", "。", "word "]) for _ in range(rnd.randrange(5, 400)))
        want, at = [], 0
        while True:
            stop = min(len(text), at + 50)
            if stop < len(text):
                breaks = [i for i in range(at, stop) if text[i] in "。\n" or (text[i:i + 2] == ". " and i + 2 <= stop)]
                if breaks and breaks[-1] > at + 25:
                    stop = breaks[-1] + 1
            want.append(text[at:stop].strip())
            if stop >= len(text):
                break
            at = max(at + 1, stop - 12)
        assert [w for w in kn.windows(text, 50, 12) if w] == [w for w in want if w]


def test_short_tail_merges_and_leaves_an_index_gap():
    body = "word " * 60
    got = kn.passages(f"{body}\n\n{body}\n\ntail\n\n# Next\n\nmore text that is long enough to stand alone here", "\n\n", 301, 40, 40)
    assert [g[0] for g in got] == [0, 1, 3]
    assert "tail" in got[-2][2]


def test_topk_over_many_blocks_equals_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(90, 8)).astype(np.float32)
    rows = [(i, f"l{i % 3}", m[i].tolist()) for i in range(90)]
    c = spark.createDataFrame(rows, "chunk_id long, layer string, vector array<float>")
    q = c.filter("chunk_id < 7").select(F.col("chunk_id").alias("query_id"), "vector")
    got = {}
    for r in kn.topk(kn.layer_topk(q, c, 4, block=20), 4).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.chunk_id
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    for i in range(7):
        assert [got[i][k] for k in (1, 2, 3, 4)] == np.argsort(-(u @ u[i]), kind="stable")[:4].tolist()


def test_filters_follow_the_rank_cut(spark):
    hits = spark.createDataFrame([(1, "tactical_fundamentals", f"c{i}", .9 - i / 10, i + 1, i != 0) for i in range(5)],
                                 "query_id int, layer string, chunk_id string, score double, rank int, usable boolean")
    routes = spark.createDataFrame([(1, ["tactical_fundamentals", "game_rules"])], "query_id int, layers array<string>")
    got = [r.chunk_id for r in kn.retrieve_for_decision(hits, routes, limit=2).orderBy("position").collect()]
    assert got == ["c1", "c2"]


def test_index_versions_replace_by_id(spark, tmp_path):
    path = str(tmp_path / "index")
    first = spark.createDataFrame([("a", 0, "x", "game_rules"), ("b", 1, "y", "game_rules")], "chunk_id string, chunk_index int, content string, layer string")
    sinks.write_index(first, path)
    second = spark.createDataFrame([("b", 1, "new", "tactical_fundamentals"), ("c", 0, "z", "game_rules")], first.schema)
    sinks.write_index(second, path)
    got = {r.chunk_id: (r.content, r.layer) for r in sinks.read_index(spark, path).collect()}
    assert got == {"a": ("x", "game_rules"), "b": ("new", "tactical_fundamentals"), "c": ("z", "game_rules")}
    sinks.write_index(second, path, reset=True)
    assert sinks.read_index(spark, path).count() == 2


def index_files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    path = tmp_path / "index"
    schema = "chunk_id string, chunk_index int, content string, layer string"
    sinks.write_index(spark.createDataFrame([(f"c{k}", k, "x", "game_rules") for k in range(200)], schema), str(path))
    before = index_files(path)
    sinks.write_index(spark.createDataFrame([("c7", 7, "new", "tactical_fundamentals"), ("c7", 3, "old", "game_rules")], schema), str(path))
    after = index_files(path)
    changed = {f.split("/")[0] for f in before.keys() ^ after.keys()} | {f.split("/")[0] for f in before.keys() & after.keys() if before[f] != after[f]}
    assert len(changed) == 1 and len({f.split("/")[0] for f in before}) > 30
    got = {r.chunk_id: (r.content, r.layer) for r in sinks.read_index(spark, str(path)).collect()}
    assert len(got) == 200 and got["c7"] == ("new", "tactical_fundamentals")


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = tmp_path / "index"
    schema = "chunk_id string, chunk_index int, content string, layer string"
    one = spark.createDataFrame([("a", 0, "first", "game_rules"), ("b", 0, "first", "game_rules")], schema)
    two = spark.createDataFrame([("b", 0, "second", "game_rules")], schema)
    sinks.write_index(one, str(path), writer="w", batch=0)
    sinks.write_index(two, str(path), writer="w", batch=1)
    before = index_files(path)
    for rows, batch in ((two, 1), (one, 0)):
        sinks.write_index(rows, str(path), writer="w", batch=batch)
    assert index_files(path) == before
    assert {r.chunk_id: r.content for r in sinks.read_index(spark, str(path)).collect()} == {"a": "first", "b": "second"}
    sinks.write_index(one, str(path), writer="other", batch=0)
    assert {r.content for r in sinks.read_index(spark, str(path)).collect()} == {"first"}


def test_metadata_comes_before_lines_of_the_chunk(spark):
    content = "Text\nlast_verified: 2024-01-02\nlast_verified： 2024-03-04 \nexceptions: a; b；;c\nexpires_at: 2030-01-01"
    docs = [("1", content, {"expires_at": "2029-09-09", "source_urls": "http://x", "last_verified": ""}),
            ("2", "plain", {"exceptions": " one ；two", "effective_from": "2020-01-01"}), ("3", "plain", None)]
    df = spark.createDataFrame(docs, "document_id string, content string, metadata map<string,string>")
    got = {r.document_id: (r.last_verified, r.effective_from, r.expires_at, r.source_urls, r.exceptions) for r in kn.fan_out(df, F.col("metadata"), F.col("content")).collect()}
    assert got == {"1": ("2024-03-04", None, "2029-09-09", ["http://x"], ["a", "b", "c"]), "2": (None, "2020-01-01", None, [], ["one", "two"]), "3": (None, None, None, [], [])}


def test_index_rows_of_structured_documents(spark):
    docs = [("d", "# 36.1 Prices\n\nThe weapon price is given here for all of them.\n\n# Other\n\nversion_sensitive: yes\n\nKeep calm and hold the site together.", {"knowledge_layer": "game_rules"}),
            ("e", "Only a plain sentence about holding an angle for long.", None)]
    df = spark.createDataFrame(docs, "document_id string, content string, metadata map<string,string>")
    rows = kn.index_rows(df, ("the", "er")).collect()
    assert {(r.document_id, r.layer, r.rule_strength, r.version_sensitive) for r in rows} == {
        ("d", "game_rules", "hard_rule", False), ("d", "dynamic_game_data", "hard_rule", True), ("e", "tactical_fundamentals", "strategic_principle", False)}
    assert len({r.chunk_id for r in rows}) == len(rows) and all(len(r.vector) == 2 for r in rows)


def test_embedder_port_normalises(spark):
    embed = kn.embedder(lambda texts: [[t.count("a"), t.count("b")] for t in texts], 2)
    df = spark.createDataFrame([("aab",), ("",)], "t string").select(embed("t").alias("v"))
    got = [[round(x, 4) for x in r.v] for r in df.collect()]
    assert got == [[.8944, .4472], [0.0, 0.0]]


def test_fuzzy_labels_once_per_text(spark):
    """No condition on the ratios is evaluated below the DISTINCT, for every row."""
    df = spark.range(1000).selectExpr("if(id % 2 = 0, 'catwlk', 'shop') AS raw", "1.0D AS conf")
    out = cx.canonical_positions(df, "raw", "conf")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {(r.label, r.n) for r in out.groupBy("label").agg(F.count("*").alias("n")).collect()} == {("catwalk", 500), ("shop", 500)}


def test_fuzzy_labels_reject_ties(spark):
    df = spark.createDataFrame([("Palace Interor", .9), ("Bombsite", .9), ("xy", .9), ("Bombsite A", .2)], "raw string, conf double")
    got = {r.raw: r.label for r in cx.canonical_positions(df, "raw", "conf").collect()}
    assert got == {"Palace Interor": "palace_interior"}


def test_token_rules(spark):
    def one(fn, value, *more):
        return spark.range(1).select(fn(F.lit(value), *more).alias("v")).first().v
    assert [one(tx.score_value, x) for x in ("71", "00", "13", "31", "x")] == [1, 0, 13, None, None]
    assert [one(tx.money_value, x) for x in ("$2750", "5450", "16050", "$70", "800")] == [2750, None, None, None, 800]
    assert [one(tx.clock_value, x) for x in ("1:52", "1352", "152", "1:75", "6:00", "12")] == [112, 112, 112, None, None, None]
    conf = F.lit(.5)
    assert [one(tx.armour_value, x, conf) for x in ("6100", "650", "7", "")] == [100, 50, 7, None]


def test_gates(spark):
    df = spark.createDataFrame([("kill at 12.5 or v1", "seen 12.5", False), ("kill 13", "seen 12.5", True)], "d string, s string, bad boolean")
    assert df.filter(unsupported_numbers(F.col("d"), F.col("s")) != F.col("bad")).count() == 0
    assert spark.range(1).select(outcome_bias(F.lit("The result proves you were right")).alias("b")).first().b
    day = F.to_date(F.lit("2026-01-01"))
    fresh = tx.is_fresh(F.lit(True), F.lit("2025-06-01"), F.lit("2025-12-31"), F.lit(True), day)
    assert spark.range(1).select(fresh.alias("b")).first().b is False
    parsed = spark.range(1).select(F.try_variant_get(tx.fenced_json(F.lit("```json\n{\"a\": 3}\n```")), "$.a", "int").alias("v"))
    assert parsed.first().v == 3


def test_lines_are_read_only_where_their_name_occurs(spark):
    """The lower-cased words are one step, and a text without the name is not split into lines."""
    texts = ["a\n LAST_Verified ： 2024-01-02 \nlast_verified: 2024-03-04", "last_verified\nx", "plain", None, "Loss Bonus", "İ expires_at: x"]
    df = spark.createDataFrame([(str(i), t, {}) for i, t in enumerate(texts)], "document_id string, content string, metadata map<string,string>")
    got = {r.document_id: (r.last_verified, r.expires_at, r.layer) for r in kn.index_rows(df, ("a",), kn.fixed_chunks).collect()}
    tactics = kn.TACTICS
    assert got == {"0": ("2024-03-04", None, tactics), "1": (None, None, tactics), "2": (None, None, tactics), "3": (None, None, tactics), "4": (None, None, kn.DYNAMIC),
                   "5": (None, None, tactics)}
    value = kn.inline_value(F.col("content"), "last_verified")
    seen = df.select(value.alias("v"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "case when contains(lower(content" in seen
    plan = kn.index_rows(df, ("a",), kn.fixed_chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(array(" not in plan


def test_an_index_is_built_without_copies_of_its_chunks(spark):
    """Documents and all chunks, as they came and merged, were written beside the index; shuffles of each step stayed."""
    from matchloom import plans
    from matchloom.operators.blocks import durable_folder
    files = lambda folder: {p: p.stat().st_size for p in Path(folder.removeprefix("file:")).rglob("*") if p.is_file()}
    folder = durable_folder(spark)
    before = files(folder)
    done = plans.load().QUERIES["index_build"](spark, "/root/testdata/sf0.01")
    new = {p: n for p, n in files(folder).items() if p not in before}
    index = sum(n for p, n in new.items() if "/index-" in str(p))
    assert index and sum(new.values()) - index < index * 2 / 3
    assert {r.layer for r in done.collect()} <= {kn.RULES, kn.TACTICS, kn.SITUATIONS, kn.DYNAMIC}
    rows = spark.range(100).selectExpr("concat('c', id) AS chunk_id", "cast(id % 4 AS int) AS bucket", "id AS chunk_index", "'x' AS content")
    merged = kn.upsert(rows, rows, "chunk_id", F.col("chunk_index"), within="bucket")
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, merged.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))


def test_chunks_keep_the_metadata_of_their_own_document(spark):
    """Joined by id, a document without one lost its chunks and two of one id had each other's metadata."""
    docs = [(None, "nameless", {"expires_at": "2030-01-01"}), ("1", "first", {"expires_at": "2031-01-01"}), ("1", "second", None)]
    df = spark.createDataFrame(docs, "document_id string, content string, metadata map<string,string>")
    rows = kn.index_rows(df, ("a",), partial(kn.fixed_chunks, keep=["metadata"])).collect()
    assert sorted((r.content, r.expires_at) for r in rows) == [("first", "2031-01-01"), ("nameless", "2030-01-01"), ("second", None)]
