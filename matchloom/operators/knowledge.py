"""Chunking, layering, embedding, index upsert and vector retrieval."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from matchloom.functions import text as tx
from matchloom.operators.sessions import top_per_group

# The four layers, their section ranges and their keyword lists.
RULES, TACTICS, SITUATIONS, DYNAMIC = "game_rules", "tactical_fundamentals", "situation_decisions", "dynamic_game_data"
DYNAMIC_TERMS = (
    "version_sensitive", "starting money", "kill reward", "loss bonus", "weapon price", "grenade price",
    "purchase price", "defuse kit", "经济数字", "价格", "奖励金额", "失败补偿",
)
SITUATION_TERMS = (
    "situation decision", "save decision", "post-plant", "post plant", "retake", "clutch", "low time",
    "late-round", "late round", "残局", "回防", "保枪", "人数劣势", "人数优势", "低时间",
)
RULE_TERMS = (
    "hard rule", "victory condition", "round phase", "bomb mechanic", "defuse", "mr12",
    "胜利条件", "回合规则", "炸弹机制", "拆弹",
)
# Terms that route a query to a layer.
ROUTE_SITUATION = (
    "save", "retake", "post-plant", "post plant", "clutch", "low time", "alive", "1v", "2v", "3v", "4v", "5v",
    "保枪", "回防", "残局", "人数", "炸弹已安放", "时间不足",
)
ROUTE_DYNAMIC = (
    "economy", "price", "reward", "buy", "money", "loss bonus", "cost", "经济", "价格", "奖励", "购买", "金钱", "补偿",
)
ROUTE_RULE = ("win condition", "mechanic", "defuse", "bomb timer", "mr12", "胜利条件", "机制", "拆弹", "回合规则")


# -- chunking ---------------------------------------------------------------

def windows(text: str, size: int, overlap: int):
    """Overlapping spans; an end past half the span snaps to the last sentence or line break.

    All break positions are found once; each span looks its end up by bisection.
    """
    marks = [(m.end(), m.start() + 1) for m in re.finditer(r"。|\. |\n", text)] if len(text) > size else []
    ends = [end for end, _ in marks]
    at = 0
    while at + size < len(text):
        stop = at + size
        last = bisect.bisect_right(ends, stop) - 1
        if last >= 0 and marks[last][1] > at + size // 2 + 1:
            stop = marks[last][1]
        yield text[at:stop].strip()
        at = max(at + 1, stop - overlap)
    yield text[at:].strip()


# The form of a numbered heading, its greatest length and number of full stops.
NUMBERED = re.compile(r"(?:\d+[.)]|\d+(?:\.\d+)+)\s+\S")
HEADING_LONGEST, HEADING_STOPS = 180, 4


def heading_of(line: str) -> str | None:
    """Markdown or numbered heading text; None for prose."""
    if line.startswith("#"):
        return line.lstrip("#").strip()
    short = len(line) <= HEADING_LONGEST and line.count("。") + line.count(".") <= HEADING_STOPS
    return line if NUMBERED.match(line) and short else None


def passages(text: str, sep: str, size: int, overlap: int, least: int):
    """(index, heading, content) of a text; a short tail joins its predecessor and its index stays unused."""
    packs: list[list] = []
    heading, fresh = None, True
    for block in filter(None, (b.strip() for b in text.split(sep))):
        first, *rest = block.splitlines()
        title = heading_of(first.strip())
        if title is not None:
            heading, block = title or heading, "\n".join(rest).strip()
            fresh = True
            if block:
                packs.append([heading, block])
                fresh = False
        elif not fresh and len(packs[-1][1]) + 2 + len(block) <= size:
            packs[-1][1] += "\n\n" + block
        else:
            packs.append([heading, block])
            fresh = False
    out: list[list] = []
    spans = ((h, w) for h, body in packs for w in windows(body, size, overlap) if w)
    for index, (h, content) in enumerate(spans):
        if len(content) < least and out and out[-1][1] == h and len(out[-1][2]) + 2 + len(content) <= size + overlap:
            out[-1][2] += "\n\n" + content
        else:
            out.append([index, h, content])
    return out


CHUNKS = T.StructType.fromJson({"type": "struct", "fields": [
    {"name": "document_id", "type": "string", "nullable": True, "metadata": {}},
    {"name": "chunk_index", "type": "integer", "nullable": True, "metadata": {}},
    {"name": "heading", "type": "string", "nullable": True, "metadata": {}},
    {"name": "content", "type": "string", "nullable": True, "metadata": {}}]})


def chunk_documents(docs: DataFrame, sep: str = "\n\n", size: int = 900, overlap: int = 120, least: int = 40) -> DataFrame:
    """Structure-aware chunks of (document_id, content), streamed batch by batch."""
    def run(batches):
        for pdf in batches:
            rows = [(doc, *r) for doc, content in zip(pdf["document_id"], pdf["content"])
                    for r in passages(content or "", sep, size, overlap, least)]
            yield pd.DataFrame(rows, columns=CHUNKS.fieldNames())
    return docs.select("document_id", "content").mapInPandas(run, CHUNKS)


def fixed_chunks(docs: DataFrame, size: int = 900, overlap: int = 120, keep: Sequence[str] = ()) -> DataFrame:
    """Fixed-stride chunks as plain expressions; ``keep`` names columns of a document that its chunks have too."""
    n = F.length("content")
    last = F.ceil(F.greatest(F.lit(0), n - size) / (size - overlap)).cast("int")
    rows = docs.select("document_id", "content", *keep, F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return rows.select("document_id", "chunk_index",
                       F.substring("content", F.col("chunk_index") * (size - overlap) + 1, F.lit(size)).alias("content"), *keep)


def inline_metadata(docs: DataFrame, key: str, text: str, marks: str = ":") -> DataFrame:
    """``name: value`` lines as rows; names lower-cased, the last line of a name wins."""
    pattern = rf"^\s*([A-Za-z_]+)\s*[{marks}]\s*(\S.*)$"
    rows = docs.select(key, F.posexplode(tx.lines(F.col(text))).alias("pos", "line")).filter(F.col("line").rlike(pattern))
    rows = rows.select(key, "pos", F.lower(F.regexp_extract("line", pattern, 1)).alias("key"),
                       F.regexp_replace(F.regexp_extract("line", pattern, 2), r"\s+$", "").alias("value"))
    return rows.groupBy(key, "key").agg(F.max_by("value", "pos").alias("value"))


# Section numbers of the layers.
RULE_SECTIONS = (1, 5)
DYNAMIC_SECTIONS, DYNAMIC_SECTION = (36, 40), 48
SITUATION_SECTIONS, SITUATION_SECTION = (49, 85), 96


def infer_layer(heading: Column, text: Column, lowered: Column | None = None) -> Column:
    """Section number range first, then keyword precedence.

    ``lowered`` may name a column that holds heading and text, joined by a line break and lower-cased.
    """
    section = F.regexp_extract(F.coalesce(heading, F.lit("")), r"^(\d+)(?:[.)]|\.\d+)", 1).try_cast("int")
    words = F.concat_ws("\n", heading, text)
    has_any = lambda terms: tx.has_any(words, terms) if lowered is None else reduce(or_, map(lowered.contains, terms))
    return (F.when(section.between(*RULE_SECTIONS), RULES)
            .when(section.between(*DYNAMIC_SECTIONS) | (section == DYNAMIC_SECTION), DYNAMIC)
            .when(section.between(*SITUATION_SECTIONS) | (section == SITUATION_SECTION), SITUATIONS)
            .when(section.isNotNull(), TACTICS)
            .when(has_any(DYNAMIC_TERMS), DYNAMIC)
            .when(has_any(SITUATION_TERMS), SITUATIONS)
            .when(has_any(RULE_TERMS), RULES)
            .otherwise(TACTICS))


def annotate(df: DataFrame, inferred: Column, explicit: Column, sensitive: Column, strength: Column) -> DataFrame:
    """Final layer, rule strength and version flag; dynamic and version-sensitive imply each other."""
    base = F.when(explicit.isin(RULES, TACTICS, SITUATIONS, DYNAMIC), explicit).otherwise(inferred)
    flag = tx.truthy(sensitive) | (base == DYNAMIC)
    default = F.when(base.isin(RULES, DYNAMIC), "hard_rule").when(base == SITUATIONS, "contextual_recommendation").otherwise("strategic_principle")
    known = strength.isin("hard_rule", "strategic_principle", "contextual_recommendation")
    return df.select("*", F.when(flag, DYNAMIC).otherwise(base).alias("layer"),
                     F.when(flag, "hard_rule").when(known, strength).otherwise(default).alias("rule_strength"),
                     flag.alias("version_sensitive"))


def inline_value(content: Column, name: str, marks: str = ":：") -> Column:
    """The value of the last ``name: value`` line, or null.

    Few texts hold the name at all; only those are split into lines.
    """
    pattern = rf"^\s*([A-Za-z_]+)\s*[{marks}]\s*(\S.*)$"
    found = F.filter(tx.lines(content), lambda x: F.lower(F.regexp_extract(x, pattern, 1)) == name)
    value = F.regexp_replace(F.regexp_extract(F.try_element_at(found, F.lit(-1)), pattern, 2), r"\s+$", "")
    return F.when(F.lower(content).contains(name), value)


def fan_out(df: DataFrame, metadata: Column, content: Column) -> DataFrame:
    """Adds last_verified, effective_from, expires_at, source_urls and exceptions of each chunk.

    The document's metadata (a map of strings) comes first, lines of the chunk second;
    empty values count as absent. URLs come from the metadata alone, exceptions are
    split at semicolons.
    """
    given = lambda name: F.when(metadata[name] != "", metadata[name])
    # the one-element array binds the value, so the lines are read once
    inline = lambda name: F.try_element_at(F.filter(F.array(inline_value(content, name)), lambda x: x != ""), F.lit(1))
    dates = [F.coalesce(given(n), inline(n)).alias(n) for n in ("last_verified", "effective_from", "expires_at")]
    urls = F.filter(F.array(given("source_urls")), lambda x: x.isNotNull())
    exceptions = F.coalesce(tx.split_exceptions(F.coalesce(given("exceptions"), inline("exceptions"))), F.array().cast("array<string>"))
    return df.select("*", *dates, urls.alias("source_urls"), exceptions.alias("exceptions"))


def index_rows(docs: DataFrame, vocabulary: Sequence[str], chunker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Documents (document_id, content, metadata) to the rows of a chunk index: annotated, dated, named and embedded.

    Where the chunker does not hand on ``metadata``, it is joined to the chunks.
    """
    chunks = (chunker or chunk_documents)(docs)
    heading = F.col("heading") if "heading" in chunks.columns else F.lit(None).cast("string")
    chunks = chunks.withColumn("heading", heading)
    if "metadata" not in chunks.columns:
        chunks = chunks.join(docs.select("document_id", "metadata"), "document_id")
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    # lower-cased in a step of its own, so once for all terms
    rows = chunks.withColumn("metadata", meta).withColumn("_words", F.lower(F.concat_ws("\n", "heading", "content")))
    rows = rows.withColumn("inferred", infer_layer(F.lower("heading"), F.lower("content"), F.col("_words"))).drop("_words")
    given, inline = F.col("metadata")["version_sensitive"], inline_value(F.col("content"), "version_sensitive")
    rows = annotate(rows, F.col("inferred"), F.col("metadata")["knowledge_layer"], F.coalesce(given, inline), F.col("metadata")["rule_strength"])
    rows = fan_out(rows, F.col("metadata"), F.col("content"))
    rows = rows.withColumn("chunk_id", tx.chunk_id(F.lit(None).cast("string"), F.col("document_id"), F.col("chunk_index"), F.col("content")))
    return embed_terms(rows.drop("inferred", "metadata"), "content", vocabulary)


def fact_document(title: Column, facts: Column, notes: Column) -> Column:
    """A fact record as document text."""
    head = F.array(F.concat(F.lit("# "), title))
    noted = F.transform(notes, lambda n: F.concat(F.lit("Note: "), n))
    return F.array_join(F.flatten(F.array(head, facts, noted)), "\n\n")


# -- embedding and index ----------------------------------------------------

def normalised(df: DataFrame, vector: Column, out: str = "vector") -> DataFrame:
    """Add the L2-normalised vector; a zero vector stays zero.

    The steps are separate projections, so the raw vector is computed once.
    """
    raw = df.withColumn("_raw", F.transform(vector, lambda x: x.cast("double")))
    raw = raw.withColumn("_norm", F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x * x)))
    unit = F.when(F.col("_norm") > 0, F.transform("_raw", lambda x: x / F.col("_norm"))).otherwise(F.col("_raw"))
    return raw.withColumn(out, unit).drop("_raw", "_norm")


def term_counts(text: Column, vocabulary: Sequence[str]) -> Column:
    """Default embedder before normalisation: occurrences of each vocabulary term."""
    return F.array(*[((F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)).cast("double") for t in vocabulary])


def embed_terms(df: DataFrame, text: str, vocabulary: Sequence[str], out: str = "vector") -> DataFrame:
    """Embedding column of normalised term counts."""
    lowered = df.withColumn("_low", F.lower(text))
    return normalised(lowered, term_counts(F.col("_low"), vocabulary), out).drop("_low")


def embedder(encode, dimensions: int):
    """Wrap ``encode(list[str]) -> 2-D array`` as a batched column function with normalised output."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        raw = np.asarray(encode(texts.fillna("").tolist()), dtype=np.float64).reshape(len(texts), dimensions)
        norm = np.linalg.norm(raw, axis=1, keepdims=True)
        return pd.Series(list((raw / np.where(norm > 0, norm, 1.0)).astype(np.float32)))
    return embed


def upsert(existing: DataFrame | None, incoming: DataFrame, key: str, order: Column, within: str | None = None) -> DataFrame:
    """Latest row per key, incoming over existing; ``existing`` None is a reset.

    ``within`` names a column that follows from the key: rows are dealt by it, and the result still is.
    """
    rows = incoming.withColumn("_new", F.lit(1)).withColumn("_o", order)
    if existing is not None:
        rows = existing.withColumn("_new", F.lit(0)).withColumn("_o", order).unionByName(rows, allowMissingColumns=True)
    keys = [key] if within is None else [within, key]
    rest = [c for c in rows.columns if c not in (*keys, "_new", "_o")]
    best = F.max_by(F.struct(*rest), F.struct("_new", "_o"))
    rows = rows if within is None else rows.repartition(within)
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def counts_by_layer(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


# -- retrieval --------------------------------------------------------------

#: Vectors in a block, the fewest blocks of chunks, and queries scored at a time.
BLOCK, SPREAD, SLICE = 4_096, 64, 256


def _unit_rows(series: pd.Series) -> np.ndarray:
    m = np.stack(series.to_numpy()).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)


def _score_blocks(k: int):
    """The k best of each layer for every query of one pair of blocks, a slice of the queries at a time."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["query_id", "layer", "chunk_id", "score"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=cols)
        q, asked, out = _unit_rows(left["vector"]), left["query_id"].to_numpy(), []
        for layer, part in right.sort_values("chunk_id").groupby("layer", sort=False):
            ids, vectors = part["chunk_id"].to_numpy(), _unit_rows(part["vector"]).T
            for at in range(0, len(q), SLICE):
                scores = q[at:at + SLICE] @ vectors
                np.clip(scores, -1.0, 1.0, out=scores)
                # ids ascend, so a stable sort breaks ties by id
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(len(scores)), best.shape[1])
                out.append(pd.DataFrame({"query_id": asked[at + row], "layer": layer, "chunk_id": ids[best.ravel()], "score": scores[row, best.ravel()]}))
        return pd.concat(out)[cols]
    return run


def layer_topk(queries: DataFrame, chunks: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Exact cosine top-k per (query, layer): query_id, layer, chunk_id, score, rank.

    Both sides are dealt to blocks by id hash, the chunks always to ``SPREAD`` at least;
    a task multiplies one pair of blocks, ``SLICE`` queries at a time, and keeps its
    local top-k, so at most k rows per query and block are shuffled on. ``queries``:
    query_id, vector; ``chunks``: chunk_id, layer, vector.
    """
    nq = max(1, math.ceil(queries.count() / block))
    nc = max(SPREAD, math.ceil(chunks.count() / block))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("qb"), spread(nc).alias("cb"))
    right = chunks.select("chunk_id", "layer", "vector", F.pmod(F.xxhash64("chunk_id"), F.lit(nc)).cast("int").alias("cb"), spread(nq).alias("qb"))
    schema = T.StructType([queries.schema["query_id"], chunks.schema["layer"], chunks.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    local = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(_score_blocks(k), schema)
    return top_per_group(local, ["query_id", "layer"], [F.col("score").desc(), "chunk_id"], k, "rank")


def topk(hits: DataFrame, k: int) -> DataFrame:
    """Global top-k per query from per-layer hits."""
    return top_per_group(hits.drop("rank"), ["query_id"], [F.col("score").desc(), "chunk_id"], k, "rank")


def route(text: Column, contextual: Column, money_known: Column) -> Column:
    """Ordered layers for a query."""
    situation = contextual | tx.has_any(text, ROUTE_SITUATION)
    dynamic = money_known | tx.has_any(text, ROUTE_DYNAMIC)
    rule = tx.has_any(text, ROUTE_RULE)
    return F.array_distinct(F.array_compact(F.array(
        F.when(situation, SITUATIONS), F.when(dynamic, DYNAMIC), F.lit(TACTICS), F.when(rule | ~situation, RULES), F.lit(SITUATIONS))))


def retrieve_for_decision(hits: DataFrame, routes: DataFrame, limit: int = 4, per_layer: int = 4, min_score: float = .15) -> DataFrame:
    """One hit per routed layer, filled from the pooled hits, ordered by layer priority.

    ``hits``: query_id, layer, chunk_id, score, rank (top ``4 * limit`` per layer), usable;
    ``routes``: query_id, layers.  Filters apply after the rank cuts.
    """
    h = hits.join(routes, "query_id").withColumn("priority", F.array_position("layers", F.col("layer")) - 1).filter("priority >= 0").drop("layers")
    ok = (F.col("score") >= min_score) & F.col("usable")
    per = h.filter((F.col("rank") <= per_layer) & (F.col("priority") < limit) & ok)
    cols = ["query_id", "chunk_id", "layer", "score", "priority"]
    first = per.groupBy("query_id", "layer").agg(F.min_by(F.struct("chunk_id", "score", "priority"), "rank").alias("b")).select(
        "query_id", "layer", "b.*").select(*cols)
    pool = top_per_group(h.drop("rank"), ["query_id"], [F.col("score").desc(), "chunk_id"], 4 * limit, "rank").filter(ok)
    pool = pool.join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    held = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("held"))
    fill = top_per_group(pool.drop("rank"), ["query_id"], [F.col("score").desc(), "chunk_id"], limit, "_rn")
    fill = fill.join(held, "query_id", "left").filter(F.col("_rn") <= limit - F.coalesce("held", F.lit(0)))
    both = first.unionByName(fill.select(*cols))
    return top_per_group(both, ["query_id"], ["priority", F.col("score").desc(), "chunk_id"], limit, "position")


def merge_hits(hits: DataFrame, keep: int = 8) -> DataFrame:
    """Best score per (query, chunk) across calls, the top ``keep`` per query."""
    best = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return top_per_group(best, ["query_id"], [F.col("score").desc(), "chunk_id"], keep, "rank")


def unique_hits(hits: DataFrame, match: str, keep: int = 10) -> DataFrame:
    """Best score per (match, chunk), the top ``keep`` per match."""
    best = hits.groupBy(match, "chunk_id").agg(F.max("score").alias("score"))
    return top_per_group(best, [match], [F.col("score").desc(), "chunk_id"], keep, "rank")


def retrieval_metrics(ranked: DataFrame, queries: DataFrame, relevant: Column) -> DataFrame:
    """Case count, hit rate at k and mean reciprocal rank (0 when missed).

    ``ranked``: query_id, chunk columns used by ``relevant``, rank.
    """
    first = ranked.filter(relevant).groupBy("query_id").agg(F.min("rank").alias("r"))
    j = queries.select("query_id").join(first, "query_id", "left")
    return j.agg(F.count(F.lit(1)).alias("cases"), F.avg(F.col("r").isNotNull().cast("int")).alias("recall_at_k"),
                 F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"))
