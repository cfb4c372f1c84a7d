"""Secret scans through a ledger of content-addressed blobs.

Every text, of any version of any document, has an address: the SHA-256 of its
content. The ledger is a table in a shared folder with one row per address and
version of the rules that has been scanned, whether or not anything was found. A
run scans only pairs that the ledger doesn't have, one text per address, appends
them, and joins the findings back to every document with that content.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.utils import AnalysisException

from matchloom.llm.common import durable_folder, pick, position, saved, surely

# The base rules: kind, pattern, whether letters of the keyword may be in either case, group measured, fewest characters of it.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    ("access", r"AKIA[A-Z0-9]+", False, 0, 16),
    ("hex", r"[0-9a-f]{32,}", False, 0, 32),
)
# A private key: its first line, then what stands before the last line, be the lines apart or run together; where that line
# is missing, the lines that are headers or look like parts of a key.
HEAD = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
FIELD = r"""[A-Z][A-Za-z0-9-]{1,40}:(?:(?!-----)[^\r\n\\])*+(?=[\r\n\\])"""
LINE = r"""(?:\r\n?|\n|\\r\\n|\\n)"""
KEY = (r"""(?:(?:(?:[\s>"'\#*|,]|\\[rn])++(?:""" + FIELD + r"""|[A-Z][A-Za-z0-9-]{1,40}:[\x20\t]*+[^\s\\]++|[A-Za-z0-9+/=]++))*+(?:[\s>"'\#*|,]|\\[rn])*+-----END [A-Z ]{0,40}PRIVATE KEY-----"""
       r"""|(?:""" + LINE + r"""++[\x20\t>"'\#*|]*+(?:""" + FIELD + r"""|(?:[A-Za-z0-9+/=]{16,}+|[A-Za-z]*+[0-9+/=][A-Za-z0-9+/=]*+|[A-Za-z]++(?=\Z))(?=[\x20\t"',]*+(?:[\r\n\\]|\Z)))"""
       r"""|[\x20\t]++[A-Za-z0-9+/=]{40,}+(?=[\s\\]|\Z))++)?""")
# What this operator looks for besides.
MORE = (
    ("pem", HEAD + KEY, False, 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", False, 0, 0),
)
RULES = BASE + MORE
MASK = "[secret]"
LEDGER = "address string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find(text: str, compiled) -> list[tuple[int, int, int]]:
    """(start, rule, end) of every match that is long enough, in code points."""
    return sorted((m.start(), k, m.end()) for k, (pattern, group, least) in enumerate(compiled)
                  for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least)


def compile_rules(rules):
    return [(re.compile(p, re.A | re.I if either else re.A), group, least) for _, p, either, group, least in rules]


def joined(found, rules) -> str:
    return ",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in found)


def scanner(rules):
    version = rule_version(rules)

    def run(batches):
        compiled = compile_rules(rules)
        for batch in batches:
            rows = {name: [] for name in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for text in batch.column(1).to_pylist():
                found = find(text, compiled)
                base = [x for x in found if x[1] < len(BASE)]
                for k, kind in enumerate(("n_assign", "n_access", "n_hex")):
                    rows[kind].append(sum(x[1] == k for x in base))
                rows["base_sha256"].append(hashlib.sha256(joined(base, rules).encode()).hexdigest())
                rows["spans"].append(joined(found, rules))
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([version] * len(batch), pa.string()), *(pa.array(v, t) for v, t in zip(rows.values(), types))],
                names=["address", "rule_version", *rows])
    return run


def address(text):
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def ledger(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def update(docs: DataFrame, path: str, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks; returns the findings of these rules and the table (doc_id, address).

    Two runs at once may both scan a blob; readers keep one row per address.
    """
    spark, version = docs.sparkSession, rule_version(rules)
    rows = pick(docs, "doc_id", "text").withColumn("address", address(F.col("text")))
    rows = rows.withColumn("path", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    slim = saved(rows.select("doc_id", "path", "address"), "addresses")
    seen = ledger(spark, path).filter(F.col("rule_version") == version).select("address")
    unseen = slim.groupBy("address").agg(F.min("path").alias("path")).join(seen, "address", "left_anti")
    todo = rows.join(unseen, ["address", "path"]).select("address", F.coalesce("text", F.lit("")).alias("text"))
    found = todo.mapInArrow(scanner(rules), LEDGER)
    found.write.mode("append").parquet(path)
    known = ledger(spark, path).filter(F.col("rule_version") == version).drop("rule_version")
    # a blob is scanned twice where equal rows repeat its document or two runs met
    once = known.groupBy("address").agg(*(F.min(c).alias(c) for c in known.columns if c != "address"))
    return saved(once, "findings"), slim.select("doc_id", "address")


def default_ledger(spark) -> str:
    """A ledger of this run alone."""
    return f"{durable_folder(spark)}/blob-ledger-{uuid.uuid4().hex}"


def scan(docs: DataFrame, path: str | None = None, rules=RULES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text is an empty one and has no spans. Equal rows give equal rows; a null
    doc_id is a document like any other. An empty table gives no rows. Columns other
    than doc_id and text are not read.
    """
    found, slim = update(docs, path or default_ledger(docs.sparkSession), rules)
    return slim.join(found, "address").drop("address")


@F.arrow_udf(T.StringType())
def masked(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, some in zip(texts.to_pylist(), spans.to_pylist()):
        if text is not None and some:
            parts, at = [], 0
            for span in some.split(","):
                _, a, b = span.split(":")
                if int(a) >= at:
                    parts += [text[at:int(a)], MASK]
                at = max(at, int(b))
            text = "".join(parts) + text[at:]
        out.append(text)
    return pa.array(out, pa.string())


def redact(docs: DataFrame, path: str | None = None, rules=RULES) -> DataFrame:
    """All documents with all their columns; every span in the text is replaced by a mask."""
    found, _ = update(docs, path or default_ledger(docs.sparkSession), rules)
    rows, text = surely(docs, "text")
    rows = rows.withColumn("address", address(F.col(text)))
    some = found.filter("spans <> ''").select("address", "spans")
    whole = rows.join(some, "address", "left").withColumn(text, F.when(F.col("spans").isNull(), F.col(text)).otherwise(masked(F.col(text), F.col("spans"))))
    columns = [F.col(c) for c in rows.columns if c != "address"]
    if "n_chars" in docs.columns:
        n = f"_{position(docs, 'n_chars')}"
        columns = [F.when(F.col("spans").isNull(), F.col(n)).otherwise(F.length(text).cast(rows.schema[n].dataType)).alias(n) if c == n else F.col(c) for c in rows.columns if c != "address"]
    return whole.select(*columns).toDF(*docs.columns)
