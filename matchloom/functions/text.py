"""Token cleaning, identifiers, metadata lines and text evidence as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def _int(text: Column) -> Column:
    return text.try_cast("int")


def score_value(raw: Column) -> Column:
    """One score token: all zeros are 0, ``7x`` is x, 0..30 stand, anything else is unknown."""
    d = digits(raw)
    value = _int(d)
    return (F.when(d.rlike("^0+$"), 0).when(d.rlike("^7[0-9]$"), _int(F.substring(d, 2, 1)))
            .when(value.between(0, 30), value))


def first_score(tokens: Column) -> Column:
    """First readable score of a token list."""
    return F.try_element_at(F.filter(F.transform(tokens, score_value), lambda x: x.isNotNull()), F.lit(1))


def money_value(raw: Column) -> Column:
    """Money token: at most five digits, no clipped-sign shape, 0..16000 in steps of 50."""
    d = digits(raw)
    value = _int(d)
    clipped = d.rlike("^5[0-9]{2,3}$")
    return F.when((F.length(d).between(1, 5)) & ~clipped & value.between(0, 16000) & (value % 50 == 0), value)


def clock_value(raw: Column) -> Column:
    """``M:SS``, or three or four digits (four: the first and the last two), in seconds."""
    kept = F.regexp_replace(raw, "[^0-9:]", "")
    colon = kept.contains(":")
    shaped = kept.rlike("^[0-9]+:[0-9]+$")
    d = F.regexp_replace(kept, ":", "")
    minutes = F.when(colon, _int(F.split_part(kept, F.lit(":"), F.lit(1)))).otherwise(_int(F.substring(d, 1, 1)))
    seconds = F.when(colon, _int(F.split_part(kept, F.lit(":"), F.lit(2)))).otherwise(_int(F.right(d, F.lit(2))))
    usable = F.when(colon, shaped).otherwise(F.length(d).isin(3, 4))
    return F.when(usable & minutes.between(0, 5) & seconds.between(0, 59), minutes * 60 + seconds)


def armour_value(raw: Column, confidence: Column) -> Column:
    """Armour token: 100 anywhere, trailing two of two or three digits, else 0..100 when confident."""
    d = digits(raw)
    tail, value = _int(F.right(d, F.lit(2))), _int(d)
    return (F.when(d.contains("100"), 100).when(F.length(d).isin(2, 3) & tail.between(10, 99), tail)
            .when((confidence >= .40) & value.between(0, 100), value))


def normal_name(raw: Column) -> Column:
    return F.regexp_replace(F.lower(raw), r"[^\p{L}\p{N}]", "")


def names_match(wanted: Column, seen: Column) -> Column:
    """Containment of the normalised names either way."""
    a, b = normal_name(wanted), normal_name(seen)
    return F.contains(b, a) | F.contains(a, b)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def stable_id(title: Column, content: Column, prefix: str = "doc_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(title, F.lit("\n"), content), 256), 1, 20))


def chunk_id(stable_key: Column, document_id: Column, index: Column, content: Column) -> Column:
    """From the stable key and index when there is one, else from the content."""
    text = F.when(stable_key.isNotNull(), F.concat_ws(":", stable_key, index.cast("string"))).otherwise(
        F.concat_ws(":", document_id, index.cast("string"), content))
    return F.concat(F.lit("chunk_"), F.substring(F.sha2(text, 256), 1, 20))


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r")


def title_of(content: Column, fallback: Column) -> Column:
    """First non-empty line without leading ``#``, at most 160 characters."""
    named = F.filter(F.transform(lines(content), lambda x: strip(F.regexp_replace(strip(x), "^#+", ""))), lambda x: x != "")
    return F.coalesce(F.substring(F.try_element_at(named, F.lit(1)), 1, 160), fallback)


def query_terms(c: dict[str, Column]) -> Column:
    """``k=v`` terms of the known decision state, bar-joined; unknown values are skipped."""
    def term(name, value):
        return F.when(value.isNotNull() & (value.cast("string") != ""), F.concat(F.lit(name + "="), value.cast("string")))
    versus = F.when(c["mates"].isNotNull() & c["enemies"].isNotNull(),
                    F.concat(F.lit("situation="), c["mates"].cast("string"), F.lit("v"), c["enemies"].cast("string")))
    clock = F.when(c["time"].isNotNull(), F.format_string("time_remaining=%.1fs", c["time"].cast("double")))
    return F.concat_ws(" | ", term("side", c["side"]), versus, term("bomb_state", c["bomb"]), term("weapon", c["weapon"]), clock,
                       term("money", c["money"]), term("utility", c["utility"]), term("map", c["map"]), term("position", c["position"]))


def iso_date(text: Column) -> Column:
    """Strict yyyy-mm-dd, else NULL."""
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d"))


def is_fresh(version_sensitive: Column, verified: Column, expires: Column, has_urls: Column, as_of: Column, max_age: int = 365) -> Column:
    """Version-sensitive facts need sources, a valid date not older than ``max_age`` days and no past expiry."""
    seen, until = iso_date(verified), iso_date(expires)
    bad = expires.isNotNull() & (expires != "") & until.isNull()
    ok = has_urls & seen.isNotNull() & ~bad & (F.datediff(as_of, seen) <= max_age) & (until.isNull() | (as_of <= until))
    return ~version_sensitive | F.coalesce(ok, F.lit(False))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "yes", "1"), F.lit(False))


def split_exceptions(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[;；]"), strip), lambda x: x != "")


def fenced_json(raw: Column) -> Column:
    """The JSON object inside an optional code fence, as a variant; NULL for anything else."""
    text = strip(F.coalesce(raw, F.lit("")))
    inner = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n", ""), r"\n[^\n]*$", "")
    body = F.when(text.startswith("```") & (F.size(lines(text)) >= 3), strip(inner)).otherwise(text)
    body = F.regexp_replace(body, r"^(?i)json\s*", "")
    return F.when(body.startswith("{"), F.try_parse_json(body))


def han_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\x{4E00}-\x{9FFF}]", ""))


def latin_count(text: Column) -> Column:
    return F.length(F.regexp_replace(F.lower(text), r"[^a-z]", ""))


def has_any(text: Column, terms) -> Column:
    """Whether the lower-cased text contains one of the terms.

    The one-element array binds the lower-cased text, so it is computed once and
    not once per term.
    """
    def chain(low):
        out = F.lit(False)
        for t in terms:
            out = out | low.contains(t)
        return out
    return F.coalesce(F.exists(F.array(F.lower(text)), chain), F.lit(False))


def number_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(?<![\w.])\d+(?:\.\d+)?"), F.lit(0)))


def manual_id(kind: Column, rid: Column, seconds: Column) -> Column:
    return F.format_string("manual_%s_%s_%09d", kind, rid.cast("string"), F.bround(seconds * 1000).cast("long"))
