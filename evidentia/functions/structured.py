"""JSON, arrays and maps as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(raw: Column) -> Column:
    """What a provider calls terms as an array: a list as it is, the values of an object, one text as itself."""
    head = F.left(F.ltrim(raw), F.lit(1))
    values = F.map_values(F.from_json(raw, "map<string,string>"))
    return F.when(head == "[", F.from_json(raw, "array<string>")).when(head == "{", values).when(F.trim(raw) != "", F.array(F.regexp_replace(raw, '^"|"$', ""))).otherwise(F.array().cast("array<string>"))


def nesting(raw: Column) -> Column:
    """(now, most, closed) of a JSON text's brackets outside of its strings: depth at the end, depth at most, and how often it came back to none."""
    bare = F.regexp_replace(F.regexp_replace(raw, r'\\.', ""), '"[^"]*"', "")
    marks = F.split(F.regexp_replace(bare, r"[^{}\[\]]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"), F.lit(0).alias("closed"))
    step = lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
    return F.aggregate(marks, start, lambda a, c: F.struct((a["now"] + step(c)).alias("now"), F.greatest(a["most"], a["now"] + step(c)).alias("most"), (a["closed"] + ((a["now"] == 1) & (step(c) == -1)).cast("int")).alias("closed")))


def depth(raw: Column) -> Column:
    """How deep the brackets of a JSON text nest, outside of its strings."""
    return nesting(raw)["most"]


def is_object(raw: Column) -> Column:
    """Whether a text is one JSON object from its first to its last letter; Spark's parsers stop behind the first value whatever follows."""
    n = nesting(raw)
    return F.coalesce(F.trim(raw).startswith("{") & F.trim(raw).endswith("}") & (n["now"] == 0) & (n["closed"] == 1) & F.try_parse_json(raw).isNotNull(), F.lit(False))


def model_scores(raw: Column) -> Column:
    """A model's answer [{"id", "score", "reasons"}] as structs: malformed entries go, scores lie in 0..1, three reasons of 80 characters stay."""
    clean = F.regexp_replace(F.trim(raw), "(?is)^```(json)?\\s*|\\s*```$", "")
    rows = F.from_json(clean, "array<struct<id:string,score:double,reasons:array<string>>>")
    good = F.filter(rows, lambda r: (F.coalesce(r["id"], F.lit("")) != "") & r["score"].isNotNull() & ~F.isnan(r["score"]) & r["reasons"].isNotNull())
    reasons = lambda r: F.transform(F.slice(F.filter(r["reasons"], lambda x: F.trim(x) != ""), 1, 3), lambda x: F.left(x, F.lit(80)))
    return F.coalesce(F.transform(good, lambda r: F.struct(r["id"].alias("id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), r["score"])).alias("score"), reasons(r).alias("reasons"))), F.array().cast("array<struct<id:string,score:double,reasons:array<string>>>"))


def cited(source: Column, quotes: Column) -> Column:
    """How many quotes stand in the source word for word."""
    return F.size(F.filter(quotes, lambda q: (F.trim(q) != "") & F.contains(source, q)))


def plain_decimal(value: Column) -> Column:
    """A decimal text without an exponent or zeros at its end."""
    d = value.try_cast("decimal(30,8)").cast("string")
    return F.when(d.contains("."), F.regexp_replace(F.regexp_replace(d, "0+$", ""), "\\.$", "")).otherwise(d)


def content_key(*parts: Column) -> Column:
    """A hash of what was said, without where and when: ties between copies are broken by content, never by position."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i:02d}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)
