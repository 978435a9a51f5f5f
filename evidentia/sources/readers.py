"""Sources of raw records. What a provider sent lands in files; these readers take it from there.

Every reader gives (source STRING, raw STRING, ...) rows or posts, and what it
refuses is a row with a reason, never an exception halfway through a scan.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators.observations import canonical_payload

RAW = "source string, raw string"
Reader = Callable[[SparkSession, str], DataFrame]


def field(raw: str | Column, path: str) -> Column:
    return F.get_json_object(raw, f"$.{path}")


def json_lines(source: str) -> Reader:
    """A feed that landed as one JSON record a line."""
    return lambda spark, path: spark.read.text(path).where(F.trim("value") != "").select(F.lit(source).alias("source"), F.col("value").alias("raw"))


def listed(source: str, items: str, need: str | None = None) -> Reader:
    """A feed that landed as documents with an array of records under a key; records without the needed field are left out."""

    def read(spark: SparkSession, path: str) -> DataFrame:
        whole = spark.read.text(path, wholetext=True)
        rows = whole.select(F.lit(source).alias("source"), F.explode(F.from_json(field("value", items) if items else F.col("value"), "array<string>")).alias("raw"))
        return rows.where(field("raw", need).isNotNull()) if need else rows

    return read


SOURCES: dict[str, Reader] = {
    "search_feed": listed("search_feed", "jobs"),
    "open_list": listed("open_list", "", "id"),
    "paged_feed": listed("paged_feed", "data"),
    "term_feed": listed("term_feed", "results"),
    "query_feed": listed("query_feed", "data"),
    "web_search": listed("web_search", "organic"),
    "board_a": listed("board_a", "jobs"),
    "board_b": listed("board_b", ""),
    "board_c": listed("board_c", "jobs"),
    "offers": json_lines("offers"),
}


def ingested(spark: SparkSession, paths: dict[str, str], only: str | None = None, limit: int | None = None, sources: dict[str, Reader] = SOURCES) -> tuple[DataFrame, DataFrame]:
    """Raw records of all sources, or of one, and health: (source, status, items, error).

    A source that can't be read gives no rows and a failed line; one without rows is
    empty. limit counts for each source alone.
    """
    if only is not None and only not in sources:
        raise ValueError(f"unknown source {only}")
    out, health = spark.createDataFrame([], RAW), []
    for name, reader in sources.items():
        if name not in paths or only not in (None, name):
            continue
        try:
            rows = reader(spark, paths[name]).select("source", "raw")
            rows = rows.limit(limit) if limit is not None else rows
            n = rows.count()
            health.append((name, "ok" if n else "empty", n, None))
            out = out.unionByName(rows)
        except Exception as e:  # one source never takes the others along
            health.append((name, "failed", 0, type(e).__name__))
    return out, spark.createDataFrame(health, "source string, status string, items long, error string")


def exact_once(df: DataFrame, payload: str, query: str) -> tuple[DataFrame, DataFrame]:
    """Rows with each payload once, and per query how many were retained, duplicate or malformed (no JSON object)."""
    good = F.coalesce(F.json_object_keys(payload).isNotNull(), F.lit(False))
    place = Window.partitionBy(F.sha2(F.coalesce(canonical_payload(F.col(payload)), F.col(payload)), 256)).orderBy(query)  # names in any order are one record
    rows = df.withColumn("_kind", F.when(~good, "malformed").when(F.row_number().over(place) > 1, "duplicate").otherwise("retained"))
    counts = rows.groupBy(query).agg(*[F.count(F.when(F.col("_kind") == k, 1)).alias(k) for k in ("retained", "duplicate", "malformed")])
    return rows.where("_kind = 'retained'").drop("_kind"), counts


def with_identity(df: DataFrame, own: Column, content: list[Column]) -> DataFrame:
    """Rows with jid, their own id or one derived from their content, each id once."""
    jid = F.coalesce(F.nullif(own, F.lit("")), F.concat(F.lit("fallback:"), F.substring(F.sha2(F.concat_ws("\u001f", *content), 256), 1, 16)))
    return df.withColumn("jid", jid).dropDuplicates(["jid"])


def boards(df: DataFrame, require_listed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records of boards (board, http_status, raw) and each board's health.

    A board whose slug isn't plain or whose answer isn't 200 gives nothing; a
    listing that says it is not listed is dropped, one that says nothing is kept
    and makes the board partial.
    """
    shown = field("raw", "isListed")
    state = F.when(~F.col("board").rlike("^[A-Za-z0-9_-]+$"), "bad_slug").when(F.col("http_status") != 200, "failed").when(F.lit(require_listed) & (shown == "false"), "unlisted").when(F.lit(require_listed) & shown.isNull(), "unknown").otherwise("ok")
    rows = df.withColumn("_state", state)
    n = lambda *k: F.count(F.when(F.col("_state").isin(*k), 1))
    status = F.when(n("bad_slug", "failed") > 0, "failed").when(n("unknown") > 0, "partial").when(n("ok") == 0, "empty").otherwise("ok")
    return rows.where(F.col("_state").isin("ok", "unknown")).drop("_state"), rows.groupBy("board").agg(n("ok", "unknown").alias("items"), status.alias("status"))


def snapshot(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """Header and records of a snapshot: JSON lines of which one is the header with record_count, which must be right."""
    lines = spark.read.text(path)
    head = lines.where(field("value", "type") == "header")
    headers = head.limit(2).collect()
    if len(headers) != 1:
        raise ValueError("a snapshot has one header")
    header = json.loads(headers[0]["value"])
    records = lines.where(F.coalesce(field("value", "type"), F.lit("")) != "header").select(field("value", "source").alias("source"), field("value", "raw").alias("raw"))
    found = records.count()
    if found != header.get("record_count"):
        raise ValueError(f"the header says {header.get('record_count')} records, the file has {found}")
    return header, records


def bounded_lines(spark: SparkSession, path: str, most_rows: int = 5000, most_bytes: int = 8 << 20, row_bytes: int = 16_000) -> DataFrame:
    """JSON lines of an input that must be small; a ValueError says which bound it breaks."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    n = lines.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes"), F.coalesce(F.max(F.octet_length("value")), F.lit(0)).alias("longest")).first()
    for name, value, bound in (("rows", n["rows"], most_rows), ("bytes", n["bytes"], most_bytes), ("bytes in a row", n["longest"], row_bytes)):
        if value > bound:
            raise ValueError(f"{value} {name}, over {bound}")
    return lines


def news(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: title, link, outlet and published."""
    schema = "title string, link string, source string, pubDate string"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    published = F.try_to_timestamp(F.regexp_extract("pubDate", "^(?:[A-Za-z]+, )?([0-9]+ [A-Za-z]+ [0-9]+ [0-9:]+)", 1), F.lit("d MMM yyyy HH:mm:ss"))
    return rows.select("title", "link", F.coalesce("source", "link").alias("outlet"), published.alias("published"))


@F.pandas_udf(T.StringType())
def json_fault(value: pd.Series) -> pd.Series:
    """What strict reading of a JSON text refuses: a name twice in one object, a number that is not finite, or broken syntax; null for none."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a name stands twice in an object")
        return dict(pairs)

    def finite(name: str) -> float:
        raise ValueError(f"{name} is not finite")

    def one(text: str | None) -> str | None:
        try:
            json.loads(text or "", object_pairs_hook=once, parse_constant=finite)
        except ValueError as e:
            return str(e)[:200]
        return None

    return value.map(one)


def audit(spark: SparkSession, path: str, most_rows: int = 100_000, most_bytes: int = 32 << 20) -> DataFrame:
    """id and row of an audit file {"rows": [...]}; broken bounds, repeated names or ids and numbers that aren't finite are refused."""
    whole = spark.read.text(path, wholetext=True)
    size = whole.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("n")).first()["n"]
    if size > most_bytes:
        raise ValueError(f"{size} bytes, over {most_bytes}")
    faults = whole.select(json_fault("value").alias("fault")).where("fault is not null").take(1)
    if faults:
        raise ValueError(faults[0]["fault"])
    rows = whole.select(F.explode(F.from_json(field("value", "rows"), "array<string>")).alias("row")).select(field("row", "id").alias("id"), "row")
    n = rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
    if n["n"] > most_rows or n["ids"] != n["n"]:
        raise ValueError("too many rows, or ids that are missing or repeated")
    return rows


def dimension(spark: SparkSession, path: str, schema: str, items: str | None = None) -> DataFrame:
    """A small dimension from a YAML or JSON file that an operator of the pipeline edits by hand: a list of records, or a map whose names become the first column.

    items names the key under which the records are, if they are not the whole file. The
    file is read through Spark and is one driver-side document, so it must be small.
    """
    import yaml

    lines = bounded_lines(spark, path, most_rows=100_000, row_bytes=1 << 20) if path.endswith(".jsonl") else None
    if lines is not None:
        return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    found = yaml.safe_load(spark.read.text(path, wholetext=True).first()["value"]) or []
    found = found.get(items) or [] if items else found
    names = [f.split()[0] for f in schema.split(", ")]
    rows = [{names[0]: k, **(v or {})} for k, v in found.items()] if isinstance(found, dict) else found
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def pending(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a queue that waits: a JSON array of texts; anything else is an empty queue."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "array<string>")).alias("id")).where("id is not null").distinct()


def point_reads(asked: DataFrame, kept: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key that was asked for, and found, which is false where there is none."""
    wanted = asked.select(key).distinct()
    last = kept.join(wanted, key, "left_semi").groupBy(key).agg(F.max_by(F.struct(*kept.columns), F.struct(at, F.xxhash64(*kept.columns))).alias("_row"))
    rest = [c for c in kept.columns if c != key]
    return wanted.join(last, key, "left").select(key, *[F.col(f"_row.{c}").alias(c) for c in rest], F.col("_row").isNotNull().alias("found"))


def posting(html: Column) -> Column:
    """The JSON of a page's JobPosting, or null."""
    blocks = F.regexp_extract_all(html, F.lit("(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>"), F.lit(1))
    return F.get(F.filter(blocks, lambda b: F.coalesce(F.get_json_object(b, "$.@type") == "JobPosting", F.lit(False))), 0)


def posting_columns(html: Column) -> dict[str, Column]:
    p = posting(html)
    place = F.concat_ws(", ", F.get_json_object(p, "$.jobLocation.address.addressLocality"), F.get_json_object(p, "$.jobLocation.address.addressCountry"))
    pay = F.concat_ws(" ", F.get_json_object(p, "$.baseSalary.currency"), F.get_json_object(p, "$.baseSalary.value.minValue"), F.lower(F.get_json_object(p, "$.baseSalary.value.unitText")))
    return {"title": F.get_json_object(p, "$.title"), "company": F.get_json_object(p, "$.hiringOrganization.name"), "location": F.nullif(place, F.lit("")), "pay_raw": F.nullif(pay, F.lit("")), "description": F.get_json_object(p, "$.description")}


def links(pages: DataFrame, html: str, host: str) -> DataFrame:
    """pages with url for each distinct link to a host."""
    found = F.regexp_extract_all(html, F.lit("(?i)<a\\s[^>]*href=[\"']([^\"'#]+)"), F.lit(1))
    return pages.withColumn("url", F.explode(F.array_distinct(found))).where(F.col("url").rlike("^https?://([^/]*\\.)?" + host.replace(".", "\\.") + "(/|$)"))


def thread_posts(df: DataFrame, raw: str) -> DataFrame:
    """Posts of forum pages: topic_id, post_id, post_number, user_id, created_at, text and, for what can't be attributed, issue."""
    schema = "array<struct<id:bigint,post_number:int,user_id:bigint,post_type:int,cooked:string,created_at:string,hidden:boolean>>"
    posts = df.select(field(raw, "id").try_cast("long").alias("topic_id"), F.explode(F.from_json(field(raw, "post_stream.posts"), schema)).alias("p"))
    issue = F.when(F.col("p.user_id").isNull(), "author_unknown").when(F.coalesce("p.hidden", F.lit(False)), "hidden").when(F.col("p.cooked").isNull(), "no_text")
    return posts.select("topic_id", F.col("p.id").alias("post_id"), "p.post_number", "p.user_id", F.try_to_timestamp("p.created_at").alias("created_at"), F.when(issue.isNull(), text.html_text(F.col("p.cooked"))).otherwise("").alias("text"), issue.alias("issue"))


def native_role(html: Column, paths: dict[str, str]) -> dict[str, Column]:
    """Columns of a role page that its own site builds: from the JSON that the page carries for its scripts (paths: column -> path in it), else from its heading and text.

    A page without such JSON gives its only h1 as title and its role's text as description.
    """
    carried = F.regexp_extract(html, "(?is)<script[^>]*type=[\"']application/json[\"'][^>]*>(.*?)</script>", 1)
    heads = F.regexp_extract_all(html, F.lit("(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1))
    plain = {"title": F.when(F.size(heads) == 1, text.html_text(F.get(heads, F.lit(0)))), "description": text.html_text(text.role_markup(html))}
    return {c: F.coalesce(F.get_json_object(F.nullif(carried, F.lit("")), p), plain.get(c, F.lit(None).cast("string"))) for c, p in paths.items()}
