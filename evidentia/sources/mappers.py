"""Raw provider records as listings with the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, times, urls
from .readers import field

COLUMNS = ("title", "company", "url", "description", "location", "pay_raw", "posted", "remote")


def span(low: str, high: str, unit: str = "") -> Column:
    """'low-high unit' from two fields that may be missing; either stands for both."""
    lo, hi = F.coalesce(field("raw", low), field("raw", high)), F.coalesce(field("raw", high), field("raw", low))
    return F.when(lo.isNotNull(), F.when(lo == hi, F.concat(lo, F.lit(unit))).otherwise(F.concat(lo, F.lit("-"), hi, F.lit(unit))))


def of(title: str, company: str | None, url: str, description: str | None, location: str | None = None, pay: Column | str | None = None, posted: str | None = None, remote: str | None = None) -> dict[str, Column]:
    get = lambda p: F.lit(None).cast("string") if p is None else F.coalesce(*[field("raw", x) for x in p.split("|")])
    return {"title": get(title), "company": get(company), "url": get(url), "description": get(description), "location": get(location), "pay_raw": pay if isinstance(pay, Column) else get(pay), "posted": get(posted), "remote": get(remote)}


def mappings() -> dict[str, dict[str, Column]]:
    return {
        "search_feed": of("title", "company_name", "url", "description", "candidate_required_location", "salary", "publication_date"),
        "open_list": of("position|title", "company", "url", "description", "location", span("salary_min", "salary_max", " per year"), "date"),
        "paged_feed": of("title", "company_name", "url", "description", "location", None, "created_at", "remote"),
        "term_feed": of("title", "company.display_name", "redirect_url", "description", "location.display_name", F.when(field("raw", "salary_is_predicted") != "1", span("salary_min", "salary_max", " per year")), "created"),
        "query_feed": of("job_title", "employer_name", "job_apply_link|job_google_link", "job_description", "job_city|job_country", span("job_min_salary", "job_max_salary", " per year"), "job_posted_at_datetime_utc", "job_is_remote"),
        "board_a": of("title", "_company", "absolute_url", "content", "location.name", None, "first_published|updated_at"),
        "board_b": of("text", "_company", "hostedUrl|applyUrl", "descriptionPlain|description", "categories.location", span("salaryRange.min", "salaryRange.max"), "createdAt"),
        "board_c": of("title", "_company", "jobUrl|applyUrl", "descriptionPlain|descriptionHtml", "location", "compensation", "publishedAt", "isRemote"),
        "web_search": of("title", None, "link", "snippet", None, None, "date"),
        "offers": of("title", "platform_key", "url", "description", None, "pay_raw"),
    }


def normalized(raw: DataFrame) -> DataFrame:
    """raw (source, raw) with the listing's columns and issue: unknown_source, no_title or no_url. Nothing is dropped."""
    maps = mappings()
    struct = F.struct(*[F.lit(None).cast("string").alias(c) for c in COLUMNS])
    for source, columns in maps.items():
        struct = F.when(F.col("source") == source, F.struct(*[columns[c].alias(c) for c in COLUMNS])).otherwise(struct)
    out = raw.withColumn("_m", struct).select("*", "_m.*").drop("_m")
    empty_null = lambda c: F.nullif(text.display_text(F.col(c)), F.lit(""))
    out = out.withColumns({c: empty_null(c) for c in ("title", "company", "url", "location", "pay_raw")})
    out = out.withColumn("description", text.html_text(F.coalesce("description", F.lit("")))).withColumn("posted", times.parsed_moment(F.col("posted"))).withColumn("remote", F.col("remote").try_cast("boolean"))
    issue = F.when(~F.col("source").isin(*maps), "unknown_source").when(F.col("title").isNull(), "no_title").when(F.col("url").isNull(), "no_url")
    return out.withColumn("issue", issue)


def canonical(listings: DataFrame) -> DataFrame:
    """Listings with clean titles (label prefixes taken off), URLs that can be shown, companies from URLs, and whether a title is cut."""
    title = F.regexp_replace("title", "(?i)^(?:\\s*(?:new|urgent|remote|hiring|job)\\s*[:!|-]+\\s*)+", "")
    return listings.withColumns({"title": title, "truncated": F.col("title").rlike("(\\.\\.\\.|…)$"), "shown_url": urls.sanitized(F.col("url")), "company": F.coalesce("company", urls.company(F.col("url")))})


def region_tags(title: Column, body: Column, remote: Column, words: dict[str, list[str]], intent: str, first: int = 2000) -> Column:
    """Tags whose words the title has, or the start of the body together with a word of intent; worldwide for remote ones without a tag."""
    low, start = F.lower(title), F.lower(F.left(F.coalesce(body, F.lit("")), F.lit(first)))
    has = lambda c, ws: c.rlike("\\b(" + "|".join(ws) + ")\\b")
    tags = F.array_compact(F.array(*[F.when(has(low, ws) | (has(start, ws) & start.rlike(intent)), F.lit(t)) for t, ws in words.items()]))
    return F.when((F.size(tags) == 0) & remote, F.array(F.lit("worldwide"))).otherwise(tags)
