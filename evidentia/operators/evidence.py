"""Evidence from text: sections, claims, concepts and what they satisfy. Patterns and words are arguments or this library's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, scoring, text

HEADINGS = {"requirements": "requirements|qualifications|what you need|you have", "responsibilities": "responsibilities|your tasks|what you will do", "benefits": "benefits|what we offer|perks", "about": "about us|who we are"}


def sections(body: Column, headings: dict[str, str] = HEADINGS, most: int = 3500) -> Column:
    """A map of sections: lines after a heading belong to it; without headings the start is 'other'."""
    lines = F.split(F.coalesce(body, F.lit("")), "\n")
    kind = lambda line: sum_first([(F.lower(F.trim(line)).rlike(f"^[#* ]*({p})[: *]*$"), k) for k, p in headings.items()])
    start = F.struct(F.lit("other").alias("now"), F.array().cast("array<struct<k:string,line:string>>").alias("out"))
    step = lambda a, line: F.when(kind(line).isNotNull(), F.struct(kind(line).alias("now"), a["out"].alias("out"))).otherwise(F.struct(a["now"].alias("now"), F.concat(a["out"], F.array(F.struct(a["now"].alias("k"), line.alias("line")))).alias("out")))
    found = F.aggregate(lines, start, step)["out"]
    names = F.array_distinct(F.transform(found, lambda x: x["k"]))
    return F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.left(F.array_join(F.transform(F.filter(found, lambda x: x["k"] == k), lambda x: x["line"]), "\n"), F.lit(most)))))


def sum_first(pairs: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for condition, name in reversed(pairs):
        out = F.when(condition, name).otherwise(out)
    return out


def language_claims(body: Column, languages: dict[str, str]) -> Column:
    """(language, modality) of each clause that names a language."""
    clauses = text.segments(F.coalesce(body, F.lit("")))
    per = lambda c: F.array_compact(F.array(*[F.when(F.lower(c).rlike(f"\\b{p}\\b"), F.struct(F.lit(k).alias("language"), text.modality(c).alias("modality"))) for k, p in languages.items()]))
    return F.array_distinct(F.flatten(F.transform(clauses, per)))


def experience_claims(body: Column) -> Column:
    """(low, high) years of each clause that asks for experience."""
    clauses = F.filter(text.segments(F.coalesce(body, F.lit(""))), lambda c: F.lower(c).rlike("[0-9]+ ?\\+? ?(-|to)? ?[0-9]* ?years?"))
    years = lambda c, i: F.regexp_extract(F.lower(c), "([0-9]+) ?\\+? ?(?:(?:-|to) ?([0-9]+))? ?years?", i).try_cast("double")
    return F.transform(clauses, lambda c: F.struct(years(c, 1).alias("low"), F.coalesce(years(c, 2), years(c, 1)).alias("high")))


def work_arrangement(body: Column) -> Column:
    """remote, hybrid or onsite if one is claimed, conflicting if several are, unknown if none: silence claims nothing."""
    low = F.lower(F.coalesce(body, F.lit("")))
    claims = scoring.flags({"remote": low.rlike("\\b(fully remote|remote position|work from home)\\b"), "hybrid": low.rlike("\\bhybrid\\b"), "onsite": low.rlike("\\b(on-site|onsite|in the office)\\b")})
    return F.when(F.size(claims) == 0, "unknown").when(F.size(claims) > 1, "conflicting").otherwise(F.get(claims, F.lit(0)))


def document_type(title: Column, body: Column, path: Column) -> Column:
    """The first of: closed, index, guide, request, offer, posting, discussion."""
    low, start = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    return scoring.first_reason(
        {
            "closed": start.rlike("\\b(no longer accepting|position (is )?closed|has been filled)\\b"),
            "index": low.rlike("^[0-9,]+\\+? .*(jobs|openings)") | path.rlike("/(search|jobs|category)/?$"),
            "guide": low.rlike("^(how to|top [0-9]+|best |guide)"),
            "request": start.rlike("\\b(looking for|need someone|wanted)\\b"),
            "offer": start.rlike("\\b(i offer|hire me|my services)\\b"),
            "posting": start.rlike("\\b(apply|responsibilities|requirements)\\b"),
        },
        "discussion",
    )


def concepts(df: DataFrame, id_: str, fields: list[str], terms: dict[str, list[str]]) -> DataFrame:
    """id, concept, field and term: of each concept the first field, in order, that has one of its terms, and the longest such term."""
    words = F.lit(" ")
    rows = [F.struct(F.lit(c).alias("concept"), F.lit(i).alias("turn"), F.lit(f).alias("field"), F.lit(t).alias("term"), F.contains(F.concat(words, text.identity_text(F.coalesce(f, F.lit(""))), words), F.lit(f" {t} ")).alias("hit")) for c, ts in terms.items() for i, f in enumerate(fields) for t in ts]
    hits = df.select(id_, F.inline(F.filter(F.array(*rows), lambda r: r["hit"])))
    best = F.min_by(F.struct("field", "term"), F.struct("turn", -F.length("term"), "term"))
    return hits.groupBy(id_, "concept").agg(best.alias("b")).select(id_, "concept", "b.field", "b.term")


def requirement_outcomes(claims: DataFrame, id_: str, group: str, known: DataFrame) -> DataFrame:
    """Per id blockers, unverified and status, for claims (id, group, name, needed) against known (name, has).

    Claims of a group are alternatives: one that is met is enough. A group fails
    only if all its alternatives are known not to be met; an unknown one leaves it
    unverified.
    """
    each = claims.where("needed").join(known, "name", "left").groupBy(id_, group).agg(F.max(F.coalesce("has", F.lit(False))).alias("met"), F.max(F.col("has").isNull()).alias("open"), F.array_join(F.array_sort(F.collect_set("name")), "/").alias("names"))
    out = each.groupBy(id_).agg(F.array_sort(F.collect_set(F.when(~F.col("met") & ~F.col("open"), F.col("names")))).alias("blockers"), F.array_sort(F.collect_set(F.when(~F.col("met") & F.col("open"), F.col("names")))).alias("unverified"))
    return out.withColumn("status", F.when(F.size("blockers") > 0, "failed").when(F.size("unverified") > 0, "unknown").otherwise("passed"))


def pay_candidates(df: DataFrame, id_: str, body: str, provenance: str, confidence: float = 0.8) -> DataFrame:
    """id, quote, basis, low, high, estimate, up_to and confidence of each clause that states money for work."""
    clauses = F.filter(text.segments(F.coalesce(body, F.lit(""))), lambda c: c.rlike("[$€£₹] ?[0-9]|[0-9] ?(usd|eur|gbp|inr)"))
    work = lambda c: ~F.lower(c).rlike("\\b(revenue|funding|raised|valuation|bonus|stipend|insurance|budget of our clients)\\b")
    rows = df.select(id_, provenance, F.explode(F.filter(clauses, work)).alias("quote"))
    pay = money.parsed_pay(F.col("quote"))
    return rows.select(id_, provenance, "quote", pay.alias("p")).select(id_, provenance, "quote", "p.*", F.lower("quote").rlike("\\bup to\\b").alias("up_to"), F.lit(confidence).alias("confidence"))


def selected_pay(candidates: DataFrame, id_: str, provenance: str, weights: dict[str, float]) -> DataFrame:
    """Per id the most credible claim; ties go to the narrower range, the lower pay and the quote."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), F.col(provenance)), F.lit(0.5))
    same = Window.partitionBy(id_, "basis", "low", "high")
    several = F.size(F.collect_set(provenance).over(same)) > 1
    rows = candidates.withColumn("corroborated", several)
    rows = rows.withColumn("credibility", scoring.claim_credibility(F.col("confidence"), weight, F.col("estimate"), F.col("up_to"), F.col("corroborated")))
    order = [F.desc("credibility"), F.asc_nulls_last(F.col("high") - F.col("low")), F.asc_nulls_last("low"), F.asc("quote")]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(id_).orderBy(*order))).where("_n = 1").drop("_n")


def offer(subject: Column, body: Column) -> Column:
    """title, rate, guaranteed and confidence of a message that offers work; 0.6 where no rate is found."""
    pay = money.parsed_pay(F.regexp_extract(F.coalesce(body, F.lit("")), "(?i)([$€£₹] ?[0-9][^\\n]{0,30})", 1))
    return F.struct(F.regexp_replace(subject, "(?i)^(re|fwd?): *", "").alias("title"), pay["high"].alias("rate"), F.lower(body).rlike("guaranteed").alias("guaranteed"), F.when(pay["high"].isNull(), 0.6).otherwise(0.9).alias("confidence"))
