"""Queries over claims with spans; the texts are those of documents, with statements set into their middle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims
from .registry import query, table

#: What is set into a document's text, by doc_id % 6, and the claims that it makes: (kind, value, modality, mode, quote, section, actor).
CASES = (
    ("Requirements:\nYou must speak Dutch or German.\nA bachelor's degree is preferred.", [("language", "Dutch,German", "required", "any", "You must speak Dutch or German.", "requirements", "applicant"), ("credential", "bachelor", "preferred", "single", "A bachelor's degree is preferred.", "requirements", "applicant")]),
    ("Compensation\nPay is $20 per hour, plus a $500 signing bonus.\nPayment is sent within 14 days.", [("money:work", "$20 per hour", "mentioned", "single", "$20 per hour", "compensation", "applicant"), ("money:benefit", "$500", "mentioned", "single", "$500", "compensation", "applicant"), ("condition:payment_schedule", "Payment is sent within 14 days.", "mentioned", "single", "Payment is sent within 14 days.", "compensation", "applicant")]),
    ("About us\nWe raised $30 million and our revenue is USD 5 million.\nOur customers write Japanese.", [("money:business", "$30 million", "mentioned", "single", "$30 million", "about us", "applicant"), ("money:business", "USD 5 million", "mentioned", "single", "USD 5 million", "about us", "applicant"), ("language", "Japanese", "mentioned", "single", "Our customers write Japanese.", "about us", "outsider")]),
    ("Qualifications\nApplicants must be based in New Zealand; 3-5 years needed.\nPlease record your own voice.", [("location", "New Zealand", "required", "single", "based in New Zealand", "qualifications", "applicant"), ("experience", "3-5", "required", "single", "3-5 years", "qualifications", "applicant"), ("voice", "record your own voice", "mentioned", "single", "record your own voice", "qualifications", "applicant")]),
    ("Benefits:\nAnother project has a salary of EUR 40,000 per year.\nFluent Korean is not required.", [("money:other_role", "EUR 40,000 per year", "mentioned", "single", "EUR 40,000 per year", "benefits", "other_role"), ("language", "Korean", "negated", "single", "Fluent Korean is not required.", "benefits", "applicant")]),
    ("Nothing is said here.", []),
)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


#: Letters alone and without words of claims, so that the documents' own lines make none; halves of whole texts.
WORDS = "licen|certif|bachelor|master|board|voice|speech"
BODY = f"SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g'), '{WORDS}', 'x', 'g') AS t FROM documents"
VALUES = ", ".join(f"({i}, {n}, {', '.join(quoted(x) for x in claim)})" for i, (_, found) in enumerate(CASES) for n, claim in enumerate(found))


@query(
    f"""WITH d AS ({BODY}), b AS (SELECT doc_id, t, length(t) // 2 AS half, CASE doc_id % 6 {' '.join(f'WHEN {i} THEN {quoted(text)}' for i, (text, _) in enumerate(CASES))} END AS said FROM d),
c(form, n, kind, value, modality, mode, quote, section, actor) AS (VALUES {VALUES})
SELECT doc_id, kind, value, modality, mode, (half + strpos(said, quote))::INTEGER AS begin, (half + strpos(said, quote) + length(quote))::INTEGER AS "end", section, actor, quote FROM b JOIN c ON doc_id % 6 = form"""
)
def span_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim of every document's text, with its span and the words there."""
    return with_claims(spark, sf_dir).select("doc_id", "kind", "value", "modality", "mode", "begin", "end", "section", "actor", F.substring("body", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("quote"))


def with_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " "), WORDS, "x").alias("t"))
    half = F.floor(F.length("t") / 2).cast("int")
    said = F.get(F.array(*[F.lit(text) for text, _ in CASES]), (F.col("doc_id") % 6).cast("int"))
    body = F.concat(F.substring("t", F.lit(1), half), F.lit("\n"), said, F.lit("\n"), F.substring("t", half + 1, F.length("t")))
    return claims.span_claims(d.select("doc_id", body.alias("body")), "body")


@query(
    f"""WITH d AS ({BODY}), b AS (SELECT doc_id, length(t) // 2 AS half, {quoted(CASES[1][0])} AS said FROM d WHERE doc_id % 6 = 1)
SELECT doc_id, 'condition:payment_schedule' AS kind, '$20 per hour' AS amount, (half + strpos(said, '$20'))::INTEGER AS amount_begin, 'section' AS found FROM b"""
)
def bound_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions with the amount that each is about."""
    return claims.bound_conditions(with_claims(spark, sf_dir), "doc_id").select("doc_id", "kind", "amount", "amount_begin", "found")
