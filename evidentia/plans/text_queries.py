"""Queries over documents, pages and conversations, each with its SQL."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, scoring, text, urls
from ..operators import entities, gates, joins, ledger, quality, ranking
from .registry import query, table

DE, ES, FR, EN = gates.FUNCTION_WORDS["de"], gates.FUNCTION_WORDS["es"], gates.FUNCTION_WORDS["fr"], gates.ENGLISH
PHRASES = {"contact": (0.6, r"[a-z0-9.]@[a-z0-9.]"), "phone": (0.5, r"[0-9]{3}[ -][0-9]{4}"), "licence": (0.25, r"(?i)license")}
PLACES = ["src0", "src1", "src2", "src3"]


def listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sql_language(c: str) -> str:
    """The rule of gates.detected_language over a column of text."""
    toks = f"list_slice(regexp_extract_all(lower(coalesce({c}, '')), '(\\p{{L}}+)', 1), 1, 400)"
    n = lambda words: f"len(list_filter({toks}, lambda t: list_contains({listed(words)}, t)))"
    return f"(SELECT CASE WHEN greatest(d, e, f) >= 3 AND greatest(d, e, f) >= 1.5 * greatest(g, 1) / 3 AND greatest(d, e, f) > g / 3 THEN CASE WHEN d >= e AND d >= f THEN 'de' WHEN e >= f THEN 'es' ELSE 'fr' END END FROM (SELECT {n(DE)} AS d, {n(ES)} AS e, {n(FR)} AS f, {n(EN)} AS g))"


SCAM = """CASE WHEN regexp_matches(t, '[a-z0-9.]@[a-z0-9.]') THEN 0.6 ELSE 0.0 END + CASE WHEN regexp_matches(t, '[0-9]{3}[ -][0-9]{4}') THEN 0.5 ELSE 0.0 END
  + CASE WHEN regexp_matches(t, '(?i)license') THEN 0.25 ELSE 0.0 END + CASE WHEN coalesce(source, '') = '' THEN 0.15 ELSE 0.0 END + CASE WHEN length(trim(coalesce(text, ''))) < 80 THEN 0.2 ELSE 0.0 END"""


def scam_columns() -> tuple:
    return gates.scam_score(F.lit(""), F.col("text"), F.col("source"), F.lit(""), PHRASES, ["free.example"])


@query(f"SELECT doc_id, {sql_language('text')} AS language FROM documents")
def posting_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", gates.detected_language(F.col("text")).alias("language"))


@query(
    f"""WITH d AS (SELECT doc_id, source, text, chr(10) || coalesce(text, '') AS t FROM documents)
SELECT doc_id, CAST(round(least({SCAM}, 1.0) * 1000) AS BIGINT) AS score_milli,
  array_to_string(list_filter([CASE WHEN regexp_matches(t, '[a-z0-9.]@[a-z0-9.]') THEN 'contact' END, CASE WHEN regexp_matches(t, '[0-9]{{3}}[ -][0-9]{{4}}') THEN 'phone' END, CASE WHEN regexp_matches(t, '(?i)license') THEN 'licence' END,
    CASE WHEN coalesce(source, '') = '' THEN 'no_company' END, CASE WHEN length(trim(coalesce(text, ''))) < 80 THEN 'thin_description' END], lambda x: x IS NOT NULL), ',') AS flags FROM d"""
)
def scam_style_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, flags = scam_columns()
    return table(spark, sf_dir, "documents").select("doc_id", F.round(score * 1000).cast("long").alias("score_milli"), F.array_join(flags, ",").alias("flags"))


VOCABULARY = {"high": ["the", "thing"], "mid": ["with", "und"], "soft": ["est", "por"], "hard": ["license"]}
TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9+#]+)', 1)"
FIT = """CASE WHEN list_contains(k, 'license') THEN 0.0 ELSE least(CASE WHEN high > 0 AND mid = 0 AND NOT (list_contains(k, 'of') OR list_contains(k, 'by')) THEN 30.0 ELSE 100.0 END,
    greatest(0.0, 10.0 + 25.0 * high + 12.0 * mid - 15.0 * soft)) END"""
COUNTS = """(list_contains(k, 'the')::INT + list_contains(k, 'thing')::INT) AS high, (list_contains(k, 'with')::INT + list_contains(k, 'und')::INT) AS mid, (list_contains(k, 'est')::INT + list_contains(k, 'por')::INT) AS soft"""


@query(f"WITH t AS (SELECT doc_id, {TOKENS} AS k FROM documents), c AS (SELECT doc_id, k, {COUNTS} FROM t) SELECT doc_id, CAST({FIT} AS DOUBLE) AS fit, list_contains(k, 'license') AS excluded FROM c")
def keyword_fit_anchor_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit, hard = gates.fit_score(text.tokens(F.coalesce("text", F.lit(""))), VOCABULARY, ["of", "by"])
    return table(spark, sf_dir, "documents").select("doc_id", fit.alias("fit"), hard.alias("excluded"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and verdict of each document by the gates in their order."""
    none = F.array().cast("array<string>")
    docs = table(spark, sf_dir, "documents").withColumn("_tokens", text.tokens(F.coalesce("text", F.lit(""))))
    score, _ = scam_columns()
    fit, hard = gates.fit_score(F.col("_tokens"), VOCABULARY, ["of", "by"])
    docs = docs.select("doc_id", "source", "text", (score >= 0.6).alias("scam"), fit.alias("fit"), hard.alias("hard"), gates.language_reasons(F.col("text"), ["fr"]).alias("language"))
    junk = quality.junk_reasons(F.lit("Rater of texts, remote"), F.lit(""), F.col("source"), F.lit(False), F.col("source") == "src3", ["src2"])
    where = F.when(F.col("source").isin(*PLACES), none).otherwise(F.array(F.lit("location:place")))
    return docs.select("doc_id", gates.verdict(F.col("scam"), junk, where, F.col("hard"), F.lit(None).cast("boolean"), F.col("language"), F.lit(None).cast("double"), F.col("fit")).alias("verdict"))


JUDGED = f"""d AS (SELECT doc_id, source, text, chr(10) || coalesce(text, '') AS t, {TOKENS} AS k FROM documents),
c AS (SELECT *, {COUNTS}, {sql_language('text')} AS language FROM d),
j AS (SELECT doc_id, CASE WHEN round(least({SCAM}, 1.0), 3) >= 0.6 THEN 'rejected_scam' WHEN source IN ('src2', 'src3') THEN 'rejected_quality' WHEN coalesce(source, '') NOT IN ('src0', 'src1', 'src2', 'src3') THEN 'rejected_location'
  WHEN list_contains(k, 'license') THEN 'rejected_irrelevant' WHEN language IN ('de', 'es') THEN 'rejected_ineligible' WHEN {FIT} < 32 THEN 'rejected_irrelevant' ELSE 'surfaced' END AS verdict FROM c)"""


@query(
    f"""WITH {JUDGED}, v(verdict) AS (VALUES {', '.join(f"('{v}')" for v in gates.VERDICTS)})
SELECT v.verdict, (SELECT count(*) FROM j WHERE j.verdict = v.verdict) AS n FROM v
UNION ALL SELECT 'accounted', (SELECT count(*) FROM j) UNION ALL SELECT 'unaccounted', 0"""
)
def verdict_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.verdict_ledger(judged(spark, sf_dir), "verdict", gates.VERDICTS)


@query(f"WITH {JUDGED}, f AS (SELECT verdict AS flag, count(*) AS n FROM j WHERE verdict LIKE 'rejected_%' GROUP BY 1) SELECT flag, n FROM f ORDER BY n DESC, flag LIMIT 4")
def reject_pile_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = judged(spark, sf_dir).where(F.col("verdict").like("rejected\\_%"))
    return ledger.top_flags(rejected.select(F.array("verdict").alias("flags")), "flags", 4)


@query(f"WITH {JUDGED} SELECT count(*) AS n_rows, md5(string_agg(doc_id || '=' || verdict, ',' ORDER BY doc_id)) AS digest FROM j")
def decision_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows give the same digest in any order. The SQL's MD5 runs over all lines in turn, so one task reads them, sorted and batch by batch; hashing.fingerprint() adds hashes instead."""
    line = F.concat(F.col("doc_id").cast("string"), F.lit("="), "verdict")
    lines = judged(spark, sf_dir).select("doc_id", line.alias("line")).repartition(1).sortWithinPartitions("doc_id", "line").select("line")
    found = lines.mapInArrow(hashing.joined_md5, "n_rows long, digest string")
    return found.agg(F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.max("digest"), F.md5(F.lit(b""))).alias("digest"))


LANES = ", ".join(f"coalesce(sum(('0x' || substr(h, {4 * i + 1}, 4))::BIGINT), 0)::BIGINT" for i in range(16))


@query(f"WITH {JUDGED}, h AS (SELECT sha256(doc_id || chr(31) || verdict) AS h FROM j) SELECT count(*) AS n_rows, sha256(array_to_string([{LANES}], ',')) AS fingerprint FROM h")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.fingerprint(judged(spark, sf_dir), "doc_id", "verdict")


@query(None)
def phrase_window_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gates.phrases_in(text.tokens(F.col("text")), ["the thing of", "license released", "reading with"])
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("phrases"))


def sql_unescaped(c: str) -> str:
    """The rule of text.unescaped() over a column, with a map of all named references."""
    names = "MAP {" + ", ".join(f"'{n}': chr({k})" for n, k in sorted(name2codepoint.items())) + "}"
    rest = "regexp_replace(p, '^[^;]*;', '')"
    decimal, hexadecimal, name = "^#([0-9]{1,7});", "^#[xX]([0-9a-fA-F]{1,6});", "^([A-Za-z][A-Za-z0-9]*);"
    one = f"""CASE WHEN regexp_matches(p, '{decimal}') THEN chr(regexp_extract(p, '{decimal}', 1)::INT) || {rest} WHEN regexp_matches(p, '{hexadecimal}') THEN chr(('0x' || regexp_extract(p, '{hexadecimal}', 1))::INT) || {rest}
      ELSE coalesce({names}[regexp_extract(p, '{name}', 1)] || {rest}, '&' || p) END"""
    return f"(string_split({c}, '&')[1] || array_to_string(list_transform(string_split({c}, '&')[2:], lambda p: {one}), ''))"


TAGS = [("(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "' '"), ("(?i)<li[^>]*>", "chr(10) || '- '"), ("(?i)<(br|/p|/div|/h[1-6]|/tr|/ul|/ol)[^>]*>", "chr(10)"), ("<[^>]*>", "' '")]
HTML = sql_unescaped("html")
for _pattern, _with in TAGS:
    HTML = f"regexp_replace({HTML}, '{_pattern}', {_with}, 'g')"
HTML = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({HTML}, '\\r\\n?', chr(10), 'g'), '{text.HIDDEN}', '', 'g'), '{text.BLANKS}', ' ', 'g'), '[\\x00-\\x09\\x0b-\\x1f\\x7f]', '', 'g')"
HTML = f"trim(regexp_replace(regexp_replace(regexp_replace({HTML}, ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), ' ' || chr(10))"


@query(f"SELECT page_id, length(x) AS n, md5(x) AS digest FROM (SELECT page_id, {HTML} AS x FROM pages)")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("x"))
    return plain.select("page_id", F.length("x").cast("long").alias("n"), F.md5(F.col("x").cast("binary")).alias("digest"))


AUTHORITY = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
URL_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def sql_pairs(dropped: tuple[str, ...]) -> str:
    name = "lower(regexp_extract(p, '^([^=]*)', 1))"
    return f"array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with({name}, 'utm_') AND NOT list_contains({listed(list(dropped))}, {name})), '&')"


@query(
    f"""WITH u AS (SELECT page_id, url, {SCHEME} AS s, {AUTHORITY} AS a, {URL_PATH} AS p, {sql_pairs(urls.TRACKING)} AS q, {sql_pairs(urls.TRACKING + urls.SECRET)} AS q2, regexp_extract(url, '^[^#]*#(.*)$', 1) AS f FROM pages)
SELECT page_id, CASE WHEN s IN ('http', 'https') AND a <> '' THEN (CASE WHEN s = 'https' THEN '' ELSE 'http://' END) || a || (CASE WHEN p = '/' THEN '' ELSE p END) || (CASE WHEN q <> '' THEN '?' || q ELSE '' END) || (CASE WHEN f <> '' THEN '#' || f ELSE '' END)
  ELSE 'opaque:' || coalesce(url, '') END AS root, CASE WHEN s IN ('http', 'https') AND a <> '' THEN s || '://' || a || (CASE WHEN p = '' THEN '/' ELSE p END) || (CASE WHEN q2 <> '' THEN '?' || q2 ELSE '' END) ELSE '' END AS shown FROM u"""
)
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.root(F.col("url")).alias("root"), urls.sanitized(F.col("url")).alias("shown"))


TIERS = [("example.com", "employer", 0.8), ("example.org", "board", 0.5)]


@query(
    f"""WITH u AS (SELECT page_id, string_split(regexp_replace({AUTHORITY}, ':[0-9]*$', ''), '.') AS h FROM pages), d AS (SELECT page_id, array_to_string(list_slice(h, -2, -1), '.') AS domain FROM u)
SELECT page_id, CASE domain WHEN 'example.com' THEN 'employer' WHEN 'example.org' THEN 'board' ELSE 'unknown' END AS tier, CASE domain WHEN 'example.com' THEN 0.8 WHEN 'example.org' THEN 0.5 END::DOUBLE AS prior FROM d"""
)
def domain_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = spark.createDataFrame(TIERS, "domain string, tier string, prior double")
    return gates.domain_tier(table(spark, sf_dir, "pages").select("page_id", "url"), "url", tiers).select("page_id", "tier", "prior")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY source = 'src0' DESC, n_chars DESC, doc_id) AS n FROM documents),
g AS (SELECT md5(text) AS identity, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(*) AS copies FROM documents GROUP BY 1)
SELECT doc_id, r.source, g.identity, sources, copies FROM r JOIN g ON md5(text) = g.identity WHERE n = 1"""
)
def dedupe_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("identity_"))
    out = entities.deduplicated(docs, F.col("identity_"), [F.col("source") == "src0", F.col("n_chars"), -F.col("doc_id")], "source", F.col("doc_id").cast("string"))
    return out.select("doc_id", "source", "identity", F.array_join("sources", ",").alias("sources"), "copies")


@query(
    """WITH r AS (SELECT source, doc_id, text, lang, quality, toxic, n_chars FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, arg_max(md5(text), n_chars * 1000000 + doc_id) FILTER (lang <> 'en') AS body, arg_max(quality, doc_id) FILTER (quality IS NOT NULL) AS quality, arg_max(toxic, doc_id) FILTER (quality = 1) AS toxic, count(*) AS observations FROM r GROUP BY source"""
)
def canonical_field_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("body", F.md5(F.col("text").cast("binary"))).drop("text")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("rank", F.col("n_chars") * 1000000 + F.col("doc_id"))
    body = entities.filled(rows, "source", [F.col("rank")], {"body": F.col("lang") != "en"})
    rest = entities.filled(rows, "source", [F.col("doc_id")], {"quality": F.lit(True), "toxic": F.col("quality") == 1}).drop("observations")
    return body.join(rest, "source").select("source", "body", "quality", "toxic", "observations")


@query("SELECT doc_id, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 40")
def round_robin_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return ranking.round_robin(docs, "source", [F.desc("n_chars"), F.col("doc_id")], 40).select("doc_id", "turn")


@query(
    """WITH a AS (SELECT * FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN lang || '!' ELSE lang END AS lang FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.lang || a.text IS NOT DISTINCT FROM b.lang || b.text THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id"""
)
def audit_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two audits made of one table: which ids are in which is part of the question."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    before = docs.where("doc_id % 7 <> 0")
    after = docs.where("doc_id % 11 <> 0").withColumn("lang", F.when(F.col("doc_id") % 5 == 0, F.concat("lang", F.lit("!"))).otherwise(F.col("lang")))
    return joins.compared(before, after, "doc_id", F.concat("lang", "text"))


@query("SELECT source || '/' || lang AS label, 'before' AS side FROM documents WHERE n_chars > 4000 EXCEPT SELECT source || '/' || lang, 'before' FROM documents WHERE n_chars < 300")
def surface_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("n_chars", F.concat("source", F.lit("/"), "lang").alias("label"))
    return docs.where("n_chars > 4000").select("label").subtract(docs.where("n_chars < 300").select("label")).withColumn("side", F.lit("before"))


@query(
    """WITH c AS (SELECT conv_id, max(turn) AS last_turn, max(CASE WHEN regexp_matches(text, '\\bde\\b') THEN turn END) AS closed, max(CASE WHEN regexp_matches(text, '\\b(the|der)\\b') THEN turn END) AS opened,
  max(CASE WHEN regexp_matches(text, '\\bde\\b') AND regexp_matches(text, '\\b(the|der)\\b') THEN 1 ELSE 0 END) AS both_, count(*) AS posts FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN both_ = 1 THEN 'unclear' WHEN closed IS NOT NULL AND (opened IS NULL OR closed > opened) THEN 'closed' ELSE 'open' END AS state, posts FROM c"""
)
def thread_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import history

    posts = table(spark, sf_dir, "conversations")
    return history.thread_state(posts, "conv_id", "turn", F.col("text").rlike("\\b(the|der)\\b"), F.col("text").rlike("\\bde\\b"))


@query(
    """WITH s AS (SELECT conv_id, turn, role, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS hi, length(text) AS n FROM conversations), p AS (SELECT conv_id, turn, hi - n AS lo, hi FROM s),
q AS (SELECT conv_id, unnest([100, 500, 1500]) AS start_at FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT q.conv_id, q.start_at, p.turn FROM q JOIN p ON q.conv_id = p.conv_id AND q.start_at >= p.lo AND q.start_at + 20 <= p.hi"""
)
def interval_span_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    posts = table(spark, sf_dir, "conversations")
    hi = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    spans = posts.select("conv_id", "turn", (hi - F.length("text")).alias("lo"), hi.alias("hi"))
    asked = posts.select("conv_id").distinct().select("conv_id", F.explode(F.array(F.lit(100), F.lit(500), F.lit(1500))).alias("start_at")).withColumn("end_at", F.col("start_at") + 20)
    return joins.contained(asked, spans, ["conv_id"], "lo", "hi", "start_at", "end_at", 1000).select("conv_id", "start_at", "turn")


@query(
    """WITH RECURSIVE e AS (SELECT doc_id AS a, doc_id // 3 AS b FROM documents WHERE doc_id % 4 <> 0 AND doc_id // 3 <> doc_id), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, w.b FROM r JOIN w ON w.a = r.other)
SELECT doc_id, min(other) AS component FROM r GROUP BY doc_id"""
)
def lineage_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an invented parent: a tree whose accepted edges leave several components."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array(F.expr("doc_id div 3")).alias("parents"))
    edges = entities.lineage_edges(docs, "doc_id", "parents", F.col("doc_id") % 4 != 0).where("a <> b")
    return entities.components(docs, edges, "doc_id")


@query(
    f"""WITH d AS (SELECT doc_id, n_chars, source, CASE WHEN source = 'src0' THEN 'employer' WHEN source = 'src1' THEN 'farm' ELSE 'unknown' END AS tier FROM documents)
SELECT doc_id, CASE WHEN tier = 'farm' THEN 100 ELSE CAST(round(1000 * least(1.0, greatest(0.0, CASE WHEN tier = 'employer' THEN 0.8 ELSE 0.5 END + CASE WHEN n_chars % 2 = 0 THEN 0.15 ELSE 0.0 END - CASE WHEN n_chars < 200 THEN 0.1 ELSE 0.0 END
   + CASE WHEN doc_id % 60 < 30 THEN 0.1 ELSE 0.0 END))) AS BIGINT) END AS confidence_milli FROM d"""
)
def listing_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    tier = F.when(F.col("source") == "src0", "employer").when(F.col("source") == "src1", "farm").otherwise("unknown")
    value = F.when(F.col("source") == "src0", 0.8).when(F.col("source") == "src1", 0.1)
    c = scoring.listing_confidence(tier, value, F.lit(False), F.col("n_chars") % 2 == 0, F.lit(1), F.col("doc_id") % 60, F.col("n_chars"))
    return docs.select("doc_id", F.round(c * 1000).cast("long").alias("confidence_milli"))
