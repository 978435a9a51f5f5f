"""Queries over orders, line items, events, parts and suppliers for policy, ledgers, lookups, checks and selections, each with its SQL or a reason for none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, scoring, text
from ..operators import checks, entities, evidence, gates, history, joins, ledger, observations, outcomes, policy, quality, ranking, state
from ..sources import readers
from .event_queries import events
from .registry import query, table

def no_reasons() -> F.Column:
    return F.array().cast("array<string>")


def pick(values: list, index: F.Column) -> F.Column:
    return F.get(F.array(*[v if isinstance(v, F.Column) else F.lit(v) for v in values]), index.cast("int"))


# ------------------------------------------------------------- gates and policy
@query(
    """SELECT p_partkey, least(CASE WHEN split_part(p_name, ' ', 1) = 'small' THEN 40.0 ELSE 100.0 END, CASE WHEN split_part(p_name, ' ', 2) = 'ring' THEN 55.0 ELSE 100.0 END, greatest(0.0, p_size * 2.0 + CASE WHEN split_part(p_name, ' ', 1) = 'small' THEN -10.0 ELSE 0.0 END + CASE WHEN split_part(p_name, ' ', 2) = 'ring' THEN -25.0 ELSE 0.0 END + CASE WHEN split_part(p_name, ' ', 1) = 'large' THEN 15.0 ELSE 0.0 END))::DOUBLE AS fit FROM part"""
)
def title_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"small": (r"\bsmall\b", -10.0, 40.0), "ring": (r"\bring\b", -25.0, 55.0), "large": (r"\blarge\b", 15.0, None)}
    return table(spark, sf_dir, "part").select("p_partkey", gates.title_adjusted(F.col("p_size") * 2.0, F.col("p_name"), rules).alias("fit"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'location:onsite' WHEN c_mktsegment = 'BUILDING' OR c_custkey % 4 = 1 THEN '' ELSE 'location:place' END AS reasons FROM customer"""
)
def location_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("c_custkey") % 4 == 0, "This is onsite only.").otherwise("Work.")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(gates.location_reasons(F.col("c_mktsegment"), body, F.col("c_custkey") % 4 == 1, ["building"]), ",").alias("reasons"))


@query(
    """WITH r AS (SELECT l_orderkey AS id, l_linenumber % 2 AS method, CASE WHEN l_returnflag = 'R' THEN 'unknown' WHEN l_linenumber = 3 THEN CASE WHEN l_quantity > 25 THEN 'compatible' ELSE 'infeasible' END WHEN l_quantity >= 25 THEN 'compatible' ELSE 'infeasible' END AS s FROM lineitem),
m AS (SELECT id, method, bool_and(s = 'compatible') AS all_, bool_and(s = 'infeasible') AS none_ FROM r GROUP BY 1, 2)
SELECT id AS l_orderkey, CASE WHEN bool_or(all_) THEN 'compatible' WHEN bool_and(none_) THEN 'infeasible' ELSE 'unknown' END AS payout FROM m GROUP BY id"""
)
def payout_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 2).alias("method"), F.col("l_quantity").cast("decimal(12,2)").alias("amount"), F.lit("USD").alias("currency"), F.lit(25).cast("decimal(12,2)").alias("minimum"), F.when(F.col("l_returnflag") == "R", "EUR").otherwise("USD").alias("minimum_currency"), (F.col("l_linenumber") == 3).alias("strict"))
    return policy.payout(r, "l_orderkey")


@query(
    """WITH r AS (SELECT user_id AS device, CASE WHEN user_id % 11 <> 0 THEN ts::DATE END AS d, CASE WHEN event_type <> 'signup' THEN event_type IN ('view', 'purchase') END AS ok FROM events WHERE ts < TIMESTAMP '2024-01-21 00:00:00' OR user_id % 11 = 0),
l AS (SELECT device, max(d) AS last FROM r GROUP BY 1), k AS (SELECT r.* FROM r JOIN l USING (device) WHERE d IS NULL OR d = last),
s AS (SELECT device, CASE WHEN bool_or(d IS NULL OR ok IS NULL) THEN 'unknown' WHEN count(DISTINCT ok) > 1 THEN 'conflict' WHEN bool_or(ok) THEN 'available' ELSE 'unavailable' END AS state FROM k GROUP BY 1),
c AS (SELECT c_custkey, c_custkey % 200 AS device, ['required', 'negated', 'preferred'][1 + c_custkey % 3] AS m FROM customer)
SELECT c_custkey, CASE m WHEN 'negated' THEN 'not_required' WHEN 'preferred' THEN 'preferred' ELSE CASE state WHEN 'available' THEN 'supported' WHEN 'unavailable' THEN 'unmet' ELSE coalesce(state, 'unknown') END END AS outcome FROM c LEFT JOIN s USING (device)"""
)
def equipment_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    records = e.select(F.col("user_id").alias("device"), F.when(F.col("user_id") % 11 != 0, F.to_date("ts")).alias("event_date"), F.when(F.col("event_type") != "signup", F.col("event_type").isin("view", "purchase")).alias("available"))
    claims = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 200).alias("device"), pick(["required", "negated", "preferred"], F.col("c_custkey") % 3).alias("modality"))
    owned = policy.inventory(records, "device", F.lit("2024-01-20").cast("date"))
    return policy.equipment(claims, owned, "device").select("c_custkey", "outcome")


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderdate AS d, o_custkey AS c, date_diff('day', o_orderdate, TIMESTAMP '2001-08-02 00:00:00') AS age FROM orders)
SELECT k AS o_orderkey, CASE WHEN s = 'F' AND c % 10 = 0 THEN 'closed' WHEN c % 7 = 0 AND age >= 0 THEN 'closed' WHEN c % 11 = 0 THEN 'watch' WHEN c % 13 = 0 THEN 'watch' WHEN c % 17 = 0 THEN 'watch' WHEN c % 3 = 2 AND age > 14 THEN 'watch' WHEN s <> 'P' AND age > 30 THEN 'watch' ELSE 'active' END AS lifecycle,
  CASE WHEN s = 'F' AND c % 10 = 0 THEN 'matching_source_closed' WHEN c % 7 = 0 AND age >= 0 THEN 'deadline_elapsed' WHEN c % 11 = 0 THEN 'account_block' WHEN c % 13 = 0 THEN 'already_applied' WHEN c % 17 = 0 THEN 'pool_not_work' WHEN c % 3 = 2 AND age > 14 THEN 'verification_exhausted' WHEN s <> 'P' AND age > 30 THEN 'stale_copy' END AS reason FROM o"""
)
def lifecycle_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, day = F.col("o_custkey"), F.col("o_orderdate").cast("timestamp")
    o = table(spark, sf_dir, "orders").withColumns(
        {
            "closed": (F.col("o_orderstatus") == "F") & (c % 10 == 0), "deadline": F.when(c % 7 == 0, day), "blocked": c % 11 == 0, "applied": c % 13 == 0, "pool": c % 17 == 0, "cycles": c % 3, "first_failed": F.lit(None).cast("timestamp"),
            "posted": day, "authoritative": F.col("o_orderstatus") == "P", "complete": F.lit(True), "verified_open": F.lit(None).cast("timestamp"), "route": F.lit(True),
        }
    )
    return policy.lifecycle(o, F.expr("TIMESTAMP '2001-08-02 00:00:00'")).select("o_orderkey", "lifecycle", "reason")


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderdate AS d, o_custkey % 5 AS tasks, date_diff('minute', TIMESTAMP '2001-07-31 00:00:00', o_orderdate) AS left_, CASE WHEN o_custkey % 4 > 0 THEN (o_custkey % 4) * 600.0 END AS need FROM orders)
SELECT k AS o_orderkey, CASE WHEN s = 'F' THEN 'reject' WHEN tasks = 0 AND s = 'O' THEN 'primary' ELSE 'verify' END AS band, CASE WHEN left_ <= 0 THEN 'elapsed' WHEN need IS NULL THEN 'unknown' WHEN left_ < need THEN 'infeasible' WHEN left_ <= 1440 AND tasks = 0 THEN 'urgent' ELSE 'feasible' END AS urgency FROM o"""
)
def action_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = F.slice(F.array(*[F.lit(str(i)) for i in range(4)]), F.lit(1), (F.col("o_custkey") % 5).cast("int"))
    terminal = F.when(F.col("o_orderstatus") == "F", "scam")
    band = policy.action_band(terminal, F.lit("passed"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("watch"), tasks, F.lit(False))
    need = F.when(F.col("o_custkey") % 4 > 0, (F.col("o_custkey") % 4) * 600.0)
    urgency = policy.urgency(F.col("o_orderdate").cast("timestamp"), F.expr("TIMESTAMP '2001-07-31 00:00:00'"), need, F.lit(0.0), tasks)
    return table(spark, sf_dir, "orders").select("o_orderkey", band.alias("band"), urgency.alias("urgency"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN 'unknown' WHEN l_returnflag = 'R' THEN 'conflicted' WHEN l_quantity < 10 THEN 'below_floor' WHEN l_linenumber = 2 THEN 'budget_known' WHEN l_linenumber = 3 THEN 'up_to_only' WHEN l_discount < 0.03 THEN 'known_unverified' WHEN l_linenumber = 4 THEN 'credible_salary' ELSE 'credible_hourly' END AS state FROM lineitem"""
)
def pay_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    chosen = F.struct(F.when(n == 1, "unknown").when(n == 2, "fixed").when(n == 4, "year").otherwise("hour").alias("basis"), (n == 3).alias("up_to"))
    rows = table(spark, sf_dir, "lineitem").withColumn("chosen", chosen)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", policy.pay_state("chosen", F.col("l_returnflag") == "R", F.col("l_quantity") < 10, F.col("l_discount"), 0.03).alias("state"))


@query(
    """WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size FROM part)
SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN NULL WHEN a IN ('red', 'blue') THEN 'colour' WHEN b = 'ring' THEN 'ring' WHEN b = 'bolt' THEN 'fastener' END AS domain,
  CASE WHEN p_size % 9 = 0 THEN 'none' WHEN a IN ('red', 'blue') THEN 'unclaimed' WHEN b = 'ring' THEN 'claimed' WHEN b = 'bolt' THEN 'unclaimed' ELSE 'none' END AS status, CASE WHEN b IN ('bolt', 'rod') THEN 'metal' WHEN b = 'plate' THEN 'flat' ELSE 'other' END AS family FROM p"""
)
def specialists(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = policy.specialist(F.col("p_name"), {"colour": ["red", "blue", "red ring"], "ring": ["ring"], "fastener": ["bolt"]}, ["ring"], F.col("p_size") % 9 == 0)
    family = policy.occupation(F.col("p_name"), {"metal": "bolt|rod", "flat": "plate"})
    return table(spark, sf_dir, "part").select("p_partkey", s.alias("s"), family.alias("family")).select("p_partkey", "s.domain", "s.status", "family")


@query(
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'lang_mismatch:fr' WHEN 1 THEN '' ELSE 'lang_mismatch:de,lang_mismatch:fr' END AS language, CASE WHEN c_custkey % 4 = 0 THEN 'location_scope_mismatch:in_excluded' WHEN c_custkey % 4 = 1 THEN '' WHEN c_custkey % 4 = 2 THEN 'location_scope_mismatch:de,location_scope_mismatch:us' ELSE '' END AS place,
  CASE c_custkey % 3 WHEN 0 THEN 'experience_mismatch:7_years,experience_mismatch:4.5_years' ELSE '' END AS years FROM customer"""
)
def mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text_array = lambda *v: F.array(*[F.lit(x) for x in v])
    spoken = text_array("en")
    needed = F.when(k % 3 == 0, text_array("fr", "en")).when(k % 3 == 1, text_array("en", "fr")).otherwise(text_array("fr", "de"))
    scopes = F.when(k % 4 == 0, text_array("in", "us")).when(k % 4 == 1, text_array("de", "in")).when(k % 4 == 2, text_array("us", "de")).otherwise(no_reasons())
    years = F.when(k % 3 == 0, F.array(F.lit(4.5), F.lit(7.0), F.lit(2.0))).otherwise(F.array(F.lit(1.0)))
    line = lambda c: F.array_join(c, ",")
    return table(spark, sf_dir, "customer").select("c_custkey", line(policy.language_mismatches(needed, spoken, k % 3 == 1)).alias("language"), line(policy.location_mismatches(scopes, k % 4 == 0, "in", ["in"])).alias("place"), line(policy.experience_mismatches(years, 4.0)).alias("years"))


@query(
    """WITH p AS (SELECT p_partkey AS k, p_name, p_brand, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT x.k AS p_partkey, CASE WHEN x.p_brand <> y.p_brand THEN 'conflict' WHEN x.a <> y.a AND x.b <> y.b THEN 'conflict' WHEN x.k % 2 = 0 THEN 'exact' WHEN x.p_name = y.p_name THEN 'corroborated' ELSE 'uncertain' END AS same FROM p x JOIN p y ON y.k = x.k + 1"""
)
def listing_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    side = lambda c: F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.lit("remote").alias("location")).alias(c)
    left = p.select("p_partkey", side("old"))
    right = p.select((F.col("p_partkey") - 1).alias("p_partkey"), side("new"))
    both = left.join(right, "p_partkey").withColumn("new", F.col("new").withField("id", F.col("old.id")))
    return both.select("p_partkey", policy.same_listing("old", "new", ["english"], ["india"]).alias("same"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'scam' WHEN event_type = 'click' AND value > 300 THEN 'pay' WHEN event_type = 'click' THEN 'deadline' WHEN value > 400 THEN 'pay' END AS terminal, CASE WHEN user_id % 3 = 0 THEN event_type IN ('view', 'click') ELSE event_type <> 'signup' END AS covered FROM events"""
)
def terminal_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    blockers = F.array_compact(F.array(F.when(F.col("value") > 400, F.lit("pay")), F.when(F.col("event_type") == "error", F.lit("scam")), F.when((F.col("event_type") == "click") & (F.col("value") > 300), F.lit("pay")), F.when((F.col("event_type") == "click") & (F.col("value") <= 300), F.lit("deadline"))))
    out = gates.decided(e.withColumn("blockers", blockers), "blockers", ["scam", "deadline", "pay"])
    needed = F.array(F.col("event_type"), F.when(F.col("user_id") % 3 == 0, "view").otherwise(F.col("event_type")))
    spoken = F.array(*[F.lit(x) for x in ("view", "click", "purchase", "error")])
    pairs = gates.language_pairs(needed, F.when(F.col("user_id") % 3 == 0, F.array(F.lit("view"), F.lit("click"))).otherwise(spoken), F.lit(True))
    return out.select("event_id", "terminal", pairs.alias("covered"))


@query(
    """WITH s AS (SELECT s_suppkey, least(1.0, greatest(0.0, s_acctbal / 8192)) AS t FROM supplier)
SELECT s_suppkey, CAST(round(1e4 * round(0.30 * t + 0.25 * 0.5 + 0.20 * 0.25 + 0.15 * 1.0 + 0.10 * 0.0, 4)) AS BIGINT) AS trust_e4, CAST(round(1e4 * greatest(0.0, t - 0.5 * (1 - 0.75))) AS BIGINT) AS careful_e4, CASE WHEN s_suppkey % 3 = 2 OR (s_suppkey % 2 = 0 AND s_suppkey % 3 >= 1) THEN 'strong' WHEN s_suppkey % 3 = 1 OR s_suppkey % 2 = 0 THEN 'medium' ELSE 'weak' END AS strength FROM s"""
)
def trust_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s_acctbal") / 8192))
    whole = scoring.composite({"payment": t, "clarity": F.lit(0.5), "support": F.lit(0.25), "volume": F.lit(1.0), "tenure": F.lit(0.0)})
    concepts = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("s_suppkey") % 3).cast("int"))
    e4 = lambda c: F.round(1e4 * c).cast("long")
    return table(spark, sf_dir, "supplier").select("s_suppkey", e4(whole).alias("trust_e4"), e4(scoring.conservative_trust(t, F.lit(0.75), F.lit(0.5))).alias("careful_e4"), scoring.match_strength(concepts, F.col("s_suppkey") % 2 == 0).alias("strength"))


# ------------------------------------------------------------- evidence
@query(
    """WITH c AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS p, CASE WHEN l_linenumber % 2 = 0 THEN 'hour' ELSE 'year' END AS basis, l_quantity AS low, l_quantity + l_linenumber % 3 AS high, l_discount * 10 AS conf, l_returnflag AS prov, l_linestatus = 'F' AS est, l_linenumber = 5 AS up FROM lineitem),
k AS (SELECT *, (SELECT count(DISTINCT x.prov) > 1 FROM c x WHERE x.id = c.id AND x.basis = c.basis AND x.low = c.low AND x.high = c.high) AS several FROM c),
s AS (SELECT *, least(1.0, conf * CASE prov WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.75 ELSE 0.5 END * CASE WHEN est THEN 0.8 ELSE 1.0 END * CASE WHEN up THEN 0.72 ELSE 1.0 END * CASE WHEN several THEN 1.08 ELSE 1.0 END) AS cred FROM k)
SELECT id AS l_orderkey, arg_min(p, (-cred, high - low, low, lpad(p::VARCHAR, 9, '0') || '-' || n)) AS l_partkey, CAST(round(1e6 * max(cred)) AS BIGINT) AS credibility_micro FROM s GROUP BY id"""
)
def selected_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.when(n % 2 == 0, "hour").otherwise("year").alias("basis"), F.col("l_quantity").alias("low"), (F.col("l_quantity") + n % 3).alias("high"), (F.col("l_discount") * 10).alias("confidence"), "l_returnflag", (F.col("l_linestatus") == "F").alias("estimate"), (n == 5).alias("up_to"), F.concat(F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lit("-"), n.cast("string")).alias("quote"))
    out = evidence.selected_pay(c, "l_orderkey", "l_returnflag", {"A": 1.0, "N": 0.75})
    return out.select("l_orderkey", "l_partkey", F.round(1e6 * F.col("credibility")).cast("long").alias("credibility_micro"))


@query(
    """WITH c AS (SELECT l_orderkey AS id, l_linenumber % 3 AS g, l_suppkey % 9 AS name FROM lineitem), e AS (SELECT id, g, bool_or(coalesce(name IN (0, 1, 2), false)) AS met, bool_or(name NOT IN (0, 1, 2, 3, 4, 5)) AS open, array_to_string(list_sort(list_distinct(list('n' || name))), '/') AS names FROM c GROUP BY 1, 2)
SELECT id AS l_orderkey, coalesce(array_to_string(list_sort(list_distinct(list(names) FILTER (NOT met AND NOT open))), ','), '') AS blockers, coalesce(array_to_string(list_sort(list_distinct(list(names) FILTER (NOT met AND open))), ','), '') AS unverified,
  CASE WHEN count(*) FILTER (NOT met AND NOT open) > 0 THEN 'failed' WHEN count(*) FILTER (NOT met AND open) > 0 THEN 'unknown' ELSE 'passed' END AS status FROM e GROUP BY id"""
)
def requirement_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("n"), (F.col("l_suppkey") % 9).cast("string"))
    claims = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("group_"), name.alias("name"), F.lit(True).alias("needed"))
    known = spark.range(6).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), (F.col("id") < 3).alias("has"))
    out = evidence.requirement_outcomes(claims, "l_orderkey", "group_", known)
    return out.select("l_orderkey", F.array_join("blockers", ",").alias("blockers"), F.array_join("unverified", ",").alias("unverified"), "status")


@query(
    """SELECT l_orderkey, coalesce(array_to_string(list_sort(list_distinct(list('n' || (l_suppkey % 9)) FILTER (l_returnflag = 'A'))), ','), '') AS required, coalesce(array_to_string(list_sort(list_distinct(list('n' || (l_suppkey % 9)) FILTER (l_returnflag = 'N'))), ','), '') AS preferred, min(l_quantity) AS least_years, max(l_quantity) AS most_years,
  CASE WHEN bool_or(l_linenumber > 5) THEN 'complete' WHEN bool_or(l_linenumber > 2) THEN 'partial' ELSE 'unknown' END AS completeness FROM lineitem GROUP BY l_orderkey"""
)
def requirements_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    modality = F.when(F.col("l_returnflag") == "A", "required").when(F.col("l_returnflag") == "N", "preferred").otherwise("mentioned")
    grade = F.when(F.col("l_linenumber") > 5, "complete").when(F.col("l_linenumber") > 2, "partial").otherwise("unknown")
    claims = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("n"), (F.col("l_suppkey") % 9).cast("string")).alias("name"), modality.alias("modality"), F.col("l_quantity").alias("years"), grade.alias("completeness"))
    out = policy.requirements_rollup(claims, "l_orderkey")
    return out.select("l_orderkey", F.array_join("required", ",").alias("required"), F.array_join("preferred", ",").alias("preferred"), "least_years", "most_years", "completeness")


@query(
    """WITH t(concept, term) AS (VALUES ('small', 'small'), ('ring', 'ring'), ('ring', 'blue ring'), ('type', 'economy')), h AS (SELECT p_partkey, concept, term, CASE WHEN ' ' || p_name || ' ' LIKE '% ' || term || ' %' THEN 0 WHEN ' ' || lower(p_type) || ' ' LIKE '% ' || term || ' %' THEN 1 END AS turn FROM part, t)
SELECT p_partkey, concept, CASE min(turn) WHEN 0 THEN 'p_name' ELSE 'p_type' END AS field, arg_min(term, (turn, -length(term))) AS term FROM h WHERE turn IS NOT NULL GROUP BY 1, 2"""
)
def concept_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.concepts(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_type"], {"small": ["small"], "ring": ["ring", "blue ring"], "type": ["economy"]})


@query(
    """WITH m AS (SELECT page_id, ['We work from home', 'A hybrid team', 'In the office', 'Hybrid or on-site', 'A team'][1 + page_id % 5] AS body FROM pages)
SELECT page_id, ['remote', 'hybrid', 'onsite', 'conflicting', 'unknown'][1 + page_id % 5] AS place, CASE page_id % 3 WHEN 0 THEN 'requirements=a|b' WHEN 1 THEN 'other=a|b' ELSE 'benefits=b;other=x' END AS parts, CASE WHEN page_id % 2 = 0 THEN '3.0-5.0' ELSE '4.0-4.0' END AS years FROM m"""
)
def text_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    place = evidence.work_arrangement(pick(["We work from home", "A hybrid team", "In the office", "Hybrid or on-site", "A team"], k % 5))
    body = pick(["Requirements:\na\nb", "a\nb", "x\n## Benefits\nb"], k % 3)
    found = F.map_entries(evidence.sections(body))
    parts = F.array_join(F.transform(F.array_sort(found), lambda e: F.concat(e["key"], F.lit("="), F.replace(e["value"], F.lit("\n"), F.lit("|")))), ";")
    years = F.get(evidence.experience_claims(F.when(k % 2 == 0, "You have 3 to 5 years. Fine.").otherwise("4+ years of work")), F.lit(0))
    return table(spark, sf_dir, "pages").select("page_id", place.alias("place"), parts.alias("parts"), F.concat_ws("-", years["low"].cast("string"), years["high"].cast("string")).alias("years"))


# ------------------------------------------------------------- lookups and state
@query("SELECT c_custkey, CASE WHEN n > 1 THEN 'held' WHEN n = 1 THEN 'mapped' ELSE 'own' END AS status, CASE WHEN n IS NULL THEN c_custkey WHEN n = 1 THEN t END AS target FROM customer LEFT JOIN (SELECT o_custkey AS old, count(DISTINCT o_orderkey % 50) AS n, min(o_orderkey % 50) AS t FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a ON old = c_custkey")
def resolved_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("old_id"), (F.col("o_orderkey") % 50).alias("new_id"))
    return joins.resolved_aliases(table(spark, sf_dir, "customer").select("c_custkey"), aliases, "c_custkey").select("c_custkey", "status", "target")


@query(
    """WITH s AS (SELECT o_orderkey, o_custkey AS c, o_orderstatus AS st FROM orders WHERE o_orderkey % 5 = 0), r AS (SELECT c_custkey, c_nationkey AS key FROM customer),
f AS (SELECT r.c_custkey, st FROM r JOIN s ON s.c = r.c_custkey UNION SELECT r.c_custkey, st FROM r JOIN s ON r.c_custkey = s.c + 1)
SELECT c_custkey, coalesce(array_to_string(list_sort(list(st)), ','), '') AS states FROM r LEFT JOIN f USING (c_custkey) GROUP BY c_custkey"""
)
def attached_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.array("c_custkey").alias("ids"))
    states = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select((F.col("o_custkey") + 1).alias("key"), F.array("o_custkey").alias("parents"), "o_orderstatus")
    out = joins.attached(rows, states, "ids", "key", "parents", "o_orderstatus")
    return out.select(F.col("key").alias("c_custkey"), F.coalesce(F.array_join("states", ","), F.lit("")).alias("states"))


@query(
    """WITH k AS (SELECT n_nationkey AS field, (n_nationkey % 7)::DOUBLE AS years FROM nation WHERE n_nationkey < 20), c AS (SELECT s_suppkey, s_nationkey AS a, (s_nationkey + 3) % 25 AS b, s_suppkey % 2 = 0 AS all_ FROM supplier)
SELECT s_suppkey, CASE WHEN all_ THEN least(coalesce(x.years, 0), coalesce(y.years, 0)) ELSE greatest(x.years, y.years) END AS years FROM c LEFT JOIN k x ON x.field = a LEFT JOIN k y ON y.field = b"""
)
def fields_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("field"), (F.col("n_nationkey") % 7).cast("double").alias("years"))
    claims = table(spark, sf_dir, "supplier").select("s_suppkey", F.array("s_nationkey", (F.col("s_nationkey") + 3) % 25).alias("fields"), F.when(F.col("s_suppkey") % 2 == 0, "all").otherwise("any").alias("how"))
    return joins.fields_needed(claims, known, "s_suppkey", "fields", "how").select("s_suppkey", "years")


@query(
    """WITH old AS (SELECT o_orderkey AS k, o_orderdate AS f, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS k, o_orderdate - INTERVAL 1 DAY * (o_orderkey % 2) + INTERVAL 2 DAY * (1 - o_orderkey % 2) AS f, o_totalprice + 1 AS v FROM orders WHERE o_orderkey % 4 <> 1)
SELECT coalesce(n.k, o.k) AS o_orderkey, epoch_us(CASE WHEN n.k IS NULL THEN o.f ELSE least(n.f, coalesce(o.f, n.f)) END) AS first_seen, coalesce(n.v, o.v) AS value FROM old o FULL JOIN new n ON o.k = n.k"""
)
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("first_seen"), F.col("o_totalprice").alias("value"))
    moved = F.when(F.col("o_orderkey") % 2 == 1, F.col("first_seen") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("first_seen") + F.expr("INTERVAL 2 DAY"))
    new = o.where("o_orderkey % 4 <> 1").select("o_orderkey", moved.alias("first_seen"), (F.col("value") + 1).alias("value"))
    return state.upserted(o.where("o_orderkey % 3 <> 0"), new, "o_orderkey", "first_seen").select("o_orderkey", F.unix_micros("first_seen").alias("first_seen"), "value")


@query("SELECT DISTINCT user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events k WHERE k.user_id = e.user_id AND k.event_type = e.event_type AND k.value > 480)")
def enqueued_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return state.enqueued(e, e.where("value > 480"), ["user_id", "event_type"]).select("user_id", "event_type")


@query("SELECT user_id, max(ts)::DATE IS NULL OR date_diff('day', max(ts)::DATE, DATE '2024-01-31') >= 3 AS due FROM events GROUP BY 1")
def due_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = events(spark, sf_dir).groupBy("user_id").agg(F.to_date(F.max("ts")).alias("last"))
    return last.select("user_id", state.due(F.col("last"), F.lit("2024-01-31").cast("date"), 3).alias("due"))


@query("SELECT user_id, event_type, max(event_id) AS baseline FROM events WHERE value > 250 GROUP BY 1, 2")
def sequence_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.baselines(table(spark, sf_dir, "events").withColumn("ok", F.col("value") > 250), ["user_id", "event_type"], "event_id", "ok")


@query(
    """WITH RECURSIVE e AS (SELECT *, epoch_us(ts) AS t, event_type = 'signup' AS pilot, event_type = 'error' AS cools, event_id % 10 = 0 AS back, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0 AS used, 0 AS own_view, 0 AS own_click, 0 AS own_purchase, 0 AS own_signup, 0 AS own_error, 0::BIGINT AS rest0, 0::BIGINT AS rest1, NULL::BIGINT AS event_id, NULL::VARCHAR AS g FROM events
UNION ALL SELECT user_id, i, used + hit, own_view + (hit AND event_type = 'view')::INT, own_click + (hit AND event_type = 'click')::INT, own_purchase + (hit AND event_type = 'purchase')::INT, own_signup + (hit AND event_type = 'signup')::INT, own_error + (hit AND event_type = 'error')::INT,
  CASE WHEN g = 'granted' AND cools AND h = 0 THEN greatest(rest0, t + 86400000000) ELSE rest0 END, CASE WHEN g = 'granted' AND cools AND h = 1 THEN greatest(rest1, t + 86400000000) ELSE rest1 END, event_id, g FROM (SELECT *, (g = 'granted' AND NOT back)::INT AS hit FROM (
  SELECT f.user_id, e.i, used, own_view, own_click, own_purchase, own_signup, own_error, rest0, rest1, e.event_id, e.event_type, e.t, e.cools, e.back, (e.event_id % 2) AS h,
  CASE WHEN e.t < CASE WHEN e.event_id % 2 = 0 THEN rest0 ELSE rest1 END THEN 'cooling' WHEN used >= 10 THEN 'run_cap' WHEN CASE e.event_type WHEN 'view' THEN own_view WHEN 'click' THEN own_click WHEN 'purchase' THEN own_purchase WHEN 'signup' THEN own_signup ELSE own_error END >= 4 THEN 'source_share' WHEN e.pilot AND own_signup >= 2 THEN 'pilot_ceiling' ELSE 'granted' END AS g
  FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)))
SELECT event_id, g AS "grant" FROM f WHERE event_id IS NOT NULL"""
)
def budget_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold: what a request is granted depends on what those before it were granted."""
    at = F.unix_micros("ts")
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts", (F.col("event_id") % 2).cast("string").alias("host"), (F.col("event_type") == "signup").alias("pilot"), (F.col("event_id") % 10 == 0).alias("unsent"))
    out = state.reserved(e, "user_id", [F.col("ts"), F.col("event_id")], "host", "event_type", "pilot", at, F.when(F.col("event_type") == "error", at + 86_400_000_000), "unsent", 10, 4)
    return out.select("event_id", "grant")


# ------------------------------------------------------------- ledgers
@query("SELECT user_id, event_type, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS reserved FROM events GROUP BY 1, 2")
def budget_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("cost", F.floor("value"))
    return ledger.states(e, "user_id", "event_type", "cost")


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS shown, count(*) FILTER (o_orderstatus IN ('F', 'P')) AS hidden, 0::BIGINT AS unexplained, true AS holds FROM orders")
def presentation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.presentation(table(spark, sf_dir, "orders"), "o_orderstatus", ["O"], ["F", "P"])


@query("SELECT o_custkey % 20 AS destination, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') + count(*) FILTER (o_orderstatus = 'F') = count(*) AS balanced FROM orders GROUP BY 1")
def delivery_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("destination", F.col("o_custkey") % 20)
    return ledger.by_destination(o, "destination", "o_orderstatus", ["O", "F"])


@query(
    """WITH r AS (SELECT user_id % 10 AS destination, event_id, value, CASE WHEN event_type = 'view' THEN 'healthy' WHEN event_id % 3 = 0 THEN 'recorded' WHEN user_id % 10 = 4 THEN 'held' ELSE 'ready' END AS place FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY destination, place ORDER BY value DESC, event_id) AS i FROM r)
SELECT destination, count(*) AS total, count(*) FILTER (place = 'healthy') AS healthy, count(*) FILTER (place = 'recorded') AS recorded, count(*) FILTER (place = 'held') AS held, count(*) FILTER (place = 'ready' AND i <= 5) AS selected, count(*) FILTER (place = 'ready' AND i > 5) AS overflow, true AS balanced FROM n GROUP BY 1"""
)
def coverage_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("destination", F.col("user_id") % 10).withColumn("status", F.when(F.col("event_type") == "view", "ok").otherwise("failed"))
    return ledger.coverage(e, "destination", "status", F.col("event_id") % 3 == 0, F.col("destination") == 4, [F.desc("value"), F.col("event_id")], 5)


@query("SELECT 'all ' || count(*) || ', fast lane ' || count(*) FILTER (o_orderstatus = 'fast_lane') || ', O ' || count(*) FILTER (o_orderstatus = 'O') AS line FROM orders")
def accounting_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.accounting_line(table(spark, sf_dir, "orders"), "o_orderstatus", ["fast_lane", "O"])


@query(
    """WITH r AS (SELECT p_brand, p_name, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS i FROM part)
SELECT p_brand, count(*) AS n, string_agg(p_name, ', ' ORDER BY i) FILTER (i <= 3) || CASE WHEN count(*) > 3 THEN ' +' || (count(*) - 3) || ' more' ELSE '' END AS line FROM r GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 12"""
)
def overflow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.overflow_lines(table(spark, sf_dir, "part"), "p_brand", "p_name", [F.desc("p_size"), F.col("p_partkey")], 3, 12)


@query(
    """SELECT user_id, count(*) AS checks, count(*) FILTER (value > 250) AS adequate, count(DISTINCT CASE WHEN event_type <> 'error' THEN event_type END)::INT AS n_actions, count(*) FILTER (event_type = 'error') AS unknown_actions, CAST(sum(CASE WHEN event_id % 2 = 0 THEN floor(value) END) AS BIGINT) AS minutes, count(*) FILTER (event_id % 2 = 1) AS unmeasured, CAST(sum(floor(value / 10)) AS BIGINT) AS cost FROM events GROUP BY 1"""
)
def value_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.col("value") > 250).alias("ok"), F.when(F.col("event_type") != "error", F.array("event_type")).alias("actions"), F.when(F.col("event_id") % 2 == 0, F.floor("value")).alias("minutes"), F.floor(F.col("value") / 10).alias("cost"))
    return ledger.value_report(e, ["user_id"], "ok", "actions", "minutes", "cost")


# ------------------------------------------------------------- checks
@query(
    """WITH r AS (SELECT p_partkey::VARCHAR AS id, p_size, p_brand FROM part), d AS (SELECT l_partkey::VARCHAR AS id, arg_max(CASE WHEN l_returnflag = 'R' THEN 'pause' ELSE 'admit' END, l_shipdate::VARCHAR || lpad(l_orderkey::VARCHAR, 9, '0') || l_linenumber || lpad(l_suppkey::VARCHAR, 9, '0') || l_returnflag) AS last FROM lineitem GROUP BY 1)
SELECT id AS source_id, 'unknown_category' AS issue FROM r WHERE p_brand = 'Brand#3' UNION ALL SELECT id, 'over_ceiling' FROM r WHERE p_size > 45
UNION ALL SELECT r.id, CASE WHEN last IS NULL THEN 'not_admitted' ELSE 'paused' END FROM r LEFT JOIN d ON d.id = r.id WHERE p_size % 2 = 0 AND (last IS NULL OR last = 'pause') UNION ALL SELECT NULL, 'too_many_pilots' WHERE (SELECT count(DISTINCT p_brand) FROM r WHERE p_size % 2 = 0) > 2"""
)
def plan_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    routes = part.select(F.col("p_partkey").cast("string").alias("source_id"), F.col("p_brand").alias("category"), F.col("p_brand").alias("family"), F.col("p_size").alias("requests"), F.when(F.col("p_size") % 2 == 0, "pilot").otherwise("watch").alias("mode"))
    categories = part.where("p_brand <> 'Brand#3'").select(F.col("p_brand").alias("category")).distinct()
    at = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.col("l_linenumber").cast("string"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), "l_returnflag")
    decisions = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("source_id"), at.alias("observed_at"), F.when(F.col("l_returnflag") == "R", "pause").otherwise("admit").alias("disposition"))
    return checks.plan_issues(routes, categories, decisions, 45)


@query(
    """SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 5 = 0 THEN 'invalid_window' END, CASE WHEN event_id % 3 = 0 THEN 'page_outside_plan' END, CASE WHEN event_id % 7 = 0 THEN 'repeated_page' END, CASE WHEN event_id % 2 = 0 AND event_type = 'view' THEN 'unreviewed_novelty' END], lambda x: x IS NOT NULL), ',') AS issues,
  event_type <> 'error' AND event_id % 3 <> 0 AND event_id % 2 = 0 AND event_type <> 'view' AS proves FROM events"""
)
def check_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = events(spark, sf_dir).withColumns(
        {
            "window_start": F.col("ts"), "window_end": F.when(k % 5 == 0, F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL 1 HOUR")), "observed_at": F.col("ts") + F.expr("INTERVAL 2 HOURS"), "planned": F.when(k % 7 == 0, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1))),
            "fetched": F.when(k % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))), "actions": F.when(k % 2 == 0, F.lit(1)), "novelty": F.col("event_type") != "view", "state": F.when(F.col("event_type") != "error", "complete").otherwise("open"), "complete": F.lit(True), "omissions": no_reasons(),
        }
    )
    return checks.check_issues(e).select("event_id", F.array_join("issues", ",").alias("issues"), checks.adequate(e).alias("proves"))


@query("SELECT 'o_custkey' AS side, o_custkey::VARCHAR AS value, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(DISTINCT o_custkey) FROM orders GROUP BY o_orderpriority HAVING count(DISTINCT o_custkey) > 1")
def not_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.not_one_to_one(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 5 = 0 THEN 'conflict' ELSE 'repeated' END AS receipt FROM orders")
def request_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    request = F.concat(F.col("o_orderkey").cast("string"), "o_orderpriority")
    done = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.sha2(F.concat(request, F.when(F.col("o_orderkey") % 5 == 0, "!").otherwise("")), 256).alias("request_hash"))
    return checks.receipts(o, done, "o_orderkey", request).select("o_orderkey", "receipt")


@query(
    """WITH f AS (SELECT user_id, event_type, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) FILTER (value > 100) AS v, bool_or(value > 495) AS c FROM events GROUP BY 1, 2)
SELECT user_id, max(CASE WHEN event_type = 'view' THEN v END) AS "view", max(CASE WHEN event_type = 'click' THEN v END) AS click, array_to_string(list_sort(list(event_type) FILTER (c)), ',') AS conflicts FROM f GROUP BY 1"""
)
def fact_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    facts = e.where("value > 100").select("user_id", "event_type", "k", F.lit("current").alias("disposition")).unionByName(e.where("value > 495").select("user_id", "event_type", "k", F.lit("conflict").alias("disposition"))).unionByName(e.select("user_id", "event_type", "k", F.lit("superseded").alias("disposition")))
    return checks.fact_values(facts, ["user_id"], "event_type", "k", ["view", "click"]).select("user_id", "view", "click", F.nullif(F.array_join("conflicts", ","), F.lit("")).alias("conflicts"))


# ------------------------------------------------------------- selections
@query(
    """WITH r AS (SELECT o_orderkey, o_orderpriority AS s, o_totalprice AS v, o_orderstatus = 'F' AS bad, o_custkey % 2 = 0 AS soft FROM orders), q AS (SELECT o_orderkey FROM r WHERE bad AND soft ORDER BY v DESC, o_orderkey LIMIT 3),
t AS (SELECT o_orderkey, s, row_number() OVER (PARTITION BY s ORDER BY v DESC, o_orderkey) AS turn FROM r WHERE NOT bad), w AS (SELECT o_orderkey, turn FROM t ORDER BY turn, s LIMIT 22)
SELECT o_orderkey, turn::INT AS turn FROM w UNION ALL SELECT o_orderkey, NULL FROM q"""
)
def quota_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("bad", F.col("o_orderstatus") == "F").withColumn("soft", F.col("o_custkey") % 2 == 0)
    return ranking.shortlist(o, "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], 25, "bad", "soft").select("o_orderkey", "turn")


@query("SELECT c_custkey FROM customer JOIN (SELECT s_suppkey, s_acctbal / 8192 AS t FROM supplier) ON s_suppkey = c_custkey % 10 WHERE t >= 0.5 AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey % 10 LIMIT 15")
def join_nudges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 10).alias("platform"), F.when(F.col("c_mktsegment") == "BUILDING", "todo").otherwise("done").alias("status"))
    registry = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("platform"), (F.col("s_acctbal") / 8192).alias("trust"))
    return ranking.nudges(c, registry, "platform", "c_acctbal", 0.5, 15).select("c_custkey")


@query(None)
def handoff_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold run twice, as a kept place changes which rows caps hide; tested against plain Python."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "action").otherwise("verify").alias("lane"), (F.col("o_custkey") % 40).alias("employer"), F.when(F.col("o_custkey") % 3 == 0, "shop").alias("platform"), (F.col("o_totalprice") > 100_000).alias("acted"), (F.col("o_custkey") % 5 == 0).alias("urgent"), "o_totalprice")
    return ranking.handoff(o, "o_orderkey", "lane", "employer", "platform", "acted", "urgent", [F.desc("o_totalprice"), F.col("o_orderkey")], {"action": 5, "verify": 2}, 7, 1, 2)


@query(
    """WITH h AS (SELECT DISTINCT o_custkey AS subject FROM orders WHERE o_orderstatus = 'P'), i AS (SELECT o_orderkey AS intent, o_custkey AS subject FROM orders WHERE o_orderkey % 4 = 0), r AS (SELECT l_orderkey AS intent, l_linenumber AS revision, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber > 3)
SELECT h.subject, min(revision)::INT AS revision, CASE WHEN min(revision) IS NULL THEN 'held' ELSE 'adopted' END AS status FROM h LEFT JOIN (SELECT subject, revision FROM i JOIN r USING (intent)) x ON x.subject = h.subject GROUP BY 1"""
)
def adopted_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    holds = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("subject"), F.lit("mail").alias("channel")).distinct()
    intents = o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("intent_id"), F.col("o_custkey").alias("subject"), F.lit("mail").alias("channel"))
    revisions = table(spark, sf_dir, "lineitem").where("l_linenumber > 3").select(F.col("l_orderkey").alias("intent_id"), F.col("l_linenumber").alias("revision"), F.col("l_partkey").cast("string").alias("material_hash"))
    return observations.adopted(holds, intents, revisions).select("subject", "revision", "status")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'same' WHEN c_custkey % 4 = 1 AND c_custkey % 3 <> 0 THEN 'adopted' ELSE 'held' END AS state FROM customer")
def schema_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit("a").alias("old_hash"), F.when(k % 4 == 0, "a").otherwise("b").alias("new_hash"))
    proofs = table(spark, sf_dir, "customer").select("c_custkey", F.lit("a").alias("old_hash"), F.when(k % 4 == 2, "c").otherwise("b").alias("new_hash"), (k % 4 < 3) & (k % 3 != 0) | (k % 4 == 2)).toDF("c_custkey", "old_hash", "new_hash", "accepted")
    return observations.schema_proofs(rows, proofs, ["c_custkey"]).select("c_custkey", "state")


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 2 ELSE 1 END::BIGINT AS repeats FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 2 ELSE 1 END::BIGINT FROM events WHERE event_id % 3 = 0")
def journal_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    return outcomes.journal(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), "event_id").select("event_id", "repeats")


@query("SELECT o_orderkey, o_orderstatus = 'P' OR (o_orderstatus = 'O' AND length(o_orderpriority) < 8) AS needs FROM orders WHERE true")
def hydration_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "P", "aggregator_unresolved").when(F.col("o_orderstatus") == "O", "original_ats").otherwise("unknown")
    needs = quality.needs_hydration(kind, F.col("o_orderpriority"), F.lit(True), F.lit(0), F.lit(None).cast("timestamp"), F.expr("TIMESTAMP '2001-01-01 00:00:00'"), enough=8)
    return table(spark, sf_dir, "orders").select("o_orderkey", needs.alias("needs"))


@query(
    """WITH v(term) AS (VALUES ('red'), ('red ring'), ('large'), ('hot gizmo'), ('ring')) SELECT p_partkey, term FROM part, v WHERE ' ' || lower(p_name) || ' ' LIKE '% ' || term || ' %'"""
)
def vocabulary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([("red",), ("red ring",), ("large",), ("hot gizmo",), ("ring",)], "term string")
    return joins.vocabulary_hits(table(spark, sf_dir, "part"), "p_partkey", "p_name", terms)


@query("SELECT user_id, array_to_string(list_sort(list(event_type || '=' || n)), ',') AS codes FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1, 2) GROUP BY 1")
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("code", F.when(F.col("event_type") != "view", F.col("event_type")))
    out = ledger.histogram(e, ["user_id"], "code")
    return out.select("user_id", F.array_join(F.transform(F.map_entries("codes"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias("codes"))


@query("SELECT c_mktsegment, c_nationkey, CAST(sum(CASE WHEN c_custkey % 4 > 0 THEN floor(c_acctbal) END) AS BIGINT) AS cost, count(*) FILTER (c_custkey % 4 = 0) AS unmeasured FROM customer GROUP BY 1, 2")
def costs_by_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("cost", F.when(F.col("c_custkey") % 4 > 0, F.floor("c_acctbal")))
    return ledger.costs(c, ["c_mktsegment"], "c_nationkey", "cost")


@query(
    """WITH s AS (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\\bde\\b') AND regexp_matches(text, '\\b(the|der)\\b') THEN 'both' WHEN regexp_matches(text, '\\bde\\b') THEN 'closed' WHEN regexp_matches(text, '\\b(the|der)\\b') THEN 'open' END AS s, CASE WHEN turn % 3 <> 1 THEN length(text) % 3 END AS terms FROM conversations),
b AS (SELECT *, last_value(s IGNORE NULLS) OVER w AS before, last_value(terms IGNORE NULLS) OVER w AS held FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, CASE WHEN count(*) FILTER (s = 'both') > 0 THEN 'unclear' WHEN arg_max(s, turn) FILTER (s IS NOT NULL) = 'closed' THEN 'closed' WHEN count(*) FILTER (s = 'open' AND before = 'closed') > 0 THEN 'reopened' ELSE 'open' END AS state,
  count(*) FILTER (s = 'open' AND before = 'closed') AS reopenings, count(*) FILTER (terms IS NOT NULL AND terms IS DISTINCT FROM held) AS revision, arg_max(terms, turn) FILTER (terms IS NOT NULL)::INT AS terms FROM b GROUP BY conv_id"""
)
def thread_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "conversations").withColumn("terms", F.when(F.col("turn") % 3 != 1, F.length("text") % 3))
    return history.thread_history(posts, "conv_id", "turn", F.col("text").rlike("\\b(the|der)\\b"), F.col("text").rlike("\\bde\\b"), "terms")


@query("SELECT c_custkey, o_orderkey, found FROM (SELECT c_custkey, max(o_orderkey) AS o_orderkey, max(o_orderkey) IS NOT NULL AS found FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, o_orderdate) AS o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS same FROM orders) WHERE same = 1 GROUP BY 1) o ON o_custkey = c_custkey GROUP BY 1)")
def point_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer, of the orders that share their day with no other of the same customer."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    o = o.withColumn("same", F.count("*").over(Window.partitionBy("c_custkey", "o_orderdate"))).where("same = 1").drop("same")
    return readers.point_reads(table(spark, sf_dir, "customer"), o, "c_custkey", "o_orderdate").select("c_custkey", "o_orderkey", "found")


@query(
    """WITH c AS (SELECT l_orderkey, l_returnflag AS unit, l_linenumber = 2 AS fixed, l_quantity AS low, l_quantity + 1 AS high FROM lineitem WHERE l_discount >= 0.05)
SELECT l_orderkey, count(*) AS claims, count(DISTINCT unit) > 1 OR max((low + high) / 2) - min((low + high) / 2) > 0.25 * max((low + high) / 2) OR count(DISTINCT fixed) > 1 OR count(DISTINCT CASE WHEN fixed THEN low END) > 1 AS conflict FROM c GROUP BY 1"""
)
def budget_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_discount", (F.col("l_linenumber") == 2).alias("fixed"), F.col("l_quantity").alias("low"), (F.col("l_quantity") + 1).alias("high"))
    return entities.pay_conflicts(c, "l_orderkey", "low", "high", "l_returnflag", "l_discount", 0.05, 0.25, F.col("fixed")).select("l_orderkey", "claims", "conflict")


@query(
    """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey % 4 - 1) * 10.0 END AS low, s_suppkey % 7 * 10.0 AS high, CASE WHEN s_suppkey % 3 > 0 THEN 0.25 END AS over FROM supplier), n AS (SELECT *, coalesce(nullif(low, 0), nullif(high, 0)) AS n FROM s)
SELECT k AS s_suppkey, CAST(round(100 * greatest(0.0, least(n, n * 0.5 * (1 - coalesce(over, 0))))) AS BIGINT) AS cents FROM n WHERE n IS NOT NULL UNION ALL SELECT k, NULL FROM n WHERE n IS NULL"""
)
def conservative_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rate = money.conservative_rate(F.when(k % 4 > 0, (k % 4 - 1) * 10.0), k % 7 * 10.0, F.lit(0.5), F.when(k % 3 > 0, 0.25))
    nominal = F.coalesce(F.nullif(F.when(k % 4 > 0, (k % 4 - 1) * 10.0), F.lit(0.0)), F.nullif(k % 7 * 10.0, F.lit(0.0)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(nominal.isNotNull(), F.round(100 * rate).cast("long")).alias("cents"))


@query(
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus <> 'P', o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderpriority <> '5-LOW') SELECT o_orderkey, place, (place - 1) // 20 AS batch FROM r WHERE place <= 60"""
)
def pending_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 60 first of a band, waiting ones before all others, in batches of 20."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'")
    out = ranking.batches(o, [(F.col("o_orderstatus") != "P").asc(), F.desc("o_totalprice"), F.col("o_orderkey").asc()], 60, 20)
    return out.select("o_orderkey", F.col("place").cast("long").alias("place"), F.col("batch").cast("long").alias("batch"))


@query(
    """WITH k AS (SELECT o_custkey AS c, o_orderkey % 20 AS r FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT o_orderkey, o_custkey AS c, o_orderkey % 20 AS r FROM orders WHERE o_orderkey % 3 = 1)
SELECT o_orderkey, CASE WHEN c % 9 = 0 THEN 'held' WHEN EXISTS (SELECT 1 FROM k WHERE k.c = n.c AND k.r = n.r) THEN 'duplicate' WHEN EXISTS (SELECT 1 FROM k WHERE k.c = n.c AND k.r > n.r) THEN 'stale' ELSE 'queued' END AS status FROM n"""
)
def enqueue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c"), (F.col("o_orderkey") % 20).alias("r"))
    return state.enqueue_status(o.where("o_orderkey % 3 = 1"), o.where("o_orderkey % 3 = 0"), o.where("c % 9 = 0"), "c", "r").select("o_orderkey", "status")


@query("SELECT p_partkey, CASE p_name WHEN 'red ring' THEN 'Ring Works' ELSE p_name END AS name, 'strasse ffi 1 ' || p_partkey AS identity, 'für ' || p_name AS shown FROM part")
def names_and_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by an alias map, and letters that compare or show alike: sharp s, ligatures, circled digits, and UTF-8 that was misread."""
    part = table(spark, sf_dir, "part")
    odd = F.concat(F.lit("Straße ﬃ ① "), F.col("p_partkey").cast("string"))
    return part.select("p_partkey", text.known_name(F.col("p_name"), {"red ring": "Ring Works"}).alias("name"), text.identity_key(odd).alias("identity"), text.people_text(F.concat(F.lit("fÃ¼r  "), "p_name")).alias("shown"))
