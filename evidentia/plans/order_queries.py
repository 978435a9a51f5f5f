"""Queries over orders, line items, parts and suppliers, each with its SQL or a reason for none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, scoring, times
from ..operators import entities, joins, ranking
from .registry import query, table

AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"
BANDS = [("1-URGENT", 40), ("2-HIGH", 40), ("3-MEDIUM", 40), ("4-NOT SPECIFIED", 40), ("5-LOW", 40)]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


FRESH = f"greatest(0.1, pow(2.0, -greatest(0.0, date_diff('day', o_orderdate, {AS_OF})) / 512.0))"


@query(f"SELECT o_orderkey, CAST(floor(1000 * {FRESH}) AS BIGINT) AS fresh_milli FROM orders")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = times.freshness(F.col("o_orderdate").cast("timestamp"), F.expr(AS_OF), 512.0)
    return orders(spark, sf_dir).select("o_orderkey", F.floor(1000 * fresh).alias("fresh_milli"))


@query(
    f"""WITH e AS (SELECT o_orderkey, o_orderpriority, (o_totalprice / 6000) * (CASE WHEN o_orderstatus = 'P' THEN 0.85 ELSE 0.4 + 0.6 * 0.75 END) * (0.7 + 0.3 * 0.5) * {FRESH} AS ev FROM orders)
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, ev DESC, o_orderkey) AS place FROM e ORDER BY place LIMIT 100"""
)
def freshness_ev_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    fresh = times.freshness(F.col("o_orderdate").cast("timestamp"), F.expr(AS_OF), 512.0)
    ev = (F.col("o_totalprice") / 6000) * scoring.trust_factor(F.when(F.col("o_orderstatus") != "P", F.lit(0.75))) * (0.7 + 0.3 * F.lit(0.5)) * fresh
    ranked = ranking.batches(o.withColumn("ev", ev), [F.col("o_orderpriority"), F.desc("ev"), F.col("o_orderkey")], 100, 20)
    return ranked.select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("SELECT o_orderkey, place FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 2")
def per_entity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.capped(orders(spark, sf_dir), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 2)
    return out.select("o_orderkey", F.col("place").cast("long").alias("place"))


def banded_sql(per: int) -> str:
    """The greedy rule, one common table for each band."""
    parts, shown = ["o AS (SELECT o_orderkey AS k, o_custkey % 40 AS e, o_orderpriority AS band, o_totalprice AS v FROM orders)"], "(SELECT NULL::BIGINT AS k, NULL::BIGINT AS e WHERE false)"
    for i, (band, limit) in enumerate(BANDS):
        parts.append(f"r{i} AS (SELECT o.k, o.e, v, row_number() OVER (PARTITION BY o.e ORDER BY v DESC, o.k) + coalesce(n, 0) AS n FROM o LEFT JOIN (SELECT e, count(*) AS n FROM {shown} GROUP BY e) u ON u.e = o.e WHERE band = '{band}')")
        parts.append(f"s{i} AS (SELECT k, e FROM r{i} WHERE n <= {per} ORDER BY v DESC, k LIMIT {limit})")
        shown = "(" + " UNION ALL ".join(f"SELECT k, e FROM s{j}" for j in range(i + 1)) + ")"
    return "WITH " + ", ".join(parts) + f""", x AS (SELECT o.*, s.k IS NOT NULL AS shown FROM o LEFT JOIN {shown} s ON s.k = o.k),
y AS (SELECT k, shown, coalesce(sum(shown::INT) OVER (PARTITION BY e ORDER BY band, v DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)
SELECT k AS o_orderkey, CASE WHEN shown THEN 'shown' WHEN before >= {per} THEN 'entity_cap' ELSE 'size_cap' END AS reason FROM y"""


@query(banded_sql(3))
def bandwise_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir).select("o_orderkey", (F.col("o_custkey") % 40).alias("entity"), F.col("o_orderpriority").alias("band"), "o_totalprice")
    return ranking.banded_caps(o, "o_orderkey", "entity", [F.desc("o_totalprice"), F.col("o_orderkey")], BANDS, 3).select("o_orderkey", "reason")


@query(None)
def multi_cap_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold: a second cap interacts with the first."""
    o = orders(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return ranking.two_caps(o, "o_orderkey", "o_custkey", "c_nationkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 2, 3, 15)


@query(
    """WITH p AS (SELECT o_orderkey, o_orderdate >= TIMESTAMP '2001-07-31 00:00:00' AS current, row_number() OVER (PARTITION BY o_orderdate >= TIMESTAMP '2001-07-31 00:00:00' ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'P')
SELECT o_orderkey, NOT current AS retried FROM p WHERE n <= CASE WHEN current THEN 1 ELSE 10 - (SELECT count(*) FROM p WHERE current AND n = 1) END"""
)
def dispatch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = orders(spark, sf_dir).where("o_orderstatus = 'P'").withColumn("current", F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '2001-07-31 00:00:00'"))
    return ranking.dispatch_plan(ready, [F.col("o_orderdate"), F.col("o_orderkey")], "current", 10).select("o_orderkey", (~F.col("current")).alias("retried"))


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice AS amount FROM lineitem)
SELECT a.l_partkey, a.l_orderkey AS o1, a.l_linenumber AS n1, b.l_orderkey AS o2, b.l_linenumber AS n2 FROM c a JOIN c b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey AND abs(a.amount - b.amount) <= 200"""
)
def corroboration_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_extendedprice").alias("amount"))
    out = entities.corroborations(c, ["l_partkey"], "amount", "l_suppkey", 200.0)
    return out.select("l_partkey", F.col("l_orderkey").alias("o1"), F.col("l_linenumber").alias("n1"), F.col("r_l_orderkey").alias("o2"), F.col("r_l_linenumber").alias("n2"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey <> a.l_suppkey AND abs(b.l_extendedprice - a.l_extendedprice) <= 200) AS corroborated FROM lineitem a"""
)
def corroborated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("amount"))
    return entities.corroborated(c, ["l_partkey"], "amount", "l_suppkey", 200.0, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "corroborated")


@query(
    """WITH c AS (SELECT l_partkey, l_returnflag AS unit, l_extendedprice AS low, l_extendedprice + l_quantity AS high FROM lineitem WHERE l_discount >= 0.09)
SELECT l_partkey, count(DISTINCT unit) AS units, count(*) AS claims, count(DISTINCT unit) > 1 OR max((low + high) / 2) - min((low + high) / 2) > 0.25 * max((low + high) / 2) AS conflict FROM c GROUP BY l_partkey"""
)
def pay_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_discount", F.col("l_extendedprice").alias("low"), (F.col("l_extendedprice") + F.col("l_quantity")).alias("high"))
    return entities.pay_conflicts(c, "l_partkey", "low", "high", "l_returnflag", "l_discount", 0.09, 0.25).select("l_partkey", "units", "claims", "conflict")


ALIASES = [("red", "short", 0), ("red widget", "widgets", 1), ("bolt", "bolts", 2), ("blue bolt", "blue", 3), ("ring", "rings", 4), ("small", "small", 5)]


@query(
    f"""WITH a(alias, target, turn) AS (VALUES {', '.join(str(a) for a in ALIASES)}), h AS (SELECT p_partkey, target, row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC, turn) AS n FROM part JOIN a ON ' ' || lower(p_name) || ' ' LIKE '% ' || alias || ' %')
SELECT p.p_partkey, h.target AS matched FROM part p LEFT JOIN h ON h.p_partkey = p.p_partkey AND n = 1"""
)
def alias_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame(ALIASES, "alias string, target string, turn int")
    return joins.alias_matched(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", aliases).select("p_partkey", "matched")


@query(
    """WITH s AS (SELECT s_suppkey, least(1.0, greatest(0.0, s_acctbal / 8192)) AS trust, n_name, 20.0 AS nominal FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 20)
SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation, CAST(round(100 * least(greatest(0.0, nominal * trust * (1 - 0.25)), nominal)) AS BIGINT) AS effective_cents, CASE WHEN trust >= 0.7 THEN 'high' WHEN trust >= 0.5 THEN 'medium' ELSE 'low' END AS badge FROM s"""
)
def registry_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    s = joins.looked_up(table(spark, sf_dir, "supplier"), registry, "s_nationkey", defaults={"nation": "unknown"})
    trust = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s_acctbal") / 8192))
    rate = money.unrounded_rate(F.lit(20.0), trust, F.lit(0.25))
    return s.select("s_suppkey", "nation", F.round(100 * rate).cast("long").alias("effective_cents"), scoring.badge(trust, 0.7, 0.5).alias("badge"))


@query(
    """WITH l AS (SELECT p_name AS url, p_partkey AS old FROM part WHERE p_partkey % 3 = 0), r AS (SELECT p_name AS url, p_partkey AS new FROM part WHERE p_partkey % 5 = 0),
a AS (SELECT url, count(DISTINCT old) AS n, min(old) AS old FROM l GROUP BY 1), b AS (SELECT url, count(DISTINCT new) AS m, min(new) AS new FROM r GROUP BY 1)
SELECT url, CASE WHEN n = 1 AND m = 1 THEN old END AS old, CASE WHEN n = 1 AND m = 1 THEN new END AS new, CASE WHEN n = 1 AND m = 1 THEN 'mapped' ELSE 'held' END AS status FROM a JOIN b USING (url)"""
)
def exact_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("url"), "p_partkey")
    left = part.where("p_partkey % 3 = 0").withColumnRenamed("p_partkey", "old")
    right = part.where("p_partkey % 5 = 0").withColumnRenamed("p_partkey", "new")
    return joins.exact_crosswalk(left, right, "url", "old", "new")


@query(
    """WITH c AS (SELECT o_orderkey AS id, o_custkey AS claimed FROM orders), o AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber = 7 THEN l_suppkey ELSE o_custkey END AS identity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT c.id, coalesce(count(DISTINCT identity) = 1 AND min(identity) = min(claimed), false) AS proven FROM c LEFT JOIN o USING (id) GROUP BY c.id"""
)
def receipts_proven(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    receipts = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("claimed"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_suppkey")
    named = lines.join(receipts, "id").select(F.col("id"), F.concat_ws("-", "id", "l_linenumber", "l_suppkey").alias("obs"), F.when(F.col("l_linenumber") == 7, F.col("l_suppkey")).otherwise(F.col("claimed")).alias("identity"))
    return joins.receipts_proven(receipts, named.select("id", "obs"), named.select("obs", "identity").distinct(), "id", "obs", "identity").select("id", "proven")


@query("SELECT s_suppkey, printf('$%.2f/h', CAST(s_suppkey % 50 + 1 AS DOUBLE)) AS pay, 'hour' AS basis FROM supplier")
def parsed_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("$"), (F.col("s_suppkey") % 50 + 1).cast("string"), F.lit(" per hour")).alias("raw"))
    pay = money.parsed_pay(F.col("raw"))
    return raw.select("s_suppkey", money.range_text(pay["low"], pay["high"]).alias("pay"), pay["basis"].alias("basis"))


@query("SELECT o_custkey, max(o_orderkey) AS best, array_to_string(list_transform(list_sort(list_distinct(list(o_orderkey))), lambda x: x::VARCHAR), ',') AS members FROM orders GROUP BY o_custkey")
def final_url_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = entities.collapsed(orders(spark, sf_dir).select("o_custkey", "o_orderkey"), "o_custkey", [F.col("o_orderkey")], "o_orderkey")
    return out.select("o_custkey", F.col("o_orderkey").alias("best"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


ORDER_SECTIONS = [("1-URGENT", 8, 2), ("2-HIGH", 6, 2), ("3-MEDIUM", 4, 3)]


@query(None)
def section_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of orders with deferred rows; the first one has a single platform and takes them up again. A test compares all rows with the greedy rule in plain Python."""
    c, p = F.col("o_custkey"), F.col("o_orderpriority")
    platform = F.when(p == "1-URGENT", "main").when(c % 7 != 0, F.concat(F.lit("p"), (c % 3).cast("string")))
    o = orders(spark, sf_dir).select("o_orderkey", "o_totalprice", (c % 25).cast("string").alias("entity"), platform.alias("platform"), p.alias("section"))
    return ranking.sectioned(o, "o_orderkey", "entity", "platform", "section", [("o_totalprice", False), ("o_orderkey", True)], ORDER_SECTIONS, 2)


@query(
    """WITH o AS (SELECT o_orderkey, o_totalprice, o_custkey % 40 AS entity, CASE WHEN o_custkey % 6 = 0 THEN 'easy' WHEN o_orderpriority = '1-URGENT' THEN 'high' WHEN o_orderstatus = 'F' THEN 'mid' END AS band FROM orders),
a AS (SELECT *, row_number() OVER (PARTITION BY band, entity ORDER BY o_totalprice DESC, o_orderkey) AS n FROM o),
e AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM a WHERE band = 'easy' AND n <= 3), se AS (SELECT * FROM e WHERE r <= 10), ue AS (SELECT entity, count(*) AS u FROM se GROUP BY 1),
h AS (SELECT a.*, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM a LEFT JOIN ue USING (entity) WHERE band = 'high' AND n + coalesce(u, 0) <= 3), sh AS (SELECT * FROM h WHERE r <= 12), uh AS (SELECT entity, count(*) AS u FROM (SELECT entity FROM se UNION ALL SELECT entity FROM sh) GROUP BY 1),
m AS (SELECT a.*, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM a LEFT JOIN uh USING (entity) WHERE band = 'mid' AND n + coalesce(u, 0) <= 3), sm AS (SELECT * FROM m WHERE r <= 5)
SELECT o_orderkey, band, o_orderkey IN (SELECT o_orderkey FROM se UNION ALL SELECT o_orderkey FROM sh UNION ALL SELECT o_orderkey FROM sm) AS shown FROM o"""
)
def grouped_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order in the first group whose condition holds, under an entity cap that all groups share."""
    band = ranking.first_group({"easy": F.col("o_custkey") % 6 == 0, "high": F.col("o_orderpriority") == "1-URGENT", "mid": F.col("o_orderstatus") == "F"})
    o = orders(spark, sf_dir).select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 40).alias("entity"), band.alias("band"))
    return ranking.banded_caps(o, "o_orderkey", "entity", [F.desc("o_totalprice"), F.col("o_orderkey")], [("easy", 10), ("high", 12), ("mid", 5)], 3).select("o_orderkey", "band", "shown")


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p, (o_totalprice / 1000000)::DOUBLE AS t, 1.0 / (1 + o_custkey % 8) AS f FROM orders),
q AS (SELECT *, (c % 4) * 5.0 AS role_priority, CASE s WHEN 'F' THEN 30.0 WHEN 'O' THEN 20.0 ELSE 0.0 END AS match, CASE WHEN c % 3 = 0 THEN 10.0 ELSE 0.0 END AS language_edge, CASE left(p, 1) WHEN '1' THEN 15.0 WHEN '2' THEN 8.0 ELSE 0.0 END AS economics, CASE c % 5 WHEN 0 THEN 10.0 WHEN 1 THEN 8.0 WHEN 2 THEN 3.0 WHEN 3 THEN 1.0 ELSE 0.0 END AS source, round(t * 10, 2) AS trust, round(f * 5, 2) AS freshness, CASE WHEN c % 7 = 0 THEN 5.0 ELSE 0.0 END AS easy_entry, -(CASE WHEN c % 10 < 5 THEN 5.0 ELSE 0.0 END + CASE WHEN c % 10 = 3 THEN 3.0 ELSE 0.0 END) AS risk FROM o)
SELECT o_orderkey, match, source, economics, risk AS risk_adjustment, round(role_priority + match + language_edge + economics + source + trust + freshness + easy_entry + risk, 2) AS score FROM q"""
)
def priority_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every order's score as a listing, and their sum."""
    c, one = F.col("o_custkey"), lambda d, key: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])[key]
    grades = {
        "match": one({"F": "strong", "O": "medium", "P": "weak"}, F.col("o_orderstatus")),
        "economics": one({"1": "excellent", "2": "viable", "3": "unknown", "4": "below_floor", "5": "unknown"}, F.left("o_orderpriority", F.lit(1))),
        "source": one({0: "original_ats", 1: "reputable_board", 2: "aggregator_unresolved", 3: "unknown", 4: "content_farm"}, (c % 5).cast("int")),
    }
    parts = ranking.priority_components(c % 4, c % 3 == 0, c % 7 == 0, (F.col("o_totalprice") / 1000000).cast("double"), 1.0 / (1 + c % 8), grades, (c % 10) / 10.0, F.when(c % 10 == 3, 0.3))
    return orders(spark, sf_dir).select("o_orderkey", parts.alias("p")).select("o_orderkey", "p.match", "p.source", "p.economics", "p.risk_adjustment", "p.score")
