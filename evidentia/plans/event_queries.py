"""Queries over events, each with its SQL or with a reason for none in its text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, times
from ..operators import history, joins, ledger, outcomes, state
from .registry import query, table

#: The decision clock of these queries.
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with props.k as a number and the moment as a timestamp in UTC."""
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("long")).withColumn("ts", F.col("ts").cast("timestamp"))


def moment(c: str, name: str | None = None) -> F.Column:
    return F.unix_micros(F.col(c)).alias(name or c)


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "k")


@query("SELECT event_id FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'purchase' AND s.user_id = e.user_id AND json_extract_string(s.props, '$.k') = json_extract_string(e.props, '$.k'))")
def seen_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return joins.idle(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), ["user_id", "k"]).select("event_id")


@query("SELECT event_id FROM events e WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'error' AND s.user_id = e.user_id AND s.value > 489)")
def busy_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return joins.idle(e.where("event_type = 'signup'"), e.where("event_type = 'error' and value > 489"), ["user_id"]).select("event_id")


@query("SELECT event_id FROM events e WHERE event_type = 'signup' AND EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'click' AND s.user_id = e.user_id AND s.value > 480)")
def ready_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return joins.with_any(e.where("event_type = 'signup'"), e.where("event_type = 'click' and value > 480"), ["user_id"]).select("event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'purchase') WHERE n = 1")
def last_delivered_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("success", F.col("event_type") == "purchase")
    none = spark.createDataFrame([], "old_id long, new_id long")
    users = e.select("user_id").distinct()
    return joins.last_success(users, e, none, "user_id", "ts", "event_id", ["event_id"]).where("last is not null").select("user_id", "last.event_id")


@query(
    """WITH w AS (SELECT *, value > 300 AS top, lag(event_type) OVER p AS prev, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS told,
  CASE event_type WHEN 'error' THEN 'reject' WHEN 'view' THEN 'verify' ELSE 'primary' END AS band FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT *, lag(band) OVER p AS pb, lag(event_type) OVER p AS pu, lag(CASE WHEN top THEN value END) OVER p AS pp FROM w WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN band = 'reject' THEN 'none' WHEN pb IS NULL OR NOT told THEN 'new' WHEN pb = 'verify' AND band = 'primary' THEN 'promoted' WHEN pb = 'reject' THEN 'restored'
  WHEN pu IS DISTINCT FROM event_type AND band = 'primary' THEN 'moved' WHEN pp IS NULL AND top THEN 'pay_resolved' ELSE 'none' END AS transition FROM x"""
)
def previous_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("band", F.when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "view", "verify").otherwise("primary"))
    e = e.withColumn("pay", F.when(F.col("value") > 300, F.col("value"))).withColumn("told", F.col("event_type") == "purchase")
    return history.transitions(e, ["user_id"], "ts", "event_id", "band", "event_type", "pay", "told").select("event_id", "transition")


@query(
    """WITH w AS (SELECT *, CASE WHEN value > 300 THEN 'high' ELSE 'low' END AS m FROM events),
x AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN m END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS told FROM w)
SELECT event_id, CASE WHEN told IS NULL THEN 'new' WHEN told = m THEN 'none' ELSE 'material_change' END AS change FROM x"""
)
def delivered_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("told", F.col("event_type") == "purchase").withColumn("m", F.when(F.col("value") > 300, "high").otherwise("low"))
    return history.against_delivered(e, ["user_id"], "ts", "event_id", "told", "m").select("event_id", "change")


@query(
    """WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER p IS NOT DISTINCT FROM event_type AND row_number() OVER p > 1 THEN 0 ELSE 1 END AS changed FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision FROM c),
g AS (SELECT user_id, revision, max(event_type) AS event_type, epoch_us(min(ts)) AS valid_from, count(*) AS n FROM r GROUP BY 1, 2)
SELECT user_id, revision::BIGINT AS revision, event_type, valid_from, n, lead(valid_from) OVER (PARTITION BY user_id ORDER BY revision) AS valid_to FROM g"""
)
def scd2_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history.validity(events(spark, sf_dir), ["user_id"], "ts", "event_id", "event_type")
    return out.select("user_id", "revision", "event_type", moment("valid_from"), "n", moment("valid_to"))


@query(
    """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS topic FROM events),
g AS (SELECT *, ts < max(ts) OVER (PARTITION BY user_id, topic, event_type) AND event_type <> 'purchase' AS gone FROM e)
SELECT event_id, CASE WHEN gone THEN 'superseded' WHEN (SELECT count(DISTINCT floor(h.value / 100)) FROM g h WHERE h.user_id = g.user_id AND h.topic = g.topic AND NOT h.gone) > 1 THEN 'conflict' ELSE 'current' END AS disposition FROM g"""
)
def latest_wins_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("topic", F.col("k") % 5).withColumn("v", F.floor(F.col("value") / 100))
    return history.latest_facts(e, ["user_id", "topic"], ["event_type"], "ts", "event_id", "v", F.col("event_type") == "purchase").select("event_id", "disposition")


@query(
    """WITH f AS (SELECT *, event_type IN ('error', 'view') AS bad FROM events), i AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f)
SELECT event_id, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER w::BIGINT AS cycles, CASE WHEN bad THEN epoch_us(min(CASE WHEN bad THEN ts END) OVER w) END AS first_failed,
  CASE WHEN sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER w >= 2 THEN epoch_us(ts + INTERVAL 14 DAY) END AS next_check FROM i WINDOW w AS (PARTITION BY user_id, island ORDER BY ts, event_id)"""
)
def verification_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("bad", F.col("event_type").isin("error", "view"))
    out = history.verification(e, ["user_id"], "ts", "event_id", "bad", 2, 14)
    return out.select("event_id", "cycles", moment("first_failed"), moment("next_check"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, ts, t_end, found, row_number() OVER (PARTITION BY user_id ORDER BY t_end, found, event_id) AS i FROM (SELECT *, ts + to_days(CAST(floor(value / 100) AS INTEGER)) AS t_end, event_type = 'purchase' AS found FROM events)),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0 AS n, NULL::TIMESTAMP AS until FROM e UNION ALL SELECT f.user_id, e.i, CASE WHEN found THEN 0 WHEN until IS NULL OR ts >= until THEN n + 1 ELSE n END, CASE WHEN found THEN NULL WHEN until IS NULL OR ts >= until THEN t_end ELSE until END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, arg_max(n, i)::INTEGER AS streak FROM f GROUP BY user_id"""
)
def zero_yield_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold: whether a check counts depends on which one before it counted."""
    e = events(spark, sf_dir).withColumn("end", F.col("ts") + F.expr("make_dt_interval(cast(value / 100 as int))")).withColumn("found", F.col("event_type") == "purchase")
    return history.zero_streak(e, ["user_id"], "ts", "end", "found", "event_id")


@query(
    """WITH RECURSIVE d AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS items, count(*) FILTER (event_type = 'error') AS errors, min(event_type) AS error FROM events GROUP BY 1, 2),
r AS (SELECT *, epoch_us(day)::BIGINT AS m, CASE WHEN errors = items THEN 'failed' WHEN errors * 3 > items THEN 'partial' ELSE 'ok' END AS s, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM d),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::VARCHAR AS b, 0::BIGINT AS had, '' AS cause, NULL::BIGINT AS told, NULL::BIGINT AS m, NULL::VARCHAR AS alert FROM r
UNION ALL SELECT user_id, i, s, items, error, CASE WHEN alert = 'none' THEN told ELSE m END, m, alert FROM (SELECT f.user_id, r.i, s, items, r.error, told, r.m, CASE WHEN b IS NULL THEN CASE WHEN s <> 'ok' THEN s ELSE 'none' END WHEN b <> 'ok' AND s = 'ok' THEN 'recovered' WHEN s = 'failed' AND b <> 'failed' THEN 'failed' WHEN b = 'ok' AND s <> 'ok' THEN s
  WHEN told IS NOT NULL AND r.m - told < 86400000000 THEN 'none' WHEN s <> 'ok' AND r.error <> cause THEN 'error_changed' WHEN had > 0 AND items < had AND items <= 0.5 * had THEN 'coverage_drop' ELSE 'none' END AS alert FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1))
SELECT user_id, m AS "at", alert FROM f WHERE i > 0"""
)
def health_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold: an alert silences later ones for a day."""
    by_day = events(spark, sf_dir).groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("items"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.min("event_type").alias("error"))
    status = F.when(F.col("errors") == F.col("items"), "failed").when(F.col("errors") * 3 > F.col("items"), "partial").otherwise("ok")
    out = history.health_transitions(by_day.withColumn("status", status), ["user_id"], "day", "status", "items", "error")
    return out.select("user_id", moment("at"), "alert")


@query(
    """SELECT user_id, count(*) AS attempted, count(*) FILTER (event_type = 'view') AS ok, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'click') AS deferred,
  CASE WHEN count(*) FILTER (event_type = 'error') = count(*) THEN 'failed' WHEN count(*) FILTER (event_type IN ('error', 'click')) > 0 THEN 'partial' ELSE 'ok' END AS status FROM events GROUP BY user_id"""
)
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "deferred")
    return ledger.health(events(spark, sf_dir).withColumn("outcome", outcome), ["user_id"], "outcome")


@query(
    """SELECT user_id, round(sum(floor(value) / 16), 4) AS total_delta, count(*) AS n, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds
FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND event_type <> 'signup' GROUP BY user_id"""
)
def trust_delta_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("delta", F.floor("value") / 16)
    return ledger.delta_report(e, "user_id", "delta", "event_type", "ts", F.expr("TIMESTAMP '2024-01-15 00:00:00'"), "signup")


@query(
    """WITH g AS (SELECT user_id % 10 AS subject, event_type AS dimension, count(*) AS hits, count(DISTINCT user_id) AS outlets FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 2)
SELECT subject, dimension, hits, outlets FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY hits DESC, dimension) AS n FROM g) WHERE n = 1"""
)
def incident_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("ts >= TIMESTAMP '2024-01-20 00:00:00'").select((F.col("user_id") % 10).alias("subject"), F.col("event_type").alias("dimension"), "user_id")
    return ledger.corroborated(e, "subject", "dimension", "user_id", 2)


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS prior, CASE event_type WHEN 'purchase' THEN 4.0 WHEN 'error' THEN -4.0 ELSE 1.0 END AS delta FROM events)
SELECT event_id, CAST(round(1e6 * CASE WHEN delta > 0 THEN delta * pow(0.5, prior) ELSE delta END) AS BIGINT) AS effect_micro FROM n"""
)
def feedback_diminishing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("delta", F.when(F.col("event_type") == "purchase", 4.0).when(F.col("event_type") == "error", -4.0).otherwise(1.0))
    out = state.diminishing(e, ["user_id", "event_type"], "ts", "event_id", "delta", 0.5)
    return out.select("event_id", F.round(F.col("effect") * 1e6).cast("long").alias("effect_micro"))


@query(
    """WITH s AS (SELECT user_id AS platform, CAST(count(*) AS DOUBLE) / 128 AS trust, CAST(max(epoch_us(ts)) AS BIGINT) AS last FROM events GROUP BY 1), d AS (SELECT *, (epoch_us(TIMESTAMP '2024-04-30 00:00:00') - last) // 86400000000 AS idle FROM s)
SELECT platform, CAST(round(1e6 * CASE WHEN idle < 30 OR abs(0.5 - trust) < 1e-4 THEN 0.0 ELSE greatest(-0.01 * idle / 30, least(0.01 * idle / 30, 0.5 - trust)) END) AS BIGINT) AS delta_micro FROM d"""
)
def decay_to_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).groupBy(F.col("user_id").alias("platform")).agg((F.count("*") / 128).alias("trust"), F.max("ts").alias("last"))
    idle = F.floor(times.days_between(F.col("last"), F.expr("TIMESTAMP '2024-04-30 00:00:00'")))
    return s.select("platform", F.round(1e6 * money.decay_delta(F.col("trust"), F.lit(0.5), idle)).cast("long").alias("delta_micro"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, CASE event_type WHEN 'error' THEN -0.2 WHEN 'purchase' THEN 0.15 ELSE 0.01 END::DOUBLE AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0.5::DOUBLE AS x FROM e UNION ALL SELECT f.user_id, e.i, round(least(1.0, greatest(0.0, x + d)), 4) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, arg_max(x, i) AS score, max(i) AS events FROM f GROUP BY user_id"""
)
def clamped_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold: the score is clamped after each event, so the sum of deltas doesn't tell it."""
    e = events(spark, sf_dir).withColumn("delta", F.when(F.col("event_type") == "error", -0.2).when(F.col("event_type") == "purchase", 0.15).otherwise(0.01))
    return state.clamped_score(e, "user_id", "event_id", "delta", 0.5)


@query("SELECT event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) <= 200 AND row_number() OVER (PARTITION BY ts::DATE, event_type ORDER BY ts, event_id) <= 30 AS granted FROM events")
def budget_running_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return state.budgeted(e, "day", [F.col("ts"), F.col("event_id")], "event_type", 200, 30).select("event_id", "granted")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts)::BIGINT AS t, CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'send' WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'fail' ELSE 'noise' END AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'pending' AS s, 0 AS n, 0::BIGINT AS until FROM e
UNION ALL SELECT user_id, i, s2, n + (s2 <> s1 AND s2 = 'sending')::INT, CASE WHEN s2 <> s1 AND s2 IN ('leased', 'sending') THEN t + 86400000000 ELSE until END FROM (SELECT *, CASE WHEN s1 = 'pending' AND a = 'claim' THEN 'leased' WHEN s1 = 'leased' AND a = 'send' THEN 'sending' WHEN s1 = 'sending' AND a = 'ok' THEN 'accepted' WHEN s1 = 'sending' AND a = 'fail' THEN 'pending' ELSE s1 END AS s2
  FROM (SELECT f.user_id, e.i, n, until, t, a, CASE WHEN t > until AND s = 'leased' THEN 'pending' WHEN t > until AND s = 'sending' THEN 'uncertain' ELSE s END AS s1 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)))
SELECT user_id, arg_max(s, i) AS state, arg_max(n, i)::INTEGER AS attempts FROM f GROUP BY user_id"""
)
def queue_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold: leases run out between actions."""
    action = F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "click", "send").when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "fail").otherwise("noise")
    return state.queue(events(spark, sf_dir).withColumn("action", action), "user_id", "event_id", "action", "ts", 86_400)


@query(
    """WITH e AS (SELECT event_id % 7000 AS id, user_id, event_type, ts, CASE WHEN event_id % 9 = 0 THEN (event_id + 450) % 7000 END AS old FROM events),
s AS (SELECT *, CASE WHEN user_id % 20 = 3 THEN 'unmatched_scope' WHEN ts > TIMESTAMP '2024-01-29 00:00:00' THEN 'future_evidence' END AS early FROM e),
k AS (SELECT *, count(DISTINCT CASE WHEN early IS NULL THEN user_id || '|' || event_type END) OVER (PARTITION BY id) AS kinds, row_number() OVER (PARTITION BY id, early ORDER BY ts, md5(user_id || '|' || event_type)) AS n FROM s)
SELECT coalesce(early, CASE WHEN kinds > 1 THEN 'event_id_collision' END, 'usable') AS status, count(*) AS n FROM k GROUP BY 1"""
)
def import_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quarantined(spark, sf_dir)
    shown = F.when(F.col("status").isin("accepted", "duplicate", "invalid_supersession"), "usable").otherwise(F.col("status"))
    return rows.groupBy(shown.alias("status")).agg(F.count("*").alias("n"))


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    named = e.select((F.col("event_id") % 7000).alias("id"), "user_id", "event_type", "ts", F.when(F.col("event_id") % 9 == 0, F.array((F.col("event_id") + 450) % 7000)).otherwise(F.array().cast("array<bigint>")).alias("olds"))
    scopes = e.select("user_id").where("user_id % 20 <> 3").distinct()
    return outcomes.imported(named, "id", "user_id", scopes, "ts", F.expr("TIMESTAMP '2024-01-29 00:00:00'"), F.concat_ws("|", "user_id", "event_type"), "olds", "event_type")


@query(
    """WITH RECURSIVE e AS (SELECT event_id % 7000 AS id, user_id, event_type, ts, CASE WHEN event_id % 9 = 0 THEN (event_id + 450) % 7000 END AS old FROM events),
s AS (SELECT *, CASE WHEN user_id % 20 = 3 THEN 'unmatched_scope' WHEN ts > TIMESTAMP '2024-01-29 00:00:00' THEN 'future_evidence' END AS early FROM e),
k AS (SELECT *, count(DISTINCT CASE WHEN early IS NULL THEN user_id || '|' || event_type END) OVER (PARTITION BY id) AS kinds, row_number() OVER (PARTITION BY id, early ORDER BY ts, md5(user_id || '|' || event_type)) AS n FROM s),
t AS (SELECT *, coalesce(early, CASE WHEN kinds > 1 THEN 'event_id_collision' WHEN n > 1 THEN 'duplicate' ELSE 'accepted' END) AS status FROM k), a AS (SELECT * FROM t WHERE status = 'accepted'),
l AS (SELECT a.id, a.old, coalesce(b.user_id = a.user_id AND b.event_type = a.event_type AND b.ts < a.ts AND b.id <> a.id, false) AS fine FROM a LEFT JOIN a b ON b.id = a.old WHERE a.old IS NOT NULL),
bad AS (SELECT id FROM l WHERE NOT fine UNION SELECT l.id FROM l JOIN bad ON bad.id = l.old), z AS (SELECT CASE WHEN status IN ('accepted', 'duplicate') AND id IN (SELECT id FROM bad) THEN 'invalid' ELSE status END AS status FROM t)
SELECT count(*) AS input, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'duplicate') AS duplicate, count(*) FILTER (status NOT IN ('accepted', 'duplicate')) AS quarantined, true AS balanced FROM z"""
)
def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts after a fixpoint over the events that name others."""
    return outcomes.import_counts(quarantined(spark, sf_dir))


@query(
    f"""SELECT event_id, ts >= {AS_OF} - INTERVAL 48 HOUR AS fresh, {AS_OF} < ts + to_days(CAST(floor(value / 100) AS INTEGER)) AS current FROM events"""
)
def ttl_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.expr(AS_OF)
    e = events(spark, sf_dir).withColumn("expires", F.col("ts") + F.expr("make_dt_interval(cast(floor(value / 100) as int))"))
    return e.select("event_id", times.within(as_of, F.col("ts"), 48).alias("fresh"), times.current(as_of, F.col("expires")).alias("current"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) < max(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM events")
def late_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.late(events(spark, sf_dir), ["user_id"], "event_id", "k").select("event_id", "late")


@query("SELECT user_id, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen, count(*) AS n FROM events GROUP BY user_id")
def first_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history.first_last(events(spark, sf_dir), ["user_id"], "ts")
    return out.select("user_id", moment("first_seen"), moment("last_seen"), "n")


@query("SELECT event_id, event_type <> 'purchase' AND CAST(json_extract_string(props, '$.k') AS BIGINT) < max(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id) AS superseded FROM events")
def superseded_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("sent", F.col("event_type") == "purchase")
    return history.superseded_unsent(e, ["user_id"], "k", "sent").select("event_id", "superseded")


@query("SELECT user_id, array_to_string(list_sort(list(event_type || '=' || k)), ',') AS state FROM (SELECT user_id, event_type, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), event_id) AS k FROM events GROUP BY 1, 2) GROUP BY user_id")
def merged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.merged_state(events(spark, sf_dir), "user_id", "event_type", "k", "event_id", "event_id")
    return out.select("user_id", F.array_join(F.transform(F.map_entries("state"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("state"))


@query("SELECT 'all' AS name, count(*) AS expected, count(*) FILTER (event_type IN ('view', 'click')) + count(*) FILTER (event_type IN ('purchase', 'signup', 'error')) AS found, true AS holds FROM events")
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda *kinds: F.count(F.when(F.col("event_type").isin(*kinds), 1))
    return ledger.conservation(table(spark, sf_dir, "events"), {"all": (F.count("*"), of("view", "click") + of("purchase", "signup", "error"))})
