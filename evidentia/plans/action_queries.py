"""Life cycle and next action over orders, with reviewed outcomes projected from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import actions
from .event_queries import events
from .registry import query, table

CLOCK = "2001-08-02 00:00:00"
EVENT_CLOCK = "2024-01-05 00:00:00"


@query(
    f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p, date_diff('day', o_orderdate, TIMESTAMP '{CLOCK}') AS age FROM orders),
f AS (SELECT *, c % 11 = 0 AS blocked, age > 14 AND c % 5 = 2 AS spent, NOT s = 'F' AND age > 30 AS stale, c % 4 = 0 AS lacking, c % 9 = 0 AS closed, age >= 0 AND c % 17 = 0 AS late FROM o),
l AS (SELECT *, CASE WHEN stale THEN 'stale_unresolved_copy' WHEN spent THEN 'verification_exhausted' WHEN NOT blocked AND p = '1-URGENT' THEN 'application_already_submitted' WHEN blocked THEN 'known_account_block' WHEN late THEN 'captured_application_deadline_elapsed' WHEN closed THEN 'matching_source_explicitly_closed' WHEN c % 13 = 0 THEN 'pool_not_allocated_work' END AS r FROM f),
m AS (SELECT *, CASE WHEN r IS NULL THEN 'active' WHEN r IN ('captured_application_deadline_elapsed', 'matching_source_explicitly_closed') THEN 'closed' ELSE 'watch' END AS lc, CASE WHEN blocked THEN 1 ELSE 0 END + CASE WHEN lacking THEN 1 ELSE 0 END AS n FROM l),
w AS (SELECT *, CASE WHEN lc <> 'active' THEN CASE WHEN r = 'application_already_submitted' THEN 'await_response' WHEN n = 0 THEN 'await_change' ELSE 'verify' END WHEN n = 0 THEN 'apply' ELSE 'verify' END AS a, closed AND lc <> 'closed' AS again FROM m)
SELECT k AS o_orderkey, CASE WHEN again THEN 'closed' ELSE lc END AS lifecycle, CASE WHEN again THEN 'matching_source_explicitly_closed' ELSE r END AS reason, CASE WHEN closed OR late THEN CASE WHEN again OR lc = 'closed' THEN 'closed' ELSE 'blocked' END WHEN lc <> 'active' THEN 'watch' WHEN n = 0 THEN 'application_ready' ELSE 'verification_needed' END AS readiness, CASE WHEN closed OR late THEN 'skip' ELSE a END AS action,
  CASE WHEN again THEN '' ELSE concat_ws(',', CASE WHEN blocked THEN 'project_access' END, CASE WHEN lacking THEN 'full_matching_requirements' END) END AS tasks FROM w"""
)
def action_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order through the whole table; facts from its customer, state, priority and date."""
    c, day = F.col("o_custkey"), F.col("o_orderdate").cast("timestamp")
    clock = F.lit(CLOCK).cast("timestamp")
    facts = {
        "account_block": c % 11 == 0, "attempts": F.when(c % 5 == 2, 2).otherwise(0), "posted": day, "authoritative": F.col("o_orderstatus") == "F", "complete": c % 4 != 0, "route": F.lit(True), "open_at": clock - F.expr("INTERVAL 1 HOUR"),
        "closed": c % 9 == 0, "deadline": F.when(c % 17 == 0, day), "pool": c % 13 == 0, "application_state": F.when(F.col("o_orderpriority") == "1-URGENT", "waiting"), "eligibility": F.lit("passed"), "observed_at": clock,
    }
    out = actions.acted(table(spark, sf_dir, "orders").withColumns(facts), clock)
    return out.select("o_orderkey", "lifecycle", "reason", "readiness", "action", F.array_join("tasks", ",").alias("tasks"))


@query(
    f"""WITH e AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'application_state' WHEN 'click' THEN 'buyer_reply' ELSE 'project_access' END AS predicate, CASE event_type WHEN 'purchase' THEN CASE WHEN value > 80 THEN 'rejected' ELSE 'waiting' END WHEN 'click' THEN 'yes' WHEN 'error' THEN 'blocked' ELSE 'accessible' END AS v, date_trunc('day', ts) AS day_ FROM events WHERE event_type IN ('purchase', 'signup', 'error', 'click') AND date_trunc('day', ts) <= TIMESTAMP '{EVENT_CLOCK}'),
l AS (SELECT user_id, predicate, max(day_) AS day_ FROM e GROUP BY ALL),
p AS (SELECT user_id, predicate, max(v) AS v, day_, min(v) <> max(v) AS clash FROM e JOIN l USING (user_id, predicate, day_) GROUP BY ALL),
u AS (SELECT user_id, bool_or(clash) AS clash, bool_or(predicate = 'application_state' AND v = 'rejected') AS ended, bool_or(predicate = 'project_access' AND v = 'blocked') AS blocked, bool_or(predicate = 'buyer_reply') AS reply, bool_or(predicate = 'buyer_reply' AND day_ >= TIMESTAMP '{EVENT_CLOCK}' - INTERVAL 2 DAY) AS fresh, bool_or(predicate = 'project_access' AND v = 'accessible' AND day_ < TIMESTAMP '{EVENT_CLOCK}' - INTERVAL 2 DAY) AS old,
  string_agg('outcome_conflict:' || predicate, ',' ORDER BY predicate) FILTER (clash) AS clashes FROM p GROUP BY user_id)
SELECT user_id, CASE WHEN clash THEN 'watch' WHEN ended THEN 'closed' WHEN blocked THEN 'watch' WHEN reply THEN CASE WHEN fresh THEN 'active' ELSE 'watch' END WHEN old THEN 'watch' ELSE 'active' END AS lifecycle,
  CASE WHEN clash THEN 'outcome_conflict' WHEN ended THEN 'exact_application_closed' WHEN blocked THEN 'known_account_block' WHEN reply THEN CASE WHEN fresh THEN 'current_buyer_reply' ELSE 'buyer_update_needs_recheck' END WHEN old THEN 'access_evidence_stale' END AS reason,
  CASE WHEN clash THEN 'verify' WHEN ended THEN 'await_change' WHEN blocked THEN 'verify' WHEN reply THEN CASE WHEN fresh THEN 'clarify_scope' ELSE 'await_change' END WHEN old THEN 'verify' ELSE 'apply' END AS action,
  CASE WHEN clash THEN clashes WHEN ended OR blocked OR reply THEN '' WHEN old THEN 'project_access' ELSE '' END AS tasks FROM u"""
)
def reviewed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users' events, as reviewed facts as of a clock, make of an application that is otherwise ready."""
    e, clock = events(spark, sf_dir), F.lit(EVENT_CLOCK).cast("timestamp")
    kind = F.col("event_type")
    value = F.when(kind == "purchase", F.when(F.col("value") > 80, "rejected").otherwise("waiting")).when(kind == "click", "yes").when(kind == "error", "blocked").otherwise("accessible")
    predicate = F.when(kind == "purchase", "application_state").when(kind == "click", "buyer_reply").otherwise("project_access")
    facts = e.where(kind.isin("purchase", "signup", "error", "click")).select("user_id", predicate.alias("predicate"), value.alias("value"), F.date_trunc("day", "ts").alias("event_at"), F.lit(None).cast("timestamp").alias("expires_at"), F.lit("provider").alias("source"))
    ready = {"posted": clock, "authoritative": F.lit(True), "complete": F.lit(True), "route": F.lit(True), "open_at": clock, "eligibility": F.lit("passed"), "observed_at": clock}
    out = actions.acted(actions.projected(facts, "user_id", clock).withColumns(ready), clock)
    return out.select("user_id", "lifecycle", "reason", "action", F.array_join("tasks", ",").alias("tasks"))
