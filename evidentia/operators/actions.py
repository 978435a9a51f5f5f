"""Life cycle and next action of listings: a decision table in stages, applied to captured facts and to the projection of reviewed outcomes as of a clock.

Each stage is a list of rules in order. In the life cycle the last rule that holds decides,
as later facts overrule earlier ones; in every other stage the first one does. Tasks are the
facts still to be verified, in the order in which they are asked for. A column that the input
lacks is unknown: nothing follows from it.

Only captured evidence makes anything ready. What is unknown (access, pay, timing) stays a
task; watching is no rejection; a blocker takes away every action but leaves the evidence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times


@dataclass(frozen=True)
class Limits:
    """Days and hours of the policy."""

    open_hours: float = 48
    marketplace_hours: float = 24
    watch_days: float = 14
    copy_days: float = 30
    buyer_days: float = 60
    most_cycles: int = 2
    half_life: float = 14
    easy_half_life: float = 30


#: Columns that rules read, and their kinds.
INPUTS = {
    **dict.fromkeys(("non_job", "pool", "closed", "thread", "thread_invalid", "thread_locked", "thread_unpaid", "complete", "marketplace", "route", "evidence_expired", "account_block", "new_evidence", "authoritative", "easy", "high_effort", "cost_approved", "scope_verified", "competition_checked", "account_specific", "allocated", "paid_terms", "binding_hold", "legacy_conflict"), "boolean"),
    **dict.fromkeys(("open_at", "observed_at", "next_check", "deadline", "posted", "buyer_at", "first_failed", "allocated_at"), "timestamp"),
    **dict.fromkeys(("thread_intent", "thread_terms", "application_state", "assessment_state", "access", "payout", "invitation_state", "invitation_route", "assessment_route", "assessment_step", "eligibility", "timing_reference"), "string"),
    **dict.fromkeys(("lead_hours", "cash", "timing_days"), "double"),
    "attempts": "int",
    "unresolved": "array<string>",
    "blockers": "array<string>",
    "outcomes": "map<string,struct<value:string,event_at:timestamp,expires_at:timestamp,source:string,conflict:boolean>>",
}
CHANGED = ("scope_changed", "budget_changed", "ambiguous", "incomplete")
LATER = ("current_open_status", "application_route")  # what an own invitation or task makes needless
#: Unresolved facts that are tasks of their own, by how they begin.
CITED = ("equipment_compatibility:", "language_unverified:", "credential_unverified:", "requirement_unverified:", "experience_unverified:", "specialist_", "location_scope_", "pay_conflict", "title_truncated", "company_identity_")


def no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def listed(pairs: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(yes(c), F.lit(name)) for c, name in pairs]))


def first(rules: list[tuple], part: int, default: Column) -> Column:
    out = default
    for rule in reversed(rules):
        out = F.when(yes(rule[0]), rule[part] if isinstance(rule[part], Column) else F.lit(rule[part])).otherwise(out)
    return out


def projected(facts: DataFrame, subject: str, as_of: Column) -> DataFrame:
    """Per subject the reviewed facts (predicate, value, event_at, expires_at, source) as of a clock, as outcomes: the latest of each predicate; those of one time that differ conflict.

    Later facts don't exist yet; facts without a time come before all others. Aggregates of (subject, predicate)
    alone, so a subject's history is never gathered.
    """
    known = facts.where(F.col("event_at").isNull() | (F.col("event_at") <= as_of))
    at = F.struct(F.col("event_at").isNotNull().alias("dated"), "event_at")
    last = known.groupBy(subject, "predicate").agg(F.max(at).alias("_last"))
    k = known.join(last.hint("merge"), [subject, "predicate"]).where(F.col("event_at").eqNullSafe(F.col("_last.event_at")))
    fact = k.groupBy(subject, "predicate").agg(F.max("value").alias("value"), F.max("event_at").alias("event_at"), F.min("expires_at").alias("expires_at"), F.min("source").alias("source"), (F.min("value") != F.max("value")).alias("conflict"))
    pair = F.struct("predicate", F.struct("value", "event_at", "expires_at", "source", F.coalesce("conflict", F.lit(False)).alias("conflict")))
    return fact.groupBy(subject).agg(F.map_from_entries(F.collect_list(pair)).alias("outcomes"))


def acted(df: DataFrame, as_of: Column, limits: Limits = Limits()) -> DataFrame:
    """df with lifecycle, reason, readiness, action, tasks, blockers, eligibility, freshness, time_to_cash_days and rule, the names of the rules that decided the action."""
    missing = {c: F.lit(None).cast(t) for c, t in INPUTS.items() if c not in df.columns}
    df = df.withColumns(missing).withColumns({"unresolved": F.coalesce("unresolved", F.array().cast("array<string>")), "blockers": F.coalesce("blockers", F.array().cast("array<string>")), "eligibility": F.coalesce("eligibility", F.lit("unknown")), "_now": as_of})
    c, now = F.col, F.col("_now")
    ago = lambda t: times.days_between(t, now)
    buyer = yes(c("thread")) & yes(c("thread_intent") == "buyer")
    changed = buyer & c("thread_terms").isin(*CHANGED)

    # facts that several rules share
    shown = F.when(buyer & (c("buyer_at") <= now), c("buyer_at")).otherwise(c("posted"))
    df = df.withColumns({"_age": F.when(shown.isNotNull(), F.greatest(F.lit(0.0), ago(shown))), "_failing": F.greatest(F.lit(0.0), F.coalesce(ago(F.coalesce("first_failed", F.when(c("attempts") > 0, c("observed_at")))), F.lit(0.0)))})
    hours = F.when(yes(c("marketplace")), limits.marketplace_hours).otherwise(limits.open_hours)
    df = df.withColumns(
        {
            "_old": F.when(c("_age").isNotNull(), c("_age") > limits.watch_days).otherwise(c("_failing") > limits.watch_days),
            "_fresh": yes((c("open_at") <= now) & (ago(c("open_at")) * 24 <= hours)),
            "_over": yes(c("next_check") <= now),
            "_late": yes(c("deadline") <= now),
        }
    )
    current = yes(c("observed_at") <= now) & ~c("_over") & no(c("evidence_expired"))

    # life cycle: the last rule that holds
    active = F.lit("active")
    state, reason = active, F.lit(None).cast("string")
    for holds, s, r in [
        (c("pool"), "watch", "pool_not_allocated_work"),
        (c("closed"), "closed", "matching_source_explicitly_closed"),
        (c("_late"), "closed", "captured_application_deadline_elapsed"),
        (yes(c("account_block")) & ~c("_over"), "watch", "known_account_block"),
        (yes(c("account_block")) & c("_over"), "watch", "account_block_recheck_due"),
        (no(c("account_block")) & c("application_state").isin("applied", "applied_waiting", "waiting"), "watch", "application_already_submitted"),
        (no(c("account_block")) & no(c("application_state").isin("applied", "applied_waiting", "waiting")) & c("assessment_state").isin("completed", "passed", "submitted"), "watch", "assessment_already_completed"),
        ((c("attempts") >= limits.most_cycles) & no(c("new_evidence")) & c("_old"), "watch", "verification_exhausted"),
        (no(c("authoritative")) & (c("_age") > limits.copy_days), "watch", "stale_unresolved_copy"),
        (no(c("authoritative")) & c("_age").isNull() & (c("attempts") >= 1) & c("_old"), "watch", "undated_copy_verification_exhausted"),
    ]:
        state, reason = F.when(yes(holds), s).otherwise(state), F.when(yes(holds), r).otherwise(reason)
    df = df.withColumns({"lifecycle": state, "reason": reason})
    historical = buyer & yes(c("_age") > limits.buyer_days) & (c("lifecycle") == "active")
    df = df.withColumns({"lifecycle": F.when(historical, "watch").otherwise(c("lifecycle")), "reason": F.when(historical, "historical_buyer_request").otherwise(c("reason"))})
    df = df.withColumn("freshness", F.coalesce(F.pow(F.lit(2.0), -c("_age") / F.when(yes(c("easy")), limits.easy_half_life).otherwise(limits.half_life)), F.lit(0.0)))
    lead = ~c("_late") & ((F.unix_timestamp("deadline") - F.unix_timestamp(now)) < c("lead_hours") * 3600)
    found = listed([(lead, "deadline_infeasible"), (c("_late"), "source_quality:application_deadline_elapsed"), (c("closed"), "source_quality:explicitly_closed"), (c("thread_invalid"), "source_quality:thread_evidence_invalid"), (c("non_job"), "source_quality:non_opportunity")])
    df = df.withColumn("blockers", F.concat(found, "blockers"))

    # tasks
    cheap = F.when(c("cash").isNull(), no(c("marketplace")) & no(c("high_effort"))).when(c("cash") > 0, yes(c("cost_approved"))).otherwise(True)
    bid = yes(c("marketplace")) & ~(yes(c("scope_verified")) & c("cash").isNotNull() & yes(c("competition_checked")))
    granted = c("access").isin("accessible", "verified")
    early = listed([(changed, "community_scope_revision"), (yes(c("thread_locked")) & no(c("closed")), "community_contact_route"), (c("account_block"), "project_access"), (no(c("complete")), "full_matching_requirements"), (~c("_fresh"), "current_open_status"), (no(c("route")), "application_route")])
    cited = F.filter(F.array_distinct("unresolved"), lambda u: u.rlike("^(" + "|".join(CITED) + ")"))
    asked = F.concat(early, cited)
    urgent = lambda u: u.startswith("location_scope_conflict:")
    ordered = F.concat(F.filter(asked, urgent), F.filter(asked, lambda u: ~urgent(u)))
    late = listed([(bid, "bid_cost_scope_competition"), (~bid & ~cheap, "onboarding_cost"), (yes(c("account_specific")) & no(granted), "project_access")])
    df = df.withColumns({"tasks": F.array_distinct(F.concat(ordered, late)), "_cheap": cheap & ~bid})

    # action: the first rule that holds
    other = F.exists("tasks", lambda t: ~t.isin(*LATER))
    passed = (c("eligibility") == "passed") & no(c("account_block")) & ~other
    allocation = current & yes((F.coalesce("allocated_at", "observed_at") <= now) & (ago(F.coalesce("allocated_at", "observed_at")) * 24 <= limits.open_hours))
    at_work = yes(c("allocated")) & yes(granted) & allocation & yes(c("paid_terms"))
    none = F.array().cast("array<string>")
    fewer = F.filter("tasks", lambda t: ~t.isin(*LATER))
    rules = [
        (at_work & no(c("payout").isin("blocked", "failed", "disabled")) & passed, "allocated_task", "allocated", "start_allocated_task", fewer),
        (c("invitation_state").isin("received", "pending_response") & current & c("invitation_route").isNotNull() & c("_cheap") & passed, "invitation", "captured_next_step", "respond_to_invitation", none),
        (c("assessment_state").isin("pending", "invited", "required") & current & c("assessment_route").isNotNull() & c("assessment_step").isNotNull() & c("_cheap") & passed, "known_step", "captured_next_step", "complete_known_step", none),
        ((F.size("tasks") == 0) & (c("lifecycle") == "active"), "application", "application_ready", "apply", none),
        (F.lit(True), "verification", "verification_needed", "verify", c("tasks")),
    ]
    df = df.withColumns({n: first(rules, i, F.lit(None)) for i, n in ((1, "rule"), (2, "readiness"), (3, "action"), (4, "tasks"))})
    open_ = c("action").isin("apply", "verify")
    unpaid, terms = yes(c("thread_unpaid")) & yes(c("thread")) & open_, changed & open_
    df = df.withColumns({"_unpaid": unpaid, "_terms": terms})
    place = lambda t: F.when(urgent(t), 0).when(c("_unpaid") & (t == "community_paid_scope"), 1).when(c("_terms") & (t == "community_scope_revision"), 2).otherwise(3)
    more = F.when(c("_unpaid"), F.array_distinct(F.concat("tasks", F.array(F.lit("community_paid_scope"))))).otherwise(c("tasks"))
    df = df.withColumn("_more", more)
    at = lambda k: F.filter("_more", lambda t: place(t) == k)
    sorted_ = F.flatten(F.array(*[at(k) for k in range(4)]))
    again = c("_unpaid") | c("_terms")
    df = df.withColumns({"tasks": F.when(again, sorted_).otherwise(c("tasks")), "readiness": F.when(again, "verification_needed").otherwise(c("readiness")), "action": F.when(again, "verify").otherwise(c("action")), "rule": F.when(c("_unpaid"), "paid_scope").when(c("_terms"), "changed_terms").otherwise(c("rule"))})
    idle = c("lifecycle") != "active"
    waits = [(idle & (c("reason") == "historical_buyer_request"), "await_change"), (idle & c("reason").isin("application_already_submitted", "assessment_already_completed"), "await_response"), (idle & (F.size("tasks") == 0), "await_change")]
    df = df.withColumns({"action": first(waits, 1, c("action")), "readiness": F.when(idle, "watch").otherwise(c("readiness")), "rule": F.when(idle, F.concat_ws(":", F.lit("idle"), "reason")).otherwise(c("rule"))})
    paid = c("payout").isin("verified", "complete") & at_work & no(c("account_block"))
    df = df.withColumn("time_to_cash_days", F.when(yes(paid & (c("timing_days") >= 0) & c("timing_reference").isNotNull()), c("timing_days")))
    return closed_off(reviewed(df, limits))


def reviewed(df: DataFrame, limits: Limits) -> DataFrame:
    """The table of reviewed outcomes: the first rule that holds may refine what acted() found, never against a blocker."""
    c, now = F.col, F.col("_now")
    fact = lambda p: F.try_element_at("outcomes", F.lit(p))
    value = lambda p: fact(p)["value"]
    fresh = lambda p: yes(no(fact(p)["source"] == "reviewed_seed") & (fact(p)["event_at"] <= now) & (times.days_between(fact(p)["event_at"], now) * 24 <= limits.open_hours) & (fact(p)["expires_at"].isNull() | (now < fact(p)["expires_at"])))
    dated = lambda p: yes((fact(p)["event_at"] <= now) & (fact(p)["expires_at"].isNull() | (now < fact(p)["expires_at"])))
    any_ = yes(F.size(F.map_keys("outcomes")) > 0)
    clash = F.array_sort(F.map_keys(F.map_filter("outcomes", lambda _, f: f["conflict"])))
    scoped = F.exists(F.map_keys("outcomes"), lambda k: k.startswith("assessment_step/"))
    chosen = value("assessment_step")
    step = lambda p: F.when(chosen.isNotNull(), value_of(p, chosen)).when(yes(scoped), F.lit(None)).otherwise(value(p))

    def value_of(p: str, name: Column) -> Column:
        return F.try_element_at("outcomes", F.concat(F.lit("assessment_step/"), name, F.lit(f"/{p}")))["value"]

    step_fresh = lambda p: F.when(chosen.isNotNull(), fresh_of(F.concat(F.lit("assessment_step/"), chosen, F.lit(f"/{p}")))).otherwise(fresh(p))

    def fresh_of(key: Column) -> Column:
        f = F.try_element_at("outcomes", key)
        return yes(no(f["source"] == "reviewed_seed") & (f["event_at"] <= now) & (times.days_between(f["event_at"], now) * 24 <= limits.open_hours) & (f["expires_at"].isNull() | (now < f["expires_at"])))

    blocked = (F.size("blockers") > 0) | yes(c("account_block")) | yes(c("reason") == "known_account_block")
    fewer = F.filter("tasks", lambda t: ~t.isin(*LATER))
    plus = lambda *names: F.array_distinct(F.concat("tasks", F.array(*[F.lit(n) for n in names])))
    none = F.array().cast("array<string>")
    invited = yes(step("assessment_state") == "invited")
    checked = yes(step("action_checks") == "privacy,schedule,equipment,cost") & step("assessment_route").isNotNull() & step_fresh("assessment_state") & step_fresh("action_checks") & step_fresh("assessment_route") & (chosen.isNull() | fresh("assessment_step"))
    left = (c("eligibility") != "passed") | (F.size(fewer) > 0)
    setup = F.exists(F.map_keys("outcomes"), lambda k: k.startswith("setup_"))
    conflicts = (F.size(clash) > 0) | yes(c("legacy_conflict"))
    keep = (c("lifecycle"), c("reason"), c("readiness"), c("action"), c("tasks"))
    # holds, rule, lifecycle, reason, readiness, action, tasks
    rules = [
        (~any_, "", *keep),
        (conflicts, "conflict", "watch", "outcome_conflict", "watch", "verify", F.array_distinct(F.concat("tasks", F.transform(clash, lambda p: F.concat(F.lit("outcome_conflict:"), p))))),
        (value("application_state").isin("rejected", "withdrawn"), "ended", "closed", "exact_application_closed", "watch", "await_change", none),
        (value("project_access") == "blocked", "no_access", "watch", "known_account_block", "watch", "verify", c("tasks")),
        (step("assessment_state").isin("completed", "passed"), "assessed", "watch", "assessment_already_completed", "watch", "await_response", none),
        (blocked, "", *keep),
        (chosen.isNull() & yes(scoped), "no_step", "watch", "assessment_step_not_selected", "verification_needed", "verify", plus("current_assessment_step")),
        (chosen.isNotNull() & step("assessment_state").isNull(), "step_unknown", "active", "assessment_step_state_unknown", "verification_needed", "verify", plus("assessment_step_state")),
        (value("buyer_reply").isNotNull() & ~fresh("buyer_reply"), "old_reply", "watch", "buyer_update_needs_recheck", "watch", "await_change", c("tasks")),
        (value("buyer_reply").isNotNull(), "reply", "active", "current_buyer_reply", "captured_next_step", "clarify_scope", fewer),
        (invited & left, "invited_unverified", "active", "existing_assessment_invitation", "verification_needed", "verify", c("tasks")),
        (invited & ~checked, "invited_unchecked", "active", "existing_assessment_invitation", "verification_needed", "verify", plus("assessment_prerequisites")),
        (invited, "invited", "active", "existing_assessment_invitation", "captured_next_step", "complete_known_step", fewer),
        ((value("project_access") == "accessible") & ~fresh("project_access"), "old_access", "watch", "access_evidence_stale", "watch", "verify", plus("project_access")),
        (~yes(setup), "", *keep),
        ((value("setup_checklist") == "completed") & dated("setup_checklist") & dated("setup_selection"), "setup_done", "watch", "setup_checklist_completed", "watch", "await_response", none),
        (F.lit(True), "setup_open", "active", "setup_checklist_needs_review", "verification_needed", "verify", plus("setup_checklist")),
    ]
    names = ("outcome_rule", "lifecycle", "reason", "readiness", "action", "tasks")
    out = df.withColumns({n: first(rules, i + 1, F.lit(None)) for i, n in enumerate(names)})
    return out.withColumn("rule", F.when(c("outcome_rule") != "", F.concat(F.lit("outcome:"), "outcome_rule")).otherwise(c("rule"))).drop("outcome_rule")


def closed_off(df: DataFrame) -> DataFrame:
    """The last word: several attempts hold, a closed source stays closed, and a blocker leaves nothing to do."""
    c = F.col
    hold, shut = yes(c("binding_hold")), yes(c("closed"))
    tasks = F.when(hold, F.array_distinct(F.concat("tasks", F.array(F.lit("active_outcome_attempt"))))).otherwise(c("tasks"))
    df = df.withColumns({"tasks": tasks, "readiness": F.when(hold, "verification_needed").otherwise(c("readiness")), "action": F.when(hold, "verify").otherwise(c("action")), "rule": F.when(hold, "binding_hold").otherwise(c("rule"))})
    again = shut & (c("lifecycle") != "closed")
    df = df.withColumns({"reason": F.when(again, "matching_source_explicitly_closed").otherwise(c("reason")), "readiness": F.when(again, "watch").otherwise(c("readiness")), "tasks": F.when(again, F.slice("tasks", 1, 0)).otherwise(c("tasks")), "lifecycle": F.when(again, "closed").otherwise(c("lifecycle"))})
    veto = F.size("blockers") > 0
    df = df.withColumns({"eligibility": F.when(veto, "failed").otherwise(c("eligibility")), "readiness": F.when(veto & (c("lifecycle") == "closed"), "closed").when(veto, "blocked").otherwise(c("readiness")), "action": F.when(veto, "skip").otherwise(c("action")), "rule": F.when(veto, "veto").otherwise(c("rule"))})
    return df.drop(*[x for x in df.columns if x in ("_now", "_age", "_failing", "_old", "_fresh", "_over", "_late", "_cheap", "_unpaid", "_terms", "_more")])
