"""Every rule of the action table fires, with the effects that it names."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidentia.operators import actions

NOW = datetime(2024, 5, 20, 12)
DAY = timedelta(days=1)
READY = dict(complete=True, route=True, open_at=NOW - DAY / 4, authoritative=True, posted=NOW - DAY, eligibility="passed", observed_at=NOW - DAY / 8)


def fact(value, days=0.1, expires=None, source="provider", conflict=False):
    return (value, NOW - days * DAY, expires, source, conflict)


CASES = {
    # name: (facts beside those of READY, (lifecycle, reason, readiness, action, rule), tasks)
    "application": ({}, ("active", None, "application_ready", "apply", "application"), []),
    "verification": ({"complete": None, "open_at": None}, ("active", None, "verification_needed", "verify", "verification"), ["full_matching_requirements", "current_open_status"]),
    "marketplace": ({"marketplace": True, "open_at": NOW - DAY * 1.5}, ("active", None, "verification_needed", "verify", "verification"), ["current_open_status", "bid_cost_scope_competition"]),
    "effort": ({"high_effort": True}, ("active", None, "verification_needed", "verify", "verification"), ["onboarding_cost"]),
    "unapproved": ({"cash": 5.0}, ("active", None, "verification_needed", "verify", "verification"), ["onboarding_cost"]),
    "approved": ({"cash": 5.0, "cost_approved": True}, ("active", None, "application_ready", "apply", "application"), []),
    "account": ({"account_specific": True}, ("active", None, "verification_needed", "verify", "verification"), ["project_access"]),
    "conflict": ({"unresolved": ["language_unverified:dutch", "thread note", "location_scope_conflict:IN"]}, ("active", None, "verification_needed", "verify", "verification"), ["location_scope_conflict:IN", "language_unverified:dutch"]),
    "allocated": ({"allocated": True, "access": "accessible", "paid_terms": True, "open_at": None, "route": None}, ("active", None, "allocated", "start_allocated_task", "allocated_task"), []),
    "allocated_long_ago": ({"allocated": True, "access": "accessible", "paid_terms": True, "allocated_at": NOW - 5 * DAY}, ("active", None, "application_ready", "apply", "application"), []),
    "invitation": ({"invitation_state": "received", "invitation_route": "https://x.example/", "route": None}, ("active", None, "captured_next_step", "respond_to_invitation", "invitation"), []),
    "known_step": ({"assessment_state": "pending", "assessment_route": "r", "assessment_step": "s"}, ("active", None, "captured_next_step", "complete_known_step", "known_step"), []),
    "pool": ({"pool": True}, ("watch", "pool_not_allocated_work", "watch", "await_change", "idle:pool_not_allocated_work"), []),
    "blocked": ({"account_block": True}, ("watch", "known_account_block", "watch", "verify", "idle:known_account_block"), ["project_access"]),
    "recheck": ({"account_block": True, "next_check": NOW}, ("watch", "account_block_recheck_due", "watch", "verify", "idle:account_block_recheck_due"), ["project_access"]),
    "applied": ({"application_state": "waiting"}, ("watch", "application_already_submitted", "watch", "await_response", "idle:application_already_submitted"), []),
    "assessed": ({"assessment_state": "passed"}, ("watch", "assessment_already_completed", "watch", "await_response", "idle:assessment_already_completed"), []),
    "exhausted": ({"attempts": 2, "posted": NOW - 20 * DAY}, ("watch", "verification_exhausted", "watch", "await_change", "idle:verification_exhausted"), []),
    "not_old": ({"attempts": 2, "posted": NOW - 10 * DAY}, ("active", None, "application_ready", "apply", "application"), []),
    "new_evidence": ({"attempts": 2, "posted": NOW - 20 * DAY, "new_evidence": True}, ("active", None, "application_ready", "apply", "application"), []),
    "stale": ({"authoritative": False, "posted": NOW - 31 * DAY}, ("watch", "stale_unresolved_copy", "watch", "await_change", "idle:stale_unresolved_copy"), []),
    "undated": ({"authoritative": False, "posted": None, "attempts": 1, "first_failed": NOW - 15 * DAY}, ("watch", "undated_copy_verification_exhausted", "watch", "await_change", "idle:undated_copy_verification_exhausted"), []),
    "historical": ({"thread": True, "thread_intent": "buyer", "buyer_at": NOW - 61 * DAY}, ("watch", "historical_buyer_request", "watch", "await_change", "idle:historical_buyer_request"), []),
    "unpaid": ({"thread": True, "thread_intent": "buyer", "thread_unpaid": True}, ("active", None, "verification_needed", "verify", "paid_scope"), ["community_paid_scope"]),
    "terms": ({"thread": True, "thread_intent": "buyer", "thread_terms": "ambiguous", "thread_locked": True}, ("active", None, "verification_needed", "verify", "changed_terms"), ["community_scope_revision", "community_contact_route"]),
    "closed": ({"closed": True}, ("closed", "matching_source_explicitly_closed", "closed", "skip", "veto"), []),
    "deadline": ({"deadline": NOW}, ("closed", "captured_application_deadline_elapsed", "closed", "skip", "veto"), []),
    "lead": ({"deadline": NOW + DAY, "lead_hours": 25.0}, ("active", None, "blocked", "skip", "veto"), []),
    "non_job": ({"non_job": True}, ("active", None, "blocked", "skip", "veto"), []),
    "thread_invalid": ({"thread_invalid": True}, ("active", None, "blocked", "skip", "veto"), []),
    "closed_then_old": ({"closed": True, "attempts": 2, "posted": NOW - 20 * DAY}, ("closed", "matching_source_explicitly_closed", "closed", "skip", "veto"), []),
    "hold": ({"binding_hold": True}, ("active", None, "verification_needed", "verify", "binding_hold"), ["active_outcome_attempt"]),
    "o_conflict": ({"outcomes": {"payout": fact("a", conflict=True)}}, ("watch", "outcome_conflict", "watch", "verify", "outcome:conflict"), ["outcome_conflict:payout"]),
    "o_ended": ({"outcomes": {"application_state": fact("rejected", 90)}, "complete": None}, ("closed", "exact_application_closed", "watch", "await_change", "outcome:ended"), []),
    "o_access": ({"outcomes": {"project_access": fact("blocked")}}, ("watch", "known_account_block", "watch", "verify", "outcome:no_access"), []),
    "o_assessed": ({"outcomes": {"assessment_state": fact("completed")}}, ("watch", "assessment_already_completed", "watch", "await_response", "outcome:assessed"), []),
    "o_no_step": ({"outcomes": {"assessment_step/a/assessment_state": fact("completed")}}, ("watch", "assessment_step_not_selected", "verification_needed", "verify", "outcome:no_step"), ["current_assessment_step"]),
    "o_step_unknown": ({"outcomes": {"assessment_step": fact("b"), "assessment_step/a/assessment_state": fact("completed")}}, ("active", "assessment_step_state_unknown", "verification_needed", "verify", "outcome:step_unknown"), ["assessment_step_state"]),
    "o_reply": ({"outcomes": {"buyer_reply": fact("yes")}, "route": None}, ("active", "current_buyer_reply", "captured_next_step", "clarify_scope", "outcome:reply"), []),
    "o_old_reply": ({"outcomes": {"buyer_reply": fact("yes", 3)}}, ("watch", "buyer_update_needs_recheck", "watch", "await_change", "outcome:old_reply"), []),
    "o_seed": ({"outcomes": {"buyer_reply": fact("yes", source="reviewed_seed")}}, ("watch", "buyer_update_needs_recheck", "watch", "await_change", "outcome:old_reply"), []),
    "o_invited_left": ({"outcomes": {"assessment_state": fact("invited")}, "complete": None}, ("active", "existing_assessment_invitation", "verification_needed", "verify", "outcome:invited_unverified"), ["full_matching_requirements"]),
    "o_unchecked": ({"outcomes": {"assessment_state": fact("invited")}}, ("active", "existing_assessment_invitation", "verification_needed", "verify", "outcome:invited_unchecked"), ["assessment_prerequisites"]),
    "o_invited": ({"outcomes": {"assessment_state": fact("invited"), "action_checks": fact("privacy,schedule,equipment,cost"), "assessment_route": fact("r")}, "open_at": None}, ("active", "existing_assessment_invitation", "captured_next_step", "complete_known_step", "outcome:invited"), []),
    "o_invited_expired": ({"outcomes": {"assessment_state": fact("invited"), "action_checks": fact("privacy,schedule,equipment,cost", expires=NOW), "assessment_route": fact("r")}}, ("active", "existing_assessment_invitation", "verification_needed", "verify", "outcome:invited_unchecked"), ["assessment_prerequisites"]),
    "o_old_access": ({"outcomes": {"project_access": fact("accessible", 3)}}, ("watch", "access_evidence_stale", "watch", "verify", "outcome:old_access"), ["project_access"]),
    "o_setup_done": ({"outcomes": {"setup_selection": fact("c1", 9), "setup_checklist": fact("completed", 9)}}, ("watch", "setup_checklist_completed", "watch", "await_response", "outcome:setup_done"), []),
    "o_setup_open": ({"outcomes": {"setup_selection": fact("c1", 9)}}, ("active", "setup_checklist_needs_review", "verification_needed", "verify", "outcome:setup_open"), ["setup_checklist"]),
    "o_behind_blocker": ({"outcomes": {"buyer_reply": fact("yes")}, "blockers": ["pay_floor"]}, ("active", None, "blocked", "skip", "veto"), []),
    "o_nothing": ({"outcomes": {"note": fact("x")}}, ("active", None, "application_ready", "apply", "application"), []),
}


@pytest.fixture(scope="module")
def found(spark):
    schema = "name string, " + ", ".join(f"{k} {t}" for k, t in actions.INPUTS.items())
    rows = [(n, *[(READY | facts).get(k) for k in actions.INPUTS]) for n, (facts, _, _) in CASES.items()]
    out = actions.acted(spark.createDataFrame(rows, schema), F.lit(NOW))
    return {r["name"]: r for r in out.collect()}


@pytest.mark.parametrize("name", CASES)
def test_rule(found, name):
    _, want, tasks = CASES[name]
    r = found[name]
    assert (r["lifecycle"], r["reason"], r["readiness"], r["action"], r["rule"]) == want
    assert r["tasks"] == tasks


def test_every_rule_of_outcomes_fires(found):
    fired = {r["rule"].removeprefix("outcome:") for r in found.values() if r["rule"].startswith("outcome:")}
    assert fired == {"conflict", "ended", "no_access", "assessed", "no_step", "step_unknown", "old_reply", "reply", "invited_unverified", "invited_unchecked", "invited", "old_access", "setup_done", "setup_open"}


def test_projection_as_of_a_clock(spark):
    rows = [(1, "a", "x", NOW - DAY, None, "p"), (1, "a", "y", NOW - 2 * DAY, None, "p"), (1, "a", "z", NOW + DAY, None, "p"), (1, "b", "u", None, None, "p"), (1, "c", "m", NOW, None, "p"), (1, "c", "n", NOW, None, "p"), (2, "a", None, NOW, None, "p")]
    facts = spark.createDataFrame(rows, "id long, predicate string, value string, event_at timestamp, expires_at timestamp, source string")
    got = {r["id"]: {k: (v["value"], v["conflict"]) for k, v in r["outcomes"].items()} for r in actions.projected(facts, "id", F.lit(NOW)).collect()}
    assert got == {1: {"a": ("x", False), "b": ("u", False), "c": ("n", True)}, 2: {"a": (None, False)}}
