"""Policy, checks and display against tables of cases."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evidentia.functions import display, structured
from evidentia.operators import checks, policy

T0 = datetime(2024, 3, 1)
SIDE = "struct<id:string,title:string,company:string,location:string>"


@pytest.mark.parametrize(
    "old, new, want",
    [
        (("7", "Data Rater", "Acme", "India"), ("7", "Data rater", "ACME", "India"), "exact"),
        (("7", "Data Rater", "Acme", None), ("8", "data rater ", None, None), "corroborated"),
        (("7", "Data Rater", "Acme", None), ("7", "Data Rater", "Other", None), "conflict"),
        (("7", "Senior Data Rater", None, None), ("7", "Plumber", None, None), "conflict"),
        (("7", "German Rater", None, None), ("7", "Dutch Rater", None, None), "conflict"),
        (("7", "Rater", None, "India"), ("7", "Rater", None, "Canada"), "conflict"),
        (("7", "Rater", None, "India remote"), ("7", "Rater", None, "Canada"), "exact"),
        (("", "Rater A", None, None), ("", "Rater B", None, None), "uncertain"),
        ((None, None, None, None), (None, None, None, None), "uncertain"),
    ],
)
def test_same_listing(spark, old, new, want):
    df = spark.createDataFrame([(old, new)], f"a {SIDE}, b {SIDE}")
    assert df.select(policy.same_listing("a", "b", ["german", "dutch"], ["india", "canada"])).first()[0] == want


def test_pay_states(spark):
    rows = [(("unknown", False), False, None, 1.0), (None, True, None, 1.0), (("hour", False), True, True, 1.0), (("hour", False), False, True, 1.0), (("fixed", False), False, None, 0.1), (("hour", True), False, False, 0.9), (("hour", False), False, False, 0.5), (("year", False), False, False, 0.9), (("hour", False), False, None, 0.65)]
    df = spark.createDataFrame(rows, "s struct<basis:string,up_to:boolean>, c boolean, low boolean, cred double")
    got = [r[0] for r in df.select(policy.pay_state("s", F.col("c"), F.col("low"), F.col("cred"))).collect()]
    assert got == ["unknown", "unknown", "conflicted", "below_floor", "budget_known", "up_to_only", "known_unverified", "credible_salary", "credible_hourly"]


def test_payouts(spark):
    d = Decimal
    rows = [(1, "wire", d("50"), "USD", d("50"), "USD", False), (2, "wire", d("50"), "USD", d("50"), "USD", True), (3, "wire", d("50"), "USD", d("10"), "EUR", False), (4, "wire", d("50"), "USD", d("99"), "USD", False), (4, "card", d("50"), "USD", d("10"), "USD", False), (5, "wire", d("50"), "USD", d("10"), "USD", False), (5, "wire", d("50"), "USD", d("99"), "USD", False), (6, "wire", None, "USD", d("10"), "USD", False), (7, "wire", d("50"), None, d("10"), "USD", False)]
    df = spark.createDataFrame(rows, "id int, method string, amount decimal(14,4), currency string, minimum decimal(14,4), minimum_currency string, strict boolean")
    assert {r["id"]: r["payout"] for r in policy.payout(df, "id").collect()} == {1: "compatible", 2: "infeasible", 3: "unknown", 4: "compatible", 5: "unknown", 6: "unknown", 7: "unknown"}


def test_equipment(spark):
    day = date(2024, 1, 1)
    records = [("cam", day, False), ("cam", day + timedelta(1), True), ("mic", None, True), ("pen", day, True), ("pen", day, False), ("desk", day, False), ("late", date(2030, 1, 1), True)]
    owned = policy.inventory(spark.createDataFrame(records, "device string, event_date date, available boolean"), "device", F.lit(date(2024, 6, 1)))
    assert {r["device"]: r["state"] for r in owned.collect()} == {"cam": "available", "mic": "unknown", "pen": "conflict", "desk": "unavailable"}
    claims = spark.createDataFrame([("cam", "required"), ("desk", "required"), ("desk", "negated"), ("none", "required"), ("cam", "preferred")], "device string, modality string")
    assert sorted((r["device"], r["modality"], r["outcome"]) for r in policy.equipment(claims, owned, "device").collect()) == [("cam", "preferred", "preferred"), ("cam", "required", "supported"), ("desk", "negated", "not_required"), ("desk", "required", "unmet"), ("none", "required", "unknown")]


@pytest.mark.parametrize(
    "body, want",
    [("Germany only.", "germany"), ("We are a team based in Germany. Work anywhere", None), ("Applicants must live in the Germany", "germany"), ("India only", None), ("Residents not in Germany only", None), ("Our headquarters: Canada based. Canada residents", "canada"), (None, None), ("", None)],
)
def test_region_locks(spark, body, want):
    df = spark.createDataFrame([("Rater", body)], "t string, b string")
    assert df.select(policy.region_lock(F.col("t"), F.col("b"), ["germany", "canada", "india"], ["india"])).first()[0] == want


def test_closures(spark):
    cases = [("<h1>Rater</h1><p>This role is now closed.</p>", True), ("<h1>Rater</h1><h1>B</h1><p>This role is closed.</p>", False), ("<h1>Other</h1><p>This role is closed.</p>", False), ("<h1>Rater</h1><p>We think this role is closed.</p>", False), (None, False)]
    df = spark.createDataFrame([(h, "Rater") for h, _ in cases], "h string, t string")
    assert [r[0] for r in df.select(policy.scoped_closure(F.col("h"), F.col("t"))).collect()] == [w for _, w in cases]


def test_roles_and_mismatches(spark):
    aliases = {"law": ["law", "contract law"], "bio": ["biology"]}
    df = spark.createDataFrame([("Contract Law and Biology Expert", False), ("Biology", False), ("Biology", True), (None, False)], "t string, g boolean")
    assert [tuple(r[0]) for r in df.select(policy.specialist(F.col("t"), aliases, ["bio"], F.col("g"))).collect()] == [("law", "unclaimed"), ("bio", "claimed"), (None, "none"), (None, "none")]
    assert [r[0] for r in df.select(policy.occupation(F.col("t"), {"expert": "expert", "science": "biology"})).collect()] == ["expert", "science", "science", "other"]
    m = spark.createDataFrame([(["de", "fr"], ["fr"], True, [3.0, 9.0, 7.5], ["germany", "emea"])], "r array<string>, s array<string>, a boolean, y array<double>, l array<string>")
    got = m.select(policy.language_mismatches(F.col("r"), F.col("s"), F.col("a")), policy.language_mismatches(F.col("r"), F.col("s"), ~F.col("a")), policy.experience_mismatches(F.col("y"), 5), policy.location_mismatches(F.col("l"), F.lit(False), "india", ["worldwide"]), policy.location_mismatches(F.array(F.lit("india")), F.lit(True), "india", []), policy.location_mismatches(F.array(F.lit("worldwide")), F.lit(False), "india", ["worldwide"])).first()
    assert list(got) == [[], ["lang_mismatch:de"], ["experience_mismatch:9_years", "experience_mismatch:7.5_years"], ["location_scope_mismatch:emea", "location_scope_mismatch:germany"], ["location_scope_mismatch:india_excluded"], []]


def test_life_cycle(spark):
    base = dict(id="x", closed=False, deadline=None, blocked=False, applied=False, pool=False, cycles=0, first_failed=None, posted=T0, authoritative=True, complete=True, verified_open=T0, route=True)
    cases = [({}, "active", None), ({"closed": True, "blocked": True}, "closed", "matching_source_closed"), ({"deadline": T0}, "closed", "deadline_elapsed"), ({"deadline": T0 + timedelta(seconds=1)}, "active", None), ({"blocked": True, "applied": True}, "watch", "account_block"), ({"cycles": 2}, "active", None), ({"cycles": 2, "posted": T0 - timedelta(days=15)}, "watch", "verification_exhausted"), ({"cycles": 2, "posted": None, "first_failed": T0 - timedelta(days=15)}, "watch", "verification_exhausted"), ({"authoritative": False, "posted": T0 - timedelta(days=31)}, "watch", "stale_copy")]
    schema = "id string, closed boolean, deadline timestamp, blocked boolean, applied boolean, pool boolean, cycles int, first_failed timestamp, posted timestamp, authoritative boolean, complete boolean, verified_open timestamp, route boolean"
    df = spark.createDataFrame([tuple((base | c | {"id": str(i)}).values()) for i, (c, _, _) in enumerate(cases)], schema)
    got = policy.lifecycle(df, F.lit(T0)).orderBy(F.col("id").cast("int")).collect()
    assert [(r["lifecycle"], r["reason"]) for r in got] == [(a, b) for _, a, b in cases] and all(r["tasks"] == [] for r in got)
    stale = policy.lifecycle(df.limit(1).withColumn("verified_open", F.lit(T0 - timedelta(hours=49))).withColumn("route", F.lit(None).cast("boolean")), F.lit(T0)).first()
    assert stale["tasks"] == ["open_status", "route"]


def test_bands_order_and_urgency(spark):
    df = spark.createDataFrame([("a", None, "passed", "active", [], False), ("b", None, "passed", "active", ["x"], False), ("c", "reject_pay", "passed", "active", [], False), ("d", None, "unknown", "active", [], False), ("e", None, "passed", "active", [], True)], "id string, t string, e string, l string, k array<string>, c boolean")
    assert [r[0] for r in df.select(policy.action_band(F.col("t"), F.col("e"), F.col("l"), F.col("k"), F.col("c"))).collect()] == ["primary", "verify", "reject", "verify", "verify"]
    ranked = spark.createDataFrame([("z", 1, 2), ("a", 1, 2), ("m", None, 9), ("b", 3, 0)], "id string, p int, q int").orderBy(*policy.priority({"p": F.col("p"), "q": F.col("q")}, "id"))
    assert [r["id"] for r in ranked.collect()] == ["b", "a", "z", "m"]
    u = [(T0, 10.0, None), (T0 + timedelta(minutes=5), 10.0, None), (T0 + timedelta(hours=2), None, None), (T0 + timedelta(hours=2), 10.0, 300.0), (T0 + timedelta(hours=2), 10.0, None), (T0 + timedelta(days=3), 10.0, None), (None, 1.0, None)]
    d = spark.createDataFrame(u, "d timestamp, m double, l double")
    assert [r[0] for r in d.select(policy.urgency(F.col("d"), F.lit(T0), F.col("m"), F.col("l"), F.array())).collect()] == ["elapsed", "infeasible", "unknown", "infeasible", "urgent", "feasible", None]


def test_requirements_rollup(spark):
    rows = [(1, "de", "required", 2.0, "partial"), (1, "fr", "preferred", None, "complete"), (1, "de", "required", 5.0, "unknown"), (2, "x", "mentioned", None, None)]
    got = {r["id"]: r for r in policy.requirements_rollup(spark.createDataFrame(rows, "id int, name string, modality string, years double, completeness string"), "id").collect()}
    assert (got[1]["required"], got[1]["preferred"], got[1]["least_years"], got[1]["most_years"], got[1]["completeness"]) == (["de"], ["fr"], 2.0, 5.0, "complete") and got[2]["completeness"] == "unknown"


def test_checks(spark):
    schema = "id int, state string, complete boolean, planned array<string>, fetched array<string>, omissions array<string>, novelty boolean, actions array<string>, window_start timestamp, window_end timestamp, observed_at timestamp"
    ok = ("complete", True, ["a", "b"], ["b", "a"], [], True, [], T0, T0 + timedelta(1), T0 + timedelta(2))
    df = spark.createDataFrame([(1, *ok), (2, "partial", *ok[1:]), (3, *ok[:3], ["a", "z"], *ok[4:]), (4, *ok[:6], None, *ok[7:]), (5, *ok[:5], False, ["n"], T0, T0, T0)], schema)
    got = checks.check_issues(df.withColumn("adequate", checks.adequate(df))).orderBy("id").collect()
    assert [r["adequate"] for r in got] == [True, False, False, False, False] and [r["issues"] for r in got] == [[], [], ["page_outside_plan"], [], ["invalid_window", "unreviewed_novelty"]]
    routes = spark.createDataFrame([("a", "c", 5, "pilot", "f1"), ("b", "no", 50, "watch", "f2"), ("d", "c", 1, "pilot", "f2"), ("e", "c", 1, "pilot", "f3"), ("a", "c", 1, "watch", "f1")], "source_id string, category string, requests int, mode string, family string")
    decisions = spark.createDataFrame([("a", "continue", 1), ("d", "continue", 1), ("d", "pause", 2)], "source_id string, disposition string, observed_at int")
    issues = checks.plan_issues(routes, spark.createDataFrame([("c",)], "category string"), decisions, 10)
    assert sorted(((r["source_id"] or "", r["issue"]) for r in issues.collect())) == [("", "too_many_pilots"), ("a", "repeated_source"), ("b", "over_ceiling"), ("b", "unknown_category"), ("d", "paused"), ("e", "not_admitted")]
    pairs = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (3, "z"), (3, "z")], "a int, b string")
    assert sorted(map(tuple, checks.not_one_to_one(pairs, "a", "b").collect())) == [("a", "1", 2), ("b", "y", 2)]
    req = spark.createDataFrame([("r1", "p"), ("r2", "p"), ("r3", "p")], "run string, body string")
    done = req.limit(2).withColumn("request_hash", F.when(F.col("run") == "r1", F.sha2("body", 256)).otherwise("other"))
    assert {r["run"]: r["receipt"] for r in checks.receipts(req, done, "run", F.col("body")).collect()} == {"r1": "repeated", "r2": "conflict", "r3": "new"}
    facts = spark.createDataFrame([("s", "state", "a", "current"), ("s", "deadline", "b", "conflict"), ("s", "state", "z", "superseded")], "scope string, predicate string, value string, disposition string")
    row = checks.fact_values(facts, ["scope"], "predicate", "value", ["state", "deadline"]).first()
    assert (row["state"], row["deadline"], row["conflicts"]) == ("a", None, ["deadline"])


def test_structured_values(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "v string").select(f(F.col("v"))).first()[0]
    assert [one(structured.terms, v) for v in ('["a","b"]', '{"x":"a"}', '"a"', "a", "", None)] == [["a", "b"], ["a"], ["a"], ["a"], [], []]
    assert [one(structured.depth, v) for v in ('{"a":[{"b":"[[["}]}', "1", '"\\"{"')] == [3, 0, 0]
    got = one(structured.model_scores, '```json\n[{"id":"a","score":7,"reasons":["x"," ","y","z","w"]},{"id":"","score":1,"reasons":[]},{"id":"b","reasons":[]},{"id":"c","score":0.5,"reasons":null}]\n```')
    assert [(r["id"], r["score"], r["reasons"]) for r in got] == [("a", 1.0, ["x", "y", "z"])] and one(structured.model_scores, "no json") == []
    assert [one(structured.plain_decimal, v) for v in ("10.500", "1e3", "100", "x", None)] == ["10.5", "1000", "100", None, None]
    assert spark.range(1).select(structured.cited(F.lit("a b c"), F.array(F.lit("b c"), F.lit("d"), F.lit("")))).first()[0] == 1


def test_display(spark):
    s = lambda c: spark.range(1).select(c).first()[0]
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    assert s(display.ordered_warnings(arr("Trust low", "pay unknown", "zzz", "location?", "pay unknown"))) == ["location?", "pay unknown", "Trust low", "zzz"]
    assert s(display.compacted(arr("a", "b", "a", "c"), 2)) == ["a", "b", "+1 more"] and s(display.compacted(arr("a"), 2)) == ["a"]
    assert s(display.subject(F.lit(2), F.lit(1), F.lit(T0))) == "2 listings, 1 update (2024-03-01)" and s(display.subject(F.lit(0), F.lit(0), F.lit(T0))) == "no changes (2024-03-01)"
    assert s(display.card(F.lit("T"), F.lit(None).cast("string"), F.lit("$5"), F.lit("X"), F.lit("u"), arr("a", "b"))) == "T\n$5 | X\nCheck: a; b\nu"
    assert s(display.run_summary({"in": F.lit(3), "out": F.lit(0)})) == "in 3 | out 0" and s(display.percent(F.lit(1), F.lit(0))) == "-"
