"""Scores, small gates, joins and ledgers against tables of cases."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidentia.functions import hashing, scoring, structured, text, times, urls
from evidentia.operators import evidence, gates, history, joins, ledger, state
from evidentia.sources import mappers, sinks
from evidentia.streaming import flows

T0 = datetime(2024, 1, 1)


def of(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_scores(spark):
    got = of(
        spark,
        scoring.composite({k: F.lit(0.5) for k in scoring.TRUST_WEIGHTS}),
        scoring.expected_value(F.lit(80.0), F.lit(None).cast("double"), F.lit(1.0), F.lit(0.5)),
        scoring.expected_value(F.lit(80.0), F.lit(1.0), F.lit(0.0), F.lit(1.0)),
        scoring.conservative_trust(F.lit(0.6), F.lit(0.5), F.lit(0.4)),
        scoring.match_strength(F.array(F.lit("a")), F.lit(True)),
        scoring.match_strength(F.array(F.lit("a")), F.lit(False)),
        scoring.match_strength(F.array().cast("array<string>"), F.lit(False)),
        scoring.claim_credibility(F.lit(1.0), F.lit(1.0), F.lit(True), F.lit(True), F.lit(False)),
        scoring.claim_credibility(F.lit(0.99), F.lit(1.0), F.lit(False), F.lit(False), F.lit(True)),
    )
    assert got == [0.5, 34.0, 56.0, pytest.approx(0.4), "strong", "medium", "weak", pytest.approx(0.576), 1.0]


def test_small_functions(spark):
    got = of(
        spark,
        text.display_slug(F.lit("data-entry_clerk")),
        text.match_text(F.lit("Head—Of  Data")),
        urls.without_query(F.lit("https://a/b?c#d")),
        times.not_after(F.lit(T0), F.lit(T0)),
        times.not_after(F.lit(T0 + timedelta(1)), F.lit(T0)),
        times.retry_after(F.lit(" 30 "), F.lit(T0)),
        times.retry_after(F.lit("Mon, 01 Jan 2024 00:01:00 GMT"), F.lit(T0)),
        state.due(F.lit(None).cast("date"), F.lit(date(2024, 1, 8)), 7),
        state.due(F.lit(date(2024, 1, 1)), F.lit(date(2024, 1, 8)), 7),
        state.due(F.lit(date(2024, 1, 2)), F.lit(date(2024, 1, 8)), 7),
    )
    assert got == ["Data Entry Clerk", "head-of data", "https://a/b", T0, None, 30.0, 60.0, True, True, False]
    keys = of(spark, structured.content_key(F.lit("a"), F.lit(None).cast("string")), structured.content_key(F.lit("a"), F.lit("")), structured.content_key(F.lit("a")), hashing.canonical_id(F.lit("a")))
    assert len(set(keys)) == 4 and len(keys[3]) == 20
    df = spark.createDataFrame([(1, None, "x")], "b int, a string, c string")
    assert df.select(hashing.canonical_json("c", "a")).first()[0] == '{"a":null,"c":"x"}' and len(df.select(hashing.row_hash("a")).first()[0]) == 64


def test_gates(spark):
    penalties = {"lead": ("\\b(head|lead)\\b", -20.0, 25.0), "senior": ("\\bsenior\\b", -10.0, None)}
    df = spark.createDataFrame([("Senior Head – Data", 90.0), ("Senior Rater", 5.0), ("Rater", 50.0)], "t string, f double")
    assert [r[0] for r in df.select(gates.title_adjusted(F.col("f"), F.col("t"), penalties)).collect()] == [25.0, 0.0, 50.0]
    places = [("India", "", None, []), ("Berlin", "", None, ["location:place"]), ("", "", None, ["location:not_remote"]), ("Berlin, remote", "", None, []), ("India", "onsite only", True, ["location:onsite"]), (None, None, True, [])]
    df = spark.createDataFrame([p[:3] for p in places], "l string, b string, r boolean")
    assert [r[0] for r in df.select(gates.location_reasons(F.col("l"), F.col("b"), F.col("r"), ["india"])).collect()] == [p[3] for p in places]
    df = spark.createDataFrame([(["pay", "scam"],), ([],), (None,), (["other"],)], "b array<string>")
    assert [r["terminal"] for r in gates.decided(df, "b", ["scam", "pay"]).collect()] == ["scam", None, None, None]
    pairs = spark.createDataFrame([(["a", "b"], ["a"], True), (["a", "b"], ["a"], False), ([], [], True), (["c"], ["a"], False)], "r array<string>, s array<string>, al boolean")
    assert [r[0] for r in pairs.select(gates.language_pairs(F.col("r"), F.col("s"), F.col("al"))).collect()] == [False, True, True, False]
    docs = [("x", "This position is closed. Apply", "/a", "closed"), ("1,200 data jobs", "", "/a", "index"), ("x", "", "/jobs/", "index"), ("How to rate", "", "/a", "guide"), ("x", "Looking for a rater", "/a", "request"), ("x", "Hire me", "/a", "offer"), ("x", "Apply now", "/a", "posting"), (None, None, None, "discussion")]
    df = spark.createDataFrame([d[:3] for d in docs], "t string, b string, p string")
    assert [r[0] for r in df.select(evidence.document_type(F.col("t"), F.col("b"), F.col("p"))).collect()] == [d[3] for d in docs]
    tags = mappers.region_tags(F.col("t"), F.col("b"), F.lit(True), {"bn": ["bengali"], "hi": ["hindi"]}, "\\bfluent\\b")
    df = spark.createDataFrame([("Bengali rater", ""), ("Rater", "fluent hindi"), ("Rater", "hindi"), ("Rater", None)], "t string, b string")
    assert [r[0] for r in df.select(tags).collect()] == [["bn"], ["hi"], ["worldwide"], ["worldwide"]]


def test_joins(spark):
    df = spark.createDataFrame([("k1", ["o1", "o2"]), ("k2", ["o3"])], "key string, ids array<string>")
    states = spark.createDataFrame([(["o1"], "zz", "s1"), ([], "k1", "s1"), (["o2"], "k1", "s2"), (["o9"], "no", "s3")], "parents array<string>, key string, state string")
    assert {r["key"]: r["states"] for r in joins.attached(df, states, "ids", "key", "parents", "state").collect()} == {"k1": ["s1", "s2"], "k2": None}
    claims = spark.createDataFrame([(1, ["a", "b"], "all"), (2, ["a", "b"], "any"), (3, ["a", "x"], "all"), (4, ["x"], "any")], "id int, fields array<string>, how string")
    known = spark.createDataFrame([("a", 2.0), ("b", 5.0)], "field string, years double")
    assert {r["id"]: r["years"] for r in joins.fields_needed(claims, known, "id", "fields", "how").collect()} == {1: 2.0, 2: 5.0, 3: 0.0, 4: None}


def test_ledgers(spark):
    rows = [("s", True, ["a", "b"], 3.0, None), ("s", False, None, None, 2.0), ("s", True, ["b"], None, None), ("t", False, [], None, None)]
    got = {r["src"]: tuple(r)[1:] for r in ledger.value_report(spark.createDataFrame(rows, "src string, ok boolean, acts array<string>, minutes double, cost double"), ["src"], "ok", "acts", "minutes", "cost").collect()}
    assert got == {"s": (3, 2, 2, 1, 3.0, 2, 2.0), "t": (1, 0, 0, 0, None, 1, None)}
    jobs = spark.createDataFrame([("e", i) for i in range(7)] + [("f", 1)], "emp string, n int").withColumn("label", F.concat("emp", F.col("n").cast("string")))
    assert [r["line"] for r in ledger.overflow_lines(jobs, "emp", "label", [F.col("n")], 3, 5).collect()] == ["e0, e1, e2 +4 more", "f1"]
    log = spark.createDataFrame([(1, 5, True), (1, 9, False), (1, 3, True)], "k int, seq int, ok boolean")
    assert history.baselines(log, ["k"], "seq", "ok").first()["baseline"] == 5


def test_sinks_and_queues(spark):
    log, new = spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert [r["k"] for r in sinks.appended_once(log, new, "k").collect()] == ["b"] and [r["k"] for r in state.enqueued(new, log, ["k"]).collect()] == ["b"]
    assert sinks.audit_lines(spark.createDataFrame([(1, None)], "id int, a string"), "id").first()["value"] == '{"a":null,"id":1}'
    reg = spark.createDataFrame([("p", 0.95), ("q", 0.5)], "k string, trust double")
    moved = sinks.evidence_appended(reg, spark.createDataFrame([("p", 0.03), ("p", 0.04)], "k string, delta double"), "k")
    assert {r["k"]: (r["trust"], r["evidence"]) for r in moved.collect()} == {"p": (1.0, 2), "q": (0.5, 0)}
    late = spark.createDataFrame([(T0, T0), (T0 + timedelta(1), T0), (None, T0)], "at timestamp, seen timestamp")
    assert [r["late"] for r in flows.split_late(late, "at", "seen").collect()] == [False, True, False]
    days = sinks.counters(late.where("at is not null"), "at").orderBy("day").collect()
    assert [(r["day"], r["n"]) for r in days] == [(date(2024, 1, 1), 1), (date(2024, 1, 2), 1)]


# ------------------------------------------------------------- lanes with a kept place
def plain_handoff(rows, caps, total, per_employer, per_platform):
    rows = sorted(rows, key=lambda r: (list(caps).index(r[1]), r[6], r[0]))

    def select(order):
        firms, shops, used, out = {}, {}, {}, {}
        for key, lane, firm, shop, *_ in order:
            if firms.get(firm, 0) >= per_employer:
                out[key] = "employer_cap"
            elif shop is not None and shops.get(shop, 0) >= per_platform:
                out[key] = "platform_cap"
            elif used.get(lane, 0) >= caps[lane] or sum(used.values()) >= total:
                out[key] = lane + "_cap"
            else:
                out[key] = "shown"
                firms[firm], used[lane] = firms.get(firm, 0) + 1, used.get(lane, 0) + 1
                if shop is not None:
                    shops[shop] = shops.get(shop, 0) + 1
        return out

    kept = next((r for r in rows if r[1] == "action" and not r[4]), None)
    plain = select(rows)
    ready = [r for r in rows if r[1] == "action" and plain[r[0]] == "shown"]
    if kept and len(ready) == caps["action"] and all(r[4] and r[5] for r in ready):
        kept = None
    return plain if kept is None else select([kept] + [r for r in rows if r is not kept]), kept


@pytest.mark.parametrize("seed", range(6))
def test_handoff_lanes_keep_a_place_for_a_discovery(spark, seed):
    import random

    from evidentia.operators import ranking

    rng = random.Random(seed)
    rows = [(i, rng.choice(["action", "verify"]), rng.choice([f"e{rng.randrange(12)}", f"alone{i}"]), rng.choice(["shop", "shop", None] if seed % 3 else ["shop", None, None]), rng.random() < 0.9, seed % 2 == 0 or rng.random() < 0.5, rng.randrange(50)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, lane string, employer string, platform string, acted boolean, urgent boolean, rank int")
    got = {r["id"]: (r["disposition"], r["reserved"]) for r in ranking.handoff(df, "id", "lane", "employer", "platform", "acted", "urgent", [F.col("rank"), F.col("id")], {"action": 3, "verify": 2}, 4, 1, 1).collect()}
    want, kept = plain_handoff(rows, {"action": 3, "verify": 2}, 4, 1, 1)
    assert {k for k, v in got.items() if v[0] == "shown"} == {k for k, v in want.items() if v == "shown"}
    assert {k for k, v in got.items() if v[1]} == ({kept[0]} if kept else set())


def test_fit_by_phrases(spark):
    vocabulary = {"high": ["prompt engineer"], "mid": ["python"], "hard": ["on site only"]}
    rows = [("a promt and engineering python role",), ("prompt engineer",), ("prompt engineer remote",), ("on site only prompt engineer",), ("nothing",)]
    df = spark.createDataFrame(rows, "t string")
    fit, hard = gates.fit_score(text.tokens(F.col("t")), vocabulary, ["remote"], phrases=True)
    assert [tuple(r) for r in df.select(fit, hard).collect()] == [(47.0, False), (30.0, False), (35.0, False), (0.0, True), (10.0, False)]


def test_a_run_that_loses_rows_is_not_sent(spark):
    from evidentia.operators import ledger

    df = spark.range(10).withColumn("kind", F.when(F.col("id") < 9, "a").otherwise("b"))
    count = lambda k: F.count(F.when(F.col("kind") == k, 1))
    assert ledger.guarded(df, ledger.conservation(df, {"all": (F.count("*"), count("a") + count("b"))})).count() == 10
    with pytest.raises(ValueError, match="all: 10 expected, 9 found"):
        ledger.guarded(df, ledger.conservation(df, {"all": (F.count("*"), count("a"))}))


def test_moments_without_a_zone_are_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-01-02T03:04:05",), ("2024-01-02T03:04:05Z",), ("2024-01-02 03:04:05+02:00",), ("2024-01-02",), ("1704164645",), ("1704164645000",), ("soon",), (None,)], "t string")
        got = [r[0] for r in df.select(F.unix_seconds(times.parsed_moment(F.col("t")))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [1704164645, 1704164645, 1704157445, 1704153600, 1704164645, 1704164645, None, None]
