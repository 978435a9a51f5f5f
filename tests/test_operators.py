"""Operators against plain Python, and their invariants: ledgers add up, order and layout of rows don't matter."""

import itertools
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidentia.functions import hashing, money, text, times, urls
from evidentia.operators import entities, evidence, gates, history, joins, ledger, outcomes, ranking, state

T0 = datetime(2024, 1, 1)


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first()["x"]


def scalar(spark, f, value, kind="string"):
    return one(spark, f(F.col("v")), v=(kind, value))


# ------------------------------------------------------------- functions
@pytest.mark.parametrize("raw, want", [("a\r\nb\rc", "a\nb\nc"), ("a​b c", "ab c"), (" x  \n\n\n\n y\x07 ", "x\n\ny"), ("", ""), (None, None), ("zwj‍kept", "zwj‍kept")])
def test_display_text(spark, raw, want):
    assert scalar(spark, text.display_text, raw) == want
    assert scalar(spark, lambda c: text.display_text(text.display_text(c)), raw) == want


def test_text_functions(spark):
    assert scalar(spark, text.html_text, "<p>a &amp; b</p><script>x('<p>')</script><ul><li>c</ul><!-- d -->e") == "a & b\n\n- c\ne"
    assert "x(" not in scalar(spark, text.html_text, "<script>x()</script>y")
    assert scalar(spark, text.identity_text, "  C++ / Straße—ÄB ") == "c++ straße äb"
    assert scalar(spark, text.fold_lookalikes, "Сода") == "Coдa"
    assert scalar(spark, text.tokens, "Use C++, c# & k8s!") == ["use", "c++", "c#", "k8s"]
    assert scalar(spark, text.number_of, "Seven") == 7.0 and scalar(spark, text.number_of, "2.5") == 2.5 and scalar(spark, text.number_of, "x") is None
    assert [scalar(spark, text.modality, s) for s in ("German is required", "French is a plus", "no degree required", "Dutch")] == ["required", "preferred", "negated", "mentioned"]
    assert scalar(spark, text.looks_shouted, "WORK FROM HOME NOW") and not scalar(spark, text.looks_shouted, "SHORT")
    assert scalar(spark, text.composed, "é") == "é" and scalar(spark, text.compatible, "Ｆ①") == "f1" and scalar(spark, text.repaired, "fÃ¼r â€“") == "für –"


@pytest.mark.parametrize(
    "url, root, shown",
    [
        ("https://A.com/P?utm_x=1&b=2&b=2&ref=z#f", "a.com/P?b=2&b=2#f", "https://a.com/P?b=2&b=2"),
        ("http://a.com/", "http://a.com", "http://a.com/"),
        ("ftp://a", "opaque:ftp://a", ""),
        (None, "opaque:", ""),
        ("https://u:p@a.com?token=1", "u:p@a.com", "https://a.com/"),
    ],
)
def test_urls(spark, url, root, shown):
    if url and "u:p@" in url:
        root = "u:p@a.com?token=1"
    assert scalar(spark, urls.root, url) == root and scalar(spark, urls.sanitized, url) == shown


def test_url_parts(spark):
    assert scalar(spark, urls.registrable, "https://x.b.co.uk:80/p") == "b.co.uk" and scalar(spark, urls.registrable, "https://x.b.com") == "b.com"
    assert tuple(scalar(spark, urls.topic, "https://f.org/t/some-slug/123/4")) == (123, 4)
    safe = {"https://a.com/x": True, "https://127.0.0.1/": False, "http://a.com:8080": False, "https://u@a.com": False, "http://localhost": False}
    assert {u: scalar(spark, urls.is_safe_public, u) for u in safe} == safe


@pytest.mark.parametrize("raw, want", [("1704067200", T0), ("1704067200000", T0), ("2024-01-01T00:00:00Z", T0), ("2024-01-01 is a Monday", T0), ("soon", None), (None, None)])
def test_moments(spark, raw, want):
    assert scalar(spark, times.parsed_moment, raw) == want


def test_freshness_and_limits(spark):
    df = spark.createDataFrame([(T0,), (T0 - timedelta(days=10),), (T0 - timedelta(days=400),), (None,)], "p timestamp")
    assert [r[0] for r in df.select(times.freshness(F.col("p"), F.lit(T0), 10.0)).collect()] == [1.0, 0.5, 0.1, 0.8]
    edge = spark.createDataFrame([(T0 - timedelta(hours=48), T0)], "seen timestamp, expires timestamp").select(times.within(F.lit(T0), F.col("seen"), 48), times.current(F.lit(T0), F.col("expires"))).first()
    assert tuple(edge) == (True, False)  # the last hour counts, the moment of expiry doesn't


@pytest.mark.parametrize(
    "raw, want",
    [
        ("$20 - $30 per hour", ("hour", 20.0, 30.0, False)),
        ("€41600 per year", ("year", 21.6, 21.6, False)),
        ("$52k", ("year", 25.0, 25.0, False)),
        ("$500", ("unknown", None, None, False)),
        ("15", ("hour", 15.0, 15.0, False)),
        ("$2 per task", ("task", 12.0, 12.0, True)),
        ("competitive", ("unknown", None, None, False)),
        (None, ("unknown", None, None, False)),
    ],
)
def test_pay(spark, raw, want):
    assert tuple(scalar(spark, money.parsed_pay, raw)) == want


def test_rates(spark):
    row = spark.range(1).select(money.effective_rate(F.lit(20.0), F.lit(0.5), F.lit(0.2)), money.pay_ok(F.lit(None).cast("double"), 4.5), money.backoff_seconds(F.lit(3)), money.backoff_seconds(F.lit(50)), money.blended(F.lit(0.4), F.lit(0.1)), money.blended(F.lit(0.4), F.lit(0.8)), money.review_delta(F.lit(5.0), F.lit(5.0))).first()
    assert tuple(row) == (8.0, None, 240, 3600, 0.4, pytest.approx(0.6), 0.03)


def test_fingerprint_ignores_order_and_layout(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    a = hashing.fingerprint(df, "id", "v").first()
    assert a == hashing.fingerprint(df.orderBy(F.rand(3)).repartition(7), "id", "v").first()
    assert a != hashing.fingerprint(df.withColumn("v", F.when(F.col("id") == 3, 99).otherwise(F.col("v"))), "id", "v").first()
    ids = spark.range(1).select(hashing.stable_id(F.lit("a|b"), F.lit("c")), hashing.stable_id(F.lit("a"), F.lit("b|c")), hashing.stable_id(F.lit(None).cast("string")), hashing.stable_id(F.lit(""))).first()
    assert len(set(ids)) == 4


# ------------------------------------------------------------- gates
def brute_phrase(want, have, slack=2):
    for start in range(len(have)):
        at, ok = start - 1, True
        for i, w in enumerate(want):
            nxt = next((j for j in range(at + 1, min(start + len(want) + slack, len(have))) if gates.same_token(w, have[j]) and (i or j == start)), None)
            if nxt is None:
                ok = False
                break
            at = nxt
        if ok:
            return True
    return False


def test_phrases(spark):
    assert gates.same_token("promt", "prompt") and gates.same_token("engineer", "engineering") and not gates.same_token("ai", "air") and not gates.same_token("rust", "rest")
    rng = random.Random(4)
    for _ in range(2000):
        want, have = [rng.choice("abc") for _ in range(rng.randrange(1, 4))], [rng.choice("abcd") for _ in range(rng.randrange(8))]
        assert gates.phrase_found(want, have) == brute_phrase(want, have)
    df = spark.createDataFrame([(["prompt", "x", "engineering"],), (None,), ([],)], "t array<string>")
    assert [r[0] for r in df.select(gates.phrases_in(F.col("t"), ["prompt engineer", "x y"])).collect()] == [["prompt engineer"], [], []]


def test_languages(spark):
    cases = {"der die das und mit von": "de", "el perro de la casa que los": "es", "the of and to in is": None, "der the": None, "": None}
    assert {k: scalar(spark, gates.detected_language, k) for k in cases} == cases
    assert scalar(spark, gates.detected_language, None) is None


def test_verdict_order(spark):
    none = F.array().cast("array<string>")
    some = F.array(F.lit("x"))
    base = dict(scam=F.lit(False), quality=none, location=none, hard=F.lit(False), pay_ok=F.lit(None).cast("boolean"), ineligible=none, trust=F.lit(None).cast("double"), fit=F.lit(50.0))
    steps = [("surfaced", {}), ("rejected_irrelevant", {"fit": F.lit(3.0)}), ("rejected_trust", {"trust": F.lit(0.1)}), ("rejected_ineligible", {"ineligible": some}), ("rejected_pay", {"pay_ok": F.lit(False)}), ("rejected_irrelevant", {"hard": F.lit(True)}), ("rejected_location", {"location": some}), ("rejected_quality", {"quality": some}), ("rejected_scam", {"scam": F.lit(True)})]
    for want, change in steps:  # each is stronger than all before it
        base |= change
        assert spark.range(1).select(gates.verdict(**base)).first()[0] == want


def test_ledger_adds_up(spark):
    df = spark.createDataFrame([("surfaced",), ("surfaced",), ("rejected_scam",), ("pending",), (None,)], "v string")
    got = {r["verdict"]: r["n"] for r in ledger.verdict_ledger(df, "v", gates.VERDICTS).collect()}
    assert got["surfaced"] == 2 and got["rejected_pay"] == 0 and got["accounted"] == 3 and got["unaccounted"] == 2
    empty = {r["verdict"]: r["n"] for r in ledger.verdict_ledger(df.limit(0), "v", gates.VERDICTS).collect()}
    assert set(empty.values()) == {0}
    assert [r["n_broken"] for r in ledger.violations(df, {"set": F.col("v").isNotNull()}).collect()] == [1]


# ------------------------------------------------------------- entities and joins
def test_deduplication_is_order_free(spark):
    rows = [("k", i % 3 == 0, i % 5, f"s{i % 4}", i) for i in range(40)] + [("j", True, 1, "s9", 99), (None, False, 0, "s1", 100)]
    base = spark.createDataFrame(rows, "key string, direct boolean, len int, source string, id int")
    results = set()
    for seed in range(3):
        out = entities.deduplicated(base.orderBy(F.rand(seed)).repartition(5), F.col("key"), [F.col("direct"), F.col("len")], "source", F.col("id").cast("string"))
        results.add(tuple(sorted((r["id"], tuple(r["sources"]), r["copies"]) for r in out.collect())))
    assert len(results) == 1 and len(next(iter(results))) == 3


def test_components_equal_brute_force(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(7, 7)]
    top = list(range(301))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        top[max(x, y)] = min(x, y)
    got = entities.components(spark.range(301), spark.createDataFrame(edges, "a long, b long"), "id").collect()
    assert {r["id"]: r["component"] for r in got} == {i: root(i) for i in range(301)}


def test_aliases_match_whole_words_longest_first(spark):
    aliases = spark.createDataFrame([("open", "o", 0), ("open task", "ot", 1), ("c++", "c", 2), ("lab", "l", 3)], "alias string, target string, turn int")
    names = spark.createDataFrame([("Open Task Inc",), ("Opener",), ("The C++ Guild",), (None,), ("Open-Task",), ("collab",)], "name string")
    assert {r["name"]: r["matched"] for r in joins.alias_matched(names, "name", aliases).collect()} == {"Open Task Inc": "ot", "Opener": None, "The C++ Guild": "c", None: None, "Open-Task": "ot", "collab": None}


def test_last_success_through_an_alias(spark):
    df = spark.createDataFrame([("n",), ("z",)], "id string")
    ev = spark.createDataFrame([("n", 1, 1, True, "a"), ("o", 5, 2, True, "b"), ("n", 9, 3, False, "c"), ("o", 5, 4, True, "d")], "id string, ts int, seq int, success boolean, v string")
    alias = spark.createDataFrame([("o", "n")], "old_id string, new_id string")
    assert {r["id"]: r["last"] and r["last"]["v"] for r in joins.last_success(df, ev, alias, "id", "ts", "seq", ["v"]).collect()} == {"n": "d", "z": None}


def test_comparison_of_audits(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, v string"), spark.createDataFrame([(2, None), (3, "z"), (4, "w")], "id int, v string")
    assert {r["id"]: r["change"] for r in joins.compared(a, b, "id", F.col("v")).collect()} == {1: "removed", 2: "unchanged", 3: "changed", 4: "added"}


def test_alias_chains_stay_one_hop(spark):
    b = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    al = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "old_id string, new_id string")
    assert {r["id"]: (r["status"], r["target"]) for r in joins.resolved_aliases(b, al, "id").collect()} == {"a": ("mapped", "x"), "b": ("held", None), "c": ("own", "c")}


# ------------------------------------------------------------- histories
def test_revisions_count_a_return(spark):
    df = spark.createDataFrame([("s", i, m) for i, m in enumerate("AABBA")] + [("t", 0, None), ("t", 1, None), ("t", 2, "A")], "k string, at int, m string")
    got = {(r["k"], r["at"]): r["revision"] for r in history.revisions(df, ["k"], "at", "at", "m").collect()}
    assert [got["s", i] for i in range(5)] == [1, 1, 2, 2, 3] and [got["t", i] for i in range(3)] == [1, 1, 2]


def test_latest_facts(spark):
    rows = [(1, "p", "me", 1, "a"), (2, "p", "me", 2, "b"), (3, "q", "me", 1, "a"), (4, "q", "you", 1, "b"), (5, "r", "me", 1, "end"), (6, "r", "me", 2, "b"), (7, "t", "me", None, "a"), (8, "u", "me", 1, "a"), (9, "u", "you", 1, "b")]
    df = spark.createDataFrame(rows, "id int, scope string, who string, at int, v string")
    named = spark.createDataFrame([(9,)], "id int")
    got = {r["id"]: r["disposition"] for r in history.latest_facts(df, ["scope"], ["who"], "at", "id", "v", F.col("v") == "end", named).collect()}
    assert got == {1: "superseded", 2: "current", 3: "conflict", 4: "conflict", 5: "conflict", 6: "conflict", 7: "current", 8: "current", 9: "superseded"}


def test_zero_streak_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, i, (s := rng.randrange(50)), s + rng.randrange(1, 9), rng.random() < 0.2) for k in range(30) for i in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "k int, id int, start int, end int, found boolean")
    want = {}
    for k, checks in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        n, until = 0, None
        for _, i, s, e, f in sorted(checks, key=lambda r: (r[3], r[4], r[1])):
            if f:
                n, until = 0, None
            elif until is None or s >= until:
                n, until = n + 1, e
        want[k] = n
    assert {r["k"]: r["streak"] for r in history.zero_streak(df, ["k"], "start", "end", "found", "id").collect()} == want


def test_health_alerts_keep_silent_in_the_cooldown(spark):
    steps = [("failed", 0, "x"), ("failed", 0, "y"), ("ok", 10, ""), ("ok", 4, ""), ("partial", 4, "z"), ("ok", 5, ""), ("ok", 2, "")]
    hours = [0, 1, 2, 3, 4, 5, 40]
    df = spark.createDataFrame([("s", T0 + timedelta(hours=h), *s) for h, s in zip(hours, steps)], "k string, at timestamp, status string, items long, error string")
    got = [r["alert"] for r in history.health_transitions(df, ["k"], "at", "status", "items", "error").orderBy("at").collect()]
    assert got == ["failed", "none", "recovered", "none", "partial", "recovered", "coverage_drop"]


def test_queue_never_repeats_an_uncertain_send(spark):
    rows = [("a", 1, "claim", 0), ("a", 2, "send", 1), ("a", 3, "ok", 2), ("b", 1, "claim", 0), ("b", 2, "send", 99), ("c", 1, "claim", 0), ("c", 2, "send", 1), ("c", 3, "ok", 99), ("c", 4, "claim", 100), ("d", 1, "claim", 0), ("d", 2, "send", 1), ("d", 3, "fail", 2), ("d", 4, "claim", 3), ("d", 5, "send", 4), ("e", 1, "ok", 0)]
    df = spark.createDataFrame([(i, s, a, T0 + timedelta(seconds=t)) for i, s, a, t in rows], "item string, seq int, action string, at timestamp")
    assert {r["item"]: (r["state"], r["attempts"]) for r in state.queue(df, "item", "seq", "action", "at", 10).collect()} == {"a": ("accepted", 1), "b": ("pending", 0), "c": ("uncertain", 1), "d": ("sending", 2), "e": ("pending", 0)}


def test_folds_keep_no_array_of_a_key(spark):
    rng = random.Random(12)
    rows = [(rng.choice([None, 1, 1, 1, 2]), i, rng.choice([0.15, -0.2, 0.01, 0.00005, None]), rng.choice(["claim", "send", "ok", "fail", None]), T0 + timedelta(minutes=i), T0 + timedelta(minutes=i + 3), rng.random() < 0.01) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i int, d double, a string, at timestamp, until timestamp, f boolean").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        scores, queue, streaks = state.clamped_score(df, "k", "i", "d", 0.5), state.queue(df, "k", "i", "a", "at", 120), history.zero_streak(df, ["k"], "at", "until", "f", "i")
        want = {}
        for k, _, d, *_ in rows:
            x, n = want.get(k, (0.5, 0))
            want[k] = (round(min(1.0, max(0.0, x + d)) + 1e-9, 4) if d is not None else 0.0, n + 1)
        assert {r["k"]: (r["score"], r["events"]) for r in scores.collect()} == want
        for out in (scores, queue, streaks):
            assert len(out.collect()) == 3 and "collect_list" not in out._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_md5_of_lines_in_batches():
    import hashlib

    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.string())], ["line"]) for x in ([None], ["1=a", None], [], ["2=b", "3=\u00e9"])]
    got = next(hashing.joined_md5(iter(batches))).to_pylist()
    assert got == [{"n_rows": 5, "digest": hashlib.md5("1=a,2=b,3=\u00e9".encode()).hexdigest()}]


def test_clamped_score_is_not_a_sum(spark):
    df = spark.createDataFrame([("k", i, d) for i, d in enumerate([0.9, 0.9, -0.3])], "k string, i int, d double")
    assert state.clamped_score(df, "k", "i", "d", 0.5).first()["score"] == 0.7


# ------------------------------------------------------------- ranking
def brute_bands(rows, bands, per):
    used, out = Counter(), {}
    for band, limit in bands:
        n = 0
        for v, k, e in sorted((-v, k, e) for k, e, b, v in rows if b == band):
            if used[e] >= per:
                out[k] = "entity_cap"
            elif n >= limit:
                out[k] = "size_cap"
            else:
                out[k], n = "shown", n + 1
                used[e] += 1
    return out


def test_banded_caps_equal_the_greedy_rule(spark):
    rng = random.Random(8)
    bands = [("x", 4), ("y", 5), ("z", 3)]
    rows = [(i, rng.randrange(6), rng.choice("xyz"), rng.randrange(5)) for i in range(90)]
    df = spark.createDataFrame(rows, "k int, e int, band string, v int")
    got = {r["k"]: r["reason"] for r in ranking.banded_caps(df, "k", "e", [F.desc("v"), F.col("k")], bands, 2).collect()}
    assert got == brute_bands(rows, bands, 2)


def test_two_caps_equal_the_greedy_rule(spark):
    rng = random.Random(9)
    for size, n in ((4, 60), (6, 200)):
        rows = [(i, rng.randrange(5), rng.choice([None, 0, 0, 0, 1, 2]), rng.randrange(4)) for i in range(n)]
        df = spark.createDataFrame(rows, "k int, e int, p int, v int").repartition(3)
        ent, plat, shown, want = Counter(), Counter(), 0, {}
        for v, k, e, p in sorted(((-v, k, e, p) for k, e, p, v in rows), key=lambda r: r[:2]):
            if ent[e] >= 2:
                want[k] = "entity_cap"
            elif p is not None and plat[p] >= 2:
                want[k] = "platform_cap"
            elif shown >= size:
                want[k] = "size_cap"
            else:
                want[k], shown = "shown", shown + 1
                ent[e] += 1
                plat[p] += p is not None
        got = {r["k"]: r["reason"] for r in ranking.two_caps(df, "k", "e", "p", [F.desc("v"), F.col("k")], 2, 2, size).collect()}
        assert {k for k, r in got.items() if r == "shown"} == {k for k, r in want.items() if r == "shown"}
        assert all(want[k] == r for k, r in got.items())


def test_two_caps_give_every_row_its_reason(spark):
    rng = random.Random(10)
    for size, n in ((3, 400), (15, 900), (8, 0)):
        rows = [(i, rng.choice([None, 0, 0, 0, 1, 2, 3, 4, 5, 6]), rng.choice([None, 0, 0, 0, 1, 2, 3]), rng.randrange(50)) for i in range(n)]
        df = spark.createDataFrame(rows, "k int, e int, p int, v int").repartition(3)
        ent, plat, shown, want = Counter(), Counter(), 0, {}
        for k, e, p, v in sorted(rows, key=lambda r: (-r[3], r[0])):
            want[k] = "entity_cap" if ent[e] >= 2 else "platform_cap" if plat[p] >= 3 else "size_cap" if shown >= size else "shown"
            if want[k] == "shown":
                shown += 1
                ent[e] += e is not None
                plat[p] += p is not None
        got = ranking.two_caps(df, "k", "e", "p", [F.desc("v"), F.col("k")], 2, 3, size).collect()
        assert len(got) == n and {r["k"]: r["reason"] for r in got} == want


def test_round_robin_is_fair(spark):
    df = spark.createDataFrame([(i, "big" if i < 50 else f"s{i}") for i in range(53)], "id int, source string").repartition(4)
    got = ranking.round_robin(df, "source", [F.col("id")], 6).collect()
    assert Counter(r["source"] for r in got) == {"big": 3, "s50": 1, "s51": 1, "s52": 1} and [r["turn"] for r in got] == [1, 1, 1, 1, 2, 3]


# ------------------------------------------------------------- journals
def test_import_gives_every_row_one_status(spark):
    rows = [("a", "s", "p", 1, [], "x"), ("a", "s", "p", 1, [], "x"), ("b", "s", "p", 2, ["a"], "y"), ("c", "s", "p", 3, ["missing"], "z"), ("d", "s", "p", 4, ["c"], "z"), ("e", "s", "p", 5, ["d"], "z"), ("f", "s", "p", 6, [], "1"), ("f", "s", "p", 6, [], "2"), ("g", "no", "p", 1, [], "x"), ("h", "s", "p", 99, [], "x"), ("i", "s", "q", 7, ["a"], "x"), ("j", "s", "p", 8, ["j"], "x"), ("k", "s", "p", 0, ["a"], "x")]
    df = spark.createDataFrame(rows, "id string, scope string, pred string, seen int, olds array<string>, v string")
    got = outcomes.imported(df, "id", "scope", spark.createDataFrame([("s",)], "scope string"), "seen", F.lit(50), F.col("v"), "olds", "pred")
    assert sorted((r["id"], r["status"]) for r in got.collect()) == [("a", "accepted"), ("a", "duplicate"), ("b", "accepted"), ("c", "invalid_supersession"), ("d", "invalid_supersession"), ("e", "invalid_supersession"), ("f", "event_id_collision"), ("f", "event_id_collision"), ("g", "unmatched_scope"), ("h", "future_evidence"), ("i", "invalid_supersession"), ("j", "invalid_supersession"), ("k", "invalid_supersession")]
    assert tuple(outcomes.import_counts(got).first()) == (13, 2, 1, 10, True)


# ------------------------------------------------------------- evidence
def test_sections_and_claims(spark):
    body = "We are a lab.\nRequirements:\nGerman is required. French is a plus\n3-5 years of practice\n## Benefits\nSnacks"
    got = scalar(spark, evidence.sections, body)
    assert got["requirements"].startswith("German") and got["benefits"] == "Snacks" and got["other"] == "We are a lab."
    languages = {"German": "german", "French": "french"}
    assert [tuple(r) for r in scalar(spark, lambda c: evidence.language_claims(c, languages), body)] == [("German", "required"), ("French", "preferred")]
    assert [tuple(r) for r in scalar(spark, evidence.experience_claims, body)] == [(3.0, 5.0)]
    arrangement = {"a hybrid role": "hybrid", "fully remote, hybrid": "conflicting", "nice": "unknown", None: "unknown"}
    assert {k: scalar(spark, evidence.work_arrangement, k) for k in arrangement} == arrangement


def test_concepts_take_the_first_field(spark):
    df = spark.createDataFrame([(1, "Data labeller", "speech and data"), (2, None, "speech data work")], "id int, title string, body string")
    got = {(r["id"], r["concept"]): (r["field"], r["term"]) for r in evidence.concepts(df, "id", ["title", "body"], {"d": ["data", "speech data"], "s": ["speech"]}).collect()}
    assert got == {(1, "d"): ("title", "data"), (1, "s"): ("body", "speech"), (2, "d"): ("body", "speech data"), (2, "s"): ("body", "speech")}


def test_alternatives_and_unknowns(spark):
    claims = spark.createDataFrame([(1, "g", "de", True), (1, "g", "fr", True), (2, "g", "es", True), (3, "g", "it", True), (3, "h", "es", True), (4, "g", "es", True), (4, "g", "it", True)], "id int, grp string, name string, needed boolean")
    known = spark.createDataFrame([("de", True), ("fr", False), ("es", False)], "name string, has boolean")
    assert {r["id"]: r["status"] for r in evidence.requirement_outcomes(claims, "id", "grp", known).collect()} == {1: "passed", 2: "failed", 3: "failed", 4: "unknown"}


def test_pay_candidates_and_selection(spark):
    df = spark.createDataFrame([(1, "Pay is $20 per hour; we raised $9000000 in funding\nup to $90 per hour", "board"), (2, "nothing", "board")], "id int, body string, kind string")
    rows = evidence.pay_candidates(df, "id", "body", "kind")
    assert rows.count() == 2
    best = evidence.selected_pay(rows, "id", "kind", {"board": 1.0}).collect()
    assert [(r["id"], r["low"]) for r in best] == [(1, 20.0)]
