"""Sections with deferred rows and backfill, releases with band limits, groups and scores, against plain Python."""

import random
from collections import Counter

import pytest
from evidentia.operators import ranking
from evidentia.plans import QUERIES
from evidentia.plans.order_queries import ORDER_SECTIONS

SECTIONS = [("a", 4, 2), ("b", 5, 1), ("c", 3, 3)]


def plain_sections(rows, sections, per_platform):
    out, used = {}, Counter()
    for name, limit, cap in sections:
        mine = sorted((r for r in rows if r[4] == name), key=lambda r: (-r[1], r[0]))
        single = len({r[3] if r[3] is not None else f"direct:{r[0]}" for r in mine}) == 1
        shown, deferred, platforms = 0, [], Counter()
        for k, _, e, p, _ in mine:
            if e is not None and used[e] >= cap:
                out[k] = "entity_cap"
            elif p is not None and platforms[p] >= per_platform:
                deferred.append((k, e))
            elif shown >= limit:
                out[k] = "size_cap"
            else:
                out[k] = "shown"
                shown += 1
                used[e] += 1
                platforms[p] += 1
        if single:
            while deferred and shown < limit:
                k, e = deferred.pop(0)
                if e is not None and used[e] >= cap:
                    out[k] = "entity_cap"
                else:
                    out[k] = "backfill"
                    shown += 1
                    used[e] += 1
        out |= {k: "platform_cap" for k, _ in deferred}
    return out


def made(rng, n, single):
    return [(i, rng.randint(0, 20), rng.choice(["x", "y", "z", "v", None]), ("p" if s in single else rng.choice(["p", "q", None])), s) for i in range(n) for s in [rng.choice("abcd")]]


@pytest.mark.parametrize("seed", range(6))
def test_sections_equal_the_greedy_rule(spark, seed):
    rng = random.Random(seed)
    rows = made(rng, rng.choice([0, 12, 60]), rng.choice([(), ("a",), ("a", "b"), ("b", "c")]))
    df = spark.createDataFrame(rows, "k long, score int, e string, p string, s string").repartition(3)
    got = {r["k"]: r["reason"] for r in ranking.sectioned(df, "k", "e", "p", "s", [("score", False), ("k", True)], SECTIONS, 2).collect()}
    assert got == plain_sections(rows, SECTIONS, 2)


def test_backfill_fills_a_section_of_one_platform(spark):
    rows = [(i, 100 - i, f"e{i % 7}", "p", "a") for i in range(30)]
    df = spark.createDataFrame(rows, "k long, score int, e string, p string, s string")
    got = {r["k"]: r["reason"] for r in ranking.sectioned(df, "k", "e", "p", "s", [("score", False), ("k", True)], [("a", 6, 1)], 2).collect()}
    assert got == plain_sections(rows, [("a", 6, 1)], 2) and Counter(got.values())["backfill"] == 4


@pytest.mark.parametrize("seed", range(4))
def test_release_equals_the_greedy_rule(spark, seed):
    rng = random.Random(seed)
    rows = made(rng, 70, ())
    df = spark.createDataFrame(rows, "k long, score int, e string, p string, s string").repartition(3)
    limits = {"a": 3, "b": 2}
    want, entities, platforms, bands = {}, Counter(), Counter(), Counter()
    for k, _, e, p, s in sorted(rows, key=lambda r: (-r[1], r[0])):
        if s not in limits:
            want[k] = "no_band"
        elif e is not None and entities[e] >= 2:
            want[k] = "entity_cap"
        elif p is not None and platforms[p] >= 2:
            want[k] = "platform_cap"
        elif bands[s] >= limits[s]:
            want[k] = "band_cap"
        else:
            want[k] = "shown"
            entities[e] += 1
            platforms[p] += 1
            bands[s] += 1
    got = {r["k"]: r["reason"] for r in ranking.released(df, "k", "e", "p", "s", [("score", False), ("k", True)], limits, 2, 2).collect()}
    assert got == want


def test_queries_equal_the_greedy_rule_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority").collect()
    rows = [(k, price, str(c % 25), None if c % 7 == 0 and p != "1-URGENT" else "main" if p == "1-URGENT" else f"p{c % 3}", p) for k, price, c, p in o]
    got = {r["o_orderkey"]: r["reason"] for r in QUERIES["section_backfill"](spark, sf).collect()}
    assert got == plain_sections(rows, ORDER_SECTIONS, 2) and "backfill" in got.values() and "platform_cap" in got.values()
