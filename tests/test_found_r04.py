"""What the fourth review found."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import payloads
from evidentia.operators import observations


def resolved(spark, records):
    df = spark.createDataFrame([(i, r, "https://board.example/x", "unknown", 0.5) for i, r in enumerate(records)], "id long, record string, url string, kind string, confidence double")
    return observations.resolved(df, "record", "url", "kind", "confidence").orderBy("id").collect()


def record(**members):
    return '{"attempted":true,"redirect_trail":["https://board.example/r"],"normalized_url":"https://employer.example/1?token=x","source_kind":"original_employer","source_confidence":0.9' + "".join(f',"{k}":{v}' for k, v in members.items()) + "}"


@pytest.mark.parametrize("depth", [1, 7, 8, 9, 64, 999, 1001, 50000])
def test_a_record_of_any_depth_is_resolved(spark, depth):
    nest = lambda x: '{"z":1,"a":' * (depth - 1) + x + "}" * (depth - 1)
    safe = lambda x: '{"a":' * (depth - 1) + x + ',"z":1}' * (depth - 1)
    posting, hidden = '{"link":" https://h.example?key=k ","Token":[{}]}', '{"Token":"[redacted]","link":"https://h.example/"}'
    (r,) = resolved(spark, [record(hydrated_job=nest(posting), hydrated_source='"board"')])
    assert r["resolution_attempted"] and r["url"] == "https://employer.example/1" and r["redirect_trail"] == ["https://board.example/r"]
    assert (r["kind"], r["confidence"], r["hydrated_source"]) == ("original_employer", 0.9, "board")
    assert r["hydrated"] == safe(hidden)


def test_what_nests_beside_the_rest_costs_it_nothing(spark):
    deep = "[" * 1500 + "]" * 1500
    (r,) = resolved(spark, [f'{{"attempted":true,"error":{{"b":{deep},"a":"x"}},"redirect_trail":[{deep},"https://a.example/",{{"c":{deep}}}],"normalized_url":"https://b.example/","other":{deep},"source_kind":{deep}}}'])
    assert r["resolution_attempted"] and r["redirect_trail"] == ["https://a.example/"] and r["url"] == "https://b.example/"
    assert r["resolution_error"] == f'{{"a":"x","b":{deep}}}' and r["kind"] == "unknown"


def test_what_is_no_json_deep_inside_changes_nothing(spark):
    deep = lambda x: record(hydrated_job='{"a":' * 20 + x + "}" * 20)
    bad = ['{"a":1,"\\u0061":2}', "[1,]", "[,1]", "[1 2]", '{"a"}', '{"a":}', '{"a":1,}', '{"a"::1}', '{1:2}', '["a":1]', "true-", "nul", "01", "NaN", '"\\x"', '"\x01"', '"', ":", "{]", "[{}{}]"]
    assert {(r["resolution_attempted"], r["url"], r["hydrated"]) for r in resolved(spark, [deep(x) for x in bad] + [deep("1")[:-1], "", None, "[1]", "7"])} == {(False, "https://board.example/x", None)}
    assert all(r["resolution_attempted"] for r in resolved(spark, [deep(x) for x in ("[]", "{}", "-0.5e3", ' [ 1 , { "b" : null } ] ', '"\\u007d\\""')]))


def test_members_are_those_of_the_walk(spark):
    rng = random.Random(4)
    names = ["a", "b", "", "Token", "Key", "é", "\U0001f600", "￿", 'q"', "x:", "10", "9"]
    leaves = ["", "x", " https://h.example?token=t&x=1 ", "Authorization: Bearer q, next", '"\\\n', ":", "{", 1, -0.0, 1.5, 10**20, True, None]

    def value(depth):
        form = rng.random()
        if depth == 0 or form < 0.3:
            return rng.choice(leaves)
        return [value(depth - 1) for _ in range(rng.randrange(4))] if form < 0.6 else {rng.choice(names): value(depth - 1) for _ in range(rng.randrange(4))}

    df = spark.createDataFrame([(json.dumps({"v": value(6)}, ensure_ascii=i % 2 == 0, indent=i % 3 or None),) for i in range(500)], "r string")
    rows = df.select(payloads.sanitized(F.col("r")).alias("walk"), payloads.members(F.col("r")).alias("m")).collect()
    for r in rows:
        assert r["walk"] == (f'{{"v":{r["m"]["nested"]["v"]}}}' if "v" in r["m"]["nested"] else r["m"]["flat"])
    assert sum("v" in r["m"]["nested"] for r in rows) > 200
