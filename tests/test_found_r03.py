"""What the third review found: each query against its SQL on small tables made for the case."""

import re
import time

import duckdb
from pyspark.sql import functions as F

from evidentia.functions import elements
from evidentia.operators import claims, entities, observations
from evidentia.plans import ORACLES, QUERIES


def both(spark, folder, name, table, df):
    """Sorted rows of a query and of its SQL over a table made for it, columns in the order of their names."""
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    return against_sql(spark, folder, name, con)


def against_sql(spark, folder, name, con):
    got, want = QUERIES[name](spark, str(folder)), con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    order = sorted(names)
    rows = lambda found: sorted(tuple(str(r[names.index(c)]) for c in order) for r in found)
    return sorted(map(lambda r: tuple(map(str, r)), got.select(*[F.col(f"`{c}`") for c in order]).collect())), rows(want.fetchall())


#: Paragraphs that are never closed, as HTML allows: deeper than the limit of elements, then more tags than it.
DEEP = ("<div>" + "<p><b>a" * 70 + "<nav>x</nav>b</div>c", "<div>" * 90 + "a<form>y</form>" + "</div>" * 90, "<p>a<button>y</button>" * 4000)


def deep_pages(spark):
    return spark.createDataFrame([(i, DEEP[i % 3]) for i in range(12)], "page_id long, html string")


def test_role_markup_of_deep_and_long_pages(spark, tmp_path):
    got, want = both(spark, tmp_path, "role_markup", "pages", deep_pages(spark))
    assert got == want and all(r[0] != "None" for r in got)


def test_blocks_of_a_deep_page(spark):
    df = spark.createDataFrame([(DEEP[0],)], "m string")
    assert df.select(elements.blocks(F.col("m")).alias("b")).first()["b"] == ["a"] * 69 + ["a b", "c"]


def test_nested_regions_of_deep_and_long_pages(spark, tmp_path):
    got, want = both(spark, tmp_path, "nested_regions", "pages", deep_pages(spark))
    assert got == want and sum(r[0] != "None" for r in got) == 8


#: Balances whose shares lie beside a half of the last place: multiples of 40.96, and others.
def near_halves(spark, folder):
    con = duckdb.connect()
    con.execute("create table nation as select i::int as n_nationkey, 'N' || i as n_name from range(25) t(i)")
    con.execute("create table supplier as select i as s_suppkey, (i % 25)::int as s_nationkey, ((i - 400) * 4096 // 8 / 100.0)::double as s_acctbal from range(2500) t(i)")
    for t in ("nation", "supplier"):
        con.execute(f"copy {t} to '{folder}/{t}.parquet' (format parquet)")
    return con


def test_rates_beside_half_a_cent(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "registry_left_join", near_halves(spark, tmp_path))
    assert len(got) == 2500 and got == want


def test_trust_beside_half_of_the_last_place(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "trust_scores", near_halves(spark, tmp_path))
    assert len(got) == 2500 and got == want


def test_letters_without_case_are_those_of_the_patterns():
    for letter in "abcdefghijklmnopqrstuvwxyz":
        pattern = re.compile(f"(?i){letter}")
        for c in filter(pattern.fullmatch, map(chr, range(0x3000))):
            assert claims.small(c) == letter
    assert [k for k, *_ in claims.claims_of("A licen\u017fe and 20 \u0130NR 7.")] == ["credential", "money:unknown"]


def test_a_long_text_without_claims_costs_less_than_its_patterns():
    text = "an der und ist die ein of the and to on que los " * 20000
    began = time.process_time()
    for pattern in (*claims.NAMED.values(), *(p for _, p in claims.MODALITIES), *(p for _, p in claims.CONDITIONS)):
        pattern.search(text)
    patterns, began = time.process_time() - began, time.process_time()
    assert list(claims.claims_of(text)) == []
    assert time.process_time() - began < patterns


def test_conditions_read_the_claims_once(spark):
    df = claims.span_claims(spark.createDataFrame([(1, "We pay $7 per task. Payment is sent within 3 days.")], "id long, body string"), "body")
    out = claims.bound_conditions(df, "id")
    assert out._jdf.queryExecution().executedPlan().toString().count("BatchEvalPythonUDTF") == 1
    assert [(r.amount, r.found) for r in out.collect()] == [("$7 per task", "section")]


def test_a_resolvers_record_is_read_once(spark):
    df = spark.createDataFrame([(1, '{"attempted":true}', "https://a.example/", "unknown", 0.5)], "id long, record string, url string, kind string, confidence double")
    out = observations.resolved(df, "record", "url", "kind", "confidence")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.lower().count("parse_json") + plan.lower().count("parsejson") <= 2
    assert out.columns == [*df.columns, "resolution_attempted", "resolution_error", "redirect_trail", "hydrated", "hydrated_source"]
    assert out.first()["resolution_attempted"] is True


def test_parts_of_claims_follow_their_number(spark, monkeypatch):
    monkeypatch.setattr(entities, "PART_ROWS", 100)
    df = spark.range(5000).select((F.col("id") % 500).alias("k"), (F.col("id") % 7).cast("double").alias("amount"), (F.col("id") % 3).alias("source"), "id")
    out = entities.corroborated(df, ["k"], "amount", "source", 0.5, "id")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert out.rdd.getNumPartitions() == 50 and out.count() == 5000
