"""The pipeline's stages against brute force on small documents, with nulls, repeats, empty tables and odd columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from evidentia.llm import toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """labels and benchmark beside documents of which some are toxic, copies, contaminated or odd."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = say(40)
    texts = {i: say(rng.randrange(40, 90)) for i in range(200)}
    for i in range(0, 200, 4):
        t = texts[i].split()
        for _ in range(4):
            t[rng.randrange(len(t))] = rng.choice(["zgrompf", "quaxxle", "vizzbok"])
        texts[i] = " ".join(t)
    texts[201] = texts[1]
    texts[203] = texts[3] + " tail"
    texts[205] = say(50) + " " + item + " " + say(50)
    texts |= {207: None, 209: "", 211: "short"}
    out = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "x") for i, t in texts.items()]
    spark.createDataFrame(rows, DOC).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), texts


def test_stages_keep_and_drop_what_they_should(spark, folder):
    sf, texts = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = p.without_toxic(spark, docs, sf)
    assert clean.columns == docs.columns
    kept = {r["doc_id"] for r in clean.collect()}
    toxic = {i for i in range(0, 200, 4)}
    assert len(toxic & kept) <= 2 and len(set(texts) - toxic - kept) <= 2
    rest = p.without_near_duplicates(spark, docs, sf)
    assert rest.columns == docs.columns and {r["doc_id"] for r in rest.collect()} == set(texts) - {201, 203}
    rest = p.without_benchmark(spark, docs, sf)
    assert rest.columns == docs.columns and {r["doc_id"] for r in rest.collect()} == set(texts) - {205}
    pieces = p.packed(spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == set(texts)


def test_run_is_the_stages_in_turn(spark, folder):
    sf, texts = folder
    got = {r["doc_id"] for r in p.run(spark, sf).collect()}
    assert not got & {201, 203, 205} and {207, 209, 211} <= got and len(got) >= 145


def test_rows_of_one_doc_id_are_judged_by_their_own_text(spark, folder):
    sf, _ = folder
    rng = random.Random(6)
    a, b, c = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "abc")
    rows = [(2, a), (4, a), (4, b), (3, b + " tail"), (4, c), (9, c), (9, a + " tail"), (1, "short"), (None, a), (5, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("number", F.lit("n")).repartition(3)
    got = p.without_near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns
    key = lambda r: (r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted([(2, a), (3, b + " tail"), (4, c), (1, "short"), (None, a), (5, None), (5, "")], key=key)


def test_empty_and_odd_documents(spark, folder):
    sf, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, None), (7, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string").withColumn("row", F.lit("r"))
    for name, stage in p.STAGES:
        assert stage(spark, odd, sf).count() == 4, name
    assert isinstance(toxicity.fit(["a"], np.array([1])), toxicity.Model)
