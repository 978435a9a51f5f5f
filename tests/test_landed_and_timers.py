"""Feeds of landed pages, one read of each source, appends with a log, and streams with timers."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidentia.sources import landed, readers
from evidentia.streaming import timers

NOW = datetime(2024, 5, 1, 12)


def put_pages(root, feed, pages):
    (root / feed).mkdir(parents=True)
    for i, page in enumerate(pages):
        if page is not None:
            (root / feed / f"{i + 1}.json").write_text(page if isinstance(page, str) else json.dumps(page))


def health(df):
    return {r["feed"]: (r["page"], r["status"], r["detail"]) for r in df.where("kind = 'health'").collect()}


def test_a_broken_page_keeps_those_before_it(spark, tmp_path):
    page = lambda *ids, **k: {"data": [{"id": i} for i in ids], **k}
    put_pages(tmp_path, "whole", [page(1, 2), page(3, last=True), page(9)])
    put_pages(tmp_path, "broken", [page(1), page(2), "{oops", page(4)])
    put_pages(tmp_path, "gap", [page(1), None, page(3)])
    put_pages(tmp_path, "refused", [{"status": 503}])
    put_pages(tmp_path, "wrong", [{"data": [1]}])
    put_pages(tmp_path, "nothing", [page()])
    put_pages(tmp_path, "long", [page(1), page(2), page(3), page(4)])
    df = landed.read_pages(spark, str(tmp_path), most=3)
    assert health(df) == {"whole": (2, "ok", None), "broken": (2, "partial", "bad_page:JSONDecodeError"), "gap": (1, "partial", "missing_page:2"), "refused": (0, "failed", "http:503"), "wrong": (0, "failed", "bad_page:ValueError"), "nothing": (1, "empty", None), "long": (3, "partial", "page_budget")}
    items = df.where("kind = 'item'").select("feed", "page", F.get_json_object("item", "$.id").cast("int").alias("id")).collect()
    assert sorted((r["feed"], r["page"], r["id"]) for r in items) == [("broken", 1, 1), ("broken", 2, 2), ("gap", 1, 1), ("long", 1, 1), ("long", 2, 2), ("long", 3, 3), ("whole", 1, 1), ("whole", 1, 2), ("whole", 2, 3)]
    assert df.rdd.getNumPartitions() == 7


def test_boards_stop_when_their_provider_refuses(spark, tmp_path):
    ok = {"data": [{"id": 1}], "last": True}
    for name, pages in {"x-a": [ok], "x-b": [{"status": 429}], "x-c": [ok], "y-a": [{"status": 500}], "y-b": [ok]}.items():
        put_pages(tmp_path, name, pages)
    df = landed.read_pages(spark, str(tmp_path), mode="boards")
    assert {k: v[1:] for k, v in health(df).items()} == {"x-a": ("ok", None), "x-b": ("failed", "http:429"), "x-c": ("deferred", "refused:429"), "y-a": ("failed", "http:500"), "y-b": ("ok", None)}
    assert df.where("kind = 'item'").count() == 2


def test_each_source_is_read_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def counted(name):
        def read(session, path):
            rows = session.range(4).repartition(2)

            def touch(batches):
                for b in batches:
                    reads.add(b.num_rows)
                    yield b

            return rows.mapInArrow(touch, "id long").select(F.lit(name).alias("source"), F.col("id").cast("string").alias("raw"))

        return read

    def broken(session, path):
        return session.range(3).select(F.lit("b").alias("source"), F.raise_error(F.lit("late")).cast("string").alias("raw"))

    sources = {"one": counted("one"), "bad": broken, "two": counted("two"), "none": readers.json_lines("none")}
    (tmp_path / "n.jsonl").write_text("")
    rows, told = landed.ingested_once(spark, dict.fromkeys(sources, str(tmp_path / "n.jsonl")), str(tmp_path / "out"), sources)
    assert [(r["source"], r["status"], r["items"]) for r in told.collect()] == [("one", "ok", 4), ("bad", "failed", 0), ("two", "ok", 4), ("none", "empty", 0)]
    assert rows.count() == 8 and reads.value == 8


def test_a_repeated_batch_adds_nothing(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "k long"
    sink = landed.committed_batches(path)
    rows = lambda *k: spark.createDataFrame([(x,) for x in k], schema)
    sink(rows(1, 2), 0)
    sink(rows(1, 2), 0)
    sink(rows(3), 1)
    rows(4, 5).write.parquet(f"{path}/data/batch=2")  # a batch that broke off before its line
    assert sorted(r["k"] for r in landed.committed(spark, path, schema).collect()) == [1, 2, 3]
    assert [(r["batch"], r["issue"]) for r in landed.doctor(spark, path, schema).collect()] == [(2, "uncommitted")]
    sink(rows(4), 2)
    assert sorted(r["k"] for r in landed.committed(spark, path, schema).collect()) == [1, 2, 3, 4] and landed.doctor(spark, path, schema).count() == 0
    assert landed.restored(spark, path, str(tmp_path / "copy"), schema) == 4
    with pytest.raises(FileExistsError):
        landed.restored(spark, path, str(tmp_path / "copy"), schema)
    rows(9).write.mode("append").parquet(f"{path}/data/batch=1")
    assert [(r["batch"], r["issue"]) for r in landed.doctor(spark, path, schema).collect()] == [(1, "count")]


def run_stream(spark, tmp_path, schema, batches, flow, name):
    """Rows after each batch of a stream over files."""
    timers.use_timers(spark)
    source, found = tmp_path / f"{name}-in", []
    source.mkdir()
    stream = flow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
    query = stream.writeStream.outputMode("update" if name != "aliases" else "append").option("checkpointLocation", str(tmp_path / f"{name}-state")).foreachBatch(lambda df, _: found.append(df.collect())).start()
    try:
        for i, batch in enumerate(batches):
            (source / f"{i}.json").write_text("\n".join(json.dumps(r) for r in batch))
            query.processAllAvailable()
    finally:
        query.stop()
    return [tuple(r) for rows in found for r in rows]


def at(minutes):
    return (NOW + timedelta(minutes=minutes)).isoformat()


def test_a_lease_runs_out_without_another_event(spark, tmp_path):
    schema = "item long, seq long, action string, at timestamp"
    batches = [
        [{"item": 1, "seq": 1, "action": "claim", "at": at(0)}, {"item": 2, "seq": 2, "action": "claim", "at": at(0)}, {"item": 2, "seq": 3, "action": "send", "at": at(1)}, {"item": 3, "seq": 4, "action": "claim", "at": at(0)}],
        [{"item": 3, "seq": 5, "action": "send", "at": at(5)}, {"item": 3, "seq": 6, "action": "ok", "at": at(6)}],
        [{"item": 9, "seq": 7, "action": "claim", "at": at(60)}],  # moves the clock for all
        [{"item": 9, "seq": 8, "action": "send", "at": at(61)}],
    ]
    got = run_stream(spark, tmp_path, schema, batches, lambda s: timers.leases(s, "item", "seq", "action", "at", 600, "1 minute"), "leases")
    last = {r[0]: r[1:] for r in got}
    assert last[1] == ("pending", 0, "lapsed") and last[2] == ("uncertain", 1, "lapsed") and last[3] == ("accepted", 1, "action") and last[9] == ("sending", 1, "action")


def test_a_check_goes_stale_and_comes_back(spark, tmp_path):
    schema = "subject long, at timestamp"
    batches = [[{"subject": 1, "at": at(0)}, {"subject": 2, "at": at(0)}], [{"subject": 2, "at": at(100)}], [{"subject": 3, "at": at(200)}], [{"subject": 3, "at": at(201)}, {"subject": 1, "at": at(202)}]]
    got = run_stream(spark, tmp_path, schema, batches, lambda s: timers.freshness(s, "subject", "at", 2, "1 minute"), "fresh")
    states = {k: [r[1] for r in got if r[0] == k] for k in (1, 2, 3)}
    assert states == {1: ["verified", "stale", "verified"], 2: ["verified", "verified"], 3: ["verified", "verified"]}


def test_rows_wait_for_their_alias(spark, tmp_path):
    schema = "id long, name string, form string"
    batches = [[{"id": 1, "name": "acme"}, {"id": 2, "name": "b"}], [{"name": "acme", "form": "ACME Ltd"}], [{"id": 3, "name": "acme"}, {"name": "acme", "form": "Acme Inc"}], [{"id": 4, "name": "acme"}]]
    got = run_stream(spark, tmp_path, schema, batches, lambda s: timers.aliased(s.where("id is not null").select("id", "name"), s.where("form is not null").select("name", "form")), "aliases")
    assert sorted(got) == [(1, "acme", "ACME Ltd", "resolved"), (3, "acme", None, "held"), (4, "acme", None, "held")]
