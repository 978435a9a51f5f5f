"""Readers, mappers, sinks and streaming flows on small files."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidentia.operators import state
from evidentia.sources import mappers, readers, sinks
from evidentia.streaming import flows


def put(folder, name, content):
    path = folder / name
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(path)


def test_one_broken_source_leaves_the_others(spark, tmp_path):
    paths = {
        "search_feed": put(tmp_path, "a.json", {"jobs": [{"title": "T", "company_name": "C", "url": "https://x.com/a?utm_s=1", "publication_date": "2024-01-01", "salary": "$20 per hour"}, {"title": ""}]}),
        "open_list": put(tmp_path, "b.json", [{"legal": "row without id"}, {"id": "1", "position": "P", "url": "https://y.com", "salary_min": "10", "salary_max": "20", "date": "1704067200"}]),
        "term_feed": str(tmp_path / "missing.json"),
        "offers": put(tmp_path, "o.jsonl", ""),
    }
    raw, health = readers.ingested(spark, paths)
    assert {r["source"]: r["status"] for r in health.collect()} == {"search_feed": "ok", "open_list": "ok", "term_feed": "failed", "offers": "empty"}
    got = {(r["source"], r["title"]): r for r in mappers.normalized(raw).collect()}
    assert got["open_list", "P"]["pay_raw"] == "10-20 per year" and got["search_feed", "T"]["posted"] == datetime(2024, 1, 1)
    assert got["search_feed", None]["issue"] == "no_title" and got["open_list", "P"]["issue"] is None
    clean = mappers.canonical(mappers.normalized(raw)).where("title = 'T'").first()
    assert clean["shown_url"] == "https://x.com/a" and not clean["truncated"]
    with pytest.raises(ValueError):
        readers.ingested(spark, paths, only="nobody")
    assert readers.ingested(spark, paths, only="open_list", limit=0)[0].count() == 0


def test_unknown_sources_are_kept_with_an_issue(spark):
    assert mappers.normalized(spark.createDataFrame([("mystery", "{}"), ("offers", None)], readers.RAW)).select("issue").distinct().count() == 2


def test_payloads_once_and_boards(spark):
    df = spark.createDataFrame([("q1", '{"a":1}'), ("q2", '{"a":1}'), ("q2", "oops"), ("q2", '{"a":2}')], "query string, raw string")
    kept, counts = readers.exact_once(df, "raw", "query")
    assert kept.count() == 2 and {r["query"]: tuple(r)[1:] for r in counts.collect()} == {"q1": (1, 0, 0), "q2": (1, 1, 1)}
    b = spark.createDataFrame([("ok", 200, '{"isListed":true}'), ("ok", 200, '{"isListed":false}'), ("part", 200, "{}"), ("gone", 404, None), ("../x", 200, "{}")], "board string, http_status int, raw string")
    rows, health = readers.boards(b, True)
    assert rows.count() == 2 and {r["board"]: r["status"] for r in health.collect()} == {"ok": "ok", "part": "partial", "gone": "failed", "../x": "failed"}
    ids = readers.with_identity(spark.createDataFrame([("1", "t"), ("1", "u"), (None, "v"), (None, "v"), ("", "w")], "id string, t string"), F.col("id"), [F.col("t")])
    assert ids.count() == 3


def test_snapshots_round_trip_and_count(spark, tmp_path):
    raw = spark.createDataFrame([("s", '{"a": "x\\ny"}'), ("t", "{}")], readers.RAW)
    sinks.write_snapshot(raw, str(tmp_path / "snap"), {"version": 1})
    header, records = readers.snapshot(spark, str(tmp_path / "snap/*"))
    assert header["record_count"] == 2 and sorted(map(tuple, records.collect())) == sorted(map(tuple, raw.collect()))
    bad = put(tmp_path, "bad.jsonl", '{"type":"header","record_count":2}\n{"source":"s","raw":"{}"}\n')
    with pytest.raises(ValueError):
        readers.snapshot(spark, bad)


def test_bounds_audits_and_news(spark, tmp_path):
    small = put(tmp_path, "s.jsonl", "{}\n\n{}\n")
    assert readers.bounded_lines(spark, small).count() == 2
    with pytest.raises(ValueError):
        readers.bounded_lines(spark, small, most_rows=1)
    assert readers.audit(spark, put(tmp_path, "a.json", {"rows": [{"id": "1"}, {"id": "2"}]})).count() == 2
    for bad in ('{"rows": [{"id": "1"}, {"id": "1"}]}', '{"rows": [{"id": "1", "x": NaN}]}', '{"rows": [{}]}'):
        with pytest.raises(ValueError):
            readers.audit(spark, put(tmp_path, "b.json", bad))
    feed = put(tmp_path, "f.xml", "<rss><channel><item><title>A &amp; B</title><link>https://n.org/1</link><source>N</source><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>C</title><link>https://n.org/2</link></item></channel></rss>")
    got = {r["title"]: (r["outlet"], r["published"]) for r in readers.news(spark, feed).collect()}
    assert got == {"A & B": ("N", datetime(2024, 1, 1, 10)), "C": ("https://n.org/2", None)}


def test_postings_links_and_threads(spark):
    html = '<script type="application/ld+json">{"@type":"WebSite"}</script><script type="application/ld+json">{"@type":"JobPosting","title":"T","hiringOrganization":{"name":"C"},"baseSalary":{"currency":"USD","value":{"minValue":5,"unitText":"HOUR"}}}</script><a href="https://a.org/x">1</a><a class=z href="https://a.org/x">2</a><a href="https://nota.org/">3</a>'
    df = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    row = df.select("id", *[c.alias(k) for k, c in readers.posting_columns(F.col("html")).items()]).where("id = 1").first()
    assert (row["title"], row["company"], row["location"], row["pay_raw"]) == ("T", "C", None, "USD 5 hour")
    assert [r["url"] for r in readers.links(df, "html", "a.org").collect()] == ["https://a.org/x"]
    page = json.dumps({"id": 7, "post_stream": {"posts": [{"id": 1, "post_number": 1, "user_id": 5, "cooked": "<p>hi</p>", "created_at": "2024-01-01T00:00:00Z"}, {"id": 2, "post_number": 2, "hidden": True, "user_id": 5, "cooked": "x"}]}})
    posts = readers.thread_posts(spark.createDataFrame([(page,)], "raw string"), "raw").orderBy("post_id").collect()
    assert [(p["text"], p["issue"]) for p in posts] == [("hi", None), ("", "hidden")]


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "runs")
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    sinks.write_run({"jobs": a}, out, "r1")
    a.write.parquet(f"{out}/jobs/run_id=r2")  # a run that broke off before its manifest
    assert [tuple(r) for r in sinks.read_runs(spark, out, "jobs", "id int, v string").collect()] == [(1, "x", "r1")]
    parts = spark.createDataFrame([("abcdefg",), ("",)], "t string").select(sinks.chunks(F.col("t"), 3).alias("c")).collect()
    assert [p["c"] for p in parts] == [["abc", "def", "g"], [""]]
    d = sinks.digest(spark.createDataFrame([("s", 2, "b"), ("s", 1, "a"), ("t", 1, "c")], "sec string, n int, l string"), "sec", F.col("l"), [F.col("n")])
    assert {r["sec"]: r["text"] for r in d.collect()} == {"s": "## s\na\nb", "t": "## t\nc"}
    old, new = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "id int, first int, v string"), spark.createDataFrame([(2, 9, "c"), (3, 9, "d")], "id int, first int, v string")
    assert sorted(map(tuple, state.upserted(old, new, "id", "first").collect())) == [(1, 5, "a"), (2, 6, "c"), (3, 9, "d")]


# ------------------------------------------------------------- streams
def streamed(spark, folder, rows, schema, parts, flow, mode, tmp):
    """The rows as files, one batch a file, through a flow; all rows that came out, in order."""
    n = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * n : (i + 1) * n], schema).coalesce(1).write.mode("append").parquet(folder)
    out, seen = [], []

    def take(batch, _):
        out.extend(map(tuple, batch.collect()))
        seen.append(1)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    flow(stream).writeStream.outputMode(mode).foreachBatch(take).option("checkpointLocation", tmp).trigger(availableNow=True).start().awaitTermination()
    return out


def test_seen_set_stream_equals_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i % 17, t0 + timedelta(minutes=i)) for i in range(60)]
    got = streamed(spark, str(tmp_path / "in"), rows, "id long, at timestamp", 3, lambda s: flows.unseen(s, "id", "at", "1 day"), "append", str(tmp_path / "cp"))
    assert sorted(r[0] for r in got) == list(range(17))


def test_queue_stream_equals_batch(spark, tmp_path):
    rng, t0 = random.Random(1), datetime(2024, 1, 1)
    rows = [(rng.randrange(8), i, rng.choice(["claim", "claim", "send", "send", "ok", "fail"]), t0 + timedelta(seconds=i * 3)) for i in range(120)]
    schema = "item long, seq long, action string, at timestamp"
    got = streamed(spark, str(tmp_path / "in"), rows, schema, 3, lambda s: flows.queue(s, "item", "seq", "action", "at", 40), "update", str(tmp_path / "cp"))
    latest = {r[0]: (r[1], r[2]) for r in got}
    want = {r["item"]: (r["state"], r["attempts"]) for r in state.queue(spark.createDataFrame(rows, schema), "item", "seq", "action", "at", 40).collect()}
    assert latest == want


def test_repeated_batches_add_nothing(spark, tmp_path):
    sink, out = flows.upsert_batches("id", str(tmp_path / "t")), str(tmp_path / "t")
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    for _ in range(2):
        sink(batch, 0)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(1, t0 + timedelta(minutes=m)) for m in (0, 1, 11, 12, 40, 41)]
    got = streamed(spark, str(tmp_path / "in"), rows, "id long, at timestamp", 3, lambda s: flows.counted(s, "at", "10 minutes", "5 minutes"), "append", str(tmp_path / "cp"))
    assert [r[-1] for r in sorted(got, key=str)] == [2, 2]


def test_late_snapshots_over_a_stream_equal_their_batch_form(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.randrange(4), i, rng.choice([None, rng.randrange(20)])) for i in range(60)]
    got = streamed(spark, str(tmp_path / "in"), rows, "key long, seq long, as_of long", 3, lambda s: flows.late(s, "key", "seq", "as_of"), "append", str(tmp_path / "cp"))
    want = state.late(spark.createDataFrame(rows, "key long, seq long, as_of long"), ["key"], "seq", "as_of")
    assert sorted((r[1], r[3]) for r in got) == sorted((r["seq"], r["late"]) for r in want.collect())


def test_dimension_files_and_waiting_queues(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("platforms:\n  shop: {trust: 0.5, note: a}\n  board: {trust: 0.9}\n")
    (tmp_path / "c.yaml").write_text("- {key: a, status: todo}\n- {key: b}\n")
    rows = readers.dimension(spark, str(tmp_path / "r.yaml"), "key string, trust double, note string", "platforms").collect()
    assert {r["key"]: (r["trust"], r["note"]) for r in rows} == {"shop": (0.5, "a"), "board": (0.9, None)}
    assert [tuple(r) for r in readers.dimension(spark, str(tmp_path / "c.yaml"), "key string, status string").collect()] == [("a", "todo"), ("b", None)]
    sinks.save_pending(spark.createDataFrame([("b",), ("a",), ("b",)], "id string"), "id", str(tmp_path / "q"))
    assert sorted(r["id"] for r in readers.pending(spark, str(tmp_path / "q")).collect()) == ["a", "b"]
    (tmp_path / "broken").write_text("{not json")
    assert readers.pending(spark, str(tmp_path / "broken")).count() == 0


@pytest.mark.parametrize("text", ['{"rows": [{"id": "a", "id": "b"}]}', '{"rows": [{"id": "a", "x": NaN}]}', '{"rows": [', '{"rows": [{"id": "a"}, {"id": "a"}]}'])
def test_audits_are_read_strictly(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(ValueError):
        readers.audit(spark, str(tmp_path / "a.json"))
    (tmp_path / "ok.json").write_text('{"rows": [{"id": "a", "said": ": NaN"}]}')
    assert readers.audit(spark, str(tmp_path / "ok.json")).count() == 1
    with pytest.raises(ValueError):
        readers.audit(spark, str(tmp_path / "ok.json"), most_bytes=5)


def test_role_pages_from_their_own_json_or_their_text(spark):
    pages = ['<h1>Old</h1><script id="x" type="application/json">{"job": {"title": "Rater", "text": "Rate"}}</script>', "<h1>Tutor</h1><nav>Home</nav><p>Teach.</p>", "<h1>A</h1><h1>B</h1><form><p>x</p>", None]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    got = df.select(*[c.alias(n) for n, c in readers.native_role(F.col("html"), {"title": "$.job.title", "description": "$.job.text"}).items()])
    assert [tuple(r) for r in got.collect()] == [("Rater", "Rate"), ("Tutor", "Tutor\nTeach."), (None, None), (None, None)]
