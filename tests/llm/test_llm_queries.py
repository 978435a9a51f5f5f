"""The numbered queries over whole small tables: against their SQL, the tokenizers library, or readers and rules written for the tests alone."""

import hashlib
import os
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import common, decontamination, media_ts, neardup, packing, queries, sharding, token_counts, token_files, warc_zip
from evidentia.llm.words import encoder

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("select doc_id, text from documents").fetchall())


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


def test_op1_equals_the_library(spark, texts):
    tok, at = Tokenizer.from_file(BYTES), 0
    got = {r["doc_id"]: r for r in queries.op1_token_files(spark, SF).collect()}
    assert len(got) == len(texts)
    for d in sorted(texts):
        ids = tok.encode(texts[d] or "", add_special_tokens=False).ids + [2]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_op2_equals_the_library_and_has_no_gaps(spark, texts):
    tok, seen, places = Tokenizer.from_file(WORDS), defaultdict(int), defaultdict(list)
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids + [2] for d, t in texts.items()}
    for r in queries.op2_packing(spark, SF).collect():
        a, n = r["start"], r["length"]
        assert r["ids_crc32"] == crc(ids[r["doc_id"]][a : a + n]) and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]] += n
        places[r["sequence_id"]].append((r["offset"], n))
    assert seen == {d: len(i) for d, i in ids.items()}
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == np.r_[0, np.cumsum([n for _, n in held])][:-1].tolist() and sum(n for _, n in held) <= 4096
    assert len(places) * 4096 <= 1.05 * sum(seen.values()) + 4096


def test_op4_keeps_its_fold_and_tells_toxic_documents(spark, duck):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, sf).collect()}
    truth = dict(duckdb.execute(f"select doc_id, toxic from '{sf}/labels.parquet' where toxic is not null").fetchall())
    assert len(got) == duckdb.execute(f"select count(*) from '{sf}/documents.parquet'").fetchone()[0]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for d, r in got.items())
    held = [d for d in truth if got[d]["held_out"]]
    toxic, clean = [d for d in held if truth[d]], [d for d in held if not truth[d]]
    assert sum(got[d]["predicted"] for d in toxic) >= 0.7 * len(toxic) and sum(got[d]["predicted"] for d in clean) <= 0.05 * len(clean)


def plain_ts_reader(media: bytes, pid: int) -> tuple[bytes, list[int], int]:
    """Payload, time stamps and random-access packets of one PID, by the layout of packets and PES headers alone."""
    assert len(media) % 188 == 0
    parts, keys, last = [], 0, None
    for at in range(0, len(media), 188):
        head = struct.unpack(">I", media[at : at + 4])[0]
        assert head >> 24 == 0x47
        if (head >> 8) & 0x1FFF != pid:
            continue
        counter, control, begin = head & 15, (head >> 4) & 3, (head >> 22) & 1
        assert last is None or counter == (last + 1) % 16
        last, skip = counter, 4
        if control & 2:
            skip += 1 + media[at + 4]
            keys += bool(media[at + 4] and media[at + 5] & 0x40)
        if begin:
            parts.append(b"")
        parts[-1] += media[at + skip : at + 188]
    out, stamps = [], []
    for pes in parts:
        assert pes[:3] == b"\0\0\1" and struct.unpack(">H", pes[4:6])[0] == len(pes) - 6
        t = pes[9:14]
        stamps.append(((t[0] & 14) << 29) | (t[1] << 22) | ((t[2] & 254) << 14) | (t[3] << 7) | (t[4] >> 1))
        out.append(pes[9 + pes[8] :])
    return b"".join(out), stamps, keys


def test_op7_digests_what_an_own_reader_finds(spark, texts):
    got = {r["doc_id"]: r for r in queries.op7_media_ts(spark, SF).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        data = (t or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        media = media_ts.multiplex(padded)
        payload, stamps, keys = plain_ts_reader(media, media_ts.DATA_PID)
        assert payload == padded
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        fields = dict(f.split("=", 1) for f in r["feature"].split(";") if "=" in f)
        assert int(fields["packets"]) == len(media) // 188 and int(fields["units"]) == len(stamps) and fields["pts"] == f"{min(stamps)}-{max(stamps)}" and len(fields["keys"].split(",")) == keys and r["feature"].endswith("whole")


def test_op9_equals_the_library(spark, texts):
    tok = Tokenizer.from_file(BYTES)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op9_token_counts(spark, SF).collect()}
    want = {d: len(tok.encode(t or "", add_special_tokens=False).ids) for d, t in texts.items()}
    assert got == {d: (len((t or "").encode()), want[d], want[d] > 512) for d, t in texts.items()}


def test_op6_splits_to_several_depths(spark):
    found = queries.op6_sharding(spark, "/root/testdata/sf0.01").select("depth").distinct().collect()
    assert len(found) > 1 and max(r["depth"] for r in found) > 2


# ------------------------------------------------------------- words made to collide
def thue_morse(n: int) -> tuple[str, str]:
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_a_pattern_are_told_apart(spark, n):
    one, two = thue_morse(n)
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{one} {two} {one}"), (4, f"{two} {one} {two}")], "doc_id long, text string")
    for path in (BYTES, WORDS):
        tok = Tokenizer.from_file(path)
        assert [x.tolist() for x in encoder(path).ids([one, two])] == [tok.encode(t, add_special_tokens=False).ids for t in (one, two)]
    tok = Tokenizer.from_file(BYTES)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {d: len(tok.encode(t, add_special_tokens=False).ids) for d, t in rows.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, BYTES).collect()} == want
    got = token_files.read_token_table(spark, token_files.write_token_table(docs, BYTES)).collect()
    assert {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in got} == {d: tok.encode(t, add_special_tokens=False).ids for d, t in rows.items()}
    pieces = packing.pieces(docs, WORDS, 1 << 20).collect()
    assert {r["doc_id"]: r["length"] for r in pieces} == {d: len(Tokenizer.from_file(WORDS).encode(t, add_special_tokens=False).ids) for d, t in rows.items()}
    assert all(r["kept"] for r in neardup.near_duplicates(docs, 3, 85).collect())


def test_rare_scripts_are_counted_by_their_pre_tokens(spark):
    some = ["Привет, мир! Привет", "日本語 のテキスト 日本語", "a b x² ½", "<|endoftext|> Привет", "🙂🙂 ok"]
    docs = spark.createDataFrame(list(enumerate(some * 3)), "doc_id long, text string")
    tok = Tokenizer.from_file(BYTES)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, BYTES).collect()} == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(some * 3)}
    assert [encoder(BYTES).split(t) is None for t in some] == [False, False, False, True, False]


# ------------------------------------------------------------- volume
def test_equal_and_null_ids_are_spread_over_groups(spark):
    rows = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), (F.col("id") % 900 + 1).alias("length"))
    out = packing.pack(rows, 1000, group=5000).withColumn("g", F.shiftright("sequence_id", 32)).groupBy("g").agg(F.count("*").alias("n"), F.sum("length").alias("sum"))
    sizes = [r["n"] for r in out.collect()]
    assert sum(sizes) == 50_000 and len(sizes) == 10 and max(sizes) < 2 * min(sizes)
    whole = packing.pack(rows.withColumn("length", F.lit(1000).cast("long")), 1000)
    assert whole.where("offset = 0 and sequence_id < 0").select("sequence_id").distinct().count() == 50_000


def test_wide_buckets_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(260):
        t = list(base)
        for i in rng.choice(120, rng.integers(0, 22), replace=False):
            t[i] = f"x{rng.integers(0, 10**9)}"
        texts.append(" ".join(t))
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in words]
    top = list(range(len(texts)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for group in (1 << 19, 900):
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 3, 85, 8, group=group).collect()}
        assert got == {i: root(i) for i in range(len(texts))}


def test_an_automaton_of_many_items_stays_small():
    import subprocess
    import sys

    code = """
import random, resource
from evidentia.llm.decontamination import Automaton
rng = random.Random(1)
words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(20000)]
items = [(str(i), " ".join(rng.choice(words) for _ in range(60))) for i in range(5600)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
Automaton(items, 13)
print(sum(len(t) for _, t in items), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    size, used = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": os.getcwd()}).stdout.split())
    assert size > 1_900_000 and used < 200  # two million bytes of items: half of what a pass holds


def test_many_items_go_in_several_passes(spark):
    rng = np.random.default_rng(2)
    words = [f"v{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choice(words, 40))) for i in range(60)]
    docs = [(i, "a b " + " ".join(items[i][1].split()[5:30]) + " c") for i in range(60)] + [(99, "nothing of that kind"), (100, None)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    one = rows_of(decontamination.contamination(frame(docs, "doc_id"), frame(items, "item_id")))
    many = rows_of(decontamination.contamination(frame(docs, "doc_id"), frame(items, "item_id"), max_bytes=1500))
    assert one == many and sum(r[0] is True for r in one) == 60


# ------------------------------------------------------------- files
def test_archive_files_are_read_by_ranges(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", bytearray(b"%d " % (i % 7) * 400)) for i in range(60)], "page_id long, url string, payload binary").repartition(3)
    archives = warc_zip.write_archives(warc_zip.with_revisits(pages), f"file://{tmp_path}/made", 4000)
    assert archives.count() > 3
    fields = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "error")
    by_file = rows_of(warc_zip.records_of(archives).select(*fields))
    cells = spark.read.format("binaryFile").load(f"{tmp_path}/made").select(F.col("path").alias("archive"), "content")
    assert by_file == rows_of(warc_zip.records(cells).select(*fields)) and len(by_file) == 60 and {r[0] for r in by_file} == {None}
    bad = tmp_path / "bad.wacz"
    bad.write_bytes(b"PK junk")
    odd = spark.createDataFrame([(str(bad),), (f"file://{tmp_path}/none.wacz",), (None,)], "archive string")
    assert [r["error"] is not None for r in warc_zip.records_of(odd).collect()] == [True] * 3
    name = archives.first()["archive"].removeprefix("file://")
    asked = []

    class Counting(warc_zip.Ranges):
        def __call__(self, offset, length):
            asked.append(length)
            return super().__call__(offset, length)

    read = Counting(name)
    places = list(warc_zip.record_places(read, read.size))
    asked.clear()
    assert warc_zip.read_record(read, *places[0])["payload_bytes"] is not None and asked == [places[0][1]]


def test_shards_are_written_by_folder(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    sharding.write_shards(docs, "doc_id", "text", 5000, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {r["shard"][:1] for r in back.collect()} == {"b"} and back.count() == 400 and back.groupBy("shard", "page").agg(F.sum("n_bytes").alias("n")).where("n > 5000").count() == 0


def test_documents_that_only_share_a_template_ask_for_nothing(spark):
    """The second look at unlinked documents of one bucket grows with them, not with their square, and finds what is similar."""
    made = []
    for n in (300, 600, 1200):
        rng = np.random.default_rng(n)
        words = lambda k: [f"x{rng.integers(0, 10**12)}" for _ in range(k)]
        template = [f"w{i}" for i in range(80)]
        texts = [" ".join(template + words(20)) for _ in range(n)]  # 0.66 alike
        for _ in range(n // 20):  # families of five, 0.9 alike
            own = words(20)
            texts += [" ".join(template + own + words(3)) for _ in range(5)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(4)
        sets, _ = common.written(neardup.token_sets(docs, 3))
        rows = []

        def saved(df, name, rows=rows):
            out, _ = common.written(df, name)
            rows.append((name, out.count()))
            return out

        pairs, rest = neardup.finer(sets, docs.select("doc", F.col("doc").alias("component")), 85, saved)
        found = {(r["centre"], r["doc"]) for r in pairs.collect()}
        assert found == {(a, b) for f in range(n, len(texts), 5) for a in range(f, f + 5) for b in range(a + 1, f + 5)} and rest.count() == 0
        made.append(sum(c for name, c in rows if name in ("keys", "few", "hot")))
    assert made[1] < 2.2 * made[0] and made[2] < 2.2 * made[1]


def test_op6_and_its_sql_agree_on_rows_over_the_limit(spark, tmp_path):
    """One row over the limit, repeated and null ids: as many rows, and few rounds."""
    rows = [(i, "x" * 9000) for i in range(60)] + [(None, None), (None, "ab"), (3, "y" * 400), (3, "y" * 400), (7, None), (77, "z" * (queries.SHARD_LIMIT + 1))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.OP6_SQL)
    names = [d[0] for d in want.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    got = queries.op6_sharding(spark, str(tmp_path))
    assert rows_of(got) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)
    assert got.where("shard_bytes > 131072").count() == 1
    places, path = common.written(spark.createDataFrame([(1, 500), (1 << 58, 10)], "place long, size long"))
    found, made = sharding.directory(places, 100)
    assert len(made) == 2 and sorted(map(tuple, found.collect())) == [(1, 60, 500), (1 << 58, 2, 10)]


def test_items_that_touch_give_one_span_in_one_pass_or_many(spark):
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    items = spark.createDataFrame([("a", words(0, 15)), ("b", words(15, 30)), ("c", words(40, 53))], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x " + words(0, 30) + ". y " + words(40, 53)), (2, words(0, 12)), (3, None)], "doc_id long, text string")
    found = [sorted((r.doc_id, r.n_hit, [(s["first"], s["last"]) for s in r.hit_bytes], r["items"]) for r in decontamination.contamination(docs, items, max_bytes=n).collect()) for n in (1 << 20, 60)]
    assert found[0] == found[1] and len(found[0][0][2]) == 2 and found[0][0][1] == 43 and found[0][1][2] == []


def test_a_block_costs_the_same_however_many_items_share_it():
    import time

    stem = " ".join(f"s{i}" for i in range(13))
    took = []
    for n in (80, 8000):
        machine = decontamination.Automaton([(str(i), f"{stem} t{i}") for i in range(n)], 13)
        text = np.frombuffer(" ".join(f"{stem} u{i}" for i in range(300)).encode(), np.uint8)
        best = []
        for _ in range(3):
            t = time.perf_counter()
            _, _, hit, items = machine.scan(text)
            best.append(time.perf_counter() - t)
        assert hit.sum() == 300 * 13 and len(items) == n
        took.append(min(best))
    assert took[1] < 5 * took[0] + 0.05
    same = decontamination.Automaton([("x", "a " * 20_000)], 13)
    t = time.perf_counter()
    _, _, hit, items = same.scan(np.frombuffer(b"a " * 4000, np.uint8))
    assert hit.all() and items == {"x"} and time.perf_counter() - t < 1


def test_each_pre_token_is_counted_once(spark, tmp_path):
    """Many lists, few buckets: what the model is asked for are the distinct pre-tokens."""
    from evidentia.llm import words

    docs = spark.createDataFrame([(i, f"alpha beta{i % 40} gamma {i}") for i in range(400)], "doc_id long, text string").repartition(4)
    blocks, _ = common.written(token_counts.frequency_blocks(docs, BYTES, 200, 2))
    lists = blocks.select("block", F.inline("lists"))
    every = [p for r in lists.collect() for p in zlib.decompress(r["pieces"]).decode().split("\0")]
    asked, real = [], words.Encoder.piece_ids
    enc = encoder(BYTES)
    try:
        words.Encoder.piece_ids = lambda self, pieces: asked.extend(pieces) or real(self, pieces)
        rows = lists.orderBy("bucket").toArrow().to_batches(max_chunksize=7)
        grabbed = {}

        class Caught:
            def repartition(self, *_):
                return self

            sortWithinPartitions = repartition

            def mapInArrow(self, f, schema):
                grabbed["run"] = f

        token_counts.piece_counts(Caught(), BYTES)
        assert sum(b.num_rows for b in grabbed["run"](iter(rows))) == lists.count()
    finally:
        words.Encoder.piece_ids = real
    assert len(every) > 2 * len(set(every)) and sorted(asked) == sorted(set(every)) and enc is encoder(BYTES)
