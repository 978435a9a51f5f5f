"""The training-data operators against brute force, with nulls, ties, repeats, long texts and empty tables."""

import base64
import gzip
import hashlib
import io
import itertools
import random
import re
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import decontamination, media_ts, neardup, packing, sharding, token_counts, token_files, toxicity, url_rules, warc_zip
from evidentia.llm.words import encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [None, "", "a", "  two  words\n", "it's we'll <|endoftext|> x² ½", "中文 שלום \U0001F600", "Straße ñandú 123 — “quoted”", "word " * 5000, "same", "same", "'s 's ''s x'd", "\0odd\x1c"]


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, None, "s", 1) for i, t in enumerate(texts)], DOC).repartition(3)


def library_ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ------------------------------------------------------------- tokenizers
@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library(path):
    rng = random.Random(3)
    letters = "ab'sSrelvtmd 1_-.,\n\tÀß€“\u00a0"
    texts = [*TEXTS, *("".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(2000))]
    tok = Tokenizer.from_file(path)
    want = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in encoder(path).ids(texts)] == want


def test_code_lengths_are_least_under_the_limit():
    rng = np.random.default_rng(1)
    for _ in range(30):
        w = rng.integers(1, 60, 5)
        best = min(sum(a * b for a, b in zip(w, l)) for l in itertools.product(range(1, 4), repeat=5) if sum(2.0**-x for x in l) <= 1)
        assert (token_files.code_lengths(w, 3) * w).sum() == best
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(9, int), 3)
    assert token_files.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 256, 1000])
def test_bits_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n).clip(1, 4999)
    lengths = token_files.code_lengths(np.bincount(np.r_[ids, 1, 2], minlength=5000))
    bits, marks = token_files.pack_bits(ids, token_files.canonical(lengths), lengths.astype(np.int64))
    assert token_files.unpack_bits(bits, marks, n, token_files.decoding_table(lengths)).tolist() == ids.tolist()


def test_token_files_hold_all_documents_in_order(spark):
    rows = [(5, "b b"), (None, "none"), (1, None), (5, "a"), (7, ""), *[(i, t) for i, t in enumerate(TEXTS, 10)]]
    docs = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, shard int").repartition(4)
    path = token_files.write_token_table(docs, BYTES, 2)
    got = token_files.read_token_table(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    by_id = dict(rows)
    for r in got:
        if r["doc_id"] != 5:
            assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library_ids(BYTES, by_id[r["doc_id"]]) + [2]


def test_token_files_of_an_empty_table(spark):
    path = token_files.write_token_table(docs_of(spark, []), BYTES, 2)
    assert token_files.read_token_table(spark, path).count() == 0


# ------------------------------------------------------------- packing
def brute_first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        k = next((i for i, r in enumerate(room) if r >= s), len(room))
        room += [capacity] if k == len(room) else []
        out.append((k, capacity - room[k]))
        room[k] -= s
    return out


def test_tournament_tree_is_first_fit():
    rng = np.random.default_rng(2)
    for n in [1, 2, 3, 17, 200]:
        sizes = np.sort(rng.integers(1, 101, n))[::-1]
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        assert list(zip(bins.tolist(), offsets.tolist())) == brute_first_fit(sizes.tolist(), 100)


def test_packing_places_every_id_once(spark):
    texts = [*TEXTS, *["w " * n for n in range(1, 60)]]
    out = packing.pack_documents(docs_of(spark, texts), WORDS, 32, 2, group=20).collect()
    want = {i: library_ids(WORDS, t) + [2] for i, t in enumerate(texts)}
    seen = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(seen.setdefault(r["doc_id"], [])) and r["doc_tokens"] == len(want[r["doc_id"]])
        seen[r["doc_id"]] += np.frombuffer(bytes(r["ids"]), "<u4").tolist()
    assert seen == want
    for _, rows in itertools.groupby(sorted(out, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in rows:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 32
    empty = docs_of(spark, [])
    assert packing.pack_documents(empty, WORDS, 32, 2).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (3, None), (3, None)], "doc_id long, text string")
    assert packing.pack_documents(odd, WORDS, 32, 2).count() == 3


# ------------------------------------------------------------- decontamination
def brute_contamination(text, items, size):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    words = lambda s: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(s))
    w = words(text)
    hit, found = [False] * len(w), set()
    for name, item in items:
        v = words(item)
        for q in [v[i : i + size] for i in range(max(1, len(v) - size + 1))] if v else []:
            for i in range(len(w) - len(q) + 1):
                if w[i : i + len(q)] == q:
                    hit[i : i + len(q)] = [True] * len(q)
                    found |= set() if name is None else {str(name)}
    return len(w), sum(hit), sorted(found), sum(hit) > 0 and 20 * sum(hit) >= len(w)


@pytest.mark.parametrize("max_bytes", [1 << 20, 12])
def test_contamination_equals_brute_force(spark, max_bytes):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ab AB.é1") for _ in range(n))
    items = [(1, "a b"), (2, None), (None, "b b a"), (2, "B é"), (10, ""), *[(i, text(9)) for i in range(20, 26)]]
    texts = [None, "", "A, b! a", *[text(rng.randrange(60)) for _ in range(40)]]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("x", "y")
    got = {r["doc_id"]: r for r in decontamination.contamination(docs_of(spark, texts), bench, 2, max_bytes, ("doc_id", "text", "source")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_hit"], sorted(r["items"]), r["contaminated"]) == brute_contamination(t, items, 2), t
        for s in r["hit_bytes"]:
            piece = (t or "").encode()[s["first"] : s["last"]]
            assert piece and not chr(piece[0]).isspace()


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs_of(spark, []), none).count() == 0
    assert [r["contaminated"] for r in decontamination.contamination(docs_of(spark, ["a"]), none).collect()] == [False]


# ------------------------------------------------------------- toxicity
def toxic_corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        if i % 4 == 0:
            for _ in range(rng.randrange(2, 6)):
                t[rng.randrange(len(t))] = rng.choice(["zgrompf", "quaxxle", "vizzbok"])
        texts.append(" ".join(t))
        labels.append(int(i % 4 == 0))
    return texts, np.array(labels)


def test_toxicity_on_held_out_and_misspelt_words():
    texts, labels = toxic_corpus(400, 1)
    model = toxicity.fit(texts, labels)
    more, truth = toxic_corpus(200, 2)
    predicted = model.scores(more) >= 0.7
    assert (predicted == truth.astype(bool)).mean() >= 0.97
    assert model.scores(["lane tore zgrommpf sail tone quaxle"])[0] > model.scores(["lane tore rail sail tone"])[0]
    assert ((0 <= model.scores([None, "", "x", "…"])) & (model.scores([None, "", "x", "…"]) < 0.7)).all()


def test_toxicity_learns_only_from_its_folds(spark):
    texts, labels = toxic_corpus(60, 3)
    docs = docs_of(spark, texts)
    flags = spark.createDataFrame([(i, int(t)) for i, t in enumerate(labels)] + [(None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    got, truth = toxicity.training_sample(docs, flags)
    allowed = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(got) == sorted(texts[i] for i in allowed) and truth.sum() == labels[allowed].sum()
    assert sorted(toxicity.training_sample(docs, flags, sample=3)[1]) == [0, 0, 0, 1, 1, 1]  # an id without a document holds no place
    model = toxicity.fit(got, truth)
    rows = toxicity.toxicity(docs_of(spark, [*texts, None, ""]), model, ("doc_id", "lang")).collect()
    assert len(rows) == 62 and all(0 <= r["score"] <= 1 for r in rows)
    with pytest.warns(RuntimeWarning):
        one_class = toxicity.fit(["a b", "c"], np.zeros(2))
    assert toxicity.toxicity(docs, one_class).where("score > 0.01").count() == 0
    assert toxicity.toxicity(docs_of(spark, []), model).count() == 0


# ------------------------------------------------------------- near-duplicates
def brute_components(rows, size, percent):
    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = {d: shingles(t) for d, t in rows}
    top = {d: d for d in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def near_copies(rng, groups, copies, words):
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(*words))]
        for _ in range(rng.randrange(*copies)):
            t = list(base)
            for _ in range(rng.randrange(0, max(2, len(t) // 25))):
                t[rng.randrange(len(t))] = f"x{rng.randrange(9999)}"
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("chunk", [48, 3])
def test_near_duplicates_equal_brute_force(spark, chunk):
    rng = random.Random(7)
    texts = [None, "", "one", "One", "one two", "a b c", "a b c", *near_copies(rng, 25, (1, 6), (5, 90)), *near_copies(rng, 1, (40, 41), (120, 121))]
    rng.shuffle(texts)
    want = brute_components(list(enumerate(texts)), 3, 85)
    got = neardup.near_duplicates(docs_of(spark, texts), 3, 85, chunk).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "e f g h"), (9, "e f g h"), (2, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (2, 2), (4, 4), (4, 4), (9, 4)]
    assert neardup.near_duplicates(docs_of(spark, []), 3, 85).count() == 0


def test_densified_bins_estimate_similarity():
    rng = np.random.default_rng(4)
    for n in [1, 3, 20, 500]:
        found = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        value = neardup.one_permutation(found)
        assert np.isin(value, found).all() and len(value) == neardup.BINS


# ------------------------------------------------------------- sharding
def test_shards_fit_and_split_only_large_buckets(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(200)) for i in range(300)] + [(None, None), (None, "ab"), (7, "y" * 5000)]
    got = sharding.sharded(spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, cell int"), "doc_id", "text", 2000).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        place = int(hashlib.md5(str(r["doc_id"] if r["doc_id"] is not None else "").encode()).hexdigest()[:15], 16)
        assert format(place, "060b").startswith(r["shard"]) and len(r["shard"]) == r["depth"]
        sizes.setdefault(r["shard"], []).append(r)
    total = lambda p: sum(r["n_bytes"] for r in got if format(r["place"], "060b").startswith(p))
    for shard, held in sizes.items():
        assert all(r["shard_bytes"] == sum(x["n_bytes"] for x in held) for r in held)
        assert total(shard) <= 2000 or len(shard) == 60
        assert not shard or total(shard[:-1]) > 2000
    assert not any(a != b and b.startswith(a) for a in sizes for b in sizes)


def test_copies_of_one_key_fill_pages(spark):
    rows = [(1, "z" * (i % 7)) for i in range(500)] + [(1, "q" * 90), (1, "q" * 150)]
    got = sharding.sharded(spark.createDataFrame(rows, "k long, text string").repartition(5), "k", "text", 100).collect()
    assert len(got) == len(rows) and {r["depth"] for r in got} == {60}
    pages = {}
    for r in got:
        pages.setdefault(r["page"], []).append(r["n_bytes"])
    assert all(sum(p) <= 100 or len(p) == 1 for p in pages.values()) and len(pages) > 15
    assert sharding.sharded(spark.createDataFrame([], "k long, text string"), "k", "text", 100).count() == 0


# ------------------------------------------------------------- transport streams
@pytest.mark.parametrize("n", [0, 1, 64, 155, 156, 157, 162, 163, 340, 8192, 8193, 70_000])
def test_transport_stream_round_trip(n):
    data = random.Random(n).randbytes(n)
    media = media_ts.multiplex(data)
    s = media_ts.demultiplex(media)
    assert len(media) % 188 == 0 and s.payload(media_ts.DATA_PID) == data
    assert (s.lost_sync, s.bad_crc, s.gaps, s.truncated) == (0, 0, 0, 0) and s.types == {media_ts.DATA_PID: 6} and s.programs == {1: media_ts.PMT_PID}
    keys = [u for u in s.units if u.random_access]
    assert len(s.units) == max(1, -(-n // media_ts.UNIT)) and len(keys) == -(-len(s.units) // media_ts.KEY_EVERY)
    assert [u.pts for u in s.units] == [90_000 + 3600 * i for i in range(len(s.units))]
    for u in keys:  # a decoder can start at the tables before a random-access point
        tail = media_ts.demultiplex(media[(u.packet - 2) * 188 :])
        assert tail.units[0].pts == u.pts and tail.gaps == 0


def test_damaged_transport_streams_are_counted():
    media = media_ts.multiplex(random.Random(1).randbytes(40_000))
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    assert media_ts.demultiplex(b"".join(packets[:10] + [packets[9]] + packets[10:])).gaps == 0  # sent twice
    lost = media_ts.demultiplex(b"".join(packets[:10] + packets[11:]))
    assert lost.gaps == 1 and lost.truncated == 1 and len(lost.units) == 4
    bad = bytearray(media)
    bad[9] ^= 1
    assert media_ts.demultiplex(bytes(bad)).bad_crc == 1
    bad = bytearray(media)
    bad[188 * 5] = 0
    assert media_ts.demultiplex(bytes(bad)).lost_sync == 1
    for cut in (0, 1, 100, 187, 189, 1000):
        media_ts.demultiplex(media[:cut])
    rng = random.Random(2)
    for _ in range(200):
        bad = bytearray(media[: 188 * 30])
        for _ in range(20):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        media_ts.demultiplex(bytes(bad))


def test_media_columns(spark):
    df = spark.createDataFrame([(1, b"abc"), (2, None), (None, b""), (1, b"abc")], "doc_id long, payload binary")
    media = media_ts.multiplexed(df)
    rows = media_ts.parsed(media).withColumn("feature", media_ts.feature()).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["payload"]), r["status"]) for r in rows) == [(0, b"", "whole"), (1, b"abc", "whole"), (1, b"abc", "whole"), (2, b"", "whole")]
    odd = spark.createDataFrame([(1, None), (2, b"junk" * 100)], "doc_id long, media binary")
    assert {r["doc_id"]: r["status"] for r in media_ts.parsed(odd).collect()} == {1: "null", 2: "damaged"}
    assert media_ts.parsed(media.limit(0)).count() == 0


# ------------------------------------------------------------- archives
def test_archives_round_trip(spark):
    rows = [(3, "http://a/x y", "same"), (1, "http://b\r\n", "same"), (2, None, None), (None, "u", "same"), (5, "v", ""), (9, "z", "long " * 9999), (9, "z", "long " * 9999)]
    pages = spark.createDataFrame([(a, b, bytearray((c).encode()) if c is not None else None, 1) for a, b, c in rows], "page_id long, url string, payload binary, archive int")
    got = warc_zip.records(warc_zip.archived(warc_zip.with_revisits(pages), 64)).collect()
    want = []
    for a, _, c in rows:
        data = (c or "").encode()
        same = [x for x, _, y in rows if (y or "").encode() == data and x is not None]
        refers = None if not same or a == min(same) or len([1 for _, _, y in rows if (y or "").encode() == data]) < 2 else min(same)
        want.append((a or 0, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted(want, key=lambda x: x[:4])
    assert all(r["error"] is None for r in got)
    assert warc_zip.records(warc_zip.archived(warc_zip.with_revisits(pages.limit(0)))).count() == 0


def test_urls_with_braces_lose_no_record(spark):
    urls = ["http://a/{x}", "{", "http://b/ {y} {", "http://c/"]
    pages = spark.createDataFrame([(i, u, bytearray(b"%d" % i)) for i, u in enumerate(urls)], "page_id long, url string, payload binary")
    got = warc_zip.records(warc_zip.archived(warc_zip.with_revisits(pages).coalesce(1))).collect()
    assert sorted((r["page_id"], r["url"], bytes(r["payload"])) for r in got if r["error"] is None) == [(i, u, b"%d" % i) for i, u in enumerate(urls)] and len(got) == 4


def test_a_bad_index_line_costs_one_record():
    data = gzip.compress(warc_zip.record(4, "http://h/", b"body", None))
    good = f'{{"offset": "0", "length": "{len(data)}", "filename": "d.warc.gz"}}'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("archive/d.warc.gz"), data)
        z.writestr("indexes/index.cdxj", "\n".join([f"h)/{{x}} 2024 {good}", "h)/ 2024 {broken", 'h)/ 2024 {"offset": null, "length": 1, "filename": "d.warc.gz"}', good, f"h)/ {good}"]))
    content = out.getvalue()
    rows = list(warc_zip.read_archive(lambda at, n: content[at : at + n], len(content)))
    assert [r.get("payload") for r in rows] == [b"body", None, None, b"body", b"body"] and ["error" in r for r in rows] == [False, True, True, False, False]


@pytest.mark.parametrize("zip64", [False, True])
def test_own_directory_reader_agrees_with_zipfile(zip64):
    content = warc_zip.archive([(i, f"http://h/{i}", b"x" * i, None) for i in range(20)], zip64)
    asked = []

    def read(at, n):
        asked.append((at, n))
        return content[at : at + n]

    members = warc_zip.directory(read, len(content))
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in z.infolist():
            assert members[info.filename][1:3] == (info.compress_size, info.file_size)
            assert warc_zip.member(read, members[info.filename]) == z.read(info)
    asked.clear()
    found = list(warc_zip.read_archive(read, len(content)))
    assert sorted(r["page_id"] for r in found) == list(range(20)) and [r for r in found if r.get("error")] == []
    inside = [n for at, n in asked if members[warc_zip.RECORDS][3] < at < members[warc_zip.INDEX][3]]
    assert max(inside) < members[warc_zip.RECORDS][1]  # records are read by range, the member never as a whole


def test_zip64_end_record_and_foreign_archives():
    data = gzip.compress(warc_zip.record(4, "http://h/", b"body", None))
    line = f'h)/ 2024 {{"offset": "0", "length": "{len(data)}", "filename": "d.warc.gz"}}'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("archive/d.warc.gz"), data)
        z.writestr("indexes/index.cdx.gz", gzip.compress(line.encode()))
        for i in range(70_000 // 1000):
            z.writestr(f"pages/{i}", b"")
        z.comment = b"PK\5\6 in a comment"
    content = out.getvalue()
    read = lambda c: list(warc_zip.read_archive(lambda at, n: c[at : at + n], len(c)))
    assert [(r["page_id"], r["payload"]) for r in read(content)] == [(4, b"body")]
    big = io.BytesIO()
    with zipfile.ZipFile(big, "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"{i}"), b"")
        z.writestr(zipfile.ZipInfo("archive/d.warc.gz"), data)
        z.writestr(zipfile.ZipInfo("indexes/i.cdxj"), line.encode())
    assert [(r["page_id"], r["payload"]) for r in read(big.getvalue())] == [(4, b"body")]


def test_damaged_archives_give_errors(spark):
    content = warc_zip.archive([(1, "u", b"abc" * 50, None)])
    rng = random.Random(3)
    broken = [b"", content[:30], content[:-30], None]
    for _ in range(60):
        b = bytearray(content)
        for _ in range(4):
            b[rng.randrange(len(b))] = rng.randrange(256)
        broken.append(bytes(b))
    rows = warc_zip.records(spark.createDataFrame([(str(i), b) for i, b in enumerate(broken)], "archive string, content binary")).collect()
    assert {r["archive"] for r in rows if r["error"]} >= {"0", "1", "2", "3"}


# ------------------------------------------------------------- token counts
def test_token_counts_equal_the_library(spark):
    texts = [*TEXTS, "same words same words", "12 12 12"]
    for block in (1, 1 << 20):
        got = token_counts.token_counts(docs_of(spark, texts), BYTES, block).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == {i: (len((t or "").encode()), len(library_ids(BYTES, t))) for i, t in enumerate(texts)}
    odd = spark.createDataFrame([(None, "a b"), (2**60 + 1, "c"), (2**60 + 1, "c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.token_counts(odd, BYTES).collect()) == [(0, 2), (2**60 + 1, 1), (2**60 + 1, 1)]
    assert token_counts.token_counts(docs_of(spark, []), BYTES).count() == 0


# ------------------------------------------------------------- URL rules
def brute_rule(url, rules, default):
    rest = (url or "").partition("://")[2] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[2:] if fit else (None, default))


@pytest.mark.parametrize("salts", [1, 5])
def test_url_rules_equal_brute_force(spark, salts):
    rng = random.Random(9)
    hosts, parts = ["a", "b.a", "c.b.a", "xb.a", "A.B.a", "", "a.", "q.c.b.a"], ["", "/", "/x", "/x/", "/x/y", "/xy", "/é", "/\uffff"]
    rules = sorted({(rng.choice(["a", "b.a", "c.b.a"]), rng.choice(parts)) for _ in range(14)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules] + [(None, "/", "block"), ("z", None, "allow")]
    urls = [None, "", "no-scheme", "http://", "x://a?q#f", "://B.a/x://y"] + [f"http://{rng.choice(hosts)}{rng.choice(parts)}{rng.choice(['', 'z', '?q=/x', '#/x', '/x'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i % 150, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judged(pages, table, "allow", salts).collect()), key=str)
    assert got == sorted(((i % 150, *brute_rule(u, rules, "allow")) for i, u in enumerate(urls)), key=str)
    none = spark.createDataFrame([], table.schema)
    assert {r["verdict"] for r in url_rules.judged(pages, none, "block").collect()} == {"block"}
    assert url_rules.judged(pages.limit(0), table).count() == 0


# ------------------------------------------------------------- clashing names
def test_columns_with_clashing_names(spark):
    names = "n_words n_hit hit_words hit_bytes items contaminated score media payload status units page shard depth place n_bytes shard_bytes sequence_id offset _group start ids n_tokens kept component_id block archive rule verdict host path".split()
    clash = spark.createDataFrame([(1, "a b c", *["x"] * len(names)), (2, None, *[None] * len(names))], ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]]))
    every = tuple(clash.columns)
    bench = spark.createDataFrame([(1, "a b", "y")], "item_id long, text string, items string")
    assert decontamination.contamination(clash, bench, 2, keep=every).where("items_in = 'x' and contaminated").count() == 1
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0)
    assert toxicity.toxicity(clash, model, every).where("score_in is null").count() == 1
    assert sharding.sharded(clash, "page", "text", 100).where("page_in = 'x' and n_bytes = 5").count() == 1
    bytes_ = clash.withColumn("payload", F.col("text").cast("binary"))
    media = media_ts.multiplexed(bytes_, "payload", every)
    assert media_ts.parsed(media, "media", ("doc_id", "status", "units", "media_in", "media")).where("status = 'whole'").count() == 2
    rows = clash.drop("start", "ids").select("*", F.lit(0).alias("start"), F.lit(3).alias("length"))
    assert packing.pack(rows, 4, 1).where("sequence_id_in = 'x' and offset = 0").count() == 1
    assert neardup.near_duplicates(clash, 3, 85).count() == token_counts.token_counts(clash, BYTES).count() == 2
    assert token_files.read_token_table(spark, token_files.write_token_table(clash, BYTES, 2)).count() == packing.pieces(clash, WORDS, 9, 2).count() == 2
    pages = clash.withColumnsRenamed({"doc_id": "page_id", "text": "url"}).withColumn("payload", F.lit(b"p"))
    assert url_rules.judged(pages, spark.createDataFrame([("a", "/", "block")], "host string, path string, verdict string")).count() == 2
    assert warc_zip.records(warc_zip.archived(warc_zip.with_revisits(pages))).count() == 2
