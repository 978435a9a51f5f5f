"""Removal of repeated strings against plain counting of all strings."""

import hashlib
import os
import random

import pytest

from evidentia.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def plain(rows):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49 if d is not None else 0):
            least[b[i : i + 50]] = min(d, least.get(b[i : i + 50], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49 if d is not None else 0):
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = []
        for i, x in enumerate(gone):
            if x and i and gone[i - 1]:
                spans[-1][1] = i + 1
            elif x:
                spans.append([i, i + 1])
        out.append((d, len(b), sum(gone), spans, bytes(c for c, x in zip(b, gone) if not x)))
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string").repartition(3)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, [[s.begin, s.end] for s in r.spans], bytes(r.kept)) for r in suffix_dedup.without_repeats(df, **options).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rnd.randint(10, 40))) for _ in range(8)]
    out = [(rnd.randint(0, 90), " ".join(rnd.choice(passages)[rnd.randint(0, 30) :] if rnd.random() < 0.3 else word() for _ in range(rnd.randint(0, 60)))) for _ in range(120)]
    return out + [(7, "a" * 300), (9, "a" * 120), (11, "ab" * 200), (12, None), (13, ""), (None, "a" * 200), (14, "a" * 49), (3, "b" + "a" * 50), (3, "b" + "a" * 50), (15, "ab" * 200)]


def test_equals_plain_counting(spark, rows):
    want = plain(rows)
    assert sum(r[2] for r in want) > 10_000
    assert found(spark, rows) == want
    assert found(spark, rows, bucket=500) == want  # many buckets


def test_a_line_in_many_contexts_goes_by_its_strings(spark):
    rnd = random.Random(2)
    noise = lambda: "".join(rnd.choice("pqr ") for _ in range(70))
    line = "".join(rnd.choice("xyz ") for _ in range(60))
    rows = [(i // 2, noise() + line + noise()) for i in range(60)]
    want = plain(rows)
    assert sum(r[2] for r in want) >= 58 * 60
    for options in ({}, {"many": 1000}, {"many": 3}, {"many": 1000, "wide": 10}):
        assert found(spark, rows, bucket=2000, **options) == want


def test_phrases_hold_each_string_once(rows):
    import numpy as np

    data = "".join(t or "" for _, t in rows).encode()
    at = np.r_[0, np.cumsum([len((t or "").encode()) for _, t in rows])]
    p = suffix_dedup.Phrases(np.frombuffer(data, np.uint8), at)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(p.first, p.last)])
    assert starts.tolist() == [i for a, b in zip(at[:-1], at[1:]) for i in range(a, b - 49)]
    assert (np.repeat(p.trigger, p.last - p.first + 1) >= starts).all() and (np.repeat(p.trigger, p.last - p.first + 1) <= starts + 34).all()


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_op13_equals_plain_counting(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((d, n, gone, len(spans), hashlib.sha256(kept).hexdigest()) for d, n, gone, spans, kept in plain(rows))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op13_suffix_dedup(spark, SF).collect())
    assert got == want and sum(r[2] for r in want) > 0
