"""Exact removal of repeated strings of KEY bytes, by prefix-free parsing spread over a cluster.

A byte goes if a string of KEY bytes covers it that also starts in a document with a
smaller doc_id. Strings are judged on the input; they never cross documents.

1. Parse. Each byte has a hash of the GRAM bytes from it on. The place with the least hash
   of a string (the first, if several) is its trigger. Strings that start one after the
   other and have one trigger make a phrase: the bytes from the first string's start to
   the last one's end. Which trigger a string has depends on its own bytes alone, so equal
   strings lie in phrases of the same trigger gram, at the same distance from it. A phrase
   has at most 2 * KEY - GRAM bytes, and there is about one for each (KEY - GRAM + 2) / 2
   bytes of text.
2. Dictionary. Phrases of a block of documents are named by two hashes (of the trigger
   gram, and of the whole phrase) and meet those of other blocks where the gram's hash
   sends them. A phrase that a smaller document has as well is repeated as a whole. Only
   the first document of each distinct phrase has to look further, and only if its gram
   is in another phrase too.
3. Suffix arrays. The bytes of those phrases meet by their gram. They are sorted once by
   what stands before the gram, read backwards (the phrase's own suffixes), and once by
   what follows it (where the parse goes on). A string is a range in either order, and the
   pair of ranges, found by longest common prefixes, is its class: the corpus order down to
   KEY bytes. A string is repeated if its class has a smaller document.
4. Grams with very many different phrases (a line that a third of all documents share,
   each in another context) don't meet in one task: a block with MANY phrases of a gram
   names none of them, and the strings of all phrases of that gram meet by their own
   hashes instead, one entry for each block.

Texts are read in blocks from a table bucketed by the task that wrote it, so that what
other tasks answer is joined to the blocks without moving texts. A task holds one block or
one bucket of the dictionary, whose number follows from the bytes of the corpus.

Null texts are empty; texts under KEY bytes have no strings. Rows that share a doc_id are
parts of one document for the question which is smaller: none is smaller than the other.
A row with a null doc_id can't be compared; it keeps all bytes and nothing is removed for
it. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, dropped, mix64, shared_folder, slices, span_hashes, text_bytes, written

KEY = 50  # bytes of a string
GRAM = 16  # bytes of a trigger
REACH = KEY - GRAM  # most bytes of a string on either side of its trigger
BLOCK = 2 << 20  # bytes of texts in a block
BUCKET = 4 << 20  # bytes of texts whose phrases meet in a bucket
MANY = 16  # phrases of one gram in a block from which on the block names none
WIDE = 4096  # phrases of one gram that are sorted together
WINDOW = 1 << 20  # bytes that are parsed at once
_PLACE = np.uint64(WINDOW - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each byte on."""
    n = len(data) - GRAM + 1
    raw = np.ascontiguousarray(data)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    return mix64(mix64(eight[:n].copy()) ^ eight[8 : 8 + n])


class Phrases:
    """Phrases of texts that lie end to end in data: first and last start of their strings, trigger, text, and hashes of gram and phrase."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        parts = [self.parsed(data, lo) for lo in range(0, max(0, len(data) - KEY + 1), WINDOW - KEY)]
        trigger = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        gram = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint64)
        first = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)
        last = np.r_[first[1:], max(0, len(data) - KEY + 1)][: len(first)] - 1
        # phrases that cross texts are cut where a text's strings end and where the next text begins
        ends = np.maximum(at[1:] - KEY + 1, at[:-1])
        cuts = np.unique(np.r_[at[:-1], ends])
        cuts = cuts[(cuts > 0) & (cuts <= (last[-1] if len(last) else -1))]
        owner = np.searchsorted(first, cuts, "right") - 1
        new = cuts[first[owner] != cuts]
        where = np.searchsorted(first, new, "right")
        back = owner[first[owner] != cuts]
        first, trigger, gram = np.insert(first, where, new), np.insert(trigger, where, trigger[back]), np.insert(gram, where, gram[back])
        last = np.r_[first[1:], max(0, len(data) - KEY + 1)][: len(first)] - 1
        text = np.searchsorted(at, first, "right") - 1
        good = first + KEY <= at[np.minimum(text + 1, len(at) - 1)]
        self.first, self.last, self.trigger, self.gram, self.text = first[good], last[good], trigger[good], gram[good], text[good]
        self.name = np.maximum(span_hashes(data, self.first, self.last + KEY) & np.uint64((1 << 48) - 1), np.uint64(1))

    @staticmethod
    def parsed(data: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Trigger, gram hash and first start of each phrase of the strings that start in data[lo : lo + WINDOW - KEY]."""
        piece = data[lo : lo + WINDOW - 1]
        hashes = gram_hashes(piece)
        low = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)  # the place breaks ties: the first of equal grams
        span, width = 1, REACH + 1
        while span * 2 <= width:
            low, span = np.minimum(low[:-span], low[span:]), span * 2
        if span < width:
            low = np.minimum(low[: span - width], low[width - span :])
        trigger = (low[: WINDOW - KEY] & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]])
        return trigger[first] + lo, hashes[trigger[first]], first + lo


class Entries:
    """Distinct phrases of a block in the order of their hashes, each with its smallest document."""

    def __init__(self, data: np.ndarray, at: np.ndarray, ids: np.ndarray, named: np.ndarray, most: int = MANY):
        p = Phrases(data, at)
        kept = named[p.text]
        self.first, self.last, self.trigger = p.first[kept], p.last[kept], p.trigger[kept]
        gram, name, doc = p.gram[kept], p.name[kept], ids[p.text[kept]]
        order = np.lexsort((doc, name, gram))
        g, n = gram[order], name[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (n[1:] != n[:-1])][: len(order)]
        self.lead = order[new]  # for each entry a phrase of its smallest document
        self.gram, self.name, self.doc = gram[self.lead], name[self.lead], doc[self.lead]
        self.of = np.empty(len(order), np.int64)  # entry of each phrase
        self.of[order] = np.cumsum(new) - 1
        self.least = doc == self.doc[self.of]  # whether a phrase stands in its entry's smallest document
        begins = np.flatnonzero(np.r_[True, self.gram[1:] != self.gram[:-1]][: len(self.gram)])
        self.group = np.cumsum(np.r_[True, self.gram[1:] != self.gram[:-1]][: len(self.gram)]) - 1
        many = np.diff(np.r_[begins, len(self.gram)]) >= most
        # what is sent: all entries, but one nameless entry for a gram of many phrases
        lone = np.zeros(len(self.gram), bool)
        lone[begins[many]] = True
        self.sent = np.flatnonzero(~many[self.group] | lone)
        self.sent_name = np.where(lone[self.sent], np.uint64(0), self.name[self.sent])
        least = np.minimum.reduceat(self.doc, begins) if len(begins) else self.doc
        self.sent_doc = np.where(lone[self.sent], least[self.group[self.sent]], self.doc[self.sent])

    def strings(self, data: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all strings of these entries' phrases, and the entry's place in the list for each."""
        lead = self.lead[entries]
        count = self.last[lead] - self.first[lead] + 1
        ends = np.cumsum(count)
        start = np.repeat(self.first[lead] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
        return span_hashes(data, start, start + KEY), np.repeat(np.arange(len(entries)), count)


# What travels between tasks: arrays as bytes, numbers as byte planes, whose high ones compress to nothing.
def planes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8" if values.dtype.kind == "u" else "<i8")).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(raw: np.ndarray, n: int, width: int, kind: str = "<u8") -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw[: n * width].reshape(width, n).T
    return out.reshape(-1).view(kind)


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def edges(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) for the runs of an ascending array."""
    at = np.r_[0, np.flatnonzero(np.diff(buckets)) + 1, len(buckets)] if len(buckets) else np.zeros(1, np.int64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield int(buckets[a]), a, b


def batch_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)


MESSAGE = "part long, ord long, bucket long, n long, body binary"
MESSAGE_NAMES, MESSAGE_KINDS = ["part", "ord", "bucket", "n", "body"], [pa.int64()] * 4 + [pa.binary()]


def blocks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as rows (part, ord, ids, sizes, n_bytes, body): about BLOCK bytes of texts each, compressed; part is the task, ord the block's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ord_, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            sizes = np.concatenate([np.diff(h[2]) for h in held])
            data = b"".join(h[1].tobytes() for h in held)
            row = [pa.array([part], pa.int64()), pa.array([ord_], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.ListArray.from_arrays([0, len(sizes)], pa.array(sizes, pa.int64())), pa.array([len(data)], pa.int64()), pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["part", "ord", "ids", "sizes", "n_bytes", "body"])

        for batch in batches:
            for cut in slices(batch, "text", BLOCK):
                data, at = text_bytes(column(cut, "text"))
                held.append((column(cut, "doc_id"), data, at))
                size += len(data)
                if size >= BLOCK:
                    yield block()
                    ord_, held, size = ord_ + 1, [], 0
        if held:
            yield block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "part long, ord long, ids array<bigint>, sizes array<bigint>, n_bytes long, body binary")


def unpacked(batches: Iterator[pa.RecordBatch], many: int) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray, Entries, list]]:
    """For each block: part, ord, ids, data, offsets, entries and the answers that came with it."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            ids = column(row, "ids").flatten()
            at = np.r_[0, np.cumsum(column(row, "sizes").flatten().to_numpy())].astype(np.int64)
            data = np.frombuffer(pa.decompress(column(row, "body")[0].as_py(), column(row, "n_bytes")[0].as_py(), "zstd", asbytes=True), np.uint8)
            entries = Entries(data, at, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), many)
            told = sorted(((x["kind"], x["bucket"], x["body"]) for x in column(row, "answers")[0].as_py() or []), key=lambda x: x[:2]) if "answers" in batch.schema.names else []
            yield column(row, "part")[0].as_py(), column(row, "ord")[0].as_py(), ids, data, at, entries, told


def named(bits: int, many: int):
    """Pass 1: a block's phrases, by bucket of their gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ord_, _, _, _, e, _ in unpacked(batches, many):
            gram = e.gram[e.sent]
            rows = [(part, ord_, b, j - i, planes(gram[i:j], 5) + planes(e.sent_name[i:j], 6) + planes(e.sent_doc[i:j], 8)) for b, i, j in edges(bucket_of(gram, bits))]
            yield batch_of(rows, MESSAGE_NAMES, MESSAGE_KINDS)

    return run


NONE, WHOLE, ASK, STRINGS = range(4)


def judged(bucket: pa.Table, wide: int) -> pa.Table:
    """A bucket of phrases: whether each is repeated as a whole, has to send its bytes, or its strings' hashes."""
    n = bucket.column("n").to_numpy()
    raw = [np.frombuffer(x, np.uint8) for x in bucket.column("body").to_pylist()]
    gram = np.concatenate([from_planes(r, k, 5) for r, k in zip(raw, n)])
    name = np.concatenate([from_planes(r[5 * k :], k, 6) for r, k in zip(raw, n)])
    doc = np.concatenate([from_planes(r[11 * k :], k, 8, "<i8") for r, k in zip(raw, n)])
    order = np.lexsort((doc, name, gram))
    g, p, d = gram[order], name[order], doc[order]
    new_gram = np.r_[True, g[1:] != g[:-1]]
    new = new_gram | np.r_[True, p[1:] != p[:-1]]
    heads, group = np.flatnonzero(new_gram), np.cumsum(new_gram) - 1
    least, most = np.minimum.reduceat(d, heads), np.maximum.reduceat(d, heads)
    phrases = np.add.reduceat(new.astype(np.int64), heads)
    strings = (p[heads] == 0) | (phrases > wide)
    again = d > d[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
    code = np.where(again, WHOLE, np.where((least < most)[group] & (phrases > 1)[group], ASK, NONE))
    out = np.empty(len(order), np.uint8)
    out[order] = np.where(strings[group], STRINGS, code)
    ends = np.cumsum(n)
    bodies = [np.packbits(out[a:b] & 1).tobytes() + np.packbits(out[a:b] >> 1).tobytes() for a, b in zip(ends - n, ends)]
    return pa.table({"part": bucket.column("part"), "ord": bucket.column("ord"), "kind": pa.array([0] * len(n), pa.int64()), "bucket": bucket.column("bucket"), "body": pa.array(bodies, pa.binary())})


ANSWER = "part long, ord long, kind long, bucket long, body binary"


def codes(e: Entries, told: list, bits: int) -> np.ndarray:
    """What pass 1 says of each entry."""
    gram = e.gram[e.sent]
    sent = np.zeros(len(gram), np.uint8)
    bodies = {b: body for kind, b, body in told if kind == 0}
    for b, i, j in edges(bucket_of(gram, bits)):
        both = np.unpackbits(np.frombuffer(bodies[b], np.uint8).reshape(2, -1), axis=1)[:, : j - i]
        sent[i:j] = both[0] | (both[1] << 1)
    out = np.zeros(len(e.gram), np.uint8)
    out[e.sent] = sent
    by_group = np.zeros(int(e.group[-1]) + 1 if len(e.group) else 0, bool)
    by_group[e.group[e.sent[sent == STRINGS]]] = True
    return np.where(by_group[e.group], np.uint8(STRINGS), out) if len(out) else out


def phrase_strings(e: Entries, data: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of the strings of entries with the code STRINGS, ascending, and their smallest documents; and the entries."""
    entries = np.flatnonzero(code == STRINGS)
    hashes, which = e.strings(data, entries)
    doc = e.doc[entries][which]
    order = np.lexsort((doc, hashes))
    first = order[np.r_[True, hashes[order][1:] != hashes[order][:-1]][: len(order)]]
    return hashes[first], doc[first], entries


def told_more(bits: int, many: int):
    """Pass 2: the bytes of phrases that must be compared, by bucket of their gram (kind 1), and hashes of strings (kind 2), by their own bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ord_, _, data, _, e, told in unpacked(batches, many):
            code, rows = codes(e, told, bits), []
            ask = np.flatnonzero(code == ASK)
            lead = e.lead[ask]
            first, size, left = e.first[lead], e.last[lead] + KEY - e.first[lead], e.trigger[lead] - e.first[lead]
            for b, i, j in edges(bucket_of(e.gram[ask], bits)):
                k, ends = j - i, np.cumsum(size[i:j])
                spread = np.repeat(first[i:j] - (ends - size[i:j]), size[i:j]) + np.arange(int(ends[-1]))
                rows.append((part, ord_, 2 * b, k, planes(e.gram[ask[i:j]], 5) + planes(e.doc[ask[i:j]], 8) + planes(size[i:j], 1) + planes(left[i:j], 1) + data[spread].tobytes()))
            hashes, doc, _ = phrase_strings(e, data, code)
            for b, i, j in edges(bucket_of(hashes, bits)):
                rows.append((part, ord_, 2 * b + 1, j - i, planes(hashes[i:j], 8) + planes(doc[i:j], 8)))
            yield batch_of(rows, MESSAGE_NAMES, MESSAGE_KINDS)

    return run


def classes(gram: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For rows of bytes (phrases x REACH) of several grams: class of the first a bytes of each row, for a = 0 .. REACH, by the sorted order and its common prefixes."""
    words = np.zeros((len(side), -(-REACH // 8) * 8), np.uint8)
    words[:, :REACH] = side
    keys = words.view(">u8").astype(np.uint64)
    order = np.lexsort((*keys.T[::-1], gram))
    rows, g = side[order], gram[order]
    differs = rows[1:] != rows[:-1]
    common = np.where(differs.any(1), differs.argmax(1), REACH)
    common = np.where(g[1:] != g[:-1], -1, common)
    out = np.empty((REACH + 1, len(side)), np.int32)
    for a in range(REACH + 1):
        out[a, order] = np.cumsum(np.r_[False, common < a])
    return out


def compared(gram: np.ndarray, doc: np.ndarray, size: np.ndarray, left: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For phrases that lie end to end in data: a number for each, whose bit a says that the string with a bytes before the trigger is in a smaller document."""
    at = np.cumsum(size) - size
    steps = np.arange(REACH)
    padded = np.r_[data, np.zeros(2 * KEY, np.uint8)]
    before = np.where(steps < left[:, None], padded[at[:, None] + np.maximum(left[:, None] - 1 - steps, 0)], 0).astype(np.uint8)
    right = size - left - GRAM
    after = np.where(steps < right[:, None], padded[at[:, None] + left[:, None] + GRAM + np.minimum(steps, np.maximum(right[:, None], 0))], 0).astype(np.uint8)
    down, on = classes(gram, before), classes(gram, after)
    out = np.zeros(len(gram), np.uint64)
    for a in range(REACH + 1):
        has = np.flatnonzero((left >= a) & (right >= REACH - a))
        if not len(has):
            continue
        key = (down[a, has].astype(np.int64) << 32) | on[REACH - a, has]
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        least = np.minimum.reduceat(doc[has][order], heads)
        back = np.repeat(least, np.diff(np.r_[heads, len(order)]))
        hit = has[order[doc[has][order] > back]]
        out[hit] |= np.uint64(1 << a)
    return out


def matched(bucket: pa.Table) -> pa.Table:
    """A bucket of phrases' bytes, or of strings' hashes: which strings are in a smaller document."""
    n = bucket.column("n").to_numpy()
    raw = [np.frombuffer(x, np.uint8) for x in bucket.column("body").to_pylist()]
    ends = np.cumsum(n)
    kind = 1 + int(bucket.column("bucket")[0].as_py()) % 2
    if kind == 1:
        gram = np.concatenate([from_planes(r, k, 5) for r, k in zip(raw, n)])
        doc = np.concatenate([from_planes(r[5 * k :], k, 8, "<i8") for r, k in zip(raw, n)])
        size = np.concatenate([r[13 * k : 14 * k] for r, k in zip(raw, n)]).astype(np.int64)
        left = np.concatenate([r[14 * k : 15 * k] for r, k in zip(raw, n)]).astype(np.int64)
        mask = compared(gram, doc, size, left, np.concatenate([r[15 * k :] for r, k in zip(raw, n)]))
        bodies = [mask[a:b].tobytes() for a, b in zip(ends - n, ends)]
    else:
        key = np.concatenate([from_planes(r, k, 8) for r, k in zip(raw, n)])
        doc = np.concatenate([from_planes(r[8 * k :], k, 8, "<i8") for r, k in zip(raw, n)])
        order = np.lexsort((doc, key))
        heads = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        hit = np.empty(len(key), bool)
        hit[order] = doc[order] > np.repeat(doc[order][heads], np.diff(np.r_[heads, len(key)]))
        bodies = [np.packbits(hit[a:b]).tobytes() for a, b in zip(ends - n, ends)]
    return pa.table({"part": bucket.column("part"), "ord": bucket.column("ord"), "kind": pa.array([kind] * len(n), pa.int64()), "bucket": bucket.column("bucket"), "body": pa.array(bodies, pa.binary())})


def repeated_starts(e: Entries, data: np.ndarray, told: list, bits: int) -> np.ndarray:
    """Whether a repeated string starts at each byte of a block."""
    code = codes(e, told, bits)
    size = np.zeros(len(data) + 1, np.int64)
    whole = ~e.least | (code[e.of] == WHOLE)
    np.add.at(size, e.first[whole], 1)
    np.add.at(size, e.last[whole] + 1, -1)
    start = np.cumsum(size)[: len(data)] > 0
    ask = np.flatnonzero(code == ASK)
    if len(ask):
        masks = np.frombuffer(b"".join(body for kind, _, body in told if kind == 1), np.uint64)
        by_entry = np.zeros(len(code), np.uint64)
        by_entry[ask] = masks
        some = np.flatnonzero(e.least & (by_entry[e.of] > 0))
        bit = (by_entry[e.of[some]][:, None] >> np.arange(REACH + 1, dtype=np.uint64)) & np.uint64(1)
        which, a = np.nonzero(bit)
        start[e.trigger[some[which]] - a] = True
    hashes, least, entries = phrase_strings(e, data, code)
    if len(entries):
        bodies = {b: body for kind, b, body in told if kind == 2}
        hit = np.concatenate([np.unpackbits(np.frombuffer(bodies[2 * b + 1], np.uint8))[: j - i] for b, i, j in edges(bucket_of(hashes, bits))]).astype(bool)
        own = np.flatnonzero(e.least & (code[e.of] == STRINGS))
        count = e.last[own] - e.first[own] + 1
        ends = np.cumsum(count)
        at = np.repeat(e.first[own] - (ends - count), count) + np.arange(int(ends[-1]))
        place = np.searchsorted(hashes, span_hashes(data, at, at + KEY))
        doc = np.repeat(e.doc[e.of[own]], count)
        start[at[hit[place] | (least[place] < doc)]] = True
    return start


RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<begin:bigint,end:bigint>>, kept binary"


def cut_out(bits: int, many: int):
    """Pass 3: each document's bytes without those that a repeated string covers, and the runs that went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]
        for _, _, ids, data, at, e, told in unpacked(batches, many):
            starts = np.cumsum(repeated_starts(e, data, told, bits), dtype=np.int64)
            gone = starts > np.r_[np.zeros(KEY, np.int64), starts[:-KEY]][: len(starts)]
            change = np.r_[False, gone[1:] != gone[:-1]][: len(gone)]
            change[at[:-1][at[:-1] < len(data)]] = True
            run_at = np.flatnonzero(change)
            run_end = np.r_[run_at[1:], len(data)][: len(run_at)]
            run_at, run_end = run_at[gone[run_at]], run_end[gone[run_at]]
            lo, hi = np.searchsorted(run_at, at[:-1]), np.searchsorted(run_at, at[1:])
            rows = []
            for i, doc in enumerate(ids.to_pylist()):
                a, b = at[i], at[i + 1]
                spans = [{"begin": int(x - a), "end": int(y - a)} for x, y in zip(run_at[lo[i] : hi[i]], run_end[lo[i] : hi[i]])]
                rows.append((doc, int(b - a), sum(s["end"] - s["begin"] for s in spans), spans, data[a:b][~gone[a:b]].tobytes()))
                if len(rows) == 1024:
                    yield batch_of(rows, ["doc_id", "n_bytes", "n_removed", "spans", "kept"], kinds)
                    rows = []
            yield batch_of(rows, ["doc_id", "n_bytes", "n_removed", "spans", "kept"], kinds)

    return run


def without_repeats(docs: DataFrame, bucket: int = BUCKET, many: int = MANY, wide: int = WIDE) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (runs of removed bytes) and kept (the other bytes) of each row of docs (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    name, path = f"blocks_{uuid.uuid4().hex}", f"{shared_folder(spark)}/blocks"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks(docs).write.option("path", path).option("compression", "none").bucketBy(tasks, "part").saveAsTable(name)
    held = spark.table(name)
    total = held.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / bucket))))
    first, one = written(held.mapInArrow(named(bits, many), MESSAGE).groupBy("bucket").applyInArrow(lambda b: judged(b, wide), ANSWER), "phrases")
    second, two = written(answered(held, first).mapInArrow(told_more(bits, many), MESSAGE).groupBy("bucket").applyInArrow(matched, ANSWER), "strings")
    out, _ = written(answered(held, first.unionByName(second)).mapInArrow(cut_out(bits, many), RESULT), "kept")
    spark.sql(f"DROP TABLE {name}")
    dropped(spark, path, one, two)
    return out


def answered(held: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with the answers to their questions; texts stay where they are, as blocks are bucketed by part."""
    by_part = answers.groupBy("part").agg(F.collect_list(F.struct("ord", "kind", "bucket", "body")).alias("told"))
    joined = held.join(by_part.hint("merge"), "part", "left")
    return joined.select("part", "ord", "ids", "sizes", "n_bytes", "body", F.filter("told", lambda x: x["ord"] == F.col("ord")).alias("answers"))
