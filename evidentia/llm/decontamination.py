"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised byte by byte: A-Z to lower case, every other ASCII byte
that is no digit or letter to a break, and breaks between words to one space. A
document is hit where it holds `window` consecutive words of a test item. Such a run
always covers a whole block of (window + 1) // 2 words, if an item is cut into such
blocks from its start; so the automaton holds each item's blocks, about as many
bytes as the items have, and not each of its windows, which are `window` times as
many. One scan of a normalised text finds all occurrences of blocks. The windows around
each are looked up, by the hashes of their words, in one sorted list of the items' windows,
so an occurrence costs the same however many items share the block, and however often. The
kept byte positions lead back to the original text.

The automaton is built once in each Python worker. MAX_BYTES bounds the bytes of all
blocks in it, which bounds its memory (about 55 bytes for each of them, so 230 MB);
more items than that are scanned for in several passes, each written to the shared
folder before the next block of items is read, and the hits of all passes are put
together by row (a stated set of items against all rows). Items that are longer alone
are cut into parts that overlap by a window less a word. The driver and each
worker hold the items of one pass.

Nulls: a null text has no words and is never hit; an item without words has no
windows; the windows of an item whose id is null count as hits but not as an item.
Repeated documents give a row each, equal windows of several items count for each
of them, and an empty table on either side gives no hits. Other columns are kept
out of the way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, dropped, mix64, set_apart, slices, span_hashes, text_bytes, written

WINDOW = 13
MAX_BYTES = 4 << 20  # of blocks in one automaton

#: Byte -> normalised byte; 0x20 is a break.
NORMAL = np.full(256, 0x20, np.uint8)
NORMAL[0x80:] = np.arange(0x80, 0x100)
NORMAL[0x30:0x3A] = np.arange(0x30, 0x3A)
NORMAL[0x61:0x7B] = np.arange(0x61, 0x7B)
NORMAL[0x41:0x5B] = np.arange(0x61, 0x7B)


def normalised(data: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The words of a UTF-8 text as ' w1 w2 ... ' (one character a byte), and their first and end bytes in the text."""
    low = NORMAL[data]
    word = np.r_[False, low != 0x20, False]
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return " ", starts, ends
    keep = np.r_[low != 0x20, True]
    keep[:-1] |= np.r_[False, low[:-1] != 0x20]  # the first break after a word
    keep[-1] = bool(word[-2])
    line = np.r_[low, np.uint8(0x20)][keep]
    return " " + line.tobytes().decode("latin-1"), starts, ends


class Automaton:
    """Blocks of items' words, and the items' windows as hashes with the items that have each."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        import ahocorasick

        self.size, block = size, (size + 1) // 2
        patterns: dict[str, int] = {}  # block or short item -> which of the two it is: 1, 2 or both
        self.names: list[str | None] = []
        windows, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for name, text in items:
            line, starts, _ = normalised(np.frombuffer((text or "").encode(), np.uint8))
            n = len(starts)
            if not n:
                continue
            spelled = line.split(" ")[1:-1]
            for i in range(0, n - block + 1, block) if n >= size else (0,):
                pattern = f" {' '.join(spelled[i : i + block] if n >= size else spelled)} "
                patterns[pattern] = patterns.get(pattern, 0) | (1 if n >= size else 2)
            found = np.unique(window_names(word_names(line), np.arange(max(1, n - size + 1)), min(n, size)))
            windows.append(found)
            owners.append(np.full(len(found), len(self.names)))
            self.names.append(name)
        windows, owners = np.concatenate(windows), np.concatenate(owners)
        order = np.lexsort((owners, windows))
        self.owners = owners[order]
        self.windows, self.first = np.unique(windows[order], return_index=True)
        self.first = np.r_[self.first, len(order)]
        self.machine = ahocorasick.Automaton()
        for w, kinds in patterns.items():
            self.machine.add_word(w, (kinds, w.count(" ") - 1, len(w)))
        if patterns:
            self.machine.make_automaton()

    def scan(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, set[str]]:
        """Words' first and end bytes, which words lie in an occurrence, and the items that occur."""
        line, starts, ends = normalised(data)
        hit, items = np.zeros(len(starts), bool), set()
        found = list(self.machine.iter(line)) if len(self.windows) and len(starts) else []
        if not found:
            return starts, ends, hit, items
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)  # word i begins after the i-th
        words, n = word_names(line), len(starts)
        kinds, length = np.array([k for _, (k, _, _) in found]), np.array([m for _, (_, m, _) in found])
        begin = np.searchsorted(spaces, np.array([e - m + 1 for e, (_, _, m) in found]))
        change, known = np.zeros(n + 1, np.int64), []
        # windows around blocks, each once; then short items, by their length
        around = begin[kinds & 1 > 0][:, None] - np.arange(self.size - (self.size + 1) // 2 + 1)
        asked = [(np.unique(around[(around >= 0) & (around + self.size <= n)]), self.size)]
        short = kinds & 2 > 0
        asked += [(np.unique(begin[short & (length == m)]), int(m)) for m in np.unique(length[short])]
        for at, m in asked:
            names = window_names(words, at, m)
            place = np.minimum(np.searchsorted(self.windows, names), len(self.windows) - 1)
            good = self.windows[place] == names
            np.add.at(change, at[good], 1)
            np.add.at(change, at[good] + m, -1)
            known.append(place[good])
        for k in np.unique(np.concatenate(known)).tolist():
            items.update(self.owners[self.first[k] : self.first[k + 1]].tolist())
        return starts, ends, np.cumsum(change[:-1]) > 0, {self.names[k] for k in items} - {None}


def window_names(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size words from each place on."""
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        out = mix64(out + words[at + k])
    return out


def word_names(line: str) -> np.ndarray:
    """A hash of each word of a normalised line, never 0."""
    c = np.frombuffer(line.encode("latin-1"), np.uint8)
    spaces = np.flatnonzero(c == 0x20)
    return span_hashes(c, spaces[:-1] + 1, spaces[1:]) | np.uint64(1)


_LATEST: dict[str, Automaton] = {}


def automaton(key: str, items: list, size: int) -> Automaton:
    """The automaton of these items; a worker keeps the latest."""
    if key not in _LATEST:
        _LATEST.clear()
        _LATEST[key] = Automaton(items, size)
    return _LATEST[key]


RESULT = ("n_words", "n_hit", "hit_words", "hit_bytes", "items", "contaminated", "_row")


def parts_of(text: str | None, size: int, max_bytes: int) -> Iterator[str]:
    """A text, or parts of about max_bytes of it that overlap by size - 1 words."""
    if len(text or "") <= max_bytes // 4:
        yield text or ""
        return
    line, _, _ = normalised(np.frombuffer(text.encode(), np.uint8))
    spelled, at = line.encode("latin-1").decode("utf-8", "replace").split(" ")[1:-1], 0
    while at < len(spelled):
        held, end = 0, at
        while end < len(spelled) and (held <= max_bytes // 2 or end - at < 2 * size):
            held += len(spelled[end].encode()) + 1
            end += 1
        yield " ".join(spelled[at:end])
        if end >= len(spelled):
            return
        at = end - size + 1


def item_blocks(items: DataFrame, size: int, max_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in lists of at most max_bytes of text (or one part of an item), one held at a time; one empty list if there are none."""
    held, used, any_ = [], 0, False
    for r in items.toLocalIterator():
        for text in parts_of(r["text"], size, max_bytes):
            n = len(text.encode())
            if held and used + n > max_bytes:
                yield held
                held, used, any_ = [], 0, True
            held.append((r["item"], text))
            used += n
    if held or not any_:
        yield held


def scanned(docs: DataFrame, items: list, size: int) -> DataFrame:
    """All columns of docs (one of them text), n_words, runs of hit words, their byte spans in the text, and the items found."""
    key = hashlib.sha256(repr((items, size)).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(items)
    pairs = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(key, shared.value, size)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                data, at = text_bytes(column(part, "text"))
                n_words, runs, spans, names = [], [], [], []
                for a, b in zip(at[:-1], at[1:]):
                    starts, ends, hit, items_ = found.scan(data[a:b])
                    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
                    first, last = edges[::2], edges[1::2] - 1
                    n_words.append(len(starts))
                    runs.append([{"first": int(x), "last": int(y)} for x, y in zip(first, last)])
                    spans.append([{"first": int(starts[x]), "last": int(ends[y])} for x, y in zip(first, last)])
                    names.append(sorted(items_))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n_words, pa.int64()), pa.array(runs, pairs), pa.array(spans, pairs), pa.array(names, pa.list_(pa.string()))], [*part.schema.names, "n_words", "hit_words", "hit_bytes", "items"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    span = "array<struct<first:bigint,last:bigint>>"
    return docs.mapInArrow(run, f"{fields}, n_words long, hit_words {span}, hit_bytes {span}, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_bytes: int = MAX_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs with n_words, n_hit, hit_bytes, items and contaminated.

    hit_bytes are the byte spans [first, last) of the original text that test
    windows cover; items are the ids, as text, of test items with a window there.
    A document is contaminated if it has a hit and at least a twentieth of its
    words are hit. A kept column whose name the result needs is called name_in.
    """
    docs, names = set_apart(docs, RESULT)
    keep = tuple(names[c] for c in keep)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text"))
    slim = docs.select(*keep, *([] if "text" in keep else ["text"]))
    blocks = item_blocks(items, size, max_bytes)
    first = next(blocks)
    second = next(blocks, None)
    out = scanned(slim, first, size) if second is None else in_passes(slim, keep, chain([first, second], blocks), size)
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    out = out.withColumn("n_hit", n_hit)
    return out.select(*keep, "n_words", "n_hit", "hit_bytes", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def in_passes(docs: DataFrame, keep: tuple[str, ...], blocks: Iterator[list], size: int) -> DataFrame:
    """scanned() by one block of items after the other over a numbered copy of docs, each pass written before the next block is read."""
    numbered, path = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found, words, paths = None, None, [path]
    for block in blocks:
        one, path = written(scanned(numbered.select("_row", "text"), block, size).select("_row", "n_words", F.arrays_zip("hit_words", "hit_bytes").alias("runs"), "items"), "pass")
        paths.append(path)
        words = one.select("_row", "n_words") if words is None else words
        hits = one.where(F.size("runs") > 0).drop("n_words")
        found = hits if found is None else found.unionByName(hits)
    flat = lambda c: F.flatten(F.collect_list(c))  # noqa: E731  as many lists of a row as there are passes
    found = found.groupBy("_row").agg(joined_runs(flat("runs")).alias("runs"), F.array_sort(F.array_distinct(flat("items"))).alias("items"))
    found = found.select("_row", F.col("runs.hit_words").alias("hit_words"), F.col("runs.hit_bytes").alias("hit_bytes"), "items")
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    out = numbered.select("_row", *keep).join(words, "_row").join(found, "_row", "left")
    out = out.select(*keep, "n_words", F.coalesce("hit_words", none).alias("hit_words"), F.coalesce("hit_bytes", none).alias("hit_bytes"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    out, _ = written(out, "hits")
    dropped(docs.sparkSession, *paths)
    return out


def joined_runs(runs: F.Column) -> F.Column:
    """Runs of hit words with their bytes, sorted; those that overlap or touch are one, as they are in a single pass."""
    last = lambda done: F.element_at(done, -1)
    both = lambda a, b, part: F.struct(a[part]["first"].alias("first"), F.greatest(a[part]["last"], b[part]["last"]).alias("last")).alias(part)
    return F.aggregate(
        F.array_sort(runs),
        F.slice(runs, 1, 0),
        lambda done, r: F.when((F.size(done) > 0) & (last(done)["hit_words"]["last"] + 1 >= r["hit_words"]["first"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(both(last(done), r, "hit_words"), both(last(done), r, "hit_bytes"))))).otherwise(F.concat(done, F.array(r))),
    )
