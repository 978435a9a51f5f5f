"""MinHash near-duplicates with exact confirmation.

1. Sketch: one hash a shingle; the top bits choose one of BINS bins and each bin
   keeps its least hash (one-permutation hashing). An empty bin copies the bin
   that its own fixed probe order finds first (optimal densification), so equal
   bins still agree with the probability of the Jaccard similarity. ROWS bins
   make a band key; with 32 bands of 4 a pair at 0.85 misses all bands about once
   in 10**10.
2. Documents with the same set are one node from here on.
3. Candidates: in each bucket (band key) every node has an edge to the smallest
   node, a star; stars of one centre are put together, so pairs stay in
   proportion to nodes however large a bucket is.
4. Confirmation: a star is dealt into chunks of about CHUNK members and a copy of
   the centre. In a chunk all pairs are compared on full sets. Members of a star of
   several chunks may be similar to each other but not to the centre, so their
   buckets that still hold several components are looked at again. A bucket that
   fits a chunk is compared as a whole. Documents of larger ones get finer keys, by an
   exact prefix filter: shingles are ordered by how many of these documents have them (by a
   table of counts of bounded size: any order is right, a good one keeps keys apart), and a document at the threshold with another shares one of its first
   n - ceil(percent * n / 100) + 1 shingles with it. Shingles of one document alone
   come first and can't be shared, so a document that differs enough from all others has no
   key. Keys of up to MEET documents give pairs, of which bounds of the overlap leave
   few. Documents of a key that more have are asked for in groups of about GROUP shingles:
   those outside the key's largest component ask all others.
   So every pair that shares a bucket is compared or is in one component.
5. Components: large-star and small-star rounds over the confirmed links.

Nulls and empty texts have no shingles and are linked with nothing. Rows that
repeat a doc_id count as one document for links. A row whose doc_id is null
can't be named by a link; it has no component and is kept. Ties don't arise. An
empty table gives an empty result. Other columns are ignored. With a column of row
numbers each row is judged by its own text alone, and links name rows. Of the tables
in the shared folder only that of the result stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, column, dropped, mix64, slices, span_hashes, text_bytes, written

BINS, ROWS = 128, 4
CHUNK = 64  # documents that are compared with each other at the first look
MEET = 32  # documents of a finer key that are paired
RARITY_BITS = 22  # of the table of shingles' counts, 16 MB, that orders them
GROUP = 1 << 18  # shingles of askers, and of those asked, in a group of the last resort

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

with np.errstate(over="ignore"):
    _BIN = np.arange(BINS, dtype=np.uint64)
    #: Bin -> the bins that it asks, in turn, while it is empty.
    PROBES = (mix64(_BIN[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(2048, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)) % np.uint64(BINS)).astype(np.int64)
EDGES = _BIN << np.uint64(57)
BANDS = mix64(np.arange(1, BINS // ROWS + 1, dtype=np.uint64))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of texts that lie end to end in data, and the words' n + 1 offsets by text."""
    word = ~SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[at] = True
    inner = word.copy()
    inner[1:] &= word[:-1] & ~begins[1 : len(data)]
    if len(inner):
        inner[0] = False  # inner: a byte that continues a word
    starts = np.flatnonzero(word & ~inner)
    ends = np.flatnonzero(word & ~np.r_[inner[1:], False]) + 1
    return span_hashes(LOWER[data], starts, ends), np.searchsorted(starts, at)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of a text's words, ascending; a shorter text is one shingle of its own kind."""
    if not len(words):
        return words
    n = min(size, len(words))
    h = np.full(max(1, len(words) - size + 1), np.uint64(n), np.uint64)
    for k in range(n):
        h = mix64(h + words[k : k + len(h)])
    return np.unique(h)


def one_permutation(found: np.ndarray) -> np.ndarray:
    """BINS values of a set that is not empty."""
    first = np.searchsorted(found, EDGES)
    value = found[np.minimum(first, len(found) - 1)]
    full = (value >> np.uint64(57)) == _BIN
    empty = np.flatnonzero(~full)
    for lo, hi in ((0, 16), (16, 2048)):
        if not len(empty):
            break
        asked = PROBES[empty, lo:hi]
        good = full[asked]
        turn = good.argmax(1)
        ok = good[np.arange(len(empty)), turn]
        value[empty[ok]] = value[asked[ok, turn[ok]]]
        empty = empty[~ok]
    if len(empty):  # about once in a million bins
        value[empty] = found[0]
    return value


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(-1, ROWS)
    key = BANDS.copy()
    for k in range(ROWS):
        key = mix64(key + rows[:, k])
    return key


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """name, doc_id, n_shingles, two 64-bit sums that name the set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                data, at = text_bytes(column(part, "text"))
                words, cut = word_hashes(data, at)
                n, one, two, keys = [], [], [], []
                for a, b in zip(cut[:-1], cut[1:]):
                    found = shingle_set(words[a:b], size)
                    n.append(len(found))
                    one.append(int(found.sum().view(np.int64)) if len(found) else 0)
                    two.append(int(mix64(found ^ np.uint64(0x5555555555555555)).sum().view(np.int64)) if len(found) else 0)
                    keys.append(band_keys(one_permutation(found)).view(np.int64) if len(found) else np.zeros(0, np.int64))
                offsets = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([column(part, "name"), column(part, "doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), bands], ["name", "doc_id", "n_shingles", "one", "two", "bands"])

    return docs.mapInArrow(run, "name long, doc_id long, n_shingles long, one long, two long, bands array<bigint>")


def similar_pairs(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs i < j of sets with 100 * intersection >= percent * union."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    number = np.cumsum(np.r_[True, flat[1:] != flat[:-1]]) - 1 if len(flat) else np.zeros(0, np.int64)
    shared = np.bincount(number)[number] > 1 if len(flat) else np.zeros(0, bool)
    number, owner = number[shared], owner[shared]
    number = np.cumsum(np.r_[True, number[1:] != number[:-1]]) - 1 if len(number) else number
    both = np.zeros((n, n), np.float64)
    width = 1 << 14
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(number, [lo, lo + width])
        m = np.zeros((n, min(width, int(number[-1]) + 1 - lo)), np.float32)
        m[owner[a:b], number[a:b] - lo] = 1
        both += m @ m.T
    union = sizes[:, None] + sizes[None, :] - both
    hit = np.triu((100 * both >= percent * union) & (union > 0), 1)
    return list(zip(*(x.tolist() for x in np.nonzero(hit))))


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The components that pairs make, each as ties of its smallest item to all others."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return sorted((top(x), x) for x in {x for p in pairs for x in p} if top(x) != x)


def sets_of(texts: pd.Series, size: int) -> list[np.ndarray]:
    out = []
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        words, _ = word_hashes(data, np.array([0, len(data)]))
        out.append(shingle_set(words, size))
    return out


def confirmed(requests: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b), a < b, between documents of one group of requests (centre, chunk, doc) whose sets are similar.

    All pairs of a group are compared. What leaves it are its components, as ties of the smallest document to the others.
    """

    def run(df: pd.DataFrame) -> pd.DataFrame:
        ids = df["doc"].to_numpy(np.int64)
        pairs = similar_pairs(sets_of(df["text"], size), percent)
        return pd.DataFrame(forest([(int(ids[i]), int(ids[j])) for i, j in pairs]), columns=["a", "b"], dtype="int64")

    return requests.join(texts.hint("merge"), "doc").groupBy("centre", "chunk").applyInPandas(run, "a long, b long")


def asked(sets: list[np.ndarray], askers: np.ndarray, percent: int) -> np.ndarray:
    """For each set the least set that it is tied to, when each asker is compared with all sets.

    Overlaps are counted over the sets that have a shingle; for a shingle that most
    sets have, over those that lack it.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    owner = owner[order]
    tokens, first, count = np.unique(flat[order], return_index=True, return_counts=True)
    common = count > n // 2
    rank = np.cumsum(common) - 1
    lacking = np.ones((int(common.sum()), n), bool)
    held = np.repeat(common, count)
    lacking[np.repeat(rank[common], count[common]), owner[held]] = False
    lack_count = lacking.sum(1)
    lack_owner, lack_first = np.nonzero(lacking)[1], np.cumsum(lack_count) - lack_count

    def tally(firsts: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> np.ndarray:
        ends = np.cumsum(counts)
        places = np.repeat(firsts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        return np.bincount(owners[places], minlength=n)

    label = np.arange(n)
    for i in askers.tolist():
        t = np.searchsorted(tokens, sets[i])
        rare, usual = t[~common[t]], rank[t[common[t]]]
        both = tally(first[rare], count[rare], owner) + len(usual) - tally(lack_first[usual], lack_count[usual], lack_owner)
        near = np.flatnonzero((both > 0) & (100 * both >= percent * (sizes[i] + sizes - both)))
        found = np.unique(label[near])
        if len(found) > 1:
            label[np.isin(label, found)] = found[0]
    return label


def confirmed_asks(requests: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between the askers and all documents of one group of requests (centre, chunk, batch, doc, asks), as ties of the smallest document."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("doc", kind="stable")
        ids = df["doc"].to_numpy(np.int64)
        label = asked(sets_of(df["text"], size), np.flatnonzero(df["asks"].to_numpy(bool)), percent)
        tied = np.flatnonzero(ids[label] != ids)
        return pd.DataFrame({"a": ids[label[tied]], "b": ids[tied]})

    return requests.join(texts.hint("merge"), "doc").groupBy("centre", "chunk", "batch").applyInPandas(run, "a long, b long")


def edge_sum(edges: DataFrame) -> tuple:
    """A number for a set of edges that tells whether a round changed it."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def labels(links: DataFrame) -> tuple[DataFrame, str]:
    """doc and component (its smallest doc) of each end of links (a, b), by large-star and small-star rounds, written to a path."""
    spark = links.sparkSession
    edges, path = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    mark = edge_sum(edges)
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after, new = written(small, "edges")
        before, mark = mark, edge_sum(after)
        dropped(spark, path)
        edges, path = after, new
        if mark == before:
            break
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "doc")
    centres = edges.select(F.col("v").alias("doc"), F.col("v").alias("component")).distinct().join(stars.select("doc"), "doc", "left_anti")
    out = written(stars.unionByName(centres), "labels")
    dropped(spark, path)
    return out


def keyed(nodes: DataFrame) -> DataFrame:
    """(doc, key) for each band of nodes (doc, bands)."""
    return nodes.select("doc", F.explode("bands").alias("key"))


def stars(keys: DataFrame, saved: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(centre, doc): each bucket's documents but the smallest are tied to the smallest."""
    buckets = keys.groupBy("key").agg(F.min("doc").alias("centre"), F.max("doc").alias("top")).where("top != centre").select("key", "centre")
    buckets = saved(buckets, "buckets").hint("merge")  # written, so that a hot bucket's rows can part in the join
    return keys.join(buckets, "key").where("doc != centre").select("centre", "doc").distinct()


def dealt(edges: DataFrame, chunk: int, saved: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The edges with chunk, which of the chunks of its star a document is in, and chunks, how many there are."""
    edges = saved(edges, "edges")
    sizes = edges.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(float(chunk))).cast("int").alias("chunks"))
    sizes = saved(sizes, "sizes").hint("merge")
    return edges.join(sizes, "centre").select("centre", "doc", F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int").alias("chunk"), "chunks")


def with_centres(members: DataFrame) -> DataFrame:
    """Requests that compare each chunk of a star and its centre."""
    return members.select("centre", "chunk", "doc").unionByName(members.select("centre", "chunk", F.col("centre").alias("doc")).distinct())


def asks(named: DataFrame, group: int, saved: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Requests (centre, chunk, batch, doc, asks) by which the documents outside the largest component of a star ask all of it.

    named is a written table of centre, doc, component and n_shingles; saved writes a table and reads it again.
    """
    parts = named.groupBy("centre", "component").agg(F.sum("n_shingles").alias("size"))
    plan = parts.groupBy("centre").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.sum("size").alias("all"), (F.sum("size") - F.max("size")).alias("rest")).where("rest > 0")
    parts_of = lambda c: F.ceil(F.col(c) / F.lit(float(group))).cast("int")
    plan = saved(plan.select("centre", "largest", parts_of("all").alias("chunks"), parts_of("rest").alias("batches")), "plan")  # so that a hot centre's rows can part in the join
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "doc"), F.col(n)).cast("int")
    dealt_out = named.join(plan, "centre").select("centre", "doc", (F.col("component") != F.col("largest")).alias("asks"), "chunks", "batches", deal(0, "chunks").alias("own_chunk"), deal(1, "batches").alias("own_batch"))
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asking = dealt_out.where("asks").select("centre", F.explode(numbers("chunks")).alias("chunk"), F.col("own_batch").alias("batch"), "doc", "asks")
    others = F.filter(numbers("batches"), lambda b: ~F.col("asks") | (b != F.col("own_batch")))
    return asking.unionByName(dealt_out.select("centre", F.col("own_chunk").alias("chunk"), F.explode(others).alias("batch"), "doc", F.lit(False).alias("asks")))


def token_sets(texts: DataFrame, size: int) -> DataFrame:
    """doc, n and tokens (its distinct shingles) of texts (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                data, at = text_bytes(column(part, "text"))
                words, cut = word_hashes(data, at)
                sets = [shingle_set(words[a:b], size).view(np.int64) for a, b in zip(cut[:-1], cut[1:])]
                n = np.array([len(x) for x in sets], np.int64)
                tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([column(part, "doc"), pa.array(n), tokens], ["doc", "n", "tokens"])

    return texts.mapInArrow(run, "doc long, n long, tokens array<bigint>")


def rarity(sets: DataFrame, bits: int = RARITY_BITS) -> np.ndarray:
    """How many documents of sets (doc, n, tokens) have tokens of each hash of so many bits; a count of one is exact, others are no less than a token's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, n = np.unique(column(batch, "tokens").flatten().to_numpy().view(np.uint64) >> np.uint64(64 - bits), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), pa.array(n)], ["place", "n"])

    found = sets.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # 2**bits rows at most
    out = np.zeros(1 << bits, np.uint32)
    out[found["place"].to_numpy()] = np.minimum(found["n"].to_numpy(), (1 << 32) - 1)
    return out


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(doc, n, left, key): the first tokens of each document in the order (count, token), but those of one document alone; left counts the tokens from there on."""
    shift = np.uint64(64 - (len(counts).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, at = column(batch, "doc").to_numpy(), column(batch, "tokens").offsets.to_numpy()
            flat = column(batch, "tokens").values.to_numpy()
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for doc, a, b in zip(docs.tolist(), at[:-1], at[1:]):
                tokens, n = flat[a:b], int(b - a)
                often = counts[(tokens.view(np.uint64) >> shift).astype(np.int64)]
                first = np.lexsort((tokens, often))[: n - -(-percent * n // 100) + 1]
                place = np.flatnonzero(often[first] > 1)
                for c, v in zip(cols, (np.full(len(place), doc), np.full(len(place), n), n - place, tokens[first[place]])):
                    c.append(v)
            arrays = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], ["doc", "n", "left", "key"])

    return sets.mapInArrow(run, "doc long, n long, left long, key long")


def finer(sets: DataFrame, component: DataFrame, percent: int, saved: Callable[[DataFrame, str], DataFrame], meet: int = MEET) -> tuple[DataFrame, DataFrame]:
    """Pairs (centre, doc) of documents of several components that may be similar, and the documents of keys that more than meet of them share (key, doc, component, n_shingles).

    sets has doc, n and tokens; component has doc and component. Two bounds of the overlap
    drop pairs before texts are read: what is left from the first shared token on, and the
    shared tokens of the prefixes with all that may follow them.
    """
    least = lambda n: F.ceil(n * F.lit(percent) / 100).cast("long")
    rows = saved(prefixes(sets, rarity(sets), percent).join(component.hint("merge"), "doc"), "keys")
    groups = rows.groupBy("key").agg(F.count("*").alias("m"), (F.min("component") != F.max("component")).alias("several")).where("several")
    groups = saved(groups.select("key", "m"), "meetings").hint("merge")
    few = saved(rows.join(groups.where(F.col("m") <= meet), "key").select("key", "doc", "n", "component", "left"), "few")
    hot = saved(rows.join(groups.where(F.col("m") > meet), "key").select("key", "doc", "component", F.col("n").alias("n_shingles")), "hot")
    a, b = few.alias("a"), few.alias("b").hint("merge")
    enough = lambda most: (100 + percent) * most >= F.lit(percent) * (F.col("n_a") + F.col("n_b"))  # noqa: E731  most: no overlap is larger
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.doc") < F.col("b.doc")) & (F.col("a.component") != F.col("b.component"))
    met = a.join(b, apart).select(F.col("a.doc").alias("centre"), F.col("b.doc").alias("doc"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), F.least("a.left", "b.left").alias("left"))
    met = met.groupBy("centre", "doc", "n_a", "n_b").agg(F.count("*").alias("m"), F.max("left").alias("left"))
    many = saved(hot.groupBy("doc").agg(F.count("*").alias("h")), "hot_keys")
    for end, h in (("centre", "h_a"), ("doc", "h_b")):  # tokens that both may share beside those that were counted
        met = met.join(many.select(F.col("doc").alias(end), F.col("h").alias(h)).hint("merge"), end, "left").fillna(0, [h])
    shared = F.col("m") + F.least("h_a", "h_b")
    first = F.when(F.least("h_a", "h_b") == 0, F.col("left")).otherwise(F.least("n_a", "n_b"))
    met = met.where(enough(first) & enough(shared + F.greatest(least(F.col("n_a")), least(F.col("n_b"))) - 1))
    return met.select("centre", "doc"), hot


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, chunk: int = CHUNK, number: str | None = None, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text); component_id is the smallest doc_id.

    number names a column of long row numbers, fixed in a written table, which comes
    back first. Then rows of one doc_id may be in several components.
    """
    scratch: list[str] = []

    def saved(df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        scratch.append(path)
        return out

    doc_id = docs["doc_id"].cast("long")
    docs = docs.select((doc_id if number is None else docs[number]).alias("name"), doc_id.alias("doc_id"), docs["text"])
    rows = saved(sketches(docs, size), "sketches")
    sets = rows.where("n_shingles > 0 and doc_id is not null").groupBy("one", "two", "n_shingles").agg(F.min("name").alias("doc"), F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    nodes = saved(sets, "nodes")

    members = saved(dealt(stars(keyed(nodes), saved), chunk, saved), "members")
    requests = with_centres(members)
    # Candidates' texts are dealt out once. Their ids grow with the documents, so they are never broadcast.
    wanted = requests.select("doc").distinct().hint("merge")
    texts = saved(docs.where("doc_id is not null").select(F.col("name").alias("doc"), "text").join(wanted, "doc", "left_semi"), "texts")
    label, path = labels(confirmed(requests, texts, size, percent))
    scratch.append(path)

    wide = members.where("chunks > 1").select("centre", "doc")
    if wide.take(1):
        # Documents of wide stars that share a bucket but no component yet.
        open_docs = wide.select("doc").unionByName(wide.select(F.col("centre").alias("doc"))).distinct()
        keys = keyed(nodes.join(open_docs, "doc", "left_semi"))
        component = F.coalesce("component", "doc")
        mixed = keys.join(label, "doc", "left").groupBy("key").agg((F.min(component) != F.max(component)).alias("several"), F.count("*").alias("n"), F.min("doc").alias("centre")).where("several")
        placed = saved(keys.join(mixed.drop("several"), "key"), "placed")
        small = placed.where(F.col("n") <= chunk).select(F.col("key").alias("centre"), F.lit(0).alias("chunk"), "doc")
        links = confirmed(small, texts, size, percent)
        large = placed.where(F.col("n") > chunk).select("doc").distinct()
        if large.take(1):
            sets = saved(token_sets(texts.join(large.hint("merge"), "doc", "left_semi"), size), "sets")
            pairs, rest = finer(sets, large.join(label.hint("merge"), "doc", "left").select("doc", component.alias("component")), percent, saved)
            edges = pairs
            links = links.unionByName(confirmed(with_centres(dealt(edges, chunk, saved)), texts, size, percent))
            rest = saved(rest.withColumnRenamed("key", "centre"), "rest")
            if rest.take(1):
                links = links.unionByName(confirmed_asks(asks(rest, group, saved), texts, size, percent))
        label, path = labels(links.unionByName(label.select(F.col("component").alias("a"), F.col("doc").alias("b"))))
        scratch.append(path)
    by_set = nodes.join(label, "doc", "left").select("one", "two", "n_shingles", F.coalesce("component", "doc").alias("_component"))
    if number is not None:
        named = nodes.join(label, "doc", "left").select("one", "two", "n_shingles", "least", F.coalesce("component", "doc").alias("_group"))
        least = named.groupBy("_group").agg(F.min("least").alias("_component"))
        by_set = named.join(least, "_group").select("one", "two", "n_shingles", "_component")
    out = rows.select("name", "doc_id", "n_shingles", "one", "two").join(by_set, ["one", "two", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_component")).otherwise(F.col("doc_id"))
    out = out.select(*([] if number is None else [F.col("name").alias(number)]), "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    out, _ = written(out, "groups")
    dropped(docs.sparkSession, *scratch)
    return out
