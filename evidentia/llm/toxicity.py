"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with marks for its start and end);
every n-gram has a vector, hashed into BUCKETS rows. A span of SPAN words is the
mean of its words, a word the mean of its n-grams, and a softmax over the mean
gives the two classes. Spans make the score independent of a document's length: a
document's score is the softmax's probability for its most toxic span. Labels are
known for documents only, so training alternates between choosing the spans of toxic
documents that stand out from all spans of clean documents, and fitting vectors and
softmax together on the chosen spans, on misspelt copies of them, on random spans of
clean documents and on their worst ones. Its last step fits the softmax's length and
bias once more, to the worst span of each document. Misspellings that were never
seen share n-grams with known words and so their vectors.

Fitting takes a bounded sample: at most SAMPLE labelled documents of each class,
the first by a hash of their id, of those whose text is there and not over LONGEST
bytes. N-grams in fewer than LEAST_DOCS documents of the sample keep a zero vector:
nothing is learnt from them. Scoring reads every whole text; vectors and softmax fold
into one number an n-gram, so it needs no matrix product.

Nulls and texts without words get the score of an empty span. Rows of any doc_id,
null or repeated, are scored alike; of a repeated id the least text is learnt. A null
label, and a label for an id that isn't there, teach nothing. If one class is missing
nothing can be told apart: all scores are 0, and fit() gives a RuntimeWarning. An empty
table gives an empty result. Labels and other columns are never inputs of a score.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, column, set_apart, slices, span_hashes

SAMPLE = 1500
LONGEST = 32_768
SPAN = 4
SIZES = (3, 4, 5)
BUCKETS = 1 << 18
WIDTH = 16
LEAST_DOCS = 4  # n-grams in fewer documents of the sample keep a vector of zeros
CLEAN = 4.0  # weight of clean documents in the softmax's last fitting
ROUNDS = 6
HARD = 2  # times that a clean document's worst span is learnt in a round
MEMO = 1_000_000

_SEPARATORS = set("\0.,;:?!\"'()[]{}<>|/\\-–—…«»¿¡“”„‘’`_=~^")
WORDS = np.array([not (chr(i).isspace() or chr(i) in _SEPARATORS or 0xD800 <= i < 0xE000) for i in range(1 << 16)])


def word_spans(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts as one line, the words' first and end characters in it, and the n + 1 offsets of the texts' words."""
    low = [(t or "").replace("\0", " ").lower() for t in texts]
    line = "\0".join(low) + "\0"
    c = np.frombuffer(line.encode("utf-32-le", "replace"), "<u4")
    word = WORDS[np.minimum(c, 0xFFFF)] | (c > 0xFFFF)
    edges = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    at = np.r_[0, np.cumsum([len(t) + 1 for t in low])]
    return line, starts, ends, np.searchsorted(starts, at)


def ngrams(words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and the n + 1 offsets of each word's; done in parts to bound memory."""
    parts = [part_ngrams(words[i : i + at_once]) for i in range(0, len(words), at_once)] or [(np.zeros(0, np.int32), np.zeros(1, np.int64))]
    sizes = np.concatenate([np.diff(cut) for _, cut in parts])
    return np.concatenate([b for b, _ in parts]), np.r_[0, np.cumsum(sizes)]


def part_ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    marked = [f"\1{w}\2" for w in words]
    c = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), "<u4")
    lengths = np.array([len(w) for w in marked], np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = ends[owner] - np.arange(len(c)) if len(c) else np.zeros(0, np.int64)
    found, whose = [], []
    for n in SIZES:
        starts = np.flatnonzero(left >= n)
        found.append(span_hashes(c, starts, starts + n))
        whose.append(owner[starts])
    found.append(span_hashes(c, ends - lengths, ends))  # the whole word
    whose.append(np.arange(len(words)))
    whose = np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return (np.concatenate(found)[order] % np.uint64(BUCKETS)).astype(np.int32), np.searchsorted(whose[order], np.arange(len(words) + 1))


def values_of(gram: np.ndarray, buckets: np.ndarray, cut: np.ndarray, at_once: int = 50_000) -> np.ndarray:
    """Mean of the numbers of each word's n-grams."""
    out = np.zeros(len(cut) - 1)
    for i in range(0, len(out), at_once):
        c = cut[i : i + at_once + 1]
        sums = np.r_[0, np.cumsum(gram[buckets[c[0] : c[-1]]], dtype=np.float64)]
        out[i : i + at_once] = (sums[c[1:] - c[0]] - sums[c[:-1] - c[0]]) / np.maximum(np.diff(c), 1)
    return out


def top_spans(values: np.ndarray, at: np.ndarray, size: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """The largest mean over `size` words in a row of each text, and where it begins; a shorter text is one span, none gives 0."""
    sums = np.r_[0, np.cumsum(values)]
    n = np.diff(at)
    best, where = np.zeros(len(n)), at[:-1].copy()
    short = n < size
    best[short] = (sums[at[1:]] - sums[at[:-1]])[short] / np.maximum(n[short], 1)
    if len(values) >= size and not short.all():
        spans = (sums[size:] - sums[:-size]) / size
        edge = np.stack([at[:-1][~short], at[1:][~short] - size + 1], 1).ravel()
        padded = np.r_[spans, -np.inf]
        best[~short] = np.maximum.reduceat(padded, edge)[::2]
        for i in np.flatnonzero(~short):
            where[i] = at[i] + int(spans[at[i] : at[i + 1] - size + 1].argmax())
    return best, where


@dataclass
class Model:
    """The softmax folded into the vectors: one number for each n-gram bucket, whose mean over a span plus shift is the span's log odds."""

    gram: np.ndarray
    shift: float
    known: Memo | None = None

    def word_values(self, words: list[str]) -> np.ndarray:
        return values_of(self.gram, *ngrams(words))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.known is None or self.known.full():
            self.known = Memo(np.float64, MEMO)
        line, starts, ends, at = word_spans(texts)
        c = np.frombuffer(line.encode("utf-32-le", "replace"), "<u4")
        unique, first, where = np.unique(span_hashes(c, starts, ends), return_index=True, return_inverse=True)
        value, new = self.known.found(unique)
        if len(new):
            value[new] = self.word_values([line[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            self.known.add(unique[new], value[new])
        best = top_maxima(value[where], at)
        return 1 / (1 + np.exp(-np.clip(best + self.shift, -60, 60)))


def top_maxima(values: np.ndarray, at: np.ndarray, size: int = SPAN) -> np.ndarray:
    """The first result of top_spans() alone."""
    sums = np.r_[0, np.cumsum(values)]
    n = np.diff(at)
    short = n < size
    best = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1)
    if not short.all():
        spans = np.r_[(sums[size:] - sums[:-size]) / size, -np.inf]
        edge = np.stack([at[:-1][~short], at[1:][~short] - size + 1], 1).ravel()
        best[~short] = np.maximum.reduceat(spans, edge)[::2]
    return best


def misspelt(word: str, rng: np.random.Generator) -> str:
    """The word with one letter changed, doubled, left out, or swapped with the next."""
    if len(word) < 4:
        return word
    i, letter = int(rng.integers(0, len(word))), "abcdefghijklmnopqrstuvwxyz0123456789@$*"[int(rng.integers(0, 39))]
    return (word[:i] + letter + word[i + 1 :], word[: i + 1] + word[i:], word[:i] + word[i + 1 :], word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :])[int(rng.integers(0, 4))]


def fit(texts: list[str], toxic: np.ndarray, seed: int = 1, rounds: int = ROUNDS, epochs: int = 4, rate: float = 0.3) -> Model:
    """A model from texts and their labels (1: toxic)."""
    rng = np.random.default_rng(seed)
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        warnings.warn("the sample has documents of one class at most: every score will be 0", RuntimeWarning, stacklevel=2)
        return Model(np.zeros(BUCKETS, np.float32), -60.0)
    line, starts, ends, at = word_spans(texts)
    c = np.frombuffer(line.encode("utf-32-le", "replace"), "<u4")
    _, first, word = np.unique(span_hashes(c, starts, ends), return_index=True, return_inverse=True)
    vocabulary = [line[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    buckets, cut = ngrams(vocabulary)
    in_docs = np.zeros(BUCKETS, np.int64)  # in how many documents an n-gram occurs
    for a, b in zip(at[:-1], at[1:]):
        ws = np.unique(word[a:b])
        n = cut[ws + 1] - cut[ws]
        in_docs[np.unique(buckets[np.repeat(cut[ws] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])] += 1
    trained = in_docs >= LEAST_DOCS

    vectors = (rng.standard_normal((BUCKETS, WIDTH)) * 0.05).astype(np.float32) * trained[:, None]
    softmax, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    squares, squares_s = np.full(BUCKETS, 1e-3, np.float32), np.full((WIDTH, 2), 1e-3, np.float32)
    extra: list[str] = []  # misspelt words
    limit = len(vocabulary)
    long_enough = np.flatnonzero(np.diff(at) > 0)

    def spans_of(docs: np.ndarray, each: int) -> list[np.ndarray]:
        out = []
        for d in docs:
            n = at[d + 1] - at[d]
            for b in at[d] + rng.integers(0, max(1, n - SPAN + 1), each):
                out.append(word[b : min(b + SPAN, at[d + 1])])
        return out

    def train(spans: list[np.ndarray], labels: np.ndarray, passes: int) -> None:
        nonlocal vectors, softmax, bias, squares, squares_s
        all_buckets, all_cut = buckets, cut
        if extra:
            more, more_cut = ngrams(extra)
            all_buckets, all_cut = np.r_[buckets, more], np.r_[cut, more_cut[1:] + cut[-1]]
        for _ in range(passes):
            order = rng.permutation(len(spans))
            for lo in range(0, len(order), 256):
                batch = order[lo : lo + 256]
                lens = np.array([len(spans[i]) for i in batch])
                ws = np.concatenate([spans[i] for i in batch])
                n = all_cut[ws + 1] - all_cut[ws]
                flat = all_buckets[np.repeat(all_cut[ws] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                row = np.repeat(np.repeat(np.arange(len(batch)), lens), n)
                share = np.repeat(1 / (n * np.repeat(lens, lens)), n)
                known = trained[flat]
                flat, row, share = flat[known], row[known], share[known].astype(np.float32)
                x = np.zeros((len(batch), WIDTH), np.float32)
                for j in range(WIDTH):
                    x[:, j] = np.bincount(row, vectors[flat, j] * share, len(batch))
                z = x @ softmax + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(batch)), labels[batch]] -= 1
                g = x.T @ p / len(batch) * 8
                squares_s += g * g
                back = p @ softmax.T
                softmax = softmax - rate * g / np.sqrt(squares_s)
                bias = bias - rate * p.mean(0)
                used, slot = np.unique(flat, return_inverse=True)
                step = np.stack([np.bincount(slot, back[row, j] * share, len(used)) for j in range(WIDTH)], 1).astype(np.float32)
                squares[used] += (step * step).mean(1)
                vectors[used] -= rate * step / np.sqrt(squares[used])[:, None]

    def word_values() -> np.ndarray:
        return values_of(vectors @ (softmax[:, 1] - softmax[:, 0]), buckets, cut)

    softmax += rng.standard_normal(softmax.shape).astype(np.float32) * 0.5
    bad, good = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    bad, good = bad[np.isin(bad, long_enough)], good[np.isin(good, long_enough)]
    if not len(bad) or not len(good):
        warnings.warn("one class of the sample has no words: every score will be 0", RuntimeWarning, stacklevel=2)
        return Model(np.zeros(BUCKETS, np.float32), -60.0)
    positive = spans_of(bad, min(max(1, 16_000 // len(bad)), 64))
    empty = [np.zeros(0, word.dtype)] * 16  # texts without words
    for turn in range(rounds):
        negative = spans_of(good, max(1, min(64, 24_000 // len(good)))) + empty
        if turn:  # clean documents are judged by their worst span, so that is what they teach
            _, where = top_spans(word_values()[word], at)
            negative += [word[where[d] : min(where[d] + SPAN, at[d + 1])] for d in good] * HARD
        labels = np.r_[np.ones(len(positive), np.int64), np.zeros(len(negative), np.int64)]
        train(positive + negative, labels, epochs if turn < 2 else 1)
        values = word_values()
        best, where = top_spans(values[word], at)
        bar = np.quantile(best[good], 0.98)
        chosen = [(d, where[d]) for d in bad if best[d] > bar] or [(d, where[d]) for d in bad]
        positive, extra = [], []
        for d, b in chosen:
            span = word[b : min(b + SPAN, at[d + 1])]
            positive += [span] * 2
            worst = np.argsort(values[span])[-2:]
            for _ in range(4):
                changed = span.copy()
                for w in worst[-int(rng.integers(1, 3)) :]:
                    extra.append(misspelt(vocabulary[span[w]], rng))
                    changed[w] = limit + len(extra) - 1
                positive.append(changed)
    gram = vectors @ (softmax[:, 1] - softmax[:, 0])
    every = np.r_[values, values_of(gram, *ngrams(extra))]
    changed = np.array([every[x].mean() for x in positive if (x >= limit).any()])
    scale, shift = fitted_softmax(np.r_[best, changed], np.r_[toxic, np.ones(len(changed), bool)])
    return Model((gram * scale).astype(np.float32), shift)


def fitted_softmax(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The length of the softmax's weights and its bias that fit the log odds x of documents' worst spans best, with a slight pull; clean rows weigh CLEAN times as much together."""
    spread = max(float(x.std()), 1e-9)
    a, b = np.c_[x / spread, np.ones(len(x))], np.zeros(2)
    weight = np.where(y, 1 / max(1, y.sum()), CLEAN / max(1, (~y).sum())) / (1 + CLEAN)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        pull = np.array([1e-3, 0])
        step = np.linalg.solve((a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(pull + 1e-9), a.T @ (weight * (p - y)) + pull * b)
        b = b - np.clip(step, -2, 2)
    return float(b[0] / spread), float(b[1])


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most `sample` documents of each class, by a hash of their id."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.where(F.octet_length("text") <= longest)
    there = short.select("doc_id").distinct().join(usable, "doc_id")
    ids = None
    for kind in (0, 1):
        part = there.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = part if ids is None else ids.unionByName(part)
    ids = docs.sparkSession.createDataFrame(ids.collect(), "doc_id long, toxic int")  # 2 * sample rows at most
    rows = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    return [r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.int64)


def toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs and score; a kept column of that name is called score_in."""
    docs, names = set_apart(docs, ("score",))
    keep = tuple(names[c] for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast((model.gram, model.shift))  # one number a bucket
    slim = docs.select(*keep, *([] if "text" in keep else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                score = pa.array(scorer.scores(column(part, "text").to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*[column(part, c) for c in keep], score], [*keep, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return slim.mapInArrow(run, f"{fields}, score double")
