"""Token ids as compact binary blocks: canonical length-limited Huffman codes.

``write_token_table`` encodes documents, counts every id over the whole corpus,
fits one canonical code (package-merge under a length limit) and writes blocks
of whole documents in ascending document order. A block can be read alone: it
carries the order of its documents, the place of its first id in the corpus and
a bit-offset checkpoint every CHECKPOINT ids. ``read_token_table`` decodes all
lanes between checkpoints side by side from one lookup table.

The table is a Parquet dataset, so task retries and lost executors are covered
by Spark's commit protocol:

    blocks    shard INT, block INT, first LONG, n_ids LONG, doc_ids ARRAY<LONG>, doc_lens ARRAY<LONG>, marks BINARY, bits BINARY
    codebook  lengths BINARY   one byte for each id: its code length, 0 for an unused id

Nulls: a null text is an empty text and becomes the end id alone; a null id sorts
first. Repeated ids are kept and ordered by a hash of their text. An empty table gives an
empty dataset. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_array, column, dropped, shared_folder, slices, written
from .words import encoder

CHECKPOINT = 128  # ids between two bit offsets
BLOCK = 1 << 17  # ids after which a block is closed, at a document's end
LIMIT = 18  # longest code in bits; the decoding table has 2**LIMIT rows

BLOCKS = "shard int, block int, first long, n_ids long, doc_ids array<bigint>, doc_lens array<bigint>, marks binary, bits binary"


# ---------------------------------------------------------------- the code
def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code lengths of least total size under the limit, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    rows, prev = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weights, prev])
        at = np.argsort(both, kind="stable")
        rows.append(at < n)  # which of the merged row are single ids
        both = both[at]
        prev = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    lengths = np.zeros(n, np.int64)
    take = 2 * (n - 1)
    for single in reversed(rows):
        singles = int(single[:take].sum())
        lengths[:singles] += 1
        take = 2 * (take - singles)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id: ascending by length, then by id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        top = int(lengths.max())
        steps = np.left_shift(np.uint64(1), (top - lengths[order]).astype(np.uint64))
        full = np.cumsum(steps) - steps
        codes[order] = full >> (top - lengths[order]).astype(np.uint64)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each prefix of `top` bits: the id that begins it and that id's code length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    top = int(lengths.max()) if len(order) else 1
    spans = 1 << (top - lengths[order].astype(np.int64))
    ids, lens = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.uint8)
    filled = int(spans.sum()) if len(order) else 0
    ids[:filled] = np.repeat(order, spans)
    lens[:filled] = np.repeat(lengths[order], spans)
    return ids, lens, top


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ids end to end, and the bit offset of every CHECKPOINT-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    if not len(ids):
        return b"", np.zeros(0, np.uint32)
    starts = ends - size
    words = np.zeros(int(ends[-1] + 63) // 64 + 1, np.uint64)
    word, room = starts >> 6, 64 - (starts & 63) - size
    code = codes[ids]
    high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[first]] = np.bitwise_or.reduceat(high, first)
    over = np.flatnonzero(room < 0)  # at most one code crosses into each word
    words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    marks = starts[::CHECKPOINT]
    return words.astype(">u8").tobytes()[: int(ends[-1] + 7) // 8], marks.astype("<u4" if ends[-1] < 1 << 32 else "<u8")


def read_marks(data: bytes, n_ids: int) -> np.ndarray:
    """The bit offsets of a block of n_ids ids: four bytes each, or eight in a block of half a gigabyte and more."""
    return np.frombuffer(data, "<u8" if len(data) > 4 * -(-n_ids // CHECKPOINT) else "<u4")


def unpack_bits(bits: bytes, marks: np.ndarray, n_ids: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of a block: one lane for each checkpoint, all lanes step together."""
    ids, lens, top = table
    words = np.frombuffer(bits + bytes(16 + -len(bits) % 8), ">u8").astype(np.uint64)
    lanes = len(marks)
    out = np.zeros((CHECKPOINT, lanes), np.uint32)
    at = marks.astype(np.int64)
    last = n_ids - (lanes - 1) * CHECKPOINT if lanes else 0
    for step in range(CHECKPOINT if lanes > 1 else last):
        if step == last:  # the last lane is over
            at = at[: lanes - 1]
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        window = (words[word] << shift) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - shift))
        key = window >> np.uint64(64 - top)
        out[step, : len(at)] = ids[key]
        at = at + lens[key]
    return out.T.reshape(-1)[:n_ids]


# ---------------------------------------------------------------- Spark side
SCRATCH = "shard int, block int, first long, n_ids long, doc_ids array<bigint>, doc_lens array<bigint>, width int, ids binary"


def raw_ids(data, width: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if width == 2 else "<u4")


def id_blocks(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """Blocks of the ids of whole texts (2 or 4 bytes each); `first` counts from the start of the shard.

    docs is dealt out by ranges of doc_id and sorted; a shard is what one task gets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        kind = np.dtype("<u2" if enc.width == 2 and (end_id or 0) < 1 << 16 else "<u4")
        tail = [] if end_id is None else [end_id]
        block, first, ids, names = 0, 0, [], []

        def close() -> pa.RecordBatch:
            nonlocal block, first, ids, names
            lens = [len(x) for x in ids]
            values = ([shard], [block], [first], [sum(lens)], [names], [lens], [kind.itemsize], [np.concatenate(ids).tobytes()])
            row = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, SCRATCH_TYPES)], SCRATCH_NAMES)
            block, first, ids, names = block + 1, first + sum(lens), [], []
            return row

        held = 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for name, got in zip(column(part, "doc_id").to_pylist(), enc.ids(column(part, "text").to_pylist())):
                    ids.append(np.append(got, tail).astype(kind))
                    names.append(name)
                    held += len(ids[-1])
                    if held >= BLOCK:
                        yield close()
                        held = 0
        if ids:
            yield close()

    return docs.mapInArrow(run, SCRATCH)


SCRATCH_NAMES = ["shard", "block", "first", "n_ids", "doc_ids", "doc_lens", "width", "ids"]
SCRATCH_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary()]


def id_counts(blocks: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents; as many numbers as the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 17, np.int64)
        for batch in batches:
            for data, width in zip(column(batch, "ids"), column(batch, "width").to_pylist()):
                got = np.bincount(raw_ids(data.as_buffer(), width), minlength=len(total))
                got[: len(total)] += total
                total = got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    rows = blocks.select("ids", "width").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r["id"] for r in rows], default=-1) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_token_table(docs: DataFrame, tokenizer: str, end_id: int | None = None, path: str | None = None) -> str:
    """Writes the token table of docs (doc_id, text) and returns its path.

    Ranges of doc_id are dealt out once, as text, and encoded where they land;
    the codes need the counts of the whole corpus, so the ids wait in a scratch
    table meanwhile. What reaches the driver are one count for each id of the
    vocabulary and one sum for each shard.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tokens"
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    order = ["doc_id", F.xxhash64("text")]
    blocks, scratch = written(id_blocks(docs.repartitionByRange(*order).sortWithinPartitions(*order), tokenizer, end_id), "ids")

    lengths = code_lengths(id_counts(blocks))
    firsts, seen = {}, 0
    for r in sorted(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()):
        firsts[r["shard"]], seen = seen, seen + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes = canonical(lengths), lengths.astype(np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                shard, width = column(row, "shard")[0].as_py(), column(row, "width")[0].as_py()
                bits, marks = pack_bits(raw_ids(column(row, "ids")[0].as_buffer(), width).astype(np.int64), codes, sizes)
                first = pa.array([firsts[shard] + column(row, "first")[0].as_py()], pa.int64())
                kept = [column(row, c) for c in ("shard", "block")], [column(row, c) for c in ("n_ids", "doc_ids", "doc_lens")]
                yield pa.RecordBatch.from_arrays([*kept[0], first, *kept[1], pa.array([marks.tobytes()], pa.binary()), pa.array([bits], pa.binary())], ["shard", "block", "first", "n_ids", "doc_ids", "doc_lens", "marks", "bits"])

    blocks.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    dropped(spark, scratch)
    return path


def read_token_table(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (uint32, little-endian) of each document of a token table."""
    lengths = np.frombuffer(bytes(spark.read.schema("lengths binary").parquet(f"{path}/codebook").first()["lengths"]), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = decoding_table(lengths)
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_bits(r["bits"], read_marks(r["marks"], r["n_ids"]), r["n_ids"], lookup).astype("<u4")
                ends = np.cumsum(r["doc_lens"])
                starts = ends - r["doc_lens"]
                raw = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["first"], pa.int64()), pa.array(r["doc_lens"], pa.int64()), binary_array([bytes(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)])], ["doc_id", "start", "n_tokens", "ids"])

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
