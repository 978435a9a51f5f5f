"""Token counts of documents without their ids.

Documents are cut into pre-tokens block by block. A block keeps its distinct
pre-tokens once, and for each document which of them it has and how often. Each
block asks for the counts of its pre-tokens: lists of them are dealt out by the
pre-tokens' hashes, so that equal ones meet in one task, which counts each of them
once by the tokenizer. The counts are joined back to the blocks, and a document's
tokens are the sum of frequency times count. Ids are never stored, and a block is
at most BLOCK_BYTES of text (or one document), so no task holds more than that.

Nulls: a null text is an empty text with no tokens. Null and repeated doc_ids give
a row each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, slices, span_hashes, written
from .words import encoder

BLOCK_BYTES = 8 << 20
BUCKET_BITS, BUCKET_BYTES = 12, 256 << 10  # pre-tokens are dealt out by so many bits of their hash, and by more where a bucket would stand for more bytes of texts
BLOCKS = "block string, doc_ids array<bigint>, doc_bytes array<bigint>, fixed array<bigint>, sizes array<int>, steps binary, often binary, lists array<struct<bucket:int,pieces:binary>>"
LISTS = pa.list_(pa.struct([("bucket", pa.int32()), ("pieces", pa.binary())]))


def packed(values: np.ndarray) -> bytes:
    """Numbers in 2 bytes each if they fit, else in 4, compressed, with the width in front."""
    kind = np.uint16 if not len(values) or values.max() < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(values.astype(kind).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(memoryview(data)[1:]), np.uint16 if data[0] == 2 else np.uint32).astype(np.int64)


def frequency_blocks(docs: DataFrame, tokenizer: str, block_bytes: int = BLOCK_BYTES, bits: int = BUCKET_BITS) -> DataFrame:
    """One row a block: its documents, its distinct pre-tokens by bucket, and what each document has of them.

    Of a document's `sizes` pre-tokens, `steps` are the differences of their ascending numbers within the block and
    `often` their frequencies, both packed; so are a list's pieces. `fixed` is the count of texts that hold special strings; the library counts these whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, n = encoder(tokenizer), 0
        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                texts = [t or "" for t in column(part, "text").to_pylist()]
                plain = [i for i, t in enumerate(texts) if enc.plain(t)]
                line, starts, ends, hashes, cut = enc.cut([texts[i] for i in plain])
                others = sorted(set(range(len(texts))) - set(plain))
                split = {i: enc.split(texts[i]) for i in others}
                fixed = np.zeros(len(texts), np.int64)
                for i in [i for i in others if split[i] is None]:
                    fixed[i] = len(enc.tok.encode(texts[i], add_special_tokens=False).ids)
                owner = np.r_[np.repeat(np.array(plain, np.int64), cut), np.repeat(np.array(others, np.int64), [len(split[i] or ()) for i in others])].astype(np.int64)
                more = [p for i in others for p in split[i] or ()]
                unique, first, where = np.unique(np.r_[hashes, hashes_of(more)], return_index=True, return_inverse=True)
                width = max(1, len(unique))
                pairs, often = np.unique(owner * width + where, return_counts=True)
                sizes = np.bincount(pairs // width, minlength=len(texts))
                steps = np.diff(pairs % width, prepend=0)
                heads = (np.cumsum(sizes) - sizes)[sizes > 0]
                steps[heads] = (pairs % width)[heads]
                buckets = (unique >> np.uint64(64 - bits)).astype(np.int64)  # ascending, as the hashes are
                edges = np.r_[np.flatnonzero(np.diff(buckets, prepend=-1)), len(unique)]
                pieces = [line[starts[k] : ends[k]] if k < len(starts) else more[k - len(starts)] for k in first.tolist()]
                lists = [{"bucket": int(buckets[a]), "pieces": zlib.compress("\0".join(pieces[a:b]).encode(), 1)} for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                values = [f"{TaskContext.get().partitionId()}-{n}", column(part, "doc_id").to_pylist(), [len(t.encode()) for t in texts], fixed.tolist(), sizes.tolist(), packed(steps), packed(often), lists]
                types = [pa.string(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), pa.binary(), pa.binary(), LISTS]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["block", "doc_ids", "doc_bytes", "fixed", "sizes", "steps", "often", "lists"])
                n += 1

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, BLOCKS)


def hashes_of(pieces: list[str]) -> np.ndarray:
    """The hashes that Encoder.cut() gives to these pre-tokens."""
    sizes = np.array([len(p.encode("utf-16-le")) // 2 for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    return span_hashes(np.frombuffer("".join(pieces).encode("utf-16-le"), "<u2"), ends - sizes, ends)


def piece_counts(lists: DataFrame, tokenizer: str) -> DataFrame:
    """lists (block, bucket, pieces) with n, packed, in place of the pieces: how many tokens the tokenizer makes of each.

    All lists of a bucket come to one task, one after the other, which counts each distinct
    pre-token once and holds those of one bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, now, known = encoder(tokenizer), None, {}
        for batch in batches:
            wanted = [zlib.decompress(p).decode().split("\0") for p in column(batch, "pieces").to_pylist()]
            buckets = column(batch, "bucket").to_numpy()
            edges, n = [*np.flatnonzero(np.diff(buckets, prepend=-1)).tolist(), len(buckets)], []
            for a, b in zip(edges[:-1], edges[1:]):
                if buckets[a] != now:
                    now, known = buckets[a], {}
                new = list({p for pieces in wanted[a:b] for p in pieces if p not in known})
                known.update(zip(new, map(len, enc.piece_ids(new))))
                n += [packed(np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))) for pieces in wanted[a:b]]
            yield pa.RecordBatch.from_arrays([column(batch, "block"), column(batch, "bucket"), pa.array(n, pa.binary())], ["block", "bucket", "n"])

    return lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "block string, bucket int, n binary")


def token_counts(docs: DataFrame, tokenizer: str, block_bytes: int = BLOCK_BYTES, bits: int | None = None) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each document. bits of a hash name a pre-token's bucket; without them they follow from the bytes of the texts."""
    if bits is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = max(BUCKET_BITS, math.ceil(math.log2(max(1, total / BUCKET_BYTES))))
    blocks, path = written(frequency_blocks(docs, tokenizer, block_bytes, bits), "blocks")
    counts = piece_counts(blocks.select("block", F.inline("lists")), tokenizer)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        n = np.concatenate([unpacked(b.as_py()) for b in right.sort_by("bucket")["n"]] or [np.zeros(0, np.int64)])
        for row in left.to_batches():
            for i in range(row.num_rows):
                got = {c: column(row, c)[i] for c in ("doc_ids", "doc_bytes", "fixed", "sizes", "steps", "often")}
                sizes = got["sizes"].values.to_numpy().astype(np.int64)
                ends = np.cumsum(sizes)
                steps = np.cumsum(unpacked(got["steps"].as_py()))
                heads = (ends - sizes)[sizes > 0]
                base = np.repeat(np.r_[0, steps[heads[1:] - 1]] if len(heads) else heads, sizes[sizes > 0])
                terms = np.r_[0, np.cumsum(n[steps - base] * unpacked(got["often"].as_py()))]
                totals = terms[ends] - terms[ends - sizes] + got["fixed"].values.to_numpy()
                out.append(pa.table([got["doc_ids"].values, got["doc_bytes"].values, pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 3, ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.sparkSession.read.schema(blocks.schema).parquet(path).drop("lists")  # a second reading has columns of its own
    return slim.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, "doc_id long, n_bytes long, n_tokens long")
