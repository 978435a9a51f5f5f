"""Packing of documents into fixed sequences by first-fit decreasing.

Texts are cut into pieces of a whole sequence and one rest. A whole piece is a
sequence of its own; the rests are dealt at random into groups of about GROUP, and
each group is packed alone: longest first, each into the leftmost open sequence that
has room, which a tournament tree over the sequences' free space finds in log time.
A group is one task's small table of lengths, however large the corpus: rows are
dealt by a row number that a written table fixes, so equal rows part as well.

Nulls: a null text is an empty text (the end id alone). A null or repeated doc_id
is packed like any other row. An empty table gives an empty result. Ties of
length go by doc_id and start, then by the order within the group. Other columns
of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, set_apart, slices, written
from .words import encoder

GROUP = 20_000  # rests for each group, about


def pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int | None = None) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (uint32, little-endian) of each piece of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        tail = [] if end_id is None else [end_id]
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                names, starts, sizes, totals, ids = [], [], [], [], []
                for name, got in zip(column(part, "doc_id").to_pylist(), enc.ids(column(part, "text").to_pylist())):
                    got = np.append(got, tail).astype("<u4")
                    for at in range(0, len(got), length):
                        names.append(name)
                        starts.append(at)
                        sizes.append(min(length, len(got) - at))
                        totals.append(len(got))
                        ids.append(got[at : at + length].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((names, pa.int64()), (starts, pa.int64()), (sizes, pa.int64()), (totals, pa.int64()), (ids, pa.binary()))], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; sizes are in descending order and none exceeds the capacity.

    tree[1] is the most room of all bins, and the children of node i are 2i and 2i + 1.
    """
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [0] * (2 * leaves)
    for i in range(leaves, leaves + n):
        tree[i] = capacity
    for i in range(leaves - 1, 0, -1):
        tree[i] = max(tree[2 * i], tree[2 * i + 1])
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, size in enumerate(sizes.tolist()):
        i = 1
        while i < leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        bins[k], offsets[k] = i - leaves, capacity - tree[i]
        tree[i] -= size
        while i > 1:
            i //= 2
            left, right = tree[2 * i], tree[2 * i + 1]
            most = left if left > right else right
            if tree[i] == most:
                break
            tree[i] = most
    return bins, offsets


def pack(rows: DataFrame, capacity: int, groups: int | None = None, seed: int = 7, group: int = GROUP) -> DataFrame:
    """rows (doc_id, start, length and any others) with sequence_id and offset.

    length must lie between 1 and capacity. A column of rows whose name the result
    needs is called name_in. A sequence's pieces fill it from 0 without gaps.
    sequence_id is unique: for rests the group's number times 2**32 plus the
    sequence's number within the group, for whole pieces a negative number. Without
    `groups` there is one for each `group` rests.
    """
    rows, _ = set_apart(rows, ("sequence_id", "offset", "_group", "_row"))
    own = rows.columns
    rows, _ = written(rows.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    rests = rows.where(F.col("length") < capacity)
    groups = groups or max(1, -(-rests.count() // group))
    dealt = rests.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(groups)).cast("int")).drop("_row")

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]))
        bins, offsets = first_fit_decreasing(t["length"].to_numpy(), capacity)
        first = t["_group"][0].as_py() << 32
        return t.drop_columns("_group").append_column("sequence_id", pa.array(bins + first, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_row")
    packed = dealt.groupBy("_group").applyInArrow(run, f"{fields}, sequence_id long, offset long")
    alone = rows.where(F.col("length") >= capacity).select(*[F.col(f"`{c}`") for c in own], (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(packed)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int | None = None, group: int = GROUP) -> DataFrame:
    """Pieces of all documents with their ids and places; see pack().

    A group then holds its pieces' ids: GROUP rests of half a sequence take about
    160 MB, so choose smaller groups where executors are small.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity, group=group)
