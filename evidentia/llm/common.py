"""Helpers shared by the training-data operators.

Everything that has to outlive a task is a Parquet table under the folder that
the session names in ``spark.checkpoint.dir``; nothing is kept in executors'
local folders, so a lost executor only means that its tasks run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..scratch import dropped, shared_folder, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_apart(df: DataFrame, taken: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns whose names a result needs renamed to name_in, and how each column is called now."""
    taken, names = {t.lower() for t in taken}, {}
    others = {c.lower() for c in df.columns}
    for c in df.columns:
        new = c
        while new.lower() in taken or (new != c and new.lower() in others):
            new += "_in"
        names[c] = new
    return df.select(*[df[f"`{c}`"].alias(new) for c, new in names.items()]), names


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about max_bytes of the column each, one row at least."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // max_bytes
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.r_[0, edges], np.r_[edges, batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def binary_array(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end (null: empty) and the n + 1 offsets of its rows."""
    col = col.fill_null("").cast(pa.large_string()) if col.null_count else col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(col) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Memo:
    """What is known of 64-bit hashes, in two sorted arrays: 16 bytes an entry, where a dict takes ten times as much."""

    def __init__(self, kind: type, most: int):
        self.kind, self.most = kind, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, self.kind)

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of ascending distinct keys, and the places of those that are not known."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        values = np.zeros(len(keys), self.kind)
        values[known] = self.values[at[known]]
        return values, np.flatnonzero(~known)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values = np.insert(self.keys, at, keys), np.insert(self.values, at, values)

    def full(self) -> bool:
        return len(self.keys) > self.most


PIECE = 1 << 20  # bytes of text that are worked on at once
LONG = 128  # bytes; longer spans are hashed by BLAKE2b


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans of an array of 1, 2 or 4 bytes an item.

    A span's bytes are taken eight at a time into a chain of bijective scrambles, so
    spans of up to eight bytes and one length never meet, and longer ones meet only by
    chance (about n * n / 2**65 for n distinct spans), whatever their pattern. Spans
    over LONG bytes are hashed by BLAKE2b.
    """
    width = data.dtype.itemsize
    first, size = np.asarray(starts, np.int64) * width, (np.asarray(ends, np.int64) - starts) * width
    out = mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(out):
        return out
    raw = np.ascontiguousarray(data).view(np.uint8)
    padded = np.r_[raw, np.zeros(8, np.uint8)]
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    short = np.flatnonzero((size > 0) & (size <= LONG))
    for at in range(0, LONG, 8):
        if not len(short):
            break
        left = size[short] - at
        block = eight[first[short] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * np.maximum(8 - left, 0)).astype(np.uint64))
        out[short] = mix64(out[short] ^ block)
        short = short[left > 8]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[first[i] : first[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return out
