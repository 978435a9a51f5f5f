"""Identities and fingerprints as columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed(*parts: Column) -> Column:
    """Parts in one text from which each can be told: nulls differ from empty texts."""
    return F.array_join(F.array(*[F.coalesce(F.concat(F.lit("="), F.replace(F.replace(p.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))), F.lit("~")) for p in parts]), "|")


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha1(keyed(*parts)), 1, 16)


def canonical_id(*parts: Column) -> Column:
    return F.substring(F.sha2(keyed(*parts), 256), 1, 20)


def canonical_json(*names: str) -> Column:
    """The named columns as JSON in the order of their names, with nulls."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]), {"ignoreNullFields": "false"})


def row_hash(*names: str) -> Column:
    return F.sha2(canonical_json(*names), 256)


def fingerprint(df: DataFrame, key: str, *names: str) -> DataFrame:
    """One row: how many rows, and a hash that ignores their order and layout.

    Each row is hashed with its key; the hashes are added in 16 lanes of 16 bits,
    so partial sums combine and nothing has to be sorted or brought together.
    """
    h = F.sha2(F.concat_ws("\u001f", F.col(key).cast("string"), *[F.coalesce(F.col(n).cast("string"), F.lit("\u0000")) for n in sorted(names)]), 256)
    lanes = [F.sum(F.conv(F.substring("h", 4 * i + 1, 4), 16, 10).cast("long")).alias(f"l{i}") for i in range(16)]
    sums = df.select(h.alias("h")).agg(F.count("*").alias("n_rows"), *lanes)
    return sums.select("n_rows", F.sha2(F.concat_ws(",", *[F.coalesce(F.col(f"l{i}"), F.lit(0)).cast("string") for i in range(16)]), 256).alias("fingerprint"))


def joined_md5(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_rows and the MD5 of the lines of one partition with commas between, without the nulls; for mapInArrow."""
    n, digest, begun = 0, hashlib.md5(), False
    for batch in batches:
        n += batch.num_rows
        lines = [x for x in batch.column(0).to_pylist() if x is not None]
        if lines:
            digest.update((("," if begun else "") + ",".join(lines)).encode())
            begun = True
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], ["n_rows", "digest"])
