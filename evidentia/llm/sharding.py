"""Sharding by extendible hashing, in DataFrame functions alone.

A row's place is a 60-bit hash of its key. The directory is indexed by the first
bits of the place: a bucket whose bytes exceed the limit is split on its next
bit, all others stay as they are. Sums are taken per prefix, STEP bits at a time,
over the distinct places and their sizes (a table written once) of buckets that are
still too large. So a round gathers 2**STEP sums for each such bucket, however many rows
it has, and never reads a payload; payloads are joined to their shards once, at the end.

Rows that share a whole place (copies of one key, or one row over the limit) can't be
parted by more bits. Once their bucket has no other place, it takes all bits without a
look at those between, and they fill overflow pages of their bucket by a running sum that is taken in two
levels (chunks of rows, then rows of a chunk), so no key's rows meet in one task.

Nulls: a null key hashes as the empty text and a null payload is 0 bytes. An
empty table has no shards. Repeated rows are kept. Other columns pass through; one
whose name the result needs is called name_in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, set_apart, written

BITS = 60
STEP = 4  # bits that one round looks at: 16 sums for each bucket that is still too large
CHUNK = 4096  # rows of one partition whose sizes are summed together
ADDED = ("n_bytes", "place", "depth", "shard", "page", "shard_bytes")


def place(key: Column) -> Column:
    """The first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def shifted(value: str, by: str | int) -> Column:
    return F.expr(f"shiftright({value}, cast({by} as int))")


def directory(places: DataFrame, limit: int) -> tuple[DataFrame, list[str]]:
    """For a written table of distinct places and their sizes: place, depth and shard_bytes of each, and the tables to drop later.

    A bucket of one place that exceeds the limit ends at the last bit at once, as no bit before parts it.
    """
    left, base, paths, done = places, 0, [], []
    while True:
        top = min(BITS, base + STEP)
        sums = left.groupBy(shifted("place", BITS - top).alias("cell")).agg(F.sum("size").alias("size"), F.min("place").alias("low"), F.max("place").alias("high"))
        nodes = sums.select("*", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth")).withColumn("prefix", shifted("cell", f"{top} - depth"))
        within = nodes.groupBy("depth", "prefix").agg(F.sum("size").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("cell").alias("cells"))
        shard = lambda depth: F.struct(depth.alias("depth"), F.col("bytes").alias("shard_bytes"))
        leaf = F.when(F.col("bytes") <= limit, shard(F.col("depth"))).when(F.col("low") == F.col("high"), shard(F.lit(BITS)))
        found, one = written(within.select(F.explode("cells").alias("cell"), leaf.alias("leaf")).groupBy("cell").agg(F.min("leaf").alias("leaf")), f"cells{top}")
        told = left.join(found.hint("merge"), shifted("place", BITS - top) == F.col("cell")).select("place", "size", "leaf.depth", "leaf.shard_bytes")
        told, two = written(told, f"round{top}")
        paths += [one, two]
        done.append(told.where(F.col("depth").isNotNull()).select("place", "depth", "shard_bytes"))
        left, base = told.where(F.col("depth").isNull()).select("place", "size"), top
        if not left.take(1):
            return reduce(DataFrame.unionByName, done), paths


def sharded(df: DataFrame, key: str, payload: str, limit: int) -> DataFrame:
    """df with n_bytes (the payload's UTF-8 size), place, depth, shard (its bits as text), page and shard_bytes.

    A shard fits the limit unless its rows share one place; then its pages do, but
    for the page of a single row that is larger than the limit. shard_bytes is the
    size of the whole shard.
    """
    if limit < 2:
        raise ValueError("a limit has at least two bytes")
    df, names = set_apart(df, ADDED)
    key, payload = names[key], names[payload]
    rows = df.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(payload)), F.lit(0)).cast("long")).withColumn("place", place(F.col(key)))
    places, path = written(rows.groupBy("place").agg(F.sum("n_bytes").alias("size")), "places")
    found, paths = directory(places, limit)
    shards, _ = written(found, "shards")
    dropped(df.sparkSession, path, *paths)
    out = rows.join(shards.hint("merge"), "place")  # the one time that payloads move
    out = out.withColumn("shard", F.when(F.col("depth") > 0, F.expr(f"lpad(bin(shiftright(place, {BITS} - depth)), depth, '0')")).otherwise(F.lit("")))
    if not shards.where(F.col("shard_bytes") > limit).take(1):
        return out.select(*df.columns, "n_bytes", "place", "depth", "shard", F.lit(0).cast("long").alias("page"), "shard_bytes")
    fits = out.where(F.col("shard_bytes") <= limit).withColumn("page", F.lit(0).cast("long"))
    return fits.unionByName(paged(out.where(F.col("shard_bytes") > limit), limit)).select(*df.columns, *ADDED)


def paged(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of rows that share a place: even numbers hold small rows together, odd ones a row above half the limit."""
    half = limit // 2
    small = F.when(F.col("n_bytes") <= half, F.greatest("n_bytes", F.lit(1))).otherwise(F.lit(0))
    big = F.when(F.col("n_bytes") > half, F.lit(1)).otherwise(F.lit(0))
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_chunk", F.expr(f"_row div {CHUNK}"))
    rows, _ = written(rows.withColumn("_small", small.cast("long")).withColumn("_big", big.cast("long")), "overflow")  # row numbers are taken once
    chunks = rows.groupBy("place", "_chunk").agg(F.sum("_small").alias("_s"), F.sum("_big").alias("_b"))
    before = Window.partitionBy("place").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("place", "_chunk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"))
    inside = Window.partitionBy("place", "_chunk").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_s", F.sum("_small").over(inside)).withColumn("_b", F.sum("_big").over(inside)).join(chunks, ["place", "_chunk"])
    page = F.when(F.col("_big") == 1, 2 * (F.col("_b0") + F.col("_b")) - 1).otherwise(2 * F.expr(f"(_s0 + _s - _small) div {max(1, half)}"))
    return rows.withColumn("page", page.cast("long")).drop("_row", "_chunk", "_small", "_big", "_s", "_b", "_s0", "_b0")


def write_shards(df: DataFrame, key: str, payload: str, limit: int, path: str) -> None:
    """The rows of df in one folder for each shard and page; folders name a shard by b and its bits, so that no reader takes the bits for a number or the empty text for null."""
    sharded(df, key, payload, limit).withColumn("shard", F.concat(F.lit("b"), "shard")).repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)
