"""Stateful operators as Structured Streaming flows. unseen(), late() and queue() equal their batch forms where a key's rows come in their order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def unseen(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Each key once; the seen set forgets keys older than the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def split_late(stream: DataFrame, at: str, as_of: str) -> DataFrame:
    """stream with late: rows that claim to be from after the moment they were observed. No state: each row is judged by itself."""
    return stream.withColumn("late", F.coalesce(F.col(at) > F.col(as_of), F.lit(False)))


def late(stream: DataFrame, key: str, seq: str, as_of: str) -> DataFrame:
    """key, seq, as_of and late, as state.late(): whether a snapshot is older than one that came before it for its subject.

    The state of a subject is its latest as_of. Snapshots of one batch are taken in the order of seq.
    """
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(as_of).cast("long").alias("as_of"))

    def run(name: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(batches)).sort_values("seq")
        before = pd.Series([held.get[0] if held.exists else None], dtype="Int64")
        most = pd.concat([before, part["as_of"].astype("Int64")]).cummax().ffill()
        part["late"] = (part["as_of"].astype("Int64").reset_index(drop=True) < most.iloc[:-1].reset_index(drop=True)).fillna(False).astype(bool).to_numpy()
        if not pd.isna(most.iloc[-1]):
            held.update((int(most.iloc[-1]),))
        yield part[["key", "seq", "as_of", "late"]]

    return rows.groupBy("key").applyInPandasWithState(run, "key long, seq long, as_of long, late boolean", "most long", "append", GroupStateTimeout.NoTimeout)


def counted(stream: DataFrame, at: str, width: str, delay: str, *keys: str) -> DataFrame:
    """Rows of each window and key; a window closes when the watermark has passed it."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))


QUEUE = "item long, state string, attempts int"


def queue(stream: DataFrame, item: str, seq: str, action: str, at: str, lease: float) -> DataFrame:
    """state.queue() over a stream: after each batch the new state of the items that it touched.

    The state of an item is three numbers, so it stays small however long an item
    lives. Actions of one batch are taken in their order.
    """
    span = int(lease * 1_000_000)
    rows = stream.select(F.col(item).cast("long").alias("item"), F.col(seq).cast("long").alias("seq"), F.col(action).alias("action"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, tries, until = held.get if held.exists else ("pending", 0, 0)
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if r.at > until:
                state = {"leased": "pending", "sending": "uncertain"}.get(state, state)
            after = {("pending", "claim"): "leased", ("leased", "send"): "sending", ("sending", "ok"): "accepted", ("sending", "fail"): "pending"}.get((state, r.action), state)
            if after != state and after in ("leased", "sending"):
                until, tries = int(r.at) + span, tries + (after == "sending")
            state = after
        held.update((state, int(tries), int(until)))
        yield pd.DataFrame({"item": [key[0]], "state": [state], "attempts": [int(tries)]})

    return rows.groupBy("item").applyInPandasWithState(run, QUEUE, "state string, tries int, until long", "update", GroupStateTimeout.NoTimeout)


def upsert_batches(key: str, path: str):
    """A foreachBatch sink that appends rows whose key the table at path doesn't have, so a repeated batch adds nothing. Each batch reads the key column of the table."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti").select(*batch.columns)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return sink
