"""State with time: leases that run out without another event, facts that go stale, and keys that follow their aliases.

The state of a key is a few values whatever its history. Timers are set in event time, so
what they do follows from the data: they fire when the watermark has passed them, in the
batch after. The session needs the RocksDB state store (use_timers() sets it).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def use_timers(spark: SparkSession) -> None:
    """Chooses the state store that keeps timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def millis(at) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


STEPS = {("pending", "claim"): "leased", ("leased", "send"): "sending", ("sending", "ok"): "accepted", ("sending", "fail"): "pending"}
LAPSED = {"leased": "pending", "sending": "uncertain"}


class Leases(StatefulProcessor):
    """A work item's state: a claim or a sending holds for a span, then it lapses by itself."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, attempts int, until long")

    def row(self, key: tuple, state: str, attempts: int, why: str) -> pd.DataFrame:
        return pd.DataFrame({"item": [key[0]], "state": [state], "attempts": [attempts], "cause": [why]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, attempts, until = self.held.get() if self.held.exists() else ("pending", 0, 0)
        before = until
        for r in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples():
            at = millis(r.at)
            if state in LAPSED and at > until:
                state = LAPSED[state]
            after = STEPS.get((state, r.action), state)
            if after != state and after in LAPSED:
                until, attempts = at + self.span, attempts + (after == "sending")
            state = after
        if before and before != until:
            self.handle.deleteTimer(before)
        if state in LAPSED and before != until:
            self.handle.registerTimer(until)
        self.held.update((state, int(attempts), int(until)))
        yield self.row(key, state, int(attempts), "action")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, attempts, until = self.held.get() if self.held.exists() else ("pending", 0, 0)
        if state in LAPSED and expiredTimerInfo.getExpiryTimeInMs() >= until:
            self.held.update((LAPSED[state], attempts, until))
            yield self.row(key, LAPSED[state], attempts, "lapsed")

    def close(self) -> None:
        pass


def leases(stream: DataFrame, item: str, seq: str, action: str, at: str, span_seconds: float, delay: str) -> DataFrame:
    """item, state, attempts and cause (action or lapsed) after each batch that touches an item, by its rows or by its lease running out."""
    rows = stream.select(F.col(item).cast("long").alias("item"), F.col(seq).cast("long").alias("seq"), F.col(action).alias("action"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", delay)
    return rows.groupBy("item").transformWithStateInPandas(Leases(int(span_seconds * 1000)), "item long, state string, attempts int, cause string", "Update", "EventTime")


class Freshness(StatefulProcessor):
    """A subject's latest check: verified while it is young enough, then stale until the next one."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(millis(t) for part in rows for t in part["at"])
        before = self.last.get()[0] if self.last.exists() else None
        if before is not None and newest <= before:
            return
        if before is not None:
            self.handle.deleteTimer(before + self.ttl + 1)
        self.last.update((newest,))
        self.handle.registerTimer(newest + self.ttl + 1)  # the last moment still counts
        yield pd.DataFrame({"subject": [key[0]], "state": ["verified"], "at": [datetime.utcfromtimestamp(newest / 1000)]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.last.get()[0]
        if expiredTimerInfo.getExpiryTimeInMs() == at + self.ttl + 1:
            yield pd.DataFrame({"subject": [key[0]], "state": ["stale"], "at": [datetime.utcfromtimestamp(at / 1000)]})

    def close(self) -> None:
        pass


def freshness(stream: DataFrame, subject: str, at: str, hours: float, delay: str) -> DataFrame:
    """subject, state (verified, stale) and the time of its latest check, whenever it changes; checks that come late don't set it back."""
    rows = stream.select(F.col(subject).cast("long").alias("subject"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", delay)
    return rows.groupBy("subject").transformWithStateInPandas(Freshness(int(hours * 3_600_000)), "subject long, state string, at timestamp", "Update", "EventTime")


class Aliases(StatefulProcessor):
    """A name's canonical form: the one that is stated, unknown before it is, held as soon as two differ."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.form = handle.getValueState("form", "form string, clash boolean")
        self.waiting = handle.getListState("waiting", "id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        form, clash = self.form.get() if self.form.exists() else (None, False)
        ids = []
        for part in rows:
            stated = part["form"].dropna()
            for f in stated:
                clash, form = clash or (form is not None and form != f), form or f
            ids += part.loc[part["form"].isna(), "id"].tolist()
        self.form.update((form, bool(clash)))
        if form is None:
            self.waiting.appendList([(int(i),) for i in ids])
            return
        if self.waiting.exists():
            ids = [i[0] for i in self.waiting.get()] + ids
            self.waiting.clear()
        if ids:
            yield pd.DataFrame({"id": ids, "name": key[0], "form": [None if clash else form] * len(ids), "state": ["held" if clash else "resolved"] * len(ids)})

    def close(self) -> None:
        pass


def aliased(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, name, form and state of rows (id, name) by a stream of aliases (name, form). Rows wait for their name's first alias; one that was stated two ways holds what comes after it, never guessed."""
    both = rows.select(F.col("id").cast("long").alias("id"), "name", F.lit(None).cast("string").alias("form")).unionByName(aliases.select(F.lit(None).cast("long").alias("id"), "name", "form"))
    return both.groupBy("name").transformWithStateInPandas(Aliases(), "id long, name string, form string, state string", "Append", "None")
