"""State over batches: seen sets, freshness, queues, budgets and scores that events move."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import folded, stepped


def upserted(old: DataFrame, new: DataFrame, key: str, first_seen: str) -> DataFrame:
    """The table after new rows replaced old ones of the same key; first_seen keeps the earlier moment."""
    before = old.select(F.col(key).alias("_k"), F.col(first_seen).alias("_f"))
    kept = old.join(new.select(key), key, "left_anti")
    fresh = new.join(before, new[key] == before["_k"], "left").withColumn(first_seen, F.least(first_seen, "_f")).drop("_k", "_f")
    return kept.unionByName(fresh.select(*old.columns))


def late(df: DataFrame, keys: list[str], seq: str, as_of: str) -> DataFrame:
    """df with late: a snapshot older than one that came before it for its subject."""
    before = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("late", F.coalesce(F.col(as_of) < F.max(as_of).over(before), F.lit(False)))


def queue(df: DataFrame, item: str, seq: str, action: str, at: str, lease: float) -> DataFrame:
    """Per item its state after its actions in order, with attempts.

    pending -claim-> leased -send-> sending -ok-> accepted | -fail-> pending;
    a lease that ran out before the next action goes back to pending, a send that
    did becomes uncertain and stays so: it is never tried again. Actions that don't
    fit the state change nothing. A fold over one item's actions.
    """
    moment, span = F.unix_micros(F.col(at).cast("timestamp")), int(lease * 1_000_000)
    moves = {("pending", "claim"): "leased", ("leased", "send"): "sending", ("sending", "ok"): "accepted", ("sending", "fail"): "pending"}

    def step(held: tuple, action: str | None, t: int | None) -> tuple:
        state, tries, until = held
        if t is not None and until is not None and t > until:
            state = {"leased": "pending", "sending": "uncertain"}.get(state, state)
        after = moves.get((state, action), state)
        if after != state and after in ("leased", "sending"):
            tries, until = tries + (after == "sending"), None if t is None else t + span
        return after, tries, until

    return folded(df, [item], [F.col(seq), F.col(action), moment], [F.col(action), moment], ("pending", 0, 0), step, lambda held: held[:2], "state string, attempts int")


def budgeted(df: DataFrame, run: str, order: list[Column], source: str, cap: int, share: int) -> DataFrame:
    """df with granted: the first requests of a run up to its cap, and of a source up to its share, counted over all that ask."""
    whole = F.row_number().over(Window.partitionBy(run).orderBy(*order))
    own = F.row_number().over(Window.partitionBy(run, source).orderBy(*order))
    return df.withColumn("granted", (whole <= cap) & (own <= share))


def reserved(df: DataFrame, run: str, order: list[Column], host: str, source: str, pilot: str, at: Column, cool_until: Column, unsent: str, cap: int, share: int, pilot_part: float = 0.2) -> DataFrame:
    """df with grant of each request of a run in order: granted, cooling, run_cap, source_share or pilot_ceiling.

    Only granted requests use a budget up, and one that provably was not sent
    (unsent) gives it back. A granted answer may name a moment until which its host
    rests (cool_until, microseconds like at, null for none); pilots together get at most pilot_part of the cap.
    """
    pilots = int(cap * pilot_part)

    def step(held: tuple, h: str, s: str, p: bool, now: int, until: int | None, back: bool) -> tuple[tuple, str]:
        used, by_source, by_pilot, resting = held
        own = by_source.get(s, 0)
        verdict = "cooling" if now < resting.get(h, now) else "run_cap" if used >= cap else "source_share" if own >= share else "pilot_ceiling" if p and by_pilot >= pilots else "granted"
        if verdict == "granted":
            if not back:
                used, by_source, by_pilot = used + 1, by_source | {s: own + 1}, by_pilot + bool(p)
            if until is not None:
                resting = resting | {h: max(until, resting.get(h, until))}
        return (used, by_source, by_pilot, resting), verdict

    return stepped(df, [run], order, [F.col(host), F.col(source), F.col(pilot), at, cool_until, F.col(unsent)], (0, {}, 0, {}), step, "grant", "string")


def clamped_score(df: DataFrame, key: str, order: str, delta: str, start: float) -> DataFrame:
    """Per key a score that events move in order and that never leaves 0..1, to four places at each step."""
    def step(held: tuple, d: float | None) -> tuple:
        x, n = held
        moved = 0.0 if d is None else 1.0 if math.isnan(x + d) else min(1.0, max(0.0, x + d))  # as greatest() and least() take nulls and NaN
        return float(Decimal(repr(moved)).quantize(Decimal("0.0001"), ROUND_HALF_UP)), n + 1

    return folded(df, [key], [F.col(order), F.col(delta)], [F.col(delta).cast("double")], (float(start), 0), step, lambda held: held, "score double, events long")


def diminishing(df: DataFrame, keys: list[str], at: str, tie: str, delta: str, factor: float = 0.7) -> DataFrame:
    """df with effect: a positive delta weakens with each earlier event of its kind, a negative one never."""
    prior = F.row_number().over(Window.partitionBy(*keys).orderBy(at, tie)) - 1
    return df.withColumn("effect", F.when(F.col(delta) > 0, F.col(delta) * F.pow(F.lit(factor), prior)).otherwise(F.col(delta)))


def due(last: Column, as_of: Column, days: int) -> Column:
    """Whether a task that was last done then is to be done again."""
    return last.isNull() | (F.date_diff(as_of, last) >= days)


def enqueued(new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not queued yet, one each."""
    return new.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti")


def enqueue_status(new: DataFrame, known: DataFrame, holds: DataFrame, key: str, revision: str) -> DataFrame:
    """new with status: held while an old receipt of its key is not cleared, duplicate if its revision is queued, stale if a later one is, else queued."""
    last = known.groupBy(F.col(key).alias("_k")).agg(F.max(revision).alias("_r"))
    same = known.select(F.col(key).alias("_sk"), F.col(revision).alias("_sr")).distinct()
    held = holds.select(F.col(key).alias("_h")).distinct()
    out = new.join(last, new[key] == F.col("_k"), "left").join(same, (new[key] == F.col("_sk")) & (new[revision] == F.col("_sr")), "left").join(held, new[key] == F.col("_h"), "left")
    status = F.when(F.col("_h").isNotNull(), "held").when(F.col("_sk").isNotNull(), "duplicate").when(F.col("_r") > new[revision], "stale").otherwise("queued")
    return out.select(*new.columns, status.alias("status"))
