"""Histories: what changed, what holds now, and runs of equal outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import folded, stepped


def order_of(keys: list[str], at: str, tie: str) -> Window:
    return Window.partitionBy(*keys).orderBy(at, tie)


def transitions(df: DataFrame, keys: list[str], at: str, tie: str, band: str, url: str, pay: str, notified: str) -> DataFrame:
    """df with transition against the row before: none, new, promoted, restored, moved or pay_resolved."""
    w = order_of(keys, at, tie)
    told = F.coalesce(F.max(F.when(F.col(notified), 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    before = {c: F.lag(c).over(w) for c in (band, url, pay)}
    kind = (
        F.when(F.col(band) == "reject", "none").when(before[band].isNull() | ~told, "new").when((before[band] == "verify") & (F.col(band) == "primary"), "promoted")
        .when(before[band] == "reject", "restored").when(~before[url].eqNullSafe(F.col(url)) & (F.col(band) == "primary"), "moved").when(before[pay].isNull() & F.col(pay).isNotNull(), "pay_resolved").otherwise("none")
    )
    return df.withColumn("transition", kind)


def against_delivered(df: DataFrame, keys: list[str], at: str, tie: str, delivered: str, material: str) -> DataFrame:
    """df with change against the last row that was delivered, not the last row: new, material_change or none."""
    w = order_of(keys, at, tie).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(delivered), F.struct(F.col(material).alias("m"))), ignorenulls=True).over(w)
    return df.withColumn("change", F.when(last.isNull(), "new").when(last["m"].eqNullSafe(F.col(material)), "none").otherwise("material_change"))


def revisions(df: DataFrame, keys: list[str], at: str, tie: str, material: str) -> DataFrame:
    """df with revision: a new number whenever the material differs from the row before, so A, B, A are three."""
    w = order_of(keys, at, tie)
    changed = F.when(F.lag(material).over(w).eqNullSafe(F.col(material)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_changed", changed).withColumn("revision", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def validity(df: DataFrame, keys: list[str], at: str, tie: str, material: str) -> DataFrame:
    """One row for each revision: its material, from when, until when (null: still), and how many rows it holds."""
    rows = revisions(df, keys, at, tie, material).groupBy(*keys, "revision").agg(F.min(at).alias("valid_from"), F.max(material).alias(material), F.count("*").alias("n"))
    return rows.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("revision")))


def superseded_unsent(df: DataFrame, subject: list[str], sequence: str, sent: str) -> DataFrame:
    """df with superseded: unsent rows of a subject for which a later sequence exists."""
    return df.withColumn("superseded", ~F.col(sent) & (F.col(sequence) < F.max(sequence).over(Window.partitionBy(*subject))))


def baselines(df: DataFrame, keys: list[str], sequence: str, accepted: str) -> DataFrame:
    """Per key the highest accepted sequence: a baseline never goes back."""
    return df.where(accepted).groupBy(*keys).agg(F.max(sequence).alias("baseline"))


def latest_facts(df: DataFrame, scope: list[str], authority: list[str], at: str, event: str, value: str, terminal: Column, superseded: DataFrame | None = None) -> DataFrame:
    """df with disposition of each fact within its scope: superseded, conflict or current.

    A later dated fact of the same authority supersedes one that isn't terminal;
    facts named in `superseded` (event) are superseded anyway. If the facts that
    are left in a scope have several values, all of them conflict.
    """
    newest = F.max(at).over(Window.partitionBy(*scope, *authority))
    gone = F.coalesce(F.col(at) < newest, F.lit(False)) & ~terminal
    out = df.withColumn("_gone", gone)
    if superseded is not None:
        named = superseded.select(F.col(event).alias("_old")).distinct()
        out = out.join(named, out[event] == named["_old"], "left").withColumn("_gone", F.col("_gone") | F.col("_old").isNotNull()).drop("_old")
    left = F.when(~F.col("_gone"), F.coalesce(F.col(value).cast("string"), F.lit("\u0000")))  # no value is a value of its own
    several = F.coalesce(F.min(left).over(Window.partitionBy(*scope)) != F.max(left).over(Window.partitionBy(*scope)), F.lit(False))
    return out.withColumn("disposition", F.when(F.col("_gone"), "superseded").when(several, "conflict").otherwise("current")).drop("_gone")


def verification(df: DataFrame, keys: list[str], at: str, tie: str, failed: str, most: int, pause_days: int) -> DataFrame:
    """df with cycles (failures in a row up to this one), first_failed of the run, and next_check once there are too many."""
    w = order_of(keys, at, tie)
    island = F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_island", island)
    run = Window.partitionBy(*keys, "_island").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("cycles", F.sum(F.when(F.col(failed), 1).otherwise(0)).over(run)).withColumn("first_failed", F.when(F.col(failed), F.min(F.when(F.col(failed), F.col(at))).over(run)))
    return out.withColumn("next_check", F.when(F.col("cycles") >= most, F.col(at) + F.make_interval(days=F.lit(pause_days)))).drop("_island")


def first_last(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("n"))


def zero_streak(df: DataFrame, keys: list[str], start: str, end: str, found: str, tie: str) -> DataFrame:
    """Per key how many empty checks stand at the end, counting only windows that don't overlap the counted one before.

    A fold over one key's checks in order: a find resets, an overlap counts for nothing.
    """

    def step(state: tuple, s, e, f) -> tuple:
        n, until = state
        if f:
            return 0, None
        return (n + 1, e) if until is None or (s is not None and s >= until) else state

    columns = [F.col(c) for c in (start, end, found)]
    return folded(df, keys, [F.col(c) for c in (end, found, tie, start)], columns, (0, None), step, lambda state: state[:1], "streak int")


def health_transitions(df: DataFrame, keys: list[str], at: str, status: str, items: str, error: str, cooldown_hours: float = 24, drop: float = 0.5) -> DataFrame:
    """df with alert: failed, partial, recovered, error_changed or coverage_drop against the row before, or none.

    The last two keep silent within the cooldown after an alert, so each step
    depends on the ones before it: a fold over one key's rows in order.
    """
    quiet_for, bad = int(cooldown_hours * 3_600_000_000), ("partial", "failed")

    def step(held: tuple, now: int, state: str, found: int, why: str) -> tuple[tuple, str]:
        before, had, cause, alerted = held
        quiet = alerted is not None and now - alerted < quiet_for
        if before is None:
            alert = state if state in bad else "none"
        elif before in bad and state not in bad:
            alert = "recovered"
        elif state in bad and (before not in bad or state == "failed" != before):
            alert = state
        elif quiet:
            alert = "none"
        elif state in bad and why != cause:
            alert = "error_changed"
        else:
            alert = "coverage_drop" if 0 < had and found < had and found <= drop * had else "none"
        return (state, found, why, alerted if alert == "none" else now), alert

    moment = F.unix_micros(F.col(at).cast("timestamp"))
    values = [moment, F.col(status), F.col(items).cast("long"), F.coalesce(F.col(error), F.lit(""))]
    return stepped(df, keys, values, values, (None, 0, "", None), step, "alert", "string").select(*keys, F.col(at).cast("timestamp").alias("at"), "alert")


def thread_state(df: DataFrame, thread: str, turn: str, opens: Column, closes: Column) -> DataFrame:
    """Per thread whether it is open, closed or unclear; a post that says both makes it unclear for good."""
    signal = F.when(opens & closes, "both").when(closes, "closed").when(opens, "open")
    out = df.withColumn("_s", signal).groupBy(thread).agg(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col(turn))).alias("last"), F.max(F.when(F.col("_s") == "both", 1).otherwise(0)).alias("both"), F.count("*").alias("posts"))
    return out.select(thread, F.when(F.col("both") == 1, "unclear").otherwise(F.coalesce("last", F.lit("open"))).alias("state"), "posts")


def thread_history(df: DataFrame, thread: str, turn: str, opens: Column, closes: Column, terms: str) -> DataFrame:
    """Per thread its state (open, closed, reopened, unclear), how often it was reopened, and which revision of its terms holds.

    A post that says both makes a thread unclear for good; an opening after a closing
    reopens it; terms get a new revision with each post that states others than before.
    """
    w = Window.partitionBy(thread).orderBy(turn)
    signal = F.when(opens & closes, "both").when(closes, "closed").when(opens, "open")
    rows = df.withColumn("_s", signal).withColumn("_before", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_held", F.last(terms, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    changed = F.col(terms).isNotNull() & ~F.col(terms).eqNullSafe(F.col("_held"))
    reopened = (F.col("_s") == "open") & (F.col("_before") == "closed")
    out = rows.groupBy(thread).agg(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col(turn))).alias("last"), F.count(F.when(F.col("_s") == "both", 1)).alias("both"), F.count(F.when(reopened, 1)).alias("reopenings"), F.count(F.when(changed, 1)).alias("revision"), F.max_by(terms, F.when(F.col(terms).isNotNull(), F.col(turn))).alias("terms"))
    state = F.when(F.col("both") > 0, "unclear").when(F.col("last") == "closed", "closed").when(F.col("reopenings") > 0, "reopened").otherwise("open")
    return out.select(thread, state.alias("state"), "reopenings", "revision", "terms")
