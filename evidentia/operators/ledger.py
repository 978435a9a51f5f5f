"""Ledgers: counts that must add up, and roll-ups of reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verdict_ledger(df: DataFrame, verdict: str, known: Iterable[str]) -> DataFrame:
    """verdict and n for each known verdict, zeros included, and for 'accounted' and 'unaccounted'."""
    names = list(known)
    counts = [F.count(F.when(F.col(verdict) == v, 1)).alias(v) for v in names]
    one = df.agg(*counts, F.count("*").alias("_all"))
    accounted = sum((F.col(v) for v in names), F.lit(0))
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("n")) for v in names], F.struct(F.lit("accounted").alias("verdict"), accounted.alias("n")), F.struct(F.lit("unaccounted").alias("verdict"), (F.col("_all") - accounted).alias("n")))
    return one.select(F.inline(rows))


def conservation(df: DataFrame, equations: dict[str, tuple[Column, Column]]) -> DataFrame:
    """name, expected, found and holds for equations between aggregates."""
    sums = [c.alias(f"{n}__{side}") for n, pair in equations.items() for side, c in zip("ab", pair)]
    one = df.agg(*sums)
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}__a").cast("long").alias("expected"), F.col(f"{n}__b").cast("long").alias("found"), F.col(f"{n}__a").eqNullSafe(F.col(f"{n}__b")).alias("holds")) for n in equations])
    return one.select(F.inline(rows))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule; a rule that is unknown is broken."""
    one = df.agg(*[F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(n) for n, c in rules.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_broken")) for n in rules])))


def delta_report(df: DataFrame, key: str, delta: str, kind: str, at: str, since: Column, excluded: str) -> DataFrame:
    """Per key the sum of deltas since a moment, their number and the sorted kinds, without one kind."""
    part = df.where((F.col(at) >= since) & (F.col(kind) != excluded))
    return part.groupBy(key).agg(F.round(F.sum(delta), 4).alias("total_delta"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"))


def top_flags(df: DataFrame, flags: str, n: int) -> DataFrame:
    """The n most frequent flags; ties by name."""
    counts = df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "flag").limit(n)


def corroborated(df: DataFrame, subject: str, dimension: str, outlet: str, least: int) -> DataFrame:
    """Per subject the dimension with the most hits, if enough distinct outlets carry it; the next one otherwise."""
    counts = df.groupBy(subject, dimension).agg(F.count("*").alias("hits"), F.countDistinct(outlet).alias("outlets")).where(F.col("outlets") >= least)
    turn = Window.partitionBy(subject).orderBy(F.desc("hits"), dimension)
    return counts.withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").drop("_turn")


def health(df: DataFrame, keys: list[str], outcome: str) -> DataFrame:
    """Per key how many attempts were ok, failed or deferred, and a status: failed, partial, ok or empty."""
    n = {o: F.count(F.when(F.col(outcome) == o, 1)).alias(o) for o in ("ok", "failed", "deferred")}
    counts = df.groupBy(*keys).agg(F.count("*").alias("attempted"), *n.values())
    status = F.when(F.col("attempted") == 0, "empty").when(F.col("failed") == F.col("attempted"), "failed").when(F.col("failed") + F.col("deferred") > 0, "partial").otherwise("ok")
    return counts.withColumn("status", status)


def value_report(df: DataFrame, keys: list[str], adequate: str, actions: str, minutes: str, cost: str) -> DataFrame:
    """Per cohort adequate checks, the distinct actions, and sums of what was measured; what never was stays null.

    Actions are made distinct as rows, so no cohort's history is gathered in one place.
    """
    out = df.groupBy(*keys).agg(
        F.count("*").alias("checks"),
        F.count(F.when(F.col(adequate), 1)).alias("adequate"),
        F.count(F.when(F.col(actions).isNull(), 1)).alias("unknown_actions"),
        F.sum(minutes).alias("minutes"),
        F.count(F.when(F.col(minutes).isNull(), 1)).alias("unmeasured"),
        F.sum(cost).alias("cost"),
    )
    distinct = df.select(*[F.col(k).alias(f"_{k}") for k in keys], F.explode(actions).alias("_action")).distinct().groupBy(*[f"_{k}" for k in keys]).agg(F.count("*").cast("int").alias("n_actions"))
    same = [out[k].eqNullSafe(distinct[f"_{k}"]) for k in keys]
    return out.join(distinct, same, "left").select(*keys, "checks", "adequate", F.coalesce("n_actions", F.lit(0)).alias("n_actions"), "unknown_actions", "minutes", "unmeasured", "cost")


def overflow_lines(df: DataFrame, group: str, label: str, order: list[Column], each: int, lines: int) -> DataFrame:
    """At most `each` labels a group and `lines` groups, with '+N more' for the rest of a group."""
    place = Window.partitionBy(group).orderBy(*order)
    ranked = df.withColumn("_place", F.row_number().over(place))
    out = ranked.groupBy(group).agg(F.sort_array(F.collect_list(F.when(F.col("_place") <= each, F.struct("_place", F.col(label).alias("label"))))).alias("shown"), F.count("*").alias("n"))
    line = F.concat(F.array_join(F.col("shown.label"), ", "), F.when(F.col("n") > each, F.format_string(" +%d more", F.col("n") - each)).otherwise(F.lit("")))
    return out.select(group, "n", line.alias("line")).orderBy(F.desc("n"), group).limit(lines)


def states(df: DataFrame, run: str, state: str, cost: str) -> DataFrame:
    """A receipt of each run: for each state how many requests and what they reserved."""
    return df.groupBy(run, state).agg(F.count("*").alias("n"), F.sum(cost).alias("reserved"))


def presentation(df: DataFrame, disposition: str, shown: list[str], hidden: list[str]) -> DataFrame:
    """One row: how many are shown and hidden, what is neither, and whether they add up to all."""
    count = lambda names: F.count(F.when(F.col(disposition).isin(*names), 1))
    one = df.agg(F.count("*").alias("total"), count(shown).alias("shown"), count(hidden).alias("hidden"))
    return one.withColumn("unexplained", F.col("total") - F.col("shown") - F.col("hidden")).withColumn("holds", F.col("unexplained") == 0)


def by_destination(df: DataFrame, destination: str, disposition: str, names: list[str]) -> DataFrame:
    """Per destination how many rows have each disposition, zeros included, and whether they are all its rows."""
    counts = [F.count(F.when(F.col(disposition) == n, 1)).alias(n) for n in names]
    out = df.groupBy(destination).agg(F.count("*").alias("total"), *counts)
    return out.withColumn("balanced", F.col("total") == sum((F.col(n) for n in names), F.lit(0)))


def coverage(df: DataFrame, destination: str, status: str, known: Column, held: Column, order: list[Column], cap: int) -> DataFrame:
    """Per destination: total = healthy + recorded + held + selected + overflow, of sources and their states.

    Sources that are well need no word; a state already told is recorded; a held
    destination's wait; of the rest the first `cap` are selected.
    """
    ill = F.col(status) != "ok"
    place = F.when(~ill, "healthy").when(known, "recorded").when(held, "held").otherwise("ready")
    rows = df.withColumn("_place", place)
    ready = rows.where("_place = 'ready'").withColumn("_n", F.row_number().over(Window.partitionBy(destination).orderBy(*order)))
    rows = rows.where("_place <> 'ready'").withColumn("_n", F.lit(None).cast("int")).unionByName(ready)
    stage = F.when(F.col("_place") != "ready", F.col("_place")).when(F.col("_n") <= cap, "selected").otherwise("overflow")
    return by_destination(rows.withColumn("_stage", stage), destination, "_stage", ["healthy", "recorded", "held", "selected", "overflow"])


def accounting_line(df: DataFrame, verdict: str, names: list[str]) -> DataFrame:
    """One line of counts in the order of the names, zeros included, after what is counted from the rows as they are now."""
    counts = [F.count(F.when(F.col(verdict) == n, 1)).alias(n) for n in names]
    one = df.agg(F.count("*").alias("_all"), *counts)
    parts = [F.concat(F.lit(n.replace("_", " ") + " "), F.col(n).cast("string")) for n in names]
    return one.select(F.concat_ws(", ", F.concat(F.lit("all "), F.col("_all").cast("string")), *parts).alias("line"))


def histogram(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    """Per key how often each code occurs, as a map from code to count without the nulls."""
    counts = df.where(F.col(code).isNotNull()).groupBy(*keys, code).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(code), "n")))).alias("codes"))


def costs(df: DataFrame, keys: list[str], currency: str, cost: str) -> DataFrame:
    """Per key and currency what was measured, and how many costs were not: sums of several currencies mean nothing."""
    return df.groupBy(*keys, currency).agg(F.sum(cost).alias("cost"), F.count(F.when(F.col(cost).isNull(), 1)).alias("unmeasured"))


def guarded(out: DataFrame, conserved: DataFrame) -> DataFrame:
    """out, if every equation of conservation() holds; a ValueError names those that don't, so that nothing is sent of a run that loses rows."""
    broken = conserved.where(~F.col("holds")).limit(20).collect()
    if broken:
        raise ValueError("; ".join(f"{r['name']}: {r['expected']} expected, {r['found']} found" for r in broken))
    return out
