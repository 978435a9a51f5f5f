"""Event journals: what is accepted, what is set aside and why, and what holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import dropped, written


def imported(df: DataFrame, event: str, scope: str, known_scopes: DataFrame, observed: str, as_of: Column, content: Column, supersedes: str, predicate: str) -> DataFrame:
    """df with status: accepted, duplicate, or the code of why a row is quarantined.

    Codes in their order: unmatched_scope, future_evidence, event_id_collision (all
    rows of an id with several contents), invalid_supersession (an event that names
    a missing or later event, one of another scope or predicate, or itself; those
    that name such an event fall with it, until nothing changes). Nothing is
    dropped: every row has exactly one status.
    """
    scopes = known_scopes.select(F.col(scope).alias("_scope")).distinct()
    same = Window.partitionBy(event)
    late = F.col(observed) > as_of
    rows = df.join(scopes, df[scope] == scopes["_scope"], "left").withColumn("_hash", F.sha2(content, 256))
    rows = rows.withColumn("_early", F.when(F.col("_scope").isNull(), "unmatched_scope").when(late, "future_evidence"))
    usable = F.when(F.col("_early").isNull(), F.col("_hash"))
    rows = rows.withColumn("_kinds", F.size(F.collect_set(usable).over(same)))
    first = Window.partitionBy(event, "_early").orderBy(observed, "_hash")
    status = F.coalesce("_early", F.when(F.col("_kinds") > 1, F.lit("event_id_collision")), F.when(F.row_number().over(first) > 1, F.lit("duplicate")), F.lit("accepted"))
    rows, _ = written(rows.withColumn("status", status).drop("_scope", "_hash", "_early", "_kinds"), "rows")
    facts = rows.where("status = 'accepted'").select(F.col(event).alias("id"), F.col(scope).alias("s"), F.col(predicate).alias("p"), F.col(observed).alias("o"), F.col(supersedes).alias("olds"))
    links = facts.select("id", "s", "p", "o", F.explode("olds").alias("old"))
    named = facts.select(F.col("id").alias("old"), F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("o").alias("o2"))
    fine = (F.col("s") == F.col("s2")) & (F.col("p") == F.col("p2")) & (F.col("o2") < F.col("o")) & (F.col("id") != F.col("old"))
    checked, checked_at = written(links.join(named, "old", "left").select("id", "old", F.coalesce(fine, F.lit(False)).alias("fine")), "links")
    bad, at = written(checked.where(~F.col("fine")).select("id").distinct(), "bad")
    while True:  # once for each step of the longest chain of events that fall
        fallen = checked.join(bad.select(F.col("id").alias("old")), "old", "left_semi").select("id").distinct().join(bad, "id", "left_anti")
        fallen, fallen_at = written(fallen, "fallen")
        if not fallen.take(1):
            break
        bad, new = written(bad.unionByName(fallen), "bad")
        dropped(df.sparkSession, at, fallen_at)
        at = new
    dropped(df.sparkSession, checked_at, fallen_at)
    out = rows.join(bad.select(F.col("id").alias("_bad")), rows[event] == F.col("_bad"), "left")
    return out.withColumn("status", F.when(F.col("_bad").isNotNull() & F.col("status").isin("accepted", "duplicate"), "invalid_supersession").otherwise(F.col("status"))).drop("_bad")


def import_counts(df: DataFrame) -> DataFrame:
    """input, accepted, duplicate, quarantined and whether they add up."""
    n = lambda c: F.count(F.when(c, 1))
    one = df.agg(F.count("*").alias("input"), n(F.col("status") == "accepted").alias("accepted"), n(F.col("status") == "duplicate").alias("duplicate"), n(~F.col("status").isin("accepted", "duplicate")).alias("quarantined"))
    return one.withColumn("balanced", F.col("input") == F.col("accepted") + F.col("duplicate") + F.col("quarantined"))


def journal(prior: DataFrame, accepted: DataFrame, event: str) -> DataFrame:
    """Prior and newly accepted events as one journal with repeats: how often an id stands in it, which must be once."""
    both = prior.unionByName(accepted)
    return both.join(both.groupBy(F.col(event).alias("_e")).agg(F.count("*").alias("repeats")), F.col(event) == F.col("_e")).drop("_e")
