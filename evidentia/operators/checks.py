"""Checks of plans, journals and receipts: what breaks a rule is a row, and nothing is repaired in silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def adequate(df: DataFrame) -> Column:
    """Whether a check (state, complete, planned, fetched, omissions, novelty, actions) proves what it found, an empty find included."""
    same = F.array_sort(F.array_distinct("planned")) == F.array_sort(F.array_distinct("fetched"))
    return F.coalesce((F.col("state") == "complete") & F.col("complete") & same & (F.size("omissions") == 0) & F.col("novelty") & F.col("actions").isNotNull(), F.lit(False))


def check_issues(df: DataFrame) -> DataFrame:
    """df with issues of each check: its window, pages outside the plan, repeated pages, actions without a review of novelty."""
    repeated = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    rules = {
        "invalid_window": (F.col("window_end") <= F.col("window_start")) | (F.col("observed_at") < F.col("window_end")),
        "page_outside_plan": F.size(F.array_except("fetched", "planned")) > 0,
        "repeated_page": repeated("planned") | repeated("fetched"),
        "unreviewed_novelty": F.col("actions").isNotNull() & ~F.col("novelty"),
    }
    return df.withColumn("issues", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])))


def plan_issues(routes: DataFrame, categories: DataFrame, decisions: DataFrame, ceiling: int, most_pilots: int = 2) -> DataFrame:
    """(source_id, issue) of a plan: repeated sources, unknown categories, routes over the shared ceiling, active routes without a decision that admits them or with a later pause, too many pilot families."""
    named = routes.join(categories.select("category", F.lit(True).alias("_known")), "category", "left")
    twice = routes.groupBy("source_id").count().where("count > 1").select("source_id", F.lit("repeated_source").alias("issue"))
    unknown = named.where("_known is null").select("source_id", F.lit("unknown_category").alias("issue"))
    over = routes.where(F.col("requests") > ceiling).select("source_id", F.lit("over_ceiling").alias("issue"))
    active = routes.where("mode <> 'watch'").select("source_id")
    last = decisions.groupBy("source_id").agg(F.max_by("disposition", "observed_at").alias("last"))
    held = active.join(last, "source_id", "left").where(F.col("last").isNull() | F.col("last").isin("pause")).select("source_id", F.when(F.col("last").isNull(), "not_admitted").otherwise("paused").alias("issue"))
    pilots = routes.where("mode = 'pilot'").agg(F.count_distinct("family").alias("n")).where(F.col("n") > most_pilots).select(F.lit(None).cast("string").alias("source_id"), F.lit("too_many_pilots").alias("issue"))
    return twice.unionByName(unknown).unionByName(over).unionByName(held).unionByName(pilots)


def not_one_to_one(df: DataFrame, a: str, b: str) -> DataFrame:
    """Values of a that lead to several b, or of b that several a lead to."""
    left = df.groupBy(a).agg(F.count_distinct(b).alias("n")).where("n > 1").select(F.lit(a).alias("side"), F.col(a).cast("string").alias("value"), "n")
    right = df.groupBy(b).agg(F.count_distinct(a).alias("n")).where("n > 1").select(F.lit(b).alias("side"), F.col(b).cast("string").alias("value"), "n")
    return left.unionByName(right)


def receipts(requests: DataFrame, done: DataFrame, run: str, request: Column) -> DataFrame:
    """requests with receipt: new, repeated (same run and content: nothing to do) or conflict (same run, other content)."""
    known = done.select(F.col(run).alias("_run"), F.col("request_hash").alias("_hash"))
    out = requests.withColumn("request_hash", F.sha2(request, 256)).join(known, F.col(run) == F.col("_run"), "left")
    return out.withColumn("receipt", F.when(F.col("_run").isNull(), "new").when(F.col("_hash") == F.col("request_hash"), "repeated").otherwise("conflict")).drop("_run", "_hash")


def fact_values(facts: DataFrame, scope: list[str], predicate: str, value: str, names: list[str]) -> DataFrame:
    """Per scope one column for each predicate: its current value, null where it conflicts or is absent."""
    one = lambda n: F.max(F.when((F.col(predicate) == n) & (F.col("disposition") == "current"), F.col(value))).alias(n)
    return facts.groupBy(*scope).agg(*[one(n) for n in names], F.array_sort(F.collect_set(F.when(F.col("disposition") == "conflict", F.col(predicate)))).alias("conflicts"))
