"""Entities: one row for copies of a thing, with the best of each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import dropped, written

#: Rows in a part that a task sorts, about; of five short columns these take some 250 MB, twice sorted.
PART_ROWS = 250_000


def deduplicated(df: DataFrame, key: Column, rank: list[Column], source: str, content: Column) -> DataFrame:
    """The row of each key with the highest rank (ties by content), its sources united and how many rows it stands for.

    One aggregation with map-side combining: a key with many copies is reduced
    before it is shuffled.
    """
    best = F.max_by(F.struct(*df.columns), F.struct(*rank, F.xxhash64(content), content))
    out = df.withColumn("_key", key).groupBy("_key").agg(best.alias("_best"), F.array_sort(F.collect_set(source)).alias("sources"), F.count("*").alias("copies"))
    return out.select("_best.*", "sources", "copies", F.col("_key").alias("identity"))


def filled(df: DataFrame, key: str, rank: list[Column], fields: dict[str, Column]) -> DataFrame:
    """Per key each field from the highest-ranked row that is fit to give it; fields: column -> condition on the row."""
    order = F.struct(*rank)
    return df.groupBy(key).agg(*[F.max_by(F.col(c), F.when(ok & F.col(c).isNotNull(), order)).alias(c) for c, ok in fields.items()], F.count("*").alias("observations"))


def lineage_edges(df: DataFrame, child: str, parents: str, accepted: Column) -> DataFrame:
    """Edges (a, b) from accepted children to their parents."""
    return df.where(accepted).select(F.col(child).alias("a"), F.explode(parents).alias("b"))


def components(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """node and component, the smallest node that is reachable over edges (a, b) in either direction.

    Labels move along edges and along labels (a node also takes its label's
    label), so rounds grow with the logarithm of a chain's length.
    """
    spark = nodes.sparkSession
    both, edges_at = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels, at = written(nodes.select(F.col(node).alias("id")).distinct().withColumn("component", F.col("id")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("_a")).agg(F.min("component").alias("_near"))
        moved = labels.join(near, labels["id"] == near["_a"], "left").select("id", F.col("component").alias("old"), F.least("component", "_near").alias("component"))
        jump = moved.select(F.col("id").alias("_id"), F.col("component").alias("_further"))
        after = moved.join(jump, moved["component"] == jump["_id"], "left").select("id", "old", F.least("component", "_further").alias("component"))
        after, new = written(after, "labels")
        dropped(spark, at)
        at, labels = new, after.select("id", "component")
        if not after.where(~F.col("old").eqNullSafe(F.col("component"))).take(1):
            dropped(spark, edges_at)
            return labels.withColumnRenamed("id", node)


def collapsed(df: DataFrame, url: str, rank: list[Column], members: str) -> DataFrame:
    """Rows with the same final URL made one: the best by rank, with all members' ids."""
    best = F.max_by(F.struct(*df.columns), F.struct(*rank))
    return df.groupBy(F.col(url).alias("_url")).agg(best.alias("_best"), F.array_sort(F.collect_set(members)).alias("members")).select("_best.*", "members")


def corroborations(df: DataFrame, same: list[str], amount: str, source: str, tolerance: float) -> DataFrame:
    """Pairs of claims in one group with nearly equal amounts from different sources, a left and a right of each.

    A self join on the group and on a band of the amount: bands are as wide as the
    tolerance, and each claim looks into its own and the two beside it.
    """
    width = tolerance
    left = df.select("*", F.floor(F.col(amount) / width).alias("_band"))
    right = df.select(*[F.col(c).alias(f"r_{c}") for c in df.columns], F.explode(F.array(*[F.floor(F.col(amount) / width) + d for d in (-1, 0, 1)])).alias("_band"))
    match = [left["_band"] == right["_band"], *[left[c] == right[f"r_{c}"] for c in same]]
    pairs = left.join(right, match).where((F.col(source) < F.col(f"r_{source}")) & (F.abs(F.col(amount) - F.col(f"r_{amount}")) <= width))
    return pairs.drop("_band")


def corroborated(df: DataFrame, same: list[str], amount: str, source: str, tolerance: float, tie: str) -> DataFrame:
    """df with corroborated: whether a claim of another source in its group has an amount within the tolerance.

    One sort of each group and no pairs: the nearest amount of another source below a
    claim stands just before the run of claims of its own source that it is in, and the
    nearest above just after it. The parts that groups are dealt to follow the number of rows, so
    that what a task sorts does not grow with the input.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(max(least, -(-df.count() // PART_ROWS)), *same)
    up, down = Window.partitionBy(*same).orderBy(amount, source, tie), Window.partitionBy(*same).orderBy(F.desc(amount), F.desc(source), F.desc(tie))

    def nearest(w: Window) -> Column:
        other = F.when(~F.lag(source).over(w).eqNullSafe(F.col(source)), F.lag(amount).over(w))
        return other

    out = df.withColumn("_a", nearest(up)).withColumn("_b", nearest(down))
    out = out.withColumn("_below", F.last("_a", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_above", F.last("_b", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    near = (F.col(amount) - F.col("_below") <= tolerance) | (F.col("_above") - F.col(amount) <= tolerance)
    return out.withColumn("corroborated", F.coalesce(near, F.lit(False))).drop("_a", "_b", "_below", "_above")


def pay_conflicts(df: DataFrame, key: str, low: str, high: str, unit: str, confidence: str, least: float = 0.65, apart: float = 0.25, fixed: Column | None = None) -> DataFrame:
    """Per key whether its trusted claims disagree: several units, midpoints more than a quarter apart, or, where fixed tells whole budgets from rates, both kinds or several budgets."""
    middle = (F.col(low) + F.col(high)) / 2
    whole = F.lit(False) if fixed is None else F.coalesce(fixed, F.lit(False))
    trusted = df.withColumn("_fixed", whole).where(F.col(confidence) >= least)
    out = trusted.groupBy(key).agg(F.countDistinct(unit).alias("units"), F.max(middle).alias("top"), F.min(middle).alias("bottom"), F.count("*").alias("claims"), F.count_distinct("_fixed").alias("_kinds"), F.count_distinct(F.when(F.col("_fixed"), F.struct(low, high))).alias("_budgets"))
    apart_ = (F.col("units") > 1) | (F.col("top") - F.col("bottom") > apart * F.col("top")) | (F.col("_kinds") > 1) | (F.col("_budgets") > 1)
    return out.withColumn("conflict", apart_).drop("_kinds", "_budgets")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
