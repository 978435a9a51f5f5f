"""Joins with the semantics of lookups, matches in order, proofs and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def looked_up(df: DataFrame, dim: DataFrame, key: str, preset: str | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """Left lookup; a preset key wins over the row's own. Missing values take their defaults."""
    own = F.coalesce(preset, key) if preset else F.col(key)
    out = df.withColumn("_k", own).join(dim.withColumnRenamed(key, "_k"), "_k", "left").drop("_k")
    return out.fillna(defaults) if defaults else out


def alias_matched(df: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """df with matched: of aliases (alias, target, turn) that stand in the name as whole words the longest, then the first.

    An alias can only match where its first word is a word of the name, so rows
    and aliases meet by an equality join on words and no pair is tried in vain.
    """
    if {"matched", "_row"} & set(df.columns):
        raise ValueError("the table already has matched or _row")
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9+#]+", " ")), " ")
    names = df.select(F.col(name).alias("_name")).where("_name is not null").distinct()
    line = F.concat(F.lit(" "), F.array_join(words(F.col("_name")), " "), F.lit(" "))
    asked = names.select("_name", line.alias("_line"), F.explode(F.array_distinct(words(F.col("_name")))).alias("_first"))
    known = aliases.select("target", "turn", F.array_join(words(F.col("alias")), " ").alias("_alias")).withColumn("_first", F.substring_index("_alias", " ", 1)).where("_alias <> ''")
    hits = asked.join(known, "_first").where(F.contains("_line", F.concat(F.lit(" "), "_alias", F.lit(" "))))
    best = hits.groupBy("_name").agg(F.max_by("target", F.struct(F.length("_alias"), -F.col("turn"))).alias("matched"))
    return df.join(best, df[name] == best["_name"], "left").drop("_name")


def attached(df: DataFrame, states: DataFrame, ids: str, key: str, parents: str, state: str) -> DataFrame:
    """States (parents, key, state) of each row: by an id among its ids or by its key, each once."""
    by_id = df.select(key, F.explode(ids).alias("_id")).join(states.select(F.explode(parents).alias("_id"), F.col(state).alias("state")), "_id").select(key, "state")
    by_key = df.select(key).join(states.select(F.col(key), F.col(state).alias("state")), key).select(key, "state")
    found = by_id.unionByName(by_key).distinct().groupBy(key).agg(F.array_sort(F.collect_list("state")).alias("states"))
    return df.join(found, key, "left")


def last_success(df: DataFrame, events: DataFrame, aliases: DataFrame, key: str, at: str, tie: str, value: list[str]) -> DataFrame:
    """df with last: the latest successful event of its key or of an old id that leads to it."""
    named = events.join(aliases.select(F.col("old_id").alias(key), "new_id"), key, "left").withColumn("_k", F.coalesce("new_id", key))
    last = named.where("success").groupBy("_k").agg(F.max_by(F.struct(at, *value), F.struct(at, tie)).alias("last"))
    return df.join(last, df[key] == last["_k"], "left").drop("_k")


def exact_crosswalk(left: DataFrame, right: DataFrame, url: str, old: str, new: str) -> DataFrame:
    """old, new and status for URLs of both sides: 'mapped' if one old id meets one new id, else 'held'."""
    a = left.groupBy(url).agg(F.array_sort(F.collect_set(old)).alias("olds"))
    b = right.groupBy(url).agg(F.array_sort(F.collect_set(new)).alias("news"))
    one = (F.size("olds") == 1) & (F.size("news") == 1)
    return a.join(b, url).select(url, F.when(one, F.get("olds", F.lit(0))).alias("old"), F.when(one, F.get("news", F.lit(0))).alias("new"), F.when(one, "mapped").otherwise("held").alias("status"))


def receipts_proven(receipts: DataFrame, bridge: DataFrame, observations: DataFrame, key: str, link: str, identity: str) -> DataFrame:
    """receipts with proven: all observations behind them have the one identity that the receipt names; a missing one proves nothing."""
    seen = bridge.join(observations, link, "left").groupBy(key).agg(F.collect_set(F.coalesce(F.col(identity).cast("string"), F.lit("?"))).alias("_seen"))
    return receipts.join(seen, key, "left").withColumn("proven", F.coalesce(F.col("_seen") == F.array(F.col("claimed").cast("string")), F.lit(False))).drop("_seen")


def idle(df: DataFrame, busy: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a busy row of the same keys."""
    return df.join(busy.select(*keys).distinct(), keys, "left_anti")


def with_any(df: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with at least one part."""
    return df.join(parts.select(*keys), keys, "left_semi")


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key), key, "left_anti")


def compared(before: DataFrame, after: DataFrame, key: str, material: Column) -> DataFrame:
    """key and change of each row of either side: added, removed, changed or unchanged by the hash of what is material."""
    a = before.select(F.col(key).alias("_a"), F.sha2(material, 256).alias("_ha"))
    b = after.select(F.col(key).alias("_b"), F.sha2(material, 256).alias("_hb"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_ha").eqNullSafe(F.col("_hb")), "unchanged").otherwise("changed")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), change.alias("change"))


def contained(points: DataFrame, spans: DataFrame, keys: list[str], low: str, high: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of a small span and the span of the same keys that contains it.

    Spans are laid out on cells of the given width and meet by equality of keys
    and cell, so one long thread is spread over many tasks.
    """
    small = points.withColumn("_cell", F.floor(F.col(start) / width))
    large = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return small.join(large, [*keys, "_cell"]).where((F.col(start) >= F.col(low)) & (F.col(end) <= F.col(high))).drop("_cell")


def resolved_aliases(bindings: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """bindings with target and status: an id that leads to one other is mapped, one that leads to several is held, others keep themselves."""
    one = aliases.groupBy(F.col("old_id").alias("_old")).agg(F.countDistinct("new_id").alias("_n"), F.min("new_id").alias("_new"))
    out = bindings.join(one, bindings[key] == one["_old"], "left")
    status = F.when(F.col("_n").isNull(), "own").when(F.col("_n") == 1, "mapped").otherwise("held")
    return out.withColumn("status", status).withColumn("target", F.when(F.col("status") == "own", F.col(key)).when(F.col("status") == "mapped", F.col("_new"))).drop("_old", "_n", "_new")


def merged_state(df: DataFrame, key: str, name: str, value: str, at: str, tie: str) -> DataFrame:
    """Per key a map of the latest value of each name."""
    latest = df.groupBy(key, name).agg(F.max_by(value, F.struct(at, tie)).alias("_v"))
    return latest.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name), F.col("_v"))))).alias("state"))


def fields_needed(claims: DataFrame, known: DataFrame, claim: str, fields: str, how: str) -> DataFrame:
    """claims with years: over its fields the least that is known for 'all', the most for 'any'; unknown fields count as none for 'all'."""
    each = claims.select(claim, how, F.explode(fields).alias("field")).join(known, "field", "left")
    years = F.when(F.first(how) == "all", F.min(F.coalesce("years", F.lit(0.0)))).otherwise(F.max("years"))
    return claims.join(each.groupBy(claim).agg(years.alias("years")), claim, "left")


def vocabulary_hits(df: DataFrame, id_: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """id and term of every term (one or more words) of the vocabulary that stands in the text as whole words.

    Texts and terms meet by an equality join on a term's first word, never each with each.
    """
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9+#]+", " "), " "), lambda w: w != "")
    asked = df.select(id_, words(F.coalesce(text, F.lit(""))).alias("_w"))
    asked = asked.select(id_, F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")).alias("_line"), F.explode(F.array_distinct("_w")).alias("_first"))
    known = vocabulary.select("term", F.array_join(words(F.col("term")), " ").alias("_term")).withColumn("_first", F.substring_index("_term", " ", 1)).where("_term <> ''").distinct()
    return asked.join(known, "_first").where(F.contains("_line", F.concat(F.lit(" "), "_term", F.lit(" ")))).select(id_, "term")
