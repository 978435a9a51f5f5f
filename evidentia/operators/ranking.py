"""Ranking: total orders, caps that account for every hidden row, and fair shortlists."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import dropped, written


def capped(df: DataFrame, entity: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each entity."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).where(F.col("place") <= n)


def first_of_each(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """df with place within its group, null beyond n. Rows are first cut to n a group and partition, so no task sorts a whole group."""
    part = Window.partitionBy(group, "_part").orderBy(*order)
    local = df.withColumn("_part", F.spark_partition_id()).withColumn("_near", F.row_number().over(part)).where(F.col("_near") <= n)
    return local.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= n).drop("_part", "_near")


def banded_caps(df: DataFrame, key: str, entity: str, order: list[Column], bands: list[tuple[str, int]], per_entity: int) -> DataFrame:
    """df with shown and reason, for an entity cap over all bands and a size limit for each band (band, limit).

    Bands come in order. Within one, rows beyond what their entity has left are
    out; of the rest the first `limit` are shown, and count for their entity. A
    hidden row's reason is entity_cap if the entity's shown rows before it used
    the cap up, else size_cap. Column band names the band.
    """
    used = df.sparkSession.createDataFrame([], f"_e {df.schema[entity].dataType.simpleString()}, _used long")
    shown, last = None, None
    for turn, (band, limit) in enumerate(bands):
        rows = df.where(F.col("band") == band).join(used, df[entity] == F.col("_e"), "left").withColumn("_used", F.coalesce("_used", F.lit(0)))
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).where(F.col("_n") + F.col("_used") <= per_entity)
        picked = rows.orderBy(*order).limit(limit).select(key, F.col(entity).alias("_e"), F.lit(turn).alias("_turn"))
        before = last
        shown, last = written(picked if shown is None else shown.unionByName(picked), "shown")  # at most the limits' sum of rows, so that no band repeats the ones before
        dropped(df.sparkSession, *([] if before is None else [before]))
        used = shown.groupBy("_e").agg(F.count("*").alias("_used"))
    turns = F.create_map(*[x for i, (b, _) in enumerate(bands) for x in (F.lit(b), F.lit(i))])
    out = df.join(shown.select(F.col(key).alias("_k"), F.lit(True).alias("shown")), df[key] == F.col("_k"), "left").drop("_k").withColumn("shown", F.coalesce("shown", F.lit(False)))
    before = Window.partitionBy(entity).orderBy(F.try_element_at(turns, F.col("band")), *order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum(F.col("shown").cast("int")).over(before), F.lit(0))
    return out.withColumn("reason", F.when(F.col("shown"), "shown").when(so_far >= per_entity, "entity_cap").otherwise("size_cap"))


def two_caps(df: DataFrame, key: str, entity: str, platform: str, order: list[Column], per_entity: int, per_platform: int, size: int) -> DataFrame:
    """key and reason of every row with an entity cap, then a platform cap, then a size limit, each row judged after all before it.

    Skipped rows use nothing up, so ranks don't tell; a fold over the sorted rows
    finds the shown ones, at most `size`. Only rows that could be shown are folded:
    - of an entity's rows on a platform the first per_entity (were one of them
      skipped, its entity or platform was full and stays so);
    - of a platform's the first per_platform + size, and of an entity's the first
      per_entity * (size + 1) (at most size shown rows can make others full);
    - over all the first size * (2 * size + 4), as no more rows than that can be
      skipped before size are shown.
    A row's reason then follows from the shown rows before it. How many these are is
    counted in groups of rows dealt out by key, with a copy of the shown rows in each.
    A null entity or platform has no cap.
    """
    has_entity = F.col(entity).isNotNull()
    able = first_of_each(df.where(has_entity).withColumn("_pair", F.struct(entity, platform)), "_pair", order, per_entity).drop("place", "_pair")
    able = first_of_each(able, entity, order, per_entity * (size + 1)).drop("place").unionByName(df.where(~has_entity))
    able = first_of_each(able, platform, order, per_platform + size).drop("place")
    first = able.orderBy(*order).limit(size * (2 * size + 4)).withColumn("_order", F.row_number().over(Window.orderBy(*order)))
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = F.array_sort(F.collect_list(F.struct("_order", F.col(key).alias("k"), F.col(entity).cast("string").alias("e"), F.col(platform).cast("string").alias("p"), whole.alias("row"))))
    full = lambda shown, e, p: (F.size(F.filter(shown, lambda x: x["e"] == e)) >= per_entity, F.size(F.filter(shown, lambda x: x["p"] == p)) >= per_platform)

    def step(shown: Column, r: Column) -> Column:
        no_entity, no_platform = full(shown, r["e"], r["p"])
        return F.when(no_entity | no_platform | (F.size(shown) >= size), shown).otherwise(F.concat(shown, F.array(r)))

    shown = first.agg(rows.alias("_r")).select(F.aggregate("_r", F.slice("_r", 1, 0), step).alias("_shown"))
    groups = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = shown.select(F.explode("_shown").alias("_s")).select("_s.row.*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"), F.lit(1).alias("_copy"))
    dealt = df.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")).withColumn("_copy", F.lit(0))
    before = F.coalesce(F.sum("_copy").over(Window.partitionBy("_group").orderBy(*order, "_copy").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    counted = dealt.unionByName(copies).withColumn("_before", before).where("_copy = 0").crossJoin(F.broadcast(shown))
    no_entity, no_platform = full(F.slice("_shown", F.lit(1), F.col("_before")), F.col(entity).cast("string"), F.col(platform).cast("string"))
    reason = F.when(F.exists("_shown", lambda x: x["k"] == F.col(key)), "shown").when(no_entity, "entity_cap").when(no_platform, "platform_cap").otherwise("size_cap")
    return counted.select(key, reason.alias("reason"))


def round_robin(df: DataFrame, source: str, order: list[Column], n: int) -> DataFrame:
    """n rows with turn: the first of every source, then the second of every source, and so on."""
    return first_of_each(df, source, order, n).withColumnRenamed("place", "turn").orderBy("turn", source).limit(n)


def batches(df: DataFrame, order: list[Column], most: int, size: int) -> DataFrame:
    """The first `most` rows with place and batch number."""
    head = df.orderBy(*order).limit(most)
    return head.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("batch", F.floor((F.col("place") - 1) / size))


def dispatch_plan(ready: DataFrame, order: list[Column], current: str, limit: int) -> DataFrame:
    """At most `limit` rows, the oldest first, with one place kept for a current row if there is one."""
    now = ready.where(current).orderBy(*order).limit(1)
    old = ready.where(~F.col(current)).orderBy(*order)
    return old.limit(max(0, limit - 1)).unionByName(now) if now.take(1) else old.limit(limit)


def shortlist(df: DataFrame, source: str, order: list[Column], n: int, rejected: str, fit_reject: str, part: float = 0.1) -> DataFrame:
    """n rows with turn: a quota of rejects that may still be wrong (fit_reject), rounded up, and a round robin of the others by source for the rest of the places."""
    quota = math.ceil(n * part)
    second = df.where(F.col(rejected) & F.col(fit_reject)).orderBy(*order).limit(quota)
    left = n - second.count()
    return round_robin(df.where(~F.col(rejected)), source, order, left).unionByName(second.withColumn("turn", F.lit(None).cast("int")))


def nudges(candidates: DataFrame, registry: DataFrame, key: str, priority: str, floor: float, n: int) -> DataFrame:
    """The n open candidates of the highest priority whose platform is trusted enough; an unknown platform has no trust."""
    known = registry.select(F.col(key).alias("_k"), F.col("trust").alias("_t"))
    open_ = candidates.where("status = 'todo'").join(known, candidates[key] == F.col("_k"), "left").where(F.coalesce("_t", F.lit(0.0)) >= floor)
    return open_.orderBy(F.desc(priority), key).limit(n).drop("_k", "_t")


def best_rate(offers: Column) -> Column:
    """Of an array of rates (quote, has_currency, hourly) the first with a currency and an hour, else with a currency, else with an hour, else the first."""
    ranked = F.transform(offers, lambda o, i: F.struct((F.when(o["has_currency"], 2).otherwise(0) + F.when(o["hourly"], 1).otherwise(0)).alias("rank"), (-i).alias("turn"), o.alias("offer")))
    return F.array_max(ranked)["offer"]


def handoff(df: DataFrame, key: str, lane: str, employer: str, platform: str, acted: str, urgent: str, order: list[Column], caps: dict[str, int], total: int, per_employer: int, per_platform: int) -> DataFrame:
    """key, disposition and reserved of the rows that lanes (action before verify) can show, at most `total`.

    Rows go by lane and order; each is shown unless its employer, its platform, its
    lane or the whole is full. The first action row that nobody acted on yet
    (a discovery) has a place kept, unless every shown action row is both acted on
    and urgent, which displaces it. A null employer or platform has no cap. Only rows
    that could be shown are folded, in one task. In each lane these are of an employer's
    rows on a platform the first per_employer, of an employer's the first
    per_employer * (total + 1), of a platform's the first per_platform + total (at most
    total shown rows fill employers and platforms), and as many of the lane as can be
    skipped before total are shown; and the first discovery.
    """
    lanes = list(caps)
    turn = F.create_map(*[x for i, n in enumerate(lanes) for x in (F.lit(n), F.lit(i))])
    rows = df.withColumn("_turn", F.try_element_at(turn, F.col(lane))).where("_turn is not null")

    def cut(part: DataFrame, by: list[str], n: int) -> DataFrame:
        """The first n of each group of a lane; rows with a null in `by` stay."""
        named = F.lit(True)
        for c in by:
            named = named & F.col(c).isNotNull()
        kept = first_of_each(part.where(named).withColumn("_group", F.struct(lane, *by)), "_group", order, n).drop("place", "_group")
        return kept.unionByName(part.where(~named))

    able = cut(rows, [employer, platform], per_employer)
    able = cut(able, [employer], per_employer * (total + 1))
    able = cut(able, [platform], per_platform + total)
    most = total * (per_employer * (total + 1) + per_platform + total + 1)
    able = first_of_each(able, lane, order, most).drop("place")
    found = rows.where((F.col(lane) == lanes[0]) & ~F.col(acted)).orderBy(*order).limit(1)
    head = able.unionByName(found).dropDuplicates([key]).withColumn("_place", F.row_number().over(Window.orderBy("_turn", *order)))
    slim = head.select(F.col(key).alias("k"), F.col(lane).alias("lane"), F.col(employer).cast("string").alias("e"), F.col(platform).cast("string").alias("p"), F.col(acted).alias("acted"), F.col(urgent).alias("urgent"), "_place")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        items = t.sort_values("_place").to_dict("records")

        def select(rows: list[dict]) -> dict:
            firms, shops, used, out = Counter(), Counter(), Counter(), {}
            for r in rows:
                e, p = r["e"] if r["e"] is not None else ("alone", r["k"]), r["p"]
                if firms[e] >= per_employer:
                    why = "employer_cap"
                elif p is not None and shops[p] >= per_platform:
                    why = "platform_cap"
                elif used[r["lane"]] >= caps[r["lane"]] or sum(used.values()) >= total:
                    why = r["lane"] + "_cap"
                else:
                    why = "shown"
                    firms[e], used[r["lane"]] = firms[e] + 1, used[r["lane"]] + 1
                    shops[p] += p is not None
                out[r["k"]] = why
            return out

        kept = next((r for r in items if r["lane"] == lanes[0] and not r["acted"]), None)
        plain = select(items)
        ready = [r for r in items if r["lane"] == lanes[0] and plain[r["k"]] == "shown"]
        if kept is not None and len(ready) == caps[lanes[0]] and all(r["acted"] and r["urgent"] for r in ready):
            kept = None
        final = plain if kept is None else select([kept, *[r for r in items if r is not kept]])
        return pd.DataFrame([(r["k"], final[r["k"]], kept is not None and r is kept) for r in items], columns=["k", "disposition", "reserved"])

    kind = df.schema[key].dataType.simpleString()
    return slim.groupBy(F.lit(1).alias("_one")).applyInPandas(run, f"k {kind}, disposition string, reserved boolean").withColumnRenamed("k", key)


def shown_before(df: DataFrame, shown: list, key: str, order: list[Column]) -> DataFrame:
    """df with _before, how many of the shown keys (a short list) stand before each row; counted in groups of rows with a copy of the shown ones in each."""
    groups = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")).withColumn("_copy", F.lit(0))
    copies = df.where(F.col(key).isin(*shown)).withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("_copy", F.lit(1))
    before = F.coalesce(F.sum("_copy").over(Window.partitionBy("_group").orderBy(*order, "_copy").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return dealt.unionByName(copies).withColumn("_before", before).where("_copy = 0").drop("_group", "_copy")


def head_of_caps(df: DataFrame, entity: str, platform: str, order: list[Column], per_entity: int, per_platform: int, size: int) -> DataFrame:
    """The rows that could be among the first `size` shown under both caps, at most size * (2 * size + 4); see two_caps."""
    named = df.where(F.col(entity).isNotNull())
    able = first_of_each(named.withColumn("_pair", F.struct(entity, platform)), "_pair", order, per_entity).drop("place", "_pair")
    able = first_of_each(able, entity, order, per_entity * (size + 1)).drop("place").unionByName(df.where(F.col(entity).isNull()))
    capped_, free = able.where(F.col(platform).isNotNull()), able.where(F.col(platform).isNull())
    able = first_of_each(capped_, platform, order, per_platform + size).drop("place").unionByName(free)
    return able.orderBy(*order).limit(size * (2 * size + 4))


def count_of(shown: list[dict], before: Column, name: str, value: Column) -> Column:
    """How many of the first `before` shown rows have value as name."""
    held = F.array(*[F.lit(r[name]).cast("string") for r in shown]) if shown else F.array().cast("array<string>")
    return F.size(F.filter(F.slice(held, F.lit(1), before), lambda x: x == value.cast("string")))


def released(df: DataFrame, key: str, entity: str, platform: str, band: str, order: list[tuple[str, bool]], limits: dict[str, int], per_entity: int, per_platform: int) -> DataFrame:
    """key and reason of every row in one order over all bands: an entity cap, then a platform cap, then each band's own limit; what is skipped uses nothing up.

    Only rows that could be shown are folded, a bounded number for each band. A row of a band without a limit is no_band.
    """
    size, (whole, rest) = max(1, sum(limits.values())), keyed_order(order)
    cut = df.select(key, F.col(entity).cast("string").alias("_e"), F.col(platform).cast("string").alias("_p"), F.col(band).alias("_b"), whole)
    heads = [head_of_caps(cut.where(F.col("_b") == b), "_e", "_p", rest, per_entity, per_platform, size) for b in limits]
    held = heads[0]
    for h in heads[1:]:
        held = held.unionByName(h)
    shown: list[dict] = []
    entities, platforms, bands = Counter(), Counter(), Counter()
    for r in held.orderBy(*rest).select(key, "_e", "_p", "_b").collect():
        full = (r["_e"] is not None and entities[r["_e"]] >= per_entity) or (r["_p"] is not None and platforms[r["_p"]] >= per_platform)
        if not full and bands[r["_b"]] < limits[r["_b"]]:
            shown.append(r.asDict())
            entities[r["_e"]] += 1
            platforms[r["_p"]] += 1
            bands[r["_b"]] += 1
    counted = shown_before(cut, [r[key] for r in shown], key, rest)
    reason = (
        F.when(F.col(key).isin(*[r[key] for r in shown]), "shown")
        .when(~F.coalesce(F.col("_b").isin(*limits), F.lit(False)), "no_band")
        .when(F.col("_e").isNotNull() & (count_of(shown, F.col("_before"), "_e", F.col("_e")) >= per_entity), "entity_cap")
        .when(F.col("_p").isNotNull() & (count_of(shown, F.col("_before"), "_p", F.col("_p")) >= per_platform), "platform_cap")
        .otherwise("band_cap")
    )
    return counted.select(key, reason.alias("reason"))


def keyed_order(order: list[tuple[str, bool]]) -> tuple[Column, list[Column]]:
    """Sort columns (name, whether it ascends) as one value _o, and the order of its parts."""
    return F.struct(*[F.col(n).alias(f"o{i}") for i, (n, _) in enumerate(order)]).alias("_o"), [F.col(f"_o.o{i}").asc() if up else F.col(f"_o.o{i}").desc() for i, (_, up) in enumerate(order)]


def sectioned(df: DataFrame, key: str, entity: str, platform: str, section: str, order: list[tuple[str, bool]], sections: list[tuple[str, int, int]], per_platform: int) -> DataFrame:
    """key, section and reason of every row, for sections (name, limit, entity cap) one after the other.

    Within a section each row is judged after all before it: the entity's cap counts what
    all sections so far show, the platform's what this one does. Rows over the platform cap are
    deferred. If the whole section comes from one platform and still has room, the deferred
    rows are taken up again in their order (backfill) until it is full; those that are not
    reached stay out as platform_cap. A row without a platform is a source of its own.
    A section shows `limit` rows at most, so its fold sees a bounded head of its rows.
    """
    used: Counter = Counter()
    found, (whole, rest) = None, keyed_order(order)
    for name, limit, cap in sections:
        rows = df.where(F.col(section) == name)
        cut = rows.select(key, F.col(entity).cast("string").alias("_e"), F.col(platform).cast("string").alias("_p"), whole)
        source = F.coalesce("_p", F.concat(F.lit("\0"), F.col(key).cast("string")))
        single = cut.agg((F.min(source) == F.max(source)).alias("single")).first()["single"]
        full = [e for e, n in used.items() if n >= cap]
        free = cut.where(F.col("_e").isNull() | ~F.col("_e").isin(*full)) if full else cut
        head = head_of_caps(free, "_e", "_p", rest, max(1, cap), max(per_platform, limit if single else 0), max(1, limit)).orderBy(*rest).collect() if cap > 0 and limit > 0 else []
        start, shown, deferred, platforms = dict(used), [], [], Counter()
        for r in head:
            if r["_e"] is not None and used[r["_e"]] >= cap:
                continue
            if r["_p"] is not None and platforms[r["_p"]] >= per_platform > 0:
                deferred.append(r)
            elif len(shown) < limit:
                shown.append(r.asDict())
                used[r["_e"]] += r["_e"] is not None
                platforms[r["_p"]] += 1
        backfill, reached = [], None
        if single and len(shown) < limit:
            for r in deferred:
                if len(shown) + len(backfill) >= limit:
                    break
                reached = r[key]
                if r["_e"] is None or used[r["_e"]] < cap:
                    backfill.append(r[key])
                    used[r["_e"]] += r["_e"] is not None
        # the first pass alone decides what is deferred; backfilled rows were deferred
        counted = shown_before(cut, [r[key] for r in shown], key, rest)
        before = F.create_map(*[x for e, n in start.items() if e is not None for x in (F.lit(e), F.lit(n))]) if any(e is not None for e in start) else F.create_map().cast("map<string,int>")
        entity_full = F.col("_e").isNotNull() & (F.coalesce(F.try_element_at(before, F.col("_e")), F.lit(0)) + count_of(shown, F.col("_before"), "_e", F.col("_e")) >= cap)
        platform_full = F.col("_p").isNotNull() & (count_of(shown, F.col("_before"), "_p", F.col("_p")) >= per_platform) if per_platform > 0 else F.lit(False)
        popped = F.lit(False)
        if single and len(shown) < limit and (backfill or reached is not None or deferred):
            if len(shown) + len(backfill) < limit:
                popped = F.lit(True)  # the section never filled up, so every deferred row was taken up
            else:
                last = next(tuple(r["_o"]) for r in head if r[key] == backfill[-1])
                popped = F.lit(False)
                for i in reversed(range(len(last))):
                    o = F.col(f"_o.o{i}")
                    ahead = o < F.lit(last[i]) if order[i][1] else o > F.lit(last[i])
                    popped = ahead | ((o == F.lit(last[i])) & popped)
        reason = F.when(F.col(key).isin(*[r[key] for r in shown]), "shown").when(F.col(key).isin(*backfill), "backfill").when(entity_full, "entity_cap").when(platform_full, F.when(popped, "entity_cap").otherwise("platform_cap")).otherwise("size_cap")
        out = counted.select(key, F.lit(name).alias("section"), reason.alias("reason"))
        found = out if found is None else found.unionByName(out)
    return found


def first_group(groups: dict[str, Column]) -> Column:
    """The first group whose condition holds, else null."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(groups.items()):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


#: What each grade of a component adds to a listing's score.
GRADES = {
    "match": {"strong": 30.0, "medium": 20.0, "weak": 0.0},
    "economics": {"excellent": 15.0, "viable": 8.0, "budget_known": 8.0, "unknown": 0.0, "below_floor": 0.0},
    "source": {"original_employer": 10.0, "original_ats": 10.0, "email_offer": 10.0, "reputable_board": 8.0, "aggregator_unresolved": 3.0, "unknown": 1.0, "content_farm": 0.0},
}


def priority_components(role: Column, language: Column, easy: Column, trust: Column, freshness: Column, grades: dict[str, Column], platform_trust: Column, onboarding: Column, low_trust: float = 5.0, high_onboarding: float = 3.0) -> Column:
    """A listing's score and its parts: role and language by their weight, grades by their table, trust, freshness, easy entry, and what a distrusted platform or a costly start takes away."""
    lookup = lambda name: F.coalesce(F.try_element_at(F.create_map(*[x for k, v in GRADES[name].items() for x in (F.lit(k), F.lit(v))]), grades[name]), F.lit(0.0))
    risk = 0.0 - (F.when(platform_trust < 0.5, low_trust).otherwise(0.0) + F.when(onboarding < 0.4, high_onboarding).otherwise(0.0))
    parts = {
        "role_priority": F.coalesce(role, F.lit(0)) * 5.0,
        "match": lookup("match"),
        "language_edge": F.when(F.coalesce(language, F.lit(False)), 10.0).otherwise(0.0),
        "economics": lookup("economics"),
        "source": lookup("source"),
        "trust": F.round(F.coalesce(trust, F.lit(0.0)) * 10, 2),
        "freshness": F.round(F.coalesce(freshness, F.lit(0.0)) * 5, 2),
        "easy_entry": F.when(F.coalesce(easy, F.lit(False)), 5.0).otherwise(0.0),
        "risk_adjustment": risk,
    }
    total = parts["role_priority"]
    for c in list(parts.values())[1:]:
        total = total + c
    return F.struct(*[c.alias(n) for n, c in parts.items()], F.round(total, 2).alias("score"))
