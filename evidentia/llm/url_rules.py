"""URL filters as sort-merge range joins, in DataFrame functions alone.

A host's canonical key is its labels in reverse, each with a dot after it:
``www.example.org`` is ``org.example.www.``. A host and all its subdomains are then
the keys that begin with the host's key, which is an interval, and so are the paths
that begin with a rule's path. Two intervals are nested or apart, so a sweep over
sorted keys, intervals opening before and closing after the keys they cover, keeps a
stack of nested intervals: a running sum of openings and closings is its height, and
what is on top at height d is the last that opened at height d.

1. Hosts: rule hosts are swept with the distinct hosts of urls. The top of the stack
   is the longest rule host that fits a host; the rule hosts below it are those that
   fit the top itself, one row for each pair of nested rule hosts.
2. Paths: keys ``rule host, path`` are swept with the distinct (top, path cut to the
   longest rule path) of urls, each asking once for each host of its stack.
3. The longest rule over a stack's hosts wins.

Askers are distinct, and dealt over parts of about PART of them, each swept alone with its
own copy of the intervals: rules are copied once for each part. What they find is joined
back to the urls by host and path; urls of a host that many share are split by adaptive execution.

Nulls: a null url, or one without ://, has an empty host and path. Rules with a
null host or path are ignored; of rules with the same host and path, block wins.
Repeated pages give a row each, no rules give the default everywhere, and other
columns of the pages are kept out of the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"
PART = 500_000  # askers that are swept together


def rest_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    """The labels of a host in reverse, each with a dot after it; no other host's key begins with it but a subdomain's."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def on_top(intervals: DataFrame, askers: DataFrame, parts: int) -> DataFrame:
    """askers with top: what the innermost interval that covers their key holds, null where none does.

    intervals (key, holds): each covers all keys that begin with its own. askers have
    key and any other columns. Keys are compared as UTF-8.
    """
    others = [c for c in askers.columns if c != "key"]
    low = F.encode("key", "UTF-8")
    held = intervals.schema["holds"].dataType
    nothing = [F.lit(None).cast(askers.schema[c].dataType).alias(c) for c in others]
    copies = intervals.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    opens = copies.select("part", low.alias("at"), F.lit(1).alias("step"), "holds", *nothing)
    closes = copies.select("part", F.concat(low, F.lit(bytearray(b"\xff"))).alias("at"), F.lit(-1).alias("step"), F.lit(None).cast(held).alias("holds"), *nothing)
    asking = askers.select(F.pmod(F.xxhash64("key", *others), F.lit(parts)).cast("int").alias("part"), low.alias("at"), F.lit(0).alias("step"), F.lit(None).cast(held).alias("holds"), *others)
    order = [F.col("at"), F.col("step").desc()]  # an interval opens before the asker at its own key
    so_far = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at_height = Window.partitionBy("part", "height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = opens.unionByName(closes).unionByName(asking).withColumn("height", F.sum("step").over(so_far))
    swept = swept.withColumn("top", F.when(F.col("height") > 0, F.last("holds", ignorenulls=True).over(at_height)))
    return swept.where("step = 0").select(*others, "top")


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, parts: int | None = None, part: int = PART) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages (page_id, url) by rules (host, path, verdict).

    Without `parts` there is one for each `part` distinct pairs of host and cut path.
    """
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict"))
    longest = rules.agg(F.coalesce(F.max(F.length("r_path")), F.lit(0)).alias("n")).first()["n"]
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("probe", F.left("path", F.lit(max(1, longest))))
    asked = urls.select("host", "probe").distinct()
    parts = parts or max(1, -(-asked.count() // part))

    hosts = rules.select("r_host").distinct()
    intervals = hosts.select(reversed_key(F.col("r_host")).alias("key"), F.col("r_host").alias("holds"))
    tops = on_top(intervals, asked.select(reversed_key(F.col("host")).alias("key"), "host").distinct(), parts).where("top is not null")
    # The stack that a rule host stands on: the rule hosts among its own suffixes.
    inner = hosts.select(F.col("r_host").alias("top"), F.explode(F.expr("transform(sequence(1, length(r_host) - length(replace(r_host, '.')) + 1), k -> substring_index(r_host, '.', -k))")).alias("r_host"))
    stacks = inner.join(hosts, "r_host", "left_semi")

    asked = asked.join(tops, "host")
    key = F.concat(reversed_key(F.col("r_host")), F.lit("\x00"))
    rule = F.struct(F.length(F.concat("r_host", "r_path")).alias("length"), F.length("r_host").alias("host_length"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    probes = asked.select("top", "probe").distinct().withColumnRenamed("top", "stack").join(stacks.withColumnRenamed("top", "stack"), "stack").select(F.concat(key, "probe").alias("key"), "stack", "probe")
    found = on_top(rules.select(F.concat(key, "r_path").alias("key"), rule.alias("holds")), probes, parts).where("top is not null")
    best = found.groupBy("stack", "probe").agg(F.max("top").alias("best")).withColumnRenamed("stack", "top")
    fits = asked.join(best, ["top", "probe"]).select("host", "probe", "best")
    return urls.join(fits, ["host", "probe"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
