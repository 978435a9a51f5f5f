"""Feeds of pages as a Python data source, one read of every source with its counts, and appends with a log of commits.

A feed's pages depend on each other, so a feed is one partition: its pages are taken in
order up to the first that can't be used, and what came before stays. Boards of one
provider are one partition as well: once it refuses (401, 403, 429), the rest are deferred.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import RAW, SOURCES, Reader

PAGES = "kind string, feed string, page int, item string, status string, detail string"
REFUSED = (401, 403, 429)


class Pages(DataSource):
    """spark.read.format("landed_pages"): a folder of feeds, each a folder of pages N.json ({"status", "data", "last"}). Option most: pages of a feed at most; mode boards: feeds are provider-board folders."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(dict(self.options))


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file:")
        self.most, self.boards = int(options.get("most", 1000)), options.get("mode", "feeds") == "boards"

    def partitions(self) -> list[InputPartition]:
        feeds = sorted(f for f in os.listdir(self.path) if os.path.isdir(f"{self.path}/{f}"))
        groups: dict[str, list[str]] = {}
        for f in feeds:
            groups.setdefault(f.split("-", 1)[0] if self.boards else f, []).append(f)
        return [InputPartition(g) for g in groups.values()] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        refused = None
        for feed in partition.value:
            if refused is not None:
                yield ("health", feed, None, None, "deferred", f"refused:{refused}")
                continue
            for row in self.feed(feed):
                refused = int(row[5].removeprefix("http:")) if row[0] == "health" and row[5] in {f"http:{s}" for s in REFUSED} and self.boards else None
                yield row

    def feed(self, feed: str) -> Iterator[tuple]:
        """Items of the pages before the first bad one, then the feed's health."""
        names = sorted((int(n[:-5]), n) for n in os.listdir(f"{self.path}/{feed}") if n.endswith(".json") and n[:-5].isdigit())
        items, detail, ended, used = 0, None, False, 0
        for place, (number, name) in enumerate(names):
            if place == self.most:
                detail = "page_budget"
                break
            if number != place + 1:
                detail = f"missing_page:{place + 1}"
                break
            try:
                with open(f"{self.path}/{feed}/{name}", encoding="utf-8") as f:
                    page = json.load(f)
                status = page.get("status", 200)
                if status != 200:
                    detail = f"http:{status}"
                    break
                data = page["data"]
                if not isinstance(data, list) or not all(isinstance(x, dict) for x in data):
                    raise ValueError("data")
            except (ValueError, KeyError, AttributeError) as e:
                detail = f"bad_page:{type(e).__name__}"
                break
            used += 1
            for x in data:
                items += 1
                yield ("item", feed, number, json.dumps(x, ensure_ascii=False, sort_keys=True), None, None)
            if page.get("last") or not data:
                ended = True
                break
        whole = detail is None
        status = ("ok" if items else "empty") if whole and (ended or names) else "deferred" if detail == "page_budget" and not used else "partial" if used else "failed" if detail else "empty"
        yield ("health", feed, used, None, status, detail if detail else None if ended else "no_end_seen")


def read_pages(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(Pages)
    return spark.read.format("landed_pages").options(**{k: str(v) for k, v in options.items()}).load(path)


def ingested_once(spark: SparkSession, paths: dict[str, str], target: str, sources: dict[str, Reader] = SOURCES, at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """Raw records of all sources, written under target, and health (source, status, items, error), in the order of sources.

    Each source is read once: its rows are counted while they are written. Several are
    written side by side; one that fails leaves nothing behind in the result.
    """

    def take(name: str) -> tuple[str, str, int, str | None]:
        seen = Observation(f"ingest {name}")
        try:
            rows = sources[name](spark, paths[name]).select("source", "raw").observe(seen, F.count(F.lit(1)).alias("n"))
            rows.write.mode("overwrite").parquet(f"{target}/{name}")
            n = seen.get["n"]
            return name, "ok" if n else "empty", n, None
        except Exception as e:  # one source never takes the others along
            return name, "failed", 0, type(e).__name__

    with ThreadPoolExecutor(at_once) as pool:
        health = list(pool.map(take, [n for n in sources if n in paths]))
    good = [f"{target}/{n}" for n, status, _, _ in health if status != "failed"]
    rows = spark.read.schema(RAW).parquet(*good) if good else spark.createDataFrame([], RAW)
    return rows, spark.createDataFrame(health, "source string, status string, items long, error string")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def committed_batches(path: str):
    """A foreachBatch sink: a batch's rows, then its line in the log of commits. A batch that the log has is known without reading the table; one that broke off before its line is written anew."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if exists(spark, f"{path}/commits/batch={batch_id}"):
            return
        seen = Observation()
        batch.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")
        spark.createDataFrame([(batch_id, seen.get["n"])], "id long, n long").coalesce(1).write.mode("overwrite").json(f"{path}/commits/batch={batch_id}")

    return sink


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of committed batches, with batch."""
    done = spark.read.schema("id long, n long").json(f"{path}/commits/*").select(F.col("id").alias("batch"))
    return spark.read.schema(f"{schema}, batch long").parquet(f"{path}/data").join(F.broadcast(done), "batch", "left_semi")  # a line for each batch


def doctor(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """batch, issue of what is not as the log says: uncommitted (rows without a line), lost (a line without rows), count (another number of rows)."""
    told = spark.read.schema("id long, n long").json(f"{path}/commits/*").select(F.col("id").alias("batch"), F.col("n").alias("told"))
    there = spark.read.schema(f"{schema}, batch long").parquet(f"{path}/data").groupBy("batch").agg(F.count("*").alias("there"))
    both = told.join(there, "batch", "full")
    issue = F.when(F.col("told").isNull(), "uncommitted").when(F.col("there").isNull() & (F.col("told") > 0), "lost").when(F.col("there") != F.col("told"), "count")
    return both.withColumn("issue", issue).where("issue is not null").select("batch", "issue", "told", "there")


def restored(spark: SparkSession, path: str, target: str, schema: str) -> int:
    """Writes the committed rows to a new table with a log of their own, which must have no issue; returns their number. Refuses a target that is there."""
    if exists(spark, target):
        raise FileExistsError(target)
    rows = committed(spark, path, schema)
    rows.write.partitionBy("batch").parquet(f"{target}/data")
    counts = rows.groupBy("batch").agg(F.count("*").alias("n"))
    counts.select(F.col("batch"), F.col("batch").alias("id"), "n").write.partitionBy("batch").json(f"{target}/commits")
    issues = doctor(spark, target, schema).count()
    if issues:
        raise ValueError(f"{issues} batches differ from their log")
    return committed(spark, target, schema).count()
