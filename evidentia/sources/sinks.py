"""Sinks: snapshots, runs that appear whole or not at all, digests and messages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_snapshot(records: DataFrame, path: str, header: dict) -> None:
    """Records (source, raw) as JSON lines and a header that tells their number."""
    spark = records.sparkSession
    lines = records.select(F.to_json(F.struct("source", "raw")).alias("value"))
    lines.write.text(f"{path}/records")
    n = spark.read.text(f"{path}/records").count()
    spark.createDataFrame([(json.dumps({"type": "header", **header, "record_count": n}),)], "value string").coalesce(1).write.text(f"{path}/header")


def write_run(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """Tables of a run, then a manifest; readers take only runs that have one, so a broken run never shows."""
    spark = next(iter(tables.values())).sparkSession
    counts = {}
    for name, df in tables.items():
        target = f"{path}/{name}/run_id={run_id}"
        df.write.mode("overwrite").parquet(target)
        counts[name] = spark.read.schema(df.schema).parquet(target).count()
    spark.createDataFrame([(run_id, json.dumps(counts, sort_keys=True))], "run string, counts string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{run_id}")


def read_runs(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of a table over all runs with a manifest, with run_id."""
    done = spark.read.schema("run string, counts string").json(f"{path}/manifest/*").select(F.col("run").alias("run_id")).distinct()
    return spark.read.schema(f"{schema}, run_id string").parquet(f"{path}/{name}").join(done, "run_id", "left_semi").select(*[f.name for f in T._parse_datatype_string(f"{schema}, run_id string").fields])


def appended_once(log: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows of a log whose key it doesn't have, each once."""
    return new.dropDuplicates([key]).join(log.select(key), key, "left_anti")


def counters(df: DataFrame, at: str) -> DataFrame:
    return df.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))


def audit_lines(df: DataFrame, id_: str) -> DataFrame:
    """One JSON line a row, with nulls, by id."""
    return df.select(F.col(id_), F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def digest(df: DataFrame, section: str, line: Column, order: list[Column]) -> DataFrame:
    """One text a section of what is shown: its lines in order. Use it on rows that a cap has reduced."""
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("o"), line.alias("line"))))
    return df.groupBy(section).agg(rows.alias("r")).select(section, F.concat_ws("\n", F.concat(F.lit("## "), F.col(section)), F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("text"))


def chunks(text: Column, most: int) -> Column:
    """A text in parts of at most so many characters."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / most).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * most + 1, F.lit(most)))


def evidence_appended(registry: DataFrame, deltas: DataFrame, key: str) -> DataFrame:
    """The registry with trust moved by deltas (key, delta), between 0 and 1, and how many there were."""
    d = deltas.groupBy(F.col(key).alias("_k")).agg(F.sum("delta").alias("_d"), F.count("*").alias("evidence"))
    out = registry.join(d, registry[key] == d["_k"], "left")
    return out.withColumn("trust", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("trust") + F.coalesce("_d", F.lit(0.0)))), 4)).withColumn("evidence", F.coalesce("evidence", F.lit(0))).drop("_k", "_d")


def manifest(df: DataFrame, name: str, content: str) -> DataFrame:
    """Names and SHA-256 of files (as binaryFile reads them), to check a copy against."""
    return df.select(F.col(name), F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("n_bytes"))


def save_pending(ids: DataFrame, key: str, path: str) -> None:
    """The ids of a waiting queue as one JSON array, in their order; a queue is small by its nature."""
    one = ids.agg(F.to_json(F.coalesce(F.array_sort(F.collect_set(F.col(key).cast("string"))), F.array().cast("array<string>"))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)
