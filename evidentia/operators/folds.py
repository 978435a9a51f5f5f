"""Folds over one key's rows in order, whose memory doesn't grow with the rows of a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(df: DataFrame, keys: list[str], order: list[Column], values: list[Column], start: Any, step: Callable[..., Any], result: Callable[[Any], tuple], schema: str) -> DataFrame:
    """keys and result(state) per key, where state begins as start and is step(state, *values) after each row.

    A key's rows come to one task in order, and only the state goes from batch to batch.
    Null keys are one key. schema names the result's columns.
    """
    n, m = len(keys), len(order)
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[c.alias(f"o{i}") for i, c in enumerate(order)], *[c.alias(f"v{i}") for i, c in enumerate(values)])
    names = [f"k{i}" for i in range(n)]
    rows = rows.repartition(*names).sortWithinPartitions(*names, *[f"o{i}" for i in range(m)]).drop(*[f"o{i}" for i in range(m)])
    types = ", ".join([f"k{i} {df.select(k).schema[0].dataType.simpleString()}" for i, k in enumerate(keys)] + [schema])
    plain, sorts = zip(*(x.split() for x in schema.split(", ")))
    arrow = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        out: list[tuple] = []
        key, state, begun = None, start, False

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, *[arrow[x] for x in sorts]])], [*names, *plain])

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(n)]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or row[:n] != key:
                    if begun:
                        out.append((*key, *result(state)))
                    key, state, begun = row[:n], start, True
                state = step(state, *row[n:])
            if out:
                yield batch_of(out)
                out = []
        if begun:
            yield batch_of([(*key, *result(state))])

    return rows.mapInArrow(run, types).toDF(*keys, *plain)


def stepped(df: DataFrame, keys: list[str], order: list[Column], values: list[Column], start: Any, step: Callable[..., tuple[Any, Any]], name: str, kind: str) -> DataFrame:
    """df with one more column, what step gives for each row: step(state, *values) returns the next state and the row's value.

    A key's rows come to one task in order, and only the state goes from batch to batch.
    """
    n, m = len(values), len(order)
    rows = df.withColumns({f"_o{i}": c for i, c in enumerate(order)} | {f"_v{i}": c for i, c in enumerate(values)})
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *[f"_o{i}" for i in range(m)]).drop(*[f"_o{i}" for i in range(m)])
    arrow = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[kind]
    own = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, start
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            out = []
            named = zip(*(columns[k].to_pylist() for k in keys))
            given = zip(*(columns[f"_v{i}"].to_pylist() for i in range(n)))
            for now, row in zip(named, given):
                if now != key:
                    key, state = now, start
                state, found = step(state, *row)
                out.append(found)
            yield pa.RecordBatch.from_arrays([*[columns[c] for c in own], pa.array(out, arrow)], [*own, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return rows.mapInArrow(run, f"{fields}, {name} {kind}")
