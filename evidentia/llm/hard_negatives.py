"""Hard negatives: for each anchor and positive, the best-scored rows of other labels within a band below the positive.

A row's score is its integer inner product with the anchor. Higher scores come first, ties
by smaller id. A positive is one of the anchor's first rows of its own label; its negatives
are the first rows of other labels whose score is between two percentages of the positive's.

Anchors are taken in blocks of ANCHORS, which is all that a pass holds of them. A pass
reads all rows where they lie, part by part: scores of a part and the block's anchors, sorted
whole for each anchor by score and id. Each positive's upper limit is found by binary search;
from there on the first k rows of other labels are read, down to the lower limit. A task
returns no more than that for each positive, so what is shuffled follows the anchors and
tasks, not the rows. Positives come from a first pass of the same kind.

Rows with a null id, label or vector, or any null or non-finite component take no part.
Vectors of different lengths are compared over the components that both have. A repeated row
is a row of its own: an anchor's copies can be its positives. Ties of score and id are
settled by label and by the place in the table. Scores are exact whatever their size (Python's
integers where 64 bits don't do) and come back held within 64 bits. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, dropped, shared_folder, written

ANCHORS = 8192  # anchors of a pass
PART, LANE = 8192, 256  # rows and anchors that are scored together
SCALE = 256  # units of a component
EXACT = 1 << 49  # scores below it are exact in float64 and leave room for a row's place in one 64-bit key


def usable(rows: DataFrame, name: Column, vector: Column, label: Column) -> DataFrame:
    """id, label and units (whole numbers) of the rows that take part."""
    real = F.transform(vector, lambda x: x.cast("double"))
    out = rows.select(name.cast("long").alias("id"), label.cast("long").alias("label"), real.alias("real"))
    odd = F.exists("real", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return out.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("real").isNotNull() & ~F.coalesce(odd, F.lit(True))).select("id", "label", F.transform("real", lambda x: F.floor(SCALE * x)).alias("units"))


def matrix(units: pa.Array) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    flat, sizes = units.flatten().to_numpy(), np.diff(units.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, as int64 or, where they may be too large, Python's integers."""
    n = min(anchors.shape[1], rows.shape[1])
    a, b = anchors[:, :n], rows[:, :n]
    most = lambda m: int(np.abs(m.astype(np.float64)).max()) if m.size else 0
    if most(a) * most(b) * max(1, n) < EXACT:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(object) @ b.T.astype(object) if n else np.zeros((len(a), len(b)), np.int64)


def in_order(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that lie in the order of ids: each anchor's scores, highest first, and the rows they belong to."""
    bits = max(1, int(found.shape[1] - 1).bit_length())
    key = np.sort(-found * (1 << bits) + np.arange(found.shape[1]), axis=1)  # score, then place
    place = key % (1 << bits)
    return -((key - place) // (1 << bits)), place.astype(np.int64)


class Best:
    """The first k of (score, id, label, row) for each of n lists."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.lists: list[list[tuple]] = [[] for _ in range(n)]

    def add(self, i: int, found: list[tuple]) -> None:
        held = self.lists[i]
        if len(held) == self.k and found and found[0] >= held[-1]:
            return
        held.extend(found)
        held.sort()
        del held[self.k :]


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """id, label, row and vectors of about PART rows at a time, in the order of id, label and row."""

    def sorted_rows(held: list[pa.RecordBatch]) -> tuple:
        ids, label, row = (np.concatenate([column(b, c).to_numpy() for b in held]) for c in ("id", "label", "row"))
        order = np.lexsort((row, label, ids))
        return ids[order], label[order], row[order], matrix(pa.concat_arrays([column(b, "units") for b in held]))[order]

    held, n = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, PART):
            held.append(batch.slice(lo, PART))
            n += held[-1].num_rows
            if n >= PART:
                yield sorted_rows(held)
                held, n = [], 0
    if n:
        yield sorted_rows(held)


def positives_of(block: dict, k: int):
    """A pass over all rows: the first k rows of each anchor's label, but itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block["id"]), k)
        for ids, label, row, units in parts(batches):
            for value in np.unique(label):
                of = np.flatnonzero(label == value)
                anchors = np.flatnonzero(block["label"] == value)
                for lo in range(0, len(anchors), LANE):
                    lane = anchors[lo : lo + LANE]
                    by_score, place = in_order(scores(block["units"][lane], units[of]))
                    for i, s, p in zip(lane.tolist(), by_score[:, : k + 1], of[place[:, : k + 1]]):
                        best.add(i, [(-int(x), int(ids[j]), int(label[j]), int(row[j])) for x, j in zip(s, p) if row[j] != block["row"][i]][:k])
        yield told(best, [(i,) for i in range(len(block["id"]))], ["anchor"])

    return run


def negatives_of(block: dict, positives: dict[int, list[tuple[int, int]]], k: int, low: int, high: int):
    """A pass over all rows: the first k rows of other labels within low to high percent of each positive's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.array(sorted(positives), np.int64)
        at = np.r_[0, np.cumsum([len(positives[i]) for i in asked.tolist()])].astype(np.int64)
        best = Best(int(at[-1]), k)
        for ids, label, row, units in parts(batches):
            for lo in range(0, len(asked), LANE):
                lane = asked[lo : lo + LANE]
                by_score, place = in_order(scores(block["units"][lane], units))
                for n, i in enumerate(lane.tolist()):
                    other = label[place[n]] != block["label"][i]
                    s, p = by_score[n][other], place[n][other]
                    tops = [x for _, x in positives[i]]
                    # the first row whose score is at most high percent of the positive's
                    first = np.searchsorted(-s, np.array([-(high * x // 100) for x in tops], dtype=s.dtype))
                    for m, (x, j) in enumerate(zip(tops, first.tolist())):
                        near = [(-int(y), int(ids[q]), int(label[q]), int(row[q])) for y, q in zip(s[j : j + k], p[j : j + k]) if 100 * int(y) >= low * x]
                        best.add(int(at[lo + n]) + m, near)
        keys = [(i, m) for i in asked.tolist() for m in range(len(positives[i]))]
        yield told(best, keys, ["anchor", "nth"])

    return run


TOP = 1 << 140  # above any score


def told(best: Best, keys: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Lists as rows; a score, which may have more than 64 bits, is the text of its distance from TOP, so that higher ones come first."""
    rows = [(*k, f"{TOP + s:036x}", i, label, row) for k, held in zip(keys, best.lists) for s, i, label, row in held]
    names = [*names, "score", "id", "label", "row"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "score" else pa.int64()) for c, n in zip(zip(*rows) if rows else [[]] * len(names), names)], names)


def first_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of each key's rows, numbered from 1; a key has k rows of each task at most."""
    order = Window.partitionBy(*keys).orderBy("score", "id", "label", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score, for rows of usable().

    is_anchor tells anchors by id. low and high are percentages of a positive's score.
    """
    spark = rows.sparkSession
    rows, path = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    results = f"{shared_folder(spark)}/negatives"
    held: list = []

    def mined(held: list) -> None:
        units = matrix(pa.array([r["units"] for r in held], pa.list_(pa.int64())))
        b = {"id": np.array([r["id"] for r in held]), "label": np.array([r["label"] for r in held]), "row": np.array([r["row"] for r in held]), "units": units}
        kinds = "score string, id long, label long, row long"
        near = first_of(rows.mapInArrow(positives_of(b, positives), f"anchor long, {kinds}"), ["anchor"], positives)
        by_anchor: dict[int, list[tuple[int, int]]] = {}
        for r in sorted(near.select("anchor", "rank", "id", "score").collect()):  # positives for each anchor of the block
            by_anchor.setdefault(r["anchor"], []).append((r["id"], TOP - int(r["score"], 16)))
        found = first_of(rows.mapInArrow(negatives_of(b, by_anchor, negatives, low, high), f"anchor long, nth long, {kinds}"), ["anchor", "nth"], negatives)

        def full(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fit = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
            for f in frames:
                pairs = [by_anchor[a][m] for a, m in zip(f["anchor"], f["nth"])]
                yield pd.DataFrame({"anchor_id": b["id"][f["anchor"].to_numpy(np.int64)], "positive_id": [p for p, _ in pairs], "rank": f["rank"], "negative_id": f["id"], "positive_score": [fit(s) for _, s in pairs], "negative_score": [fit(TOP - int(s, 16)) for s in f["score"]]})

        found.mapInPandas(full, RESULT).write.mode("append").parquet(results)

    for r in rows.where(is_anchor).toLocalIterator():
        held.append(r)
        if len(held) == block:
            mined(held)
            held = []
    mined(held)
    dropped(spark, path)
    return spark.read.schema(RESULT).parquet(results)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
