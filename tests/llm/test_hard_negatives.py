"""Hard negatives against a plain search over all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evidentia.llm import hard_negatives


def plain(rows, step, n_positives, n_negatives, low, high):
    use = []
    for i, vector, label in rows:
        if i is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        use.append((i, label, [max(-(1 << 63), min((1 << 63) - 1, math.floor(256 * x))) for x in vector]))
    fit = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    out = []
    for n, (i, label, a) in enumerate(use):
        if i % step:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(a, b)), j, other, m) for m, (j, other, b) in enumerate(use) if m != n)
        for score, j, _, _ in [r for r in ranked if r[2] == label][:n_positives]:
            p = -score
            near = [r for r in ranked if r[2] != label and low * p <= -100 * r[0] <= high * p][:n_negatives]
            out += [(i, j, k + 1, r[1], fit(p), fit(-r[0])) for k, r in enumerate(near)]
    return sorted(out)


def found(spark, rows, step=2, parts=3, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, v array<double>, label int, rank string").repartition(parts)
    use = hard_negatives.usable(df, F.col("vec_id"), F.col("v"), F.col("label"))
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(use, F.col("id") % step == 0, **options).collect())


def test_equals_a_plain_search(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([0.0, 0.01, 0.5, 1.0, -0.3]) + 0.2 for _ in range(6)], rnd.randint(0, 3)) for i in range(160)]
    rows += [(i, [0.7] * 6, i % 2) for i in range(200, 240)] + [(10, [0.5] * 6, 1)] * 3  # one vector in many rows, repeated rows
    rows += [(300, None, 1), (301, [1.0, None], 1), (302, [1.0, float("nan")], 1), (303, [float("inf")], 1), (304, [0.4] * 6, None), (None, [0.4] * 6, 1), (306, [], 1), (308, [0.9, 0.9], 2), (310, [-5.0] * 6, 3)]
    want = plain(rows, 2, 5, 3, 50, 95)
    assert len(want) > 500
    assert found(spark, rows) == want
    assert found(spark, rows, block=17) == want  # many passes
    assert found(spark, rows, positives=2, negatives=4, low=10, high=60) == plain(rows, 2, 2, 4, 10, 60)


@pytest.mark.parametrize("big", [1e9, 1e15])
def test_scores_of_any_size(spark, big):
    rnd = random.Random(6)
    rows = [(i, [rnd.uniform(0.1, 1) * big for _ in range(3)], i % 3) for i in range(40)]
    assert found(spark, rows) == plain(rows, 2, 5, 3, 50, 95) != []


def test_empty_table(spark):
    assert found(spark, []) == []
