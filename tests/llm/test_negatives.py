"""Hard negatives against brute force in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, w int, score string"
ANCHOR = "vec_id % 10 = 0"


def plain(rows, k=5, positives=5, low=80):
    ok = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, c in ok:
        if i % 10 == 0:
            anchors[i] = min(anchors.get(i, (c, v)), (c, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = [(sum(x * y for x, y in zip(v, u)), i, c) for i, u, c in ok if len(u) == len(v)]
        same = sorted((-s, i) for s, i, c in scored if c == label and i != a)[:positives]
        for neg, p in same:
            top = -neg
            found = sorted((-s, i) for s, i, c in scored if c != label and low * top <= 100 * s <= 100 * top)[:k]
            out += [(a, p, n, i, top, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def found(spark, rows, **how):
    table = spark.createDataFrame([(i, v, c, "x", 1, "y") for i, v, c in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in negatives.hard_negatives(table, F.expr(ANCHOR), **how).collect())


def some(n, width, seed, spread=1.0):
    r = random.Random(seed)
    return [(i, [r.gauss(0.5, spread) for _ in range(width)], r.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("block", [3, 1000])
def test_equals_brute_force(spark, block):
    rows = some(400, 6, 1)
    rows += [(None, [1.0] * 6, 1), (401, None, 1), (402, [1.0] * 6, None), (410, [float("nan")] * 6, 1), (420, [float("inf")] + [1.0] * 5, 1), (430, [None] + [1.0] * 5, 1)]
    rows += [(440, [1.0, 2.0], 0), (441, [1.0, 2.0], 0), (442, [1.0, 1.9], 1), (450, [], 0), (451, [], 0), (452, [], 1)]
    rows += [(0, [0.1] * 6, 0), (7, [0.3] * 6, 1), (7, [0.3] * 6, 1), (-20, [0.2] * 6, 0)]
    assert found(spark, rows, block=block) == plain(rows)


def test_one_vector_in_very_many_rows(spark):
    """The kth score has far more rows than are gathered, so the ids decide, digit by digit."""
    r = random.Random(2)
    rows = [(r.randrange(-(2**62), 2**62) // 10 * 10 + 1, [1.0, 1.0], 1 + i % 2) for i in range(3000)]
    rows += [(10, [1.0, 1.0], 0), (11, [1.0, 1.0], 0), (12, [0.9, 0.9], 0), (20, [1.0, 0.5], 1), (21, [-1.0, -1.0], 1)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, k=200, positives=2) == plain(rows, k=200, positives=2)


def test_very_large_components_are_exact(spark):
    rows = [(i, [x * 2.0**20, y * 2.0**22], c) for i, (x, y), c in [(i, (1 + i % 7, 1 + i % 5), i % 3) for i in range(60)]]
    assert found(spark, rows) == plain(rows)


def test_several_rounds_find_the_bound(spark, monkeypatch):
    monkeypatch.setattr(negatives, "GATHER", 1)
    rows = some(600, 4, 3, 0.2)
    assert found(spark, rows) == plain(rows)


def test_label_of_the_caller_and_empty_tables(spark):
    rows = some(100, 4, 4)
    moved = [(i, v, (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert found(spark, rows, label=label) == plain(moved)
    assert found(spark, []) == [] and found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    with pytest.raises(TypeError):
        negatives.hard_negatives(spark.createDataFrame([("a", [1.0], 1)], "vec_id string, embedding array<double>, label int"), F.expr(ANCHOR))
