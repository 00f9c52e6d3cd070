"""Hard negatives against scoring every anchor with every row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import hard_negatives, queries
from tests.compare import compare, connect
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, cell int, uid string"
RNG = random.Random(12)


def clustered(n, size, scale=0.3, spread=0.05):
    heads = [[RNG.gauss(0, scale) for _ in range(size)] for _ in range(7)]
    return [(k, RNG.randrange(4), [x + RNG.gauss(0, spread) for x in heads[k % 7]]) for k in range(n)]


def mined(spark, rows, every=5):
    df = spark.createDataFrame([(i, v, lab, 1, "x") for i, lab, v in rows], SCHEMA)
    got = hard_negatives.mine(df, F.col("vec_id") % every == 0).collect()
    return sorted(tuple(r) for r in got)


ODD = [(None, 1, [0.1]), (5, None, [0.2]), (10, 1, None), (15, 2, [0.1, None]), (20, 2, [math.nan, 1.0]), (25, 2, [math.inf, 1.0]),
       (30, 0, []), (35, 1, [0.5]), (40, 1, [0.5] * 9), (41, 1, [0.5] * 9), (41, 2, [0.4] * 9), (41, 2, [0.4] * 9), (42, 3, [0.3] * 9),
       (45, 1, [2.0**20] * 9), (50, 3, [-0.5] * 9), (55, 7, [0.1] * 9), (60, 1, [0.0] * 9), (61, 2, [0.0] * 9)]


@pytest.mark.parametrize("data, cell_rows, first_rows, block", [
    (clustered(500, 8), 4, 20, 1024), (clustered(300, 3) + ODD, 10, 5, 2000), (clustered(200, 8), 10**6, 10**6, 1 << 16), (ODD, 1, 1, 1)])
def test_every_negative_is_found(spark, monkeypatch, data, cell_rows, first_rows, block):
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(hard_negatives, "FIRST_ROWS", first_rows)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    assert mined(spark, data) == brute.hard_negatives(data, lambda i: i % 5 == 0)


def test_hot_vector_and_wide_numbers(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 2000)
    same = [(k, k % 3, [0.25, -0.5, 0.125, 0.3]) for k in range(150)] + clustered(60, 4)
    assert mined(spark, same, 25) == brute.hard_negatives(same, lambda i: i % 25 == 0)
    wide = [(k, k % 2, [RNG.uniform(2.0**19, 2.0**20) * RNG.choice([1, 1, 1, -1]) for _ in range(6)]) for k in range(80)]
    assert mined(spark, wide) == brute.hard_negatives(wide, lambda i: i % 5 == 0)


def test_nothing_to_mine(spark):
    assert mined(spark, []) == [] and mined(spark, [(5, None, [1.0])]) == [] and mined(spark, clustered(20, 4)[1:], 10**6) == []
    assert mined(spark, [(5, 1, [1.0])]) == []


def test_heap_visits_pairs_by_falling_sum():
    first, second = np.array([RNG.random() for _ in range(9)]), np.array([RNG.random() for _ in range(7)])
    got = list(hard_negatives.by_bound(first, second))
    assert len({(i, j) for _, i, j in got}) == 63 and all(abs(s - first[i] - second[j]) < 1e-12 for s, i, j in got)
    assert [s for s, _, _ in got] == sorted((s for s, _, _ in got), reverse=True)


def test_far_cells_stay_closed(monkeypatch):
    """Cells below the limit are not opened, and none that holds a score at or above it is left out."""
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * np.concatenate([rng.normal(c, 0.02, (60, 8)) for c in rng.normal(0, 0.5, (20, 8))]))
    index = hard_negatives.Index([hard_negatives.codebook(vectors[:, :4], 12, 1), hard_negatives.codebook(vectors[:, 4:], 12, 2)], 8, False)
    cell, far = index.file(vectors)
    index.count = np.bincount(cell, minlength=144).reshape(12, 12)
    index.radius = [np.array([f[cell == c].max() if (cell == c).any() else 0 for c in range(144)]).reshape(12, 12) for f in far]
    shares = []
    for anchor in vectors[::40]:
        scores = vectors @ anchor
        limit = np.sort(scores)[-20]
        opened = hard_negatives.cells_of(index, anchor, limit, math.inf, math.inf)
        assert set(cell[scores >= limit]) <= set(opened)
        shares.append(index.count.reshape(-1)[opened].sum() / len(vectors))
    assert np.mean(shares) < 0.4


def test_query_equals_sql(spark):
    same, note = compare(queries.op12(spark, SF), connect(SF), queries.SQL["op12_hard_negatives"])
    assert same, note
