"""Blocks of neighbour lists are few and large; rows with few cells in common are compared without a number for every pair."""

import math
import random

from tastemark.operators import cosine_join
from tastemark.operators.similarity import neighbours


def test_few_blocks_however_many_rows():
    """Two blocks a core at 600,000 rows of 30 cells: every block reads all rows it may meet."""
    assert 600_000 / cosine_join._block_rows(600_000, 18_000_000, 12, 10) <= 24
    assert cosine_join._block_rows(600_000, 600_000_000, 12, 10) * 1000 <= cosine_join.BLOCK_CELLS
    assert cosine_join._block_rows(600_000, 18_000_000, 12, 500) * 500 <= cosine_join.BLOCK_PARTNERS
    assert cosine_join._block_rows(1000, 30_000, 12, 10) == cosine_join.LEAST_ROWS


def _cells():
    rng = random.Random(5)
    return [(r, c, float(rng.choice([-1, 1, 2, 3]))) for r in range(300) for c in rng.sample(range(900), 6)]


def _want(cells, k):
    vec = {}
    for r, c, v in cells:
        vec.setdefault(r, {})[c] = v
    norm = {r: math.sqrt(sum(v * v for v in d.values())) for r, d in vec.items()}
    out = []
    for a, v in vec.items():
        sims = [(round(sum(x * vec[b].get(c, 0.0) for c, x in v.items()) / norm[a] / norm[b], 9), b) for b in vec if b != a]
        out += [(a, b, round(s, 6)) for s, b in sorted((x for x in sims if x[0] > 0), key=lambda x: (-x[0], x[1]))[:k]]
    return sorted(out)


def test_sparse_rows_agree_with_brute_force(spark):
    cells = _cells()
    df = spark.createDataFrame(cells, "row long, col long, value double")
    for options in ({"block_rows": 300}, {"block_rows": 100, "segment_cells": 2}):
        assert sorted((r.id, r.nbr, round(r.sim, 6)) for r in neighbours(df, 4, **options).collect()) == _want(cells, 4)


def test_a_column_calls_its_rows_to_more_blocks_than_a_number_has_bits(spark):
    cells = _cells()
    df = spark.createDataFrame(cells, "row long, col long, value double")
    assert sorted((r.id, r.nbr, round(r.sim, 6)) for r in neighbours(df, 4, block_rows=4).collect()) == _want(cells, 4)
