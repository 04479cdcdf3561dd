"""Cover trees against full products: tree invariants, the query's rows, clustered and degenerate vectors, odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tastemark.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows: list[tuple]) -> set[tuple]:
    kept: dict = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [int(max(min(math.floor(256 * float(np.float32(x))), 1 << 28), -(1 << 28))) for x in v])
        kept[i] = min(kept.get(i, row), row)
    out = set()
    for a in (i for i in kept if i % 100 == 0):
        label, v = kept[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in kept.items() if i != a)
        for score, p, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 30 * -score <= 100 * -s[0] <= 90 * -score][:10]
            out |= {(a, p, r, n, -score, -s) for r, (s, n, _) in enumerate(fits, 1)}
    return out


def told(df) -> set[tuple]:
    rows = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def mined(table, **more):
    rows = negatives.vectors(table)
    return negatives.mine(rows, rows.where("id % 100 = 0"), **more)


def test_query_against_full_products(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    df = queries.op11_cover_tree_negatives(spark, sf)
    assert dict(df.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    assert told(df) == plain(rows)


def clustered(n: int, seed: int = 3) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, 16)) * 3
    return np.float32(centres[draw.integers(0, 12, n)] + draw.normal(size=(n, 16)) * draw.choice([0.0, 0.05, 0.4], n)[:, None])


def test_tree_covers_and_separates():
    rows = np.floor(clustered(3000).astype(float) * 256)
    tree = negatives.CoverTree(np.arange(3000), np.zeros(3000, np.int64), rows)
    assert sorted(np.concatenate(tree.bucket)) == list(range(3000))
    norms = (rows**2).sum(axis=1)
    lifted = np.column_stack([rows, np.sqrt(norms.max() - norms)])
    under = [set(b) for b in tree.bucket]
    for i in range(len(tree.parent) - 1, 0, -1):
        under[tree.parent[i]] |= under[i]
    for i, members in enumerate(under):
        assert np.sqrt(((lifted[sorted(members)] - lifted[tree.centre[i]]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-6
        children = [j for j, p in enumerate(tree.parent) if p == i]
        assert len(children) <= negatives.CHILDREN
        for x, j in enumerate(children):
            assert tree.radius[j] <= tree.radius[i] / 2 + 1e-6
            for y in children[:x]:
                assert np.linalg.norm(lifted[tree.centre[j]] - lifted[tree.centre[y]]) > tree.radius[i] / 2


def test_search_is_exact_and_skips_nodes():
    rows, ids = np.floor(clustered(4000).astype(float) * 256), np.arange(4000) * 3
    labels = ids % 4
    tree = negatives.CoverTree.unpacked(negatives.CoverTree(ids, labels, rows).packed())
    anchors = np.arange(0, 4000, 100)
    scores = (rows[anchors] @ rows.T).astype(np.int64)
    top = np.sort(scores, axis=1)[:, -2]
    low, high = np.stack([30 * top, 0 * top, top * 0 + 1], axis=1), np.stack([90 * top, 50 * top, top * 0], axis=1)
    for same in (True, False):
        names, best, multiplied = tree.search(ids[anchors], labels[anchors], rows[anchors], low, high, 7, same)
        assert multiplied < scores.size * 0.8
        for a in range(len(anchors)):
            for w in range(3):
                fits = [(-s, i) for s, i, l in zip(scores[a], ids, labels) if (l == labels[anchors[a]]) == same and i != ids[anchors[a]] and low[a, w] <= 100 * s <= high[a, w]]
                want = sorted(fits)[:7]
                got = [(-s, i) for s, i in zip(best[a, w], names[a, w]) if s > np.iinfo(np.int64).min]
                assert got == want


@pytest.mark.parametrize("shard_rows", [37, 5000])
def test_clusters_ties_and_copies(spark, shard_rows):
    vectors = clustered(900)
    rows = [(i, [float(x) for x in (vectors[0] if i % 3 == 0 else vectors[i])], i % 5) for i in range(900)]
    assert told(mined(spark.createDataFrame(rows, SCHEMA), shard_rows=shard_rows)) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (100, [1.0, 2.0, 0.5], 2), (100, [0.5, 0.25], 2), (200, [], 3), (300, [1e30, -1e30], 1), (400, [0.0, 0.0], 2), (-100, [-1.0, 1.0], 3)]
    rows += [(None, [1.0, 1.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 2), (4, [inf, 1.0], 2), (5, [1.0, 1.0], None), (500, [-inf, 0.0], 1)]
    rows += [(10 + i, [math.cos(i), math.sin(i)], i % 3 + 1) for i in range(80)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert told(mined(table)) == plain(rows)
    clash = table.selectExpr("*", "'x' AS id", "'x' AS v", "'x' AS shard", "'x' AS score", "'x' AS rank", "'x' AS name")
    assert told(mined(clash)) == plain(rows)
    assert told(mined(table.limit(0))) == set() and told(mined(table.where("vec_id = 0"))) == set()
    assert told(mined(table.where("vec_id % 100 <> 0"))) == set()
