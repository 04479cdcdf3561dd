"""Lists of several recipes or shares in one step, their parts, and blocks whose partners must share a cell of one source."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tastemark.operators import cosine_join, evaluate, knn, scored_lists
from tastemark.operators.scored_lists import user_lists
from tastemark.operators.similarity import Recipe, combine_recipe, neighbours


def rows(df, *columns):
    return sorted((*[str(r[c]) for c in columns], None if r.score is None else round(r.score, 8)) for r in df.collect())


@pytest.fixture
def study(spark, monkeypatch):
    rnd = random.Random(3)
    shares = (0.25, 1.0)
    cells = [(s, u, i, float(rnd.randint(-2, 5))) for s in shares for u in range(30) for i in rnd.sample(range(25), 7)]
    cells += [(0.25, None, 3, 2.0), (1.0, 7, None, 3.0), (1.0, 8, 24, None), (0.5, 1, 1, 4.0), (0.25, 7, 7, 1.0), (0.25, 7, 7, 1.0)]
    nbrs = [(s, a, b, round(rnd.random(), 9), r) for s in shares for a in range(-2, 30) for r, b in enumerate(rnd.sample(range(30), 6), 1) if a != b]
    monkeypatch.setattr(scored_lists, "PIECE_CELLS", 3)
    monkeypatch.setattr(scored_lists, "EXPANDED", 10)
    return spark.createDataFrame(nbrs, "share double, id long, nbr long, sim double, rank int"), spark.createDataFrame(cells, "share double, user_id long, item_id long, value double")


@pytest.mark.parametrize("item_based", [False, True])
def test_groups_equal_the_single_steps(study, item_based):
    nbrs, ratings = study
    ks = (2, 4, 6)
    want = knn.top_k(knn.sweep_scores(nbrs, ratings, ks, item_based, ["share"], seen=ratings), None, 4, ["share", "k"])
    got = user_lists(nbrs, ratings, 4, item_based, ks, by=["share"])
    assert rows(got, "share", "k", "user_id", "item_id", "rank") == rows(want, "share", "k", "user_id", "item_id", "rank") != []
    one = ratings.where("share = 1.0").drop("share")
    named = nbrs.withColumn("recipe", F.concat(F.lit("r"), "share")).drop("share")
    want = knn.top_k(knn.score(named, one, item_based, by=["recipe"]), one, 4, ["recipe"])
    got = user_lists(named, one, 4, item_based, by=["recipe"])
    assert rows(got, "recipe", "user_id", "item_id", "rank") == rows(want, "recipe", "user_id", "item_id", "rank") != []
    assert user_lists(named.limit(0), one, 4, item_based, by=["recipe"]).count() == 0


def test_recipes_shuffle_no_row_a_user_and_item(study):
    nbrs, ratings = study
    plan = user_lists(nbrs, ratings, 4, by=["share"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]


@pytest.mark.parametrize("parts", [5, 12, 16])
def test_every_part_has_a_partition_of_its_own(spark, parts):
    names = scored_lists.apart(parts)
    told = spark.createDataFrame([(x,) for x in names], "part int").repartition(parts, "part").select(F.spark_partition_id().alias("p"))
    assert told.distinct().count() == parts == len(set(names))


def test_the_place_of_a_short_list_in_long_ones(spark):
    """Lists longer than twice the wanted length are cut before they are sorted; ties, nulls and users of few items stay right."""
    rnd = random.Random(8)
    nbrs = spark.createDataFrame([(u, 100 + n, float(n), n) for u in range(6) for n in (1, 2, 3)], "id long, nbr long, sim double, rank int")
    ratings = spark.createDataFrame([(100 + n, i, rnd.choice([None, 1.0, 2.0])) for n in (1, 2, 3) for i in rnd.sample(range(60), 40)] + [(0, 4, 1.0)], "user_id long, item_id long, value double")
    got, want = user_lists(nbrs, ratings, 5), knn.top_k(knn.score(nbrs, ratings), ratings, 5)
    assert rows(got, "user_id", "item_id", "rank") == rows(want, "user_id", "item_id", "rank")


def test_map_reads_no_place_after_the_cut_off(spark):
    rnd = random.Random(1)
    recs = spark.createDataFrame([(u, r, i) for u in range(20) for r, i in enumerate(rnd.sample(range(40), 3 + u), 1)], "user_id long, rank int, item_id long")
    truth = spark.createDataFrame([(u, i) for u in range(25) for i in rnd.sample(range(40), 9)], "user_id long, item_id long")
    full = evaluate.summarise(evaluate.per_user(recs, truth, [10]), [10], digits=6).where("name = 'MAP'").select("mean", "ci95", "n").collect()
    assert [tuple(r) for r in evaluate.map_at(recs, truth, 10).collect()] == [tuple(r) for r in full]


def two_sources():
    rnd = random.Random(4)
    sparse = [(r, c, float(rnd.choice([1, 2, 3]))) for r in range(260) for c in rnd.sample(range(500), 5)]
    return sparse + [(900, 1, 1.0)], [(r, c, rnd.random() + 0.1) for r in range(250) for c in range(4)] + [(901, 2, 1.0)]


def brute(sources, recipe, k):
    unit = []
    for cells in sources:
        rows = {}
        for r, c, v in cells:
            rows.setdefault(r, {})[c] = v
        unit.append({r: {c: v / math.sqrt(sum(x * x for x in d.values())) for c, v in d.items()} for r, d in rows.items()})
    ids, out = sorted({r for u in unit for r in u}), []
    for a in ids:
        sims = []
        for b in ids:
            xs = [sum(v * u.get(b, {}).get(c, 0.0) for c, v in u.get(a, {}).items()) for u in unit]
            s = round({"sum": sum(w * x for w, x in zip(recipe.weights, xs)), "max": max([*xs, *([0.0] if recipe.zero else [])]), "min": min([*xs, *([0.0] if recipe.zero else [])])}[recipe.op], 9)
            sims += [(s, b)] if b != a and s > 0 else []
        out += [(a, b, round(s, 6)) for s, b in sorted(sims, key=lambda x: (-x[0], x[1]))[:k]]
    return sorted(out)


RECIPES = [
    combine_recipe("min", [0, 1], "min", slots=None), combine_recipe("avg5", [0, 1], "average"), combine_recipe("max", [0, 1], "max"),
    combine_recipe("w", [0, 1], [0.9, 0.1]), Recipe("w1", "sum", (0, 1), (0.0, 1.0)),
]


@pytest.mark.parametrize("place, narrow, options", [(0, 64, {"block_rows": 262}), (1, 0, {"block_rows": 90, "segment_cells": 2}), (2, 64, {"block_rows": 90}), (3, 64, {"block_rows": 90, "segment_cells": 2}), (4, 64, {"block_rows": 262})])
def test_partners_of_a_leading_source_agree_with_brute_force(spark, monkeypatch, place, narrow, options):
    sources, recipe = two_sources(), RECIPES[place]
    monkeypatch.setattr(cosine_join, "NARROW", narrow)
    monkeypatch.setattr(cosine_join, "SPARSE", 1)
    frames = [spark.createDataFrame(x, "row long, col long, value double") for x in sources]
    got = neighbours(frames, 3, [recipe], **options).collect()
    assert sorted((r.id, r.nbr, round(r.sim, 6)) for r in got) == brute(sources, recipe, 3)


def test_rows_with_floors_above_the_other_sources_meet_fewer_pairs(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(cosine_join, "SPARSE", 4)
    sparse, dense = two_sources()
    by = {}
    for m, cells in enumerate((sparse, dense)):
        for r, c, v in cells:
            by.setdefault(r, []).append((m, c, v))
    held = {}
    for r, xs in by.items():
        held[r] = [math.sqrt(sum(v * v for m, _, v in xs if m == n)) or 1.0 for n in (0, 1)]
    ids = sorted(by)
    batch = pa.RecordBatch.from_arrays([
        pa.array(ids), pa.array([held[r] for r in ids]), *[pa.array([[x[i] for x in by[r]] for r in ids], pa.list_(kind)) for i, kind in enumerate((pa.int32(), pa.int64(), pa.float64()))],
    ], names=["row", "norm", "src", "col", "v"])
    block = cosine_join.Block([cosine_join.Cells(batch)], [combine_recipe("w", [0, 1], [0.9, 0.1])], 1)
    block.start()
    lead, rest = block.split()
    assert lead.lead == 0 and rest.lead is None and lead.n > 200
    met, real = [], cosine_join.Block._pairs
    cosine_join.Block._pairs = lambda self, *a: (lambda out: met.append(len(out[0])) or out)(real(self, *a))
    try:
        lead.offer(cosine_join.Cells(batch))
    finally:
        cosine_join.Block._pairs = real
    assert 0 < sum(met) < lead.n * len(ids) / 10
    rest.offer(cosine_join.Cells(batch))
    ids_of = np.concatenate([x[1] for x in lead.lists() + rest.lists()])
    assert sorted(ids_of) == ids


def test_equal_partners_that_come_later_are_not_kept():
    """Rows of equal direction: once k earlier partners are known, later ones of the same similarity change nothing."""
    import numpy as np
    import pyarrow as pa

    n = 4000
    lists = lambda x, kind: pa.array([[v] for v in x], pa.list_(kind))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), lists(np.ones(n), pa.float64()), lists(np.zeros(n, np.int32), pa.int32()), lists(np.zeros(n, np.int64), pa.int64()), lists(np.ones(n), pa.float64())], names=["row", "norm", "src", "col", "v"])
    block = cosine_join.Block([cosine_join.Cells(batch.slice(0, 200))], [Recipe("")], 3)
    block.start()
    kept, real = [], block._keep
    block._keep = lambda r, q, *rest: kept.append(len(q)) or real(r, q, *rest)
    for low in range(0, n, 500):
        block.offer(cosine_join.Cells(batch.slice(low, 500)))
    (_, ids, names, _, rank), = block.lists()
    assert names[ids == 100].tolist() == [0, 1, 2] and names[ids == 1].tolist() == [0, 2, 3] and len(ids) == 600
    assert sum(kept) < n * 200 / 4


def test_a_run_of_seen_items_alone_follows_sums_of_its_user():
    import numpy as np
    import pyarrow as pa

    one = lambda x, kind: pa.array(x, kind)
    pieces = pa.RecordBatch.from_arrays([one([5], pa.int64()), one([[1, 2, 3]], pa.list_(pa.int64())), one([[1.0, 2.0, None]], pa.list_(pa.float64())), one([[0, 0, 0]], pa.list_(pa.int32()))], names=["u", "item", "x", "rank"])
    sums = scored_lists._Sums(scored_lists._Lists([pieces]), [2**31 - 1], 9, 9, True)
    told = []
    for key, seen in ((5, False), (2, True), (9, True)):
        row = pa.RecordBatch.from_arrays([one([7], pa.int64()), one([key], pa.int64()), one([0.5], pa.float64()), one([0], pa.int32()), one([seen], pa.bool_())], names=["u", "key", "w", "at", "seen"])
        told += list(sums.offer(row))
    (out,) = told + list(sums.end())
    assert out.column("item").to_pylist() == [1, 3] and out.column("score").to_pylist() == [0.5, None] and np.all(out.column("u").to_numpy() == 7)
