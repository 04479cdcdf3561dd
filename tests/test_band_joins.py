"""Distance and interval joins against all pairs; refreshed lists against new fits; values along chains and circles."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tastemark.functions.scalars import distance_km
from tastemark.operators import cosine_join, similarity
from tastemark.operators.band_joins import within_distance, within_intervals
from tastemark.operators.similarity import neighbours


def points(spark, rows, names):
    return spark.createDataFrame(rows, f"{names[0]} long, {names[1]} double, {names[2]} double")


@pytest.mark.parametrize("km", [0.5, 40.0, 900.0, 9000.0])
@pytest.mark.parametrize("ellipsoid", [False, True])
def test_distances_over_the_whole_earth(spark, km, ellipsoid):
    rng = random.Random(km)
    spots = [(0.0, 0.0), (89.99, 10.0), (90.0, 0.0), (-90.0, 77.0), (-89.5, -170.0), (10.0, 180.0), (10.0, -180.0), (-33.0, 179.99), (60.0, -179.999), (43.65, -79.38)]
    near = [(max(-90.0, min(90.0, a + rng.uniform(-2, 2) * km / 110)), (b + rng.uniform(-2, 2) * km / 110 / max(0.02, math.cos(math.radians(a))) + 180) % 360 - 180) for a, b in spots for _ in range(12)]
    every = spots + near + [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(60)]
    left = points(spark, [(i, a, o) for i, (a, o) in enumerate(every)] + [(900, None, 1.0)], ("p", "lat", "lon"))
    right = points(spark, [(i, a, o) for i, (a, o) in enumerate(every[::2])] + [(901, 1.0, None)], ("q", "olat", "olon"))
    got = sorted((r.p, r.q, r.km) for r in within_distance(left, right, km, ellipsoid).collect())
    pairs = left.join(right, F.lit(True)).withColumn("km", distance_km(F.col("olat"), F.col("olon"), F.col("lat"), F.col("lon"), ellipsoid))
    want = sorted((r.p, r.q, r.km) for r in pairs.where((F.col("km") >= 0) & (F.col("km") <= km) & F.col("lat").isNotNull() & F.col("olon").isNotNull()).collect())
    assert got == want and len(want) >= len(every) // 2


def test_distances_use_an_equality_join(spark):
    df = within_distance(points(spark, [(1, 0.0, 0.0)], ("p", "lat", "lon")), points(spark, [(1, 0.0, 0.0)], ("q", "olat", "olon")), 3.0)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell" in plan and "Join Inner, (" in plan and "= _cell" in plan


def test_intervals_against_all_pairs(spark):
    rng = random.Random(4)
    day = lambda n: datetime.date(1995, 1, 1) + datetime.timedelta(days=n)
    rows = [(i, day(rng.randrange(-400, 1500)) if i % 17 else None) for i in range(400)]
    spans = []
    for i in range(300):
        a = rng.randrange(-300, 1400)
        spans.append((i, day(a), day(a + rng.choice([-3, 0, 1, 2, 31, 32, 200, 900]))))
    spans.append((999, None, day(3)))
    left, right = spark.createDataFrame(rows, "r long, date date"), spark.createDataFrame(spans, "w long, low date, high date")
    want = sorted((r, w) for r, d in rows for w, a, b in spans if d and a and a < d < b)
    for bins in (1, 31, 1000):
        assert sorted((x.r, x.w) for x in within_intervals(left, "date", right, bin_days=bins).collect()) == want
    assert len(want) > 5_000


def cells(spark, seed, rows, columns=40, first=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(first + r, c, float(rng.randint(1, 5))) for r in range(rows) for c in range(columns) if rng.random() < 0.15], "row long, col long, value double")


def test_refreshed_lists_equal_a_new_fit(spark):
    old, new = cells(spark, 1, 70), cells(spark, 2, 9, first=1000)
    known = neighbours(old, 4)
    told = lambda df: sorted((r.id, r.nbr, round(r.sim, 6), r["rank"]) for r in df.collect())
    got = told(similarity.refresh_neighbours(known, old, new, 4))
    assert got == told(neighbours(old.unionByName(new), 4))
    before = {r.id: r.nbr for r in known.where("rank = 4").collect()}
    assert any(i in before and not any(x[0] == i and x[1] == before[i] for x in got) for i in before)  # some were let go
    assert told(similarity.refresh_neighbours(known, old, new.limit(0), 4)) == told(known)
    assert told(similarity.refresh_neighbours(known.limit(0), old.limit(0), new, 4)) == told(neighbours(new, 4))


def test_values_along_a_long_chain_and_a_circle(spark):
    links = [(i, i + 1) for i in range(1000)] + [(2000, 2001), (2001, 2002), (2002, 2000), (3000, 2000), (4000, 4001), (5000, 5000)]
    items = [(i, None) for i in range(1000)] + [(1000, "$$$")] + [(i, None) for i in (2000, 2001, 2002, 3000, 4000, 5000, 6000)] + [(4001, "$$")]
    table = spark.createDataFrame(items, "item_id long, price string")
    got = dict(similarity.impute_along_links(table, spark.createDataFrame(links, "id long, similar_id long"), "price", "$").collect())
    assert got == {i: "$$$" for i in range(1001)} | {i: "$" for i in (2000, 2001, 2002, 3000, 5000, 6000)} | {4000: "$$", 4001: "$$"}
    full = table.where("price is not null")
    assert sorted(similarity.impute_along_links(full, spark.createDataFrame(links, "id long, similar_id long"), "price", "$").collect()) == sorted(full.collect())


def test_rows_meet_only_blocks_whose_prefixes_they_share(spark):
    """Groups of rows on columns of their own, and one column that all rows hold: that one alone leads to no meetings."""
    rng = random.Random(9)
    rows = [(30 * g + r, 100 * g + c, 3.0 + rng.random()) for g in range(20) for r in range(30) for c in rng.sample(range(9), 7)] + [(r, 99_999, 1.0) for r in range(600)]
    table = spark.createDataFrame(rows, "row long, col long, value double")
    told = cosine_join.cut(table.selectExpr("0 AS grp", "0 AS src", "row", "col", "value"))
    whole = cosine_join.in_blocks(cosine_join.segments(told, 1), 20, 30)
    _, met = cosine_join.routes(told, whole, 5, [similarity.Recipe("")], 20, 30)
    assert met.count() < 600 * 7  # of 20 blocks and a few for rows that had too few partners in theirs
    got = sorted((r.id, r.nbr, round(r.sim, 6)) for r in neighbours(table, 5, block_rows=30).collect())
    vectors = {}
    for r, c, v in rows:
        vectors.setdefault(r, {})[c] = v
    norm = {r: math.sqrt(sum(x * x for x in v.values())) for r, v in vectors.items()}
    want = []
    for a, v in vectors.items():
        sims = sorted((-round(sum(x * vectors[b].get(c, 0.0) for c, x in v.items()) / norm[a] / norm[b], 9), b) for b in vectors if b != a)[:5]
        want += [(a, b, round(-s, 6)) for s, b in sims]
    assert got == sorted(want)
