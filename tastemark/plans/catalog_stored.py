"""Queries on what is stored once and used again: ids that stay, sketches of months, bucketed matrices."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tastemark.operators import id_maps, sketches
from tastemark.plans import fixtures
from tastemark.plans.catalog_models import _part, _parts
from tastemark.plans.registry import SPLIT, query
from tastemark.session import cut, shared_folder
from tastemark.sources.writers import write_bucketed

#: Days that end the loads of the id map; the last load has the rest.
_LOADS = ("1992-03-01", "1992-09-01")
_QUARTILES = (0.25, 0.5, 0.75)
#: Buckets of the two parts of the split.
BUCKETS = 16


def _loads_sql() -> str:
    ends = [f"o_orderdate < TIMESTAMP '{day}'" for day in _LOADS] + ["TRUE"]
    load = "CASE " + " ".join(f"WHEN {test} THEN {i}" for i, test in enumerate(ends)) + " END"
    return f"""WITH first AS (SELECT o_custkey AS user_id, min({load}) AS version FROM orders GROUP BY o_custkey)
SELECT user_id, row_number() OVER (ORDER BY version, user_id) - 1 AS num, version FROM first"""


@query(_loads_sql())
def stable_user_ids(spark, sf):
    """Users numbered load by load, as orders come in: later loads leave earlier ids alone."""
    orders = fixtures.table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at"))
    path = os.path.join(shared_folder(spark), f"ids-{uuid.uuid4().hex}")
    for day in _LOADS:
        id_maps.store_ids(orders.where(F.col("at") < F.lit(day).cast("timestamp")), path, "user_id", "num")
    return id_maps.store_ids(orders, path, "user_id", "num")


@query("""SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS reviews, TRUE AS users_within, TRUE AS quartiles_within
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def years_from_monthly_sketches(spark, sf):
    """Sketches of months merged to years, held against the exact figures: users within four standard errors, the ranks of the quartiles within one hundredth."""
    orders = fixtures.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("user"), "o_orderdate")
    lines = fixtures.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").cast("double").alias("price"))
    rows = lines.join(orders, "o_orderkey").select("user", "price", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    months = cut(sketches.sketch(rows, ["year", "month"], ["user"], ["price"]))
    years = sketches.merge(months, ["year"])
    told = years.select("year", F.col("rows").alias("reviews"), sketches.distinct_of("user").alias("users"), *[sketches.quantile_of("price", p).alias(f"q{i}") for i, p in enumerate(_QUARTILES)])
    told = F.broadcast(cut(told))  # a row a year
    below = [f(F.when(test, 1).otherwise(0)).alias(f"{name}{i}") for i in range(len(_QUARTILES)) for f, test, name in ((F.avg, F.col("price") < F.col(f"q{i}"), "lt"), (F.avg, F.col("price") <= F.col(f"q{i}"), "le"))]
    exact = rows.select("year", "user", "price").join(told, "year").groupBy("year", "reviews", "users").agg(F.count_distinct("user").alias("true_users"), *below)
    near = F.abs(F.col("users") - F.col("true_users")) <= F.greatest(F.lit(1.0), F.lit(4 * sketches.distinct_error()) * F.col("true_users"))
    right = [(F.col(f"lt{i}") <= p + 0.01) & (F.col(f"le{i}") >= p - 0.01) for i, p in enumerate(_QUARTILES)]
    return exact.select("year", "reviews", near.alias("users_within"), (right[0] & right[1] & right[2]).alias("quartiles_within"))


@query(f"""WITH {SPLIT}, means AS (SELECT user_id, sum(value) / count(*) AS mean FROM train GROUP BY user_id),
held AS (SELECT user_id, item_id, value FROM split WHERE split = 'test')
SELECT user_id, count(*) AS n, round(avg(abs(value - mean)), 6) AS mae, round(sqrt(avg((value - mean) * (value - mean))), 6) AS rmse FROM held JOIN means USING (user_id) GROUP BY user_id""")
def user_mean_errors_bucketed(spark, sf):
    """Per user, how far held-out ratings lie from the mean of the training ratings: two bucketed matrices, no exchange after they are stored."""
    parts, run = cut(_parts(spark, sf)), uuid.uuid4().hex
    train, held = (
        write_bucketed(_part(parts, part), f"cells_{part}_{run}", os.path.join(shared_folder(spark), f"buckets-{part}-{run}"), "user_id", BUCKETS) for part in ("train", "test")
    )
    means = train.groupBy("user_id").agg((F.sum("value") / F.count(F.lit(1))).alias("mean"))
    off = F.col("value") - F.col("mean")
    met = held.hint("merge").join(means, "user_id")
    return met.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(off)), 6).alias("mae"), F.round(F.sqrt(F.avg(off * off)), 6).alias("rmse"))
