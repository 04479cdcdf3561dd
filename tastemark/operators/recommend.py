"""Popularity lists, distance limits, merged lists and item cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemark.functions.scalars import distance_km
from tastemark.lookups import LIST_LENGTH, ORIGINS
from tastemark.operators.ranking import top_per_group, top_rows


def rater_counts(ratings: DataFrame, liked_at: float = 4) -> DataFrame:
    """Users who rated and users who liked each item."""
    return ratings.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("rated"), F.count_if(F.col("value") >= liked_at).alias("liked")
    )


def popular_by_count(items: DataFrame, count: str = "review_count", k: int = LIST_LENGTH) -> DataFrame:
    """Items by review count, one row per item."""
    return top_rows(items.groupBy("item_id").agg(F.max(count).alias(count)), [F.col(count).desc(), F.col("item_id")], k, "rank")


def popular_by_stars(items: DataFrame, ratings: DataFrame, min_raters: int = 50, stars: str = "stars", k: int = LIST_LENGTH) -> DataFrame:
    """Items by average stars; items with at most ``min_raters`` raters are left out."""
    enough = rater_counts(ratings).where(F.col("rated") > min_raters)
    best = items.groupBy("item_id").agg(F.max(stars).alias(stars)).join(enough, "item_id")
    return top_rows(best, [F.col(stars).desc(), F.col("item_id")], k, "rank")


def popular_by_liked(ratings: DataFrame, min_raters: int = 30, ascending: bool = False, k: int = LIST_LENGTH) -> DataFrame:
    """Items by share of likes, 0 for items with at most ``min_raters`` raters; ``ascending`` lists the least liked."""
    share = F.when(F.col("rated") > min_raters, F.col("liked") / F.col("rated")).otherwise(F.lit(0.0))
    scored = rater_counts(ratings).withColumn("share", share)
    return top_rows(scored, [F.col("share").asc() if ascending else F.col("share").desc(), F.col("item_id")], k, "rank")


def same_for_all(users: DataFrame, ranked: DataFrame, k: int = LIST_LENGTH) -> DataFrame:
    """The first ``k`` items of one list for every user, at any ``k``: the list is copied to every part of the users."""
    deals = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = users.select("user_id").distinct().withColumn("_part", F.pmod(F.xxhash64("user_id"), F.lit(deals)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))).alias("_part")
    copies = ranked.where(F.col("rank") <= k).select(F.col("rank").cast("int").alias("rank"), F.col("item_id").cast("long").alias("item_id"), every)
    return parts.join(copies, "_part").select("user_id", "rank", "item_id")


def item_distances(items: DataFrame, origins: Sequence[tuple[str, float, float]] = ORIGINS, ellipsoid: bool = True) -> DataFrame:
    """Distance of every item from every origin: ``(origin, item_id, km)``. Origins are literals, not a join side."""
    points = F.array(*[F.struct(F.lit(n).alias("origin"), F.lit(a).alias("olat"), F.lit(o).alias("olon")) for n, a, o in origins])
    return (
        items.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .select("item_id", "lat", "lon", F.explode(points).alias("o"))
        .select(F.col("o.origin").alias("origin"), "item_id",
                distance_km(F.col("o.olat"), F.col("o.olon"), F.col("lat"), F.col("lon"), ellipsoid).alias("km"))
    )


def within_radius(recs: DataFrame, distances: DataFrame, km: float, n: int, by: Sequence[str] = ("user_id",)) -> DataFrame:
    """First ``n`` items of each list within ``km`` of each origin, list order kept: adds ``origin`` and ``near_rank``."""
    near = distances.where(F.col("km") <= km)
    return top_per_group(recs.join(near, "item_id"), [*by, "origin"], [F.col("rank"), F.col("item_id")], n, "near_rank")


def merge_ranked(lists: DataFrame, by: Sequence[str], n: int = 3) -> DataFrame:
    """Pool the lists of several origins: best original rank per item, first ``n``."""
    pooled = lists.groupBy(*by, "item_id").agg(F.min("rank").alias("best_rank"))
    return top_per_group(pooled, by, [F.col("best_rank"), F.col("item_id")], n)


def category_sizes(item_categories: DataFrame, k: int = 50) -> DataFrame:
    """Items per category, largest first."""
    counts = item_categories.groupBy("category").agg(F.countDistinct("item_id").alias("items"))
    return top_rows(counts, [F.col("items").desc(), F.col("category")], k, "rank")


def category_sizes_near(item_categories: DataFrame, distances: DataFrame, km: float = 2.0, k: int = 50) -> DataFrame:
    """Items per category among the items within ``km`` of any origin."""
    near = distances.where(F.col("km") <= km).select("item_id").distinct()
    return category_sizes(item_categories.join(near, "item_id", "left_semi"), k)


def unwanted_items(items: DataFrame, pattern: str, exact: Sequence[str] = (), column: str = "categories") -> DataFrame:
    """Items whose category text matches the pattern or equals one of ``exact``."""
    hit: Column = F.col(column).rlike(f"(?i){pattern}")
    if exact:
        hit = hit | F.col(column).isin(*exact)
    return items.where(hit).select("item_id").distinct()


def cards(recs: DataFrame, items: DataFrame, distances: DataFrame | None = None, explanations: DataFrame | None = None) -> DataFrame:
    """Recommended ids with what a reader sees: name, categories, price, stars, distance, explanation.

    The item tables are joined without hints; the planner broadcasts them only when their size allows.
    """
    out = recs.join(items, "item_id", "left")
    if distances is not None:
        out = out.join(distances.select("item_id", F.concat(F.col("km").cast("string"), F.lit("km")).alias("distance")), "item_id", "left")
    if explanations is not None:
        out = out.join(explanations, "item_id", "left")
    return out
