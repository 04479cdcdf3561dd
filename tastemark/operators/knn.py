"""Neighbourhood scores and ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemark.lookups import FOLD_IN_NEIGHBOURS, LIST_LENGTH
from tastemark.operators.ranking import group_rank, top_per_group
from tastemark.operators.similarity import neighbours

SCORE_DIGITS = 9


def as_matrix(ratings: DataFrame, row: str = "user_id", col: str = "item_id", value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Ratings as ``(row, col, value)`` cells for the similarity operators."""
    return ratings.select(*keep, F.col(row).alias("row"), F.col(col).alias("col"), F.col(value).alias("value"))


def _weighted(nbrs: DataFrame, ratings: DataFrame, item_based: bool, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Neighbour rows joined with the ratings of the neighbour; a hot neighbour is split by the skew join."""
    keys = list(keys)
    on = "item_id" if item_based else "user_id"
    shared = [c for c in keys if c in ratings.columns]
    joined = ratings.join(nbrs.withColumnRenamed("nbr", on), [*shared, on])
    joined = joined.drop(on).withColumnRenamed("id", on)
    return joined, [*keys, "user_id", "item_id"]


def score(nbrs: DataFrame, ratings: DataFrame, item_based: bool = False, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """``(user_id, item_id, score)``: sum over neighbours of similarity times rating, not divided by the similarities."""
    joined, keys = _weighted(nbrs.select(*by, "id", "nbr", "sim"), ratings, item_based, by)
    return joined.groupBy(*keys).agg(F.round(F.sum(F.col("sim") * F.col(value)), SCORE_DIGITS).alias("score"))


def sweep_scores(nbrs: DataFrame, ratings: DataFrame, ks: Sequence[int], item_based: bool = False, by: Sequence[str] = (), value: str = "value", seen: DataFrame | None = None) -> DataFrame:
    """Scores for every neighbourhood size in one aggregation: ``(k, user_id, item_id, score)``.

    Each neighbour rating is read once; the sizes are conditional sums, not repeated rows. Items a user has in ``seen``
    are left out before the sizes become rows.
    """
    ks = sorted(ks)
    joined, keys = _weighted(nbrs.where(F.col("rank") <= ks[-1]).select(*by, "id", "nbr", "sim", "rank"), ratings, item_based, by)
    part = F.col("sim") * F.col(value)
    sums = [F.round(F.sum(F.when(F.col("rank") <= k, part)), SCORE_DIGITS).alias(f"k{k}") for k in ks]
    wide = joined.groupBy(*keys).agg(*sums)
    wide = wide if seen is None else unseen(wide, seen, by)
    sizes = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("score")) for k in ks])).alias("s")
    return wide.select(*keys, sizes).select(*keys, "s.k", "s.score").where(F.col("score").isNotNull())


def unseen(scores: DataFrame, seen: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scores without the items a user has in the train part."""
    keys = [*[c for c in by if c in seen.columns], "user_id", "item_id"]
    return scores.join(seen.select(*keys).distinct(), keys, "left_anti")


def ranked_order() -> list[Column]:
    return [F.col("score").desc(), F.col("item_id")]


def top_k(scores: DataFrame, seen: DataFrame | None = None, k: int = LIST_LENGTH, by: Sequence[str] = ()) -> DataFrame:
    """Best ``k`` unseen items per user: ``(user_id, rank, item_id, score)``, ties by smaller item id."""
    rest = scores if seen is None else unseen(scores, seen, by)
    return top_per_group(rest, [*by, "user_id"], ranked_order(), k)


def full_ranking(scores: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Every unseen scored item of every user, ranked. Long lists are ranked in ranges of the score."""
    rest = scores if seen is None else unseen(scores, seen)
    return group_rank(rest, ["user_id"], ranked_order(), "rank", "_n").drop("_n")


def without_known(recs: DataFrame, known: DataFrame) -> DataFrame:
    """Drop known items from a finished list and close the gaps in the rank."""
    rest = recs.join(known.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")
    return top_per_group(rest.withColumnRenamed("rank", "_old"), ["user_id"], [F.col("_old")], 2**31 - 1).drop("_old")


def fold_in(item_neighbours: DataFrame, new_ratings: DataFrame, k: int = FOLD_IN_NEIGHBOURS) -> DataFrame:
    """Item-based scores of new users from the ratings they start with, without refitting."""
    return score(item_neighbours.where(F.col("rank") <= k), new_ratings, item_based=True)


def liked_as_ratings(liked: DataFrame, stars: float = 5.0) -> DataFrame:
    """Liked items of a new user as ratings of ``stars``."""
    return liked.select("user_id", "item_id").distinct().withColumn("value", F.lit(float(stars)))


def fitted_neighbours(train: DataFrame, entire: DataFrame, k: int) -> DataFrame:
    """Neighbour weights of users and of items, on the train part and on all data, as one table."""
    out = None
    for name, data in (("train", train), ("entire", entire)):
        for axis, (row, col) in (("user", ("user_id", "item_id")), ("item", ("item_id", "user_id"))):
            part = neighbours(as_matrix(data, row, col), k).select(F.lit(name).alias("data"), F.lit(axis).alias("axis"), "id", "nbr", "sim", "rank")
            out = part if out is None else out.unionByName(part)
    return out
