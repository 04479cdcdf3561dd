"""Sparse matrices as long tables: one row per stored cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemark.lookups import LIKE_THRESHOLD
from tastemark.operators.ranking import with_dense_id


def coo(df: DataFrame, row: str, col: str, value: Column | None = None, dedupe: str | None = None, ts: str | None = None) -> DataFrame:
    """Cells ``(row, col, value[, ts])``; repeated cells add up (values and, like the values, their times).

    ``dedupe="latest"`` keeps the value of the newest repeat instead and needs ``ts``.
    """
    value = F.lit(1.0) if value is None else value.cast("double")
    grouped = df.groupBy(F.col(row).alias("row"), F.col(col).alias("col"))
    if dedupe == "latest":
        if ts is None:
            raise ValueError('dedupe="latest" needs ts')
        newest = F.max(F.struct(F.col(ts).alias("t"), value.alias("v")))
        return grouped.agg(newest.alias("n")).select("row", "col", F.col("n.v").alias("value"), F.col("n.t").alias("ts"))
    aggs = [F.sum(value).alias("value")]
    if ts is not None:
        aggs.append(F.sum(ts).alias("ts"))
    return grouped.agg(*aggs)


def rating_matrices(ratings: DataFrame, deviation: str | None = None) -> DataFrame:
    """Rating and time matrices in one pass: ``(user_id, item_id, value, ts_sum, ts[, deviation])``.

    ``ts_sum`` adds the times of repeats up, ``ts`` is the newest time and orders the split.
    """
    aggs = [F.sum(F.col("stars").cast("double")).alias("value"), F.sum("ts").alias("ts_sum"), F.max("ts").alias("ts")]
    if deviation:
        aggs.append(F.sum(deviation).alias(deviation))
    return ratings.groupBy("user_id", "item_id").agg(*aggs)


def above(cells: DataFrame, threshold: float = LIKE_THRESHOLD, inclusive: bool = False, value: str = "value") -> DataFrame:
    """Implicit matrix: cells above the threshold become 1, the others are absent."""
    keep = F.col(value) >= threshold if inclusive else F.col(value) > threshold
    return cells.where(keep).withColumn(value, F.lit(1.0))


def visits(cells: DataFrame) -> DataFrame:
    """Visit matrix: every positive cell becomes 1."""
    return above(cells, 0.0)


def centre(cells: DataFrame, by: str = "user_id", value: str = "value", shift: float = 0.001) -> DataFrame:
    """Value minus the mean of the stored values of its row plus ``shift``, so cells at the mean stay stored."""
    means = cells.groupBy(by).agg(F.avg(value).alias("_mean"))
    return cells.join(means, by).withColumn(value, F.col(value) - F.col("_mean") + F.lit(shift)).drop("_mean")


def item_category(item_categories: DataFrame, category_ids: DataFrame) -> DataFrame:
    """Item-category cells ``(item_id, category_id, value)``; repeated labels of an item add up."""
    return (
        item_categories.join(category_ids, "category")
        .groupBy("item_id", "category_id")
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )


def user_category(ratings: DataFrame, item_cat: DataFrame, by: str = "category_id") -> DataFrame:
    """User-category cells: ratings matrix times item-category matrix (partial sums before the shuffle)."""
    weighted = ratings.select("user_id", "item_id", F.col("value").alias("_r")).join(item_cat, "item_id")
    return weighted.groupBy("user_id", by).agg(F.sum(F.col("_r") * F.col("value")).alias("value"))


def keyed_terms(term_counts: DataFrame, key: str, binary: bool = True) -> DataFrame:
    """Item-keyword or user-keyword cells from per-review term counts ``(review_id, key, term, tf)``.

    Binary mode adds one per review that holds the term, otherwise the counts add up.
    """
    value = F.count(F.lit(1)).cast("double") if binary else F.sum("tf").cast("double")
    return term_counts.groupBy(key, "term").agg(value.alias("value"))


def concat_blocks(keyword: DataFrame, user: DataFrame, ratio: float, user_offset: int | None = None) -> DataFrame:
    """Block matrix of item-keyword and item-user cells, weighted ``ratio`` and ``1 - ratio``.

    User columns are shifted by ``user_offset``; ``None`` lets user j and keyword j share column j and add up.
    """
    left = keyword.select("row", "col", (F.col("value") * F.lit(float(ratio))).alias("value"))
    shift = F.lit(int(user_offset or 0))
    right = user.select("row", (F.col("col") + shift).alias("col"), (F.col("value") * F.lit(1.0 - float(ratio))).alias("value"))
    return left.unionByName(right).groupBy("row", "col").agg(F.sum("value").alias("value"))


def add(*parts: DataFrame) -> DataFrame:
    """Cell-wise sum of matrices ``(user_id, item_id, value)``."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("user_id", "item_id").agg(F.sum("value").alias("value"))


def append_rows(cells: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Append the cells of new rows."""
    return cells.unionByName(new_rows.select(*cells.columns))


def new_user_vectors(new_ratings: DataFrame) -> DataFrame:
    """Explicit, implicit and centred value of each rating of a new user."""
    centred = centre(new_ratings.withColumn("centred", F.col("value")), value="centred")
    return centred.withColumn("implicit", F.when(F.col("value") > LIKE_THRESHOLD, 1.0).otherwise(0.0))


def remove_empty(cells: DataFrame) -> DataFrame:
    """Compact ids: users and items that hold a cell are renumbered, the original ids are kept beside them."""
    return with_dense_id(with_dense_id(cells, "user_id", "user_num_id"), "item_id", "item_num_id")
