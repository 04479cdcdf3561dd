"""Frequency tables, histograms and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemark.operators.ranking import top_rows

PIVOT_LIMIT = 1000


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Rows per value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values of each column, one row."""
    fn = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(*[fn(c).alias(c) for c in columns])


def count_histogram(df: DataFrame, key: str, bins: int = 70, log: bool = False) -> DataFrame:
    """Equal-width bins of rows per key (or of its logarithm): ``(bin, lo, hi, keys)``; the last bin is closed."""
    counts = frequency(df, key)
    value = F.log("count") if log else F.col("count").cast("double")
    sizes = counts.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("m"))
    low, high = sizes.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return sizes.select(F.lit(0).alias("bin"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.col("m").alias("keys"))
    width = (high - low) / bins or 1.0 / bins
    bucket = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    filled = sizes.groupBy(bucket.alias("bin")).agg(F.sum("m").alias("keys"))
    return filled.select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("lo"), (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "keys")


def count_of_counts(df: DataFrame, key: str) -> DataFrame:
    """How many keys have each number of rows."""
    return frequency(df, key).groupBy("count").agg(F.count(F.lit(1)).alias("keys"))


def utility_matrix(reviews: DataFrame, items: Sequence[int], stars: str = "stars") -> DataFrame:
    """Users by a short list of items, mean stars, 0 where unrated. Long form is the way for large item lists."""
    if len(items) > PIVOT_LIMIT:
        raise ValueError(f"pivot at most {PIVOT_LIMIT} items; use the long form beyond")
    wide = reviews.groupBy("user_id").pivot("item_id", list(items)).agg(F.avg(stars))
    return wide.na.fill(0.0)


def one_hot(df: DataFrame, key: str, column: str, values: Sequence, prefix: str) -> DataFrame:
    """0/1 column per value."""
    flags = [F.max((F.col(column) == v).cast("int")).alias(f"{prefix}{i}") for i, v in enumerate(values)]
    return df.groupBy(key).agg(*flags).na.fill(0)


def moments(df: DataFrame, value: Column) -> DataFrame:
    """Mean, population standard deviation and size."""
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("size"))


def describe(df: DataFrame, value: Column, approximate: bool = False) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum."""
    quartile = (lambda q: F.percentile_approx(value, q)) if approximate else (lambda q: F.percentile(value, F.lit(q)))
    return df.agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        quartile(0.25).alias("p25"), quartile(0.5).alias("p50"), quartile(0.75).alias("p75"), F.max(value).alias("max"),
    )


def threshold_summary(df: DataFrame, key: str, more_than: int) -> DataFrame:
    """Keys with more than ``more_than`` rows and the sum of their rows."""
    return frequency(df, key).where(F.col("count") > more_than).agg(
        F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")
    )


def attribute_keys(df: DataFrame, column: str = "attributes") -> DataFrame:
    """How often each attribute key occurs."""
    return df.select(F.explode(F.map_keys(column)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("count"))


def category_words(df: DataFrame, column: str = "categories") -> DataFrame:
    """How often each word of the category text occurs; commas, points and ampersands are stripped."""
    words = df.select(F.explode(F.split(column, " ")).alias("w")).select(F.regexp_replace("w", r"^[,.&]+|[,.&]+$", "").alias("word"))
    return words.where(F.col("word") != "").groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def most_frequent(df: DataFrame, column: str, k: int) -> DataFrame:
    return top_rows(frequency(df, column), [F.col("count").desc(), F.col(column)], k, "rank")
