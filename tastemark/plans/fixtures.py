"""The engine's tables as views over the provided star-schema tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemark.functions.scalars import epoch_seconds
from tastemark.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def reviews(spark: SparkSession, sf: str, item: str = "l_suppkey") -> DataFrame:
    """One row per rating: who, what, stars, day and second. Only the needed columns reach the scans."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("date"))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        "l_linenumber",
        F.col(item).alias("item_id"),
        (F.lit(1) + F.floor("l_quantity").cast("int") % 5).cast("int").alias("stars"),
    )
    return lines.join(orders, "o_orderkey").withColumn("ts", epoch_seconds(F.col("date")))


def cells(spark: SparkSession, sf: str, item: str = "l_suppkey") -> DataFrame:
    """User-item cells: repeated ratings add up, the newest time orders the split."""
    return reviews(spark, sf, item).groupBy("user_id", "item_id").agg(
        F.sum(F.col("stars").cast("double")).alias("value"), F.max("ts").alias("ts")
    )


def business(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    key = F.col("s_suppkey")
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            key.alias("item_id"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
            (F.lit(1) + (key % 9) * F.lit(0.5)).cast("double").alias("stars"),
            F.when(key % 7 == 0, None).otherwise(F.repeat(F.lit("$"), (F.lit(1) + key % 4).cast("int"))).alias("price"),
            (F.lit(43.60) + (key % 20) * F.lit(0.01)).cast("double").alias("lat"),
            (F.lit(-79.50) + (key % 25) * F.lit(0.01)).cast("double").alias("lon"),
            (key % 10 != 3).cast("int").alias("is_open"),
        )
    )


def item_categories(spark: SparkSession, sf: str, label: str = "p_type") -> DataFrame:
    """Distinct ``(item_id, category)``; category is the part type, brand or one word of the part name."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col(label).alias("category"))
    lines = table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").alias("item_id"))
    return lines.join(part, "l_partkey").select("item_id", "category").distinct()


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Review texts: 20 sources are the items."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), F.col("source").alias("item"), "text", "lang")
    return spread(docs)
