"""Dense ids that stay: a stored map grows by the keys not seen before, and no id given once ever changes.

A map has ``raw, num, version``; ``num`` runs from 0 without gaps, ``version`` is the load that brought the key.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemark.operators.ranking import global_index


def new_ids(keys: DataFrame, raw: str, num: str, known: DataFrame | None = None) -> DataFrame:
    """Rows to add to ``known`` (raw, num, version): the unseen keys in sorted order, numbered on from its last id.

    Null keys get no id. A repeated key is one. Without ``known`` this is the first load, version 0. Positions come from
    ranges of the keys and the last id is a scalar subquery, so nothing but that one number is in one place.
    """
    fresh = keys.select(raw).where(F.col(raw).isNotNull()).distinct()
    if known is None:
        return global_index(fresh, [raw], num).select(raw, F.col(num).cast("long").alias(num), F.lit(0).alias("version"))
    unseen = fresh.join(known.select(raw), raw, "left_anti")
    after, version = (known.agg(F.coalesce(F.max(c) + 1, F.lit(0))).scalar() for c in (num, "version"))
    return global_index(unseen, [raw], "_at").select(raw, (F.col("_at") + after).cast("long").alias(num), version.cast("int").alias("version"))


def read_ids(spark: SparkSession, path: str, raw: str, num: str, kind: str = "long") -> DataFrame:
    return spark.read.schema(f"{raw} {kind}, {num} long, version int").parquet(path)


def store_ids(keys: DataFrame, path: str, raw: str, num: str) -> DataFrame:
    """Append the unseen keys to the map at ``path`` (made if it is not there) and return the whole map.

    Each load is a folder of its own, committed as one job; a load that died leaves no version behind and is simply run
    again. Loads into one map follow each other.
    """
    spark, kind = keys.sparkSession, keys.schema[raw].dataType.simpleString()
    if not _is_there(spark, path):
        new_ids(keys, raw, num).drop("version").write.mode("overwrite").parquet(os.path.join(path, "version=0"))
        return read_ids(spark, path, raw, num, kind)
    known = read_ids(spark, path, raw, num, kind)
    # the version names the folder; a load without new keys adds an empty one
    version = max([0, *(int(name) + 1 for name in _versions(spark, path))])
    new_ids(keys, raw, num, known).drop("version").write.mode("overwrite").parquet(os.path.join(path, f"version={version}"))
    return read_ids(spark, path, raw, num, kind)


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Versions whose job was committed."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return []
    found = files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "version=*/_SUCCESS"))
    return [s.getPath().getParent().getName().split("=", 1)[1] for s in found or []]


def _is_there(spark: SparkSession, path: str) -> bool:
    return bool(_versions(spark, path))
