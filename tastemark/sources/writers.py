"""Sinks: CSV, JSON lines, matrices, lookups, slices and the tables of one run."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemark.operators.ranking import global_index


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_matrix(cells: DataFrame, path: str, row: str = "row") -> None:
    """Cells clustered by row, so a reader of some rows skips most row groups."""
    cells.repartitionByRange(F.col(row)).sortWithinPartitions(row).write.mode("overwrite").parquet(path)


def write_bucketed(cells: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Cells as a table ``name`` of hash buckets sorted by ``key``, one file a bucket, and the table read back.

    Joins on ``key`` with tables of as many buckets and aggregations by ``key`` need no exchange. Choose ``buckets`` so that
    one fits a task; a key's cells are one bucket's.
    """
    ready = cells.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    ready.mode("overwrite").format("parquet").option("path", path).saveAsTable(name)
    return cells.sparkSession.table(name)


def write_lookup(df: DataFrame, path: str) -> None:
    """A dictionary, id map or location table."""
    df.write.mode("overwrite").parquet(path)


def with_slice(df: DataFrame, keys: Sequence[str], slices: int) -> DataFrame:
    """Number the rows in key order and cut them into ``slices`` equal runs; a remainder becomes one slice more."""
    indexed = global_index(df, keys, "_idx", "_total")
    size = F.greatest(F.floor(F.col("_total") / slices), F.lit(1))
    return indexed.withColumn("slice", F.least(F.floor(F.col("_idx") / size), F.lit(slices)).cast("int")).drop("_idx", "_total")


def write_slices(df: DataFrame, keys: Sequence[str], slices: int, path: str) -> None:
    with_slice(df, keys, slices).write.mode("overwrite").partitionBy("slice").parquet(path)


def write_run(tables: Mapping[str, DataFrame], folder: str) -> None:
    """The named tables of one run under one folder, as parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(folder, name))
