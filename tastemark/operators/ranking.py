"""Ranking that does not put a large group, or the whole table, into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemark.session import cut


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per group. ``row_number() <= k`` is planned as a window group limit: every map task keeps at
    most ``k`` rows per group before the shuffle, so a hot group stays small."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(window)).where(F.col(rank_col) <= k)


def _ranged(df: DataFrame, order: Sequence[str | Column], pieces: int | None = None) -> DataFrame:
    """Rows with ``_piece``, the number of the key range they fall in, by Spark's range partitioning.

    The table is written once, so that every branch that reads it sees the same ranges, also after a lost executor.
    """
    parts = df.repartitionByRange(pieces, *order) if pieces else df.repartitionByRange(*order)
    return cut(parts.withColumn("_piece", F.spark_partition_id()))


def group_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column], rank_col: str = "pos", count_col: str = "n", pieces: int | None = None) -> DataFrame:
    """1-based position in the group and group size, for groups of any size; null group values are a group.

    Rows are ranked inside ranges of (group, order) and shifted by the rows of the group in earlier ranges, so a large
    group is spread over as many tasks as it has ranges. A window over a group sees one row per range. ``pieces`` sets
    the number of ranges; otherwise it follows the data and the session.
    """
    ranged = _ranged(df, [*[F.col(c) for c in group], *order], pieces).withColumn("_group", F.struct(*group))
    sizes = ranged.groupBy("_group", "_piece").agg(F.count(F.lit(1)).alias("_m"))
    whole = Window.partitionBy("_group")
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_group", "_piece", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.sum("_m").over(whole).alias(count_col))
    local = Window.partitionBy("_group", "_piece").orderBy(*order)
    ranked = ranged.withColumn("_local", F.row_number().over(local)).join(shifts, ["_group", "_piece"])
    return ranked.withColumn(rank_col, F.col("_local") + F.col("_before")).drop("_group", "_piece", "_local", "_before")


def global_index(
    df: DataFrame, keys: Sequence[str], index_col: str = "idx", total_col: str | None = None, pieces: int | None = None
) -> DataFrame:
    """0-based position of every row in the order of ``keys`` (which must be unique), without a one-task sort.

    Rows are numbered inside key ranges; each range is shifted by the rows before it. ``pieces`` sets the number of
    ranges, else it is that of the session's shuffle partitions.
    """
    ranged = _ranged(df, [F.col(k) for k in keys], pieces)
    counts = ranged.groupBy("_piece").agg(F.count(F.lit(1)).alias("_m"))  # one row per range from here on
    seen = Window.partitionBy(F.lit(0)).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        "_piece",
        F.coalesce(F.sum("_m").over(seen), F.lit(0)).alias("_before"),
        F.sum("_m").over(Window.partitionBy(F.lit(0))).alias("_rows"),
    )
    local = Window.partitionBy("_piece").orderBy(*keys)
    out = (
        ranged.withColumn("_local", F.row_number().over(local))
        .join(F.broadcast(shifts), "_piece")
        .withColumn(index_col, F.col("_before") + F.col("_local") - 1)
    )
    if total_col:
        out = out.withColumn(total_col, F.col("_rows"))
    return out.drop("_piece", "_local", "_before", "_rows")


def dense_ids(df: DataFrame, raw: str, num: str) -> DataFrame:
    """Id map: 0-based rank of each raw id among the sorted distinct ids."""
    return global_index(df.select(raw).where(F.col(raw).isNotNull()).distinct(), [raw], num)


def with_dense_id(df: DataFrame, raw: str, num: str) -> DataFrame:
    """Attach the dense id of ``raw`` to every row."""
    return df.join(dense_ids(df, raw, num), raw)


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``. The group limit keeps one row per key and map task."""
    return top_per_group(df, key, order, 1, "_first").drop("_first")


def keep_unrepeated(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key occurs exactly once; every member of a repeated key is dropped.

    Aggregated (count and one row) rather than windowed, so a key with many copies never sits in one task.
    """
    rest = [c for c in df.columns if c not in key]
    row = F.struct(*rest) if rest else F.struct(F.lit(1).alias("one"))
    return (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"), F.first(row).alias("_row"))
        .where(F.col("_n") == 1)
        .select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])
    )


def top_with_ties(df: DataFrame, group: Sequence[str], score: str, k: int, rank_col: str = "rank") -> DataFrame:
    """Rows scoring at least as much as the k-th row of the group."""
    window = Window.partitionBy(*group).orderBy(F.col(score).desc())
    return df.withColumn(rank_col, F.rank().over(window)).where(F.col(rank_col) <= k)


def top_rows(df: DataFrame, order: Sequence[Column], k: int, rank_col: str | None = None) -> DataFrame:
    """First ``k`` rows of the table; the rank is added to the ``k`` rows only."""
    head = df.orderBy(*order).limit(k)
    if rank_col is None:
        return head
    return head.withColumn(rank_col, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
