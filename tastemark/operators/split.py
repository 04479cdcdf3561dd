"""Train / validation / test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemark.lookups import LIKE_THRESHOLD, SPLIT_RATIO
from tastemark.operators.ranking import global_index, group_rank


def by_user_time(
    cells: DataFrame,
    ratio: Sequence[float] = SPLIT_RATIO,
    train_share: float = 1.0,
    side: str = "newest",
    implicit: bool = False,
    by: Sequence[str] = ("user_id",),
) -> DataFrame:
    """Time-ordered split per user: adds ``split`` in train, valid, test.

    The last ``int(n * test)`` ratings are test, the ones before them up to ``int(n * (valid + test))`` valid, the
    rest train. ``train_share`` keeps that share of the train rows, newest or oldest first; other train rows drop out.
    """
    if implicit:
        cells = cells.where(F.col("value") > LIKE_THRESHOLD).withColumn("value", F.lit(1.0))
    ranked = group_rank(cells, list(by), [F.col("ts"), F.col("item_id")], "_pos", "_n")
    return assign_split(ranked, ratio, train_share, side).drop("_pos", "_n")


def assign_split(ranked: DataFrame, ratio: Sequence[float], train_share: float = 1.0, side: str = "newest") -> DataFrame:
    """Split name from the position ``_pos`` in a user's ``_n`` ratings."""
    n, pos = F.col("_n"), F.col("_pos")
    n_test = F.floor(n * F.lit(float(ratio[2])))
    n_hold = F.floor(n * F.lit(float(ratio[1]) + float(ratio[2])))
    n_train = n - n_hold
    kept = F.floor(n_train * F.lit(float(train_share)))
    in_sample: Column = pos > n_train - kept if side == "newest" else pos <= kept
    name = (
        F.when(pos > n - n_test, "test")
        .when(pos > n_train, "valid")
        .when(in_sample, "train")
    )
    return ranked.withColumn("split", name).where(F.col("split").isNotNull())


def binarise_holdout(split: DataFrame, value: str = "value", centred: str | None = None) -> DataFrame:
    """Hold-out targets as 0/1: valid rows liked at 4 or more; centred values above 0 in valid and test."""
    held = F.col("split") == "valid"
    out = split.withColumn(value, F.when(held, (F.col(value) >= 4).cast("double")).otherwise(F.col(value)))
    if centred:
        later = F.col("split").isin("valid", "test")
        out = out.withColumn(centred, F.when(later, (F.col(centred) > 0).cast("double")).otherwise(F.col(centred)))
    return out


def train_part(split: DataFrame, final: bool = False) -> DataFrame:
    """Train rows; ``final`` adds the valid rows, as for the last test."""
    return split.where(F.col("split").isin("train", "valid") if final else F.col("split") == "train")


def by_global_time(df: DataFrame, keys: Sequence[str], train_share: float = 0.8) -> DataFrame:
    """Chronological split of the whole table: the first ``ceil(share * N)`` rows in ``keys`` order are train."""
    indexed = global_index(df, keys, "_idx", "_total")
    train = F.col("_idx") < F.ceil(F.lit(float(train_share)) * F.col("_total"))
    return indexed.withColumn("split", F.when(train, "train").otherwise("test")).drop("_idx", "_total")


def by_hash(df: DataFrame, key: str, seed: int = 66, train_percent: int = 80) -> DataFrame:
    """Hold-out split that depends on the row key only, not on partitions."""
    digits = F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 7)
    bucket = F.conv(digits, 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(bucket < train_percent, "train").otherwise("test"))


def corpus_rows(df: DataFrame, train: DataFrame) -> DataFrame:
    """Rows of ``df`` whose (user, item) is in the train part."""
    return df.join(train.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_semi")
