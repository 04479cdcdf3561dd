"""Sketches that are stored per part of a table and merged when asked: distinct counts (HyperLogLog) and quantiles (KLL).

A part is read once; later questions over any union of parts, such as a year of months, read a few kilobytes a part.
Both sides are aggregated before the shuffle, so a hot group travels as one sketch per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct count as a power of two; its standard error is 1.04 over their root, 0.8 % here.
LG_K = 14
#: Size of a quantile sketch; the rank of an answer is off by about 0.4 % of the rows at 99 % certainty.
KLL_K = 800


def distinct_error(lg_k: int = LG_K) -> float:
    return 1.04 / 2 ** (lg_k / 2)


def sketch(df: DataFrame, keys: Sequence[str], distinct: Sequence[str] = (), quantiles: Sequence[str] = (), lg_k: int = LG_K, kll_k: int = KLL_K) -> DataFrame:
    """One row per part: ``keys``, ``rows``, ``<c>_distinct`` and ``<c>_quantiles`` as binary sketches. Nulls are not counted."""
    counts = [F.hll_sketch_agg(c, lg_k).alias(f"{c}_distinct") for c in distinct]
    shapes = [F.kll_sketch_agg_double(F.col(c).cast("double"), kll_k).alias(f"{c}_quantiles") for c in quantiles]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *counts, *shapes)


def merge(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sketches of unions of parts, in the same columns."""
    counts = [F.hll_union_agg(c).alias(c) for c in parts.columns if c.endswith("_distinct")]
    shapes = [F.kll_merge_agg_double(c).alias(c) for c in parts.columns if c.endswith("_quantiles")]
    return parts.groupBy(*keys).agg(F.sum("rows").alias("rows"), *counts, *shapes)


def distinct_of(c: str) -> Column:
    return F.hll_sketch_estimate(f"{c}_distinct")


def quantile_of(c: str, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(f"{c}_quantiles", F.lit(share))
