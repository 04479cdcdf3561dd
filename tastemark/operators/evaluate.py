"""Ranking metrics computed from hits only, all cut-offs in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemark.lookups import EVAL_CUTOFFS


def _harmonic(low: Column, high: Column) -> Column:
    """Sum of ``1 / p`` for ``low <= p <= high`` (0 when empty)."""
    steps = F.sequence(low.cast("int"), F.greatest(high, low).cast("int"))
    return F.when(low > high, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda a, p: a + F.lit(1.0) / p))


def per_user(recs: DataFrame, truth: DataFrame, ks: Sequence[int] = EVAL_CUTOFFS, by: Sequence[str] = (), mode: str = "reference") -> DataFrame:
    """Metrics of each user that has a list and at least one true item, one column per metric.

    ``recs`` holds ``(user_id, rank, item_id)``, ``truth`` ``(user_id, item_id)``. Recall, precision and average
    precision are cut at each k; R-precision, NDCG and clicks use the whole list. Average precision is the mean over
    all positions of hits so far over position; the ideal NDCG runs over all true items. ``mode="standard"`` averages
    over hits and cuts the ideal at the list length instead.

    Average precision needs only the hits: a hit at rank h adds ``1/p`` at every later position p.
    """
    by = [*by]
    keys = [*by, "user_id"]
    true_keys = [c for c in keys if c in truth.columns]
    true_items = truth.select(*true_keys, "item_id").distinct()
    n_true = true_items.groupBy(*true_keys).agg(F.count(F.lit(1)).alias("n_true"))
    hit_rows = true_items.withColumn("_hit", F.lit(1))
    marked = recs.select(*keys, "rank", "item_id").join(hit_rows, [*true_keys, "item_id"], "left")
    hit = F.col("_hit") == 1
    rank = F.col("rank")
    aggs = [
        F.max("rank").alias("length"),
        F.min(F.when(hit, rank)).alias("first_hit"),
        F.sum(F.when(hit, F.lit(1.0) / F.log2(rank + 1))).alias("dcg"),
        F.sort_array(F.collect_list(F.when(hit, rank))).alias("hit_ranks"),  # at most the list length
    ]
    lists = marked.groupBy(*keys).agg(*aggs).join(n_true, true_keys)
    ranks, length, true_count = F.col("hit_ranks"), F.col("length"), F.col("n_true")

    def hits_to(limit: Column) -> Column:
        return F.size(F.filter(ranks, lambda r: r <= limit))

    columns = []
    for k in ks:
        cut = F.least(F.lit(k), length)
        hits = hits_to(cut)
        if mode == "standard":
            within = F.filter(ranks, lambda r: r <= cut)
            total = F.aggregate(F.transform(within, lambda r, i: (i + 1) / r), F.lit(0.0), lambda a, v: a + v)
            ap = total / F.least(F.lit(k), true_count)
        else:
            total = F.aggregate(F.filter(ranks, lambda r: r <= cut), F.lit(0.0), lambda a, r: a + _harmonic(r, cut))
            ap = total / cut
        columns += [ap.alias(f"MAP@{k}"), (hits / cut).alias(f"Precision@{k}"), (hits / true_count).alias(f"Recall@{k}")]
    ideal_to = F.least(true_count, length.cast("long")) if mode == "standard" else true_count
    ideal = F.aggregate(F.sequence(F.lit(1), ideal_to.cast("int")), F.lit(0.0), lambda a, p: a + F.lit(1.0) / F.log2(p + 1))
    columns += [
        (hits_to(true_count) / true_count).alias("R-Precision"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("NDCG"),
        F.when(F.col("first_hit").isNull(), F.lit(5.0)).otherwise((F.col("first_hit") - 1) / 10).alias("Clicks"),
    ]
    return lists.select(*keys, *columns)


def metric_names(ks: Sequence[int]) -> list[str]:
    return [f"{m}@{k}" for k in ks for m in ("MAP", "Precision", "Recall")] + ["R-Precision", "NDCG", "Clicks"]


def summarise(users: DataFrame, ks: Sequence[int], by: Sequence[str] = (), n_users: int | None = None, digits: int = 4) -> DataFrame:
    """``(name, k, mean, ci95, n)`` rows. The interval divides by the square root of ``n_users`` (all users of the
    matrix, evaluated or not) when given, else by that of the evaluated users."""
    names = metric_names(ks)
    cutoff = "at" if "k" in by else "k"  # a sweep over k keeps its own column
    n = F.count(F.lit(1)).alias("_n")
    stats = [f(F.col(f"`{m}`")).alias(f"{p}{i}") for i, m in enumerate(names) for p, f in (("a", F.avg), ("s", F.stddev_pop))]
    wide = users.groupBy(*by).agg(n, *stats) if by else users.agg(n, *stats)
    size = F.lit(float(n_users)) if n_users is not None else F.col("_n")
    cells = [
        F.struct(
            F.lit(m.split("@")[0]).alias("name"),
            F.lit(int(m.split("@")[1]) if "@" in m else None).cast("int").alias(cutoff),
            F.round(F.col(f"a{i}"), digits).alias("mean"),
            F.round(F.lit(1.96) * F.col(f"s{i}") / F.sqrt(size), digits).alias("ci95"),
        )
        for i, m in enumerate(names)
    ]
    return wide.select(*by, F.col("_n").alias("n"), F.explode(F.array(*cells)).alias("m")).select(*by, "m.*", "n")


def metrics(
    recs: DataFrame,
    truth: DataFrame,
    ks: Sequence[int] = EVAL_CUTOFFS,
    by: Sequence[str] = (),
    n_users: int | None = None,
    mode: str = "reference",
    digits: int = 4,
) -> DataFrame:
    """Mean and confidence interval of every metric."""
    return summarise(per_user(recs, truth, ks, by, mode), ks, by, n_users, digits)


def map_at(recs: DataFrame, truth: DataFrame, k: int = 10, by: Sequence[str] = (), n_users: int | None = None, digits: int = 6) -> DataFrame:
    """MAP at one cut-off: ``(by..., map, ci95, n)``."""
    users = per_user(recs.where(F.col("rank") <= k), truth, [k], by)  # average precision reads no place after the cut-off
    rows = summarise(users, [k], by, n_users, digits).where(F.col("name") == "MAP")
    return rows.select(*by, F.col("mean").alias("map"), "ci95", "n")
