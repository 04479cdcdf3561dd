"""Cosine similarities of long-form matrices: neighbour lists, single query rows, combinations of several matrices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemark.operators import cosine_join
from tastemark.operators.cosine_join import SIM_DIGITS, Recipe
from tastemark.operators.ranking import top_per_group
from tastemark.operators.scored_lists import product
from tastemark.session import cut


def combine_recipe(label: str, parts: Sequence[int], method: str | Sequence[float], slots: int | None = 5) -> Recipe:
    """``max``, ``min``, ``average`` or explicit weights over ``parts``.

    With ``slots`` the matrices missing up to that number count as zeros; ``slots=None`` uses the given ones only.
    """
    parts = tuple(parts)
    missing = slots is not None and len(parts) < slots
    if method == "average":
        return Recipe(label, "sum", parts, tuple([1.0 / (slots or len(parts))] * len(parts)))
    if method in ("max", "min"):
        return Recipe(label, method, parts, tuple([1.0] * len(parts)), missing)
    return Recipe(label, "sum", parts, tuple(float(w) for w in method))


def normalise(cells: DataFrame, by: Sequence[str] = ("row",), value: str = "value") -> DataFrame:
    """L2-normalise each row; rows of norm zero drop out (their cosine is 0 with everything)."""
    by = list(by)
    norms = cells.groupBy(*by).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm")).where(F.col("_norm") > 0)
    return cells.join(norms, by).withColumn(value, F.col(value) / F.col("_norm")).drop("_norm")


def neighbours(
    sources: DataFrame | Sequence[DataFrame],
    k: int,
    recipes: Sequence[Recipe] | None = None,
    by: str | None = None,
    block_rows: int | None = None,
    segment_cells: int = cosine_join.SEGMENT_CELLS,
) -> DataFrame:
    """Best ``k`` neighbours ``(id, nbr, sim, rank)`` of every row by cosine, self excluded, ties by smaller id.

    Only positive similarities are kept: a pair without common cells has similarity 0 and adds nothing to a score.
    ``by`` compares rows inside each value of that column only. Several ``recipes`` over several ``sources`` are
    evaluated in the same pass and add a ``recipe`` column.
    """
    many = recipes is not None
    recipes = list(recipes or [Recipe("")])
    sources = [sources] if isinstance(sources, DataFrame) else list(sources)
    cells = None
    for i, source in enumerate(sources):
        part = source.select(
            (F.struct(F.col(by).alias("by")) if by else F.lit(0)).alias("grp"),
            F.lit(i).alias("src"),
            F.col("row").cast("long").alias("row"),
            F.col("col").cast("long").alias("col"),
            F.col("value").cast("double").alias("value"),
        )
        cells = part if cells is None else cells.unionByName(part)
    found = cosine_join.join(cut(cells.where(F.col("value") != 0)), len(sources), k, recipes, block_rows, segment_cells)
    return found.select(*([F.col("grp.by").alias(by)] if by else []), *(["recipe"] if many else []), "id", "nbr", "sim", "rank")


def against(queries: DataFrame, cells: DataFrame, k: int | None = None) -> DataFrame:
    """Cosine of a few query rows with every row: ``(id, nbr, sim[, rank])``.

    Work is bounded by the cells that share a column with a query, not by pairs of rows. The queries' cells are sent to
    parts of the rows and the sums of a row stay in its task; no pair is shuffled.
    """
    left = normalise(cells).select(F.col("row").cast("long").alias("u"), F.col("col").cast("long").alias("key"), F.col("value").alias("w"), F.lit(0).alias("at"))
    right = cut(normalise(queries).select(F.col("col").cast("long").alias("key"), F.col("row").cast("long").alias("item"), F.col("value").alias("x"), F.lit(0).alias("at")))
    told = product(left, right, digits=SIM_DIGITS, everywhere=True)
    sims = told.select(F.col("item").alias("id"), F.col("u").alias("nbr"), F.col("score").alias("sim")).where(F.col("id") != F.col("nbr"))
    return sims if k is None else top_per_group(sims, ["id"], [F.col("sim").desc(), F.col("nbr")], k)


def append_similarities(known: DataFrame, new: DataFrame, apart: bool = False) -> DataFrame:
    """Add the similarities of new rows in both directions (new row and new column).

    ``apart`` tells that every pair of ``new`` is there once and its partner is no new row, so that no pair can come in
    both directions already and none has to be compared with the others.
    """
    one, other = F.struct("id", "nbr", "sim"), F.struct(F.col("nbr").alias("id"), F.col("id").alias("nbr"), F.col("sim"))
    both = new.select(F.explode(F.array(one, other)).alias("p")).select("p.*")
    return known.select("id", "nbr", "sim").unionByName(both if apart else both.distinct())


def refresh_neighbours(known: DataFrame, cells: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """Neighbour lists ``(id, nbr, sim, rank)`` after rows were added, equal to those of a new fit on all rows.

    ``known`` are the lists of ``cells`` with the same ``k``; ``new`` are the cells of rows that were not there. Only
    pairs with a new row are computed. Old lists take new rows in and let their last ones go; every map task keeps ``k``
    partners a row before the shuffle.
    """
    keep = ["row", "col", "value"]
    sims = cut(against(new, cells.select(*keep).unionByName(new.select(*keep))).where(F.col("sim") > 0))
    fresh = new.select(F.col("row").alias("nbr")).distinct()
    for_old = sims.join(fresh, "nbr", "left_anti").select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), "sim")
    every = known.select("id", "nbr", "sim").unionByName(sims).unionByName(for_old)
    return top_per_group(every, ["id"], [F.col("sim").desc(), F.col("nbr")], k)


def weight_grid(n: int, steps: Sequence[float], spark) -> DataFrame:
    """Weight tuples ``w1..wn`` from ``steps`` whose sum is 1 (tolerance 1e-9)."""
    grid = spark.range(1).select(F.lit(0.0).alias("_sum"))
    for i in range(1, n + 1):
        grid = grid.withColumn(f"w{i}", F.explode(F.array(*[F.lit(float(s)) for s in steps])))
        grid = grid.withColumn("_sum", F.col("_sum") + F.col(f"w{i}")).where(F.col("_sum") <= 1 + 1e-9)
    return grid.where(F.abs(F.col("_sum") - 1) < 1e-9).drop("_sum")


def second_best(neighbour_table: DataFrame) -> DataFrame:
    """The most similar other item of each item."""
    return neighbour_table.where(F.col("rank") == 1).select("id", F.col("nbr").alias("similar_id"), "sim")


def impute_from_similar(items: DataFrame, similar: DataFrame, value: str, default, rounds: int = 1) -> DataFrame:
    """Missing ``value`` of an item from its most similar item; what stays missing gets ``default``.

    Each round reads the values known before it; more rounds let an imputed value feed the next.
    """
    pairs = similar.select(F.col("id").alias("item_id"), "similar_id")
    known = items
    for _ in range(rounds):
        donors = known.select(F.col("item_id").alias("similar_id"), F.col(value).alias("_donor"))
        filled = known.join(pairs, "item_id", "left").join(donors, "similar_id", "left")
        known = filled.withColumn(value, F.coalesce(value, "_donor")).select(*items.columns)
    return known.withColumn(value, F.coalesce(value, F.lit(default)))


def impute_along_links(items: DataFrame, similar: DataFrame, value: str, default) -> DataFrame:
    """Missing ``value`` of an item from the first item that has one on the way of "most similar item" links.

    Links are doubled in every round, so a way of n items takes log2(n) rounds; ways that end or run in a circle without
    a value get ``default``. ``similar`` has one ``similar_id`` an ``id``. Null ids have no links. All rows and columns stay.
    """
    known = items.where(F.col(value).isNotNull() & F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min(value).alias("_value"))
    links = similar.select(F.col("id").alias("item_id"), F.col("similar_id").alias("_to"))
    missing = items.where(F.col(value).isNull()).select("item_id").distinct().join(known, "item_id", "left_anti")
    open_ = cut(missing.join(links, "item_id").select("item_id", "_to", F.lit(None).cast(items.schema[value].dataType).alias("_value")))
    first = open_.join(known.select(F.col("item_id").alias("_to"), F.col("_value").alias("_found")), "_to", "left")
    ways = cut(first.select("item_id", "_to", F.col("_found").alias("_value")))
    reach, total = 1, ways.count()
    while reach < total:
        ahead = ways.select(F.col("item_id").alias("_to"), F.col("_to").alias("_next"), F.col("_value").alias("_found"))
        done = ways.where(F.col("_value").isNotNull())
        further = ways.where(F.col("_value").isNull()).join(ahead, "_to").select("item_id", F.col("_next").alias("_to"), F.col("_found").alias("_value"))
        ways, reach = cut(done.unionByName(further)), 2 * reach
    filled = items.join(ways.select("item_id", "_value"), "item_id", "left")
    return filled.withColumn(value, F.coalesce(value, "_value", F.lit(default))).select(*items.columns)


def iter_pairs(n: int, low: int = 2) -> Iterator[tuple[int, ...]]:
    """All subsets of ``range(n)`` with at least ``low`` members (the combination sweep of four: eleven)."""
    from itertools import combinations

    for size in range(low, n + 1):
        yield from combinations(range(n), size)
