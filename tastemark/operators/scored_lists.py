"""Scores and ranked lists of users in one step: a sparse product whose sums stay in the task that holds the user.

Every user is in one part. The lists that a part's users read (ratings of their neighbours, or neighbours of their
items) are sent to the part once, not once a user, nor once a recipe that reads the same lists; sums, items already seen and ranks are then local. What is shuffled
are the two inputs and these lists, not a row for every user and item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemark.session import cut

#: Cells of lists that a task holds; where all lists have more, parts are made small enough.
HELD_CELLS = 40_000_000
#: Products looked at at once.
EXPANDED = 1_000_000
#: Cells of one piece of a list.
PIECE_CELLS = 1024
#: Parts up to which each has a partition of its own; of more than that chance gives no partition many.
NAMED = 512
#: Stands for a null id inside the tasks; it comes before all others, as nulls do.
NONE = -(2**63)


class _Lists:
    """The lists of a part by key: items, factors, whether they are given, and ranks. Items are numbered in order."""

    def __init__(self, pieces: list[pa.RecordBatch]):
        sizes = [p.column("item").value_lengths().to_numpy(zero_copy_only=False) for p in pieces]
        flat = lambda c, p: p.column(c).flatten()
        key = np.concatenate([p.column("u").to_numpy(zero_copy_only=False) for p in pieces] or [np.zeros(0, np.int64)])
        size = np.concatenate(sizes or [np.zeros(0, np.int64)]).astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(size)])
        self.keys, first = np.unique(key, return_index=True)  # pieces of a key stand together
        self.start = begins[first]
        self.count = np.diff(np.concatenate([self.start, begins[-1:]]))
        item = np.concatenate([flat("item", p).to_numpy(zero_copy_only=False) for p in pieces] or [np.zeros(0, np.int64)])
        self.items, self.code = np.unique(item, return_inverse=True)
        self.given = np.concatenate([flat("x", p).is_valid().to_numpy(zero_copy_only=False) for p in pieces] or [np.zeros(0, bool)])
        self.x = np.concatenate([flat("x", p).fill_null(0.0).to_numpy(zero_copy_only=False) for p in pieces] or [np.zeros(0)])
        self.rank = np.concatenate([flat("rank", p).to_numpy(zero_copy_only=False) for p in pieces] or [np.zeros(0, np.int32)])


class _Sums:
    """Sums by user and item while a part's users stream past in order; those of the last user are carried on."""

    def __init__(self, lists: _Lists, ks: Sequence[int], most: int | None, digits: int, empty: bool, g: int = 0):
        self.lists, self.ks, self.most, self.digits, self.empty, self.g = lists, ks, most, digits, empty, g
        self.order = np.argsort(ks)  # sizes from small to large
        self.bands = np.asarray(ks, np.int64)[self.order]
        self.carry = self._none()

    def _none(self) -> tuple:
        n = len(self.ks)
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, n)), np.zeros((0, n), np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        u, key, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "key", "at"))
        seen = batch.column("seen").to_numpy(zero_copy_only=False).astype(bool)
        given, w = batch.column("w").is_valid().to_numpy(zero_copy_only=False), batch.column("w").fill_null(0.0).to_numpy(zero_copy_only=False)
        lists = self.lists
        place = np.minimum(np.searchsorted(lists.keys, key), max(len(lists.keys) - 1, 0))
        met = ~seen & (lists.keys[place] == key) if len(lists.keys) else np.zeros(len(u), bool)
        count = np.zeros(len(u), np.int64)
        count[met] = lists.count[place[met]]
        total, low = np.cumsum(count + 1), 0
        while low < len(u):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + EXPANDED, "right")))
            mine = slice(low, high)
            yield from self._add(u[mine], key[mine], w[mine], given[mine], rank[mine], seen[mine], place[mine], count[mine])
            low = high

    def _add(self, u, key, w, given, rank, seen, place, count) -> Iterator[pa.RecordBatch]:
        lists, old, size, width = self.lists, self.carry, max(1, len(self.lists.items)), len(self.ks)
        at = np.repeat(np.arange(len(u)), count)
        cell = np.arange(len(at)) + np.repeat(np.where(count > 0, lists.start[place] if len(lists.keys) else 0, 0) - (np.cumsum(count) - count), count)
        ok = given[at] & lists.given[cell]
        part = np.where(ok, w[at] * lists.x[cell], 0.0)
        band = np.searchsorted(self.bands, np.maximum(rank[at], lists.rank[cell]))  # the first size that counts the product
        new = np.concatenate([[len(old[0]) == 0 or u[0] != old[0][0]], u[1:] != u[:-1]])
        who, names = np.cumsum(new) - (0 if len(old[0]) else 1), np.concatenate([old[0][:1], u[new]])
        known_item = np.flatnonzero(seen)
        code = np.minimum(np.searchsorted(lists.items, key[known_item]), max(len(lists.items) - 1, 0))
        listed = lists.items[code] == key[known_item] if len(lists.items) else np.zeros(len(code), bool)
        pairs = np.concatenate([old[1], who[at] * size + lists.code[cell], who[known_item[listed]] * size + code[listed]])
        if not len(pairs):
            self.carry = self._none()
            return
        order = np.argsort(pairs)
        pairs = pairs[order]
        begins = np.concatenate([[True], pairs[1:] != pairs[:-1]])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(begins) - 1
        pairs = pairs[begins]
        n, a, b = len(pairs), len(old[0]), len(old[0]) + len(at)
        counted = band < width
        wide = group[a:b][counted] * width + band[counted]
        sums = np.bincount(wide, part[counted], n * width).astype(float).reshape(n, width).cumsum(1)  # without products these are whole numbers
        known = np.bincount(wide[ok[counted]], minlength=n * width).reshape(n, width).cumsum(1)
        told = np.bincount(group[a:b], minlength=n)
        out = np.zeros(n, bool)
        sums[group[:a]] += old[2]
        known[group[:a]] += old[3]
        told[group[:a]] += old[4]
        out[group[:a][old[5]]] = True
        out[group[b:]] = True
        last = len(names) - 1
        done = int(np.searchsorted(pairs, last * size))
        who, items = pairs // size, pairs % size
        yield from self._lists(names[who[:done]], items[:done], sums[:done], known[:done], told[:done], out[:done])
        self.carry = names[who[done:]], items[done:], sums[done:], known[done:], told[done:], out[done:]

    def end(self) -> Iterator[pa.RecordBatch]:
        old, self.carry = self.carry, self._none()
        yield from self._lists(*old)

    def _lists(self, users, items, sums, known, told, out) -> Iterator[pa.RecordBatch]:
        """Rows come by user and item, so equal scores stay in the order of their items."""
        for column, i in enumerate(self.order):
            here = np.flatnonzero(~out & ((told > 0) if self.empty else (known[:, column] > 0)))
            u, item, none, score = users[here], items[here], known[here, column] == 0, np.round(sums[here, column], self.digits)
            if self.most is not None:
                first = _foremost(u, np.where(none, -np.inf, np.where(np.isnan(score), np.inf, score)), self.most)
                u, item, none, score = u[first], item[first], none[first], score[first]
                kind = np.where(none, 2, np.where(np.isnan(score), 0, 1))
                order = np.lexsort((-score, kind, u))
                u, item, none, score = u[order], item[order], none[order], score[order]
            rank = np.arange(len(u)) - np.searchsorted(u, u) + 1
            keep = rank <= (self.most or 0) if self.most is not None else np.ones(len(u), bool)
            columns = [
                pa.array(np.full(int(keep.sum()), self.g, np.int32)), pa.array(np.full(int(keep.sum()), self.ks[i], np.int64)), pa.array(u[keep]), pa.array(self.lists.items[item[keep]]),
                pa.array(score[keep], mask=none[keep]), pa.array(rank[keep]),
            ]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(columns, names=["g", "k", "u", "item", "score", "rank"])


def _foremost(u: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Rows, in their order, that have at least the score of their user's place ``most``; all rows where one user has nearly everything."""
    starts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(u)))
    widest = int(sizes.max(initial=0))
    if widest <= 2 * most or widest * len(starts) > 4 * len(u):
        return np.arange(len(u))
    who = np.repeat(np.arange(len(starts)), sizes)
    table = np.full((len(starts), widest), np.inf)
    table[who, np.arange(len(u)) - starts[who]] = -score
    least = -np.partition(table, most - 1, axis=1)[:, most - 1]
    return np.flatnonzero(score >= least[who])


def _folded(ks: Sequence[int], most: int | None, digits: int, empty: bool, groups: int = 1):
    """Rows sorted by (part, kind, u): a part's lists (kind 0) are held, its users' rows (kind 1) stream past once for each group.

    Rows of group -1 are those of every group.
    """

    def of(rows: pa.RecordBatch, g: int) -> pa.RecordBatch:
        mine = rows.column("g").to_numpy(zero_copy_only=False)
        mask = (mine == g) | (mine < 0)
        return rows if mask.all() else rows.filter(pa.array(mask))

    def begun(pieces: list[pa.RecordBatch]) -> list[_Sums]:
        shared = _Lists(pieces) if groups == 1 or all((p.column("g").to_numpy(zero_copy_only=False) < 0).all() for p in pieces) else None
        return [_Sums(shared or _Lists([of(p, g) for p in pieces]), ks, most, digits, empty, g) for g in range(groups)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pieces, sums = None, [], []
        for batch in batches:
            keys = batch.column("part").to_numpy(zero_copy_only=False) * 2 + batch.column("kind").to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip([0, *ends[:-1]], ends):
                if a == b:
                    continue
                where, kind = divmod(int(keys[a]), 2)
                if where != part:
                    for one in sums:
                        yield from one.end()
                    part, pieces, sums = where, [], []
                if kind == 0:
                    pieces.append(batch.slice(a, b - a))
                    continue
                if not sums:
                    sums, pieces = begun(pieces), []
                for one in sums:
                    rows = of(batch.slice(a, b - a), one.g) if groups > 1 else batch.slice(a, b - a)
                    if rows.num_rows:
                        yield from one.offer(rows)
        for one in sums:
            yield from one.end()

    return run


def apart(parts: int) -> list[int]:
    """Names of ``parts`` parts that Spark's hash deals to as many different partitions."""
    found, name = {}, 0
    while len(found) < parts:
        found.setdefault(_spark_hash(name) % parts, name)
        name += 1
    return sorted(found.values())


def _spark_hash(value: int, seed: int = 42) -> int:
    """Spark's hash of an int column (32-bit Murmur3), as a signed number."""
    mask = 0xFFFFFFFF
    turned = lambda x, n: ((x << n) | (x >> (32 - n))) & mask
    h = seed ^ (turned((value & mask) * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask)
    h = (turned(h, 13) * 5 + 0xE6546B64) & mask ^ 4
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & mask
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def product(
    left: DataFrame, right: DataFrame, seen: DataFrame | None = None, ks: Sequence[int] | None = None, most: int | None = None, digits: int = 9, parts: int | None = None,
    everywhere: bool = False, groups: int = 1,
) -> DataFrame:
    """``(g, k, u, item, score, rank)``: the sum of ``w * x`` over equal keys for each ``u`` and item.

    ``left`` has ``(u, key, w, at)``, ``right`` ``(key, item, x, at)``; a product counts for every ``k`` that is at
    least both ``at``. Pairs of ``seen`` ``(u, item)`` are left out. ``most`` keeps the best of each u, ties by smaller
    item. Without ``ks`` everything counts, and sums of nulls alone are null; with ``ks`` these drop out.
    ``everywhere`` sends all lists to every part, for few lists and many rows of ``left``. ``right`` is read more than
    once and should be a written table, as should ``left`` otherwise. With ``groups`` the sums are made for each group
    apart: a side that has ``g`` (from 0) has rows of its own for every group, a side without it is the same for all and
    travels once.
    """
    grouped = ["g"] if "g" in left.columns and "g" in right.columns else []
    left, right, seen = (x if x is None or "g" in x.columns else x.withColumn("g", F.lit(-1)) for x in (left, right, seen))
    cores = left.sparkSession.sparkContext.defaultParallelism
    left = left.where(F.col("key").isNotNull()).withColumn("u", F.coalesce("u", F.lit(NONE)))
    right = right.where(F.col("key").isNotNull()).withColumn("item", F.coalesce("item", F.lit(NONE)))
    cells = right.count()
    if parts is None:
        parts = 2 * cores
        if cells > HELD_CELLS:  # a part reads no more cells than its own rows ask for
            asked = left.count() * cells / max(1, right.select("key", *grouped).distinct().count())
            parts = max(parts, math.ceil(asked / HELD_CELLS))
    names = F.array(*[F.lit(i) for i in apart(parts)]) if parts <= NAMED else F.sequence(F.lit(0), F.lit(parts - 1))
    part = F.element_at(names, (F.pmod(F.xxhash64("u"), F.lit(parts)) + 1).cast("int")).alias("part")
    # not null: Spark sizes a batch at every row, and Arrow then goes through all null lists since the last list again
    empty = [F.array().cast(f"array<{kind}>").alias(name) for name, kind in (("item", "long"), ("x", "double"), ("rank", "int"))]
    mine = left.select(part, F.lit(1).alias("kind"), F.col("g").cast("int").alias("g"), "u", "key", F.col("w").cast("double").alias("w"), F.col("at").cast("int").alias("at"), F.lit(False).alias("seen"), *empty)
    if seen is not None:
        known = seen.where(F.col("u").isNotNull() & F.col("item").isNotNull())
        mine = mine.unionByName(known.select(part, F.lit(1).alias("kind"), F.col("g").cast("int").alias("g"), "u", F.col("item").alias("key"), F.lit(0.0).alias("w"), F.lit(0).alias("at"), F.lit(True).alias("seen"), *empty))
    piece = F.floor((F.row_number().over(Window.partitionBy("key", "g").orderBy("item")) - 1) / PIECE_CELLS)
    cell = F.collect_list(F.struct("item", F.col("x").cast("double").alias("x"), F.col("at").cast("int").alias("at")))
    pieces = right.withColumn("_piece", piece).groupBy("key", "g", "_piece").agg(cell.alias("c"))
    if everywhere:
        called = pieces.withColumn("part", F.explode(names))
    else:
        called = pieces.join(left.select(part, "key", *grouped).distinct(), ["key", *grouped])
    sent = called.select(
        "part", F.lit(0).alias("kind"), F.col("g").cast("int").alias("g"), F.col("key").alias("u"), F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("w"), F.lit(0).alias("at"), F.lit(False).alias("seen"),
        F.col("c.item").alias("item"), F.col("c.x").alias("x"), F.col("c.at").alias("rank"),
    )
    dealt = sent.unionByName(mine).repartition(parts, "part").sortWithinPartitions("part", "kind", "u")
    told = dealt.mapInArrow(_folded(list(ks) if ks else [2**31 - 1], most, digits, not ks, groups), "g int, k long, u long, item long, score double, rank long")
    given = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
    return told.select("g", "k", given("u"), given("item"), "score", "rank")


def user_lists(
    nbrs: DataFrame, ratings: DataFrame, k: int | None, item_based: bool = False, ks: Sequence[int] | None = None, value: str = "value", digits: int = 9, parts: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """``([by...,] [k,] user_id, item_id, score, rank)``: the best ``k`` items that a user has no rating for, all of them for ``None``.

    Equal to scores, the seen items left out, and ranks as separate steps; ``ks`` gives one list for each neighbourhood size.
    Each value of ``by``, which is a parameter of a study and so has few, has neighbours of its own, and ratings where they have that column.
    """
    at = F.col("rank") if ks else F.lit(0)
    nbrs = cut(nbrs.where(F.col("rank") <= max(ks)) if ks else nbrs)
    long = lambda c: F.col(c).cast("long")
    groups = sorted(tuple(r) for r in nbrs.select(*by).distinct().collect()) if by else [()]
    number = F.coalesce(*[F.when(_all(F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, one)), F.lit(i)) for i, one in enumerate(groups)]) if by and groups else F.lit(0)
    g = [number.alias("g")] if by else []
    own = g if by and all(c in ratings.columns for c in by) else []
    seen = ratings.select(*own, long("user_id").alias("u"), long("item_id").alias("item"))
    if item_based:
        left = ratings.select(*own, long("user_id").alias("u"), long("item_id").alias("key"), F.col(value).alias("w"), F.lit(0).alias("at"))
        right = nbrs.select(*g, long("nbr").alias("key"), long("id").alias("item"), F.col("sim").alias("x"), at.alias("at"))
    else:
        left = nbrs.select(*g, long("id").alias("u"), long("nbr").alias("key"), F.col("sim").alias("w"), at.alias("at"))
        right = ratings.select(*own, long("user_id").alias("key"), long("item_id").alias("item"), F.col(value).alias("x"), F.lit(0).alias("at"))
    if own:  # ratings of a value without neighbours
        left, right, seen = (x.where(F.col("g").isNotNull()) for x in (left, right, seen))
    told = product(left, right, seen, ks, 2**31 - 1 if k is None else k, digits, parts, groups=max(1, len(groups)))
    kinds = dict(ratings.select("user_id", "item_id").dtypes) | dict(nbrs.dtypes)
    sizes = [F.col("k").cast("int").alias("k")] if ks else []
    values = [F.element_at(F.array(*[F.lit(v[i]) for v in groups]), F.col("g") + 1).cast(kinds[c]).alias(c) if groups else F.lit(None).cast(kinds[c]).alias(c) for i, c in enumerate(by)]
    return told.select(*values, *sizes, F.col("u").cast(kinds["user_id"]).alias("user_id"), F.col("item").cast(kinds["item_id"]).alias("item_id"), "score", F.col("rank").cast("int").alias("rank"))


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)
