"""Exact top-k cosine join of sparse rows: an inverted index of row prefixes decides which rows meet.

Columns are ordered by how many rows hold them, the rarest first. A row's cells stand in that order, so the cells from
any place on have a norm that bounds every cosine that comes from them alone. Rows are put into blocks by one of their
rarer columns, so that rows with columns in common tend to stand together. First each block is compared with itself; a
row's k-th best cosine there is a floor under its final list, and the cells before the place where the rest's norm falls
under that floor are its prefix. Rows whose prefix is the whole row are then put into blocks of their own. A row that shares no prefix cell
with any row of a block cannot enter one of the block's lists. So only rows that meet a block's prefix columns in the
index are sent to it, and are compared there by full products: what is shuffled grows with the shared prefix cells, and
columns held by very many rows, which come last, lead to no meetings by themselves.

A block's rows are held by one task while the others stream past; long rows come in segments of columns, whose products
add up. Every row is in one block, so a block's lists are final.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemark.operators.ranking import top_per_group
from tastemark.session import cut

#: Rows of a block, at least and at most; in between blocks are sized to give every core two. Every block reads the rows
#: that it may meet, so few large blocks shuffle less than many small ones.
LEAST_ROWS, MOST_ROWS = 128, 1 << 17
#: Cells of a block on average, and partners that its rows may keep over all recipes.
BLOCK_CELLS, BLOCK_PARTNERS = 4_000_000, 2_000_000
#: Cells of one segment of a row.
SEGMENT_CELLS = 1024
#: Cells that stream past a block in one task, on average and at most; a block that may meet more has several tasks.
STREAM_CELLS = 32_000_000
#: Numbers a task holds at once in a piece of the product, and products of single cells.
HELD, EXPANDED = 1 << 17, 2_000_000
#: Products of single cells sorted at once.
SORTED = 1 << 18
#: Numbers of a block kept as a full matrix.
FULL = 16_000_000
#: Products stay sparse if less than one pair in this many has a cell in common in the source that every partner shares.
SPARSE = 16
#: Columns of a source up to which its products for chosen pairs come from full rows.
NARROW = 64
MOST_TASKS = 20_000
SIM_DIGITS = 9
#: Similarities are rounded, so bounds have this margin.
MARGIN = 1e-8
#: Comes after every row.
NOBODY = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Recipe:
    """How the similarities of several matrices become one: ``sum`` (weighted), ``max`` or ``min`` over ``parts``.

    ``zero`` adds a 0 to the values compared by max and min, standing for matrices that were not given.
    """

    label: str
    op: str = "sum"
    parts: tuple[int, ...] = (0,)
    weights: tuple[float, ...] = field(default=(1.0,))
    zero: bool = False


def mix(values: list[np.ndarray], recipe: Recipe) -> np.ndarray:
    if recipe.op == "sum":
        if len(values) == 1 and recipe.weights[0] == 1.0:
            return values[0]
        out = recipe.weights[0] * values[0]
        for w, v in zip(recipe.weights[1:], values[1:], strict=True):
            out += w * v
        return out
    pick = np.maximum if recipe.op == "max" else np.minimum
    out = values[0] if not recipe.zero else pick(values[0], 0.0)
    for v in values[1:]:
        out = pick(out, v)
    return out


def bound(norms: list[np.ndarray], recipe: Recipe) -> np.ndarray:
    """Most that a recipe can give to vectors of these norms against unit vectors."""
    if recipe.op == "sum":
        return sum(abs(w) * n for w, n in zip(recipe.weights, norms, strict=True))
    return (np.maximum if recipe.op == "max" else np.minimum).reduce(norms)


def without(recipe: Recipe, m: int) -> float:
    """Most that a recipe can give to a pair without a common cell in source ``m``."""
    others = [i for i, part in enumerate(recipe.parts) if part != m]
    if recipe.op == "sum":
        return sum(abs(recipe.weights[i]) for i in others)
    return 0.0 if not others or (recipe.op == "min" and len(others) < len(recipe.parts)) else 1.0


class Cells:
    """Cells of a run of stream rows: the row segment they are in, source, column and unit value."""

    def __init__(self, batch: pa.RecordBatch):
        flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
        self.rows = batch.column("row").to_numpy(zero_copy_only=False)
        self.at = np.repeat(np.arange(len(self.rows)), batch.column("col").value_lengths().to_numpy(zero_copy_only=False))
        self.src, self.col = flat("src"), flat("col")
        norms = flat("norm").reshape(len(self.rows), -1)
        self.value = flat("v") / norms[self.at, self.src]


class Block:
    """Rows of one block with their best partners so far; partners are offered as cells, in the order of their rows."""

    def __init__(self, parts: list[Cells], recipes: Sequence[Recipe], k: int):
        self.parts = parts
        ids = np.unique(np.concatenate([p.rows for p in parts]))
        q = np.concatenate([np.searchsorted(ids, p.rows)[p.at] for p in parts])
        self._set(ids, q, *(np.concatenate([getattr(p, c) for p in parts]) for c in ("src", "col", "value")), recipes, k)

    def _set(self, ids: np.ndarray, q: np.ndarray, src: np.ndarray, col: np.ndarray, value: np.ndarray, recipes: Sequence[Recipe], k: int) -> None:
        self.ids, self.n, self.recipes, self.k = ids, len(ids), recipes, k
        self.q, self.src, self.col, self.value = q, src, col, value
        self.lead: int | None = None  # a source that every partner shares a cell in
        self.used = sorted({m for r in recipes for m in r.parts})
        self.index = {m: self._index(m) for m in self.used}
        self.dense: dict[int, np.ndarray] = {}
        self.floor = np.zeros((len(recipes), self.n))
        self.last = np.full((len(recipes), self.n), NOBODY)  # the k-th best partner, where k are kept
        self.kept: list[list[tuple]] = [[] for _ in recipes]
        self.waiting: tuple[int, dict[int, np.ndarray]] | None = None  # products of a row whose segments may go on

    def _index(self, m: int) -> tuple:
        """Columns of one source with the places of their cells in two arrays: block row and value."""
        mine = np.flatnonzero(self.src == m)
        mine = mine[np.argsort(self.col[mine], kind="stable")]
        columns, start, count = np.unique(self.col[mine], return_index=True, return_counts=True)
        return columns, start, count, self.q[mine], self.value[mine]

    def offer_own(self) -> None:
        """Compare the block's rows with each other, for floors: where cells are few, those that share one of the cheapest source."""
        self.lead = min(self.used, key=self._cost)
        for part in self.parts:
            self.offer(part)
        self._end()
        self.lead = None

    def _cost(self, m: int) -> float:
        return float(np.square(self.index[m][2], dtype=float).sum())

    def start(self) -> None:
        """Floors from the block's own rows, which come again with the others; their cells are let go."""
        self.offer_own()
        self._end()
        for r in range(len(self.recipes)):
            self._best(r)
        self.kept = [[] for _ in self.recipes]
        self.last[:] = NOBODY
        self.parts = []

    def split(self) -> list[Block]:
        """The block as it is, or its rows that every partner must share a cell of one source with apart from the others.

        Such rows have floors that no pair without a common cell in that source can reach.
        """
        sure = {}
        for m in self.used:
            least = np.array([without(recipe, m) for recipe in self.recipes])[:, None]
            sure[m] = ((least < 0.4 * 10**-SIM_DIGITS) | (least < self.floor - MARGIN)).all(0)
        lead = max(self.used, key=lambda m: (np.count_nonzero(sure[m]), -self._cost(m)))
        if 2 * np.count_nonzero(sure[lead]) < self.n:
            return [self]
        out = []
        for rows, source in ((sure[lead], lead), (~sure[lead], None)):
            if rows.any():
                mine = rows[self.q]
                block = Block.__new__(Block)
                block._set(self.ids[rows], (np.cumsum(rows) - 1)[self.q[mine]], self.src[mine], self.col[mine], self.value[mine], self.recipes, self.k)
                block.floor, block.lead, block.parts = self.floor[:, rows], source, []
                out.append(block)
        return out

    def offer(self, cells: Cells) -> None:
        found = []
        for m in self.used:
            columns, start, count, _, _ = self.index[m]
            mine = np.flatnonzero(cells.src == m) if len(columns) else np.zeros(0, np.int64)
            place = np.minimum(np.searchsorted(columns, cells.col[mine]), max(len(columns) - 1, 0))
            mine, place = (x[columns[place] == cells.col[mine]] for x in (mine, place)) if len(columns) else (mine, place)
            found.append((m, cells.at[mine], place, start[place], count[place], cells.value[mine]))
        cost, apart = np.zeros(len(cells.rows)), np.zeros(len(cells.rows))
        for m, at, _, _, count, _ in found:
            now = np.bincount(at, count, minlength=len(cells.rows))
            cost += now
            if not self._narrow(m) or m == self.lead:
                apart += now
        sparse = self.lead is not None and apart.sum() * SPARSE < self.n * len(cells.rows)
        total, low, most = np.cumsum(apart if sparse else cost), 0, max(32, HELD // self.n)
        while low < len(cells.rows):
            spent = total[low - 1] if low else 0.0
            high = int(np.searchsorted(total, spent + (SORTED if sparse else EXPANDED), "right"))
            high = max(low + 1, high if sparse else min(low + most, high))
            (self._meet_sparse if sparse else self._meet)(cells.rows[low:high], low, high, found)
            low = high

    def _narrow(self, m: int) -> bool:
        """Whether full rows of a source can be had for any pairs."""
        return len(self.index[m][0]) <= NARROW and self.n * len(self.index[m][0]) <= FULL

    def _meet_sparse(self, rows: np.ndarray, low: int, high: int, found: list[tuple]) -> None:
        """As ``_meet``, without a number for every pair. The first and last rows, whose segments may lie outside, are met in full."""
        starts = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1, [len(rows)]])
        a = int(starts[1]) if self.waiting is not None and self.waiting[0] == rows[0] else 0
        b = max(a, int(starts[-2]))
        if a:
            self._meet(rows[:a], low, low + a, found)
        if a < b:
            self._meet_pairs(rows[a:b], low + a, low + b, found)
        if b < len(rows):
            self._meet(rows[b:], low + b, high, found)

    def _meet_pairs(self, rows: np.ndarray, low: int, high: int, found: list[tuple]) -> None:
        """Whole rows with the block's rows that share a cell of the leading source with them."""
        begins = np.concatenate([[True], rows[1:] != rows[:-1]])
        names, row = rows[begins], np.cumsum(begins) - 1
        by = {f[0]: f for f in found}
        flat, sums = self._pairs(by[self.lead], row, low, high)
        q, y = flat % self.n, flat // self.n
        products = {self.lead: sums}
        for m in self.used:
            if m == self.lead:
                continue
            if self._narrow(m):
                _, at, place, _, _, value = by[m]
                a, b = np.searchsorted(at, [low, high])
                other = np.zeros((len(names), max(1, len(self.index[m][0]))))
                np.add.at(other, (row[at[a:b] - low], place[a:b]), value[a:b])
                products[m] = np.einsum("ij,ij->i", self._full(m)[q], other[y])
            else:
                also, more = self._pairs(by[m], row, low, high)
                place = np.minimum(np.searchsorted(also, flat), max(len(also) - 1, 0))
                products[m] = np.where(also[place] == flat, more[place], 0.0) if len(also) else np.zeros(len(flat))
        for r, recipe in enumerate(self.recipes):
            sims = mix([products[m] for m in recipe.parts], recipe)
            good = sims >= self._least(r, names)[q]
            self._keep(r, q[good], names[y[good]], sims[good])

    def _pairs(self, found: tuple, row: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs with a common cell in a source, as places in a matrix with a line of block rows a stream row, and their products."""
        m, at, _, start, count, value = found
        a, b = np.searchsorted(at, [low, high])
        _, _, _, q, w = self.index[m]
        cell = np.arange(int(count[a:b].sum())) + np.repeat(start[a:b] - (np.cumsum(count[a:b]) - count[a:b]), count[a:b])
        flat = q[cell] + np.repeat(row[at[a:b] - low] * self.n, count[a:b])
        part = np.repeat(value[a:b], count[a:b]) * w[cell]
        order = np.argsort(flat)
        flat, part = flat[order], part[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else flat
        return flat[first], np.add.reduceat(part, first) if len(flat) else part

    def _full(self, m: int) -> np.ndarray:
        """A source of the block as a full matrix."""
        if m not in self.dense:
            columns, mine = self.index[m][0], self.src == m
            self.dense[m] = np.zeros((self.n, max(1, len(columns))))
            self.dense[m][self.q[mine], np.searchsorted(columns, self.col[mine])] = self.value[mine]
        return self.dense[m]

    def _meet(self, rows: np.ndarray, low: int, high: int, found: list[tuple]) -> None:
        width = high - low + 1  # place 0 is the row that waits for more segments
        products = {}
        for m, at, place, start, count, value in found:
            a, b = np.searchsorted(at, [low, high])
            products[m] = self._product(m, width, at[a:b] - low + 1, place[a:b], start[a:b], count[a:b], value[a:b])
        if self.waiting is not None:
            rows = np.concatenate([[self.waiting[0]], rows])
            for m, p in products.items():
                p[:, 0] = self.waiting[1][m]
        else:
            products = {m: p[:, 1:] for m, p in products.items()}
        first = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1])
        if len(first) < len(rows):
            products = {m: np.add.reduceat(p, first, axis=1) for m, p in products.items()}
        names = rows[first]
        self.waiting = (names[-1], {m: p[:, -1].copy() for m, p in products.items()})
        self._score(names[:-1], {m: p[:, :-1] for m, p in products.items()})

    def _product(self, m: int, width: int, at: np.ndarray, place: np.ndarray, start: np.ndarray, count: np.ndarray, value: np.ndarray) -> np.ndarray:
        columns, _, _, q, w = self.index[m]
        pairs = int(count.sum())
        if len(columns) <= 4096 and self.n * len(columns) <= FULL and pairs > self.n * width * len(columns) // 24:  # cells nearly everywhere
            other = np.zeros((width, len(columns)))
            np.add.at(other, (at, place), value)
            return self._full(m) @ other.T
        cell = np.arange(pairs) + np.repeat(start - (np.cumsum(count) - count), count)
        flat = q[cell] * width + np.repeat(at, count)
        return np.bincount(flat, np.repeat(value, count) * w[cell], minlength=self.n * width).reshape(self.n, width)

    def _score(self, names: np.ndarray, products: dict[int, np.ndarray]) -> None:
        if not len(names):
            return
        for r, recipe in enumerate(self.recipes):
            sims = mix([products[m] for m in recipe.parts], recipe)
            least = self._least(r, names)
            good = sims >= least[:, None]
            place = len(names) - self.k - 1  # a row may be its own best partner here, so one more is let through
            if place > 0 and np.count_nonzero(good) > 4 * self.k * self.n:
                own = np.partition(sims, place, axis=1)[:, place]
                good = sims >= np.maximum(least, own - MARGIN)[:, None]
            q, y = np.divmod(np.flatnonzero(good), len(names))
            self._keep(r, q, names[y], sims[q, y])

    def _least(self, r: int, names: np.ndarray) -> np.ndarray:
        """What a partner among ``names`` needs, a margin aside: more than the k-th best where that one comes before all of them."""
        later = self.last[r] < names.min(initial=NOBODY)
        return np.where(later, self.floor[r] + 0.4 * 10**-SIM_DIGITS, np.maximum(self.floor[r] - MARGIN, 0.4 * 10**-SIM_DIGITS))

    def _keep(self, r: int, q: np.ndarray, names: np.ndarray, sims: np.ndarray) -> None:
        s = np.round(sims, SIM_DIGITS)
        fits = (s > 0) & (names != self.ids[q])
        self.kept[r].append((q[fits], names[fits], s[fits]))
        if sum(len(x[0]) for x in self.kept[r]) > max(20_000, 4 * self.k * self.n):
            self._best(r)

    def _best(self, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each row among those kept: row, partner, similarity and rank from 1."""
        q, names, s = (np.concatenate([x[i] for x in self.kept[r]]) if self.kept[r] else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, float)))
        order = np.lexsort((names, -s, q))
        q, names, s = q[order], names[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
        keep = rank <= self.k
        q, names, s, rank = q[keep], names[keep], s[keep], rank[keep]
        self.kept[r] = [(q, names, s)]
        self.floor[r][q[rank == self.k]], self.last[r][q[rank == self.k]] = s[rank == self.k], names[rank == self.k]
        return q, names, s, rank

    def _end(self) -> None:
        if self.waiting is not None:
            name, products = self.waiting
            self.waiting = None
            self._score(np.array([name]), {m: p[:, None] for m, p in products.items()})

    def lists(self) -> list[tuple]:
        """(recipe, id, nbr, sim, rank) as arrays, one entry a recipe."""
        self._end()
        out = []
        for r, recipe in enumerate(self.recipes):
            q, names, s, rank = self._best(r)
            out.append((recipe.label, self.ids[q], names, s, rank))
        return out

    def prefix(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Prefixes given the floors that the rows have now: (row, its own, source, column).

        A row whose prefix reaches its most common column is told for itself; of the others the block's columns are.
        """
        self._end()
        for r in range(len(self.recipes)):
            self._best(r)
        order = np.argsort(self.q, kind="stable")  # cells of a row stay in the order of their columns' frequency
        q, src, col, square = self.q[order], self.src[order], self.col[order], self.value[order] ** 2
        after = np.searchsorted(q, q, "right")
        rest = {}
        for m in self.used:
            sums = np.concatenate([np.cumsum(np.where(src == m, square, 0.0)[::-1])[::-1], [0.0]])
            rest[m] = np.sqrt(np.maximum(sums[:-1] - sums[after], 0.0))
        keep = np.zeros(len(q), bool)
        for r, recipe in enumerate(self.recipes):
            keep |= bound([rest[m] for m in recipe.parts], recipe) >= self.floor[r][q] - MARGIN
        own = np.zeros(self.n, bool)
        own[q[(after == np.arange(len(q)) + 1) & keep]] = True
        mine = np.flatnonzero(keep & own[q])
        told = [(self.ids[q[mine]], np.ones(len(mine), bool), src[mine].astype(np.int32), col[mine])]
        keep &= ~own[q]
        for m in self.used:
            common = np.unique(col[keep & (src == m)])
            told.append((np.zeros(len(common), np.int64), np.zeros(len(common), bool), np.full(len(common), m, np.int32), common))
        return tuple(np.concatenate([t[i] for t in told]) for i in range(4))


def _stream(recipes: Sequence[Recipe], k: int, told: Callable[[list[Block], dict], Iterator[pa.RecordBatch]]):
    """Rows sorted by (grp, block, kind): a block's own rows (kind 0) are held, the others (kind 1) are offered to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, blocks = None, [], None
        for batch in batches:
            grp = batch.column("grp")
            keys = list(zip(grp.to_pylist(), batch.column("block").to_pylist(), batch.column("kind").to_pylist(), strict=True))
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip([0, *ends[:-1]], ends):
                if a == b:
                    continue
                where, kind = keys[a][:2], keys[a][2]
                if where != now:
                    if parts or blocks:
                        yield from told(blocks or [Block(parts, recipes, k)], last)
                    now, parts, blocks, last = where, [], None, {"grp": grp.slice(a, 1), "block": where[1]}
                if kind == 0:
                    parts.append(Cells(batch.slice(a, b - a)))
                elif parts or blocks:
                    if blocks is None:
                        block, parts = Block(parts, recipes, k), []
                        block.start()
                        blocks = block.split()
                    cells = Cells(batch.slice(a, b - a))
                    for block in blocks:
                        block.offer(cells)
        if parts or blocks:
            yield from told(blocks or [Block(parts, recipes, k)], last)

    return run


def _same(value: pa.Array, n: int) -> pa.Array:
    return value.take(pa.array(np.zeros(n, np.int64)))


def _told_lists(blocks: list[Block], at: dict) -> Iterator[pa.RecordBatch]:
    for label, ids, names, sims, rank in (one for block in blocks for one in block.lists()):
        columns = [_same(at["grp"], len(ids)), pa.array([label] * len(ids), pa.string()), pa.array(ids), pa.array(names), pa.array(sims), pa.array(rank.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["grp", "recipe", "id", "nbr", "sim", "rank"])


def _told_prefix(blocks: list[Block], at: dict) -> Iterator[pa.RecordBatch]:
    block = blocks[0]
    block.offer_own()
    row, own, src, col = block.prefix()
    columns = [_same(at["grp"], len(src)), pa.array(np.full(len(src), at["block"], np.int64)), pa.array(row), pa.array(own), pa.array(src), pa.array(col)]
    yield pa.RecordBatch.from_arrays(columns, names=["grp", "block", "row", "own", "src", "col"])


def segments(cells: DataFrame, sources: int, segment_cells: int = SEGMENT_CELLS) -> DataFrame:
    """Rows in segments ``grp, row, seg, norm[], lead_src, lead_col, lead_held, src[], col[], v[]``, cells in the order of their columns' frequency, the rarest first.

    Values travel as they are, beside the row's norm in each source, and are divided where they are compared.
    """
    held = cells.groupBy("grp", "src", "col").agg(F.count(F.lit(1)).alias("held"))
    whole = Window.partitionBy("grp", "row")
    inner = whole.orderBy("held", "src", "col")
    square = F.array(*[F.sum(F.when(F.col("src") == m, F.col("value") * F.col("value"))).over(whole) for m in range(sources)])
    # one column a row, drawn by a hash with chances that fall with how common it is: rows that share rare columns draw the same
    draw = -F.log((F.pmod(F.xxhash64("src", "col"), F.lit(1 << 30)) + 1) / F.lit((1 << 30) + 1)) * F.col("held")
    lead = F.min_by(F.struct(F.col("src").alias("lead_src"), F.col("col").alias("lead_col"), F.col("held").alias("lead_held")), F.struct(draw, "src", "col")).over(whole)
    unit = cells.join(held, ["grp", "src", "col"]).select("*", square.alias("square"), lead.alias("lead")).select(
        "grp", "row", "src", "col", F.col("value").alias("v"), F.transform("square", lambda x: F.coalesce(F.sqrt(x), F.lit(1.0))).alias("norm"), (F.row_number().over(inner) - 1).alias("pos"), "lead",
    )
    placed = unit.withColumn("seg", F.floor(F.col("pos") / segment_cells).cast("int"))
    cell = F.sort_array(F.collect_list(F.struct("pos", "src", "col", "v")))
    told = placed.groupBy("grp", "row", "seg", "lead", "norm").agg(cell.alias("c"))
    return told.select("grp", "row", "seg", "norm", "lead.*", *[F.col(f"c.{x}").alias(x) for x in ("src", "col", "v")])


def in_blocks(rows: DataFrame, blocks: int, block_rows: int) -> DataFrame:
    """Rows with their block: rows of one drawn column stay together, dealt over as many blocks as they fill if it is a common one."""
    salt = F.pmod(F.xxhash64("row"), F.ceil(F.col("lead_held") / block_rows))
    return rows.withColumn("block", F.pmod(F.xxhash64("lead_src", "lead_col", salt), F.lit(blocks)).cast("long")).drop("lead_src", "lead_col", "lead_held")


def join(cells: DataFrame, sources: int, k: int, recipes: Sequence[Recipe], block_rows: int | None = None, segment_cells: int = SEGMENT_CELLS) -> DataFrame:
    """``grp, recipe, id, nbr, sim, rank`` for a written table of cells ``grp, src, row, col, value`` without zeros.

    ``src`` numbers the matrices from 0; ``sources`` is how many there are.
    """
    cores = cells.sparkSession.sparkContext.defaultParallelism
    told = cut(segments(cells, sources, segment_cells))
    rows = max(1, told.where("seg = 0").count())  # sets the size of the tasks, nothing else
    held = cells.count()
    block_rows = block_rows or _block_rows(rows, held, cores, k * len(recipes))
    blocks = math.ceil(rows / block_rows)
    whole = in_blocks(told, blocks, block_rows)
    whole, met = routes(cells, whole, k, recipes, blocks, block_rows)
    sent = whole.drop("block").join(met, ["grp", "row"]).withColumn("kind", F.lit(1))
    schema = f"grp {_kind(cells)}, recipe string, id long, nbr long, sim double, rank int"
    # a task sorts what streams past it, so that is dealt over several tasks, each with the block's rows, where it may be the whole of a large table
    slices = math.ceil(held / STREAM_CELLS) or 1
    mine = whole.withColumn("kind", F.lit(0))
    if slices > 1:
        number = lambda i: F.col("block") * slices + i
        mine = mine.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")), number)))
        sent = sent.withColumn("block", number(F.pmod(F.xxhash64("row"), F.lit(slices))))
    lists = _dealt(mine.unionByName(sent), blocks * slices).mapInArrow(_stream(recipes, k, _told_lists), schema)
    return lists if slices == 1 else top_per_group(lists.drop("rank"), ["grp", "recipe", "id"], [F.col("sim").desc(), F.col("nbr")], k)


def _block_rows(rows: int, cells: int, cores: int, partners: int) -> int:
    """Rows of a block: two blocks a core, less if the cells or the lists of so many rows were too much for a task."""
    fit = min(MOST_ROWS, BLOCK_CELLS * rows // max(cells, 1), BLOCK_PARTNERS // partners)
    return max(LEAST_ROWS, min(fit, math.ceil(rows / (2 * cores))))


def _kind(cells: DataFrame) -> str:
    return cells.schema["grp"].dataType.simpleString()


def _dealt(stream: DataFrame, blocks: int) -> DataFrame:
    return stream.repartition(min(MOST_TASKS, 4 * blocks), "grp", "block").sortWithinPartitions("grp", "block", "kind", "row", "seg")


def routes(cells: DataFrame, whole: DataFrame, k: int, recipes: Sequence[Recipe], blocks: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows in their final blocks, and ``grp, block, row``: which rows may enter a block's lists.

    Rows without a floor to speak of, whose prefix is the whole row, move to blocks of their own: else one of them
    would call all holders of a common column to its block.
    """
    own = _dealt(whole.withColumn("kind", F.lit(0)), blocks)
    found = cut(own.mapInArrow(_stream(recipes, k, _told_prefix), f"grp {_kind(cells)}, block long, row long, own boolean, src int, col long"))
    lone = found.where("own").select("grp", "row").distinct()
    lone_blocks = max(1, math.ceil(lone.count() / block_rows))
    apart = (F.lit(blocks) + F.pmod(F.xxhash64("row"), F.lit(lone_blocks))).cast("long")
    moved = whole.join(lone.withColumn("own", F.lit(True)), ["grp", "row"], "left").withColumn("block", F.when(F.col("own"), apart).otherwise(F.col("block"))).drop("own")
    prefixes = found.select("grp", F.when(F.col("own"), apart).otherwise(F.col("block")).alias("block"), "src", "col")
    # a column's blocks as bits, 32 a number: its cells are read once for 32 blocks, and a row's numbers are or-ed
    bits = F.expr("bit_or(shiftleft(1L, cast(block % 32 as int)))").alias("bits")
    called = prefixes.groupBy("grp", "src", "col", F.floor(F.col("block") / 32).alias("word")).agg(bits)
    met = cells.select("grp", "src", "col", "row").join(called, ["grp", "src", "col"]).groupBy("grp", "row", "word").agg(F.bit_or("bits").alias("bits"))
    each = F.explode(F.expr("filter(sequence(0L, 31L), i -> (shiftright(bits, cast(i as int)) & 1L) = 1L)")).alias("bit")
    return moved, met.select("grp", "row", "word", each).select("grp", (F.col("word") * 32 + F.col("bit")).alias("block"), "row")
