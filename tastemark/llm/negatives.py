"""Hard negatives by inner product from cover trees over norm-augmented vectors.

Every candidate gets one more component, so that all vectors of a tree have one norm; the nearest rows of an anchor are
then those of the largest inner product, and a node of covering radius r holds only products within |anchor| r of its
centre's. Trees are built over shards of the table, level by level: a node's children are candidates that lie further
apart than half its radius and cover the node's rows within that; rows that no child covers stay with the node itself.
A search goes down from the root for a block of anchors at a time, leaves out nodes whose bounds miss every window, takes
the remaining buckets by their upper bounds, the best first, and stops where the bound falls under the last row that is
kept. Rows of a bucket are multiplied as whole numbers, so scores and windows are exact; bounds have a margin for rounding.

First the positives of all anchors are searched in all shards and merged, then the windows that follow from them. Anchors
travel in blocks to the shards, so a task holds one tree and one block. Of every shard come k rows at most a window.

Edge cases: rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors of unequal
length are compared as if the shorter ones went on with zeros. Components beyond 2^28 after scaling count as 2^28. Of rows
with one id the least by label, then vector, counts, so repeated rows count once. Equal scores are ordered by id. Anchors
without positives give no rows; negative positive scores have empty windows. Empty tables give none. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemark.operators.ranking import top_per_group
from tastemark.session import cut

#: Candidates of a shard and anchors of a block, on average.
SHARD_ROWS, BLOCK_ANCHORS = 2048, 256
#: Rows of a node that is not split further, and children of a node.
LEAF_ROWS, CHILDREN = 64, 64
LARGEST = 1 << 28


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id, label, v``: rows that take part, one an id, with components scaled to whole numbers and labels shifted where due."""
    x = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull()
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * 256).cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST))).cast("int"))
    label = F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col)).cast("long")
    kept = rows.where(sound & F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.struct(label.alias("label"), whole.alias("v")).alias("row"))
    return kept.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v")


def padded(lists: list[np.ndarray]) -> np.ndarray:
    """Rows of equal length, short ones filled with zeros; exact as float64 while products stay under 2^53."""
    width = max((len(x) for x in lists), default=0)
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; by floats where these are exact, which is the common case, else by integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * width < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class CoverTree:
    """Nodes in the order of their levels. Node i has centre, radius, parent, and a bucket of rows of its own (maybe none)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        order = np.lexsort((ids,))
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        norms = (self.rows**2).sum(axis=1)
        lifted = np.column_stack([self.rows, np.sqrt(norms.max(initial=0.0) - norms)])
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.parent: list[int] = []
        self.bucket: list[np.ndarray] = []
        level = [(-1, 0, np.arange(len(ids)))] if len(ids) else []
        while level:
            below = []
            for parent, centre, members in level:
                far = np.sqrt(((lifted[members] - lifted[centre]) ** 2).sum(axis=1))
                me, radius = len(self.centre), float(far.max())
                self.centre.append(centre)
                self.radius.append(radius)
                self.parent.append(parent)
                rest = members
                if len(members) > LEAF_ROWS and radius > 0:
                    rest, children = self._cover(lifted, members, centre, radius / 2)
                    below += [(me, c, m) for c, m in children]
                self.bucket.append(np.sort(rest))
            level = below

    @staticmethod
    def _cover(lifted: np.ndarray, members: np.ndarray, centre: int, within: float) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Children that cover rows within ``within``, the node's own centre first; and the rows left to the node.

        A centre that covers only itself opens no child: its row stays with the node.
        """
        left, children, alone, pick = members, [], [], centre
        while True:
            near = ((lifted[left] - lifted[pick]) ** 2).sum(axis=1) <= within * within
            if near.sum() > 1:
                children.append((pick, left[near]))
            else:
                alone.append(left[near])
            left = left[~near]
            if len(left) == 0 or len(children) >= CHILDREN or len(alone) >= CHILDREN:
                return np.concatenate([left, *alone]).astype(np.int64), children
            pick = left[0]

    def levels(self) -> list[np.ndarray]:
        depth = np.zeros(len(self.parent), np.int64)
        for i, p in enumerate(self.parent):
            depth[i] = 0 if p < 0 else depth[p] + 1
        return [np.flatnonzero(depth == d) for d in range(depth.max(initial=-1) + 1)]

    def packed(self) -> bytes:
        out = io.BytesIO()
        ends = np.cumsum([len(b) for b in self.bucket], dtype=np.int64)
        np.savez(
            out, ids=self.ids, labels=self.labels, rows=self.rows.astype(np.int32), centre=np.array(self.centre, np.int64), radius=np.array(self.radius), parent=np.array(self.parent, np.int64),
            bucket=np.concatenate(self.bucket) if self.bucket else np.zeros(0, np.int64), ends=ends,
        )
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> CoverTree:
        f = np.load(io.BytesIO(data))
        tree = CoverTree.__new__(CoverTree)
        tree.ids, tree.labels, tree.rows = f["ids"], f["labels"], f["rows"].astype(float)
        tree.centre, tree.radius, tree.parent = f["centre"], f["radius"], f["parent"]
        tree.bucket = np.split(f["bucket"], f["ends"][:-1]) if len(f["ends"]) else []
        return tree

    def search(self, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """Best ``k`` rows of each anchor and window: ids and scores (anchor, window, place), and how many rows were multiplied.

        A window holds scores with low <= 100 score <= high. ``same`` takes rows of the anchor's label, else of other labels.
        Empty places have the smallest integer as score.
        """
        windows = low.shape[1]
        nothing = np.iinfo(np.int64).min
        best, best_ids = np.full((len(ids), windows, k), nothing), np.zeros((len(ids), windows, k), np.int64)
        if not len(self.centre) or not len(ids):
            return best_ids, best, 0
        width = min(anchors.shape[1], self.rows.shape[1])
        norm = np.sqrt((anchors[:, :width] ** 2).sum(axis=1))
        middle = whole_products(anchors, self.rows[self.centre]).astype(float)
        reach = norm[:, None] * np.asarray(self.radius)[None, :]
        reach += 1e-9 * (np.abs(middle) + reach) + 1e-3
        upper, lower = middle + reach, middle - reach
        # scores and limits as floats are only used with a margin; rows are compared as integers
        floor, ceiling = low / 100.0 - 1, high / 100.0 + 1
        meets = ((upper[:, None, :] >= floor[:, :, None]) & (lower[:, None, :] <= ceiling[:, :, None])).any(axis=1)
        for nodes in self.levels()[1:]:
            meets[:, nodes] &= meets[:, np.asarray(self.parent)[nodes]]
        filled = np.array([len(b) for b in self.bucket]) > 0
        order = [n for n in np.argsort(-np.where(meets, upper, -np.inf).max(axis=0), kind="stable") if filled[n]]
        multiplied = 0
        for node in order:
            open_ = (upper[:, node, None] >= np.maximum(floor, best[:, :, -1])) & (lower[:, node, None] <= ceiling)
            take = np.flatnonzero(meets[:, node] & open_.any(axis=1))
            if not len(take):
                continue
            held = self.bucket[node]
            scores = whole_products(anchors[take], self.rows[held])
            multiplied += scores.size
            fits = (self.labels[held][None, :] == labels[take, None]) == same
            fits &= self.ids[held][None, :] != ids[take, None]
            for w in range(windows):
                inside = fits & (100 * scores >= low[take, w, None]) & (100 * scores <= high[take, w, None])
                self._merge(best, best_ids, take, w, np.where(inside, scores, nothing), self.ids[held], k)
        return best_ids, best, multiplied

    @staticmethod
    def _merge(best: np.ndarray, best_ids: np.ndarray, take: np.ndarray, w: int, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
        """Keep the k best of what was kept and of a bucket, whose rows are in the order of their ids."""
        if scores.shape[1] > k:  # rows that cannot be among the k best go before the sort; ties with the last one stay
            last = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            columns = (scores >= np.maximum(last, np.iinfo(np.int64).min + 1)[:, None]).any(axis=0)
            scores, ids = scores[:, columns], ids[columns]
        both = np.concatenate([best[take, w], scores], axis=1)
        names = np.concatenate([best_ids[take, w], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((names, -np.maximum(both, np.iinfo(np.int64).min + 1)), axis=1)[:, :k]
        best[take, w], best_ids[take, w] = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)


def _lists(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(ends) else []


def build(candidates: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """``shard, tree``, one packed cover tree a shard, written once; and the number of shards. ``candidates`` is a written table of ``id, label, v``."""
    shards = max(1, math.ceil(candidates.count() / shard_rows))

    def grow(rows: pa.Table) -> pa.Table:
        tree = CoverTree(rows["id"].to_numpy(), rows["label"].to_numpy(), padded(_lists(rows["v"])))
        return pa.table({"shard": pa.array([rows["shard"][0].as_py()], pa.int32()), "tree": pa.array([tree.packed()], pa.binary())})

    dealt = candidates.withColumn("shard", F.pmod(F.xxhash64("id", "label"), F.lit(shards)).cast("int"))
    return cut(dealt.groupBy("shard").applyInArrow(grow, "shard int, tree binary")), shards


def _packed(rows: pa.Table) -> pa.Table:
    """A block of anchors with their windows, as one value; anchors with fewer windows get empty ones."""
    windows = rows["windows"].to_pylist()
    most = max(map(len, windows), default=0)
    low, high, names = np.ones((len(windows), most), np.int64), np.zeros((len(windows), most), np.int64), np.zeros((len(windows), most), np.int64)
    for i, found in enumerate(windows):
        for j, w in enumerate(found):
            names[i, j], low[i, j], high[i, j] = w["name"], w["low"], w["high"]
    out = io.BytesIO()
    np.savez(out, ids=rows["id"].to_numpy(), labels=rows["label"].to_numpy(), v=padded(_lists(rows["v"])).astype(np.int32), low=low, high=high, names=names)
    return pa.table({"block": pa.array([rows["block"][0].as_py()], pa.int32()), "data": pa.array([out.getvalue()], pa.binary())})


def search(trees: DataFrame, shards: int, anchors: DataFrame, k: int, same: bool, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """``id, name, nbr, score``: the k best rows of every shard for each window of the anchors ``id, label, v, windows``.

    ``windows`` is an array of structs (name, low, high), limits of 100 times the score. Blocks of anchors stream to the
    shards behind each shard's tree, so a task holds one tree and one Arrow batch of blocks.
    """
    blocks = max(1, math.ceil(anchors.count() / block_anchors))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    packed = cut(anchors.select(block, "id", "label", "v", "windows").groupBy("block").applyInArrow(_packed, "block int, data binary"))
    sent = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("at"), "block", "data")
    stream = trees.select("shard", F.lit(0).alias("at"), F.lit(0).alias("block"), F.col("tree").alias("data")).unionByName(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = owner = None
        for batch in batches:
            for shard, at, data in zip(batch.column("shard").to_pylist(), batch.column("at").to_pylist(), batch.column("data")):
                if at == 0:
                    tree, owner = CoverTree.unpacked(data.as_py()), shard
                    continue
                if shard != owner:  # a shard without rows
                    continue
                f = np.load(io.BytesIO(data.as_py()))
                names, scores, _ = tree.search(f["ids"], f["labels"], f["v"].astype(float), f["low"], f["high"], k, same)
                a, w, n = np.nonzero(scores > np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (f["ids"][a], f["names"][a, w], names[a, w, n], scores[a, w, n])], names=["id", "name", "nbr", "score"])

    return stream.repartition("shard").sortWithinPartitions("shard", "at", "block").mapInArrow(run, "id long, name long, nbr long, score long")


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Negatives of every anchor and positive: rows of other labels that score from ``low`` to ``high`` percent of the positive.

    ``rows`` are ``id, label, v`` with one row an id, ``anchors`` some of them. Returns ``anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score``.
    """
    rows, anchors = cut(rows), cut(anchors)
    trees, shards = build(rows, shard_rows)
    best = [F.col("score").desc(), F.col("nbr")]
    all_scores = F.struct(F.lit(0).cast("long").alias("name"), F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high"))
    near = search(trees, shards, anchors.withColumn("windows", F.array(all_scores)), positives, same=True)
    near = cut(top_per_group(near, ["id"], best, positives))
    windows = near.groupBy("id").agg(F.collect_list(F.struct(F.col("nbr").alias("name"), (F.col("score") * low).alias("low"), (F.col("score") * high).alias("high"))).alias("windows"))
    hard = search(trees, shards, anchors.join(windows, "id"), negatives, same=False)
    hard = top_per_group(hard, ["id", "name"], best, negatives)
    scores = near.select("id", F.col("nbr").alias("name"), F.col("score").alias("positive_score"))
    return hard.join(scores, ["id", "name"]).select(
        F.col("id").alias("anchor_id"), F.col("name").alias("positive_id"), "rank", F.col("nbr").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
