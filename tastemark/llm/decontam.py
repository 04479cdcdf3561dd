"""Benchmark decontamination with suffix arrays over the training documents.

Each task holds a shard of documents as word numbers. Every suffix of the shard and of the test set, within runs of words
of the test set's vocabulary, is sorted to its full length by prefix doubling; the place of the test suffixes among the
shard's is found by binary search, and the common beginning with the neighbours there is the longest verbatim match.
Windows are searched in an array sorted to their length, which gives all places of each. Documents are whole within a
shard (a piece of a batch), so nothing is shuffled. The test set is a query set; it is read in blocks of at most ``block_words``
words, each a broadcast of proven size, and a further block is one more pass in the same stage.

Words are matched on bytes after lower-casing A-Z; every ASCII character but letters and digits separates words.

Edge cases: null texts have no words, and neither hit nor are hit. An item without words has no window; an item of fewer
words than a window is one window. Items with equal texts are all reported. Null item ids are reported as empty strings.
Repeated documents get equal results. An empty test set or table is no error.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tastemark.llm.common import free_name, pieces

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_HITS = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("longest", pa.int32()), ("longest_at", pa.int32())])
_TYPE = "n_words long, spans array<int>, items array<string>, longest int, longest_at int"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class TestBlock:
    """Word numbers, windows and suffixes of one block of test items."""

    __test__ = False

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.number: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        coded = [[self.number.setdefault(w, len(self.number) + 1) for w in ws] for _, ws in items]
        self.bits = len(self.number).bit_length() or 1
        self.per_key = max(1, 62 // self.bits)
        #: The items laid end to end, with a 0 after each.
        self.codes = np.array([w for c in coded for w in (*c, 0)], np.int64)
        #: Window length -> (distinct windows, the items that each occurs in).
        self.windows: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        by_size: dict[int, dict[tuple, dict[int, None]]] = {}
        for i, c in enumerate(coded):
            n = min(window, len(c))
            for j in range(len(c) - n + 1):
                by_size.setdefault(n, {}).setdefault(tuple(c[j : j + n]), {})[i] = None
        for n, found in by_size.items():
            self.windows[n] = np.array(list(found), np.int64).reshape(-1, n), [list(x) for x in found.values()]

    def keys(self, codes: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
        """Columns that order the suffixes at ``at`` by their first ``size`` words; positions past the end count as 0."""
        columns = []
        for low in range(0, size, self.per_key):
            key = np.zeros(len(at), np.int64)
            for k in range(low, min(size, low + self.per_key)):
                key = (key << self.bits) | codes[at + k]
            columns.append(key)
        return columns


class SuffixArray:
    """Sorted suffixes of a shard, to a depth of ``size`` words, among the given starts."""

    def __init__(self, block: TestBlock, codes: np.ndarray, starts: np.ndarray, size: int):
        self.block, self.size = block, size
        self.padded = np.concatenate([codes, np.zeros(size, np.int64)])
        columns = block.keys(self.padded, starts, size)
        order = np.lexsort(columns[::-1])
        self.at, self.columns = starts[order], [c[order] for c in columns]

    def find(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one rank of the suffixes that begin with each query row (of ``size`` words)."""
        flat = np.concatenate([queries.reshape(-1), np.zeros(self.size, np.int64)])
        wanted = self.block.keys(flat, np.arange(len(queries)) * self.size, self.size)
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.at), np.int64)
        for have, want in zip(self.columns, wanted, strict=True):
            low, high = _bisect(have, want, low, high, False), _bisect(have, want, low, high, True)
        return low, high


def _bisect(have: np.ndarray, want: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of every ``want`` within its own range of ``have``."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        less = np.zeros(len(want), bool)
        seen = have[np.minimum(mid[open_], len(have) - 1)]
        less[open_] = seen <= want[open_] if right else seen < want[open_]
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


class FullOrder:
    """All suffixes of ``codes`` that start at a word, each up to the next 0, in full order; a rank per depth that was sorted."""

    def __init__(self, codes: np.ndarray, run: np.ndarray, bits: int):
        self.codes, self.run, depth = codes, run, max(1, 62 // bits)
        places = np.flatnonzero(codes)
        padded = np.concatenate([codes, np.zeros(depth, np.int64)])
        key, alive = np.zeros(len(places), np.int64), np.ones(len(places), bool)
        for k in range(depth):
            word = padded[places + k]
            alive &= word > 0
            key = (key << bits) | np.where(alive, word, 0)
        order = np.argsort(key, kind="stable")
        self.at, first = places[order], _changes(key[order])
        rank = np.zeros(len(codes) + 1, np.int32)
        rank[self.at] = _heads(first, np.arange(len(places))) + 1
        self.ranks = [(depth, rank)]
        while True:
            tied = np.flatnonzero(~(first & np.append(first[1:], True)) & (run[self.at] >= depth))
            if not len(tied):
                return
            some = self.at[tied]
            key = (rank[some].astype(np.int64) << 32) | rank[some + depth]
            order = np.argsort(key, kind="stable")
            self.at[tied], first[tied] = some[order], _changes(key[order])
            rank = rank.copy()
            rank[self.at[tied]] = _heads(first[tied], tied) + 1
            depth *= 2
            self.ranks.append((depth, rank))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of words that the suffixes at ``a`` and ``b`` begin with together, from the deepest ranks to single words."""
        a, start = a.copy(), a
        b = b.copy()
        lowest = self.ranks[0][1]
        deep = np.flatnonzero(lowest[a] == lowest[b])
        for depth, rank in reversed(self.ranks):
            same = deep[(rank[a[deep]] == rank[b[deep]]) & (rank[a[deep]] > 0)]
            step = np.minimum(depth, self.run[a[same]])
            a[same] += step
            b[same] += step
        going = np.arange(len(a))
        for _ in range(self.ranks[0][0]):
            going = going[(self.codes[a[going]] == self.codes[b[going]]) & (self.codes[a[going]] > 0)]
            a[going] += 1
            b[going] += 1
        return a - start


def _changes(keys: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it."""
    return np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)


def _heads(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row the place of the first row of its group."""
    return np.maximum.accumulate(np.where(first, at, 0)) if len(at) else at


def _search(block: TestBlock, docs: list[list[bytes]]) -> tuple[list[list[int]], list[set[int]], list[int], list[int]]:
    """Per document: flat [start, end) word ranges hit, items, and length and place of the longest verbatim match."""
    lens = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(lens + 1)  # one 0 after each document, so that no run crosses
    first = ends - lens - 1
    size_all = int(ends[-1]) if len(ends) else 0
    codes = np.zeros(size_all + len(block.codes), np.int64)
    number = block.number.get
    for d, s in zip(docs, first, strict=True):
        codes[s : s + len(d)] = [number(w, 0) for w in d]
    codes[size_all:] = block.codes
    stops, every = np.flatnonzero(codes == 0), np.flatnonzero(codes)
    run = np.zeros(len(codes) + 1, np.int64)
    run[every] = stops[np.searchsorted(stops, every)] - every
    places = every[every < size_all]
    spans: list[list[int]] = [[] for _ in docs]
    items: list[set[int]] = [set() for _ in docs]
    for size, (windows, within) in block.windows.items():
        starts = places[run[places] >= size]
        if not len(starts):
            continue
        array = SuffixArray(block, codes[:size_all], starts, size)
        low, high = array.find(windows)
        found = high - low
        window = np.repeat(np.arange(len(windows)), found)
        at = array.at[np.arange(len(window)) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)]
        doc = np.searchsorted(ends, at, "right")
        for d, p in zip(doc.tolist(), (at - first[doc]).tolist(), strict=True):
            spans[d] += [p, p + size]
        for pair in np.unique(doc * len(windows) + window).tolist():
            items[pair // len(windows)].update(within[pair % len(windows)])
    longest, where = _longest(FullOrder(codes, run, block.bits), size_all, places, first, ends)
    return [_merge(x) for x in spans], items, longest, where


def _longest(order: FullOrder, size: int, places: np.ndarray, first: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Length and first place of the longest match of each document with any test suffix: one of the two nearest in the order."""
    longest, where = np.zeros(len(ends), np.int64), np.full(len(ends), -1)
    test = order.at[order.at >= size]
    if len(places) and len(test):
        rank = order.ranks[-1][1]
        after = np.searchsorted(rank[test], rank[places])
        length = np.maximum(*(order.common(places, test[np.clip(i, 0, len(test) - 1)]) for i in (after - 1, after)))
        doc = np.searchsorted(ends, places, "right")
        np.maximum.at(longest, doc, length)
        top = np.flatnonzero((length == longest[doc]) & (length > 0))
        found, at = np.unique(doc[top], return_index=True)
        where[found] = places[top[at]] - first[found]
    return longest.tolist(), where.tolist()


def _merge(flat: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def blocks(test: DataFrame, window: int, block_words: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[TestBlock]:
    """The test set in blocks of at most ``block_words`` words (or one item), streamed to the driver one block at a time."""
    held, size = [], 0
    for r in test.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).filter("text is not null").toLocalIterator():
        ws = words_of(r["text"])
        if not ws:
            continue
        if held and size + len(ws) > block_words:
            yield TestBlock(held, window)
            held, size = [], 0
        held.append((r["id"], ws))
        size += len(ws)
    if held or not size:
        yield TestBlock(held, window)


def hits(docs: DataFrame, test: DataFrame, text_col: str = "text", out: str = "hits", window: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, spans (flat word ranges that windows cover), items (ids), longest verbatim match and its place."""
    for i, block in enumerate(blocks(test, window, block_words)):
        found = _searcher(docs.sparkSession.sparkContext.broadcast(pickle.dumps(block))).asNondeterministic()(F.col(text_col))
        if not i:
            docs = docs.withColumn(out, found)
        else:
            more = free_name(docs, "_block_hits")
            docs = docs.withColumn(more, found).withColumn(out, arrow_udf(_joined, _TYPE)(F.col(out), F.col(more))).drop(more)
    return docs


def _searcher(packed: Broadcast):
    @arrow_udf(_TYPE)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block = pickle.loads(packed.value)
        for batch in batches:
            done = []
            for piece in pieces(batch):
                split = [words_of(t) for t in piece.to_pylist()]
                rows = zip(split, *_search(block, split), strict=True)
                done.append(pa.array([{"n_words": len(w), "spans": s, "items": sorted({block.names[i] for i in x}), "longest": n, "longest_at": p} for w, s, x, n, p in rows], _HITS))
            yield pa.concat_arrays(done) if done else pa.array([], _HITS)

    return search


def _joined(a: pa.Array, b: pa.Array) -> pa.Array:
    rows = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        top = x if x["longest"] >= y["longest"] else y
        rows.append({"n_words": x["n_words"], "spans": _merge(x["spans"] + y["spans"]), "items": sorted({*x["items"], *y["items"]}), "longest": top["longest"], "longest_at": top["longest_at"]})
    return pa.array(rows, _HITS)


def n_hit(hits_col: str = "hits") -> Column:
    """Number of words that windows cover: the ends less the starts of the flat ranges, by alternating signs."""
    flat = F.col(f"{hits_col}.spans")
    return F.aggregate(flat, F.lit(0).cast("long"), lambda a, x: x.cast("long") - a)


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def decontaminate(docs: DataFrame, test: DataFrame, text_col: str = "text", **options: int) -> DataFrame:
    """The documents that no window of a test item occurs in, all columns kept, whatever their names."""
    out = free_name(docs, "_hits")
    return hits(docs, test, text_col, out, **options).filter(F.size(f"{out}.spans") == 0).drop(out)
