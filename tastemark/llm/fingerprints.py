"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` holds two modular prefix arrays of a text (one prime, two bases). They give the hash of any span in
constant time, so any two spans are compared at once, and the longest common extension of two places by binary search.
A fingerprint keeps, for each of 64 slots, eight bits of the least span hash that falls into it, over all spans of
``SPAN`` code points; the share of equal slots tells how many spans two texts have in common.

Edge cases: a null text is empty; a text shorter than a span is one span; the empty text has an all-empty fingerprint.
Equal texts have equal fingerprints; two empty texts are alike to degree 1, an empty and another one to degree 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tastemark.llm.common import in_pieces
from tastemark.session import cut

PRIME = (1 << 31) - 1
BASES = (1_000_003, 69_621)
SPAN, SLOTS, EMPTY = 24, 64, 255
_BLOCK = 1 << 18


def _mod(x: np.ndarray) -> np.ndarray:
    """Residue of non-negative 64-bit numbers modulo the Mersenne prime."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


class _Powers:
    """Powers of the bases and of their inverses, grown by doubling."""

    up = np.ones((2, 1), np.int64)
    down = np.ones((2, 1), np.int64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while (have := cls.up.shape[1]) < n:
            step = [np.array([[pow(b, sign * have, PRIME)] for b in BASES], np.int64) for sign in (1, -1)]
            cls.up = np.concatenate([cls.up, _mod(cls.up * step[0])], 1)
            cls.down = np.concatenate([cls.down, _mod(cls.down * step[1])], 1)
        return cls.up, cls.down


class Prefixes:
    """Prefix hashes of one text: ``sums[k, i]`` is the hash of the first i code points by base k."""

    def __init__(self, text: str | np.ndarray):
        self.code = code_points(text) if isinstance(text, str) else text
        n = len(self.code)
        up, _ = _Powers.to(n + 1)
        self.sums = np.zeros((2, n + 1), np.int64)
        for k in range(2):
            self.sums[k, 1:] = _mod(np.cumsum(_mod((self.code + 1) * up[k, :n])))

    def __len__(self) -> int:
        return len(self.code)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [start, end), independent of where they stand."""
        _, down = _Powers.to(len(self) + 1)
        h = [_mod(_mod(self.sums[k][end] - self.sums[k][start] + PRIME) * down[k][start]) for k in range(2)]
        return (h[0] << 31) | h[1]

    def equal(self, start: int, other: Prefixes, at: int, length: int) -> bool:
        one = lambda p, s: int(p.spans(np.array([s]), np.array([s + length]))[0])
        return start + length <= len(self) and at + length <= len(other) and one(self, start) == one(other, at)

    def extension(self, start: int, other: Prefixes, at: int) -> int:
        """Length of the longest common extension of both places, by binary search on span equality."""
        low, high = 0, min(len(self) - start, len(other) - at)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(start, other, at, mid) else (low, mid - 1)
        return low


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def marks_of(prefixes: Prefixes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and value of every span of ``width`` code points, by where it starts."""
    n = len(prefixes)
    slots, values = np.zeros(max(0, n - width + 1) if n else 0, np.uint8), np.zeros(max(0, n - width + 1) if n else 0, np.int64)
    for low in range(0, len(slots), _BLOCK):
        start = np.arange(low, min(low + _BLOCK, len(slots)))
        h = prefixes.spans(start, start + width).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) >> np.uint64(1)
        slots[start], values[start] = (h & np.uint64(SLOTS - 1)).astype(np.uint8), h.astype(np.int64) >> 6
    return slots, values


def print_of(*marks: tuple[np.ndarray, np.ndarray]) -> str:
    """The fingerprint that the least values of each slot make."""
    slots, values = (np.concatenate(x) for x in zip(*marks, strict=True))
    least = np.full(SLOTS, np.iinfo(np.int64).max)
    if len(slots):
        order = np.sort((slots.astype(np.int64) << 57) | values)  # values have 57 bits
        first = np.flatnonzero(np.diff(order >> 57, prepend=-1))
        least[order[first] >> 57] = order[first] & ((1 << 57) - 1)
    kept = np.where(least == np.iinfo(np.int64).max, EMPTY, least % EMPTY).astype(np.uint8)
    return kept.tobytes().hex()


def fingerprint_of(prefixes: Prefixes) -> str:
    return print_of(marks_of(prefixes, min(SPAN, len(prefixes))))


def likeness(a: str, b: str) -> float:
    """Share of both texts' spans that the other has too (Dice), from the equal slots less what chance gives; 0 to 1."""
    if a == b:
        return 1.0
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    filled = (x != EMPTY) | (y != EMPTY)
    share = float(((x == y) & filled).sum()) / int(filled.sum())
    overlap = max(0.0, (share - 1 / EMPTY) / (1 - 1 / EMPTY))
    return 2 * overlap / (1 + overlap)


def fingerprint(text: str | Column) -> Column:
    @arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_pieces(batches, lambda texts: pa.array([fingerprint_of(Prefixes(code_points(t))) for t in texts], pa.string()), pa.string())

    return run.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


_EDIT_TYPE = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_chars long, place string, part int, text string"
_EDIT_KIND = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("kept_chars", pa.int64()), ("place", pa.string()), ("part", pa.int32()), ("text", pa.string())])


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


class _Held:
    def __init__(self, ident: int | None, text: str | None):
        self.id, self.text = ident, text or ""
        self.prefixes = Prefixes(code_points(self.text))
        self.marks = marks_of(self.prefixes, min(SPAN, len(self.prefixes)))
        self.print = print_of(self.marks)

    def edited_print(self, following: _Held, kept: int, taken: int) -> str:
        """Fingerprint of the first ``kept`` code points followed by ``taken`` of the other text: only spans over the seam are new."""
        if kept + taken < SPAN:
            return fingerprint_of(Prefixes(np.concatenate([self.prefixes.code[:kept], following.prefixes.code[:taken]])))
        seam = np.concatenate([self.prefixes.code[max(0, kept - SPAN + 1) : kept], following.prefixes.code[: min(taken, SPAN - 1)]])
        parts = [tuple(x[: max(0, n - SPAN + 1)] for x in held.marks) for held, n in ((self, kept), (following, taken))]
        return print_of(*parts, *([marks_of(Prefixes(seam), SPAN)] if len(seam) >= SPAN else []))

    def against(self, following: _Held) -> dict:
        changed = edit(self.text, following.text)
        third = len(self.text) // 3
        kept, taken = len(self.text) - third, min(third, len(following.text))
        print_ = self.edited_print(following, kept, taken)
        return {
            "id": self.id, "n_chars": len(self.text), "edited_sha256": hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
            "fingerprint": self.print, "edited_fingerprint": print_, "near_edited": likeness(self.print, print_), "near_next": likeness(self.print, following.print),
            "kept_chars": kept + self.prefixes.extension(kept, following.prefixes, 0) if third else kept,
        }


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row against the next one of the partition; the first and the last row also come back with their texts."""
    part, held, out, size = TaskContext.get().partitionId(), None, [], 0
    for batch in batches:
        for ident, text in zip(batch.column(0), batch.column(1), strict=True):
            now = _Held(ident.as_py(), text.as_py())
            if held is None:
                out.append({"id": now.id, "place": "head", "part": part, "text": now.text})
            else:
                out.append(held.against(now) | {"place": "inner"})
            held = now
            if (size := size + 1) % 500 == 0:
                yield pa.RecordBatch.from_pylist(out, _EDIT_KIND)
                out = []
    if held is not None:
        out.append({"id": held.id, "place": "tail", "part": part, "text": held.text})
    if out:
        yield pa.RecordBatch.from_pylist(out, _EDIT_KIND)


_PAIR_TYPE = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_chars long"


def _pair(text: pa.Array, following: pa.Array) -> pa.Array:
    fields = [f for f in _EDIT_KIND if f.name not in ("id", "place", "part", "text")]
    rows = [_Held(None, a).against(_Held(None, b)) for a, b in zip(text.to_pylist(), following.to_pylist(), strict=True)]
    return pa.array([{f.name: r[f.name] for f in fields} for r in rows], pa.struct(fields))


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness, the texts taken in descending order of id.

    Rows are dealt out by ranges of the id (and, among equal ids, the beginning of the text) and walked in order within
    a task; only the two rows at the seams between
    tasks are paired afterwards, by a join on the number of the range. Equal ids are ordered by text, null ids come
    last. The text after the last one is the first.
    """
    spark = docs.sparkSession
    order = [F.col("id").desc_nulls_last(), F.col("text").asc_nulls_first()]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = [order[0], F.substring("text", 1, 32).asc_nulls_first()]  # short keys, as a sample of them goes to the driver
    walked = cut(rows.repartitionByRange(ranges, *dealt).sortWithinPartitions(*order).mapInArrow(_walk, _EDIT_TYPE))
    inner = walked.filter("place = 'inner'").drop("place", "part", "text")
    heads = walked.filter("place = 'head'").select("part", F.col("text").alias("following"))
    after = heads.select("part").withColumn("previous", F.lag("part").over(Window.orderBy("part")))  # one small number per range
    last = after.agg(F.max("part")).first()[0]
    after = after.select("part", F.coalesce("previous", F.lit(-1 if last is None else last)).alias("tail"))
    seams = walked.filter("place = 'tail'").select("id", "text", F.col("part").alias("tail")).join(after, "tail").join(heads, "part")
    seams = seams.select("id", arrow_udf(_pair, _PAIR_TYPE)("text", "following").alias("r")).select("id", "r.*")
    return inner.unionByName(seams).withColumnRenamed("id", id_col)
