"""Shared helpers of the operators: tables, the row split of the contracts, labelled samples and Arrow pieces."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a Python helper works on at once; larger Arrow batches are cut at row boundaries.
PIECE_BYTES = 4 << 20
#: Present where the C library is glibc.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as a column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remainder(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id's text modulo ``mod``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(mod))


def pieces(array: pa.Array, max_bytes: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of at most ``max_bytes`` each, or of one row where a row is longer."""
    if len(array) == 0:
        return
    if array.nbytes <= max_bytes:
        yield array
        return
    start = size = 0
    for i, value in enumerate(array):
        n = len(value.as_buffer()) if value.is_valid else 0
        if size + n > max_bytes and i > start:
            yield array.slice(start, i - start)
            start, size = i, 0
        size += n
    yield array.slice(start)


def small_batches(spark: SparkSession, most: int = PIECE_BYTES) -> None:
    """Bound the bytes of an Arrow batch between Spark and its Python workers for what this session plans from now on.

    A batch of many long texts is held several times over: by the JVM outside its heap, by the worker, and again as the
    result. A smaller bound that the session has already is kept; results do not depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(name, None) or "").removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(name, str(most))


def in_pieces(batches: Iterator[pa.Array], work: Callable[[list], pa.Array], kind: pa.DataType, max_bytes: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """Apply ``work`` (a list of values to an Arrow array of as many rows) to bounded slices of every batch."""
    for batch in batches:
        done = [work(piece.to_pylist()) for piece in pieces(batch, max_bytes)]
        yield pa.concat_arrays(done) if done else pa.array([], kind)
        done = batch = None
        give_back()


def give_back() -> None:
    """Return memory that is free within the worker to the system: workers are reused by later stages and run side by side."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def sampled(rows: DataFrame, label: str, per_label: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """About ``per_label`` rows of each label, taken by a hash of the id at a rate per label; only the counts reach the driver.

    Rows with a null label or id are left out. The number of rows returned is bounded by ``per_label`` up to chance.
    """
    rows = rows.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0)
    steps = 1 << 30
    rate = F.coalesce(*[F.when(F.col(label) == F.lit(k), F.lit(min(steps, steps * per_label // n))) for k, n in sorted(counts.items())])
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(steps)) < rate)


def gathered(rows: DataFrame, label: str, per_label: int, seed: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> list[Row]:
    """(label, text, id) of sampled rows on the driver, in a fixed order, at most 1.3 times ``per_label`` of each label.

    Of each text comes one window of at most ``max_chars`` code points at a hashed place; null texts are left out, and of
    rows of one id and label one is taken. The bound holds before anything is collected.
    """
    room = F.greatest(F.lit(1), F.char_length(text_col) - F.lit(max_chars) + 1)
    start = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col)), room).cast("int") + 1
    window = F.substring(F.col(text_col), start, F.lit(max_chars))
    drawn = rows.filter(F.col(text_col).isNotNull()).select(F.col(label).alias("label"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("draw"), F.col(id_col).alias("id"), window.alias("text"))
    one = drawn.groupBy("label", "draw", "id").agg(F.min("text").alias("text"))
    first = one.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("draw", "id"))).filter(F.col("place") <= per_label * 13 // 10)
    return sorted(first.select("label", "text", "id", "draw").collect(), key=lambda r: (r["draw"], r["id"], r["text"]))


def labelled_sample(rows: DataFrame, label: str, per_label: int, seed: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple]:
    """A bounded sample of labelled rows (label, text) for fitting a model on the driver."""
    taken = gathered(sampled(rows, label, per_label, seed, id_col), label, per_label, seed, max_chars, id_col, text_col)
    return [(r["label"], r["text"]) for r in taken]
