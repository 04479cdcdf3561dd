"""Near-duplicates by SimHash with pigeonhole blocks.

Each distinct fingerprint is cut into four quarters. Two fingerprints with at most two differing bits agree on at least
two quarters, so they meet in one of six tables keyed by a pair of quarters; candidates are joined there and their
Hamming distance is verified. A bucket of more than ``max_bucket`` fingerprints is not paired: its members are linked
through the fingerprints at one bit from them, since two of them are within two bits exactly if they share such a
neighbour (or are one bit apart), which gives a star per neighbour instead of all pairs, and no link is lost.
Components come from alternating large-star and small-star rounds with salted joins; every round is a written table.

Edge cases: null texts and texts without words have fingerprint zero and are linked like any other. Null ids: a
component's id is the smallest non-null id in it, null if there is none. Repeated rows share fingerprint and component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tastemark.llm.common import in_pieces
from tastemark.session import cut

HASH_SEED = 42
SALTS = 16
#: Shingles hashed and counted at once, which bounds the memory for a very long text.
_AT_ONCE = 1 << 16
_QUARTERS = ((0, 16), (0, 32), (0, 48), (16, 32), (16, 48), (32, 48))


def fingerprint_of(text: str | None, size: int) -> int:
    """64-bit SimHash over shingles of ``size`` words, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for low in range(0, n, _AT_ONCE):
        high = min(n, low + _AT_ONCE)
        h = np.fromiter((digest(b" ".join(words[i : i + size]), HASH_SEED) for i in range(low, high)), np.uint64, high - low)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | Column, size: int = 3) -> Column:
    """64-bit fingerprint as a (signed) long."""

    @arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = lambda texts: pa.array(np.array([fingerprint_of(t, size) for t in texts], np.uint64).view(np.int64))
        yield from in_pieces(batches, work, pa.int64())

    return run.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def links(prints: DataFrame, max_bits: int = 2, max_bucket: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``; their connected components are those of all pairs within ``max_bits``."""
    if max_bits not in (1, 2):
        raise ValueError("the blocks are laid out for one or two differing bits")
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", a).bitwiseAND(0xFFFF).alias("x"), F.shiftrightunsigned("fp", b).bitwiseAND(0xFFFF).alias("y")) for i, (a, b) in enumerate(_QUARTERS)]))
    keyed = prints.select("fp", table.alias("t")).select("fp", (F.col("t.block").cast("long") * F.lit(1 << 32) + F.col("t.x") * F.lit(1 << 16) + F.col("t.y")).alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    mates = cut(keyed.join(full, "key"))

    small = mates.filter(F.col("n") <= max_bucket).select("key", "fp")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = small.select("key", F.col("fp").alias("a")).join(small.select("key", F.col("fp").alias("b")), "key").filter(F.col("a") < F.col("b")).filter(near <= max_bits).select("a", "b")

    large = mates.filter(F.col("n") > max_bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    around = large.select("fp", F.explode(flips).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("via"), (F.col("bit") == 0).alias("self"))
    if max_bits == 2:
        hubs = around.groupBy("via").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("via", "hub")
        stars = _salted_join(around.select("via", "fp"), hubs, "via")
        far = stars.filter(F.col("fp") != F.col("hub")).select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    else:
        own = large.select(F.col("fp").alias("via"))
        far = around.filter("not self and fp < via").join(own, "via", "left_semi").select(F.col("fp").alias("a"), F.col("via").alias("b"))
    return pairs.unionByName(far).distinct()


def _salted_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join whose hot keys on the left are dealt over ``SALTS`` tasks; the right side has one row per key."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of the connected component of every node that has an edge."""

    def star(pairs: DataFrame) -> DataFrame:
        """(u, v) to (v, smallest of u and its v)."""
        least = pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        return _salted_join(pairs, least, "u")

    def measure(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = measure(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hung = star(large)
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        e = cut(small)
        now = measure(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, size: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) per input row."""
    rows = cut(docs.select(F.col(id_col).alias("id"), fingerprint(text_col, size).alias("fp")))
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("low")))
    found = components(links(classes.select("fp"), max_bits))
    named = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = _salted_join(named.select("fp", "root"), lows, "root").select("fp", "component_id")
    return rows.join(cut(ids), "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = 5, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group of near-duplicates, all columns kept: the row with the smallest id (null ids last).

    Rows of equal id are told apart by their place in the input, so of fully equal rows one stays too.
    """
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"))
    rows = cut(docs.withColumns({"_simhash": fingerprint(text_col, size), "_place": place}))
    classes = cut(rows.groupBy(F.col("_simhash").alias("fp")).agg(F.min("_place").alias("first")))
    found = components(links(classes.select("fp"), max_bits))
    named = classes.join(found, classes["fp"] == found["node"], "left").select("first", F.coalesce("root", "fp").alias("root"))
    kept = cut(named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_kept")))
    # the kept rows grow with the input, so they are never broadcast
    return rows.join(kept.hint("merge"), F.col("_place.row") == F.col("_kept"), "left_semi").select(*docs.columns)
