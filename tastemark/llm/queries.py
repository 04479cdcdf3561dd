"""Registered queries of the ten operators: production parameters, whole tables, and SQL where it can express the rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemark.llm import backtrack_bpe, bpe, decontam, dialogues, fingerprints, language, negatives, oracles, pii, secrets, simhash, toxicity, urls, warc
from tastemark.llm.common import remainder, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
MERGES = public_tokenizers.path("byte_bpe_50k.json")


def _sha(text) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = remainder("doc_id", 4)
    model = language.train(docs.filter(part != 2))
    rows = docs.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), language.identify(model, "text").alias("r"))
    return rows.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), "r.score", "r.n_words", "r.switches")


def op2_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", pii.spans("text").alias("s"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [_count("s", kind) for kind in pii.BASE]
    base = F.filter("s", lambda s: s["kind"].isin(*pii.BASE))
    return rows.select("doc_id", *counts, _sha(joined(base)).alias("base_sha256"), joined(F.col("s")).alias("spans"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip("text", VOCABULARY, PATTERN).alias("r")).select("doc_id", "r.ids", "r.decoded")
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan(table(spark, sf_dir, "documents"), path_col="doc_id")
    counts = [_count("spans", kind) for kind in secrets.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(F.col("path").alias("doc_id"), *counts, _sha(secrets.spans_text(base)).alias("base_sha256"), secrets.spans_text("spans").alias("spans"))


def op5_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, max_bits=2)


def op6_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    n = decontam.n_hit()
    digest = _sha(F.array_join(F.array_sort("hits.items"), ","))
    return rows.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), n.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"), digest.alias("items_sha256"), (n > 0).alias("contaminated"),
    )


def op8_prefix_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kept_chars")


def op9_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.cut(warc.write(table(spark, sf_dir, "pages"), least_bytes=0))
    return warc.read(archives, with_payload=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


def op10_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = remainder("doc_id", 3)
    learned = labels.filter(part != 1).filter("toxic is not null").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, learned)
    rows = docs.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), toxicity.score(model, "text").alias("r"))
    return rows.select("doc_id", "held_out", "r.score", F.when(F.col("r.score") >= 0.7, 1).otherwise(0).alias("predicted"), F.col("r.neighbours").cast("array<long>").alias("neighbours"), "r.similarities")


def op11_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.vectors(table(spark, sf_dir, "embeddings"))
    return negatives.mine(rows, rows.where(F.col("id") % 100 == 0), positives=5, negatives=10, low=30, high=90)


def op12_backtrack_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", backtrack_bpe.round_trip("text", MERGES).alias("r")).select("doc_id", "r.ids", "r.decoded")
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256"))


def op13_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return dialogues.repair(dialogues.damaged(rows), rows.select(F.col("conv_id").alias("conv"))).withColumnRenamed("conv", "conv_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_crf, op2_pii_anchors, op3_byte_bpe, op4_secret_ledger, op5_simhash_blocks, op6_path_templates, op7_suffix_arrays, op8_prefix_hashes, op9_warc_zstd, op10_toxicity_neighbours, op11_cover_tree_negatives, op12_backtrack_bpe, op13_grammar_repair)
}
ORACLES: dict[str, str] = oracles.ORACLES
