"""Secret scan with an incremental ledger of blobs.

Every version of every path is addressed by the hash of its content. The ledger remembers which (blob, rule version)
pairs have been scanned and what was found; only unseen pairs are scanned, each once however many paths and versions
share the blob, and findings are joined back to all paths. All of it is DataFrame code: matches come from
``regexp_extract_all``, their places from the lengths of the texts between them (``split`` by the same pattern).

Edge cases: a null text is the empty blob. Null paths keep their row. Repeated rows and equal blobs get equal findings.
A ledger row of another rule version does not count as seen. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemark.session import cut


@dataclass(frozen=True)
class Rule:
    """``pattern`` must not match the empty text; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = ("assign", "access", "hex")
#: A run of 24 or more is the same match as a run of any length that has 24: both begin where the run begins.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosted", r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_)[A-Za-z0-9_-]{16,}"),
)
_SPANS = "array<struct<start:int,end:int>>"


def find(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    value = lambda m: m if rule.group == 0 else F.regexp_extract(m, rule.pattern, rule.group)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["hit"])
        kept = F.char_length(value(pair["hit"])) >= rule.least
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(kept, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
    return F.when(text.rlike(rule.pattern), F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPANS))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "path", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows).

    Findings: one row per version with ``path``, ``blob`` and ``spans``, an array of (start, kind, end) sorted by start
    and then rule order. Ledger rows: (blob, rule, spans); append them to the ledger after use.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = versions.select(F.col(path_col).alias("path"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("blob"))
    blobs = rows.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        todo = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = ledger.select("blob", "rule").groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    found = [F.struct(F.lit(r.key).alias("rule"), F.when(~F.array_contains("seen", r.key), find(F.col("text"), r)).alias("spans")) for r in rules]
    scanned = todo.select("blob", F.explode(F.array(*found)).alias("f")).filter("f.spans is not null").select("blob", "f.rule", "f.spans")
    fresh = cut(scanned)
    known = fresh if ledger is None else fresh.unionByName(ledger.select("blob", "rule", "spans"))
    return _to_paths(rows, known, rules), fresh


def _to_paths(rows: DataFrame, known: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    order = F.coalesce(*[F.when(F.col("rule") == r.key, F.lit(i)) for i, r in enumerate(rules)])
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rank") + 1)
    hits = known.filter(F.size("spans") > 0).withColumn("rank", order).filter("rank is not null")
    hits = hits.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), s["end"].alias("end"), kind.alias("kind"))).alias("spans"))
    by_blob = cut(hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")))  # one row per rule at most
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return rows.select("path", "blob").join(by_blob, "blob", "left").select("path", "blob", F.coalesce("spans", empty).alias("spans"))


def spans_text(spans: str | Column) -> Column:
    col = F.col(spans) if isinstance(spans, str) else spans
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
