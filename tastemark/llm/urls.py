"""URL filter with a tree of path templates per host.

Variable-looking segments (numbers, hashes, dates, long mixed tokens) become ``*`` at once; the distinct shapes of each
host then form a tree. Level by level, branches with too few pages become ``*`` as well, and labelled branches whose
share of blocked pages does not differ from that of all labelled branches beside them are merged into ``~``. A template
is rejected when its share of blocked labels, smoothed towards ``base``, reaches ``reject_at``. Labels come from rules: a rule fits its host
and all subdomains where the path starts with the rule's path, the longest one wins, and it also decides the pages it
fits; the templates decide the others. Only DataFrame operations are used.

Edge cases: a null url or one without ``://`` has empty host and path, no rule, and the verdict of the empty template.
The tree goes on level by level until no branch of ``least_pages`` pages has a further segment; what is
left of a path is one last ``**``. A template without labels has the share ``base`` and is let through. Null page ids and repeated rows are kept; extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemark.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    where: str  # host, then the start of the path

    @property
    def host(self) -> str:
        return self.where.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.where.partition("/")[2]


#: Fixed by the contract of the query.
RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)


def url_host(url: str | Column) -> Column:
    return F.translate(_part(url, 1), UPPER, LOWER)


def url_path(url: str | Column) -> Column:
    return _part(url, 2)


def _part(url: str | Column, group: int) -> Column:
    col = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(col, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (where, verdict) of the longest rule that fits, null if none does."""
    chosen = F.lit(None)
    for r in sorted(rules, key=lambda r: (len(r.where), r.where)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chosen = F.when(fits, F.struct(F.lit(r.where).alias("where"), F.lit(r.verdict).alias("verdict"))).otherwise(chosen)
    return chosen.cast("struct<where:string,verdict:string>")


def shape(path: Column) -> Column:
    """Segments of a path, variable-looking ones as ``*``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    stem = lambda s: F.regexp_replace(s, r"\.[A-Za-z]{2,5}$", "")
    variable = r"^(?:[0-9][0-9._-]*|[0-9a-fA-F-]{16,}|(?=.*[0-9])[A-Za-z0-9_-]{20,})$"
    return F.transform(parts, lambda s: F.when(stem(s).rlike(variable), F.lit("*")).otherwise(s))


def template_tree(shapes: DataFrame, least_pages: int, z: float) -> DataFrame:
    """``shapes`` (host, shape, pages, labelled, blocked) with the column ``template``."""
    rows, level = shapes.withColumn("template", F.lit("")), 0
    while True:
        rows = rows.withColumn("seg", F.get("shape", F.lit(level)))
        sums = [F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")]
        branches = cut(rows.filter("seg is not null").groupBy("host", "template", "seg").agg(*sums))
        large = branches.groupBy("host", "template").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= least_pages)
        if large.isEmpty():
            break
        beside = branches.filter("labelled > 0").groupBy("host", "template").agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
        # one host may hold most branches, so the join to its sums is salted
        salted = branches.withColumn("salt", F.pmod(F.xxhash64("seg"), F.lit(SALTS)))
        copies = beside.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        judged = salted.join(copies, ["host", "template", "salt"], "left")
        others, share = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") / F.col("all_labelled")
        apart = F.abs(F.col("blocked") / F.col("labelled") - (F.col("all_blocked") - F.col("blocked")) / others)
        noise = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / others))
        alike = (F.col("labelled") > 0) & (others > 0) & (apart <= F.lit(z) * noise)
        name = F.when(F.col("seg") == "*", "*").when(F.col("pages") < least_pages, F.lit("*")).when(alike, F.lit("~")).otherwise(F.col("seg"))
        named = judged.select("host", "template", "seg", name.alias("name"))
        rows = rows.join(cut(named), ["host", "template", "seg"], "left").withColumn("template", F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name"))).drop("name", "seg")
        rows, level = cut(rows), level + 1
    return rows.withColumn("template", F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/**")))).drop("seg")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, least_pages: int = 3, z: float = 1.96, strength: float = 4.0, base: float = 0.2, reject_at: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) per page."""
    split = pages.select(F.col(id_col).alias("id"), url_host(url_col).alias("host"), url_path(url_col).alias("path"))
    rows = split.select("id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r"), shape(F.col("path")).alias("shape"))
    ruled = rows.select("id", "host", "path", "shape", F.col("r.where").alias("rule"), F.col("r.verdict").alias("said"))
    labelled, blocked = F.count("said"), F.count(F.when(F.col("said") == "block", 1))
    shapes = cut(ruled.groupBy("host", "shape").agg(F.count("*").alias("pages"), labelled.alias("labelled"), blocked.alias("blocked")))
    tree = template_tree(shapes, least_pages, z)
    purity = (F.sum("blocked") + F.lit(strength * base)) / (F.sum("labelled") + F.lit(strength))
    templates = cut(tree.groupBy("host", "template").agg(purity.alias("purity")))
    named = cut(tree.select("host", "shape", "template").join(templates, ["host", "template"]).select("host", "shape", "template", "purity"))
    out = ruled.join(named, ["host", "shape"], "left")
    verdict = F.coalesce("said", F.when(F.col("purity") >= F.lit(reject_at), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
