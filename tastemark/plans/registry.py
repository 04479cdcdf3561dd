"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name; ``sql`` is the equivalent statement on the same tables."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


# Shared pieces of the checking SQL -----------------------------------------------------------------------------------

REVIEWS = """reviews AS (
  SELECT o_custkey AS user_id, l_suppkey AS item_id, 1 + CAST(floor(l_quantity) AS INT) % 5 AS stars,
         CAST(o_orderdate AS DATE) AS date, (CAST(o_orderdate AS DATE) - DATE '1970-01-01') * CAST(86400 AS BIGINT) AS ts,
         l_orderkey AS o_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

CELLS = REVIEWS + """, cells AS (
  SELECT user_id, item_id, sum(CAST(stars AS DOUBLE)) AS value, max(ts) AS ts FROM reviews GROUP BY user_id, item_id)"""

SPLIT = CELLS + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM cells),
split AS (
  SELECT *, CASE WHEN pos > n - floor(n * CAST(0.3 AS DOUBLE)) THEN 'test'
                 WHEN pos > n - floor(n * (CAST(0.2 AS DOUBLE) + CAST(0.3 AS DOUBLE))) THEN 'valid' ELSE 'train' END AS split FROM ranked),
train AS (SELECT user_id, item_id, value, ts FROM split WHERE split = 'train'),
valid AS (SELECT user_id, item_id FROM split WHERE split = 'valid'),
test AS (SELECT user_id, item_id FROM split WHERE split = 'test')"""

#: The split of the liked cells alone, to follow ``SPLIT``.
IMPLICIT = """iranked AS (
  SELECT user_id, item_id, CAST(1 AS DOUBLE) AS value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n
  FROM cells WHERE value > 3),
isplit AS (
  SELECT *, CASE WHEN pos > n - floor(n * CAST(0.3 AS DOUBLE)) THEN 'test'
                 WHEN pos > n - floor(n * (CAST(0.2 AS DOUBLE) + CAST(0.3 AS DOUBLE))) THEN 'valid' ELSE 'train' END AS split FROM iranked),
itrain AS (SELECT user_id, item_id, value FROM isplit WHERE split = 'train'),
ivalid AS (SELECT user_id, item_id FROM isplit WHERE split = 'valid'),
itest AS (SELECT user_id, item_id FROM isplit WHERE split = 'test')"""

BUSINESS = """business AS (
  SELECT s_suppkey AS item_id, s_name AS name, n_name AS city, r_name AS state, CAST(1 + (s_suppkey % 9) * 0.5 AS DOUBLE) AS stars,
         CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE repeat('$', CAST(1 + s_suppkey % 4 AS INT)) END AS price,
         CAST(43.60 AS DOUBLE) + (s_suppkey % 20) * CAST(0.01 AS DOUBLE) AS lat, CAST(-79.50 AS DOUBLE) + (s_suppkey % 25) * CAST(0.01 AS DOUBLE) AS lon,
         CASE WHEN s_suppkey % 10 <> 3 THEN 1 ELSE 0 END AS is_open
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CATEGORIES = """item_categories AS (
  SELECT DISTINCT l_suppkey AS item_id, p_type AS category FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def sims_sql(cells: str, row: str, col: str, name: str = "sims", value: str = "value", digits: int = 9) -> str:
    """Cosine of every pair that shares a cell, as a self join on the column."""
    return f"""{name}_unit AS (
  SELECT {row} AS r, {col} AS c, {value} / sqrt(sum({value} * {value}) OVER (PARTITION BY {row})) AS v FROM {cells} WHERE {value} <> 0),
{name} AS (
  SELECT a.r AS id, b.r AS nbr, round(sum(a.v * b.v), {digits}) AS sim FROM {name}_unit a JOIN {name}_unit b ON a.c = b.c AND a.r <> b.r
  GROUP BY a.r, b.r)"""


def top_sql(sims: str, k: int, name: str = "nbrs") -> str:
    return f"""{name} AS (
  SELECT id, nbr, sim, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nbr) AS rank FROM {sims} WHERE sim > 0) WHERE rank <= {k})"""


def score_sql(nbrs: str, ratings: str, item_based: bool = False, name: str = "scores", value: str = "value") -> str:
    if item_based:
        return f"""{name} AS (
  SELECT t.user_id, n.id AS item_id, round(sum(n.sim * t.{value}), 9) AS score FROM {nbrs} n JOIN {ratings} t ON n.nbr = t.item_id GROUP BY t.user_id, n.id)"""
    return f"""{name} AS (
  SELECT n.id AS user_id, t.item_id, round(sum(n.sim * t.{value}), 9) AS score FROM {nbrs} n JOIN {ratings} t ON n.nbr = t.user_id GROUP BY n.id, t.item_id)"""


def lists_sql(scores: str, seen: str | None, k: int, name: str = "recs", by: str = "") -> str:
    anti = f"WHERE NOT EXISTS (SELECT 1 FROM {seen} t WHERE t.user_id = s.user_id AND t.item_id = s.item_id)" if seen else ""
    return f"""{name} AS (
  SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY {by} s.user_id ORDER BY s.score DESC, s.item_id) AS rank FROM {scores} s {anti}) WHERE rank <= {k})"""


def map_sql(recs: str, truth: str, k: int = 10, by: str = "", name: str = "maps") -> str:
    """Average precision at every position up to k, averaged over users with a list and a true item."""
    b = f"{by}, " if by else ""
    rb = ", ".join(f"r.{c.strip()}" for c in by.split(",")) + ", " if by else ""
    return f"""{name}_hits AS (
  SELECT {rb} r.user_id, r.rank, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS hit
  FROM {recs} r LEFT JOIN (SELECT DISTINCT user_id, item_id FROM {truth}) t ON r.user_id = t.user_id AND r.item_id = t.item_id
  WHERE r.rank <= {k} AND r.user_id IN (SELECT user_id FROM {truth})),
{name}_users AS (
  SELECT {b} user_id, avg(c / rank) AS ap FROM (
    SELECT {b} user_id, rank, CAST(sum(hit) OVER (PARTITION BY {b} user_id ORDER BY rank) AS DOUBLE) AS c FROM {name}_hits)
  GROUP BY {b} user_id),
{name} AS (
  SELECT {b} round(avg(ap), 6) AS map, round(1.96 * stddev_pop(ap) / sqrt(count(*)), 6) AS ci95, count(*) AS n FROM {name}_users {'GROUP BY ' + by if by else ''})"""


def literal_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words))
