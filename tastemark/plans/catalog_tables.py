"""Queries for sources, filters, joins, aggregates, windows, set operations and scalar functions."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemark.functions import scalars, textual
from tastemark.lookups import ORIGINS
from tastemark.operators import aggregates, clean, experiments, matrix, ranking, recommend, split
from tastemark.plans import fixtures
from tastemark.plans.registry import BUSINESS, CATEGORIES, CELLS, REVIEWS, SPLIT, query
from tastemark.session import cut, shared_folder
from tastemark.sources import readers, writers


def _folder(spark) -> str:
    return os.path.join(shared_folder(spark), f"files-{uuid.uuid4().hex}")


# --- sources and sinks ------------------------------------------------------------------------------------------------

@query("SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS business_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS chars FROM documents")
def scan_json_lines(spark, sf):
    docs = fixtures.documents(spark, sf)
    path = _folder(spark)
    writers.write_json(docs.select(F.col("review_id").cast("string").alias("review_id"), F.col("item").alias("business_id"), "text"), path)
    df = readers.read_reviews(spark, path)
    return df.select("review_id", "business_id", F.md5("review_text").alias("text_md5"), F.length("review_text").cast("long").alias("chars"))


@query("SELECT n_nationkey AS nation, count(*) AS records, CAST(sum(s_suppkey) AS BIGINT) AS keys, min(s_name) AS first_name FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def scan_json_array(spark, sf):
    """One file with a JSON array per nation, written and read back."""
    suppliers = fixtures.table(spark, sf, "supplier")
    record = F.to_json(F.struct("s_suppkey", "s_name", "s_nationkey"))
    arrays = suppliers.groupBy("s_nationkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ",\n"), F.lit("]")).alias("value"))
    path = _folder(spark)
    arrays.write.partitionBy("s_nationkey").text(path)
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()), T.StructField("s_nationkey", T.LongType())])
    df = readers.json_array(spark, os.path.join(path, "*"), schema)
    return df.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("records"), F.sum("s_suppkey").alias("keys"), F.min("s_name").alias("first_name"))


@query("SELECT doc_id AS review_id, md5(text) AS text_md5 FROM documents")
def scan_csv_columns(spark, sf):
    path = _folder(spark)
    writers.write_csv(fixtures.documents(spark, sf), path)
    schema = T.StructType([T.StructField("review_id", T.LongType()), T.StructField("item", T.StringType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
    return readers.csv(spark, path, schema, ["review_id", "text"], multi_line=True).select("review_id", F.md5("text").alias("text_md5"))


@query(f"WITH {CELLS} SELECT user_id AS row, item_id AS col, value FROM cells")
def matrix_save_and_load(spark, sf):
    path = _folder(spark)
    c = fixtures.cells(spark, sf)
    writers.write_matrix(c.select(F.col("user_id").alias("row"), F.col("item_id").alias("col"), "value"), path)
    return readers.read_matrix(spark, path)


@query("SELECT name AS raw, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS num_id FROM (SELECT DISTINCT s_name AS name FROM supplier)")
def lookup_save_and_load(spark, sf):
    path = _folder(spark)
    writers.write_lookup(ranking.dense_ids(fixtures.business(spark, sf).select(F.col("name").alias("raw")), "raw", "num_id"), path)
    return readers.read_lookup(spark, path)


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS idx, count(*) OVER () AS n FROM lineitem)
SELECT CAST(least(idx // (n // 10), 10) AS INT) AS slice, count(*) AS rows, min(l_orderkey) AS first_order, max(l_orderkey) AS last_order FROM t GROUP BY 1""")
def equal_slices(spark, sf):
    lines = fixtures.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    sliced = writers.with_slice(lines, ["l_orderkey", "l_linenumber"], 10)
    return sliced.groupBy("slice").agg(F.count(F.lit(1)).alias("rows"), F.min("l_orderkey").alias("first_order"), F.max("l_orderkey").alias("last_order"))


@query(f"""WITH {SPLIT}, {BUSINESS}, {CATEGORIES}
SELECT 'ratings' AS name, count(*) AS rows FROM train UNION ALL SELECT 'items', count(*) FROM business UNION ALL SELECT 'item_category', count(*) FROM item_categories""")
def run_bundle(spark, sf):
    folder = _folder(spark)
    tables = {
        "ratings": split.train_part(split.by_user_time(fixtures.cells(spark, sf))),
        "items": fixtures.business(spark, sf),
        "item_category": fixtures.item_categories(spark, sf),
    }
    writers.write_run(tables, folder)
    out = None
    for name in tables:
        one = spark.read.parquet(os.path.join(folder, name)).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


# --- filters ----------------------------------------------------------------------------------------------------------

@query(f"WITH {BUSINESS} SELECT item_id, name FROM business WHERE is_open = 1")
def filter_open_only(spark, sf):
    return clean.open_only(fixtures.business(spark, sf)).select("item_id", "name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1998-01-01'")
def filter_after_date(spark, sf):
    orders = fixtures.table(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate"))
    return clean.after(orders, "date", "1998-01-01").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1996-01-01' AND CAST(o_orderdate AS DATE) < DATE '1997-06-01'")
def filter_date_window(spark, sf):
    orders = fixtures.table(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate"))
    return clean.between(orders, "date", "1996-01-01", "1997-06-01").select("o_orderkey", "o_custkey")


@query(f"WITH {BUSINESS} SELECT item_id, city, state FROM business WHERE state = 'ASIA'")
def filter_location(spark, sf):
    return clean.located(fixtures.business(spark, sf), "state", "ASIA").select("item_id", "city", "state")


@query(f"WITH {BUSINESS} SELECT item_id, price FROM business WHERE price IS NOT NULL")
def filter_complete_rows(spark, sf):
    return clean.complete(fixtures.business(spark, sf), ["price", "name"]).select("item_id", "price")


def _catalogue(spark, sf):
    """Parts as a city catalogue: name words are the categories, the brand is the alias."""
    return fixtures.table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("categories"), F.lower("p_brand").alias("alias"),
        F.when(F.col("p_size") % 7 == 0, None).otherwise(F.repeat(F.lit("$"), (1 + F.col("p_size") % 4).cast("int"))).alias("price"),
        F.col("p_size").alias("review_count"),
    )


_CATALOGUE = """catalogue AS (SELECT p_partkey AS item_id, p_name AS categories, lower(p_brand) AS alias,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE repeat('$', CAST(1 + p_size % 4 AS INT)) END AS price, p_size AS review_count FROM part)"""


@query(f"WITH {_CATALOGUE} SELECT item_id, categories FROM catalogue WHERE regexp_matches(categories, 'Ring|Bolt|GEAR', 'i')")
def filter_category_include(spark, sf):
    return _catalogue(spark, sf).where(clean.matches("categories", "Ring|Bolt|GEAR")).select("item_id", "categories")


@query(f"WITH {_CATALOGUE} SELECT item_id, categories FROM catalogue WHERE NOT regexp_matches(categories, 'Small|HOT', 'i')")
def filter_category_exclude(spark, sf):
    return _catalogue(spark, sf).where(~clean.matches("categories", "Small|HOT")).select("item_id", "categories")


@query(f"""WITH {_CATALOGUE}, matched AS (SELECT * FROM catalogue WHERE regexp_matches(categories, 'ring|bolt|gear|caterer|red', 'i')),
kept AS (SELECT * FROM matched WHERE NOT regexp_matches(categories, 'small', 'i')
  AND NOT (price IS NULL AND regexp_matches(categories, 'cater', 'i'))
  AND NOT (review_count <= 6 AND regexp_matches(categories, 'fooddeliveryservices', 'i')) AND NOT regexp_matches(alias, 'brand#1', 'i'))
SELECT item_id, alias, categories FROM kept UNION ALL SELECT item_id, alias, categories FROM matched WHERE regexp_matches(alias, 'brand#12|brand#2$', 'i')""")
def select_restaurants(spark, sf):
    df = clean.select_restaurants(_catalogue(spark, sf), "ring|bolt|gear|caterer|red", "small", "brand#1", "brand#12|brand#2$")
    return df.select("item_id", "alias", "categories")


@query(f"""WITH {_CATALOGUE} SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(categories, '\\w+')) AS token FROM catalogue
WHERE NOT regexp_matches(categories, 'ring|bolt', 'i') AND NOT regexp_matches(categories, 'small|hot', 'i')) WHERE token NOT IN ('alias', 'title')""")
def missed_row_tokens(spark, sf):
    return clean.distinct_tokens(clean.missed_rows(_catalogue(spark, sf), "categories", "ring|bolt", "small|hot"), "categories")


@query("SELECT p_partkey AS item_id, CAST(p_size AS VARCHAR) AS meal FROM part WHERE p_size % 3 = 0")
def filter_has_attribute(spark, sf):
    part = fixtures.table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("GoodForMeal"), F.col("p_size").cast("string"), F.lit("WiFi"), F.lit("no")))
        .otherwise(F.create_map(F.lit("WiFi"), F.lit("yes"))).alias("attributes"),
    )
    return clean.has_attribute(part).select("item_id", F.col("attributes")["GoodForMeal"].alias("meal"))


@query(f"WITH {REVIEWS} SELECT o_orderkey, l_linenumber, user_id FROM reviews WHERE user_id IN (SELECT user_id FROM reviews GROUP BY user_id HAVING count(*) > 40)")
def filter_active_users(spark, sf):
    return clean.active_users(fixtures.reviews(spark, sf), 40).select("o_orderkey", "l_linenumber", "user_id")


@query(f"""WITH {REVIEWS}, liked AS (SELECT * FROM reviews WHERE stars > 3),
u AS (SELECT user_id FROM liked GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 300), i AS (SELECT item_id FROM liked GROUP BY item_id ORDER BY count(*) DESC, item_id LIMIT 50)
SELECT o_orderkey, l_linenumber, user_id, item_id FROM reviews WHERE user_id IN (SELECT user_id FROM u) AND item_id IN (SELECT item_id FROM i)""")
def density_sample(spark, sf):
    return experiments.density_sample(fixtures.reviews(spark, sf), 300, 50).select("o_orderkey", "l_linenumber", "user_id", "item_id")


@query(f"WITH {_CATALOGUE} SELECT DISTINCT item_id FROM catalogue WHERE regexp_matches(categories, 'ring|bolt', 'i') OR categories IN ('red gear')")
def unwanted_items(spark, sf):
    return recommend.unwanted_items(_catalogue(spark, sf), "ring|bolt", ["red gear"])


@query(f"WITH {BUSINESS} SELECT item_id, name, stars FROM business WHERE name IN ('Supplier#000000003', 'Supplier#000000007')")
def filter_named(spark, sf):
    return clean.named(fixtures.business(spark, sf), ["Supplier#000000003", "Supplier#000000007"], ["item_id", "name", "stars"])


@query("""SELECT p_partkey AS item_id, CAST(p_size AS DOUBLE) AS latitude, CAST(p_retailprice AS DOUBLE) AS longitude FROM part WHERE p_size % 5 <> 0""")
def parse_coordinates(spark, sf):
    """Printed coordinate dicts, some with None, back to numbers; rows without coordinates drop out."""
    raw = fixtures.table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.concat(F.lit("{'latitude': "), F.when(F.col("p_size") % 5 == 0, F.lit("None")).otherwise(F.col("p_size").cast("string")),
                 F.lit(", 'longitude': "), F.col("p_retailprice").cast("string"), F.lit("}")).alias("coordinates"),
        F.lit("[]").alias("categories"),
    )
    return clean.parse_business(raw).select("item_id", "latitude", "longitude")


# --- joins ------------------------------------------------------------------------------------------------------------

@query(f"""WITH {REVIEWS}, {BUSINESS} SELECT o_orderkey, l_linenumber, r.item_id, r.stars AS review_stars, b.name, b.stars AS business_stars
FROM reviews r JOIN business b ON r.item_id = b.item_id WHERE b.is_open = 1""")
def join_review_business(spark, sf):
    reviews = fixtures.reviews(spark, sf).select("o_orderkey", "l_linenumber", "item_id", F.col("stars").alias("review_stars"))
    b = clean.open_only(fixtures.business(spark, sf)).select("item_id", "name", F.col("stars").alias("business_stars"))
    return clean.join_reviews(reviews, b, "item_id")


@query(f"""WITH {REVIEWS}, {BUSINESS} SELECT o_orderkey, l_linenumber, r.item_id, r.stars, b.stars AS business_stars
FROM reviews r JOIN business b ON r.item_id = b.item_id""")
def join_with_clashing_names(spark, sf):
    reviews = fixtures.reviews(spark, sf).select("o_orderkey", "l_linenumber", "item_id", "stars")
    return clean.join_reviews(reviews, fixtures.business(spark, sf).select("item_id", "stars"), "item_id")


_USERS = "users AS (SELECT user_id, avg(CAST(stars AS DOUBLE)) AS average_stars FROM reviews GROUP BY user_id)"


def _users(reviews):
    return reviews.groupBy("user_id").agg(F.avg(F.col("stars").cast("double")).alias("average_stars"))


@query(f"""WITH {REVIEWS}, {_USERS} SELECT o_orderkey, l_linenumber, r.user_id, round(average_stars, 6) AS user_avg_stars
FROM reviews r JOIN users u ON r.user_id = u.user_id""")
def join_user_average(spark, sf):
    reviews = fixtures.reviews(spark, sf)
    joined = clean.join_user_average(reviews, _users(reviews))
    return joined.select("o_orderkey", "l_linenumber", "user_id", F.round("user_avg_stars", 6).alias("user_avg_stars"))


@query(f"""WITH {REVIEWS}, {_USERS}, {BUSINESS} SELECT o_orderkey, l_linenumber,
round(CASE WHEN r.stars - u.average_stars = 0 THEN 0.01 ELSE r.stars - u.average_stars END, 6) AS dev_user,
round(CASE WHEN r.stars - b.stars = 0 THEN 0.01 ELSE r.stars - b.stars END, 6) AS dev_business
FROM reviews r JOIN users u ON r.user_id = u.user_id JOIN business b ON r.item_id = b.item_id""")
def deviation_columns(spark, sf):
    reviews = fixtures.reviews(spark, sf)
    b = fixtures.business(spark, sf).select("item_id", F.col("stars").alias("business_stars"))
    joined = clean.join_user_average(reviews.withColumnRenamed("stars", "review_stars"), _users(reviews)).join(b, "item_id")
    d = clean.with_deviations(joined)
    return d.select("o_orderkey", "l_linenumber", F.round("dev_user", 6).alias("dev_user"), F.round("dev_business", 6).alias("dev_business"))


@query(f"""WITH {SPLIT} SELECT o_orderkey, l_linenumber, user_id, item_id FROM reviews r
WHERE EXISTS (SELECT 1 FROM train t WHERE t.user_id = r.user_id AND t.item_id = r.item_id)""")
def train_corpus_rows(spark, sf):
    reviews = fixtures.reviews(spark, sf)
    train = split.train_part(split.by_user_time(fixtures.cells(spark, sf)))
    return split.corpus_rows(reviews, train).select("o_orderkey", "l_linenumber", "user_id", "item_id")


_KM = """distances AS (SELECT o.origin, b.item_id,
  round(CAST(12742.0176 AS DOUBLE) * asin(least(1.0, sqrt(pow(sin(radians(b.lat - o.olat) / 2), 2) + cos(radians(o.olat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - o.olon) / 2), 2)))), 1) AS km
  FROM business b, (VALUES {}) AS o(origin, olat, olon))""".format(
    ", ".join(f"('{n}', CAST({a} AS DOUBLE), CAST({o} AS DOUBLE))" for n, a, o in ORIGINS)
)


@query(f"WITH {BUSINESS}, {_KM} SELECT origin, item_id, km FROM distances")
def origin_distances(spark, sf):
    return recommend.item_distances(fixtures.business(spark, sf), ellipsoid=False)


# latitudes reduced to the auxiliary sphere, the central angle on it, then the flattening correction
_ELLIPSOID = """reduced AS (SELECT o.origin, b.item_id, atan((1 - {f}) * tan(radians(o.olat))) AS b1, atan((1 - {f}) * tan(radians(b.lat))) AS b2, radians(b.lon - o.olon) AS dl
  FROM business b, (VALUES {o}) AS o(origin, olat, olon)),
angled AS (SELECT *, 2 * asin(least(1.0, sqrt(pow(sin((b2 - b1) / 2), 2) + cos(b1) * cos(b2) * pow(sin(dl / 2), 2)))) AS s FROM reduced),
terms AS (SELECT *, (s - sin(s)) * pow(sin((b1 + b2) / 2) * cos((b2 - b1) / 2), 2) / pow(cos(s / 2), 2) AS x,
  (s + sin(s)) * pow(cos((b1 + b2) / 2) * sin((b2 - b1) / 2), 2) / pow(sin(s / 2), 2) AS y FROM angled)
SELECT origin, item_id, CASE WHEN s = 0 THEN 0 ELSE round(CAST(6378.137 AS DOUBLE) * (s - {f} / 2 * (x + y)), 1) END AS km FROM terms""".format(
    f="(CAST(1 AS DOUBLE) / CAST(298.257223563 AS DOUBLE))", o=", ".join(f"('{n}', CAST({a} AS DOUBLE), CAST({o} AS DOUBLE))" for n, a, o in ORIGINS)
)


@query(f"WITH {BUSINESS}, {_ELLIPSOID}")
def origin_distances_ellipsoid(spark, sf):
    return recommend.item_distances(fixtures.business(spark, sf))


@query(f"WITH {BUSINESS} SELECT DISTINCT b.item_id FROM business b WHERE b.name IN (SELECT s_name FROM supplier WHERE s_acctbal > 5000)")
def ids_of_selected_names(spark, sf):
    chosen = fixtures.table(spark, sf, "supplier").where(F.col("s_acctbal") > 5000).select(F.col("s_name").alias("name"))
    return clean.item_ids_of_names(fixtures.business(spark, sf), chosen)


@query("""WITH ids AS (SELECT s_name AS name, CAST(row_number() OVER (ORDER BY s_name DESC) AS BIGINT) AS x FROM supplier)
SELECT s_suppkey AS item_id, s.s_name AS name, (SELECT count(*) FROM supplier t WHERE t.s_name < s.s_name) AS business_num_id FROM supplier s""")
def business_with_num_id(spark, sf):
    b = fixtures.business(spark, sf).select("item_id", "name")
    return ranking.with_dense_id(b, "name", "business_num_id").select("item_id", "name", "business_num_id")


# --- aggregates -------------------------------------------------------------------------------------------------------

@query(f"WITH {REVIEWS} SELECT stars, count(*) AS count FROM reviews GROUP BY stars")
def star_frequencies(spark, sf):
    return aggregates.frequency(fixtures.reviews(spark, sf), "stars")


@query(f"WITH {REVIEWS} SELECT user_id, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, user_id) AS rank FROM reviews GROUP BY user_id QUALIFY rank <= 25")
def busiest_users(spark, sf):
    return aggregates.most_frequent(fixtures.reviews(spark, sf), "user_id", 25)


@query(f"WITH {REVIEWS} SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT item_id) AS item_id, count(DISTINCT date) AS date FROM reviews")
def distinct_counts(spark, sf):
    return aggregates.distinct_counts(fixtures.reviews(spark, sf), ["user_id", "item_id", "date"])


@query(f"""WITH {REVIEWS}, c AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS v FROM reviews GROUP BY item_id), b AS (SELECT min(v) AS lo, max(v) AS hi FROM c),
h AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / 70)), 69) AS INT) AS bin, count(*) AS keys FROM c, b GROUP BY 1)
SELECT bin, round(lo + bin * ((hi - lo) / 70), 6) AS lo, round(lo + (bin + 1) * ((hi - lo) / 70), 6) AS hi, keys FROM h, b""")
def item_count_histogram(spark, sf):
    h = aggregates.count_histogram(fixtures.reviews(spark, sf), "item_id", 70)
    return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "keys")


@query(f"""WITH {REVIEWS}, c AS (SELECT user_id, ln(count(*)) AS v FROM reviews GROUP BY user_id), b AS (SELECT min(v) AS lo, max(v) AS hi FROM c)
SELECT CAST(least(floor((v - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS keys FROM c, b GROUP BY 1""")
def user_log_count_histogram(spark, sf):
    return aggregates.count_histogram(fixtures.reviews(spark, sf), "user_id", 20, log=True).select("bin", "keys")


@query(f"WITH {REVIEWS} SELECT count, count(*) AS keys FROM (SELECT item_id, count(*) AS count FROM reviews GROUP BY item_id) GROUP BY count")
def count_of_counts(spark, sf):
    return aggregates.count_of_counts(fixtures.reviews(spark, sf), "item_id")


_PIVOT = ", ".join(f'round(coalesce(avg(CASE WHEN item_id = {i} THEN CAST(stars AS DOUBLE) END), 0), 6) AS "{i}"' for i in range(1, 6))


@query(f"WITH {REVIEWS} SELECT user_id, {_PIVOT} FROM reviews GROUP BY user_id")
def utility_pivot(spark, sf):
    wide = aggregates.utility_matrix(fixtures.reviews(spark, sf), [1, 2, 3, 4, 5])
    return wide.select("user_id", *[F.round(str(i), 6).alias(str(i)) for i in range(1, 6)])


@query(f"WITH {REVIEWS} SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(x) AS size FROM (SELECT CAST(stars > 3 AS INT) AS x FROM reviews)")
def target_moments(spark, sf):
    m = aggregates.moments(fixtures.reviews(spark, sf), scalars.liked(F.col("stars")))
    return m.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "size")


@query("""SELECT count(w) AS count, round(avg(w), 6) AS mean, round(stddev_samp(w), 6) AS std, CAST(min(w) AS INT) AS min, quantile_cont(w, 0.25) AS p25,
quantile_cont(w, 0.5) AS p50, quantile_cont(w, 0.75) AS p75, CAST(max(w) AS INT) AS max FROM (SELECT len(string_split(text, ' ')) AS w FROM documents)""")
def describe_word_count(spark, sf):
    d = aggregates.describe(fixtures.documents(spark, sf), textual.word_count(F.col("text")))
    return d.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query(f"WITH {CATEGORIES} SELECT category, count(DISTINCT item_id) AS items, row_number() OVER (ORDER BY count(DISTINCT item_id) DESC, category) AS rank FROM item_categories GROUP BY category QUALIFY rank <= 50")
def items_per_category(spark, sf):
    return recommend.category_sizes(fixtures.item_categories(spark, sf))


@query(f"""WITH {CATEGORIES}, {BUSINESS}, {_KM}, near AS (SELECT DISTINCT item_id FROM distances WHERE km <= 2.0)
SELECT category, count(DISTINCT item_id) AS items, row_number() OVER (ORDER BY count(DISTINCT item_id) DESC, category) AS rank
FROM item_categories WHERE item_id IN (SELECT item_id FROM near) GROUP BY category QUALIFY rank <= 50""")
def items_per_category_near(spark, sf):
    km = recommend.item_distances(fixtures.business(spark, sf), ellipsoid=False)
    return recommend.category_sizes_near(fixtures.item_categories(spark, sf), km, 2.0)


@query("SELECT key, count(*) AS count FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def attribute_key_counts(spark, sf):
    events = fixtures.table(spark, sf, "events").select(F.from_json("props", "map<string,string>").alias("attributes"))
    return aggregates.attribute_keys(events)


@query("SELECT word, count(*) AS count FROM (SELECT trim(unnest(string_split(p_name || ', ' || p_type, ' ')), ',.&') AS word FROM part) WHERE word <> '' GROUP BY word")
def category_word_counts(spark, sf):
    part = fixtures.table(spark, sf, "part").select(F.concat_ws(", ", "p_name", "p_type").alias("categories"))
    return aggregates.category_words(part)


@query(f"WITH {BUSINESS} SELECT DISTINCT city FROM business WHERE city IS NOT NULL")
def distinct_cities(spark, sf):
    return aggregates.distinct_values(fixtures.business(spark, sf), "city")


@query(f"""WITH {CELLS}, m AS (SELECT user_id, avg(value) AS mean FROM cells GROUP BY user_id)
SELECT c.user_id, c.item_id, round(value - mean + 0.001, 6) AS value FROM cells c JOIN m ON c.user_id = m.user_id""")
def user_mean_centring(spark, sf):
    return matrix.centre(fixtures.cells(spark, sf)).select("user_id", "item_id", F.round("value", 6).alias("value"))


@query(f"WITH {REVIEWS} SELECT user_id, item_id, sum(CAST(stars AS DOUBLE)) AS value, CAST(sum(ts) AS BIGINT) AS ts_sum, max(ts) AS ts FROM reviews GROUP BY user_id, item_id")
def rating_and_time_matrices(spark, sf):
    return matrix.rating_matrices(fixtures.reviews(spark, sf))


@query(f"""WITH {REVIEWS} SELECT user_id AS row, item_id AS col, value, ts FROM (
SELECT user_id, item_id, CAST(stars AS DOUBLE) AS value, ts, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, stars DESC) AS r FROM reviews) WHERE r = 1""")
def latest_rating_matrix(spark, sf):
    return matrix.coo(fixtures.reviews(spark, sf), "user_id", "item_id", F.col("stars"), dedupe="latest", ts="ts")


@query(f"WITH {REVIEWS} SELECT user_id, item_id, any_value(stars) AS stars FROM reviews GROUP BY user_id, item_id HAVING count(*) = 1")
def drop_repeated_keys(spark, sf):
    return ranking.keep_unrepeated(fixtures.reviews(spark, sf).select("user_id", "item_id", "stars"), ["user_id", "item_id"])


@query(f"""WITH {REVIEWS} SELECT user_id, item_id, date, stars FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, o_orderkey, l_linenumber, item_id, stars) AS r FROM reviews) WHERE r = 1""")
def newest_review_per_user(spark, sf):
    order = [F.col("date").desc(), *[F.col(c) for c in ("o_orderkey", "l_linenumber", "item_id", "stars")]]
    return ranking.keep_first(fixtures.reviews(spark, sf), ["user_id"], order).select("user_id", "item_id", "date", "stars")


@query(f"WITH {REVIEWS}, c AS (SELECT user_id, count(*) AS n FROM reviews GROUP BY user_id HAVING count(*) > 40) SELECT count(*) AS keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM c")
def threshold_summary(spark, sf):
    return aggregates.threshold_summary(fixtures.reviews(spark, sf), "user_id", 40)


@query(f"WITH {CELLS} SELECT item_id, count(*) AS rated, count(*) FILTER (WHERE value >= 4) AS liked FROM cells GROUP BY item_id")
def raters_and_likers(spark, sf):
    return recommend.rater_counts(fixtures.cells(spark, sf))


# --- windows and splits -----------------------------------------------------------------------------------------------

@query(f"WITH {REVIEWS} SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS BIGINT) AS user_num_id FROM (SELECT DISTINCT user_id FROM reviews)")
def dense_user_ids(spark, sf):
    return ranking.dense_ids(fixtures.table(spark, sf, "orders").join(
        fixtures.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi"
    ).select(F.col("o_custkey").alias("user_id")), "user_id", "user_num_id")


@query(f"WITH {SPLIT} SELECT user_id, item_id, value, ts, split FROM split")
def split_by_user_time(spark, sf):
    return split.by_user_time(fixtures.cells(spark, sf))


@query(f"WITH {SPLIT} SELECT split, count(*) AS cells, count(DISTINCT user_id) AS users, sum(value) AS total FROM split GROUP BY split")
def split_sizes(spark, sf):
    parts = split.by_user_time(fixtures.cells(spark, sf))
    return parts.groupBy("split").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("user_id").alias("users"), F.sum("value").alias("total"))


_IMPLICIT = CELLS.replace("GROUP BY user_id, item_id)", "GROUP BY user_id, item_id HAVING sum(CAST(stars AS DOUBLE)) > 3)")


@query(f"""WITH {_IMPLICIT}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM cells)
SELECT user_id, item_id, CAST(1.0 AS DOUBLE) AS value, CASE WHEN pos > n - floor(n * CAST(0.3 AS DOUBLE)) THEN 'test' WHEN pos > n - floor(n * CAST(0.5 AS DOUBLE)) THEN 'valid' ELSE 'train' END AS split FROM ranked""")
def split_implicit(spark, sf):
    return split.by_user_time(fixtures.cells(spark, sf), implicit=True).select("user_id", "item_id", "value", "split")


def _sampled(side: str) -> str:
    inside = "pos > t - floor(t * CAST(0.4 AS DOUBLE)) AND pos <= t" if side == "newest" else "pos <= floor(t * CAST(0.4 AS DOUBLE))"
    return f"WITH {SPLIT}, s AS (SELECT *, n - floor(n * CAST(0.5 AS DOUBLE)) AS t FROM ranked) SELECT user_id, item_id FROM s WHERE {inside}"


@query(_sampled("newest"))
def train_sample_newest(spark, sf):
    return split.train_part(split.by_user_time(fixtures.cells(spark, sf), train_share=0.4)).select("user_id", "item_id")


@query(_sampled("oldest"))
def train_sample_oldest(spark, sf):
    return split.train_part(split.by_user_time(fixtures.cells(spark, sf), train_share=0.4, side="oldest")).select("user_id", "item_id")


@query(f"""WITH {SPLIT}, m AS (SELECT user_id, avg(value) AS mean FROM cells GROUP BY user_id)
SELECT s.user_id, item_id, split, CASE WHEN split = 'valid' THEN CAST(value >= 4 AS DOUBLE) ELSE value END AS value,
round(CASE WHEN split IN ('valid', 'test') THEN CAST(value - mean + 0.001 > 0 AS DOUBLE) ELSE value - mean + 0.001 END, 6) AS centred
FROM split s JOIN m ON s.user_id = m.user_id""")
def split_with_binary_holdout(spark, sf):
    cells = fixtures.cells(spark, sf)
    with_centre = matrix.centre(cells.withColumn("centred", F.col("value")), value="centred")
    out = split.binarise_holdout(split.by_user_time(with_centre), centred="centred")
    return out.select("user_id", "item_id", "split", "value", F.round("centred", 6).alias("centred"))


@query(f"WITH {SPLIT} SELECT user_id, item_id, value FROM split WHERE split IN ('train', 'valid')")
def final_train_part(spark, sf):
    return split.train_part(split.by_user_time(fixtures.cells(spark, sf)), final=True).select("user_id", "item_id", "value")


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN idx < ceil(CAST(0.8 AS DOUBLE) * n) THEN 'train' ELSE 'test' END AS split FROM o""")
def split_by_global_time(spark, sf):
    orders = fixtures.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return split.by_global_time(orders, ["date", "o_orderkey"]).select("o_orderkey", "split")


@query("""SELECT CASE WHEN CAST('0x' || substr(md5('66/' || doc_id), 1, 7) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS split, count(*) AS rows FROM documents GROUP BY 1""")
def split_by_hash(spark, sf):
    return split.by_hash(fixtures.documents(spark, sf).select("review_id"), "review_id").groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


# --- popularity, set operations, one-hot ----------------------------------------------------------------------------

@query("SELECT l_suppkey AS item_id, count(*) AS review_count, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS rank FROM lineitem GROUP BY l_suppkey QUALIFY rank <= 50")
def popular_by_count(spark, sf):
    counts = fixtures.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("item_id")).agg(F.count(F.lit(1)).alias("review_count"))
    return recommend.popular_by_count(counts)


@query(f"""WITH {CELLS}, {BUSINESS}, r AS (SELECT item_id, count(*) AS rated, count(*) FILTER (WHERE value >= 4) AS liked FROM cells GROUP BY item_id HAVING count(*) > 50)
SELECT b.item_id, b.stars, rated, liked, row_number() OVER (ORDER BY b.stars DESC, b.item_id) AS rank FROM business b JOIN r ON b.item_id = r.item_id QUALIFY rank <= 50""")
def popular_by_stars(spark, sf):
    return recommend.popular_by_stars(fixtures.business(spark, sf), fixtures.cells(spark, sf), 50)


def _liked(direction: str) -> str:
    return f"""WITH {CELLS}, r AS (SELECT item_id, count(*) AS rated, count(*) FILTER (WHERE value >= 4) AS liked FROM cells GROUP BY item_id)
SELECT item_id, rated, liked, round(CASE WHEN rated > 450 THEN liked / rated ELSE 0 END, 6) AS share,
row_number() OVER (ORDER BY CASE WHEN rated > 450 THEN liked / rated ELSE 0 END {direction}, item_id) AS rank FROM r QUALIFY rank <= 50"""


@query(_liked("DESC"))
def popular_by_liked(spark, sf):
    return recommend.popular_by_liked(fixtures.cells(spark, sf), 450).withColumn("share", F.round("share", 6))


@query(_liked("ASC"))
def least_liked(spark, sf):
    return recommend.popular_by_liked(fixtures.cells(spark, sf), 450, ascending=True).withColumn("share", F.round("share", 6))


@query(f"""WITH {CELLS}, top AS (SELECT l_suppkey AS item_id, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS rank FROM lineitem GROUP BY l_suppkey QUALIFY rank <= 10)
SELECT user_id, rank, item_id FROM (SELECT DISTINCT user_id FROM cells), top""")
def same_list_for_all(spark, sf):
    counts = fixtures.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("item_id")).agg(F.count(F.lit(1)).alias("review_count"))
    return recommend.same_for_all(fixtures.cells(spark, sf), recommend.popular_by_count(counts, k=10), 10)


@query(f"WITH {SPLIT} SELECT user_id, item_id, sum(value) AS value FROM (SELECT user_id, item_id, value FROM train UNION ALL SELECT user_id, item_id, value FROM split WHERE split <> 'train') GROUP BY user_id, item_id")
def add_split_parts(spark, sf):
    parts = cut(split.by_user_time(fixtures.cells(spark, sf)).select("user_id", "item_id", "value", "split"))
    return matrix.add(*[parts.where(F.col("split") == s).drop("split") for s in ("train", "valid", "test")])


@query(f"WITH {CELLS} SELECT user_id, item_id, value FROM cells UNION ALL SELECT user_id + 1000000, item_id, CAST(5 AS DOUBLE) FROM cells WHERE user_id % 100 = 1")
def append_user_rows(spark, sf):
    c = fixtures.cells(spark, sf).select("user_id", "item_id", "value")
    new = c.where(F.col("user_id") % 100 == 1).select((F.col("user_id") + 1000000).alias("user_id"), "item_id", F.lit(5.0).alias("value"))
    return matrix.append_rows(c, new)


@query(f"WITH {SPLIT} SELECT user_id, item_id FROM valid UNION SELECT user_id, item_id FROM test")
def union_of_lists(spark, sf):
    parts = split.by_user_time(fixtures.cells(spark, sf))
    a, b = (parts.where(F.col("split") == s).select("user_id", "item_id") for s in ("valid", "test"))
    return a.union(b).distinct()


@query(f"""WITH {BUSINESS} SELECT item_id, CAST(CASE WHEN length(price) = 1 THEN 1 ELSE 0 END AS INT) AS price0, CAST(CASE WHEN length(price) = 2 THEN 1 ELSE 0 END AS INT) AS price1,
CAST(CASE WHEN length(price) = 3 THEN 1 ELSE 0 END AS INT) AS price2, CAST(CASE WHEN length(price) = 4 THEN 1 ELSE 0 END AS INT) AS price3 FROM business""")
def one_hot_price(spark, sf):
    return aggregates.one_hot(fixtures.business(spark, sf), "item_id", "price", ["$", "$$", "$$$", "$$$$"], "price")


# --- scalar functions -----------------------------------------------------------------------------------------------

@query("SELECT o_orderkey, (CAST(o_orderdate AS DATE) - DATE '1970-01-01') * CAST(86400 AS BIGINT) AS ts FROM orders")
def date_to_seconds(spark, sf):
    return fixtures.table(spark, sf, "orders").select("o_orderkey", scalars.epoch_seconds(F.col("o_orderdate")).alias("ts"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders")
def swapped_date_parts(spark, sf):
    d = F.to_date("o_orderdate")
    raw = fixtures.table(spark, sf, "orders").select("o_orderkey", F.year(d).alias("y"), F.day(d).alias("m"), F.month(d).alias("d"))
    return raw.select("o_orderkey", scalars.date_from_swapped(F.col("y"), F.col("m"), F.col("d")).cast("string").alias("date"))


@query("SELECT p_partkey AS item_id, p_type || ', ' || p_brand AS categories, p_name || ', ' || p_type AS address FROM part")
def parse_categories_and_address(spark, sf):
    def printed(*titles):
        return F.concat(F.lit("["), F.concat_ws(", ", *[F.concat(F.lit("{'alias': '"), F.lower(t), F.lit("', 'title': '"), t, F.lit("'}")) for t in titles]), F.lit("]"))

    part = fixtures.table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), printed(F.col("p_type"), F.col("p_brand")).alias("c"),
        F.concat(F.lit("{'display_address': ['"), "p_name", F.lit("', '"), "p_type", F.lit("'], 'zip': None}")).alias("a"),
    )
    return part.select("item_id", scalars.category_text(F.col("c")).alias("categories"), scalars.display_address(F.col("a")).alias("address"))


@query(f"""WITH {BUSINESS} SELECT item_id, CAST(length(price) AS INT) AS label, CASE length(price) WHEN 1 THEN 'inexpensive' WHEN 2 THEN 'moderately priced'
WHEN 3 THEN 'premium priced' WHEN 4 THEN 'fine dining' END AS words FROM business""")
def price_labels(spark, sf):
    label = scalars.price_label(F.col("price"))
    return fixtures.business(spark, sf).select("item_id", label.alias("label"), scalars.price_words(label).alias("words"))


@query("""SELECT doc_id AS review_id, CAST(len(string_split(text, ' ')) AS INT) AS words, round(ln(length(text) + 1), 6) AS log_chars FROM documents""")
def word_counts(spark, sf):
    docs = fixtures.documents(spark, sf)
    return docs.select("review_id", textual.word_count(F.col("text")).alias("words"), F.round(F.log(F.length("text") + 1), 6).alias("log_chars"))


@query("SELECT item_id, category FROM (SELECT p_partkey AS item_id, trim(unnest(string_split(p_type || ', ' || p_brand || ',' || p_name, ','))) AS category FROM part)")
def split_category_text(spark, sf):
    part = fixtures.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.concat("p_type", F.lit(", "), "p_brand", F.lit(","), "p_name").alias("c"))
    return part.select("item_id", F.explode(scalars.split_categories(F.col("c"))).alias("category"))


@query(f"WITH {CELLS} SELECT user_id, item_id, CAST(1 AS DOUBLE) AS value FROM cells WHERE value > 3")
def implicit_matrix(spark, sf):
    return matrix.above(fixtures.cells(spark, sf)).select("user_id", "item_id", "value")


@query(f"WITH {CELLS} SELECT user_id, item_id, CAST(1 AS DOUBLE) AS value FROM cells WHERE value >= 4")
def implicit_matrix_inclusive(spark, sf):
    return matrix.above(fixtures.cells(spark, sf), 4, inclusive=True).select("user_id", "item_id", "value")


@query(f"WITH {CELLS} SELECT user_id, item_id, CAST(1 AS DOUBLE) AS value FROM cells WHERE value > 0")
def visit_matrix(spark, sf):
    return matrix.visits(fixtures.cells(spark, sf)).select("user_id", "item_id", "value")


@query(f"WITH {BUSINESS} SELECT DISTINCT item_id, stars, CAST(length(price) AS INT) AS price FROM business")
def item_value_tables(spark, sf):
    """Distinct stars and price label of each item, the lookup tables of a critique."""
    return fixtures.business(spark, sf).select("item_id", "stars", scalars.price_label(F.col("price")).alias("price")).distinct()


@query("""WITH c AS (SELECT o_custkey AS user_id, l_suppkey AS item_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING count(*) > 1),
u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_num_id FROM (SELECT DISTINCT user_id FROM c)),
i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_num_id FROM (SELECT DISTINCT item_id FROM c))
SELECT user_num_id, item_num_id, user_id, item_id, CAST(n AS DOUBLE) AS value FROM c JOIN u USING (user_id) JOIN i USING (item_id)""")
def compact_ids_without_empty_rows(spark, sf):
    """Users and items with a cell left after a filter, renumbered; the original ids stay."""
    repeated = matrix.coo(fixtures.reviews(spark, sf), "user_id", "item_id").where(F.col("value") > 1)
    return matrix.remove_empty(repeated.select(F.col("row").alias("user_id"), F.col("col").alias("item_id"), "value"))


@query(f"""WITH {SPLIT}, seen AS (SELECT user_id, item_id FROM split WHERE split <> 'test')
SELECT user_id, item_id FROM test t WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = t.user_id AND s.item_id = t.item_id + 1)""")
def candidate_difference(spark, sf):
    """Candidates without the excluded ones."""
    parts = cut(split.by_user_time(fixtures.cells(spark, sf)).select("user_id", "item_id", "split"))
    excluded = parts.where(F.col("split") != "test").select("user_id", (F.col("item_id") - 1).alias("item_id"))
    return parts.where(F.col("split") == "test").drop("split").join(excluded, ["user_id", "item_id"], "left_anti")
