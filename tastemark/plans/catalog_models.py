"""Queries for feature matrices, similarities, neighbourhood models and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemark.lookups import LIST_LENGTH
from tastemark.operators import evaluate, experiments, knn, matrix, ranking, recommend, similarity, split
from tastemark.operators.scored_lists import user_lists
from tastemark.operators.similarity import Recipe, combine_recipe, neighbours
from tastemark.plans import fixtures, flagship
from tastemark.plans.catalog_tables import _KM
from tastemark.plans.registry import BUSINESS, CATEGORIES, CELLS, IMPLICIT, SPLIT, lists_sql, map_sql, query, score_sql, sims_sql, top_sql
from tastemark.session import cut


def _parts(spark, sf):
    """The split, written once for the branches that read it."""
    return cut(split.by_user_time(fixtures.cells(spark, sf)))


def _train(spark, sf):
    return cut(split.train_part(split.by_user_time(fixtures.cells(spark, sf))))


def _implicit_parts(spark, sf):
    """The split of the liked cells alone: filtered first, then split per user."""
    return cut(split.by_user_time(fixtures.cells(spark, sf), implicit=True))


def _part(parts, name):
    return parts.where(F.col("split") == name).drop("split")


def _sixth(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


# --- matrices ---------------------------------------------------------------------------------------------------------

_IC = """cat_ids AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS category_id FROM (SELECT DISTINCT category FROM item_categories)),
ic AS (SELECT item_id, category_id, CAST(count(*) AS DOUBLE) AS value FROM item_categories JOIN cat_ids USING (category) GROUP BY item_id, category_id)"""


def _ic(spark, sf):
    pairs = fixtures.item_categories(spark, sf)
    return matrix.item_category(pairs, ranking.dense_ids(pairs, "category", "category_id"))


@query(f"WITH {CATEGORIES}, {_IC} SELECT item_id, category_id, value FROM ic")
def item_category_matrix(spark, sf):
    return _ic(spark, sf)


_UC = "uc AS (SELECT t.user_id, category_id, sum(ic.value) AS value FROM itrain t JOIN ic ON t.item_id = ic.item_id GROUP BY t.user_id, category_id)"


def _uc(spark, sf, liked=None):
    """User-category cells of the implicit train part."""
    liked = _part(_implicit_parts(spark, sf), "train") if liked is None else liked
    return matrix.user_category(liked, _ic(spark, sf))


@query(f"WITH {SPLIT}, {IMPLICIT}, {CATEGORIES}, {_IC}, {_UC} SELECT user_id, category_id, value FROM uc")
def user_category_matrix(spark, sf):
    return _uc(spark, sf)


@query(f"WITH {SPLIT}, {IMPLICIT}, {CATEGORIES}, {_IC}, {_UC} SELECT user_id, category_id, CAST(1 AS DOUBLE) AS value FROM uc WHERE value > 3")
def user_category_implicit(spark, sf):
    return matrix.above(_uc(spark, sf))


def _brand_cells(spark, sf):
    """Item-by-brand counts, a second feature block of the items."""
    part = fixtures.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("col"))
    lines = fixtures.table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").alias("row"))
    return matrix.coo(lines.join(part, "l_partkey"), "row", "col")


_BRAND = "brand AS (SELECT l_suppkey AS row, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS col, CAST(count(*) AS DOUBLE) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def _blocks_sql(offset: int, ratio: float = 0.3) -> str:
    return f"""blocks AS (SELECT row, col, sum(value) AS value FROM (
  SELECT row, col, value * CAST({ratio} AS DOUBLE) AS value FROM brand UNION ALL
  SELECT item_id, user_id + {offset}, value * (1 - CAST({ratio} AS DOUBLE)) FROM train) GROUP BY row, col)"""


def _blocks(spark, sf, offset, train=None, ratio=0.3):
    train = _train(spark, sf) if train is None else train
    return matrix.concat_blocks(_brand_cells(spark, sf), knn.as_matrix(train, "item_id", "user_id"), ratio, offset)


@query(f"WITH {SPLIT}, {_BRAND}, {_blocks_sql(1000)} SELECT row, col, round(value, 6) AS value FROM blocks")
def block_matrix(spark, sf):
    return _sixth(_blocks(spark, sf, 1000), "value")


@query(f"WITH {SPLIT}, {_BRAND}, {_blocks_sql(0)} SELECT row, col, round(value, 6) AS value FROM blocks")
def block_matrix_shared_columns(spark, sf):
    return _sixth(_blocks(spark, sf, None), "value")


# --- similarities -----------------------------------------------------------------------------------------------------

_USER_SIMS = sims_sql("train", "user_id", "item_id")
_ITEM_SIMS = sims_sql("train", "item_id", "user_id")
_USER_KNN = f"{SPLIT}, {_USER_SIMS}, {top_sql('sims', 10)}"
_ITEM_KNN = f"{SPLIT}, {_ITEM_SIMS}, {top_sql('sims', 10)}"
_NBR_COLUMNS = "id, nbr, sim, rank"


@query(f"WITH {_USER_KNN} SELECT {_NBR_COLUMNS} FROM nbrs")
def user_neighbours(spark, sf):
    return neighbours(knn.as_matrix(_train(spark, sf)), 10)


@query(f"WITH {_ITEM_KNN} SELECT {_NBR_COLUMNS} FROM nbrs")
def item_neighbours(spark, sf):
    return neighbours(knn.as_matrix(_train(spark, sf), "item_id", "user_id"), 10)


@query(f"""WITH {CELLS.replace('l_suppkey', 'l_partkey')}, {sims_sql('cells', 'item_id', 'user_id')}, {top_sql('sims', 5)} SELECT {_NBR_COLUMNS} FROM nbrs""")
def part_neighbours(spark, sf):
    """The larger item space: parts that the same users rate."""
    return neighbours(knn.as_matrix(fixtures.cells(spark, sf, "l_partkey"), "item_id", "user_id"), 5)


@query(f"""WITH e AS (SELECT vec_id, u.i AS col, CAST(u.x AS DOUBLE) AS value FROM (SELECT vec_id, unnest(list_transform(embedding, lambda x, i: {{'x': x, 'i': i}})) AS u FROM embeddings)),
{sims_sql('e', 'vec_id', 'col')}, {top_sql('sims', 5)} SELECT {_NBR_COLUMNS} FROM nbrs""")
def embedding_neighbours(spark, sf):
    """Cosine neighbours of dense vectors, stored as cells like any other matrix."""
    e = fixtures.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "value"))
    return neighbours(e, 5)


@query(f"WITH {_USER_KNN}, {score_sql('nbrs', 'train')} SELECT user_id, item_id, score FROM scores")
def user_knn_scores(spark, sf):
    train = _train(spark, sf)
    return knn.score(neighbours(knn.as_matrix(train), 10), train)


@query(f"WITH {_ITEM_KNN}, {score_sql('nbrs', 'train', True)} SELECT user_id, item_id, score FROM scores")
def item_knn_scores(spark, sf):
    train = _train(spark, sf)
    return knn.score(neighbours(knn.as_matrix(train, "item_id", "user_id"), 10), train, item_based=True)


_LIST_COLUMNS = "user_id, item_id, rank, score"


@query(f"WITH {_USER_KNN}, {score_sql('nbrs', 'train')}, {lists_sql('scores', 'train', 50)} SELECT {_LIST_COLUMNS} FROM recs")
def user_knn_lists(spark, sf):
    return flagship.user_knn_lists(_train(spark, sf), 10, 50).select("user_id", "item_id", "rank", "score")


@query(f"""WITH {_USER_KNN}, {score_sql('nbrs', 'train')}, {lists_sql('scores', 'train', 10)}, {BUSINESS}
SELECT user_id, r.item_id, rank, score, name, city, stars, price FROM recs r LEFT JOIN business b ON r.item_id = b.item_id""")
def user_knn_cards(spark, sf):
    return flagship.user_knn_cards(spark, sf)


@query(f"WITH {_ITEM_KNN}, {score_sql('nbrs', 'train', True)}, {lists_sql('scores', 'train', 100000)} SELECT {_LIST_COLUMNS} FROM recs")
def item_knn_full_ranking(spark, sf):
    train = _train(spark, sf)
    scores = knn.score(neighbours(knn.as_matrix(train, "item_id", "user_id"), 10), train, item_based=True)
    return knn.full_ranking(scores, train).select("user_id", "item_id", "rank", "score")


@query(f"""WITH {_USER_KNN}, {score_sql('nbrs', 'train')}, {lists_sql('scores', 'train', 20)}
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS rank, score FROM recs r
WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.user_id = r.user_id AND v.item_id = r.item_id)""")
def lists_without_known_items(spark, sf):
    parts = _parts(spark, sf)
    lists = flagship.user_knn_lists(_part(parts, "train"), 10, 20)
    return knn.without_known(lists, _part(parts, "valid")).select("user_id", "item_id", "rank", "score")


@query(f"WITH {SPLIT}, {_ITEM_SIMS}, {top_sql('sims', 1)} SELECT id, nbr AS similar_id, sim FROM nbrs")
def most_similar_item(spark, sf):
    return similarity.second_best(neighbours(knn.as_matrix(_train(spark, sf), "item_id", "user_id"), 1))


@query(f"""WITH {SPLIT}, {BUSINESS}, {_ITEM_SIMS}, {top_sql('sims', 1)}
SELECT b.item_id, coalesce(b.price, d.price, '$') AS price FROM business b LEFT JOIN nbrs n ON b.item_id = n.id LEFT JOIN business d ON n.nbr = d.item_id""")
def impute_price(spark, sf):
    items = fixtures.business(spark, sf).select("item_id", "price")
    similar = similarity.second_best(neighbours(knn.as_matrix(_train(spark, sf), "item_id", "user_id"), 1))
    return similarity.impute_from_similar(items, similar, "price", "$")


# --- combinations -----------------------------------------------------------------------------------------------------

_TWO = f"""{SPLIT}, {IMPLICIT}, {CATEGORIES}, {_IC}, {_UC}, {sims_sql('train', 'user_id', 'item_id', 's1', digits=15)}, {sims_sql('uc', 'user_id', 'category_id', 's2', digits=15)},
pairs AS (SELECT id, nbr, coalesce(a.sim, 0) AS x1, coalesce(b.sim, 0) AS x2 FROM s1 a FULL JOIN s2 b USING (id, nbr))"""


def _combined_sql(expr: str, k: int = 10) -> str:
    return f"WITH {_TWO}, sims AS (SELECT id, nbr, round({expr}, 9) AS sim FROM pairs), {top_sql('sims', k)} SELECT {_NBR_COLUMNS} FROM nbrs"


def _two_sources(spark, sf, train, liked=None):
    uc = _uc(spark, sf, liked).select(F.col("user_id").alias("row"), F.col("category_id").alias("col"), "value")
    return [knn.as_matrix(train), uc]


def _combined(spark, sf, recipe):
    out = neighbours(_two_sources(spark, sf, _train(spark, sf)), 10, [recipe])
    return out.drop("recipe")


@query(_combined_sql("greatest(x1, x2, 0)"))
def combine_max(spark, sf):
    return _combined(spark, sf, combine_recipe("max", [0, 1], "max"))


@query(_combined_sql("least(x1, x2)"))
def combine_min_of_given(spark, sf):
    return _combined(spark, sf, combine_recipe("min", [0, 1], "min", slots=None))


@query(_combined_sql("(x1 + x2) / 5"))
def combine_average_of_five(spark, sf):
    return _combined(spark, sf, combine_recipe("avg5", [0, 1], "average"))


@query(_combined_sql("(x1 + x2) / 2"))
def combine_average_of_given(spark, sf):
    return _combined(spark, sf, combine_recipe("avg", [0, 1], "average", slots=None))


@query(_combined_sql("CAST(0.7 AS DOUBLE) * x1 + CAST(0.3 AS DOUBLE) * x2"))
def combine_weighted(spark, sf):
    return _combined(spark, sf, combine_recipe("w", [0, 1], [0.7, 0.3]))



def _best_sql(options: str, k: int = 10) -> str:
    """The best ``k`` neighbours per recipe of ``options`` (recipe, id, nbr, sim)."""
    return f"""nbrs AS (SELECT recipe, id, nbr, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY recipe, id ORDER BY sim DESC, nbr) AS rank FROM ({options}) WHERE sim > 0) WHERE rank <= {k})"""


def _recipe_map_sql(name: str, ratings: str, truth: str, item_based: bool = False, nbrs: str = "nbrs") -> str:
    """Lists of every recipe of ``nbrs`` on one prediction matrix, and their MAP as ``name`` (recipe, map, ci95, n)."""
    user, item, on = ("t.user_id", "n.id", "t.item_id") if item_based else ("n.id", "t.item_id", "t.user_id")
    return f"""{name}_s AS (SELECT recipe, {user} AS user_id, {item} AS item_id, round(sum(n.sim * t.value), 9) AS score FROM {nbrs} n JOIN {ratings} t ON n.nbr = {on} GROUP BY 1, 2, 3),
{lists_sql(f"{name}_s", ratings, 50, f"{name}_r", "s.recipe, ")}, {map_sql(f"{name}_r", truth, 10, "recipe", name)}"""


def _sweep_of_subsets_sql() -> str:
    sources = (("train", "user_id", "item_id", "value"), ("itrain", "user_id", "item_id", "value"), ("uc", "user_id", "category_id", "value"), ("seen", "user_id", "item_id", "value"))
    sims = ", ".join(sims_sql(t, r, c, f"s{i}", v, 15) for i, (t, r, c, v) in enumerate(sources, 1))
    union = " UNION ALL ".join(f"SELECT {i} AS src, id, nbr, sim FROM s{i}" for i in range(1, 5))
    pairs = ", ".join(f"coalesce(max(sim) FILTER (src = {i}), 0) AS x{i}" for i in range(1, 5))
    subsets = [[p + 1 for p in parts] for parts in similarity.iter_pairs(4)]
    options = " UNION ALL ".join(f"SELECT '{'+'.join(map(str, p))}' AS recipe, id, nbr, round(greatest({', '.join(f'x{i}' for i in p)}, 0), 9) AS sim FROM pairs" for p in subsets)
    return f"""WITH {SPLIT}, {IMPLICIT}, {CATEGORIES}, {_IC}, {_UC}, seen AS (SELECT user_id, item_id, CAST(1 AS DOUBLE) AS value FROM train WHERE value > 0), {sims},
pairs AS (SELECT id, nbr, {pairs} FROM ({union}) GROUP BY id, nbr), {_best_sql(options)}, {_recipe_map_sql("me", "train", "valid")}, {_recipe_map_sql("mi", "itrain", "ivalid")}
SELECT recipe, 'explicit' AS matrix, map, ci95, n FROM me UNION ALL SELECT recipe, 'implicit', map, ci95, n FROM mi"""


@query(_sweep_of_subsets_sql())
def combination_sweep(spark, sf):
    """Eleven subsets of four similarities times two prediction matrices, one pass over the block products.

    The implicit matrix is the train part of the implicit split and is held against that split's hold-out.
    """
    parts, liked_parts = _parts(spark, sf), _implicit_parts(spark, sf)
    train, liked = _part(parts, "train"), _part(liked_parts, "train")
    explicit, uc = _two_sources(spark, sf, train, liked)
    sources = [explicit, knn.as_matrix(liked), uc, knn.as_matrix(matrix.visits(train))]
    return experiments.combination_sweep(sources, {"explicit": train, "implicit": liked}, _truths(explicit=_part(parts, "valid"), implicit=_part(liked_parts, "valid")), 10)


def _truths(**by_matrix):
    """Hold-outs of several prediction matrices as one table with the column ``matrix``."""
    out = None
    for name, truth in by_matrix.items():
        one = truth.select(F.lit(name).alias("matrix"), "user_id", "item_id")
        out = one if out is None else out.unionByName(one)
    return out


_WEIGHTS = " UNION ALL ".join(f"SELECT '{a:g}/{1 - a:g}' AS recipe, id, nbr, round(CAST({a} AS DOUBLE) * x1 + CAST({1 - a} AS DOUBLE) * x2, 9) AS sim FROM pairs" for a in (0.0, 0.25, 0.5, 0.75, 1.0))


@query(f"WITH {_TWO}, {_best_sql(_WEIGHTS)}, {_recipe_map_sql('m', 'train', 'valid')} SELECT recipe, map, ci95, n FROM m")
def weighted_combinations(spark, sf):
    """Weights of the grid over two similarities, evaluated on the hold-out."""
    parts = _parts(spark, sf)
    train = _part(parts, "train")
    grid = similarity.weight_grid(2, [0.0, 0.25, 0.5, 0.75, 1.0], spark).orderBy("w1").collect()  # five weight pairs
    recipes = [Recipe(f"{w[0]:g}/{w[1]:g}", "sum", (0, 1), (w[0], w[1])) for w in grid]
    nbrs = neighbours(_two_sources(spark, sf, train), 10, recipes)
    lists = user_lists(nbrs, train, 50, by=["recipe"])
    return evaluate.map_at(lists, _part(parts, "valid"), 10, ["recipe"])


# --- new users --------------------------------------------------------------------------------------------------------

_NEW = "new AS (SELECT DISTINCT user_id + 1000000 AS user_id, item_id, CAST(5 AS DOUBLE) AS value FROM cells WHERE user_id % 50 = 7)"


def _new_users(spark, sf):
    liked = fixtures.cells(spark, sf).where(F.col("user_id") % 50 == 7)
    return knn.liked_as_ratings(liked.select((F.col("user_id") + 1000000).alias("user_id"), "item_id"))


@query(f"""WITH {SPLIT}, {_NEW}, {_ITEM_SIMS}, {top_sql('sims', 110)}, {score_sql('nbrs', 'new', True)}, {lists_sql('scores', 'new', 100000)} SELECT {_LIST_COLUMNS} FROM recs""")
def fold_in_new_users(spark, sf):
    new = cut(_new_users(spark, sf))
    nbrs = neighbours(knn.as_matrix(_train(spark, sf), "item_id", "user_id"), 110)
    return knn.full_ranking(knn.fold_in(nbrs, new), new).select("user_id", "item_id", "rank", "score")


@query(f"""WITH {CELLS}, {_NEW}, a AS (SELECT user_id, item_id, value / sqrt(sum(value * value) OVER (PARTITION BY user_id)) AS v FROM new),
b AS (SELECT user_id, item_id, value / sqrt(sum(value * value) OVER (PARTITION BY user_id)) AS v FROM cells),
one AS (SELECT a.user_id AS id, b.user_id AS nbr, round(sum(a.v * b.v), 9) AS sim FROM a JOIN b USING (item_id) GROUP BY 1, 2)
SELECT id, nbr, sim FROM one UNION ALL SELECT nbr, id, sim FROM one""")
def new_user_similarities(spark, sf):
    new, cells = cut(knn.as_matrix(_new_users(spark, sf))), cut(knn.as_matrix(fixtures.cells(spark, sf)))
    ids = new.select("row").distinct()
    apart, among = (similarity.against(new, cells.join(ids, "row", how)) for how in ("left_anti", "left_semi"))
    none = spark.createDataFrame([], "id long, nbr long, sim double")
    return similarity.append_similarities(similarity.append_similarities(none, apart, apart=True), among)


@query(f"""WITH {CELLS}, n AS (SELECT * FROM cells WHERE user_id % 50 = 7), m AS (SELECT user_id, avg(value) AS mean FROM n GROUP BY user_id)
SELECT n.user_id, item_id, value, round(value - mean + 0.001, 6) AS centred, CAST(value > 3 AS DOUBLE) AS implicit FROM n JOIN m ON n.user_id = m.user_id""")
def new_user_vectors(spark, sf):
    new = fixtures.cells(spark, sf).where(F.col("user_id") % 50 == 7).select("user_id", "item_id", "value")
    return _sixth(matrix.new_user_vectors(new), "centred")


def _fitted_sql() -> str:
    parts, out = [SPLIT], []
    for data in ("train", "cells"):
        for axis, (r, c) in (("user", ("user_id", "item_id")), ("item", ("item_id", "user_id"))):
            n = f"{data}_{axis}"
            parts += [sims_sql(data, r, c, n), top_sql(n, 5, f"{n}_n")]
            out.append(f"SELECT '{'entire' if data == 'cells' else data}' AS data, '{axis}' AS axis, {_NBR_COLUMNS} FROM {n}_n")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)}"


@query(_fitted_sql())
def fitted_neighbours(spark, sf):
    return knn.fitted_neighbours(_train(spark, sf), cut(fixtures.cells(spark, sf)), 5)


# --- evaluation -------------------------------------------------------------------------------------------------------

def _metrics_sql(size: str = "count(*)", per_user: bool = False) -> str:
    """``size``: what the interval's root is taken of."""
    ks = (5, 10, 15, 20, 50)
    cols = []
    for k in ks:
        cols += [
            f"sum(CASE WHEN rank <= {k} THEN c / rank END) / least({k}, max(len)) AS map{k}",
            f"CAST(sum(CASE WHEN rank <= {k} THEN hit END) AS DOUBLE) / least({k}, max(len)) AS prec{k}",
            f"CAST(sum(CASE WHEN rank <= {k} THEN hit END) AS DOUBLE) / max(n_true) AS rec{k}",
        ]
    out = []
    for k in ks:
        for label, c in (("MAP", "map"), ("Precision", "prec"), ("Recall", "rec")):
            out.append(f"SELECT '{label}' AS name, {k} AS k, {c}{k} AS v FROM u")
    out += ["SELECT 'R-Precision', NULL, rprec FROM u", "SELECT 'NDCG', NULL, ndcg FROM u", "SELECT 'Clicks', NULL, clicks FROM u"]
    users = f"""WITH {_USER_KNN}, {score_sql('nbrs', 'train')}, {lists_sql('scores', 'train', 50)},
truth AS (SELECT user_id, count(*) AS n_true FROM valid GROUP BY user_id),
h AS (SELECT r.user_id, r.rank, n_true, CASE WHEN v.item_id IS NULL THEN 0 ELSE 1 END AS hit, count(*) OVER (PARTITION BY r.user_id) AS len
  FROM recs r JOIN truth t ON r.user_id = t.user_id LEFT JOIN valid v ON r.user_id = v.user_id AND r.item_id = v.item_id),
hc AS (SELECT *, CAST(sum(hit) OVER (PARTITION BY user_id ORDER BY rank) AS DOUBLE) AS c FROM h),
u AS (SELECT user_id, {', '.join(cols)}, CAST(sum(CASE WHEN rank <= n_true THEN hit END) AS DOUBLE) / max(n_true) AS rprec,
  sum(hit / log2(rank + 1)) / (SELECT sum(1 / log2(p + 1)) FROM range(1, 2000) AS g(p) WHERE p <= max(hc.n_true)) AS ndcg,
  coalesce((min(CASE WHEN hit = 1 THEN rank END) - 1) / 10, 5) AS clicks FROM hc GROUP BY user_id)"""
    if per_user:
        return users + " SELECT user_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("map10", "prec10", "rec10", "rprec", "ndcg", "clicks")) + " FROM u"
    return f"""{users}, long AS ({' UNION ALL '.join(out)})
SELECT name, CAST(k AS INT) AS k, round(avg(v), 6) AS mean, round(1.96 * stddev_pop(v) / sqrt({size}), 6) AS ci95, count(*) AS n FROM long GROUP BY name, k"""


@query(_metrics_sql())
def ranking_metrics(spark, sf):
    parts = _parts(spark, sf)
    lists = flagship.user_knn_lists(_part(parts, "train"), 10, 50)
    return evaluate.metrics(lists, _part(parts, "valid"), digits=6)


@query(_metrics_sql("(SELECT count(DISTINCT user_id) FROM cells)"))
def ranking_metrics_over_all_users(spark, sf):
    """The interval divides by the number of all users, evaluated or not."""
    parts = _parts(spark, sf)
    lists = flagship.user_knn_lists(_part(parts, "train"), 10, 50)
    return evaluate.metrics(lists, _part(parts, "valid"), n_users=parts.select("user_id").distinct().count(), digits=6)


@query(_metrics_sql(per_user=True))
def per_user_metrics(spark, sf):
    parts = _parts(spark, sf)
    lists = flagship.user_knn_lists(_part(parts, "train"), 10, 50)
    users = evaluate.per_user(lists, _part(parts, "valid"), (10,))
    names = {"map10": "MAP@10", "prec10": "Precision@10", "rec10": "Recall@10", "rprec": "R-Precision", "ndcg": "NDCG", "clicks": "Clicks"}
    return users.select("user_id", *[F.round(F.col(f"`{name}`").cast("double"), 6).alias(short) for short, name in names.items()])


@query(f"""WITH {_USER_KNN}, {score_sql('nbrs', 'train')}, {lists_sql('scores', 'train', 50)}, {map_sql('recs', 'valid')} SELECT map, ci95, n FROM maps""")
def map_of_single_k(spark, sf):
    parts = _parts(spark, sf)
    train = _part(parts, "train")
    return experiments.single_k(neighbours(knn.as_matrix(train), 10), train, _part(parts, "valid"), 10)


def _sweep_sql(ks, sims, item_based=False):
    parts = [SPLIT, sims, top_sql("sims", max(ks))]
    union = []
    for k in ks:
        parts += [f"n{k} AS (SELECT * FROM nbrs WHERE rank <= {k})", score_sql(f"n{k}", "train", item_based, f"sc{k}")]
        union.append(f"SELECT {k} AS k, user_id, item_id, score FROM sc{k}")
    parts += [f"scores AS ({' UNION ALL '.join(union)})", lists_sql("scores", "train", 50, by="s.k, "), map_sql("recs", "valid", 10, "k")]
    return f"WITH {', '.join(parts)} SELECT k, map, ci95, n FROM maps"


@query(_sweep_sql((5, 10, 20, 40), _USER_SIMS))
def k_sweep_users(spark, sf):
    parts = _parts(spark, sf)
    train = _part(parts, "train")
    return experiments.k_sweep(neighbours(knn.as_matrix(train), 40), train, _part(parts, "valid"), (5, 10, 20, 40))


@query(_sweep_sql((50, 60, 70, 80, 90, 100, 110), _ITEM_SIMS, True))
def k_sweep_items(spark, sf):
    parts = _parts(spark, sf)
    train = _part(parts, "train")
    nbrs = neighbours(knn.as_matrix(train, "item_id", "user_id"), 110)
    return experiments.k_sweep(nbrs, train, _part(parts, "valid"), item_based=True)


def _size_sql(shares, ks) -> str:
    """Sweep on valid for every share of the train part, the best size per share, and that size on test."""
    sums = ", ".join(f"round(sum(n.sim * t.value) FILTER (n.rank <= {k}), 9) AS k{k}" for k in ks)
    long = " UNION ALL ".join(f"SELECT share, {k} AS k, user_id, item_id, k{k} AS score FROM wide WHERE k{k} IS NOT NULL" for k in ks)
    values = ", ".join(f"(CAST({s} AS DOUBLE))" for s in shares)
    return f"""WITH {SPLIT}, sized AS (SELECT *, n - floor(n * (CAST(0.2 AS DOUBLE) + CAST(0.3 AS DOUBLE))) AS m FROM ranked),
t AS (SELECT share, user_id, item_id, value FROM sized, (VALUES {values}) AS v(share) WHERE pos <= m AND pos > m - floor(m * share)),
unit AS (SELECT share, user_id, item_id, value / sqrt(sum(value * value) OVER (PARTITION BY share, user_id)) AS v FROM t WHERE value <> 0),
sims AS (SELECT a.share, a.user_id AS id, b.user_id AS nbr, round(sum(a.v * b.v), 9) AS sim FROM unit a JOIN unit b ON a.share = b.share AND a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY ALL),
nbrs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY share, id ORDER BY sim DESC, nbr) AS rank FROM sims WHERE sim > 0) WHERE rank <= {max(ks)}),
wide AS (SELECT n.share, n.id AS user_id, t.item_id, {sums} FROM nbrs n JOIN t ON n.share = t.share AND n.nbr = t.user_id
  WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.share = n.share AND o.user_id = n.id AND o.item_id = t.item_id) GROUP BY ALL),
recs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY share, k, user_id ORDER BY score DESC, item_id) AS rank FROM ({long})) WHERE rank <= 50),
{map_sql('recs', 'valid', 10, 'share, k', 'mv')}, {map_sql('recs', 'test', 10, 'share, k', 'mt')},
best AS (SELECT share, k, map FROM mv QUALIFY row_number() OVER (PARTITION BY share ORDER BY map DESC, k) = 1)
SELECT best.share, CAST(best.k AS INT) AS k, best.map, mt.map AS test_map FROM best JOIN mt ON best.share = mt.share AND best.k = mt.k"""


@query(_size_sql((0.25, 0.5, 0.75, 1.0), (10, 20, 40)))
def training_size_study(spark, sf):
    return experiments.size_study(fixtures.cells(spark, sf), (0.25, 0.5, 0.75, 1.0), (10, 20, 40))


@query(_size_sql([i / 10 for i in range(1, 11)], experiments.SWEEP_NEIGHBOURS))
def training_size_study_full(spark, sf):
    """Ten training sizes times seven neighbourhood sizes."""
    return experiments.size_study(fixtures.cells(spark, sf), [i / 10 for i in range(1, 11)], experiments.SWEEP_NEIGHBOURS)


_POPULAR = f"""{BUSINESS}, raters AS (SELECT item_id, count(*) AS rated, count(*) FILTER (value >= 4) AS liked FROM train GROUP BY item_id),
per_item AS (SELECT l_suppkey AS item_id, count(*) AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
top AS (SELECT 'count' AS recipe, item_id, row_number() OVER (ORDER BY c DESC, item_id) AS rank FROM per_item
  UNION ALL SELECT 'stars', b.item_id, row_number() OVER (ORDER BY b.stars DESC, b.item_id) FROM business b JOIN raters r ON b.item_id = r.item_id JOIN per_item p ON p.item_id = b.item_id WHERE rated > 50
  UNION ALL SELECT 'liked', item_id, row_number() OVER (ORDER BY CASE WHEN rated > 30 THEN liked / rated ELSE 0 END DESC, item_id) FROM raters),
recs AS (SELECT recipe, user_id, rank, item_id FROM top, (SELECT DISTINCT user_id FROM train) WHERE rank <= 50)"""


@query(f"WITH {SPLIT}, {_POPULAR}, {map_sql('recs', 'valid', 10, 'recipe')} SELECT recipe, map, ci95, n FROM maps")
def popularity_baselines(spark, sf):
    parts = _parts(spark, sf)
    counts = fixtures.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("item_id")).agg(F.count(F.lit(1)).alias("review_count"))
    items = fixtures.business(spark, sf).join(counts, "item_id")
    return experiments.popularity_baselines(items, _part(parts, "train"), _part(parts, "valid"))


def _recipe_sims(spark, sf, train, liked):
    """Similarity sources the model recipes read, by name; implicit ones come from the implicit split."""
    uc = _uc(spark, sf, liked).select(F.col("user_id").alias("row"), F.col("category_id").alias("col"), "value")
    ic = _ic(spark, sf).select(F.col("item_id").alias("row"), F.col("category_id").alias("col"), "value")
    return {
        "explicit": knn.as_matrix(train), "implicit": knn.as_matrix(liked), "centred": knn.as_matrix(matrix.centre(train)),
        "visit": knn.as_matrix(matrix.visits(train)), "user_category": uc, "user_category_implicit": matrix.above(uc),
        "item_user": knn.as_matrix(train, "item_id", "user_id"), "item_user_implicit": knn.as_matrix(liked, "item_id", "user_id"),
        "item_category": ic, "item_blocks": _blocks(spark, sf, 1000, train),
    }


# recipe name -> (similarity source, prediction matrix, item based)
RECIPES = {
    "explicit->explicit": ("explicit", "explicit", False), "implicit->implicit": ("implicit", "implicit", False),
    "implicit->explicit": ("implicit", "explicit", False), "explicit->centred": ("explicit", "centred", False),
    "centred->centred": ("centred", "centred", False), "visit->visit": ("visit", "visit", False),
    "user_category->explicit": ("user_category", "explicit", False), "user_category->implicit": ("user_category", "implicit", False),
    "user_category_implicit->explicit": ("user_category_implicit", "explicit", False),
    "item_user->explicit": ("item_user", "explicit", True), "item_user_implicit->implicit": ("item_user_implicit", "implicit", True),
    "item_category->explicit": ("item_category", "explicit", True), "item_category->implicit": ("item_category", "implicit", True),
    "item_blocks->implicit": ("item_blocks", "implicit", True),
}


def _recipes_sql() -> str:
    """Neighbours of every source, then one MAP per (prediction matrix, axis) over the recipes that use it."""
    sources = {
        "explicit": ("train", "user_id", "item_id"), "implicit": ("itrain", "user_id", "item_id"), "centred": ("centred", "user_id", "item_id"),
        "visit": ("seen", "user_id", "item_id"), "user_category": ("uc", "user_id", "category_id"), "user_category_implicit": ("uci", "user_id", "category_id"),
        "item_user": ("train", "item_id", "user_id"), "item_user_implicit": ("itrain", "item_id", "user_id"), "item_category": ("ic", "item_id", "category_id"),
        "item_blocks": ("blocks", "row", "col"),
    }
    targets = {"explicit": ("train", "valid"), "implicit": ("itrain", "ivalid"), "centred": ("centred", "valid"), "visit": ("seen", "valid")}
    with_ = [SPLIT, IMPLICIT, CATEGORIES, _IC, _UC, _BRAND, _blocks_sql(1000), "uci AS (SELECT user_id, category_id, CAST(1 AS DOUBLE) AS value FROM uc WHERE value > 3)",
             "seen AS (SELECT user_id, item_id, CAST(1 AS DOUBLE) AS value FROM train WHERE value > 0)",
             "centred AS (SELECT user_id, item_id, value - avg(value) OVER (PARTITION BY user_id) + CAST(0.001 AS DOUBLE) AS value FROM train)"]
    for name, (t, r, c) in sources.items():
        with_ += [sims_sql(t, r, c, f"s_{name}"), top_sql(f"s_{name}", 50, f"n_{name}")]
    out = []
    for target, (ratings, truth) in targets.items():
        for item_based in (False, True):
            used = [(label, s) for label, (s, m, i) in RECIPES.items() if m == target and i == item_based]
            if used:
                name = f"m_{target}_{'item' if item_based else 'user'}"
                options = " UNION ALL ".join(f"SELECT '{label}' AS recipe, id, nbr, sim FROM n_{s}" for label, s in used)
                with_.append(f"{name}_n AS ({options})")
                with_.append(_recipe_map_sql(name, ratings, truth, item_based, f"{name}_n"))
                out.append(f"SELECT recipe, map, ci95, n FROM {name}")
    return f"WITH {', '.join(with_)} {' UNION ALL '.join(out)}"


@query(_recipes_sql())
def model_recipes(spark, sf):
    """Hold-out MAP of the model recipes; the user sources share one pass, the item sources another."""
    parts, liked_parts = _parts(spark, sf), _implicit_parts(spark, sf)
    train, liked = _part(parts, "train"), _part(liked_parts, "train")
    sources = _recipe_sims(spark, sf, train, liked)
    ratings = {"explicit": train, "implicit": liked, "centred": cut(matrix.centre(train)), "visit": matrix.visits(train)}
    truths = {"explicit": _part(parts, "valid"), "implicit": _part(liked_parts, "valid")}
    lists = {"explicit": None, "implicit": None}
    for item_based in (False, True):
        names = sorted({s for s, _, i in RECIPES.values() if i == item_based})
        nbrs = cut(neighbours([sources[n] for n in names], 50, [Recipe(n, "sum", (i,), (1.0,)) for i, n in enumerate(names)]))
        for target, rated in ratings.items():  # recipes of one prediction matrix share its lists
            labels = {source: label for label, (source, on, based) in RECIPES.items() if on == target and based == item_based}
            if labels:
                one = user_lists(nbrs.where(F.col("recipe").isin(*labels)), rated, LIST_LENGTH, item_based, by=["recipe"])
                label = F.coalesce(*[F.when(F.col("recipe") == source, F.lit(name)) for source, name in labels.items()])
                one = one.select(label.alias("recipe"), "user_id", "rank", "item_id")
                side = "implicit" if target == "implicit" else "explicit"
                lists[side] = one if lists[side] is None else lists[side].unionByName(one)
    tables = [evaluate.map_at(lists[side], truths[side], 10, ["recipe"]) for side in lists]
    return tables[0].unionByName(tables[1])


def _final_sql() -> str:
    own = {"Implicit_UserReview": ("ifinal", "user_id", "item_id", 140, "ifinal", "itest", False), "Implicit_Explicit_Combined_UserReview": ("ifinal", "user_id", "item_id", 100, "final", "test", False),
           "ItemKeyphrase": ("brand", "row", "col", 110, "final", "test", True), "ItemCategory": ("ic", "item_id", "category_id", 130, "final", "test", True)}
    with_ = [SPLIT, IMPLICIT, CATEGORIES, _IC, _BRAND, BUSINESS, "final AS (SELECT user_id, item_id, value FROM split WHERE split <> 'test')", "ifinal AS (SELECT user_id, item_id, value FROM isplit WHERE split <> 'test')"]
    out = []
    for i, (name, (t, r, c, k, ratings, truth, item_based)) in enumerate(own.items()):
        with_ += [sims_sql(t, r, c, f"s{i}"), top_sql(f"s{i}", k, f"t{i}"), f"n{i} AS (SELECT '{name}' AS recipe, id, nbr, sim FROM t{i})", _recipe_map_sql(f"m{i}", ratings, truth, item_based, f"n{i}")]
        out.append(f"SELECT recipe, map, ci95, n FROM m{i}")
    with_.append("""pop AS (SELECT 'Popularity_reviewNumber' AS recipe, user_id, rank, item_id FROM (SELECT l_suppkey AS item_id, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS rank
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1), (SELECT DISTINCT user_id FROM final) WHERE rank <= 50)""")
    with_.append(map_sql("pop", "test", 10, "recipe", "mp"))
    return f"WITH {', '.join(with_)} {' UNION ALL '.join(out)} UNION ALL SELECT recipe, map, ci95, n FROM mp"


@query(_final_sql())
def final_test_table(spark, sf):
    """Five recipes trained on train plus valid against the test part of their own split."""
    parts, liked_parts = _parts(spark, sf), _implicit_parts(spark, sf)
    final, liked = (p.where(F.col("split") != "test").drop("split") for p in (parts, liked_parts))
    test, liked_test = _part(parts, "test"), _part(liked_parts, "test")
    like = cut(neighbours(knn.as_matrix(liked), 140))
    ic = _ic(spark, sf).select(F.col("item_id").alias("row"), F.col("category_id").alias("col"), "value")
    counts = fixtures.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("item_id")).agg(F.count(F.lit(1)).alias("review_count"))
    popular = recommend.popular_by_count(fixtures.business(spark, sf).join(counts, "item_id"))
    lists = {
        "Implicit_Explicit_Combined_UserReview": user_lists(like.where(F.col("rank") <= 100), final, LIST_LENGTH),
        "ItemKeyphrase": user_lists(neighbours(_brand_cells(spark, sf), 110), final, LIST_LENGTH, True),
        "ItemCategory": user_lists(neighbours(ic, 130), final, LIST_LENGTH, True),
        "Popularity_reviewNumber": recommend.same_for_all(final, popular),
    }
    own = {"Implicit_UserReview": user_lists(like, liked, LIST_LENGTH)}
    return experiments.recipe_table(lists, test).unionByName(experiments.recipe_table(own, liked_test))


@query()
def rolling_window_validation(spark, sf):
    reviews = fixtures.reviews(spark, sf)
    return experiments.rolling_validation(reviews, fixtures.item_categories(spark, sf), experiments.rolling_windows(spark, 1995, 1999), experiments.SWEEP_NEIGHBOURS, 6_100, 4_000)


# --- distance-limited lists -------------------------------------------------------------------------------------------

_NEAR = f"""{_USER_KNN}, {score_sql('nbrs', 'train')}, {lists_sql('scores', 'train', 50)}, {BUSINESS}, {_KM},
near AS (SELECT user_id, origin, item_id, rank, near_rank FROM (
  SELECT r.user_id, d.origin, r.item_id, r.rank, row_number() OVER (PARTITION BY r.user_id, d.origin ORDER BY r.rank, r.item_id) AS near_rank
  FROM recs r JOIN distances d ON r.item_id = d.item_id WHERE d.km <= 5.0) WHERE near_rank <= 10)"""


def _near(spark, sf):
    km = recommend.item_distances(fixtures.business(spark, sf), ellipsoid=False)
    return recommend.within_radius(flagship.user_knn_lists(_train(spark, sf), 10, 50), km, 5.0, 10)


@query(f"WITH {_NEAR} SELECT user_id, origin, item_id, rank, near_rank FROM near")
def lists_within_radius(spark, sf):
    return _near(spark, sf).select("user_id", "origin", "item_id", "rank", "near_rank")


@query(f"""WITH {_NEAR}, pooled AS (SELECT user_id, item_id, min(rank) AS best_rank FROM near GROUP BY user_id, item_id)
SELECT user_id, item_id, best_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY best_rank, item_id) AS rank FROM pooled) WHERE rank <= 3""")
def merged_lists_of_origins(spark, sf):
    return recommend.merge_ranked(_near(spark, sf), ["user_id"], 3).select("user_id", "item_id", "best_rank", "rank")
