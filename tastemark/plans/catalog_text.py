"""Queries for text cleaning, term statistics, classification, highlights and critique sessions."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tastemark.functions import textual
from tastemark.lookups import COMPOUNDS, CONTRACTIONS, HIGHLIGHT_NOUN_STOP, STOP_WORDS, STOP_WORDS_EXTRA
from tastemark.operators import aggregates, classify, critique, evaluate, highlights, knn, lookup, matrix, recommend, split, vectors
from tastemark.operators.scored_lists import user_lists
from tastemark.operators.similarity import neighbours
from tastemark.plans import fixtures
from tastemark.plans.registry import lists_sql, literal_list, map_sql, query, score_sql, sims_sql, top_sql
from tastemark.session import cut, shared_folder
from tastemark.streaming import critique_stream

STOP = literal_list([*STOP_WORDS, *STOP_WORDS_EXTRA])
W = r"[\p{L}\p{N}_]"
TOKENS = rf"{W}+-{W}+[-\[\p{{L}}\p{{N}}_]+\]?|{W}+|[.,!?;]"

# Negation marks by a running "last event" per text, independent of how the engine finds them.
CLEAN = rf"""raw_tok AS (SELECT doc_id, source, u.t AS t, u.i AS i FROM (
  SELECT doc_id, source, unnest(list_transform(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda t, i: {{'t': t, 'i': i}})) AS u FROM documents)),
ev AS (SELECT *, CASE WHEN t = 'not' THEN 1 WHEN regexp_matches(t, '[,.?;]|however|but') THEN 0 END AS e FROM raw_tok),
sc AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le FROM ev),
marked AS (SELECT doc_id, source, string_agg(CASE WHEN t <> 'not' AND le = 1 THEN 'not_' || t ELSE t END, ' ' ORDER BY i) AS txt FROM sc GROUP BY doc_id, source),
clean_all AS (SELECT doc_id, source, u.t AS term, u.i AS i FROM (SELECT doc_id, source, unnest(list_transform(string_split(trim(regexp_replace(
  regexp_replace(txt, '&lt;/?.*?&gt;', ' &lt;&gt; ', 'g'), '[^\p{{L}}\p{{Nl}}\p{{No}}_]+', ' ', 'g')), ' '), lambda t, i: {{'t': t, 'i': i}})) AS u FROM marked)),
words AS (SELECT * FROM clean_all WHERE term <> '' AND term NOT IN ({STOP}))"""


def _words():
    return textual.clean_tokens(F.col("text"))


def _docs(spark, sf):
    return fixtures.documents(spark, sf)


def _clean_docs(spark, sf):
    """Texts with their cleaned words; cleaning is done once for the branches that read it."""
    return cut(_docs(spark, sf).select("review_id", "item", _words().alias("words")))


@query(f"WITH {CLEAN} SELECT doc_id AS review_id, md5(string_agg(term, ' ' ORDER BY i)) AS text_md5, count(*) AS words FROM words GROUP BY doc_id")
def clean_reviews(spark, sf):
    w = _docs(spark, sf).select("review_id", _words().alias("w")).where(F.size("w") > 0)
    return w.select("review_id", F.md5(F.array_join("w", " ")).alias("text_md5"), F.size("w").cast("long").alias("words"))


@query(f"""WITH {CLEAN}, known AS (SELECT DISTINCT term FROM words)
SELECT doc_id AS review_id, md5(string_agg(CASE WHEN length(w.term) > 3 AND ends_with(w.term, 's') THEN coalesce(k.term, w.term) ELSE w.term END, ' ' ORDER BY i)) AS text_md5, count(*) AS words
FROM words w LEFT JOIN known k ON w.term = k.term || 's' GROUP BY doc_id""")
def clean_reviews_with_lemmas(spark, sf):
    """Lemmas from a joined table: a word in ``s`` becomes the word without it where the corpus has that one."""
    rows = _clean_docs(spark, sf).where(F.size("words") > 0)
    known = cut(rows.select(F.explode(F.array_distinct("words")).alias("lemma")).distinct())
    table = known.select(F.concat("lemma", F.lit("s")).alias("word"), "lemma").where(F.length("word") > 3)
    table = cut(table.join(known.select(F.col("lemma").alias("word")), "word", "left_semi"))  # forms that no text has are not looked up
    done = lookup.lemmatised(rows, "words", table, ["review_id"])
    return done.select("review_id", F.md5(F.array_join("words", " ")).alias("text_md5"), F.size("words").cast("long").alias("words"))


def _expand_sql(column: str) -> str:
    for old, new in {**CONTRACTIONS, **COMPOUNDS}.items():
        column = "replace({}, '{}', '{}')".format(column, old.replace("'", "''"), new.replace("'", "''"))
    return column


# every entry of the table before and after the whole text, since invented texts have few contractions of their own
_ALL_FORMS = " ".join([*CONTRACTIONS, *COMPOUNDS])
_FORMS_SQL = "'{0} ' || coalesce(text, '') || ' {0}'".format(_ALL_FORMS.replace("'", "''"))


@query(f"SELECT doc_id AS review_id, md5({_expand_sql(_FORMS_SQL)}) AS text_md5, length({_expand_sql('text')}) AS chars FROM documents")
def expand_contractions(spark, sf):
    text = F.concat(F.lit(f"{_ALL_FORMS} "), F.coalesce("text", F.lit("")), F.lit(f" {_ALL_FORMS}"))
    expand = textual.expand_contractions
    return _docs(spark, sf).select("review_id", F.md5(expand(text)).alias("text_md5"), F.char_length(expand(F.col("text"))).cast("long").alias("chars"))


@query(f"SELECT doc_id AS review_id, CAST(len(t) AS BIGINT) AS tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(text, '{TOKENS}') AS t FROM documents)")
def tokenise(spark, sf):
    t = _docs(spark, sf).select("review_id", textual.tokens(F.col("text")).alias("t"))
    return t.select("review_id", F.size("t").cast("long").alias("tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


# --- term counts ------------------------------------------------------------------------------------------------------

def _ngram_sql(n: int) -> str:
    if n == 1:
        return "grams AS (SELECT doc_id, source, term AS gram FROM words)"
    parts = " || ' ' || ".join(["term"] + [f"lead(term, {j}) OVER w" for j in range(1, n)])
    return f"grams AS (SELECT doc_id, source, {parts} AS gram FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i))"


def _top_terms_sql(n: int) -> str:
    return f"""WITH {CLEAN}, {_ngram_sql(n)} SELECT gram AS term, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, gram) AS rank
FROM grams WHERE gram IS NOT NULL GROUP BY gram QUALIFY rank <= 20"""


def _top_terms(n):
    def run(spark, sf):
        return vectors.top_terms(_docs(spark, sf), _words(), n, 20, 2000)

    return run


for _n, _name in ((1, "top_words"), (2, "top_bigrams"), (3, "top_trigrams")):
    query(_top_terms_sql(_n), _name)(_top_terms(_n))


@query(f"""WITH {CLEAN}, c AS (SELECT term, count(*) AS count FROM words GROUP BY term)
SELECT * FROM (SELECT term, count, row_number() OVER (ORDER BY count DESC, term) AS rank, 'common' AS kind FROM c QUALIFY rank <= 20)
UNION ALL SELECT * FROM (SELECT term, count, row_number() OVER (ORDER BY count, term) AS rank, 'rare' AS kind FROM c QUALIFY rank <= 20)""")
def common_and_rare_words(spark, sf):
    return vectors.common_and_rare(_docs(spark, sf), _words())


def _tfidf_sql(key: str, max_df: float, features: int, name: str = "vec") -> str:
    return f"""tc AS (SELECT {key} AS k, term, count(*) AS tf FROM words GROUP BY 1, 2),
nd AS (SELECT count(DISTINCT {'source' if key == 'source' else 'doc_id'}) AS n FROM documents),
vocab AS (SELECT term, df, total, n, row_number() OVER (ORDER BY total DESC, term) - 1 AS term_id FROM (
  SELECT term, count(*) AS df, sum(tf) AS total FROM tc GROUP BY term), nd WHERE df <= CAST({max_df} AS DOUBLE) * n QUALIFY term_id < {features}),
wt AS (SELECT k, term, term_id, tf, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS x FROM tc JOIN vocab USING (term)),
{name} AS (SELECT k, term, term_id, tf, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS value FROM wt)"""


@query(f"WITH {CLEAN}, {_tfidf_sql('source', 0.9, 5000)} SELECT term, term_id, df, CAST(total AS BIGINT) AS total FROM vocab")
def item_vocabulary(spark, sf):
    docs = _clean_docs(spark, sf)
    counts = vectors.term_counts(docs, F.col("words"), ["item"])
    return vectors.vocabulary(counts, "item", docs.select("item").distinct()).select("term", "term_id", "df", "total")


def _item_tfidf(spark, sf):
    return vectors.fit_tfidf(_clean_docs(spark, sf), F.col("words"), "item")


@query(f"WITH {CLEAN}, {_tfidf_sql('source', 0.9, 5000)} SELECT k AS item, term, tf, round(value, 9) AS value FROM vec")
def item_tfidf(spark, sf):
    return _item_tfidf(spark, sf).select("item", "term", "tf", F.round("value", 9).alias("value"))


@query(f"WITH {CLEAN}, {_tfidf_sql('doc_id', 1.0, 350)} SELECT k AS review_id, term, tf, round(value, 9) AS value FROM vec")
def document_tfidf(spark, sf):
    v = vectors.fit_tfidf(_clean_docs(spark, sf), F.col("words"), "review_id", 1.0, 350)
    return v.select("review_id", "term", "tf", F.round("value", 9).alias("value"))


_GRAMS13 = "grams13 AS (" + " UNION ALL ".join(
    f"SELECT doc_id, source, {p} AS term FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)" if n > 1 else "SELECT doc_id, source, term FROM words"
    for n, p in ((1, ""), (2, "term || ' ' || lead(term, 1) OVER w"), (3, "term || ' ' || lead(term, 1) OVER w || ' ' || lead(term, 2) OVER w"))
) + ")"


@query(f"""WITH {CLEAN}, {_GRAMS13}, {_tfidf_sql('doc_id', 0.8, 2000).replace('FROM words GROUP BY', 'FROM grams13 WHERE term IS NOT NULL GROUP BY')}
SELECT review_id, rank, term FROM (SELECT k AS review_id, term, row_number() OVER (PARTITION BY k ORDER BY round(value, 9) DESC, term_id DESC) AS rank FROM vec) WHERE rank <= 5""")
def document_keywords(spark, sf):
    """Five best keywords of every text over one to three word terms."""
    v = vectors.fit_tfidf(_clean_docs(spark, sf), F.col("words"), "review_id", 0.8, 2000, 1, 3)
    return vectors.keywords(v.withColumn("value", F.round("value", 9)), "review_id", 5).select("review_id", "rank", "term")


@query(f"WITH {CLEAN}, tc AS (SELECT doc_id, source, term, count(*) AS tf FROM words GROUP BY 1, 2, 3) SELECT source AS item, term, CAST(count(*) AS DOUBLE) AS value FROM tc GROUP BY 1, 2")
def item_keyword_matrix(spark, sf):
    counts = vectors.term_counts(_docs(spark, sf), _words(), ["review_id", "item"])
    return matrix.keyed_terms(counts, "item")


@query(f"WITH {CLEAN} SELECT source AS item, term, CAST(count(*) AS DOUBLE) AS value FROM words GROUP BY 1, 2")
def item_keyword_counts(spark, sf):
    counts = vectors.term_counts(_docs(spark, sf), _words(), ["review_id", "item"])
    return matrix.keyed_terms(counts, "item", binary=False)


@query("""WITH t AS (SELECT source, doc_id, text, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 1000 AS part FROM documents)
SELECT source AS item, CAST(part AS INT) AS part, count(*) AS reviews, md5(string_agg(text, ' ' ORDER BY doc_id)) AS text_md5 FROM t GROUP BY source, part""")
def item_texts(spark, sf):
    parts = vectors.concat_texts(_docs(spark, sf), "item", "review_id")
    return parts.select("item", "part", "reviews", F.md5("text").alias("text_md5"))


_ITEM_TEXT_SIMS = f"""{CLEAN}, {_tfidf_sql('source', 0.9, 5000)}, iv AS (SELECT CAST(substr(k, 4) AS BIGINT) AS item_id, term_id, value FROM vec),
{sims_sql('iv', 'item_id', 'term_id')}, {top_sql('sims', 5)}"""


def _item_text_cells(spark, sf):
    return _item_tfidf(spark, sf).select(F.substring("item", 4, 10).cast("long").alias("row"), F.col("term_id").alias("col"), "value")


@query(f"WITH {_ITEM_TEXT_SIMS} SELECT id, nbr, sim, rank FROM nbrs")
def item_text_neighbours(spark, sf):
    return neighbours(_item_text_cells(spark, sf), 5)


@query(f"""WITH {CLEAN}, {_tfidf_sql('doc_id', 1.0, 350)}, q AS (SELECT * FROM vec WHERE k IN (SELECT doc_id FROM labels WHERE toxic = 1)),
dots AS (SELECT q.k AS query, v.k AS match, round(sum(q.value * v.value), 9) AS sim FROM q JOIN vec v ON q.term_id = v.term_id WHERE q.k <> v.k GROUP BY 1, 2)
SELECT query, match, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, match) AS rank FROM dots) WHERE rank <= 5""")
def similar_reviews(spark, sf):
    """Five most similar texts for each text labelled toxic."""
    v = cut(vectors.fit_tfidf(_clean_docs(spark, sf), F.col("words"), "review_id", 1.0, 350))
    chosen = fixtures.table(spark, sf, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("review_id"))
    return vectors.similar_texts(v.join(chosen, "review_id", "left_semi"), v, "review_id")


# --- classification ---------------------------------------------------------------------------------------------------

def _labelled(spark, sf):
    labels = fixtures.table(spark, sf, "labels").select(F.col("doc_id").alias("review_id"), F.col("quality").cast("int").alias("label"))
    docs = _docs(spark, sf).join(labels, "review_id").select("review_id", "label", _words().alias("words"))
    return cut(split.by_hash(docs, "review_id"))


def _features(spark, sf, folds=False):
    data = _labelled(spark, sf)
    train = data.where(F.col("split") == "train")
    model, vocab = classify.fit_features(train, "words", "review_id")
    rows = model.transform(data).select("review_id", "label", "split", "features")
    if folds:
        rows = classify.with_folds(rows.where(F.col("split") == "train"), "review_id")
    rows = cut(rows)  # iterative fits read the features many times
    return rows, vocab, rows.where(F.col("split") == "train").count()


@query("SELECT round(avg(quality), 6) AS mean, round(stddev_pop(quality), 6) AS std, count(*) AS size FROM labels JOIN documents USING (doc_id)")
def favourable_share(spark, sf):
    labels = fixtures.table(spark, sf, "labels").join(fixtures.table(spark, sf, "documents").select("doc_id"), "doc_id")
    m = aggregates.moments(labels, F.col("quality"))
    return m.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "size")


@query()
def classifier_accuracy(spark, sf):
    """Naive Bayes, logistic regression and random forest, train and test accuracy."""
    rows, _, n = _features(spark, sf)
    return classify.compare(rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test"), n)


@query()
def classification_report(spark, sf):
    rows, _, n = _features(spark, sf)
    _, predicted = classify.fit_and_score(rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test"), classify.logistic(n))
    return classify.report(predicted.where(F.col("part") == "test"))


@query()
def strongest_words(spark, sf):
    """Largest and smallest coefficients of the logistic regression."""
    rows, vocab, n = _features(spark, sf)
    model = classify.logistic(n).fit(rows.where(F.col("split") == "train"))
    return classify.strongest_words(vocab, model.coefficients)


@query()
def forest_word_importance(spark, sf):
    rows, vocab, _ = _features(spark, sf)
    model = classify.forest().fit(rows.where(F.col("split") == "train"))
    return classify.strongest_words(vocab, model.featureImportances, both_ends=False)


@query()
def logistic_grid_search(spark, sf):
    rows, _, n = _features(spark, sf, folds=True)
    lr = classify.logistic(n)
    return classify.grid_search(rows, lr, classify.logistic_grid(lr, n))


@query()
def forest_grid_search(spark, sf):
    rows, _, _ = _features(spark, sf, folds=True)
    rf = classify.forest(depth=10)  # 80 fits; deeper trees take more passes over the rows each
    return classify.grid_search(rows, rf, classify.forest_grid(rf))


@query()
def cross_validated_accuracy(spark, sf):
    rows, _, n = _features(spark, sf, folds=True)
    return classify.cross_accuracy(rows, n)


# --- highlights -------------------------------------------------------------------------------------------------------
# The texts are invented words, so tags come from word endings and valences from a small list of frequent words.

SUFFIXES = (("ble", "J"), ("less", "J"), ("ly", "R"), ("ing", "N"), ("er", "N"), ("tion", "N"), ("nd", "J"), ("on", "N"), ("re", "J"))
LEXICON = {"thble": 2.5, "erble": 1.9, "onble": -1.2, "worthless": -1.9, "hehely": 0.8, "ernd": -0.6, "thnd": 1.1, "erre": 0.9, "onre": -2.2, "thre": 1.4, "orre": 0.3}


def _tagger():
    return textual.tagger({}, SUFFIXES)


def _valences(spark):
    return spark.createDataFrame(list(LEXICON.items()), "word string, valence double")


_TAG = "CASE {w} " + " ".join(f"WHEN '{w}' THEN '{t}'" for w, t in textual.CLOSED_CLASS.items()) + " ELSE CASE " + " ".join(
    f"WHEN ends_with({{w}}, '{s}') AND length({{w}}) > {len(s)} THEN '{t}'" for s, t in SUFFIXES) + " ELSE 'O' END END"
_PHRASE_STOP = literal_list([w for w in STOP_WORDS if w not in ("is", "was", "are", "were")])
_HTOK = f"""htok AS (SELECT doc_id, source, regexp_extract_all(lower({_expand_sql('text')}), '{TOKENS}') AS words FROM documents),
tagged AS (SELECT doc_id, source, array_to_string(list_transform(words, lambda w: w || '/' || {_TAG.format(w='w')} || ' '), '') AS t FROM htok)"""


def _phrases_sql() -> str:
    one = []
    for i, p in ((1, textual.DESCRIBED_NOUN), (2, textual.NOUN_IS_ADJECTIVE)):
        one.append(f"SELECT source, {i} AS pattern, unnest(regexp_extract_all(t, '{p}')) AS m FROM tagged")
    return f"""{_HTOK}, found AS ({' UNION ALL '.join(one)}),
acc AS (SELECT source, pattern, list_filter(string_split(regexp_replace(trim(m), '/[A-Z]( |$)', '\\1', 'g'), ' '), lambda w: length(w) BETWEEN 2 AND 40 AND w NOT IN ({_PHRASE_STOP})) AS w FROM found),
phrases AS (SELECT source AS item, array_to_string(w, ' ') AS phrase, min(pattern) AS pattern FROM acc WHERE len(w) > 1 GROUP BY 1, 2)"""


_NOUNS_SQL = f"""nouns AS (SELECT DISTINCT item, noun FROM (SELECT item, unnest(string_split(phrase, ' ')) AS noun FROM phrases)
WHERE {_TAG.format(w='noun')} = 'N' AND noun NOT IN ({literal_list(HIGHLIGHT_NOUN_STOP)}))"""
_NOUN_SCORES_SQL = f"""noun_scores AS (SELECT source AS item, w AS noun, count(*) AS occurrences, count(DISTINCT doc_id) AS reviews FROM (SELECT doc_id, source, unnest(words) AS w FROM htok)
WHERE length(w) > 2 AND w NOT IN ({literal_list(STOP_WORDS)}) AND (source, w) IN (SELECT item, noun FROM nouns) GROUP BY 1, 2),
top_nouns AS (SELECT item, noun, row_number() OVER (PARTITION BY item ORDER BY occurrences * reviews DESC, noun) AS noun_rank FROM noun_scores QUALIFY noun_rank <= 3)"""


def _tokens(spark, sf):
    return cut(highlights.review_tokens(_docs(spark, sf)))


@query(f"WITH {_phrases_sql()} SELECT item, phrase, pattern FROM phrases")
def candidate_phrases(spark, sf):
    return highlights.phrases(_tokens(spark, sf), _tagger())


@query(f"WITH {_phrases_sql()}, {_NOUNS_SQL} SELECT item, noun FROM nouns")
def phrase_nouns_by_tag_table(spark, sf):
    """Phrases and nouns with the tags of a joined table that holds every word of the corpus."""
    tokens = _tokens(spark, sf)
    known = tokens.select(F.explode(F.array_distinct("words")).alias("word")).distinct()
    tags = highlights.TagTable(cut(known.select("word", _tagger()(F.col("word")).alias("tag"))))
    return highlights.nouns(highlights.phrases(tokens, tags), tags)


@query(f"WITH {_phrases_sql()}, {_NOUNS_SQL} SELECT item, noun FROM nouns")
def phrase_nouns(spark, sf):
    return highlights.nouns(highlights.phrases(_tokens(spark, sf), _tagger()), _tagger())


def _scored(spark, sf):
    tokens = _tokens(spark, sf)
    found = cut(highlights.phrases(tokens, _tagger()))
    return tokens, found, highlights.noun_scores(tokens, cut(highlights.nouns(found, _tagger())))


@query(f"WITH {_phrases_sql()}, {_NOUNS_SQL}, {_NOUN_SCORES_SQL} SELECT item, noun, occurrences, reviews, occurrences * reviews AS score FROM noun_scores")
def noun_scores(spark, sf):
    return _scored(spark, sf)[2]


_HELD = "held AS (SELECT DISTINCT p.item, p.phrase, p.pattern FROM phrases p JOIN top_nouns n ON p.item = n.item AND contains(p.phrase, n.noun))"


@query(f"WITH {_phrases_sql()}, {_NOUNS_SQL}, {_NOUN_SCORES_SQL}, {_HELD} SELECT item, phrase, pattern FROM held")
def phrases_with_top_nouns(spark, sf):
    _, found, scores = _scored(spark, sf)
    return highlights.phrases_with_nouns(found, highlights.top_nouns(scores))


_VALENCE = "CASE {w} " + " ".join(f"WHEN '{w}' THEN CAST({v} AS DOUBLE)" for w, v in LEXICON.items()) + " ELSE 0 END"
_NEG = literal_list(textual.NEGATORS)


def _compound_sql(words: str, source: str, keys: str, name: str) -> str:
    """Valences per word with the three words before it, summed in order."""
    return f"""{name}_w AS (SELECT {keys}, u.t AS t, u.i AS i FROM (SELECT {keys}, unnest(list_transform({words}, lambda t, i: {{'t': t, 'i': i}})) AS u FROM {source})),
{name}_n AS (SELECT *, coalesce(max(CASE WHEN t IN ({_NEG}) THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS neg FROM {name}_w),
{name}_s AS (SELECT {keys}, sum({_VALENCE.format(w='t')} * CASE WHEN neg = 1 THEN CAST(-0.74 AS DOUBLE) ELSE 1 END) AS s FROM {name}_n GROUP BY {keys}),
{name} AS (SELECT {keys}, round(s / sqrt(s * s + 15), 4) AS sentiment FROM {name}_s)"""


@query(f"WITH {_phrases_sql()}, {_compound_sql(chr(39).join(['string_split(phrase, ', ' ', ')']), 'phrases', 'item, phrase', 'ps')} SELECT item, phrase, sentiment FROM ps")
def phrase_sentiment(spark, sf):
    found = cut(highlights.phrases(_tokens(spark, sf), _tagger()))
    return highlights.phrase_sentiment(found, _valences(spark)).select("item", "phrase", "sentiment")


_FINAL_SQL = f"""{_phrases_sql()}, {_NOUNS_SQL}, {_NOUN_SCORES_SQL}, {_HELD}, {_compound_sql(chr(39).join(['string_split(phrase, ', ' ', ')']), 'held', 'item, phrase', 'ps')},
opt AS (SELECT h.item, n.noun_rank, n.noun, h.phrase, row_number() OVER (PARTITION BY h.item, n.noun_rank ORDER BY sentiment DESC, pattern, h.phrase) AS place
  FROM held h JOIN ps USING (item, phrase) JOIN top_nouns n ON h.item = n.item AND list_contains(string_split(h.phrase, ' '), n.noun)),
one AS (SELECT item, noun_rank, noun, phrase FROM opt WHERE noun_rank = 1 AND place = 1),
two AS (SELECT item, noun_rank, noun, phrase FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY place) AS r FROM opt WHERE noun_rank = 2 AND (item, phrase) NOT IN (SELECT item, phrase FROM one)) WHERE r = 1),
three AS (SELECT item, noun_rank, noun, phrase FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY place) AS r FROM opt WHERE noun_rank = 3
  AND (item, phrase) NOT IN (SELECT item, phrase FROM one) AND (item, phrase) NOT IN (SELECT item, phrase FROM two)) WHERE r = 1),
fin AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three),
tidy AS (SELECT item, noun_rank, noun, string_split(replace(replace(replace(replace(replace(phrase, 'was', 'is'), 'were', 'are'), 'also', ''), 'still', ''), 'actual', ''), ' ') AS ws FROM fin),
final AS (SELECT item, CAST(noun_rank AS INT) AS noun_rank, noun, array_to_string(list_filter(ws, lambda w, i: w <> '' AND list_position(ws, w) = i), ' ') AS phrase FROM tidy)"""


@query(f"WITH {_FINAL_SQL} SELECT item, noun_rank, noun, phrase FROM final")
def highlight_phrases(spark, sf):
    tokens, found, scores = _scored(spark, sf)
    best = highlights.top_nouns(scores)
    held = highlights.phrase_sentiment(highlights.phrases_with_nouns(found, best), _valences(spark))
    return highlights.final_phrases(held, best)


@query(f"""WITH {_FINAL_SQL} SELECT item, string_agg(phrase, ' and ' ORDER BY noun_rank) AS explanation
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY noun_rank) AS place FROM final) WHERE place <= 2 GROUP BY item""")
def explanations(spark, sf):
    return highlights.explain(highlights.highlight(_docs(spark, sf), _tagger(), _valences(spark)))


@query(f"""WITH {_phrases_sql()}, {_NOUNS_SQL}, {_NOUN_SCORES_SQL},
t15 AS (SELECT item, noun FROM (SELECT item, noun, rank() OVER (PARTITION BY item ORDER BY occurrences * reviews DESC) AS r FROM noun_scores) WHERE r <= 15)
SELECT p.item, p.phrase, n.noun, 1 AS present FROM phrases p JOIN t15 n ON p.item = n.item AND list_contains(string_split(p.phrase, ' '), n.noun)""")
def phrase_noun_incidence(spark, sf):
    _, found, scores = _scored(spark, sf)
    return highlights.noun_incidence(found, scores)


def _context_sql(units: str) -> str:
    return f"""WITH {_phrases_sql()}, {_NOUNS_SQL}, {_NOUN_SCORES_SQL}, {_HELD}, units AS ({units}),
toks AS (SELECT item, unit, regexp_extract_all(text, '{TOKENS}') AS tk FROM units), {_compound_sql('tk', 'toks', 'item, unit', 'us')},
hit AS (SELECT h.item, h.phrase, avg(coalesce(us.sentiment, 0)) AS mean, count(*) AS units FROM held h JOIN units u ON h.item = u.item AND contains(u.text, h.phrase)
  LEFT JOIN us ON us.item = u.item AND us.unit = u.unit GROUP BY 1, 2)
SELECT h.item, h.phrase, round(coalesce(mean, 0), 6) AS sentiment, coalesce(units, 0) AS units FROM (SELECT DISTINCT item, phrase FROM held) h LEFT JOIN hit USING (item, phrase)"""


def _in_context(spark, sf, sentences):
    _, found, scores = _scored(spark, sf)
    held = cut(highlights.phrases_with_nouns(found, highlights.top_nouns(scores)))
    units = cut(highlights.text_units(_docs(spark, sf), sentences))
    return highlights.sentiment_in_context(held, units, _valences(spark))


@query(_context_sql("SELECT source AS item, CAST(doc_id AS VARCHAR) AS unit, lower(text) AS text FROM documents"))
def phrase_sentiment_in_reviews(spark, sf):
    return _in_context(spark, sf, False)


@query(_context_sql(r"""SELECT item, doc_id || '/' || (i - 1) AS unit, text FROM (SELECT source AS item, doc_id, u.t AS text, u.i AS i FROM (
SELECT source, doc_id, unnest(list_transform(string_split(regexp_replace(lower(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda t, i: {'t': t, 'i': i})) AS u FROM documents))"""))
def phrase_sentiment_in_sentences(spark, sf):
    return _in_context(spark, sf, True)


# --- critique sessions ------------------------------------------------------------------------------------------------

FEATURES = {"click": "name", "view": "cuisine", "purchase": "price", "error": "rating", "signup": "distance"}


def critique_events(spark, sf):
    """The event log as critiques: each user is one session."""
    e = fixtures.table(spark, sf, "events")
    order = Window.partitionBy("session").orderBy("ts", "event_id")
    feature = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in FEATURES.items()])
    value = F.col("value").cast("double")
    types = ("ECONOMY", "SMALL", "LARGE", "PROMO", "STANDARD", "MEDIUM")
    said = (
        F.when(feature == "cuisine", F.element_at(F.array(*[F.lit(t.lower()) for t in types]), (F.floor(value) % len(types) + 1).cast("int")))
        .when(feature == "price", F.when(F.floor(value) % 2 == 0, "more expensive").otherwise("cheaper"))
        .when(feature == "rating", F.when(F.floor(value) % 3 == 0, (F.floor(value) % 10 / 2).cast("string")).otherwise("current_rating"))
        .when(feature == "distance", F.when(F.floor(value) % 3 == 0, "further").when(F.floor(value) % 3 == 1, "closer").otherwise(F.round(value % 20, 1).cast("string")))
        .otherwise(F.lit(""))
    )
    sign = F.when(F.floor(value * 10) % 2 == 0, "negative").otherwise("positive")
    rows = e.select(F.col("user_id").alias("session"), "ts", "event_id", feature.alias("feature"), sign.alias("sign"), said.alias("value"))
    return rows.withColumn("seq", F.row_number().over(order).cast("long"))


def critique_inputs(spark, sf):
    """Ranked candidates of every user, the item columns a critique names, and the critiques."""
    train = cut(split.train_part(split.by_user_time(fixtures.cells(spark, sf))))
    nbrs = neighbours(knn.as_matrix(train, "item_id", "user_id"), 50)
    events = critique_events(spark, sf)
    own = train.join(events.select(F.col("session").alias("user_id")).distinct(), "user_id", "left_semi")  # only users who have a session
    recs = user_lists(nbrs, own, None, item_based=True).select(F.col("user_id").alias("session"), "rank", "item_id")
    cats = fixtures.item_categories(spark, sf).groupBy("item_id").agg(F.sort_array(F.collect_set("category")).alias("categories"))  # part types: a fixed few per item
    km = recommend.item_distances(fixtures.business(spark, sf), ellipsoid=False).where(F.col("origin") == "bloor_and_bathurst")
    items = fixtures.business(spark, sf).select("item_id", F.length("price").alias("price"), "stars")
    items = items.join(km.select("item_id", "km"), "item_id").join(cats, "item_id", "left")
    return recs, items, events


@query()
def critique_sessions(spark, sf):
    recs, items, events = critique_inputs(spark, sf)
    return critique.run(recs, items, events, 10.0)


@query()
def critique_responses(spark, sf):
    """The answer rows with the item cards."""
    recs, items, events = critique_inputs(spark, sf)
    answers = critique.run(recs, items, events, 10.0)
    cards = fixtures.business(spark, sf).select("item_id", "name", "city", "stars", "price").join(items.select("item_id", "km"), "item_id")
    return critique.response(answers, cards)


@query()
def critique_stream_answers(spark, sf):
    """The same critiques as a stream: session rows read as files, answers written by a streaming query."""
    recs, items, events = critique_inputs(spark, sf)
    active = events.select("session").distinct()
    timed = events.withColumn("event_time", F.col("ts").cast("timestamp"))
    rows = critique_stream.session_rows(critique.candidate_rows(recs.join(active, "session", "left_semi"), items), timed, "event_time")
    folder = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    rows.write.parquet(os.path.join(folder, "in"))
    answers = critique_stream.stream(spark.readStream.schema(rows.schema).parquet(os.path.join(folder, "in")), 10.0)
    started = (
        answers.writeStream.format("parquet").outputMode("append").option("path", os.path.join(folder, "out"))
        .option("checkpointLocation", os.path.join(folder, "state")).trigger(availableNow=True).start()
    )
    started.awaitTermination()
    return spark.read.schema(answers.schema).parquet(os.path.join(folder, "out"))


_EVENT_SPLIT = """cells AS (SELECT user_id, event_id % 20 AS item_id, sum(CAST(value AS DOUBLE)) AS value, max(CAST(floor(epoch(ts)) AS BIGINT)) AS ts FROM events GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM cells),
parts AS (SELECT *, CASE WHEN pos > n - floor(n * CAST(0.3 AS DOUBLE)) THEN 'test' WHEN pos > n - floor(n * (CAST(0.2 AS DOUBLE) + CAST(0.3 AS DOUBLE))) THEN 'valid' ELSE 'train' END AS split FROM ranked),
train AS (SELECT user_id, item_id, value FROM parts WHERE split = 'train'), valid AS (SELECT user_id, item_id FROM parts WHERE split = 'valid')"""


@query(f"""WITH {_ITEM_TEXT_SIMS.replace("rank <= 5", "rank <= 10")}, {_EVENT_SPLIT}, {score_sql('nbrs', 'train', True)}, {lists_sql('scores', 'train', 50)}, {map_sql('recs', 'valid')}
SELECT map, ci95, n FROM maps""")
def text_recipe(spark, sf):
    """Item keywords as the similarity source: items are the text sources, users are the event users rating them."""
    events = fixtures.table(spark, sf, "events")
    ratings = events.groupBy("user_id", (F.col("event_id") % 20).alias("item_id")).agg(F.sum("value").alias("value"), F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("ts"))
    parts = cut(split.by_user_time(ratings))
    train = parts.where(F.col("split") == "train").drop("split")
    nbrs = neighbours(_item_text_cells(spark, sf), 10)
    lists = knn.top_k(knn.score(nbrs, train, item_based=True), train)
    return evaluate.map_at(lists, parts.where(F.col("split") == "valid"), 10)
