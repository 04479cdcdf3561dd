import math
import re

from pyspark.sql import functions as F

from tastemark.functions import scalars, textual
from tastemark.lookups import STOP_WORDS
from tastemark.operators import clean, highlights, vectors


def value(spark, expr, **cols):
    names = ", ".join(f"{k} string" for k in cols)
    return spark.createDataFrame([tuple(cols.values())], names).select(expr.alias("x")).first()[0]


def mark(text, resets=(",", ".", "?", ";", "however", "but")):
    words, flag = text.lower().split(), False
    for j, w in enumerate(words):
        if w == "not":
            flag = True
            continue
        if flag:
            words[j] = "not_" + w
            flag = not any(r in w for r in resets)
    return " ".join(words)


def test_negation_scope(spark):
    cases = [
        "not good, but the butter", "I do NOT like the butter here at all", "not", "nothing, not. a not b", "not not x? y",
        "a knot not tied; ok not open however\nnot closed", "", "fine", "it was not what I\twanted  but ok", "not a not b, c not d",
    ]
    for text in cases:
        assert value(spark, textual.mark_negation(F.col("t")), t=text) == mark(text), text


def test_clean_tokens_and_lemmas(spark):
    words = value(spark, textual.clean_tokens(F.col("t"), lemmas={"dishes": "dish"}), t="The 2 dishes were not good, &lt;b&gt;x but the butter")
    assert words == ["dish", "not_good", "lt", "gt", "x", "butter"]
    assert value(spark, textual.clean_tokens(F.col("t")), t="") == []
    assert "the" in STOP_WORDS


def test_tokens(spark):
    text = "Ice-cream, a-b & hot-pot! Wow..."
    pattern = r"[\w]+-[\w]+[-\[\w]+\]?|[\w]+|[.,!?;]"
    assert value(spark, textual.tokens(F.col("t")), t=text) == re.findall(pattern, text)


def test_contractions_in_order(spark):
    assert value(spark, textual.expand_contractions(F.col("t")), t="it's hotpot and ice cream, don't") == "it has hot pot and ice-cream, do not"


def test_ngrams(spark):
    words = F.split("t", " ")
    assert value(spark, textual.ngrams(words, 2), t="a b c") == ["a b", "b c"]
    assert value(spark, textual.ngrams(words, 3), t="a b") == []
    assert value(spark, textual.ngram_range(words, 1, 2), t="a b") == ["a", "b", "a b"]


def test_compound(spark):
    lexicon = {"good": 2.0, "bad": -1.5}
    c = textual.compound(F.split("t", " "), lexicon)

    def want(s):
        return round(s / math.sqrt(s * s + 15), 4)

    assert value(spark, c, t="good food") == want(2.0)
    assert value(spark, c, t="not so very good but bad") == want(2.0 * -0.74 - 1.5)
    assert value(spark, c, t="not a b c good") == want(2.0)
    assert value(spark, c, t="plain") == 0.0


def test_parsing(spark):
    assert value(spark, scalars.category_text(F.col("t")), t="[{'alias': 'x', 'title': 'X'}]") == "X"
    assert value(spark, scalars.category_text(F.col("t")), t="[{'alias': 'x', 'title': 'X'}, {'alias': 'y', 'title': \"Y's\"}]") == "X, Y's"
    assert value(spark, scalars.coordinates(F.col("t"))["latitude"], t="{'latitude': None, 'longitude': -79.1}") is None
    assert value(spark, scalars.coordinates(F.col("t"))["longitude"], t="{'latitude': None, 'longitude': -79.1}") == -79.1
    assert value(spark, scalars.display_address(F.col("t")), t="{'display_address': ['1 A St', 'B'], 'zip': None}") == "1 A St, B"
    assert value(spark, scalars.price_label(F.lit(None).cast("string")), t="") is None
    assert value(spark, scalars.price_words(F.lit(4)), t="") == "fine dining"


def test_distances(spark):
    args = [F.lit(x) for x in (43.779824, -79.415665, 43.6561, -79.3802)]
    assert abs(value(spark, scalars.ellipsoid_km(*args), t="") - 14.0334) < 0.02
    assert abs(value(spark, scalars.haversine_km(*args), t="") - 14.0) < 0.1
    assert value(spark, scalars.ellipsoid_km(args[0], args[1], args[0], args[1]), t="") == 0.0


def test_tfidf_uses_the_train_vocabulary(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "a")], "doc long, t string")
    counts = vectors.term_counts(docs, F.split("t", " "), ["doc"])
    vocab = vectors.vocabulary(counts, "doc", docs, max_df=0.9)
    assert sorted(r.term for r in vocab.collect()) == ["b", "c"]  # a is in every text
    new = spark.createDataFrame([(9, "b c d")], "doc long, t string")
    got = {r.term: r.value for r in vectors.tfidf(vectors.term_counts(new, F.split("t", " "), ["doc"]), vocab, "doc").collect()}
    assert set(got) == {"b", "c"} and abs(sum(v * v for v in got.values()) - 1) < 1e-12
    assert abs(got["b"] - math.sqrt(0.5)) < 1e-12


def test_concat_in_parts(spark):
    docs = spark.createDataFrame([("x", i, f"w{i}") for i in range(25)] + [("y", 3, "z")], "k string, i long, text string")
    parts = vectors.concat_texts(docs, "k", "i", separator=" ", part_reviews=10).orderBy("k", "part").collect()
    assert [r.reviews for r in parts] == [10, 10, 5, 1]
    assert " ".join(r.text for r in parts if r.k == "x") == " ".join(f"w{i}" for i in range(25))
    fused = vectors.concat_texts(docs, "k", "i", separator="").where("k = 'x'").first()
    assert fused.text == "".join(f"w{i}" for i in range(25))


def test_highlights(spark):
    tag = textual.tagger({"great": "J", "spicy": "J", "fresh": "J", "bad": "J", "noodle": "N", "soup": "N", "rice": "N"})
    reviews = spark.createDataFrame([
        ("b", 1, "Great noodle soup. The rice was very fresh!"), ("b", 2, "Spicy noodle; great noodle soup, bad rice"), ("b", 3, "noodle noodle"), ("c", 4, "Nothing"),
    ], "item string, review_id long, text string")
    tokens = highlights.review_tokens(reviews)
    found = highlights.phrases(tokens, tag)
    assert {r.phrase for r in found.collect()} == {"great noodle soup", "spicy noodle", "bad rice", "rice was fresh"}
    scores = {r.noun: (r.occurrences, r.reviews, r.score) for r in highlights.noun_scores(tokens, highlights.nouns(found, tag)).collect()}
    assert scores == {"noodle": (5, 3, 15), "soup": (2, 2, 4), "rice": (2, 2, 4)}
    final = highlights.highlight(reviews, tag, {"great": 3.0, "fresh": 2.0, "bad": -2.0})
    got = [(r.noun_rank, r.noun, r.phrase) for r in final.orderBy("noun_rank").collect()]
    # the best phrase of the first noun is not used again for the third
    assert got == [(1, "noodle", "great noodle soup"), (2, "rice", "rice is fresh")]
    assert highlights.explain(final).first().explanation == "great noodle soup and rice is fresh"


def test_sentiment_in_context_checks_containment(spark):
    phrases = spark.createDataFrame([("b", "ice cream", 1), ("b", "old tea", 1)], "item string, phrase string, pattern int")
    reviews = spark.createDataFrame([("b", 1, "A nice cream cake. good"), ("b", 2, "ice  cream good"), ("c", 3, "ice cream good"), ("b", 4, "bad ice creams")], "item string, review_id long, text string")
    out = {r.phrase: (r.sentiment, r.units) for r in highlights.sentiment_in_context(phrases, highlights.text_units(reviews), {"good": 2.0, "bad": -2.0}).collect()}
    assert out == {"ice cream": (0.0, 2), "old tea": (0.0, 0)}


def test_restaurant_selection_rules(spark):
    rows = [
        (1, "Pizza", "a", "$", 10), (2, "Pizza, Spas", "b", "$", 10), (3, "Caterers", "c", None, 10), (4, "Food, fooddeliveryservices", "d", "$", 6),
        (5, "Sushi", "soho-ktv", "$", 9), (6, "Bakeries, bubbletea", "tasty-pot", "$", 9), (7, "Sushi", "mika-sushi", "$", 9), (8, "Books", "e", "$", 9),
    ]
    df = spark.createDataFrame(rows, "id int, categories string, alias string, price string, review_count int")
    assert sorted(r.id for r in clean.select_restaurants(df).collect()) == [1, 6, 7, 7]
