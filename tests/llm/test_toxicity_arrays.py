"""Texts become arrays of terms and weights directly: equal to counting word by word."""

import math
import random

import numpy as np

from tastemark.llm import toxicity


def test_terms_of_a_text_equal_a_count_word_by_word():
    rng = random.Random(3)
    words = ["damn", "damned", "damnation", "fools", "foolish", "the", "a", "zebra", "unknown"]
    vocabulary = toxicity.Vocabulary(["a", "damn", "damn-", "damned", "fool-", "the", "zebra"])
    for size in (0, 1, 5, 40):
        text = " ".join(rng.choices(words, k=size))
        want: dict = {}
        for w in toxicity.words_of(text):
            for t in toxicity.terms_of(w):
                if t in vocabulary.ids:
                    want[vocabulary.ids[t]] = want.get(vocabulary.ids[t], 0) + 1
        at, n, n_words = vocabulary.terms(text)
        assert dict(zip(at.tolist(), n.tolist())) == want and at.tolist() == sorted(want) and n_words == size
    assert vocabulary.terms(None)[2] == 0


def test_scores_come_from_arrays_without_a_mapping_per_text(monkeypatch):
    sample = [(y, f"{w} common words here", f"{w}{y}") for y, ws in ((1, ("awful", "vile", "nasty")), (0, ("nice", "calm", "kind"))) for w in ws]
    terms = sorted({w for _, text, _ in sample for w in toxicity.words_of(text)})
    model = toxicity.Model(terms, np.ones(len(terms)), sample, {0: 0.5, 1: 0.5}, 2, 1.0)
    vector, near = model.vector("vile words"), model.index.nearest(model.vector("vile words"), 2)
    assert math.isclose(sum(x * x for x in vector.values()), 1.0)
    monkeypatch.setattr(toxicity.Model, "vector", lambda self, text: 1 / 0)  # made one mapping for every text before
    told = model.score("vile words")
    assert told["neighbours"] == [model.ids[i] for i in near[0]] and told["similarities"] == near[1].tolist() and told["neighbours"][0] == "vile1"
