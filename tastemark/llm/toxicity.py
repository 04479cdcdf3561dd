"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

A bounded, stratified sample of labelled rows gives the examples; every word of theirs is in the vocabulary. Markers are
the words and word beginnings whose rate in toxic texts differs surely from that in clean ones, counted by distinct
contexts (the words on both sides), so that copies of one text count once; all other words weigh ``PLAIN`` as much.
Document frequencies cover all documents. The examples stand in an inverted index of blocks with the largest weight of
every term in every block; a query visits blocks in the order of their upper bounds until none can improve its ``k``
nearest, which is exact. Votes fall with distance, and isotonic regression on the examples (each left out once, weighted
to the true label rates) turns them into calibrated scores. Evidence: ids and similarities of the neighbours.

Edge cases: null and empty texts and texts without a word of any example have a zero vector and get the rate of toxic
ones among such examples. Without labels of both kinds every score is the (smoothed) share of toxic labels. Ties in
similarity go to the example first in the index. Repeated texts get equal scores.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tastemark.llm.common import gathered, in_pieces, pieces, sampled

BEGINNINGS = range(4, 8)
#: Words whose vocabulary terms a task remembers; beyond that it starts anew, which changes no result.
MEMO_WORDS = 400_000
#: Weight of a word that is no marker, and of the one component that all texts share, times the root of the number of
#: words: without it the cosine would not tell one chance marker in a long text from many in a short one.
PLAIN, COMMON = 0.02, 0.3
#: Blocks whose examples are scored first; what they give decides which others are read.
FIRST_BLOCKS = 3
_WORD = re.compile(r"[^\W_]+")
_KIND = pa.struct([("score", pa.float64()), ("neighbours", pa.list_(pa.string())), ("similarities", pa.list_(pa.float64()))])


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def terms_of(word: str) -> list[str]:
    """The word and its beginnings of 4 to 7 letters, which inflected and compound forms share."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def select_words(sample: list[tuple[int, str]], least_ratio: float, least_evidence: float) -> list[str]:
    """Terms at least ``least_ratio`` times as frequent by distinct contexts in one label as in the other, whose log-likelihood ratio statistic is ``least_evidence`` or more."""
    contexts: dict[int, set] = {0: set(), 1: set()}
    for label, text in sample:
        ws = ["", *words_of(text), ""]
        contexts[label].update(zip(ws[1:-1], ws[:-2], ws[2:], strict=True))
    count: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for y, c in contexts.items():
        for w, n in Counter(t[0] for t in c).items():
            for term in terms_of(w):
                count[y][term] += n
    share = (len(contexts[1]) + 1.0) / (len(contexts[0]) + len(contexts[1]) + 2.0)
    chosen = []
    for w in count[0].keys() | count[1].keys():
        a, b = count[1][w], count[0][w]
        evidence = sum(2 * n * math.log(n / ((a + b) * p)) for n, p in ((a, share), (b, 1 - share)) if n)
        odds = math.log((a + 0.5) / share) - math.log((b + 0.5) / (1 - share))
        if evidence >= least_evidence and abs(odds) >= math.log(least_ratio):
            chosen.append(w)
    return sorted(chosen)


class Vocabulary(dict):
    """Numbers of the terms; remembers which of them a word has. A word is a term as a whole, its beginnings where they are markers."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.ids = {t: i for i, t in enumerate(terms)}
        #: Numbers of the terms that are beginnings, without their hyphen, and the lengths they have.
        self.heads = {t[:-1]: i for t, i in self.ids.items() if t.endswith("-")}
        self.lengths = sorted({len(t) for t in self.heads})

    def __missing__(self, word: str) -> tuple[int, ...]:
        own = self.ids.get(word)
        size, heads = len(word), self.heads
        found = () if own is None else (own,)
        for n in self.lengths:
            if n < size and (i := heads.get(word[:n])) is not None:
                found += (i,)
        self[word] = found
        return found

    def terms(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """The terms of a text, the count of each, and the number of its words."""
        words = words_of(text)
        if len(self) > MEMO_WORDS:
            self.clear()
        counts = Counter(words)
        found = list(map(self.__getitem__, counts))
        lens = np.fromiter(map(len, found), np.int64, len(found))
        at = np.fromiter(chain.from_iterable(found), np.int64, int(lens.sum()))
        n = np.repeat(np.fromiter(counts.values(), np.int64, len(found)), lens)
        order = np.argsort(at)
        at, n = at[order], n[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
        return at[first], np.add.reduceat(n, first) if len(at) else n, len(words)


class TermCounts:
    """In how many texts each term occurs. Words are counted as they are; the few that begin like a marker one by one."""

    def __init__(self, terms: list[str]):
        self.ids = {t: i for i, t in enumerate(terms)}
        #: Numbers of the terms that are beginnings, without their hyphen.
        self.heads = {t[:-1]: i for t, i in self.ids.items() if t.endswith("-")}
        self.found = np.zeros(len(terms), np.int64)
        self.words: Counter = Counter()
        self.plain: set[str] = set()

    def add(self, text: str | None) -> None:
        words = set(words_of(text))
        self.words.update(words)
        beginnings = set()
        for w in words - self.plain:
            own = [self.heads[w[:n]] for n in BEGINNINGS if len(w) > n and w[:n] in self.heads]
            if own:
                beginnings.update(own)
            else:
                self.plain.add(w)
        for i in beginnings:
            self.found[i] += 1
        if len(self.words) > MEMO_WORDS:
            self.settle()

    def settle(self) -> np.ndarray:
        for w, n in self.words.items():
            i = self.ids.get(w)
            if i is not None:
                self.found[i] += n
        self.words.clear()
        self.plain.clear()
        return self.found


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges end to end, and how many each has."""
    n = stop - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum()), n


class Index:
    """Postings by term and example; the examples of a term fall into blocks, each with its largest weight."""

    def __init__(self, vectors: list[dict[int, float]], labels: list[int], block: int = 64):
        self.labels = np.array(labels, np.float64)
        self.size, self.blocks = len(vectors), -(-len(vectors) // block)
        lens = [len(v) for v in vectors]
        term = np.fromiter((t for v in vectors for t in v), np.int64, sum(lens))
        weight = np.fromiter((w for v in vectors for w in v.values()), np.float64, sum(lens))
        example = np.repeat(np.arange(self.size), lens)
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        keys = term[order] * max(self.blocks, 1) + self.example // block
        #: One cell for each block of a term: where its postings start, the block, and the largest weight.
        cells, start = np.unique(keys, return_index=True)
        self.start = np.append(start, len(keys))
        self.in_block = cells % max(self.blocks, 1)
        self.most = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.of_term = np.searchsorted(cells // max(self.blocks, 1), np.arange(int(term.max()) + 2 if len(term) else 1))

    def nearest(self, query: dict[int, float], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above zero, best first, ties by position. ``without``: one to leave out."""
        return self.nearest_to(np.fromiter(query, np.int64, len(query)), np.fromiter(query.values(), np.float64, len(query)), k, without)

    def nearest_to(self, term: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """As ``nearest``, the query as two arrays."""
        known = term < len(self.of_term) - 1
        term, w = term[known], w[known]
        cells, n = _ranges(self.of_term[term], self.of_term[term + 1])
        w, block = np.repeat(w, n), self.in_block[cells]
        bounds = np.bincount(block, w * self.most[cells], self.blocks)
        left = np.argsort(-bounds, kind="stable")
        left = left[bounds[left] > 0]
        ids, sims, first = np.zeros(0, np.int64), np.zeros(0), FIRST_BLOCKS
        while len(left):
            chosen = np.zeros(self.blocks, bool)
            chosen[left[:first]] = True
            read = chosen[block]
            cell = cells[read]
            at, m = _ranges(self.start[cell], self.start[cell + 1])
            score = np.bincount(self.example[at], np.repeat(w[read], m) * self.weight[at], self.size)
            hit = np.flatnonzero(score > 0)
            hit = hit[hit != without]
            ids, sims = np.concatenate([ids, hit]), np.concatenate([sims, np.round(score[hit], 12)])
            order = np.lexsort((ids, -sims))[:k]
            ids, sims = ids[order], sims[order]
            left = left[first:]
            if len(sims) == k:
                left = left[bounds[left] >= sims[-1] - 1e-9]
            first = self.blocks
        return ids, sims


class Model:
    def __init__(self, terms: list[str], idf: np.ndarray, sample: list[tuple[int, str, object]], rates: dict[int, float], k: int, prior_votes: float):
        """``idf``: of each term, with the weight of markers in it."""
        self.vocabulary = Vocabulary(terms)
        self.idf, self.k, self.prior_votes = idf, k, prior_votes
        vectors = [self.vector(text) for _, text, _ in sample]
        labels = [y for y, _, _ in sample]
        in_sample = Counter(labels)
        weight = np.array([rates[y] / in_sample[y] for y in labels])
        self.base = (rates[1] + 1e-3) / (rates[0] + rates[1] + 2e-3)
        # examples with much in common stand together: first by label, then by the share of the component of all texts
        kept = sorted((i for i, v in enumerate(vectors) if v), key=lambda i: (labels[i], vectors[i][len(idf)], i))
        zero = np.array([not v for v in vectors], bool)
        y = np.array(labels, np.float64)
        # one observation of each base rate smooths the share of the texts without any word of the vocabulary
        unit = weight.mean() if len(weight) else 1.0
        self.zero_score = float(((weight * y)[zero].sum() + self.base * unit) / (weight[zero].sum() + unit))
        self.ids = [str(sample[i][2]) for i in kept]
        self.index = Index([vectors[i] for i in kept], [labels[i] for i in kept])
        raw = np.array([self.vote(*self.index.nearest(vectors[i], self.k, j)) for j, i in enumerate(kept)])
        self.steps = isotonic(raw, y[kept], weight[kept]) if kept else (np.array([0.0]), np.array([self.base]))

    def weights(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector over the vocabulary as terms and weights; empty where no word of it occurs."""
        at, n, n_words = self.vocabulary.terms(text)
        if not len(at):
            return at, np.zeros(0)
        x = np.append((1 + np.log(n)) * self.idf[at], COMMON * math.sqrt(n_words))
        return np.append(at, len(self.idf)), x / np.sqrt(x @ x)

    def vector(self, text: str | None) -> dict[int, float]:
        at, x = self.weights(text)
        return dict(zip(at.tolist(), x.tolist(), strict=True))

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        votes = 1 / (1.05 - np.minimum(sims, 1.0))
        return float((votes @ self.index.labels[ids] + self.prior_votes * self.base) / (votes.sum() + self.prior_votes))

    def score(self, text: str | None) -> dict:
        at, x = self.weights(text)
        if not len(at):
            return {"score": self.zero_score, "neighbours": [], "similarities": []}
        ids, sims = self.index.nearest_to(at, x, self.k)
        return {"score": float(np.interp(self.vote(ids, sims), *self.steps)), "neighbours": [self.ids[i] for i in ids], "similarities": sims.tolist()}


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x (pool adjacent violators), for linear interpolation."""
    blocks: list[list[float]] = []
    for v in np.unique(x):
        at = x == v
        blocks.append([float((weight * y)[at].sum()), float(weight[at].sum()), v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], high]
    xs = np.array([v for b in blocks for v in b[2:]])
    ys = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return xs, np.clip(ys, 0.0, 1.0)


def document_frequencies(docs: DataFrame, terms: list[str], text_col: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and of those that each term of a bounded vocabulary occurs in, over all rows."""
    packed = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = TermCounts(packed.value), 0
        for batch in batches:
            for piece in pieces(batch.column(0)):
                for text in piece.to_pylist():
                    n += 1
                    counts.add(text)
        found = counts.settle()
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"word": np.append(-1, seen).astype(np.int32), "n": np.append(n, found[seen])}, pa.schema([("word", pa.int32()), ("n", pa.int64())]))

    told = docs.select(text_col).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    word, n = told["word"].to_numpy(), told["n"].to_numpy()
    df = np.zeros(len(terms), np.float64)
    df[word[word >= 0]] = n[word >= 0]
    return int(n[word < 0].sum()), df


def train(docs: DataFrame, labels: DataFrame, label: str = "label", per_label: int = 1500, max_chars: int = 20_000, k: int = 15, least_ratio: float = 4.0, least_evidence: float = 25.0, prior_votes: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most about ``per_label`` rows of each label (0 or 1) of ``labels`` (id, label), ``max_chars`` code points of each.

    The labels are sampled before their texts are looked up, so the join broadcasts a number of ids bounded by
    ``per_label`` and no text is shuffled.
    """
    labels = labels.filter(F.col(label).isin(0, 1)).select(F.col(id_col).alias("_labelled"), F.col(label).cast("int").alias("_label"))
    counts = {r[0]: r[1] for r in labels.groupBy("_label").count().collect()}
    drawn = F.broadcast(sampled(labels, "_label", per_label, 1010, "_labelled").distinct())
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(drawn, F.col("_id") == F.col("_labelled"))
    sample = [(r["label"], r["text"], r["id"]) for r in gathered(texts, "_label", per_label, 1010, max_chars, "_id", "_text")]
    total = sum(counts.values()) or 1
    rates = {y: counts.get(y, 0) / total for y in (0, 1)}
    markers = select_words([(y, text) for y, text, _ in sample], least_ratio, least_evidence) if len({y for y, _, _ in sample}) == 2 else []
    terms = sorted({*markers, *(w for _, text, _ in sample for w in words_of(text))})
    n, df = document_frequencies(docs, terms, text_col) if terms else (0, np.zeros(0))
    chosen = set(markers)
    marked = np.array([t in chosen for t in terms], bool)
    return Model(terms, (np.log((n + 1) / (df + 1)) + 1) * np.where(marked, 1.0, PLAIN), sample, rates, k, prior_votes)


def score(model: Model, text: str | Column) -> Column:
    """Struct (score, neighbours, similarities); neighbours are the ids of the nearest examples as text, nearest first."""
    packed = SparkSession.active().sparkContext.broadcast(pickle.dumps(model))

    @arrow_udf("score double, neighbours array<string>, similarities array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = pickle.loads(packed.value)
        yield from in_pieces(batches, lambda texts: pa.array([fitted.score(t) for t in texts], _KIND), _KIND)

    return run.asNondeterministic()(F.col(text) if isinstance(text, str) else text)
