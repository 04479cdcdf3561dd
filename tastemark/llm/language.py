"""Language identification by a linear-chain conditional random field over words.

Every word has features: its character n-grams with boundary marks (the marked ones are its affixes) and its entry in a
lexicon of frequent training words. Feature and transition weights are fitted together on a bounded sample; the
forward-backward algorithm then gives each word of a text, code-switched or not, its label probabilities.

Edge cases: a null text or one without a letter is ``und`` with score 0. Without any labelled row every text is ``und``.
Ties go to the label first in sort order. Repeated rows get equal results. Extra columns of the input do not matter.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tastemark.llm.common import in_pieces, labelled_sample

UNKNOWN = "und"
NGRAMS = (2, 3, 4)
BUCKET_BITS = 16
BLOCK = 128
#: All ASCII bytes but letters become blanks.
_BLANKS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_KIND = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()), ("switches", pa.int64()), ("certainty", pa.float64())])


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    lexicon: dict[bytes, int]  # word to its row in lexicon_weights
    lexicon_weights: np.ndarray  # (words + 1) x labels; the last row is for all other words
    transitions: np.ndarray  # labels x labels, log
    start: np.ndarray  # labels, log


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_BLANKS).split()


def _has_letter(word: bytes) -> bool:
    return any(map(str.isalpha, word.decode("utf-8", "replace")))


def ngram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words (at most one per place and length) and the word each belongs to."""
    joined = "\x02" + "\x03\x02".join(w.decode("utf-8", "replace") for w in words) + "\x03"
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.cumsum(code == 2) - 1
    buckets, owners = [], []
    for n in NGRAMS:
        if len(code) < n:
            continue
        m = len(code) - n + 1
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ code[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = word[:m] == word[n - 1 :]
        buckets.append((h[inside] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(word[:m][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def word_scores(model: Model, words: list[bytes]) -> np.ndarray:
    """Log potential of every label for every (distinct) word."""
    buckets, owners = ngram_buckets(words)
    out = np.empty((len(words), len(model.labels)))
    for k in range(len(model.labels)):
        out[:, k] = np.bincount(owners, model.weights[:, k][buckets], len(words))
    other = len(model.lexicon)
    return out + model.lexicon_weights[[model.lexicon.get(w, other) for w in words]]


def forward_backward(scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Label probabilities of every word of several chains laid end to end; ``starts`` marks each chain's first word.

    Exact: the words are cut into blocks, each block's product of transition and word potentials is found for all
    blocks at once, the products are chained, and the words inside the blocks follow, again for all blocks at once.
    With ``pairs`` also the expected number of each transition.
    """
    n, k = scores.shape
    size = min(BLOCK, max(1, n))
    blocks = -(-n // size)
    e = np.ones((blocks * size, k))
    e[:n] = np.exp(np.clip(scores - scores.max(1, keepdims=True), -60, 0))
    e = e.reshape(blocks, size, k)
    new = np.ones(blocks * size, bool)  # what fills the last block begins chains of its own
    new[:n] = starts
    new[0] = True
    new = new.reshape(blocks, size)
    a, pi = np.exp(transitions - transitions.max()), np.exp(start - start.max())

    prod = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(size):
        step = (prod.reshape(-1, k) @ a).reshape(blocks, k, k)
        if (r := new[:, t]).any():
            step[r] = prod[r].sum(2, keepdims=True) * pi
        prod = step * e[:, t, None, :]
        prod /= prod.max((1, 2), keepdims=True)
    first, last = np.empty((blocks, k)), np.empty((blocks, k))
    v = np.ones(k)
    for b in range(blocks):
        first[b] = v
        v = v @ prod[b]
        v /= v.sum()
    v = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        last[b] = v
        v = prod[b] @ v
        v /= v.sum()

    alpha = np.empty((blocks, size, k))
    v = first
    for t in range(size):
        v = np.where(new[:, t, None], v.sum(1, keepdims=True) * pi, v @ a) * e[:, t]
        v = v / v.sum(1, keepdims=True)
        alpha[:, t] = v
    beta = np.empty((blocks, size, k))
    v = last
    for t in range(size - 1, -1, -1):
        beta[:, t] = v
        w = e[:, t] * v
        v = np.where(new[:, t, None], (w * pi).sum(1, keepdims=True), w @ a.T)
        v = v / v.sum(1, keepdims=True)
    post = alpha * beta
    post = (post / post.sum(2, keepdims=True)).reshape(-1, k)[:n]
    if not pairs:
        return post
    inner = ~new.reshape(-1)[1:n]
    left, right = alpha.reshape(-1, k)[: n - 1][inner], (e * beta).reshape(-1, k)[1:n][inner]
    total = ((left @ a) * right).sum(1)
    return post, a * (left.T @ (right / total[:, None]))


def fit(sample: list[tuple[str, str]], rounds: int = 30, rate: float = 0.3, decay: float = 1e-5, lexicon_size: int = 4000, seed: int = 7) -> Model | None:
    """Fit all weights by maximum likelihood (Adam) on labelled texts.

    Half of the words stay in their texts; the others are cut into short runs and mixed across texts, so the
    transitions are learned from code-switched chains as well. None without any labelled word.
    """
    labels = sorted({label for label, _ in sample})
    texts = [(labels.index(label), ws) for label, text in sample if (ws := [w for w in words_of(text) if _has_letter(w)])]
    if not texts:
        return None
    rng, chains, runs = np.random.default_rng(seed), [], []
    for y, ws in texts:
        chains.append([(y, ws[: len(ws) // 2 + 1])])
        rest = ws[len(ws) // 2 + 1 :]
        while rest:
            n = int(rng.integers(4, 40))
            runs.append((y, rest[:n]))
            rest = rest[n:]
    order = rng.permutation(len(runs))
    chains += [[runs[i] for i in order[s : s + 6]] for s in range(0, len(runs), 6)]
    ids: dict[bytes, int] = {}
    seq, gold, starts = [], [], []
    for chain in chains:
        for j, (y, ws) in enumerate(chain):
            seq += [ids.setdefault(w, len(ids)) for w in ws]
            gold += [y] * len(ws)
            starts += [j == 0, *[False] * (len(ws) - 1)]
    words, seq, gold, starts = list(ids), np.array(seq), np.array(gold), np.array(starts)
    k, n = len(labels), len(seq)
    lexicon = {w: i for i, (w, _) in enumerate(sorted(Counter(w for _, ws in texts for w in ws).items(), key=lambda x: (-x[1], x[0]))[:lexicon_size])}
    entry = np.array([lexicon.get(w, len(lexicon)) for w in words])
    buckets, owners = ngram_buckets(words)
    params = {"w": np.zeros((1 << BUCKET_BITS, k)), "l": np.zeros((len(lexicon) + 1, k)), "t": np.zeros((k, k)), "s": np.zeros(k)}
    moment = {p: (np.zeros_like(v), np.zeros_like(v)) for p, v in params.items()}
    inner = ~starts[1:]
    true_pairs = np.zeros((k, k))
    np.add.at(true_pairs, (gold[:-1][inner], gold[1:][inner]), 1)
    for r in range(1, rounds + 1):
        per_word = np.stack([np.bincount(owners, params["w"][:, c][buckets], len(words)) for c in range(k)], 1) + params["l"][entry]
        post, seen = forward_backward(per_word[seq], starts, params["t"], params["s"], pairs=True)
        miss = -post
        miss[np.arange(n), gold] += 1
        by_word = np.stack([np.bincount(seq, miss[:, c], len(words)) for c in range(k)], 1)
        grad = {
            "w": np.stack([np.bincount(buckets, by_word[:, c][owners], 1 << BUCKET_BITS) for c in range(k)], 1) / n,
            "l": np.stack([np.bincount(entry, by_word[:, c], len(lexicon) + 1) for c in range(k)], 1) / n,
            "t": (true_pairs - seen) / n,
            "s": miss[starts].sum(0) / n,
        }
        for p, g in grad.items():
            g = g - decay * params[p]
            m, v = moment[p]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            params[p] += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-5)
    return Model(labels, params["w"].astype(np.float32), lexicon, params["l"], params["t"], params["s"])


#: Bytes of text labelled at once: several arrays of words by labels are held for them.
PIECE_BYTES = 1 << 19


def label_words(model: Model | None, texts: list[str | None]) -> list[tuple[list[bytes], np.ndarray]]:
    """Words and their label probabilities, per text; all texts of the call share one pass."""
    split = [words_of(t) if t else [] for t in texts]
    lens = np.array([len(ws) for ws in split], np.int64)
    if model is None or not lens.sum():
        return [(ws, np.zeros((len(ws), 0))) for ws in split]
    ids: dict[bytes, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) for ws in split for w in ws])
    starts = np.zeros(len(seq), bool)
    ends = np.cumsum(lens)
    starts[(ends - lens)[lens > 0]] = True
    post = forward_backward(word_scores(model, list(ids))[seq], starts, model.transitions, model.start)
    return [(ws, post[e - n : e]) for ws, e, n in zip(split, ends, lens, strict=True)]


def _predict(model: Model | None, texts: list[str | None]) -> pa.Array:
    out = []
    for words, post in label_words(model, texts):
        if not post.size or not any(map(_has_letter, words)):
            out.append({"lang": UNKNOWN, "score": 0.0, "n_words": len(words), "switches": 0, "certainty": 0.0})
            continue
        share = post.mean(0)
        best = int(np.argmax(np.round(share, 9)))
        top = post.argmax(1)
        out.append({"lang": model.labels[best], "score": min(1.0, float(share[best])), "n_words": len(words), "switches": int((top[1:] != top[:-1]).sum()), "certainty": min(1.0, float(post.max(1).mean()))})
    return pa.array(out, _KIND)


def train(docs: DataFrame, per_label: int = 120, max_chars: int = 6000, label: str = "lang") -> Model | None:
    """Fit on a bounded sample: about ``per_label`` rows of each label, ``max_chars`` code points of each at most."""
    return fit(labelled_sample(docs, label, per_label, 101, max_chars))


def identify(model: Model | None, text: str | Column) -> Column:
    """Struct (lang, score, n_words, switches, certainty) of a text column.

    score is the mean probability of ``lang`` over all words, certainty that of each word's own best label.
    """
    packed = pickle.dumps(model)

    @arrow_udf("lang string, score double, n_words long, switches long, certainty double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = pickle.loads(packed)
        yield from in_pieces(batches, lambda texts: _predict(fitted, texts), _KIND, PIECE_BYTES)

    return predict.asNondeterministic()(F.col(text) if isinstance(text, str) else text)
