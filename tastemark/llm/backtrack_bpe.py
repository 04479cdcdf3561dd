"""BPE encoding without a merge queue: longest matches, checked against the pair-compatibility table, with backtracking.

An Aho-Corasick automaton over the tokens gives the longest token at every place of a word. The encoder walks left to
right and takes the longest token that may stand after the one before it; if none may, it goes one token back and
marks the place as a dead end. Two tokens may stand together if no merge across their border comes before the merges
that made them: the table is filled by undoing the merges of both, latest first, and asking at each step whether the
two pieces at the border would have merged earlier. As every prefix of a word has one encoding only, a place is a dead
end whatever stands before it, so the walk is linear in the word. Decoding gathers from one buffer of all token bytes
through a table of offsets.

The file is that of the tokenizers library: byte-level BPE, read for its vocabulary, merges and added tokens. Words are
cut as the library cuts them; texts with characters outside ``PLAIN``, where Unicode versions may differ, are cut by
the library's own rule. Equal words of a task are encoded once.

Edge cases: null and empty texts have no ids and decode to the empty text. A string of an added token within a text is
that token. Repeated rows give equal ids. A word of any length is encoded in full. Ids outside the vocabulary raise an
error when decoded; bytes that form no character decode to the replacement character, as in the library. Other columns
are not touched.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from tokenizers import Tokenizer

from tastemark.llm.bpe import byte_characters
from tastemark.llm.common import in_pieces

#: Entries that a worker keeps in its table of words and of token pairs; beyond that the table starts anew, which changes no result.
KEPT_WORDS, KEPT_PAIRS = 100_000, 1_000_000
#: Words up to this length are kept.
KEPT_LENGTH = 40
#: The word pattern of the file format.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters for which the pattern's classes have been compared with the library, one by one (in the tests).
BEYOND_PLAIN = regex.compile(r"[^\x00-՗]")


class Encoder:
    """Encoder and decoder of one Python worker; not shared between threads."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, added = file["model"], file["added_tokens"]
        if model["type"] != "BPE" or file.get("normalizer") or file["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path} is no plain byte-level BPE")
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} has model options that change the merges")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        self.words_of = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = {self._bytes(name): i for name, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in added}
        self.added_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        size = 1 + max([*vocabulary.values(), *self.added.values()])

        self.rank, self.parts, self.merge = [-1] * size, [(-1, -1)] * size, {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (vocabulary[self._bytes(x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = vocabulary[self._bytes("".join(pair) if isinstance(pair, list) else pair.replace(" ", ""))]
            if self.rank[whole] >= 0:
                raise ValueError(f"{path} has two merges for one token")
            self.rank[whole], self.parts[whole], self.merge[left, right] = rank, (left, right), rank
        self._tables(vocabulary, size)
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _bytes(self, name: str) -> bytes:
        """A token's bytes from the characters that stand for them; a name with other characters stands for itself."""
        if all(c in self.byte_of for c in name):
            return bytes(self.byte_of[c] for c in name)
        return name.encode()

    def _tables(self, vocabulary: dict[bytes, int], size: int) -> None:
        """Which tokens merges can reach, the automaton over these, each one's next shorter prefix, and the decoder's offsets."""
        reached = [False] * size
        for token, i in sorted(vocabulary.items(), key=lambda x: self.rank[x[1]]):
            left, right = self.parts[i]
            reached[i] = len(token) == 1 if left < 0 else reached[left] and reached[right] and self._border(left, right, 2 * self.rank[i])
        self.automaton, self.length, self.shorter = ahocorasick.Automaton(), [0] * size, [-1] * size
        self.whole: dict[str, int] = {}
        for token, i in vocabulary.items():
            if reached[i]:
                self.length[i] = len(token)
                self.whole[token.decode("latin-1")] = i
                self.automaton.add_word(token.decode("latin-1"), i)
                self.shorter[i] = next((vocabulary[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in vocabulary and reached[vocabulary[token[:n]]]), -1)
        if len(vocabulary) and len(self.whole) and not all(chr(b) in self.whole for b in range(256)):
            raise ValueError("a byte has no token")
        self.automaton.make_automaton()

        spelled = [b""] * size
        for token, i in [*vocabulary.items(), *((self._bytes(content), i) for content, i in self.added.items())]:
            spelled[i] = token
        self.sizes = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.buffer = np.frombuffer(b"".join(spelled), np.uint8)

    def _border(self, left: int, right: int, before: int = 1 << 62) -> bool:
        """Whether merges leave the border between two tokens alone; ``before`` is twice the rank of a merge to come.

        Equal merges go from left to right, so a merge across the border also precedes an equal one in the right token.
        """
        while True:
            across = self.merge.get((left, right))
            if across is not None and 2 * across < before:
                return False
            if self.rank[left] > self.rank[right]:
                before, left = 2 * self.rank[left], self.parts[left][1]
            elif self.rank[right] >= 0:
                before, right = 2 * self.rank[right] + 1, self.parts[right][0]
            else:
                return True

    def _may_follow(self, left: int, right: int) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self._border(left, right)
        return found

    def word(self, word: str) -> list[int]:
        """Ids of one word, given as one character a byte."""
        if word in self.whole:
            return [self.whole[word]]
        length, shorter, may_follow, n = self.length, self.shorter, self._may_follow, len(word)
        longest = [0] * n
        for last, token in self.automaton.iter(word):
            longest[last + 1 - length[token]] = token  # later ends come later, so the longest stays
        taken, dead, at, token = [], bytearray(n + 1), 0, longest[0]
        while at < n:
            while token >= 0 and (dead[at + length[token]] or (taken and not may_follow(taken[-1], token))):
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                last = taken.pop()
                at -= length[last]
                token = shorter[last]
        return taken

    def _text(self, text: str) -> list[int]:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        words = WORDS.findall(text) if BEYOND_PLAIN.search(text) is None else [text[a:b] for _, (a, b) in self.words_of(text)]
        known, out = self.known, []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = tuple(self.word(word.encode().decode("latin-1")))
                if len(word) <= KEPT_LENGTH:
                    known[word] = ids
            out += ids
        return out

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.added_cut is None or self.added_cut.search(text) is None:
            return np.array(self._text(text), "<u4")
        out = []
        for part in self.added_cut.split(text):
            out += [self.added[part]] if part in self.added else self._text(part)
        return np.array(out, "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        size = self.sizes[ids]
        if not size.all():
            raise ValueError("an id has no token")
        total = int(size.sum())
        return self.buffer[np.arange(total) + np.repeat(self.starts[ids] - np.cumsum(size) + size, size)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(text: str | Column, path: str) -> Column:
    """Binary column: the ids as little-endian unsigned 32-bit integers. ``path`` is readable on every executor."""

    @arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path)
        yield from in_pieces(batches, lambda texts: pa.array([e.encode(x).tobytes() for x in texts], pa.binary()), pa.binary())

    return run.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def decode(ids: str | Column, path: str) -> Column:
    """String column: the text that packed ids stand for."""

    @arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path)
        yield from in_pieces(batches, lambda rows: pa.array([e.decode(np.frombuffer(x or b"", "<u4")) for x in rows], pa.string()), pa.string())

    return run.asNondeterministic()(F.col(ids) if isinstance(ids, str) else ids)


def round_trip(text: str | Column, path: str) -> Column:
    """Struct (ids, decoded): packed ids and the text decoded from them, by one Python worker a task."""
    kind = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])

    @arrow_udf("ids binary, decoded string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path)

        def work(texts: list) -> pa.Array:
            ids = [e.encode(x) for x in texts]
            return pa.StructArray.from_arrays([pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([e.decode(x) for x in ids], pa.string())], fields=list(kind))

        yield from in_pieces(batches, work, kind)

    return run.asNondeterministic()(F.col(text) if isinstance(text, str) else text)
