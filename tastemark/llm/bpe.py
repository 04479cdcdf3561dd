"""Byte-level BPE encoding and decoding with the tokenizers library, for vocabularies given as byte ranks.

The ranks are turned into the library's vocabulary and merges: every way to put a token together from two other tokens
is a merge, ordered by the token's rank. Texts are cut before blanks that follow a non-blank, where no match of the
pattern can cross, so the library encodes each distinct piece of a task once and the ids of a text are gathered from
these. Ids are kept as packed little-endian 32-bit integers. Decoding reverses the byte table; a character split over
several tokens comes out whole because bytes, not characters, are joined.

Edge cases: null and empty texts have no ids and decode to zero bytes. Repeated rows give equal ids. Lone surrogates
cannot occur in Spark strings. Ids outside the vocabulary raise an error when decoded.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from tokenizers import Regex, Tokenizer, pre_tokenizers
from tokenizers.models import BPE

from tastemark.llm.common import in_pieces

#: Distinct pieces kept per task; beyond that the table starts anew, which changes no result.
CACHE_PIECES = 120_000
#: Pieces given to the library in one call.
CALL_PIECES = 8_000
_CUT = re.compile(r"(?<=\S)(?= )")
_DOUBLE = re.compile(r"\s ")


def byte_characters() -> list[str]:
    """The library's character for every byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def build(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    shown = byte_characters()
    name = lambda token: "".join(map(shown.__getitem__, token))
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        for i in range(len(token) - 1, 0, -1):
            if token[:i] in ranks and token[i:] in ranks:
                merges.append((name(token[:i]), name(token[i:])))
    tokenizer = Tokenizer(BPE({name(t): r for t, r in ranks.items()}, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


class Codec:
    """Encoder and decoder of one Python worker; not shared between threads."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks = read_ranks(path)
        self.tokenizer = build(ranks, pattern)
        self.bytes_of = np.full(max(ranks.values(), default=-1) + 1, None, object)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces not seen before; each is a word of the library's input."""
        ids, counts = [self.ids], []
        for low in range(0, len(pieces), CALL_PIECES):
            part = pieces[low : low + CALL_PIECES]
            found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, "<u4"))
            counts.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
        self.ids = np.concatenate(ids)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > CACHE_PIECES:
            self._forget()
        known, before, rows = self.known, len(self.known), []
        for text in texts:
            if not text:
                parts = []
            elif _DOUBLE.search(text):
                parts = _CUT.split(text)
            else:
                head, *rest = text.split(" ")
                parts = [head] * bool(head) + [" " + p for p in rest]
            rows.append(np.array([known.setdefault(p, len(known)) for p in parts], np.int64))
        if len(known) > before:
            self._learn(list(known)[before:])
        out = []
        for row in rows:
            start, size = self.ends[row], self.ends[row + 1] - self.ends[row]
            total = int(size.sum())
            place = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
            out.append(self.ids[place])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes_of[ids].tolist())

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one code point that each token has bytes of; parts of one split character share it."""
        data = np.frombuffer(self.decode(ids), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        size = np.array([len(b) for b in self.bytes_of[ids].tolist()], np.int64)
        end = np.cumsum(size)
        return char[end - size], char[end - 1] + 1


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(text: str | Column, path: str, pattern: str) -> Column:
    """Binary column: the ids as little-endian unsigned 32-bit integers. ``path`` is readable on every executor."""

    @arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        yield from in_pieces(batches, lambda texts: pa.array([x.tobytes() for x in c.encode(texts)], pa.binary()), pa.binary())

    return run.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def round_trip(text: str | Column, path: str, pattern: str) -> Column:
    """Struct (ids, decoded): the packed ids and the bytes decoded from them, by one Python worker per task."""
    kind = pa.struct([("ids", pa.binary()), ("decoded", pa.binary())])

    @arrow_udf("ids binary, decoded binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)

        def work(texts: list) -> pa.Array:
            ids = c.encode(texts)
            return pa.StructArray.from_arrays([pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([c.decode(x) for x in ids], pa.binary())], fields=list(kind))

        yield from in_pieces(batches, work, kind)

    return run.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def decode(ids: str | Column, path: str, pattern: str) -> Column:
    """Binary column: the bytes that packed ids stand for."""

    @arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        yield from in_pieces(batches, lambda rows: pa.array([c.decode(np.frombuffer(x or b"", "<u4")) for x in rows], pa.binary()), pa.binary())

    return run.asNondeterministic()(F.col(ids) if isinstance(ids, str) else ids)


def token_offsets(ids: str | Column, path: str, pattern: str) -> Column:
    """Array of structs (start, end), in code points of the text that the packed ids decode to."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @arrow_udf("array<struct<start:int,end:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)

        def work(rows: list) -> pa.Array:
            pairs = [c.offsets(np.frombuffer(x or b"", "<u4")) for x in rows]
            return pa.array([[{"start": int(a), "end": int(b)} for a, b in zip(s, e, strict=True)] for s, e in pairs], kind)

        yield from in_pieces(batches, work, kind)

    return run.asNondeterministic()(F.col(ids) if isinstance(ids, str) else ids)
