"""Backtracking BPE against the tokenizers library: whole tables, every character, hard words, damaged ids."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tastemark.llm import backtrack_bpe, queries


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.MERGES)


@pytest.fixture(scope="module")
def encoder():
    return backtrack_bpe.encoder(queries.MERGES)


def same(library, encoder, text: str) -> None:
    ids = library.encode(text, add_special_tokens=False).ids
    got = encoder.encode(text)
    assert got.tolist() == ids, text[:200]
    assert encoder.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_query_against_library(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op12_backtrack_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded))


def test_plain_characters_are_cut_as_the_library_cuts(encoder):
    for code in range(0x558):
        for text in (f"x{chr(code)}x", f" {chr(code)}1 {chr(code)}{chr(code)}\n"):
            assert [m.span() for m in backtrack_bpe.WORDS.finditer(text)] == [tuple(span) for _, span in encoder.words_of(text)], hex(code)


def test_characters_beyond(library, encoder):
    step = 97
    for code in [*range(0x558, 0xD800, step), *range(0xE000, 0x110000, step), 0x558, 0x2028, 0x3000, 0x1F600, 0x10940]:
        same(library, encoder, f"a{chr(code)}b {chr(code)}{chr(code)} 1{chr(code)}")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "\n", "é", "the", "'s", "1", "<|endoftext|>", "<|endof", "漢", "😀", "\t", "..", "ing", " ", "ﬁ", "\x00"]), max_size=40).map("".join))
def test_random_texts(library, encoder, text):
    same(library, encoder, text)


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 50_000, " " * 70_000 + "x", "\n" * 50_001, "é" * 40_000, "aA1!" * 20_000, "".join(random.Random(3).choices("abcdehilnorst", k=60_000))])
def test_long_words(library, encoder, text):
    same(library, encoder, text)


def test_border_table_against_merging(encoder):
    """Two tokens may stand together just if encoding their bytes gives these two back."""
    draw = random.Random(5)
    tokens = sorted(encoder.whole, key=encoder.whole.get)
    for _ in range(4000):
        left, right = draw.choice(tokens[: draw.choice([300, 3000, 50_000])]), draw.choice(tokens[: draw.choice([300, 3000, 50_000])])
        a, b = encoder.whole[left], encoder.whole[right]
        parts = [*map(encoder.whole.__getitem__, left + right)]
        while True:  # the lowest merge first, the leftmost of equal ones
            ranks = [encoder.merge.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            if not ranks or min(ranks) == 1 << 60:
                break
            i = ranks.index(min(ranks))
            whole = next(t for t, p in enumerate(encoder.parts) if encoder.rank[t] == ranks[i])
            parts[i : i + 2] = [whole]
        assert (parts == [a, b]) == encoder._may_follow(a, b)


def test_few_kept_words_change_nothing(library, encoder, monkeypatch):
    monkeypatch.setattr(backtrack_bpe, "KEPT_WORDS", 2)
    monkeypatch.setattr(backtrack_bpe, "KEPT_PAIRS", 3)
    for text in ("one two three, four", "three one ultraviolets", "two one"):
        same(library, encoder, text)


def test_columns(spark, library):
    texts = ["", None, "Über uns.", "a  b", "a  b", "<|endoftext|>x"]
    rows = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "id long, text string, ids string, decoded string")
    packed = rows.select("id", backtrack_bpe.encode("text", queries.MERGES).alias("packed"))
    got = packed.select("id", "packed", backtrack_bpe.decode("packed", queries.MERGES).alias("back")).orderBy("id").collect()
    assert [r["back"] for r in got] == [t or "" for t in texts]
    assert [np.frombuffer(r["packed"], "<u4").tolist() for r in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert rows.limit(0).select(backtrack_bpe.round_trip("text", queries.MERGES).alias("r")).collect() == []


def test_ids_of_half_a_character_and_wrong_ids(library, encoder):
    ids = library.encode("漢字😀", add_special_tokens=False).ids
    for cut in (ids[1:], ids[:-1], ids[::-1]):
        assert encoder.decode(np.array(cut, "<u4")) == library.decode(cut, skip_special_tokens=False)
    with pytest.raises(IndexError):
        encoder.decode(np.array([60_000], "<u4"))
