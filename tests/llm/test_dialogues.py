"""Conversation repair: the matrices against all edit sequences, the query's rows against a plain programme over rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tastemark.llm import dialogues, queries

GOOD = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def all_edits(letters: str, most_inserted: int) -> tuple[int, str]:
    """Least (cost, audit) over every edit sequence with at most so many insertions in a gap."""
    rows = []
    for x in letters:
        ways = [("D", "", 2)]
        if x != "x":
            extra = 5 if x.isupper() else 0
            ways += [("K", x.lower(), extra), ("R", "u", 1 + extra), ("R", "a", 1 + extra)]
        rows.append(ways)
    gaps = [("I" * n, "".join(p), 5 * n) for n in range(most_inserted + 1) for p in itertools.product("ua", repeat=n)]
    best = (1 << 30, "")
    for parts in itertools.product(*[w for row in rows for w in (gaps, row)], gaps):
        if GOOD.fullmatch("".join(p[1] for p in parts)):
            best = min(best, (sum(p[2] for p in parts), "".join(p[0] for p in parts)))
    return best


@pytest.mark.parametrize("size", [0, 1, 2, 3])
def test_matrices_against_all_edit_sequences(size):
    solver = dialogues.Solver([])
    for letters in map("".join, itertools.product("suaoSUx" if size < 3 else "suaUx", repeat=size)):
        assert solver.solve(letters) == all_edits(letters, 2 if size < 3 else 1), letters


def row_by_row(letters: str) -> tuple[int, str]:
    """Least (cost, audit) for every state, letter by letter; insertions one at a time."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def put(to, state, value):
        if state not in to or value < to[state]:
            to[state] = value
            return True
        return False

    def insert(line):
        while any([put(line, moves[s, i], (line[s][0] + 5, line[s][1] + "I")) for s in list(line) for i in "ua" if (s, i) in moves]):
            pass
        return line

    line = insert({"": (0, "")})
    for x in letters:
        new: dict = {}
        extra = 5 if x.isupper() else 0
        for s, (cost, audit) in line.items():
            put(new, s, (cost + 2, audit + "D"))
            if x != "x":
                if (s, x.lower()) in moves:
                    put(new, moves[s, x.lower()], (cost + extra, audit + "K"))
                for i in "ua":
                    if (s, i) in moves:
                        put(new, moves[s, i], (cost + extra + 1, audit + "R"))
        line = insert(new)
    return min(line[s] for s in ("", "a") if s in line)


def plain(rows: list[tuple]) -> dict:
    """The contract's columns for (conv, turn, role, text) rows."""
    said = lambda v: " " if v is None else str(v)
    blanks = " \t\n\x0b\x0c\r"
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text, pick = said(role), said(text), zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
            if pick:
                text = "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text
                kept += [(turn, "user" if pick == 4 else role, text)] * (2 if pick == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, letters, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in kept:
            bare = text.strip(blanks)
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            letters += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        turns = [t for t, _, _ in kept if t is not None]
        first = [r[1][:1] for r in kept]
        cost, audit = row_by_row(letters)
        left, repaired, left_rows = sum(x != "D" for x in audit), [], iter(kept)
        expected = (["s"] if left % 2 else []) + ["u", "a"] * (left // 2)
        for x in audit:
            row = None if x == "I" else next(left_rows)
            if x != "D":
                want = {"s": "system", "u": "user", "a": "assistant"}[expected.pop(0)]
                repaired.append(f"{row[1]}:{row[2]}" if x == "K" else f"{want}:{row[2] if row else ''}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
        )
    return out


def told(df) -> dict:
    rows = df.collect()
    out = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def run(rows):
    return dialogues.repair(dialogues.damaged(rows), rows.select(F.col("conv_id").alias("conv"))).withColumnRenamed("conv", "conv_id")


def test_query_against_plain_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert told(queries.op13_grammar_repair(spark, sf)) == plain([tuple(r) for r in rows.collect()])


def test_nulls_ties_repeats_and_odd_roles(spark):
    rows = [(None, 1, "user", "a."), (None, None, None, None), (None, 2, "assistant", "b"), (7, None, "user", "x."), (7, None, "user", "x.")]
    rows += [(8, t, r, x) for t in (5, 9) for r in ("user", "", "Üser", "assistant", "system", "ux") for x in ("", "hi.", "hi. ", " \t\x0b", "no end", "é" * 3000 + "!")]
    rows += [(9, i // 3, "user" if i % 2 else "assistant", f"{i % 7}.") for i in range(400)] + [(10, -(1 << 62), "user", "a."), (10, 1 << 62, "assistant", "b?")]
    rows += [(100 + i, t, r, "Same." if t else "Same?") for i in range(30) for t, r in enumerate(("user", "assistant", "user"))]
    table = spark.createDataFrame(rows, SCHEMA)
    assert told(run(table)) == plain(rows)
    odd = table.select("*", *[F.lit("?").alias(c) for c in ("id", "at", "key", "_piece", "copies", "audit", "letters", "conv")])
    assert told(run(odd)) == plain(rows)
    assert told(run(spark.createDataFrame([], SCHEMA))) == {}


def test_a_long_conversation_in_many_ranges(spark):
    rows = [(1, i, ("user", "assistant", "user", "system")[i % 4] if i % 5 else "assistant", f"Text {i % 900}{'.' if i % 3 else ''}") for i in range(4000)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert told(run(table)) == plain(rows)


def test_rules_change_no_answer(spark):
    letters = ["".join("suaUx"[(i * j + j // 3) % 5] for j in range(n)) for i, n in enumerate([1, 5, 9, 40, 90, 200] * 4)]
    table = spark.createDataFrame([(x,) for x in set(letters)], "letters string")
    rules = dialogues.grammar(table, 32)
    assert len(rules) > 8
    got = {r["letters"]: (r["cost"], r["audit"]) for r in dialogues.solved(table, rules).collect()}
    assert got == {x: row_by_row(x) for x in set(letters)}


def test_schema(spark, sf):
    kinds = dict(queries.op13_grammar_repair(spark, sf).dtypes)
    assert kinds == {"conv_id": "bigint", **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint"), "audit": "string", "repaired_sha256": "string"}
