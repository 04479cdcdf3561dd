"""Repair of conversation structure by a grammar-compressed dynamic programme.

Every row of a conversation becomes one letter: what its role begins with and whether it is blank, duplicate or
truncated. Equal letter sequences are solved once for all conversations. Re-Pair rules, found over the distinct
sequences by rounds of pair counts, replace frequent neighbours by one symbol; each rule gets one transfer matrix over
the states of the role grammar, with the least cost and the least audit of every entry, computed bottom-up from the
matrices of its two halves. A sequence is then a short product of such matrices. Audits are ropes: an entry points to
the entries it was put together from, and letters are only spelled out to break a tie and at the end.

Of two edit sequences of one stretch of rows and one cost neither can begin with the other (each row has one letter,
and a longer one has insertions that cost more), so the ASCII-least audit of a product comes from the ASCII-least
audits of its factors. The number of rules bounds the driver's table and changes no result.

Letters of a conversation travel as pieces of ranges of rows; a conversation's audit, a byte a row, is one value of one
task. Its repaired rows are hashed as a stream in order, as a hash of joined texts asks for, without being held.

Edge cases: nulls in role and text are one space, and so are null ids within the hashed key; null turns come first, and
rows with a null conversation id are one conversation. Rows of one turn are ordered by role, then by a digest of the
text; rows that are equal in all of these stand together, the later ones being duplicates. Roles that begin with none
of the three letters, the empty role included, can be reroled or deleted only. Text of any length is read as a whole.
An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tastemark.operators.ranking import _ranged
from tastemark.session import cut, spread

#: Blanks of the texts' contract and the ends of a whole sentence.
BLANKS, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the role grammar ``(s?(ua)+)?``: at the start, after s, after u, after a. Rows and conversations end in ENDS.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS = 4, (0, 3)
#: Letters of a row: its role's initial (o: another) as it is, in upper case if truncated; x if it has to be deleted.
LETTERS = "suaoSUAOx"
FIRST_RULE = 0xE000  # rules are private-use characters from here on


class Rope:
    """An audit put together from two others, spelled out when first asked for."""

    __slots__ = ("left", "right", "text")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right

    def __add__(self, other: Rope) -> Rope:
        return other if self.text == "" else self if other.text == "" else Rope(None, self, other)

    def spelled(self) -> str:
        if self.text is None:
            parts, stack = [], [self]
            while stack:
                rope = stack.pop()
                if rope.text is None:
                    stack += [rope.right, rope.left]
                else:
                    parts.append(rope.text)
            self.text, self.left, self.right = "".join(parts), None, None
        return self.text


#: A matrix: for every state before and after, the least cost and its audit, or None.
Entry = tuple[int, Rope] | None
Matrix = list[list[Entry]]


def better(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1] is b[1] or a[1].spelled() <= b[1].spelled() else b


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        line: list[Entry] = [None] * STATES
        for k, x in enumerate(row):
            if x is not None:
                for j, y in enumerate(b[k]):
                    if y is not None and (line[j] is None or x[0] + y[0] <= line[j][0]):
                        line[j] = better(line[j], (x[0] + y[0], x[1] + y[1]))
        out.append(line)
    return out


def _insertions() -> Matrix:
    """Any number of insertions: shortest ways over user and assistant turns."""
    out: Matrix = [[(0, Rope("")) if i == j else None for j in range(STATES)] for i in range(STATES)]
    for _ in range(STATES):
        for i in range(STATES):
            for (state, initial), after in STEPS.items():
                if initial != "s" and out[i][state] is not None:
                    cost, audit = out[i][state]
                    out[i][after] = better(out[i][after], (cost + INSERT, Rope(audit.spelled() + "I")))
    return out


def letter_matrices() -> dict[str, Matrix]:
    """One matrix a letter: insertions, then keep, rerole or delete."""
    free, out = _insertions(), {}
    for letter in LETTERS:
        edit: Matrix = [[(DELETE, Rope("D")) if i == j else None for j in range(STATES)] for i in range(STATES)]
        if letter != "x":
            extra = TRUNCATED if letter.isupper() else 0
            for (state, initial), after in STEPS.items():
                if initial == letter.lower():
                    edit[state][after] = better(edit[state][after], (extra, Rope("K")))
                if initial != "s":
                    edit[state][after] = better(edit[state][after], (extra + REROLE, Rope("R")))
        out[letter] = product(free, edit)
    return out


class Solver:
    """Matrices of all letters and rules, and the answer for whole sequences. A rule is two characters of lower symbols."""

    def __init__(self, rules: list[str]):
        self.matrices, self.end = letter_matrices(), _insertions()
        for i, pair in enumerate(rules):
            self.matrices[chr(FIRST_RULE + i)] = product(self.matrices[pair[0]], self.matrices[pair[1]])

    def _whole(self, symbols: str) -> Matrix:
        """Product in halves, so that a long sequence is spelled out a logarithm of times at most."""
        level = [self.matrices[x] for x in symbols]
        while len(level) > 1:
            level = [product(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def solve(self, symbols: str) -> tuple[int, str]:
        """Least cost and its audit. Short sequences follow the one start state only."""
        line: Matrix = [[(0, Rope("")), None, None, None]]
        if len(symbols) > 64:
            line = [self._whole(symbols)[0]]
        else:
            for x in symbols:
                line = product(line, self.matrices[x])
        line = product(line, self.end)
        cost, audit = [e for e in [better(line[0][ENDS[0]], line[0][ENDS[1]])] if e is not None][0]
        return cost, audit.spelled()


def repaired_roles(audit: str) -> Iterator[tuple[str, str | None]]:
    """(edit, role) of every letter of an audit: the role a row or an insertion gets, None where it stays or goes."""
    left = sum(x != "D" for x in audit)
    expect = "s" if left % 2 else "u"
    for x in audit:
        if x == "D":
            yield x, None
            continue
        yield x, None if x == "K" else {"u": "user", "a": "assistant"}[expect]
        expect = "a" if expect == "u" else "u"


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, copies`` after the damage that a hash of conversation and turn picks for each row."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    pick = F.pmod(F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")), F.lit(20))
    kept = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), pick.alias("_pick")).where(F.col("_pick") != 0)
    new_text = F.when(F.col("_pick") == 1, "").when(F.col("_pick") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    return kept.select(
        "conv", "turn", F.when(F.col("_pick") == 4, "user").otherwise(F.col("role")).alias("role"), new_text.alias("text"), F.when(F.col("_pick") == 3, 2).otherwise(1).alias("copies"),
    )


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with ``blank``, ``truncated``, the role's ``initial`` and ``key``, a digest of the text."""
    ended, initial = F.rtrim(F.col("text"), F.lit(BLANKS)), F.substring("role", 1, 1)
    return rows.withColumns({
        "blank": ended == "",
        "truncated": (ended != "") & ~F.substring(ended, -1, 1).isin(*STOPS),
        "initial": F.when(initial.isin("s", "u", "a"), initial).otherwise("o"),
        "key": F.unhex(F.md5(F.col("text").cast("binary"))),
    })


def lettered(rows: DataFrame) -> DataFrame:
    """One row a distinct (conversation, turn, role, text): its ``letters``, its ``initials`` and counts of faults.

    Only digests of the texts are shuffled. The first of equal rows of a conversation is found by a minimum over turns.
    """
    sums = rows.groupBy("conv", "turn", "role", "key", "blank", "truncated", "initial").agg(F.sum("copies").alias("copies"))
    cells = cut(sums.withColumn("id", F.struct("conv")))
    order = F.struct(F.col("turn").isNotNull(), "turn")  # nulls first
    firsts = cells.where(~F.col("blank")).groupBy("id", "role", "key").agg(F.min(order).alias("first"))
    first = (~F.col("blank")) & F.coalesce(F.col("first") == order, F.lit(False))
    n = F.col("copies").cast("int")
    letter = F.when(F.col("truncated"), F.upper("initial")).otherwise(F.col("initial"))
    return cells.join(firsts, ["id", "role", "key"], "left").select(
        "id", "turn", "role", "key",
        F.when(first, F.concat(letter, F.repeat(F.lit("x"), n - 1))).otherwise(F.repeat(F.lit("x"), n)).alias("letters"),
        F.repeat("initial", n).alias("initials"),
        F.when(F.col("blank"), n).otherwise(0).cast("long").alias("blank"),
        F.when(F.col("blank"), 0).when(first, n - 1).otherwise(n).cast("long").alias("duplicate"),
        F.when(first & F.col("truncated"), 1).otherwise(0).cast("long").alias("truncated"),
    )


def sequences(cells: DataFrame) -> DataFrame:
    """One row a conversation: ``letters`` and ``initials`` in order, faults and gaps. Long conversations come in pieces."""
    ordered = _ranged(cut(cells), ["id", F.col("turn").asc_nulls_first(), "role", "key"])
    faults = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    rows = F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "key", "letters", "initials")))
    pieces = ordered.groupBy("id", "_piece").agg(rows.alias("rows"), *faults).withColumn("turns", F.array_distinct(F.filter("rows.turn", lambda t: t.isNotNull())))
    piece = F.struct("_piece", F.array_join("rows.letters", "").alias("letters"), F.array_join("rows.initials", "").alias("initials"), F.size("turns").cast("long").alias("n"), F.array_min("turns").alias("low"), F.array_max("turns").alias("high"))
    whole = pieces.select("id", "blank", "duplicate", "truncated", piece.alias("piece")).groupBy("id").agg(F.sort_array(F.collect_list("piece")).alias("p"), *faults)
    # the last turn of a piece may go on as the first of the next one
    held = whole.withColumn("held", F.filter("p", lambda x: x["n"] > 0))
    again = F.transform("held", lambda x, i: F.when(x["low"] == F.get("held", i - 1)["high"], 1).otherwise(0).cast("long"))
    distinct = F.aggregate(F.zip_with("held", again, lambda x, a: x["n"] - a), F.lit(0).cast("long"), lambda n, x: n + x)
    wide = lambda c: c.cast("decimal(21,0)")
    gaps = wide(F.array_max("held.high")) - wide(F.array_min("held.low")) + 1 - wide(distinct)
    return held.select("id", F.array_join("p.letters", "").alias("letters"), F.array_join("p.initials", "").alias("initials"), "blank", "duplicate", "truncated", F.coalesce(gaps.try_cast("long"), F.lit(0)).alias("gaps"))


def _chosen(counts: list[tuple[str, int]], taken: int) -> list[str]:
    """Frequent pairs that share no symbol, so that one round may replace them all."""
    used, out = set(), []
    for pair, n in sorted(counts, key=lambda x: (-x[1], x[0])):
        if n > 1 and len(out) < taken and not used & set(pair):
            used |= set(pair)
            out.append(pair)
    return out


def grammar(texts: DataFrame, rules: int, column: str = "letters") -> list[str]:
    """Re-Pair rules over distinct sequences: each round counts neighbours and replaces frequent ones that share no symbol.

    Only the counts of the pairs reach the driver, at most (letters + rules) squared of them.
    """
    found: list[str] = []
    while len(found) < rules:
        pairs = texts.select(F.explode(F.regexp_extract_all(compressed(F.col(column), found), F.lit("(?s)(?=(..))"), 1)).alias("pair"))
        counts = pairs.groupBy("pair").count().where("count > 1").collect()
        new = _chosen([(r[0], r[1]) for r in counts], rules - len(found))
        if not new:
            break
        found += new
    return found


def compressed(letters: Column, rules: list[str]) -> Column:
    for i, pair in enumerate(rules):
        letters = F.replace(letters, F.lit(pair), F.lit(chr(FIRST_RULE + i)))
    return letters


def solved(letters: DataFrame, rules: list[str]) -> DataFrame:
    """``letters, cost, audit`` for a table of distinct sequences."""

    @arrow_udf("cost long, audit string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        solver = Solver(rules)
        for batch in batches:
            found = [solver.solve(x) for x in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["cost", "audit"])

    return spread(letters).select("letters", run.asNondeterministic()(compressed(F.col("letters"), rules)).alias("r")).select("letters", "r.cost", "r.audit")


#: What is told of a conversation besides its rows.
TOLD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, its head before its rows: a running hash, one conversation at a time."""
    head, state, edits, first = None, None, iter(()), True

    def put(role: str, text: str) -> None:
        nonlocal first
        state.update((("" if first else "\n") + role + ":" + text).encode())
        first = False

    def next_edit() -> tuple[str, str | None]:
        """The next row's edit; insertions before it are written."""
        for edit, role in edits:
            if edit != "I":
                return edit, role
            put(role, "")
        return "", None

    def closed() -> list[tuple]:
        if head is None:
            return []
        next_edit()
        return [(*head, state.hexdigest())]

    def table(rows: list[tuple], kinds: list[pa.Field]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], names=[f.name for f in kinds])

    kinds = None
    for batch in batches:
        kinds = [pa.field("conv", batch.schema.field("conv").type), *(pa.field(c, pa.int64()) for c in TOLD), pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())]
        done = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "role", "text", "copies", *TOLD)), strict=True):
            conv, audit, role, text, copies, *told = row
            if audit is not None:
                done += closed()
                head, state, edits, first = (conv, *told, audit), hashlib.sha256(), repaired_roles(audit), True
                continue
            for _ in range(copies):
                edit, new_role = next_edit()
                if edit != "D":
                    put(role if edit == "K" else new_role, text)
        yield table(done, kinds)
    if kinds:
        yield table(closed(), kinds)


def with_hashes(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Heads (``conv``, TOLD, ``audit``) with the hash of the repaired ``role:text`` of each conversation, joined by newlines.

    Each conversation is one sorted stream behind its head; memory holds one audit and one batch of rows.
    """
    gone = lambda c, kind: F.lit(None).cast(kind).alias(c)
    turn = rows.schema["turn"].dataType
    front = heads.select("conv", F.lit(0).alias("at"), gone("turn", turn), gone("role", "string"), gone("key", "binary"), gone("text", "string"), gone("copies", "int"), "audit", *TOLD)
    body = rows.select("conv", F.lit(1).alias("at"), "turn", "role", "key", "text", "copies", gone("audit", "string"), *[gone(c, "long") for c in TOLD])
    stream = front.unionByName(body).repartition("conv").sortWithinPartitions("conv", "at", F.col("turn").asc_nulls_first(), "role", "key")
    told = ", ".join(f"{c} long" for c in TOLD)
    return stream.mapInArrow(_hash_rows, f"conv {rows.schema['conv'].dataType.simpleString()}, {told}, audit string, repaired_sha256 string")


def illegal(initials: Column) -> Column:
    """How many neighbours are none of su, ua, au."""
    times = lambda pair: (F.length(initials) - F.length(F.replace(initials, F.lit(pair), F.lit("")))) / 2
    return F.greatest(F.length(initials) - 1 - times("su") - times("ua") - times("au"), F.lit(0)).cast("long")


def repair(rows: DataFrame, everyone: DataFrame, rules: int = 64) -> DataFrame:
    """One row for each ``conv`` of ``everyone``: faults, gaps, least cost, its audit and the hash of the repaired rows.

    ``rows`` have ``conv, turn, role, text, copies``. A conversation without rows has zeros, no edits and the hash of nothing.
    """
    rows = keyed(rows)
    found = cut(sequences(lettered(rows)))
    texts = cut(found.select("letters").distinct())
    answers = cut(solved(texts, grammar(texts, rules)))
    heads = everyone.select(F.struct("conv").alias("id")).distinct().join(found.join(answers, "letters"), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    told = {c: zero(illegal(F.col("initials")) if c == "illegal" else F.col(c)).alias(c) for c in TOLD}
    return with_hashes(rows, heads.select(F.col("id.conv").alias("conv"), *told.values(), F.coalesce("audit", F.lit("")).alias("audit")))
