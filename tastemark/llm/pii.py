"""Personal data by anchor expansion.

One Aho-Corasick automaton finds at-signs, schemes, digits, plus signs and identifier cues in a text. At each anchor a
deterministic local parser grows the match to both sides, bounded by the end of the last match of its kind, and
validates it. Base kinds: ``email``, ``ip``, ``card`` and ``phone``. Kinds added by the cues: ``account`` (an account
or passport number after its cue; an IBAN by its check digits), ``address`` (house number and street) and ``login``
(user part of a URL).

Edge cases: a null text is empty and has no spans. Spans of one kind never overlap, those of two kinds may. Texts of
any length are read whole, each anchor once. Repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tastemark.llm.common import in_pieces

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "address", "login")
ACCOUNT_CUES = ("iban", "account", "acct", "passport", "ssn", "bic")
STREET_CUES = ("street", "avenue", "road", "boulevard", "straße", "strasse")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_ACCOUNT = re.compile(r"(?:[ \t]*+(?:no|nr|number|num)\b\.?)?[ \t]*+[:=#]?[ \t]*+((?:[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,4})?)|[A-Za-z]{0,2}[0-9](?:[ -]?[0-9]){5,17})(?![A-Za-z0-9])", re.ASCII)
_HOUSE = re.compile(r"(?<!\w)[0-9]{1,5}[A-Za-z]?(?: [\w.'-]{1,30}){1,4}$")
_HOUSE_AFTER = re.compile(r" [0-9]{1,4}[a-z]?\b")
_LOGIN = re.compile(r"[^\s/@?#]++(?=@[A-Za-z0-9\[])")
_ORDER = {kind: i for i, kind in enumerate(KINDS)}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    value = value.replace(" ", "").upper()
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("street", STREET_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans in code points, end exclusive, by start and then kind."""
    if not text:
        return []
    done = dict.fromkeys(KINDS, 0)
    spans = []

    def keep(kind: str, start: int, end: int) -> None:
        done[kind] = end
        spans.append((kind, start, end))

    for last, (anchor, size) in _anchors().iter(text):
        at, end = last - size + 1, last + 1
        if anchor == "digit":
            if at >= done["ip"]:
                if m := _IP.match(text, at):
                    done["ip"] = m.end()
                    if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                        keep("ip", at, m.end())
                else:
                    done["ip"] = _DIGITS.match(text, at).end()
            if at >= done["card"]:
                if m := _CARD.match(text, at):
                    done["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        keep("card", at, m.end())
                else:
                    done["card"] = end
        elif anchor == "at":
            start, low = at, done["email"]
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, end)):
                keep("email", start, m.end())
        elif anchor == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                    keep("phone", at, m.end())
        elif anchor == "scheme":
            if end >= done["login"] and (m := _LOGIN.match(text, end)):
                keep("login", m.start(), m.end())
        elif anchor == "account":
            if at >= done["account"] and not (at and text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, end)):
                if m[1][:2].isdigit() or not m[1][2:4].isdigit() or iban(m[1]):
                    keep("account", m.start(1), m.end(1))
        elif not (end < len(text) and text[end].isalnum()):
            low = max(done["address"], at - 160)
            if m := _HOUSE.search(text[low:end]):
                keep("address", low + m.start(), end)
            elif (m := _HOUSE_AFTER.match(text, end)) and at >= done["address"]:
                start = at
                while start > done["address"] and (text[start - 1].isalpha() or text[start - 1] == "-"):
                    start -= 1
                keep("address", start, m.end())
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    work = lambda texts: pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in texts], _SPANS)
    yield from in_pieces(batches, work, _SPANS)


def spans(text: str | Column) -> Column:
    """Array of structs (kind, start, end); empty for a null text."""
    return arrow_udf(_find, "array<struct<kind:string,start:int,end:int>>").asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in capitals and angle brackets; overlapping spans become one."""
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in find_spans(text):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    if not merged:
        return text
    for kind, start, end in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def _mask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from in_pieces(batches, lambda texts: pa.array([mask(t) for t in texts], pa.string()), pa.string())


def masked(text: str | Column) -> Column:
    """The column with personal data masked; null stays null."""
    return arrow_udf(_mask, "string").asNondeterministic()(F.col(text) if isinstance(text, str) else text)
