"""Personal data beside very long runs: blanks after a cue, a login of any length, many schemes."""

import time

from tastemark.llm.pii import find_spans


def test_a_million_blanks_take_no_time():
    began = time.perf_counter()
    for gap in (" " * 1_000_000, "\t" * 1_000_000, " \t" * 500_000):
        assert find_spans(f"account{gap}x") == []
        assert find_spans(f"account no.{gap}:{gap}123456789") == [("account", 12 + 2 * len(gap), 21 + 2 * len(gap))]
        assert find_spans("account" + gap + "account" + gap) == []
    assert time.perf_counter() - began < 5


def test_logins_end_at_the_next_delimiter_only():
    for user in ("u:p", "u" * 255, "u" * 5000):
        assert ("login", 8, 8 + len(user)) in find_spans(f"https://{user}@host/x")
    assert not [s for s in find_spans("https://" + "u" * 300 + "/@host") if s[0] == "login"]
    began = time.perf_counter()
    find_spans("a://" * 200_000 + "u" * 200_000)
    assert time.perf_counter() - began < 5
