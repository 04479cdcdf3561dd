"""The fingerprint of an edited text from the spans of its two sources equals the one made anew."""

import random

from tastemark.llm.fingerprints import SPAN, Prefixes, _Held, code_points, edit, fingerprint_of


def test_edited_print_equals_a_new_one():
    rng = random.Random(2)
    sizes = [0, 1, 2, 3, SPAN - 1, SPAN, SPAN + 1, 2 * SPAN, 3 * SPAN - 1, 3 * SPAN, 3 * SPAN + 2, 200, 1000]
    for n in sizes:
        for m in sizes:
            a, b = ("".join(rng.choice("abé😀 ") for _ in range(x)) for x in (n, m))
            for first, second in ((a, b), (a, a), ("a" * n, "a" * m), (a, a[2 * n // 3 + (n % 3 > 0) :] + b)):
                changed = edit(first, second)
                told = _Held(1, first).against(_Held(2, second))
                same = next((i for i, (x, y) in enumerate(zip(first, changed)) if x != y), min(len(first), len(changed)))
                assert told["edited_fingerprint"] == fingerprint_of(Prefixes(code_points(changed)))
                assert told["kept_chars"] == same
