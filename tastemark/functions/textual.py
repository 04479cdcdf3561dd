"""Text expressions: cleaning with negation scope, tokens, n-grams, tags and phrase patterns.

All of them work on one row at a time with built-in functions and touch the whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tastemark.functions.scalars import literal_map, replace_all
from tastemark.lookups import COMPOUNDS, CONTRACTIONS, NEGATION_RESETS, PHRASE_KEEP, STOP_WORDS, STOP_WORDS_EXTRA

# Token and clean-up patterns (word characters are letters, digits and the underscore).
WORD = r"[\p{L}\p{N}_]"
TOKEN_PATTERN = rf"{WORD}+-{WORD}+[-\[\p{{L}}\p{{N}}_]+\]?|{WORD}+|[.,!?;]"
TAG_PATTERN = r"&lt;/?.*?&gt;"
NOT_WORD_PATTERN = r"[^\p{L}\p{Nl}\p{No}_]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column used inside a lambda would be computed again for every element; bound as a lambda variable it is not.
    """
    return F.transform(F.array(value), body)[0]


def squeeze(text: Column) -> Column:
    """Lower case, runs of blanks as one, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def mark_negation(text: Column, resets: Sequence[str] = NEGATION_RESETS) -> Column:
    """Prefix ``not_`` to the tokens after a token ``not``, up to and including a token that contains a reset.

    The text is cut at the ``not`` tokens; in each later piece the scope is a prefix of the piece.
    """
    ends = "|".join(f"\\Q{r}\\E" for r in resets)
    pieces = F.split(F.concat(F.lit(" "), squeeze(text)), r" not(?= |$)")
    scope_end = rf"^(.*?(?:{ends})\S*)(.*)$"

    def scoped(piece: Column) -> Column:
        ended = piece.rlike(scope_end)
        scope = F.when(ended, F.regexp_extract(piece, scope_end, 1)).otherwise(piece)
        rest = F.when(ended, F.regexp_extract(piece, scope_end, 2)).otherwise(F.lit(""))
        return F.concat(F.regexp_replace(scope, r" (?=\S)", " not_"), rest)

    marked = F.transform(pieces, lambda piece, i: F.when(i == 0, piece).otherwise(scoped(piece)))
    return F.trim(F.array_join(marked, " not"))


def clean_tokens(
    text: Column,
    stop_words: Iterable[str] = (*STOP_WORDS, *STOP_WORDS_EXTRA),
    lemmas: Mapping[str, str] | None = None,
    negation: bool = True,
) -> Column:
    """Cleaned words of a review as an array: negation marks, tags and non-letters out, stop words out, lemmas."""
    marked = mark_negation(text) if negation else squeeze(text)
    untagged = F.regexp_replace(marked, TAG_PATTERN, " &lt;&gt; ")
    words = F.split(F.trim(F.regexp_replace(untagged, NOT_WORD_PATTERN, " ")), " ")
    stop = list(dict.fromkeys(stop_words))
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*stop))
    return lemmatise(kept, lemmas)


def clean_text(text: Column, **options) -> Column:
    """Cleaned words joined with blanks."""
    return F.array_join(clean_tokens(text, **options), " ")


def lemmatise(words: Column, lemmas: Mapping[str, str] | None) -> Column:
    """Replace words by their lemma where the lookup has one."""
    if not lemmas:
        return words
    table = literal_map(lemmas)
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))


def expand_contractions(text: Column, table: Mapping[str, str] | None = None) -> Column:
    """Contractions written out, compounds joined, in table order.

    The leading entries with an apostrophe are tried on texts that have one only.
    """
    table = dict(table if table is not None else {**CONTRACTIONS, **COMPOUNDS})
    marked = {}
    for old, new in table.items():
        if "'" not in old or "'" in new:
            break
        marked[old] = new
    rest = {old: new for old, new in table.items() if old not in marked}

    def expand(t: Column) -> Column:
        return replace_all(F.when(F.contains(t, F.lit("'")), replace_all(t, marked)).otherwise(t), rest)

    return bind(text, expand)


def tokens(text: Column) -> Column:
    """Words (with inner hyphens) and sentence marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of pieces between single blanks."""
    return F.size(F.split(text, " ", -1))


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring words joined with blanks; shorter arrays give none."""
    if n == 1:
        return words

    def runs(ws: Column) -> Column:
        count = F.size(ws) - F.lit(n - 1)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: i <= count)
        return F.transform(starts, lambda i: F.array_join(F.slice(ws, i, n), " "))

    return bind(words, runs)


def ngram_range(words: Column, low: int, high: int) -> Column:
    """All n-grams with ``low <= n <= high``."""
    return bind(words, lambda ws: F.flatten(F.array(*[ngrams(ws, n) for n in range(low, high + 1)])))


def acceptable(word: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Length 2 to 40 and not a stop word; forms of ``be`` that phrases need are kept."""
    stop = [w for w in stop_words if w not in PHRASE_KEEP]
    return F.length(word).between(2, 40) & ~F.lower(word).isin(*stop)


def accepted_words(words: Column) -> Column:
    """Acceptable words in lower case."""
    return F.transform(F.filter(words, lambda w: acceptable(w)), lambda w: F.lower(w))


# --- tags and phrase patterns -------------------------------------------------------------------------------------
# One letter per tag: R adverb, J adjective, N common noun, I preposition, V is/was-type verb, O anything else.

Tagger = Callable[[Column], Column]

# Closed-class words every tagger knows.
CLOSED_CLASS = {
    "is": "V", "was": "V", "has": "V", "had": "V", "are": "O", "were": "O",
    "in": "I", "of": "I", "with": "I", "for": "I", "on": "I", "at": "I", "by": "I", "from": "I",
    "very": "R", "really": "R", "too": "R", "so": "R", "not": "R", "also": "R", "still": "R",
}


def tagger(lexicon: Mapping[str, str], suffixes: Sequence[tuple[str, str]] = (), default: str = "O") -> Tagger:
    """Tag of a word from a lexicon, else from the first matching suffix, else ``default``."""
    table = literal_map({**CLOSED_CLASS, **lexicon})

    def tag(word: Column) -> Column:
        by_suffix = F.lit(default)
        for suffix, letter in reversed(list(suffixes)):
            by_suffix = F.when(F.endswith(word, F.lit(suffix)) & (F.length(word) > len(suffix)), letter).otherwise(by_suffix)
        return F.coalesce(F.try_element_at(table, word), by_suffix)

    return tag


def tagged_text(words: Column, tag: Tagger) -> Column:
    """Words and tags as ``word/T `` runs, the form the phrase patterns read."""
    return F.array_join(F.transform(words, lambda w: F.concat(w, F.lit("/"), tag(w), F.lit(" "))), "")


# Phrase patterns over tagged words.
DESCRIBED_NOUN = r"(?:\S+/R )?(?:\S+/J )+(?:\S+/N )+"
NOUN_IS_ADJECTIVE = r"(?:\S+/N )+\S+/V (?:\S+/R )?(?:\S+/J )+"


def phrase_matches(tagged: Column, pattern: str) -> Column:
    """Non-overlapping matches of a phrase pattern, as word arrays."""
    found = F.regexp_extract_all(tagged, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m: F.split(F.regexp_replace(F.trim(m), r"/[A-Z](?= |$)", ""), " "))


def tidy_phrase(phrase: Column) -> Column:
    """Present tense, filler words out, repeated words out (first one stays)."""
    for old, new in (("was", "is"), ("were", "are"), ("also", ""), ("still", ""), ("actual", "")):
        phrase = F.replace(phrase, F.lit(old), F.lit(new))
    return F.array_join(F.array_distinct(F.filter(F.split(phrase, " "), lambda w: w != "")), " ")


# --- sentiment ----------------------------------------------------------------------------------------------------

# Published constants of the lexicon method (normalisation, negation factor) and its negators.
COMPOUND_ALPHA = 15
NEGATION_FACTOR = -0.74
NEGATORS = ("not", "no", "never", "none", "nor", "cannot", "without", "nothing", "neither", "nobody", "nowhere")


def compound(words: Column, lexicon: Mapping[str, float], negators: Sequence[str] = NEGATORS) -> Column:
    """``compound_of`` with the valences of a short fixed lexicon; larger ones are joined by ``operators.lookup``."""
    table = literal_map({w: float(v) for w, v in lexicon.items()})
    return bind(words, lambda ws: compound_of(ws, F.transform(ws, lambda w: F.try_element_at(table, w)), negators))


def compound_of(words: Column, valences: Column, negators: Sequence[str] = NEGATORS) -> Column:
    """Compound sentiment ``s / sqrt(s * s + 15)`` of a word array and its valences (null: none), 4 decimals.

    ``s`` adds the valences; a negator among the three words before flips and damps a valence.
    """
    denied = F.transform(words, lambda w: w.isin(*negators))

    def valence(v: Column, i: Column, deny: Column) -> Column:
        start = F.greatest(i - 2, F.lit(1))
        negated = F.array_contains(F.slice(deny, start, i + 1 - start), F.lit(True))
        return F.when(v.isNull() | (v == 0), F.lit(0.0)).when(negated, v * NEGATION_FACTOR).otherwise(v)

    values = bind(denied, lambda deny: F.transform(valences, lambda v, i: valence(v, i, deny)))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return bind(total, lambda s: F.round(s / F.sqrt(s * s + F.lit(COMPOUND_ALPHA)), 4))
