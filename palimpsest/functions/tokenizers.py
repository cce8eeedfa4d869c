"""Tokenizers as column expressions: words, sentences, n-grams, skip n-grams.

All take and give Columns, stay inside the JVM, and map null to null. With ``strict`` a text that is too short for the
tokenizer raises; otherwise it gives an empty array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# fixed value: word segments by Unicode word boundaries, restricted to what RE2 and Java share
WORD = r"(?:[\p{L}_][\p{L}\p{M}_]*(?:['’‘.·][\p{L}_][\p{L}\p{M}_]*)*|\p{Nd}+(?:[.,;'’‘]\p{Nd}+)*)+"

# fixed values: sentence marking, in order; \x01 ends a sentence, \x02 may end one
_CLOSE = r"""["'”’»)\]]*"""
SENTENCE_STEPS = (
    (r"(\r\n|[\r\n])", "$1\x01"),
    (r"([!?][.!?]*" + _CLOSE + r"[ \t]*)", "$1\x01"),
    (r"(\.+" + _CLOSE + r"[ \t]*)", "$1\x02"),
    ("\x02([^\\p{L}\r\n.!?\x01\x02]*\\p{Ll})", "$1"),
    ("(\\.)\x02(\\p{Nd})", "$1$2"),
    ("(\\p{L}\\.)\x02(\\p{Lu})", "$1$2"),
    ("\x02([,;:.!?-])", "$1"),
)


def words(text: Column, lowercase: bool = True) -> Column:
    return F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text, False))


def sentences(text: Column, lowercase: bool = True) -> Column:
    """Sentences without punctuation, spaces collapsed; a line break ends one, so blank lines give empty ones."""
    marked = text
    for pattern, by in SENTENCE_STEPS:
        marked = F.regexp_replace(marked, pattern, by)
    pieces = F.split(F.regexp_replace(marked, "[\x01\x02]\\z", ""), "[\x01\x02]", -1)

    def clean(s: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(s, r"\p{P}", " "), r"[\s\p{Z}]+", " ")
        s = F.trim(s)
        return F.lower(s) if lowercase else s

    return F.transform(pieces, clean)


def _check(w: Column, ok: Column, message: str, value: Column, strict: bool) -> Column:
    if strict:
        value = F.when(ok, value).otherwise(F.raise_error(F.lit(message)))
    else:
        value = F.when(ok, value).otherwise(F.array().cast("array<string>"))
    return F.when(w.isNotNull(), value)


def shingle(w: Column, n: int = 3, strict: bool = False) -> Column:
    """Runs of n words joined by a space; there must be more than n words."""
    if n < 1:
        raise ValueError("n must be at least 1")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    return _check(w, F.size(w) > n, f"n-grams of {n} need more than {n} words", grams, strict)


def skip_shingle(w: Column, n: int = 3, k: int = 1, strict: bool = False) -> Column:
    """n words at equal gaps of k, k - 1, ... 0 words, wider gaps first."""
    if n < 1 or k < 0:
        raise ValueError("n must be at least 1 and k at least 0")

    def spread(gap: int) -> Column:
        width = n + n * gap - gap
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
        return F.transform(at, lambda i: F.concat_ws(" ", *[F.get(w, i + j * (gap + 1)) for j in range(n)]))

    parts = [spread(gap) for gap in range(k, -1, -1)]
    least = n + n * k - k
    return _check(w, F.size(w) >= least, f"skip n-grams of {n} and {k} need {least} words", F.concat(*parts), strict)


def ngrams(text: Column, n: int = 3, lowercase: bool = True, strict: bool = False) -> Column:
    return let(words(text, lowercase), lambda w: shingle(w, n, strict))


def skip_ngrams(text: Column, n: int = 3, k: int = 1, lowercase: bool = True, strict: bool = False) -> Column:
    return let(words(text, lowercase), lambda w: skip_shingle(w, n, k, strict))


def minimum_words(n: int = 3, k: int = 0) -> int:
    """Fewest words a document needs not to be skipped as short."""
    return n + n * k - k if k else n + 1


Tokenizer = Callable[[Column], Column]
