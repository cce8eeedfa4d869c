"""Small text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_string(text: Column) -> Column:
    """A whole file as one string: no byte order mark, no final line break."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r?\n\z", "")


def filenames(path: Column, extension: bool = False) -> Column:
    """Last part of a path, without a purely alphabetic extension unless ``extension``."""
    base = F.element_at(F.split(path, "/"), -1)
    return base if extension else F.regexp_replace(base, r"\.\p{L}+\z", "")


def squish(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def mark_chars(word: Column, mark: str = "#") -> Column:
    """``mark`` as often as the word has characters."""
    if len(mark) != 1:
        raise ValueError("the mark must be a single character")
    return F.repeat(F.lit(mark), F.length(word))
