"""Folding of index tokens."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_token(token: Column) -> Column:
    """Without surrounding white space, in lower case; null stays null."""
    return F.lower(F.regexp_replace(token, r"^\s+|\s+$", ""))
