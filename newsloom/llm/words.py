"""Words and sizes of texts as column expressions.

A word is a run of characters other than the six ASCII white-space characters,
the pattern `[^\\x20\\x09-\\x0D]+`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space between words.
BLANKS = " \t\n\x0b\f\r"


def word_array(text: Column) -> Column:
    """The words in order; no words for null."""
    blanked = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.filter(F.split(blanked, " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.size(word_array(text)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it new to the frame."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
