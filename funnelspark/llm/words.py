"""Words of a text: maximal runs without a space or one of the characters tab to carriage return."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "[ \\x09-\\x0D]+"


def word_array(text: Column) -> Column:
    """Array of words; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")
