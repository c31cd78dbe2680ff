"""Word counts of texts as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_count(text: Column) -> Column:
    """Words: runs of characters other than blank, tab, line and page ends; 0 for a null text."""
    marks = F.regexp_replace(text, "[^ \\t-\\r]+", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")
