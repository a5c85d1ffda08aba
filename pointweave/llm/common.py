"""What several operators of this folder share: the notion of a word, and rows with odd values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARACTERS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARACTERS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES + "+"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def same(a: Column, b: Column) -> Column:
    """Equality that holds between two nulls."""
    return a.eqNullSafe(b)
