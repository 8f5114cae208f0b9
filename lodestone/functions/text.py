"""Text expressions: white space, truncation, passages and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.stemming import stemmed

#: White space in the Unicode sense, as the regex engine of the JVM writes it.
SPACE = r"(?U)\s+"
EDGES = r"(?U)^\s+|\s+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def contents(title: Column | str, text: Column | str) -> Column:
    """Title and text joined by a space, null as empty, trimmed as a whole."""
    parts = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (title, text)]
    return stripped(F.concat(parts[0], F.lit(" "), parts[1]))


def truncated(text: Column | str, max_words: int = 300) -> Column:
    """The first max_words words, one space between them; null and blank give an empty string."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
    return F.array_join(F.slice(words, 1, max_words), " ")


def passage(title: Column, text: Column, max_words: int = 300) -> Column:
    """Title and text, each trimmed, joined and cut to max_words."""
    return truncated(contents(stripped(F.coalesce(title, F.lit(""))), stripped(F.coalesce(text, F.lit("")))), max_words)


#: The stop words that English analyzers commonly leave out (fixed values).
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def tokens(text: Column | str, stop_words: list[str] | None = None, stems: bool = False) -> Column:
    """Lower-cased runs of letters and digits, without stop words and as stems where asked for."""
    text = F.col(text) if isinstance(text, str) else text
    left_out = ["", *(stop_words or [])]
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: ~t.isin(left_out))
    return stemmed(found) if stems else found
