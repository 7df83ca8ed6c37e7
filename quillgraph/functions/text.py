"""Text functions as column expressions: tokens, stems and spoken edge types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that search leaves out.
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "are", "it", "as", "by", "with", "be", "at", "this", "that")


def stem(w: Column) -> Column:
    n = F.length(w)
    cut = lambda k: F.left(w, n - k)
    return (
        F.when((n > 5) & F.endswith(w, F.lit("ing")), cut(3))
        .when((n > 4) & (F.endswith(w, F.lit("ed")) | F.endswith(w, F.lit("es"))), cut(2))
        .when((n > 3) & F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")), cut(1))
        .otherwise(w)
    )


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"))


def tokens(text: Column) -> Column:
    """Words of two letters or more without stop words, stemmed, in order."""
    return F.transform(F.filter(words(text), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)), stem)


def spoken(edge_type: Column) -> Column:
    """worksAt, works_at and works-at become "works at"."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(edge_type, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " ")))
