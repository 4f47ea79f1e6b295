"""Column expressions over words that the native operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; empty for null and wordless texts."""
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.coalesce(clean, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(clean, " ", -1))


def tuples(w: Column, k: int, make) -> Column:
    """``make`` of each k consecutive words; a shorter text that has words makes one tuple of them all.

    ``w`` should be a plain column: it is read once a word.
    """
    n = F.size(w)
    return (
        F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: make(*(F.element_at(w, (i + j).cast("int")) for j in range(k)))))
        .when(n > 0, F.array(make(*(F.coalesce(F.get(w, F.lit(j)), F.lit("")) for j in range(k)))))
    )
