"""Scalar helpers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_bytes(n: Column) -> Column:
    f = lambda x, p: F.call_function("format_number", x, F.lit(p))
    k = 1024
    return F.when(n < k, F.concat(n.cast("string"), F.lit(" B"))).when(n < k**2, F.concat(f(n / k, "0.0"), F.lit(" KB"))).when(n < k**3, F.concat(f(n / k**2, "0.0"), F.lit(" MB"))).otherwise(F.concat(f(n / k**3, "0.00"), F.lit(" GB")))


def format_timestamp(seconds: Column) -> Column:
    return F.when(seconds == 0, "unknown").otherwise(F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm"), F.lit(" UTC")))


def sanitized(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")


def resize_map(old: Column, new: int) -> Column:
    """Source index of each target index of a nearest-neighbour resize."""
    return F.transform(F.sequence(F.lit(0), F.lit(new - 1)), lambda i: F.floor(i * old / new))


def non_finite(vector: Column) -> Column:
    return F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def cut(text: Column, longest: int) -> Column:
    """A text for display: at most ``longest`` characters, the last three dots where it is longer."""
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest - 3), F.lit("..."))).otherwise(text)


def path_tail(path: Column, longest: int = 30) -> Column:
    """The end of a path for display, behind three dots where it is longer."""
    return F.when(F.length(path) > longest, F.concat(F.lit("..."), F.right(path, F.lit(longest - 3)))).otherwise(path)


def set_summary(values: Column) -> Column:
    """A sorted array of texts for display: up to four of them, else three and how many there are."""
    some = F.concat(F.array_join(F.slice(values, 1, 3), ", "), F.lit("... ("), F.size(values), F.lit(" total)"))
    return F.when(F.size(values) <= 4, F.array_join(values, ", ")).otherwise(some)


def left_fold(values: Column) -> Column:
    """The sum of an array of floats in its order, rounded to a float at each step; nulls count as 0."""
    zero = F.lit(0.0).cast("float")
    return F.aggregate(values, zero, lambda acc, x: (acc + F.coalesce(x, zero)).cast("float"))
