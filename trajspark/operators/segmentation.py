"""Episode segmentation of an ordered step stream, without a one-task window.

Steps are dealt into ranges of their order key; each range is cut by itself, and the
counts of the ranges and their last steps, a bounded table, give every range its offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajspark.operators import ranges
from trajspark.operators.ordering import RANGE_ROWS, fresh


def islands(steps: DataFrame, order: list[str], name: str = "episode", n: int | None = None) -> DataFrame:
    """A new episode begins at ``is_first`` and after ``is_last`` or ``is_terminal``; missing flags are false.

    ``order`` must tell all steps apart; ``order[0]`` is a timestamp or a number, and
    steps that share it are one range, as their order lies in the other columns.
    """
    spark = steps.sparkSession
    raw = F.col(order[0])
    key, at, closes, before, begins, running, start = (fresh(steps, c) for c in ("_key", "_range", "_closes", "_before", "_begins", "_running", "_start"))
    keyed = steps.withColumn(key, F.unix_micros(raw.cast("timestamp")) if dict(steps.dtypes)[order[0]].startswith("timestamp") else raw.cast("long"))
    total = keyed.count()
    cut = ranges.even(keyed, key, n or max(64, -(-total // RANGE_ROWS)), total)
    keyed = keyed.withColumn(at, F.when(F.col(key).isNull(), -1).otherwise(cut.place(F.col(key))))
    w = Window.partitionBy(at).orderBy(*order)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    parted = keyed.withColumn(closes, flag("is_last") | flag("is_terminal")).withColumn(before, F.lag(closes).over(w))
    # inside a range the first step's cut is open until the range before is known
    parted = parted.withColumn(begins, (flag("is_first") | flag(before)).cast("long"))
    last, first = F.max_by(closes, F.struct(*order)), F.min_by(begins, F.struct(*order))
    rows, so_far, closed = [], -1, True
    found = parted.groupBy(at).agg(F.sum(begins).alias("n"), last.alias("closes"), first.alias("begins")).collect()
    for r in sorted(found, key=lambda r: r[0]):
        more = int(closed and not r["begins"])
        rows.append((r[0], so_far + more))
        so_far, closed = so_far + more + r["n"], r["closes"]
    offset = F.broadcast(spark.createDataFrame(rows, f"`{at}` int, `{start}` long"))
    out = parted.withColumn(running, F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0))).join(offset, at)
    return out.withColumn(name, F.col(start) + F.col(running)).drop(key, at, closes, before, begins, running, start)
