"""Global positions without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trajspark import storage
from trajspark.operators import ranges

#: Rows of a range, about.
RANGE_ROWS = 1_000_000


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores until no column of ``df`` has it (case ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_position(df: DataFrame, key: str, name: str = "position", n: int | None = None) -> DataFrame:
    """``df`` with the 0-based place of each row by ``key``, nulls first; rows of one key by a hash of all their columns.

    Rows are ranked inside even ranges of the key, and the rows of the ranges before, a
    bounded table, are added. ``df`` is written to the shared folder first: it is
    evaluated once, and positions are the same in every evaluation of the result.
    """
    spark = df.sparkSession
    path = storage.fresh_path(spark, "placed")
    df.write.parquet(path)
    df = spark.read.schema(df.schema).parquet(path)
    total = df.count()
    n = n or max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    by, at, before = (fresh(df, c) for c in ("_by", "_range", "_before"))
    hashed = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, T.MapType)]
    cut = ranges.even(df, key, n, total)
    dealt = cut.numbered(df.withColumn(by, F.xxhash64(*hashed)), key, by, at)
    rows, start = [], 0
    for r in sorted(dealt.groupBy(at).count().collect()):
        rows.append((r[0], start))
        start += r[1]
    starts = F.broadcast(spark.createDataFrame(rows, f"`{at}` long, `{before}` long"))
    place = F.row_number().over(Window.partitionBy(at).orderBy(F.asc_nulls_first(key), by)).cast("long") - 1
    return dealt.join(starts, at).withColumn(name, F.col(before) + place).drop(by, at, before)
