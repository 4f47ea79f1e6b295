"""Small DataFrame helpers of the document operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.llm.text import chunks

#: Text bytes that an Arrow-batched operator handles and returns at once; one longer text makes a piece of its own.
PIECE_BYTES = 2 << 20
#: Bytes of a sample that a model is fitted on, at most.
FIT_BYTES = 96 << 20
#: Arrow batches that go to Python, about, where the session has no limit of its own.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables that cut lineage: ``spark.checkpoint.dir`` of the session.

    Where neither the session nor its context has one, a folder under the warehouse
    serves a driver that is its own executor; on a cluster that is an error.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: lineage ends here and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete ``written`` tables that nothing reads any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores until no column of ``df`` has it (case ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(id_col: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(divisor)).cast("int")


def lean(df: DataFrame) -> DataFrame:
    """``df``; its session's Arrow batches are limited to ``BATCH_BYTES`` if the session has Spark's default limit."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, "67108864b") == "67108864b":
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df


def appended(docs: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], list[pa.Array]], by: str | None = "text") -> DataFrame:
    """``docs`` with columns that ``fn`` makes from each Arrow batch; all other columns pass through.

    Batches are handed on in pieces of about ``PIECE_BYTES`` of the column ``by``, which bounds a worker's memory.
    """
    schema = T.StructType([*docs.schema.fields, *fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(by), PIECE_BYTES) if by else [(0, batch.num_rows)]:
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *fn(part)], names=names)

    return lean(docs).mapInArrow(run, schema)


def bounded(rows: DataFrame, key: Column, cap: int) -> DataFrame:
    """About ``cap`` rows at most, taken evenly by the hash of ``key``; all of them if there are fewer."""
    n = rows.count()
    if n <= cap:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit(20)), F.lit(1 << 30)) < int(cap / n * (1 << 30)))


def trained(sample: DataFrame, schema: str, fit: Callable[[pa.Table], pa.Table], budget: int = FIT_BYTES) -> list:
    """Run ``fit`` in one task over a bounded sample; its bounded rows come to the driver.

    Should the sample have more than ``budget`` bytes, those rows are left out whose hash
    (of all their columns) is largest, so memory holds at most twice the budget and one
    batch. ``fit`` must order its input itself, so a rerun after a lost executor gives
    the same model.
    """
    columns = sample.columns
    tagged = sample.withColumn(tag := fresh(sample, "_tag"), F.xxhash64(*(F.col(f"`{c}`") for c in columns)))

    def least(got: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(got)
        t = t.take(np.argsort(t.column(tag).to_numpy(), kind="stable"))
        # rows differ in size: halve until what stays fits
        while t.num_rows > 1 and _size(t) > budget:
            t = t.slice(0, max(1, int(t.num_rows * max(0.5, budget / _size(t)))))
        return t.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for b in batches:
            got.append(b)
            size += b.nbytes
            if size > 2 * budget:
                got = least(got)
                size = sum(x.nbytes for x in got)
        if got:
            yield from fit(pa.Table.from_batches(least(got) if size > budget else got).drop_columns([tag])).to_batches()

    return lean(tagged).repartition(1).mapInArrow(run, schema).collect()


def _size(t: pa.Table) -> int:
    return sum(c.nbytes for c in t.columns)
