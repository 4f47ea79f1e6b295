"""Tables on the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_kept: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or of its context; where a driver is its own executor, a warehouse folder."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``key``, built and written once in an application and read from then on.

    Scans of it see pushed filters and pruned columns, which a view of the same
    expressions, evaluated again by every query, does not offer.
    """
    name = (spark.sparkContext.applicationId, key)
    if name not in _kept:
        path = fresh_path(spark, "table")
        build().write.parquet(path)
        _kept[name] = path
    return spark.read.parquet(_kept[name])


def put(path: str, content: bytes) -> None:
    """Write a small file, with the folders above it."""
    from pyarrow import fs

    files, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    files.create_dir(where.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(where) as out:
        out.write(content)
