"""Episodes and frames of an RLDS folder: TFRecord files of tf.train.Example, one per step.

No TensorFlow: a small reader of the record framing and of the protobuf wire format runs
over the files in parallel. Checksums are not verified; a record that doesn't parse is
left out, and a file that ends inside a record ends there. Lists are read whole, packed or not. Episodes are cut by
``operators.segmentation``; they may go on in the next file, by order of the paths.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajspark.functions import images as codecs
from trajspark.functions import scalars
from trajspark.operators.segmentation import islands

STEP = "path string, record bigint, is_first boolean, is_last boolean, is_terminal boolean, reward float, action array<float>, state array<float>, task string"
#: Steps of one Arrow batch that a file's reader hands on.
BATCH = 4096
#: Record numbers of one file in the key that orders all steps.
PER_FILE = 1 << 40


def records(data: bytes) -> Iterator[bytes]:
    """The payloads of a TFRecord file: length, its checksum, payload, its checksum."""
    at = 0
    while at + 12 <= len(data):
        (size,) = struct.unpack_from("<Q", data, at)
        if at + 12 + size > len(data):
            return
        yield data[at + 12 : at + 12 + size]
        at += size + 16


def _varint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = b[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at
        if shift > 63:
            raise ValueError("varint of over ten bytes")


def message(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of each field: an int, or the bytes of fixed and delimited ones."""
    at = 0
    while at < len(b):
        tag, at = _varint(b, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(b, at)
        else:
            if kind == 2:
                size, at = _varint(b, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind}")
            if at + size > len(b):
                raise ValueError("field beyond the end")
            value, at = b[at : at + size], at + size
        yield tag >> 3, value


def _feature(b: bytes) -> list[bytes] | np.ndarray | list[int]:
    """The list of a Feature: bytes (1), floats (2) or integers (3)."""
    for kind, body in message(b):
        values = [v for n, v in message(body) if n == 1]
        if kind == 1:
            return values
        if kind == 2:
            return np.frombuffer(b"".join(values), "<f4")
        if kind == 3:
            out = []
            for v in values:
                if isinstance(v, int):
                    out.append(v)
                    continue
                at = 0
                while at < len(v):
                    n, at = _varint(v, at)
                    out.append(n)
            return out
    return []


def example(b: bytes) -> dict:
    """The features of a tf.train.Example by key."""
    out = {}
    for n, features in message(b):
        for m, entry in message(features) if n == 1 else ():
            if m == 1:
                pair = dict(message(entry))
                out[pair.get(1, b"").decode()] = _feature(pair.get(2, b""))
    return out


def step(found: dict) -> tuple:
    """(is_first, is_last, is_terminal, reward, action, state, task) of an Example's features."""

    def floats(key: str) -> np.ndarray:
        v = found.get(key)
        return v if isinstance(v, np.ndarray) else np.zeros(0, np.float32)

    def flag(key: str) -> bool:
        v = found.get(key)
        return isinstance(v, list) and bool(v) and isinstance(v[0], int) and v[0] != 0

    reward, task = floats("reward"), None
    for key in ("language_instruction", "observation/language_instruction"):
        v = found.get(key)
        if task is None and isinstance(v, list) and v and isinstance(v[0], bytes):
            try:
                task = v[0].decode()
            except UnicodeDecodeError:
                continue
    parts = [floats(k) for k in sorted(found) if k.startswith("observation/") and "image" not in k]
    state = np.concatenate([np.zeros(0, np.float32), *parts])
    return flag("is_first"), flag("is_last"), flag("is_terminal"), float(reward[0]) if len(reward) else 0.0, floats("action"), state, task


def _table(path: str, rows: list[tuple]) -> pa.RecordBatch:
    number, first, last, terminal, reward, action, state, task = zip(*rows)
    vectors = [pa.array(list(v), pa.list_(pa.float32())) for v in (action, state)]
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(rows)), pa.array(number, pa.int64()), pa.array(first), pa.array(last), pa.array(terminal), pa.array(reward, pa.float32()), *vectors, pa.array(task, pa.string())],
        names=["path", "record", "is_first", "is_last", "is_terminal", "reward", "action", "state", "task"],
    )


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0), batch.column(1)):
            path, rows = path.as_py(), []
            for k, payload in enumerate(records(data.as_py())):
                try:
                    rows.append((k, *step(example(payload))))
                except (ValueError, IndexError, TypeError, AttributeError):
                    continue  # by contract, records that don't parse are left out
                if len(rows) == BATCH:
                    yield _table(path, rows)
                    rows = []
            if rows:
                yield _table(path, rows)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*tfrecord*").load(folder)


def _numbered(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(path, file) in order of the paths, and (path, content)."""
    # the driver lists these paths to plan the scan anyway; contents aren't read here
    paths = sorted((r["path"] for r in _files(spark, folder).select("path").collect()), key=lambda p: p.split("/"))
    return spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "path string, file bigint"), _files(spark, folder).select("path", "content")


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """One row per parsed record, with the ``key`` that orders all of them."""
    numbers, files = _numbered(spark, folder)
    return files.mapInArrow(_parse, STEP).join(numbers, "path").withColumn("key", F.col("file") * PER_FILE + F.col("record"))


def default_task(spark: SparkSession, folder: str) -> str | None:
    """The ``description`` of dataset_info.json, if there is one."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "dataset_info.json").load(folder).select("content").head()
    try:
        text = json.loads(found["content"].decode()).get("description") if found else None
    except (ValueError, AttributeError):
        text = None
    return text if isinstance(text, str) and text else None


def _shots(found: dict) -> list[tuple[str, bytes]]:
    """(camera, bytes) of the decodable images of an Example, by key."""
    out = []
    for key in sorted(found):
        v = found[key]
        if "image" in key and isinstance(v, list) and v and isinstance(v[0], bytes):
            try:
                codecs.decode(v[0])
            except codecs.ImageError:
                continue
            out.append((key.replace("observation/", "").replace("image/", "").replace("image", "camera"), v[0]))
    return out


def _parse_images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0), batch.column(1)):
            path, rows = path.as_py(), []
            for k, payload in enumerate(records(data.as_py())):
                try:
                    rows += [(path, k, n, camera, shot) for n, (camera, shot) in enumerate(_shots(example(payload)))]
                except (ValueError, IndexError, TypeError, AttributeError):
                    continue  # by contract, records that don't parse are left out
                if len(rows) >= BATCH:
                    yield _image_table(rows)
                    rows = []
            if rows:
                yield _image_table(rows)


def _image_table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "record", "camera_pos", "camera", "data"])


def _named(folder: str, dataset: str | None) -> Column:
    return F.lit(dataset or folder.rstrip("/").rsplit("/", 1)[-1])


def _keyed_frames(spark: SparkSession, folder: str, dataset: str | None, max_episodes: int | None) -> DataFrame:
    cut = islands(steps(spark, folder), ["key"], "position")
    if max_episodes is not None:
        cut = cut.where(F.col("position") < max_episodes)
    w = Window.partitionBy("position")
    return cut.select(
        _named(folder, dataset).alias("dataset"), "position", (F.row_number().over(w.orderBy("key")).cast("long") - 1).alias("timestep"),
        "state", "action", "reward", (F.col("is_terminal") | (F.col("key") == F.max("key").over(w))).alias("is_terminal"), "key", "task", F.col("is_terminal").alias("flagged"),
    )


def frames(spark: SparkSession, folder: str, dataset: str | None = None, max_episodes: int | None = None) -> DataFrame:
    """One row per step; terminal if the step says so or is the last of its episode."""
    return _keyed_frames(spark, folder, dataset, max_episodes).drop("key", "task", "flagged")


def images(spark: SparkSession, folder: str, dataset: str | None = None, max_episodes: int | None = None) -> DataFrame:
    """(dataset, position, timestep, camera_pos, camera, data): encoded images as they are; undecodable ones are left out."""
    paths, files = _numbered(spark, folder)
    shots = files.mapInArrow(_parse_images, "path string, record long, camera_pos int, camera string, data binary").join(paths, "path").withColumn("key", F.col("file") * PER_FILE + F.col("record"))
    places = _keyed_frames(spark, folder, dataset, max_episodes).select("dataset", "position", "timestep", "key")
    return shots.join(places, "key").select("dataset", "position", "timestep", "camera_pos", "camera", "data")


def read(spark: SparkSession, folder: str, dataset: str | None = None, embodiment: str = "unknown", task: str | None = None, fps: float = 10.0, max_episodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(episodes, frames) of the folder. Success is the last step's own terminal flag; the reward is the float sum of the steps' in order."""
    rows = _keyed_frames(spark, folder, dataset, max_episodes)
    given = F.lit(task if task is not None else default_task(spark, folder) or "")
    instruction = F.lit(task) if task is not None else F.coalesce(F.min_by("task", "timestep"), given)
    rewards = F.transform(F.sort_array(F.collect_list(F.struct("timestep", "reward"))), lambda x: x["reward"])
    episodes = rows.groupBy("dataset", "position").agg(
        instruction.alias("language_instruction"), F.count("*").alias("num_frames"), F.min_by(F.size("action"), "timestep").alias("action_dim"), F.min_by(F.size("state"), "timestep").alias("state_dim"),
        F.max_by("flagged", "timestep").alias("success"), scalars.left_fold(rewards).alias("total_reward"),
    )
    episodes = episodes.select(
        "dataset", "position", F.col("position").alias("episode_id"), F.lit(embodiment).alias("embodiment"), "language_instruction", "num_frames", F.lit(fps).cast("float").alias("fps"),
        "action_dim", "state_dim", "success", "total_reward",
    )
    return episodes, rows.drop("key", "task", "flagged")
