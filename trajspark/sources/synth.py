"""Synthetic trajectory datasets in closed form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark import schema as schemas
from trajspark.operators.dataset import Dataset

# What the two generators cycle through, their vectors, sizes and queries.
EMBODIMENTS = ["widowx", "franka", "aloha", "ur5"]
TASKS = ["pick up the red block", "open the drawer", "place the cup on the plate", "push the green button", "stack the blue cube on the yellow cube", "close the laptop lid"]
BENCH_EMBODIMENTS = ["franka", "widowx", "aloha", "ur5"]
BENCH_TASKS = ["pick up the red block", "open the drawer", "place cup on plate", "push the button"]
BENCH_QUERIES = ["embodiment = 'franka'", "success = true", "num_frames > 25", "embodiment = 'franka' AND success = true AND num_frames > 25", "task CONTAINS 'pick'"]
ACTION = [0.01, 0.005, 0.01, 0.0, 0.0, 0.005]
BENCH_STATE, BENCH_ACTION = [0.1] * 6, [0.01] * 7
CAMERAS, SIZE = ["front", "wrist"], 64


def _cycle(values: list[str], i: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), (i % len(values)).cast("int"))


def episodes(spark: SparkSession, n: int = 10, frames: int = 50, bench: bool = False, name: str = "synth") -> DataFrame:
    i = F.col("id")
    ok = i % 3 != 0
    return spark.range(n).select(
        F.lit(name).alias("dataset"), i.alias("position"), i.alias("episode_id"), _cycle(BENCH_EMBODIMENTS if bench else EMBODIMENTS, i).alias("embodiment"),
        _cycle(BENCH_TASKS if bench else TASKS, i).alias("language_instruction"), F.lit(frames).cast("long").alias("num_frames"), F.lit(10.0).cast("float").alias("fps"),
        F.lit(7).alias("action_dim"), F.lit(6).alias("state_dim"), ok.alias("success"), F.when(ok, 1.0).otherwise(0.0).cast("float").alias("total_reward"),
    )


def frames(spark: SparkSession, n: int = 10, t: int = 50, bench: bool = False, name: str = "synth") -> DataFrame:
    p = (F.col("timestep").cast("float") / F.lit(float(t)).cast("float")).cast("float")
    vec = lambda *c: F.array(*((F.lit(x) if isinstance(x, float) else x).cast("float") for x in c))
    part = lambda x: p * F.lit(x).cast("float")
    if bench:
        state, action = vec(*BENCH_STATE), vec(*BENCH_ACTION)
    else:
        state = vec(part(0.3), part(0.1), F.lit(0.5).cast("float") + part(0.2), 0.0, 0.0, part(0.1))
        action = vec(*ACTION, F.when(F.col("timestep") < t - 2, 0.0).otherwise(1.0))
    last = F.col("timestep") == t - 1
    at = spark.range(n).select(F.col("id").alias("position"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(t - 1).cast("long"))).alias("timestep"))
    return at.select(
        F.lit(name).alias("dataset"), "position", "timestep", state.alias("state"), action.alias("action"),
        F.when(last & (F.col("position") % 3 != 0), 1.0).otherwise(0.0).cast("float").alias("reward"), last.alias("is_terminal"),
    )


def pixels(progress: float, bench: bool = False) -> np.ndarray:
    """A gradient whose blue follows the progress; a plain grey for the benchmark."""
    if bench:
        return np.full((SIZE, SIZE, 3), 128, np.uint8)
    out = np.zeros((SIZE, SIZE, 3), np.uint8)
    ramp = (np.arange(SIZE, dtype=np.float32) / np.float32(SIZE) * np.float32(255)).astype(np.uint8)
    out[..., 0], out[..., 1], out[..., 2] = ramp, ramp[:, None], np.uint8(np.float32(progress) * np.float32(255))
    return out


def images(spark: SparkSession, n: int = 10, t: int = 50, bench: bool = False, name: str = "synth") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for position in batch.column(0).to_pylist():
                rows = [(name, position, k, c, camera, SIZE, SIZE, 3, 0, pixels(np.float32(k) / np.float32(t), bench).tobytes()) for k in range(t) for c, camera in enumerate(CAMERAS[: 1 if bench else 2])]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["dataset", "position", "timestep", "camera_pos", "camera", "width", "height", "channels", "format", "data"])

    return spark.range(n).mapInArrow(run, schemas.IMAGES)


def create_test(spark: SparkSession, n: int = 10, t: int = 50, with_images: bool = False) -> Dataset:
    return Dataset(episodes(spark, n, t), frames(spark, n, t), images(spark, n, t) if with_images else None)


def create_bench(spark: SparkSession, n: int = 500, t: int = 50, with_images: bool = False) -> Dataset:
    return Dataset(episodes(spark, n, t, True), frames(spark, n, t, True), images(spark, n, t, True) if with_images else None)
