"""One entry to all sources, by format."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trajspark.operators.dataset import Dataset
from trajspark.sources import compact, hdf5, lerobot, rlds

FORMATS = ("hdf5", "lerobot", "rlds", "tfrecord", "compact")


def sized(images, spark: SparkSession) -> "DataFrame":  # noqa: F821
    """Encoded images (…, data) with the columns of an images table; sizes are known after decoding only."""
    return images.select("dataset", "position", "timestep", "camera_pos", "camera", F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(3).alias("channels"), F.lit(1).alias("format"), "data")


def ingest(spark: SparkSession, source: str, form: str = "hdf5", embodiment: str = "unknown", task: str | None = None, fps: float | None = None, max_episodes: int | None = None, dataset: str | None = None, **options) -> Dataset:
    """The dataset that a source of one of ``FORMATS`` holds; an unknown format is a ValueError.

    fps is the source's own (LeRobot) or 10 unless given; "unknown" leaves LeRobot's robot type.
    """
    if form == "hdf5":
        return hdf5.read(spark, source, dataset, embodiment, task, hdf5.FPS if fps is None else fps, max_episodes, **options)
    if form == "lerobot":
        found = lerobot.LeRobot(spark, source, dataset, embodiment, task, fps, max_episodes)
        return Dataset(found.episodes(), found.frames(), sized(found.images(), spark))
    if form in ("rlds", "tfrecord"):
        episodes, frames = rlds.read(spark, source, dataset, embodiment, task, 10.0 if fps is None else fps, max_episodes)
        return Dataset(episodes, frames, sized(rlds.images(spark, source, dataset, max_episodes), spark))
    if form == "compact":
        return compact.read(spark, source, **options)
    raise ValueError(f"unknown format {form!r}: {', '.join(FORMATS)}")
