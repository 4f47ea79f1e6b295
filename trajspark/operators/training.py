"""Training reads: epoch orders, mixture schedules, samples as arrays, prefetching iterators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajspark.functions import images as codecs
from trajspark.operators.dataset import Dataset
from trajspark.operators.mixture import Mixture
from trajspark.operators.ordering import with_position


def tag(seed: int, *parts: Column) -> Column:
    """What shuffles order by: a hash of the seed and the parts, the same on every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def epoch_order(positions: DataFrame, seed: int = 42, epoch: int = 0, shuffle: bool = True) -> DataFrame:
    """``positions`` (position) with ``place``: its order in an epoch, shuffled by seed + epoch."""
    key = tag(seed + epoch, F.col("position")) if shuffle else F.lpad(F.col("position").cast("string"), 20, "0")
    return with_position(positions.withColumn("_tag", key), "_tag", "place").drop("_tag")


def schedule(sources: DataFrame, positions: DataFrame, seed: int = 42, epoch: int = 0, shuffle: bool = True) -> DataFrame:
    """(place, source_idx, position) of a mixture's epoch.

    ``sources`` (source_idx, weight) and ``positions`` (source_idx, position). A source of
    normalised weight w gets max(1, w x all episodes, rounded half to even) picks, which
    cycle through its (shuffled) positions; then all picks are shuffled. Unshuffled,
    sources follow each other. An empty source has no picks.
    """
    sizes = positions.groupBy("source_idx").agg(F.count("*").alias("n"))
    whole, share = F.sum("n").over(Window.partitionBy()), F.col("weight") / F.sum("weight").over(Window.partitionBy())  # one row a source
    picks = F.greatest(F.lit(1).cast("long"), F.bround(share * whole).cast("long"))
    picks = sources.join(sizes, "source_idx").select("source_idx", "n", picks.alias("picks"))
    order = tag(seed + epoch, F.col("source_idx"), F.col("position")) if shuffle else F.lpad(F.col("position").cast("string"), 20, "0")
    # places inside a source, from places among all sources
    keyed = with_position(positions.withColumn("_key", F.concat(F.lpad(F.col("source_idx").cast("string"), 10, "0"), order)), "_key", "_at")
    starts = keyed.groupBy("source_idx").agg(F.min("_at").alias("_start"))
    keyed = keyed.join(F.broadcast(starts), "source_idx").join(F.broadcast(picks), "source_idx").withColumn("_i", F.col("_at") - F.col("_start"))
    turns = F.when(F.col("_i") < F.col("picks"), F.sequence(F.lit(0).cast("long"), F.floor((F.col("picks") - 1 - F.col("_i")) / F.col("n")))).otherwise(F.array().cast("array<bigint>"))
    rows = keyed.select("source_idx", "position", "_i", "n", F.explode(turns).alias("_turn")).withColumn("pick", F.col("_i") + F.col("_turn") * F.col("n"))
    last = tag(seed + epoch + 1, F.col("source_idx"), F.col("pick")) if shuffle else F.concat(F.lpad(F.col("source_idx").cast("string"), 10, "0"), F.lpad(F.col("pick").cast("string"), 20, "0"))
    return with_position(rows.select("source_idx", "position", "pick", last.alias("_key")), "_key", "place").select("place", "source_idx", "position", "pick")


# Arrays ------------------------------------------------------------------------------


def arrays(row: Row, images: bool = True) -> dict:
    """An episode (a row of ``Dataset.nested``) as numpy arrays.

    meta, actions (T, A), states (T, S), rewards (T), is_terminal (list), and images by
    camera (T, H, W, C); a camera is left out unless every frame has it, decodable and
    in one size. Cameras are matched by name.
    """
    frames = row["frames"]
    stack = lambda c, n: np.array([f[c] or [] for f in frames], np.float32).reshape(len(frames), -1) if frames else np.zeros((0, n), np.float32)
    meta = {"episode_id": row["episode_id"], "embodiment": row["embodiment"], "task": row["language_instruction"], "num_frames": len(frames), "fps": row["fps"], "action_dim": row["action_dim"], "success": row["success"], "total_reward": row["total_reward"]}
    out = {"meta": meta, "actions": stack("action", row["action_dim"] or 0), "states": stack("state", 0), "rewards": np.array([f["reward"] or 0.0 for f in frames], np.float32), "is_terminal": [bool(f["is_terminal"]) for f in frames]}
    if not images:
        return out
    out["images"] = {}
    for camera in dict.fromkeys(i["camera"] for i in (frames[0]["images"] if frames else ())):
        shown = [next((i for i in f["images"] if i["camera"] == camera), None) for f in frames]
        pixels = [None if i is None else picture(i) for i in shown]
        if all(p is not None and p.shape == pixels[0].shape for p in pixels):
            out["images"][camera] = np.stack(pixels)
    return out


def picture(image) -> np.ndarray | None:
    """The pixels (H, W, C) of a stored image, or None if its bytes are not an image of its sizes."""
    data = bytes(image["data"] or b"")
    if data[:3] == codecs.JPEG or data[:4] == codecs.PNG:
        try:
            return codecs.decode(data)
        except codecs.ImageError:
            return None
    h, w, c = (image[k] or 0 for k in ("height", "width", "channels"))
    return np.frombuffer(data, np.uint8).reshape(h, w, c) if data and len(data) == h * w * c else None


def sample(episode: dict, image_key: str | None = None, image_size: tuple[int, int] | None = None, to_tensor: bool = False) -> dict:
    """A training sample from ``arrays``: one camera, resized, as floats (T, C, H, W) in 0..1; tensors where torch is there."""
    meta = episode["meta"]
    out = {"action": episode["actions"], "state": episode["states"], "reward": episode["rewards"], "task": meta["task"], "embodiment": meta["embodiment"], "success": meta["success"], "episode_id": meta["episode_id"]}
    shown = episode.get("images") or {}
    camera = image_key or next(iter(shown), None)
    if camera in shown:
        pixels = shown[camera] if image_size is None else codecs.resized(shown[camera], *image_size)
        out["image"], out["camera"] = codecs.normalised(pixels), camera
    if to_tensor:
        try:
            import torch
        except ImportError:
            return out
        out = {k: torch.from_numpy(np.ascontiguousarray(v)) if isinstance(v, np.ndarray) else v for k, v in out.items()}
    return out


# Iterators ---------------------------------------------------------------------------


def prefetched(data: Dataset, order: list[int] | DataFrame | None = None, images: bool = True) -> Iterator[Row]:
    """Episodes one after the other, read ahead by one partition.

    ``order`` lists positions, which may repeat, or is a DataFrame (place, position);
    without it all episodes come by position. Closing the generator ends the reading.
    """
    if order is None:
        rows = data.nested(images).orderBy("position")
    else:
        spark = data.episodes.sparkSession
        wanted = order if isinstance(order, DataFrame) else spark.createDataFrame([(k, int(p)) for k, p in enumerate(order)], "place long, position long")
        rows = data.fetch_positions(wanted, images)
    yield from rows.toLocalIterator(prefetchPartitions=True)


class MapSamples:
    """Samples by number: of all episodes, or of those that satisfy a KQL query."""

    def __init__(self, data: Dataset, kql_filter: str | None = None, image_key: str | None = None, image_size: tuple[int, int] | None = None, to_tensor: bool = False):
        self.data, self.options = data, (image_key, image_size, to_tensor)
        hits = data.query(kql_filter) if kql_filter else data.episodes.orderBy("position")
        self.indices = [r[0] for r in hits.select("position").collect()]

    def __len__(self) -> int:
        return len(self.indices)

    def __getitem__(self, k: int) -> dict:
        row = self.data.read_episode(self.indices[k]).head()
        return sample(arrays(row), *self.options)


class IterSamples:
    """Streams samples in epochs: one dataset, or datasets with weights by name.

    Each iteration is the next epoch. Its length is that of the schedule.
    """

    def __init__(self, spark: SparkSession, data: Dataset | dict[str, tuple[Dataset, float]], kql_filter: str | None = None, image_key: str | None = None, image_size: tuple[int, int] | None = None, shuffle: bool = True, seed: int = 42, to_tensor: bool = False):
        self.options, self.shuffle, self.seed, self.epoch = (image_key, image_size, to_tensor), shuffle, seed, 0
        if isinstance(data, Dataset):
            self.data = data
            hits = data.query(kql_filter) if kql_filter else data.episodes
            self.order = lambda epoch: epoch_order(hits.select("position"), seed, epoch, shuffle)
        elif isinstance(data, dict):
            mix = Mixture.of(data, seed)
            self.data = mix.dataset()
            sources = mix.table(spark).select("source_idx", F.col("norm_weight").alias("weight"))
            positions = mix.union().select("source_idx", "position")
            self.order = lambda epoch: schedule(sources, positions, seed, epoch, shuffle)
        else:
            raise ValueError("give a dataset, or datasets and weights by name")

    def __len__(self) -> int:
        return self.order(0).count()

    def __iter__(self) -> Iterator[dict]:
        order, self.epoch = self.order(self.epoch).select("place", "position"), self.epoch + 1
        for row in prefetched(self.data, order):
            yield sample(arrays(row), *self.options)


def from_mixture(spark: SparkSession, sources: dict[str, tuple[Dataset, float]], seed: int = 42, **options) -> IterSamples:
    return IterSamples(spark, sources, seed=seed, **options)


def batches(draw: Callable[[int], list[Row]], total: int, size: int) -> Iterator[Row]:
    """Episodes from as many batches as ``total`` needs, as a remote reader streams them; the last batch is whole."""
    for _ in range(-(-total // size)):
        yield from draw(size)
