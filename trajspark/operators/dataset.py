"""Dataset: episodes, frames and images as tables, with reads, queries and merge."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark import schema as schemas
from trajspark import storage
from trajspark.functions import scalars
from trajspark.operators.ordering import fresh, with_position
from trajspark.operators.validation import findings  # noqa: F401
from trajspark.plans import kql

META = ["position", "episode_id", "embodiment", "language_instruction", "num_frames", "fps", "action_dim", "state_dim", "success", "total_reward"]


class Dataset:
    """Episodes with their frames, images and catalog, where there are any.

    Nothing is read until a result is. Frames and images belong to episodes by
    ``position`` (and ``dataset``, if both have it), or else by ``episode_id``.
    """

    def __init__(self, episodes: DataFrame, frames: DataFrame | None = None, images: DataFrame | None = None, catalog: DataFrame | None = None):
        self.episodes, self.frames, self.images, self.catalog = episodes, frames, images, catalog

    # Metadata ------------------------------------------------------------------------

    def query(self, text: str, limit: int | None = None) -> DataFrame:
        """Episodes that satisfy a KQL query, by position. Only metadata is read; comparisons reach its scan."""
        hits = self.episodes.where(kql.compiled(text)).orderBy("position")
        return hits if limit is None else hits.limit(limit)

    def query_table(self, text: str, limit: int | None = None) -> DataFrame:
        """What a query shows: position, embodiment, frames, success, and the task cut to 28 characters."""
        shown = F.when(F.col("success").isNull(), "unknown").otherwise(F.col("success").cast("string"))
        return self.query(text, limit).select("position", "embodiment", "num_frames", "action_dim", shown.alias("success"), scalars.cut(F.col("language_instruction"), 28).alias("task"))

    def served(self, text: str, limit: int = 0) -> DataFrame:
        """Positions and metadata flags of the hits as a service returns them; a limit of 0 means all."""
        return Dataset(self.query(text, limit or None)).meta_flags()

    def positions(self, text: str) -> list[int]:
        """The positions of the hits; a query that does not parse raises a ValueError."""
        return [r[0] for r in self.query(text).select("position").collect()]

    def read_meta(self, position: int) -> DataFrame:
        return self.episodes.where(F.col("position") == position)

    def read_by_id(self, episode_id: int) -> DataFrame:
        """The first episode of an id."""
        return self.episodes.where(F.col("episode_id") == episode_id).orderBy("position").limit(1)

    def meta_flags(self) -> DataFrame:
        e = F.col
        keep = [c for c in ("dataset", *META[:-2]) if c in self.episodes.columns and c != "state_dim"]
        return self.episodes.select(*keep, e("success").isNotNull().alias("has_success"), F.coalesce("success", F.lit(False)).alias("success"), e("total_reward").isNotNull().alias("has_reward"), F.coalesce("total_reward", F.lit(0.0)).alias("total_reward"))

    def num_episodes(self) -> int:
        return self.episodes.count()

    def num_frames(self) -> int:
        """As the catalog states it, else as the metadata say."""
        table, column = (self.episodes, "num_frames") if self.catalog is None else (self.catalog, "num_frames")
        return table.agg(F.coalesce(F.sum(column), F.lit(0))).head()[0]

    def version(self) -> DataFrame:
        return self.catalog.select("dataset", F.concat_ws(".", "version_major", "version_minor").alias("version"))

    # Frames and images ---------------------------------------------------------------

    def key(self, rows: DataFrame) -> list[str]:
        shared = [c for c in ("dataset", "position") if c in rows.columns and c in self.episodes.columns]
        return shared if "position" in shared else ["episode_id"]

    def _of(self, rows: DataFrame, chosen: DataFrame) -> DataFrame:
        on = [c for c in self.key(rows) if c in chosen.columns]
        return rows.join(chosen.select(*on).distinct(), on, "left_semi")

    def read_frames(self, position: int) -> DataFrame:
        """The frames of one episode in order, without images."""
        if "position" in self.frames.columns:
            return self.frames.where(F.col("position") == position).orderBy("timestep")
        return self.frames.join(F.broadcast(self.read_meta(position).select("episode_id")), "episode_id", "left_semi").orderBy("timestep")

    def fetch(self, hits: DataFrame) -> DataFrame:
        """Frames of the episodes in ``hits``."""
        return self._of(self.frames, hits)

    def only(self, hits: DataFrame) -> Dataset:
        """The dataset of these episodes, places and ids as they are."""
        return Dataset(self._of(self.episodes, hits), self.frames and self._of(self.frames, hits), self.images and self._of(self.images, hits), self.catalog)

    def nested(self, images: bool = True, of: DataFrame | None = None) -> DataFrame:
        """One row an episode, its frames in order as an array, the images of each frame (in order of camera_pos) in it.

        An episode's frames meet in one task, as they must to be one value; episodes
        without frames have an empty array.
        """
        frames, episodes = self.frames, self.episodes if of is None else self._of(self.episodes, of)
        frames = frames if of is None else self._of(frames, of)
        on = self.key(frames)
        columns = [c for c in ("state", "action", "reward", "is_terminal") if c in frames.columns]
        frames = frames.select(*on, "timestep", *columns)
        if images and self.images is not None:
            seen = self.images if of is None else self._of(self.images, of)
            parts = [c for c in ("camera_pos", "camera", "width", "height", "channels", "format", "data") if c in seen.columns]
            shown = F.transform(F.sort_array(F.collect_list(F.struct(*parts))), lambda i: F.struct(*(i[p].alias(p) for p in parts if p != "camera_pos")))
            frames = frames.join(seen.groupBy(*on, "timestep").agg(shown.alias("images")), [*on, "timestep"], "left")
            kind = frames.schema["images"].dataType
            frames = frames.withColumn("images", F.coalesce("images", F.array().cast(kind)))
        else:
            frames = frames.withColumn("images", F.array().cast(f"array<{schemas.IMAGE}>"))
        rows = frames.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("timestep", *columns, "images"))).alias("frames"))
        out = episodes.join(rows, on, "left")
        return out.withColumn("frames", F.coalesce("frames", F.array().cast(out.schema["frames"].dataType)))

    def read_episode(self, position: int, images: bool = True) -> DataFrame:
        """One row: the whole episode at a position."""
        return self.nested(images, self.read_meta(position))

    def read_episode_by_id(self, episode_id: int, images: bool = True) -> DataFrame:
        return self.nested(images, self.read_by_id(episode_id))

    def read_actions(self, position: int) -> DataFrame:
        """One row: the episode without images, whose table is not read."""
        return self.read_episode(position, images=False)

    def fetch_positions(self, wanted: DataFrame, images: bool = True) -> DataFrame:
        """Whole episodes for ``wanted`` (place, position, and dataset if there are several), by place.

        A position may be wanted many times and is then given as often, but read and
        nested once; one that does not exist is left out.
        """
        on = [c for c in ("dataset", "position") if c in wanted.columns and c in self.episodes.columns]
        episodes = self.nested(images, wanted) if self.frames is not None else self._of(self.episodes, wanted)
        return wanted.join(episodes, on).orderBy("place")

    def first_camera(self, camera: str | None = None) -> DataFrame:
        """The images of one camera across all frames: that named, or each episode's first one."""
        if camera is not None:
            return self.images.where(F.col("camera") == camera)
        on = self.key(self.images)
        first = self.images.groupBy(*on).agg(F.min_by("camera", F.struct("timestep", "camera_pos")).alias("camera"))
        return self.images.join(first, [*on, "camera"])

    # Storage -------------------------------------------------------------------------

    def save(self, path: str) -> Dataset:
        """Write the tables under ``path``, sorted so that a position is found by the statistics of few row groups."""
        for name in ("episodes", "frames", "images"):
            rows = getattr(self, name)
            if rows is not None:
                rows.repartitionByRange("position").sortWithinPartitions("position", *(["timestep"] if name != "episodes" else [])).write.mode("overwrite").parquet(f"{path}/{name}")
        if self.catalog is not None:
            self.catalog.write.mode("overwrite").parquet(f"{path}/catalog")
        return Dataset.load(self.episodes.sparkSession, path, [n for n in ("frames", "images", "catalog") if getattr(self, n) is not None])

    @staticmethod
    def load(spark: SparkSession, path: str, tables: list[str]) -> Dataset:
        """The dataset that ``save`` wrote, with these tables beside the episodes."""
        return Dataset(spark.read.parquet(f"{path}/episodes"), **{n: spark.read.parquet(f"{path}/{n}") for n in tables})


class OnDemand(Dataset):
    """A dataset that makes each table by ``table(name)`` when it is first asked for; the catalog needs none."""

    def __init__(self, table: Callable[[str], DataFrame], catalog: DataFrame | None = None):
        self._table, self.catalog = table, catalog

    episodes = cached_property(lambda self: self._table("episodes"))
    frames = cached_property(lambda self: self._table("frames"))
    images = cached_property(lambda self: self._table("images"))


def merge(inputs: list[DataFrame], query: str | None = None) -> DataFrame:
    """All metadata in order of the inputs, duplicates kept, filtered, with new ids and positions."""
    return _merged(inputs, query).drop("_input", "_was")


def _merged(inputs: list[DataFrame], query: str | None) -> DataFrame:
    """``merge`` with the input and the position there of each episode (_input, _was)."""
    kept = [(d.where(kql.compiled(query)) if query else d).withColumn("_input", F.lit(k)).withColumn("_was", F.col("position")) for k, d in enumerate(inputs)]
    out = kept[0]
    for d in kept[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    # inputs have fewer than 2**40 episodes
    out = out.withColumn(order := fresh(out, "_order"), F.shiftleft(F.col("_input").cast("long"), 40) + F.col("position"))
    return with_position(out.drop("position", "episode_id"), order).withColumn("episode_id", F.col("position")).drop(order)


def merge_datasets(inputs: list[Dataset], query: str | None = None, name: str = "merged") -> Dataset:
    """Whole datasets one after the other; frames and images of episodes that are left out are not read on."""
    episodes = _merged([d.episodes for d in inputs], query)
    places = episodes.select("_input", "_was", "position")

    def moved(table: str) -> DataFrame | None:
        rows = [getattr(d, table) for d in inputs]
        if any(r is None for r in rows):
            return None
        out = None
        for k, r in enumerate(rows):
            r = r.withColumn("_input", F.lit(k)).withColumnRenamed("position", "_was")
            out = r if out is None else out.unionByName(r, allowMissingColumns=True)
        return out.join(places, ["_input", "_was"]).drop("_input", "_was").withColumn("dataset", F.lit(name))

    return Dataset(episodes.drop("_input", "_was").withColumn("dataset", F.lit(name)), moved("frames"), moved("images"))


def merge_counts(inputs: list[DataFrame], query: str | None = None) -> DataFrame:
    """(input, total, written, skipped, frames): what a merge takes from each input."""
    keep: Column = kql.compiled(query) if query else F.lit(True)
    out = None
    for k, d in enumerate(inputs):
        one = d.select(F.lit(k).alias("input"), keep.alias("keep"), "num_frames")
        out = one if out is None else out.unionByName(one)
    written = F.count_if("keep")
    return out.groupBy("input").agg(F.count("*").alias("total"), written.alias("written"), (F.count("*") - written).alias("skipped"), F.coalesce(F.sum(F.when(F.col("keep"), F.col("num_frames"))), F.lit(0)).alias("frames"))


def kept_dataset(spark: SparkSession, key: str, episodes, frames) -> Dataset:
    """A derived dataset whose tables are written once an application."""
    return Dataset(storage.kept(spark, f"{key}/episodes", episodes), storage.kept(spark, f"{key}/frames", frames))
