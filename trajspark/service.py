"""The service façade: information, metadata, episodes, batches and queries of one dataset or mixture.

Results are DataFrames; errors are typed. ``Client`` offers the same calls as a remote
reader would, on any object with these methods; Spark Connect carries both over a wire.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from trajspark.operators import training
from trajspark.operators.dataset import Dataset
from trajspark.operators.mixture import Mixture, sequential_batch
from trajspark.plans.kql import KqlParseError


class ServiceError(Exception):
    pass


class NotFound(ServiceError):
    pass


class InvalidArgument(ServiceError):
    pass


class Service:
    """Serves a dataset, or a mixture as one; random draws continue from call to call.

    A single dataset is drawn from like a mixture of one source, by the seed.
    """

    def __init__(self, spark: SparkSession, backend: Dataset | Mixture, seed: int = 42):
        self.spark, self.mixed = spark, isinstance(backend, Mixture)
        self.mixture = backend if self.mixed else None
        self.data = backend.dataset() if self.mixed else backend
        self.seed, self._size = seed, None

    def num_episodes(self) -> int:
        if self._size is None:
            self._size = self.mixture.total_episodes if self.mixed else self.data.num_episodes()
        return self._size

    def server_info(self) -> DataFrame:
        frames = self.mixture.totals()[1] if self.mixed else self.data.num_frames()
        row = (self.num_episodes(), frames, self.mixed, len(self.mixture.sources) if self.mixed else 1)
        return self.spark.createDataFrame([row], "num_episodes long, num_frames long, is_mixture boolean, num_sources int")

    def _checked(self, position: int) -> int:
        if not 0 <= position < self.num_episodes():
            raise NotFound(f"position {position} of {self.num_episodes()}")
        return position

    def get_meta(self, position: int) -> DataFrame:
        return Dataset(self.data.read_meta(self._checked(position))).meta_flags()

    def get_episode(self, position: int, include_images: bool = True) -> DataFrame:
        return self.data.read_episode(self._checked(position), include_images)

    def get_batch(self, batch_size: int, mode: str = "", offset: int = 0, include_images: bool = True) -> DataFrame:
        """Whole episodes by ``place``: in order from an offset, wrapping around, or drawn."""
        if batch_size < 1:
            raise InvalidArgument("batch_size must be positive")
        if self.num_episodes() < 1:
            raise InvalidArgument("the dataset is empty")
        if mode == "sequential":
            wanted = sequential_batch(self.spark, offset, batch_size, self.num_episodes())
        elif mode in ("random", "weighted", ""):
            if self.mixture is None:
                self.mixture = Mixture([("data", self.num_episodes(), 1.0)], self.seed)
            wanted = self.mixture.next_draws(self.spark, batch_size).select(F.col("draw_no").alias("place"), F.col("global_idx").alias("position"))
        else:
            raise InvalidArgument(f"unknown mode {mode!r}: sequential, random or weighted")
        return self.data.fetch_positions(wanted, include_images)

    def query(self, kql: str, limit: int = 0) -> DataFrame:
        """Positions and metadata of the hits; a limit of 0 means all."""
        try:
            return self.data.served(kql, limit)
        except KqlParseError as e:
            raise InvalidArgument(str(e)) from e

    def total_matches(self, kql: str, limit: int = 0) -> DataFrame:
        """How many rows ``query`` returns, so no more than the limit."""
        return self.query(kql, limit).agg(F.count("*").alias("total_matches"))


class Client:
    """A reader of a service: dictionaries of arrays, and a stream of random batches."""

    def __init__(self, service: Service):
        self.service = service

    def server_info(self) -> dict:
        return self.service.server_info().head().asDict()

    def get_meta(self, position: int) -> dict:
        return self.service.get_meta(position).head().asDict()

    def get_episode(self, position: int, include_images: bool = True) -> dict:
        return training.arrays(self.service.get_episode(position, include_images).head(), include_images)

    def get_batch(self, batch_size: int, **options) -> list[dict]:
        return [training.arrays(r, options.get("include_images", True)) for r in self.service.get_batch(batch_size, **options).collect()]

    def query(self, kql: str, limit: int = 0) -> list[int]:
        return [r["position"] for r in self.service.query(kql, limit).collect()]

    def stream(self, batch_size: int = 32, mode: str = "random") -> Iterator[dict]:
        """An epoch of episodes, in as many batches as cover the dataset."""
        draw = lambda n: self.service.get_batch(n, mode).collect()
        row: Row
        for row in training.batches(draw, self.service.num_episodes(), batch_size):
            yield training.arrays(row)
