"""Weighted mixtures: a seeded xorshift64 draw sequence joined to the sources.

The generator is linear over GF(2), so a jump of m steps is a 64 x 64 bit matrix: each
block of draws starts at its own state, and inside a block so do the lanes of an array,
which step together. The draws are made in parallel, bit for bit the sequence of a
single loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.functions import scalars
from trajspark.operators.dataset import Dataset

MASK = (1 << 64) - 1
#: Draws of a task, and the lanes that step together.
BLOCK, LANES = 1 << 20, 1024
DRAWS = "draw_no long, source_idx int, local_idx long, global_idx long"


def xorshift(x):
    """The next state: of a number, or of each in an array of 64-bit numbers."""
    # The shifts of the generator.
    a, b, c = 13, 7, 17
    if isinstance(x, np.ndarray):
        a, b, c = (np.uint64(n) for n in (a, b, c))
        x = x ^ (x << a)
        x = x ^ (x >> b)
        return x ^ (x << c)
    x ^= (x << a) & MASK
    x ^= x >> b
    return x ^ ((x << c) & MASK)


def _columns(steps: int) -> list[int]:
    """The images of the 64 unit vectors after ``steps`` steps."""
    power, out = [xorshift(1 << k) for k in range(64)], [1 << k for k in range(64)]
    while steps:
        if steps & 1:
            out = [_applied(power, x) for x in out]
        power = [_applied(power, x) for x in power]
        steps >>= 1
    return out


def _applied(columns: list[int], x: int) -> int:
    out = 0
    for k, c in enumerate(columns):
        if x >> k & 1:
            out ^= c
    return out


def jump(seed: int, steps: int) -> int:
    return _applied(_columns(steps), seed)


def states(seed: int, first: int, n: int) -> np.ndarray:
    """States first + 1 .. first + n of the sequence."""
    each = max(1, -(-n // LANES))
    stride, x, starts = _columns(each), jump(seed, first), []
    for _ in range(-(-n // each)):
        starts.append(x)
        x = _applied(stride, x)
    lanes, out = np.array(starts, np.uint64), np.zeros((len(starts), each), np.uint64)
    for k in range(each):
        lanes = xorshift(lanes)
        out[:, k] = lanes
    return out.ravel()[:n]


def parse_source(text: str) -> tuple[str, float]:
    """``path:weight``; without a number after the last colon the weight is 1."""
    path, colon, weight = text.rpartition(":")
    try:
        return (path, float(weight)) if colon else (text, 1.0)
    except ValueError:
        return text, 1.0


class Mixture:
    """Sources (name, number of episodes, weight) drawn with replacement.

    Given ``datasets`` too, one for each source, draws fetch their episodes.
    """

    def __init__(self, sources: list[tuple[str, int, float]], seed: int = 42, datasets: list[Dataset] | None = None):
        if not sources:
            raise ValueError("a mixture needs a source")
        if any(w <= 0 for _, _, w in sources):
            raise ValueError("weights must be positive")
        if any(n <= 0 for _, n, _ in sources):
            raise ValueError("a source of a mixture is empty")
        total = sum(w for _, _, w in sources)
        self.sources, self.seed, start = [], seed, 0
        for k, (name, n, w) in enumerate(sources):
            self.sources.append((k, name, n, w / total, start))
            start += n
        self.total_episodes, self.datasets, self.drawn = start, datasets, 0

    @staticmethod
    def of(datasets: dict[str, tuple[Dataset, float]], seed: int = 42) -> Mixture:
        """A mixture of datasets by name, each with its weight."""
        return Mixture([(name, d.num_episodes(), w) for name, (d, w) in datasets.items()], seed, [d for d, _ in datasets.values()])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.sources, "source_idx int, name string, num_episodes long, norm_weight double, global_start long")

    def report(self, spark: SparkSession) -> DataFrame:
        """What is shown of the sources: path, episodes, weight, and the place of the first episode."""
        return self.table(spark).select("source_idx", scalars.path_tail(F.col("name")).alias("path"), "num_episodes", "norm_weight", "global_start")

    def totals(self) -> tuple[int, int]:
        """Episodes and frames of all sources."""
        return self.total_episodes, sum(d.num_frames() for d in self.datasets)

    # Draws ---------------------------------------------------------------------------

    def draws(self, spark: SparkSession, n: int, block: int = BLOCK, first: int = 0) -> DataFrame:
        """(draw_no, source_idx, local_idx, global_idx) of n draws from draw ``first`` on."""
        seed = self.seed
        sizes, starts = (np.array([s[k] for s in self.sources], np.uint64) for k in (2, 4))
        edges = []
        for s in self.sources:
            edges.append((edges[-1] if edges else 0.0) + s[3])
        edges = np.array(edges)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    low = b * block
                    x = states(seed, 2 * (first + low), 2 * (min(n, low + block) - low)).reshape(-1, 2)
                    # the first source whose cumulative weight exceeds r, else the last
                    pick = np.minimum(np.searchsorted(edges, x[:, 0].astype(float) / 2.0**64, "right"), len(edges) - 1)
                    local = x[:, 1] % sizes[pick]
                    columns = (np.arange(low, low + len(x)), pick.astype(np.int32), local.astype(np.int64), (starts[pick] + local).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["draw_no", "source_idx", "local_idx", "global_idx"])

        return spark.range(-(-n // block)).mapInArrow(run, DRAWS)

    def next_draws(self, spark: SparkSession, n: int) -> DataFrame:
        """The next n draws; each call goes on where the last one ended."""
        out = self.draws(spark, n, first=self.drawn)
        self.drawn += n
        return out

    def weighted_epoch(self, spark: SparkSession, n: int) -> DataFrame:
        """(draw_no, global_idx) of an epoch of n draws."""
        return self.draws(spark, n).select("draw_no", "global_idx")

    # Episodes ------------------------------------------------------------------------

    def union(self, table: str = "episodes") -> DataFrame:
        """All sources' rows with source_idx, local_idx and global_idx; positions are the global ones."""
        out = None
        for (k, _, _, _, start), d in zip(self.sources, self.datasets):
            rows = getattr(d, table).withColumn("source_idx", F.lit(k)).withColumn("local_idx", F.col("position")).withColumn("global_idx", F.col("position") + start)
            rows = rows.withColumn("position", F.col("global_idx")).drop("dataset")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def dataset(self) -> Dataset:
        """The virtual union as one dataset; every source keeps its own dimensions."""
        tables = {t: self.union(t) if all(getattr(d, t) is not None for d in self.datasets) else None for t in ("episodes", "frames", "images")}
        return Dataset(**tables)

    def sample(self, spark: SparkSession, n: int, images: bool = True) -> DataFrame:
        """The next n drawn episodes, whole, by draw_no; one that is drawn again comes again."""
        wanted = self.next_draws(spark, n).select(F.col("draw_no").alias("place"), F.col("global_idx").alias("position"))
        return self.dataset().fetch_positions(wanted, images).withColumnRenamed("place", "draw_no")

    def sample_meta(self, spark: SparkSession, n: int) -> DataFrame:
        """The metadata of the next n draws, by draw_no; frames are not read."""
        return self.next_draws(spark, n).select("draw_no", F.col("global_idx").alias("position")).join(self.union(), "position").orderBy("draw_no")

    def read_global(self, spark: SparkSession, wanted: DataFrame) -> DataFrame:
        """``wanted`` (global_idx) with source and local index: a range join with the few sources."""
        s = F.broadcast(self.table(spark))
        return wanted.join(s, (F.col("global_idx") >= F.col("global_start")) & (F.col("global_idx") < F.col("global_start") + F.col("num_episodes"))).select("global_idx", "source_idx", (F.col("global_idx") - F.col("global_start")).alias("local_idx"))

    def read_episode(self, spark: SparkSession, global_idx: int, images: bool = True) -> DataFrame:
        """One row: the whole episode at a global index."""
        if not 0 <= global_idx < self.total_episodes:
            raise IndexError(global_idx)
        return self.sample_of(spark, [global_idx], images)

    def sample_of(self, spark: SparkSession, wanted: list[int], images: bool = True) -> DataFrame:
        rows = spark.createDataFrame(list(enumerate(wanted)), "place long, position long")
        return self.dataset().fetch_positions(rows, images)

    def distribution(self, spark: SparkSession, n: int) -> DataFrame:
        """(embodiment, count) of n draws, most frequent first, by name where equal."""
        drawn = self.draws(spark, n).select(F.col("global_idx").alias("position")).join(self.union().select("position", "embodiment"), "position")
        return drawn.groupBy("embodiment").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "embodiment")


def sequential_batch(spark: SparkSession, offset: int, size: int, n: int) -> DataFrame:
    """Positions of a batch that wraps around at n."""
    if size < 1 or n < 1:
        raise ValueError("a batch and its dataset must not be empty")
    return spark.range(size).select(F.col("id").alias("place"), ((F.col("id") + offset) % n).alias("position"))
