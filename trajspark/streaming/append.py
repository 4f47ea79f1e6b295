"""A dataset that grows by a stream of whole episodes.

Each micro-batch of ``schema.EPISODE_ROWS`` is checked and appended under ``path`` as one
folder of each table, named by the batch, so a batch that runs again replaces itself. Its
positions follow those of the batches before, which a small table of totals gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from trajspark.operators.dataset import Dataset
from trajspark.operators.ordering import with_position

TOTALS = "batch bigint, episodes bigint, frames bigint"


def _batches(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(TOTALS).parquet(f"{path}/totals")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], TOTALS)
        raise


def append(rows: DataFrame, batch: int, path: str, dataset: str = "stream") -> None:
    """Append the episodes of a batch; those without frames, or with an action of another length than action_dim, are refused."""
    spark = rows.sparkSession
    wrong = (F.size("frames") < 1) | F.exists("frames", lambda f: F.size(f["action"]) != F.col("action_dim"))
    if not rows.where(F.coalesce(wrong, F.lit(True))).isEmpty():
        raise ValueError(f"batch {batch} has an episode without frames or with actions of another length")
    before = _batches(spark, path).where(F.col("batch") < batch).agg(F.coalesce(F.sum("episodes"), F.lit(0))).head()[0]
    placed = with_position(rows.withColumnRenamed("position", "_key"), "_key").withColumn("position", F.col("position") + before).drop("_key").withColumn("dataset", F.lit(dataset))
    first = F.get("frames", F.lit(0))
    episodes = placed.select(
        "dataset", "position", F.col("position").alias("episode_id"), "embodiment", "language_instruction", F.size("frames").cast("long").alias("num_frames"), "fps", "action_dim",
        F.size(first["state"]).alias("state_dim"), "success", "total_reward",
    )
    each = placed.select("dataset", "position", F.posexplode("frames").alias("timestep", "f"))
    frames = each.select("dataset", "position", F.col("timestep").cast("long").alias("timestep"), "f.state", "f.action", F.coalesce("f.reward", F.lit(0.0).cast("float")).alias("reward"), "f.is_terminal")
    images = each.select("dataset", "position", F.col("timestep").cast("long").alias("timestep"), F.posexplode("f.images").alias("camera_pos", "i")).select("dataset", "position", "timestep", "camera_pos", "i.*")
    for name, table in (("episodes", episodes), ("frames", frames), ("images", images)):
        table.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    totals = episodes.agg(F.lit(batch).cast("long").alias("batch"), F.count("*").alias("episodes"), F.coalesce(F.sum("num_frames"), F.lit(0)).alias("frames"))
    totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals/at={batch}")


def appending(stream: DataFrame, path: str, checkpoint: str, dataset: str = "stream") -> DataStreamWriter:
    """The writer that appends a stream of episodes; start it with the trigger you want."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: append(rows, batch, path, dataset))


def load(spark: SparkSession, path: str) -> Dataset:
    """The dataset so far."""
    read = lambda name: spark.read.parquet(f"{path}/{name}").drop("batch")
    return Dataset(read("episodes"), read("frames"), read("images"))
