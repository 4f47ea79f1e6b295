"""Reports on a dataset: info, schema, mixture, ingest and their display forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.functions import scalars
from trajspark.operators.dataset import Dataset

#: How many of a set a report shows, and from how many episodes cameras are taken.
SHOWN, CAMERA_EPISODES = 10, 10


def info(data: Dataset) -> DataFrame:
    """Counts, mean length, and the success rate among episodes whose success is known."""
    n, known = F.count("*"), F.count("success")
    return data.episodes.agg(
        n.alias("num_episodes"), F.coalesce(F.sum("num_frames"), F.lit(0)).cast("long").alias("total_frames"), (F.sum("num_frames") / F.when(n > 0, n)).alias("mean_frames"),
        F.when(known > 0, F.count_if("success") / F.when(known > 0, known) * 100).alias("success_rate_known"),
    )


def values(data: Dataset, column: str) -> DataFrame:
    """The distinct values of a column with their counts."""
    return data.episodes.groupBy(column).agg(F.count("*").alias("n"))


def listed(data: Dataset, column: str, shown: int = SHOWN) -> DataFrame:
    """(value, more): the first distinct values in order, and how many more there are."""
    distinct = data.episodes.select(F.col(column).alias("value")).distinct()
    count = distinct.agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))
    return distinct.orderBy("value").limit(shown).join(F.broadcast(count))  # one row


def episodes_table(data: Dataset) -> DataFrame:
    """What the list of episodes shows."""
    return data.episodes.select("position", "episode_id", "embodiment", "num_frames", "action_dim", "state_dim", scalars.cut(F.col("language_instruction"), 30).alias("task")).orderBy("position")


def schema(data: Dataset) -> DataFrame:
    """Frame statistics, the success rate among all episodes if any is known, and the mean known reward."""
    known = F.count("success")
    return data.episodes.agg(
        F.min("num_frames").alias("min_frames"), F.max("num_frames").alias("max_frames"), F.avg("num_frames").alias("avg_frames"), F.countDistinct("language_instruction").alias("num_tasks"),
        F.when(known > 0, F.count_if("success") / F.count("*") * 100).alias("success_rate_all"), F.avg(F.col("total_reward").cast("double")).alias("avg_reward"),
    )


def sets(data: Dataset) -> DataFrame:
    """One row: the summaries of the distinct action dims, frame rates, embodiments, and the state dims of the first episodes."""
    # the sets of dims, rates and embodiments are small; tasks are only counted
    rows = data.episodes.agg(
        F.sort_array(F.collect_set("action_dim")).alias("action_dims"), F.collect_set(F.col("fps")).alias("rates"), F.sort_array(F.collect_set("embodiment")).alias("embodiments"),
        F.sort_array(F.collect_set(F.when(F.col("position") < CAMERA_EPISODES, F.col("state_dim")))).alias("state_dims"),
    )
    text = lambda c: scalars.set_summary(F.transform(c, lambda x: x.cast("string")))
    rates = F.transform(F.sort_array("rates"), lambda x: F.call_function("format_number", x.cast("double"), F.lit("0.0")))
    return rows.select(text("action_dims").alias("action_dims"), scalars.set_summary(F.array_distinct(rates)).alias("fps"), scalars.set_summary(F.col("embodiments")).alias("embodiments"), text("state_dims").alias("state_dims"))


def cameras(data: Dataset) -> DataFrame:
    """(camera, width, height, channels) of the first frames of the first episodes; the sizes of the first episode win, in it the last image's."""
    first = data.images.where((F.col("position") < CAMERA_EPISODES) & (F.col("timestep") == 0))
    size = F.struct("width", "height", "channels")
    return first.groupBy("camera").agg(F.min_by(size, F.struct("position", -F.col("camera_pos"))).alias("size")).select("camera", "size.*")


def byte_budget(data: Dataset) -> DataFrame:
    """Bytes of each episode's sections in the compact file layout, with images as they are stored."""
    e = F.col
    text = F.octet_length("embodiment") + F.octet_length("language_instruction")
    out = data.episodes.select(
        "position", "num_frames", (10 + text + F.when(e("total_reward").isNotNull(), 4).otherwise(0)).cast("long").alias("meta_bytes"),
        (e("num_frames") * (4 * (e("state_dim") + e("action_dim")) + 5)).cast("long").alias("action_bytes"), (e("num_frames") * 2).cast("long").alias("image_bytes"),
    )
    if data.images is not None:
        held = data.images.groupBy("position").agg(F.sum(16 + F.octet_length("camera") + F.octet_length("data")).alias("held"))
        out = out.join(held, "position", "left").withColumn("image_bytes", F.col("image_bytes") + F.coalesce("held", F.lit(0))).drop("held")
    total = F.col("meta_bytes") + F.col("action_bytes") + F.col("image_bytes")
    return out.select("position", "meta_bytes", "action_bytes", "image_bytes", total.alias("total_bytes"), F.call_function("div", F.col("action_bytes") + F.col("image_bytes"), F.col("num_frames")).alias("bytes_per_frame"))


def totals(data: Dataset) -> DataFrame:
    """One row, as an ingest reports it: episodes and frames."""
    return data.episodes.agg(F.count("*").alias("episodes"), F.coalesce(F.sum("num_frames"), F.lit(0)).cast("long").alias("frames"))


def summary(data: Dataset) -> str:
    """One line on the dataset."""
    r = totals(data).head()
    return f"{r['episodes']} episodes, {r['frames']} frames"
