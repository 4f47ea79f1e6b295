"""Trajectories derived from the relational test tables, written once an application."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajspark import storage
from trajspark.operators.dataset import Dataset
from trajspark.operators.ordering import with_position


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """One row per line item: episode_id, timestep and the vector elements."""
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        F.col("l_orderkey").alias("episode_id"), (F.row_number().over(w) - 1).cast("long").alias("timestep"), "p_name",
        *(F.col(f"l_{c}").alias(c) for c in ("quantity", "extendedprice", "discount", "tax")),
    )


def _episodes(spark: SparkSession, d: str, lines: DataFrame) -> DataFrame:
    first = F.min_by("p_name", "timestep").alias("language_instruction")
    ep = lines.groupBy("episode_id").agg(F.count("*").alias("num_frames"), first, F.sum(F.col("extendedprice").cast("decimal(18,2)")).alias("r"))
    orders = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    both = ep.join(orders, F.col("episode_id") == F.col("o_orderkey")).select(
        "episode_id", F.col("c_mktsegment").alias("embodiment"), "language_instruction", "num_frames", (F.substring("o_orderpriority", 1, 1).cast("float") * 10).cast("float").alias("fps"),
        F.lit(4).alias("action_dim"), F.lit(2).alias("state_dim"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("success"),
        F.when(F.col("o_orderstatus") != "P", F.col("r").cast("double")).alias("total_reward"), "o_orderstatus",
    )
    return with_position(both, "episode_id").repartitionByRange("position").sortWithinPartitions("position")


def orders(spark: SparkSession, d: str) -> Dataset:
    """Orders as episodes, their line items as frames; both tables are sorted by position."""
    lines = storage.kept(spark, f"{d}/lines", lambda: _lines(spark, d))
    episodes = storage.kept(spark, f"{d}/episodes", lambda: _episodes(spark, d, lines))

    def frames() -> DataFrame:
        each = lines.join(episodes.select("episode_id", "position", "num_frames"), "episode_id")
        real = lambda *c: F.array(*(F.col(x).cast("float") for x in c))
        out = each.select(
            "position", "episode_id", "timestep", real("quantity", "discount").alias("state"), real("quantity", "extendedprice", "discount", "tax").alias("action"),
            F.lit(None).cast("float").alias("reward"), (F.col("timestep") == F.col("num_frames") - 1).alias("is_terminal"), "quantity", "extendedprice", "discount", "tax",
        )
        return out.repartitionByRange("position").sortWithinPartitions("position", "timestep")

    return Dataset(episodes, storage.kept(spark, f"{d}/frames", frames))


def order_frames(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).frames


def order_episodes(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).episodes


def event_steps(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        "event_id", "ts", "user_id", "value", (kind == "signup").alias("is_first"), (kind == "purchase").alias("is_last"), (kind == "error").alias("is_terminal")
    )
