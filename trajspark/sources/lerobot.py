"""Episodes and frames of a LeRobot folder (meta/info.json, meta/tasks.*, data/**/*.parquet).

All files are read by Spark, so the folder may be in any store. Rows keep the order of
their files' paths and their place in the file; ``frame_index`` is not used. Rewards
and success are unknown (null) and only the last frame of an episode is terminal.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trajspark.operators.ordering import with_position

# Fixed values of the format.
FPS, ROBOT = 30.0, "unknown"
ACTION, STATE = "action", "observation.state"


def _has(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether ``folder`` holds a file ``name``; only the listing is read."""
    return not spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).select("path").isEmpty()


def info(spark: SparkSession, folder: str) -> tuple[float, str]:
    """Frames per second and robot type, from meta/info.json, which must be there."""
    if not _has(spark, f"{folder}/meta", "info.json"):
        raise FileNotFoundError(f"{folder}/meta/info.json")
    got = json.loads(spark.read.text(f"{folder}/meta/info.json", wholetext=True).head()[0])
    fps, robot = got.get("fps"), got.get("robot_type")
    return float(fps) if isinstance(fps, (int, float)) else FPS, robot if isinstance(robot, str) else ROBOT


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """(task_index, task): tasks.jsonl if there is one, else tasks.parquet, else no rows.

    Lines that don't parse, negative indexes and empty tasks are left out; of lines with
    the same index the last one holds.
    """
    meta = f"{folder}/meta"
    if _has(spark, meta, "tasks.jsonl"):
        lines = spark.read.text(f"{meta}/tasks.jsonl", wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
        row = F.from_json("value", "task_index long, task string")
        found = lines.select("line", row["task_index"].alias("task_index"), row["task"].alias("task"))
    elif _has(spark, meta, "tasks.parquet"):
        table = spark.read.parquet(f"{meta}/tasks.parquet")
        name = next((f.name for f in table.schema if f.name == "task"), None) or next((f.name for f in table.schema if isinstance(f.dataType, T.StringType)), None)
        if name is None:
            raise ValueError(f"{meta}/tasks.parquet has no column of tasks")
        found = table.select(F.col("_metadata.row_index").alias("line"), F.col("task_index").cast("long").alias("task_index"), F.col(f"`{name}`").alias("task"))
    else:
        return spark.createDataFrame([], "task_index long, task string")
    return found.where("task_index >= 0 and task <> ''").groupBy("task_index").agg(F.max_by("task", "line").alias("task"))


def _vector(schema: T.StructType, prefix: str) -> Column:
    """The float columns ``prefix`` and ``prefix.*``, by name, as one array without nulls; other types add nothing."""
    real = (T.FloatType, T.DoubleType)
    pieces = []
    for f in sorted(schema, key=lambda f: f.name):
        if f.name != prefix and not f.name.startswith(prefix + "."):
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, real):
            pieces.append(F.array(c.cast("float")))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, real):
            pieces.append(F.coalesce(c.cast("array<float>"), F.array().cast("array<float>")))
    return F.filter(F.concat(*pieces), lambda v: v.isNotNull()) if pieces else F.array().cast("array<float>")


def _cameras(schema: T.StructType) -> list[tuple[str, str]]:
    """(column, camera) of the columns of encoded images."""
    out = []
    for f in sorted(schema, key=lambda f: f.name):
        if "image" in f.name and "state" not in f.name and isinstance(f.dataType, T.StructType) and "bytes" in f.dataType.names:
            camera = f.name.replace("observation.", "").replace("images.", "").replace("image", "camera")
            out.append((f.name, camera or "camera"))
    return out


class LeRobot:
    """A folder as DataFrames: ``episodes``, ``frames`` and ``images`` (encoded bytes)."""

    def __init__(self, spark: SparkSession, folder: str, dataset: str | None = None, embodiment: str | None = None, task: str | None = None, fps: float | None = None, max_episodes: int | None = None):
        self.spark, self.folder, self.task, self.limit = spark, folder.rstrip("/"), task, max_episodes
        found_fps, robot = info(spark, self.folder)
        self.fps = found_fps if fps is None else fps
        self.embodiment = robot if embodiment in (None, "unknown") else embodiment
        self.dataset = dataset or self.folder.rsplit("/", 1)[-1]
        self.rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("mergeSchema", "true").parquet(f"{self.folder}/data")
        if "episode_index" not in self.rows.columns or not isinstance(self.rows.schema["episode_index"].dataType, T.LongType):
            raise ValueError("episode_index must be a 64-bit integer")

    def _placed(self, *columns: Column) -> DataFrame:
        """The rows of the chosen episodes with position, timestep and the ``columns``; others aren't read."""
        at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
        steps = self.rows.select(F.col("episode_index").alias("_episode"), *at, *columns).where("_episode is not null")
        w = Window.partitionBy("_episode").orderBy("_file", "_row")
        steps = steps.withColumn("timestep", F.row_number().over(w).cast("long") - 1)
        places = with_position(self.rows.select(F.col("episode_index").alias("_episode")).where("_episode is not null").distinct(), "_episode")
        if self.limit is not None:
            places = places.where(F.col("position") < self.limit)
        return steps.join(places, "_episode").withColumn("dataset", F.lit(self.dataset))

    def frames(self) -> DataFrame:
        placed = self._placed(_vector(self.rows.schema, STATE).alias("state"), _vector(self.rows.schema, ACTION).alias("action"))
        last = F.max("timestep").over(Window.partitionBy("_episode"))
        return placed.select("dataset", "position", "timestep", "state", "action", F.lit(None).cast("float").alias("reward"), (F.col("timestep") == last).alias("is_terminal"))

    def episodes(self) -> DataFrame:
        index = F.col("task_index").cast("long") if "task_index" in self.rows.columns else F.lit(None).cast("long")
        sizes = [F.size(_vector(self.rows.schema, p)).alias(n) for p, n in ((ACTION, "_action"), (STATE, "_state"))]
        # the first row of each episode by file and place, without a sort of the rows
        first = lambda c: F.min_by(c, F.struct("_file", "_row"))
        steps = self.rows.select(F.col("episode_index").alias("_episode"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), index.alias("_task"), *sizes)
        found = steps.where("_episode is not null").groupBy("_episode").agg(
            F.count("*").alias("num_frames"), first("_task").alias("task_index"), first("_action").alias("action_dim"), first("_state").alias("state_dim")
        )
        found = with_position(found, "_episode")
        if self.limit is not None:
            found = found.where(F.col("position") < self.limit)
        found = found.join(tasks(self.spark, self.folder), "task_index", "left")
        name = F.lit(self.task) if self.task is not None else F.coalesce("task", F.concat(F.lit("episode_"), F.col("_episode")))
        return found.select(
            F.lit(self.dataset).alias("dataset"), "position", F.col("position").alias("episode_id"), F.lit(self.embodiment).alias("embodiment"), name.alias("language_instruction"), "num_frames",
            F.lit(self.fps).cast("float").alias("fps"), "action_dim", "state_dim", F.lit(None).cast("boolean").alias("success"), F.lit(None).cast("float").alias("total_reward"),
        )

    def images(self) -> DataFrame:
        """(dataset, position, timestep, camera_pos, camera, data): encoded images as they are; null ones are left out."""
        cameras = _cameras(self.rows.schema)
        if not cameras:
            return self.spark.createDataFrame([], "dataset string, position bigint, timestep bigint, camera_pos int, camera string, data binary")
        packed = F.array(*(F.struct(F.lit(camera).alias("camera"), F.col(f"`{c}`.bytes").alias("data")) for c, camera in cameras))
        placed = self._placed(packed.alias("_images")).select("dataset", "position", "timestep", F.filter("_images", lambda i: i["data"].isNotNull()).alias("_images"))
        return placed.select("dataset", "position", "timestep", F.posexplode("_images").alias("camera_pos", "i")).select("dataset", "position", "timestep", "camera_pos", "i.camera", "i.data")
