"""Registered queries of the trajectory operators, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajspark import service, storage
from trajspark.functions import images, scalars
from trajspark.operators import mixture, reports, training, validation
from trajspark.operators.dataset import Dataset, merge, merge_counts, merge_datasets
from trajspark.operators.segmentation import islands
from trajspark.operators.validation import findings
from trajspark.plans import kql
from trajspark.sinks import export
from trajspark.sources import adapters, compact, hdf5, lerobot, synth
from trajspark.streaming import append

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
META = ["position", "episode_id", "embodiment", "language_instruction", "num_frames", "fps", "action_dim", "state_dim", "success", "total_reward"]
KEY = ["position", "episode_id"]

EPISODES = """
fr AS (SELECT l_orderkey AS episode_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1 AS timestep,
  p_name, l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax FROM lineitem JOIN part ON l_partkey = p_partkey),
ep AS (SELECT episode_id, count(*) AS num_frames, arg_min(p_name, timestep) AS task, sum(CAST(extendedprice AS DECIMAL(18,2))) AS r FROM fr GROUP BY episode_id),
episodes AS (SELECT row_number() OVER (ORDER BY episode_id) - 1 AS position, episode_id, c_mktsegment AS embodiment, task AS language_instruction, num_frames,
  CAST(CAST(substr(o_orderpriority, 1, 1) AS FLOAT) * 10 AS FLOAT) AS fps, 4 AS action_dim, 2 AS state_dim, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS success,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(r AS DOUBLE) END AS total_reward, o_orderstatus
  FROM ep JOIN orders ON o_orderkey = episode_id JOIN customer ON c_custkey = o_custkey)
"""


def over_episodes(body: str) -> str:
    return f"WITH {EPISODES} {body}"


def dataset(spark: SparkSession, d: str) -> Dataset:
    return adapters.orders(spark, d)


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# KQL ---------------------------------------------------------------------------------
_KQL = {
    "kql_str_eq": ("embodiment = 'BUILDING'", "embodiment = 'BUILDING'"),
    "kql_str_neq": ("embodiment != 'BUILDING'", "embodiment <> 'BUILDING'"),
    "kql_contains_ci": ("task CONTAINS 'RED'", "contains(lower(language_instruction), 'red')"),
    "kql_bareword": ("embodiment = MACHINERY", "embodiment = 'MACHINERY'"),
    "kql_bool_eq": ("success = true", "success IS NOT DISTINCT FROM true"),
    "kql_bool_neq_includes_null": ("success != true", "success IS DISTINCT FROM true"),
    "kql_bool_null": ("success = null", "success IS NULL"),
    "kql_bool_not_null": ("success != null", "success IS NOT NULL"),
    "kql_num_eq_eps": ("num_frames = 4.0000005", "abs(num_frames - 4.0000005::DOUBLE) < 1e-6"),
    "kql_num_neq_eps": ("fps != 30", "abs(fps::DOUBLE - 30) >= 1e-6"),
    "kql_gt": ("num_frames > 5", "num_frames > 5"),
    "kql_lt": ("total_reward < 50000.5", "total_reward < 50000.5"),
    "kql_gte": ("fps >= 40", "fps >= 40"),
    "kql_lte": ("num_frames <= 2", "num_frames <= 2"),
    "kql_reward_null": ("total_reward = null", "total_reward IS NULL"),
    "kql_reward_neq_null_empty": ("total_reward != null", "false"),
    "kql_reward_neq_value": ("total_reward != 0", "total_reward IS NOT NULL AND abs(total_reward) >= 1e-6"),
    "kql_type_mismatch_empty": ("task != 5", "false"),
    "kql_compound": ("success = true AND num_frames > 3 AND task CONTAINS 'red'", "success AND num_frames > 3 AND contains(lower(language_instruction), 'red')"),
}
for _name, (_text, _where) in _KQL.items():
    register(_name, lambda s, d, q=_text: dataset(s, d).query(q).select(*KEY), over_episodes(f"SELECT position, episode_id FROM episodes WHERE {_where}"))
register("kql_limit", lambda s, d: dataset(s, d).query("num_frames > 2", 25).select(*KEY), over_episodes("SELECT position, episode_id FROM episodes WHERE num_frames > 2 ORDER BY position LIMIT 25"))
register("kql_positions", lambda s, d: dataset(s, d).query("fps = 10").select("position"), over_episodes("SELECT position FROM episodes WHERE fps = 10"))
register("server_query_total", lambda s, d: service.Service(s, dataset(s, d)).total_matches("success = false", 100), over_episodes("SELECT count(*) AS total_matches FROM (SELECT 1 FROM episodes WHERE success = false LIMIT 100)"))

_GRID = "(VALUES (0, 'NaN'), (1, 'Infinity'), (2, '-Infinity'), (3, '0.0'), (4, '1.0'), (5, '1.0000005'), (6, '1.000002'), (7, NULL)) AS g(position, v)"


def _nan_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(f"SELECT CAST(position AS BIGINT) AS position, CAST(v AS DOUBLE) AS total_reward FROM {_GRID}")
    return rows.select("position", *(kql.compiled(f"total_reward {op} 1").alias(name) for op, name in (("=", "eq"), ("!=", "ne"), (">", "gt"), ("<=", "le"))))


_x = "coalesce(NOT isnan(x) AND {}, false)"
register(
    "kql_nan_grid", _nan_grid,
    f"SELECT position::BIGINT AS position, {_x.format('abs(x - 1) < 1e-6')} AS eq, {_x.format('abs(x - 1) >= 1e-6')} AS ne, {_x.format('x > 1')} AS gt, {_x.format('x <= 1')} AS le FROM (SELECT position, v::DOUBLE AS x FROM {_GRID})",
)

# Reads -------------------------------------------------------------------------------
register("episodes", lambda s, d: adapters.order_episodes(s, d).select(*META), over_episodes(f"SELECT {', '.join(META)} FROM episodes"))
register("read_meta_at", lambda s, d: dataset(s, d).read_meta(17).select(*META), over_episodes(f"SELECT {', '.join(META)} FROM episodes WHERE position = 17"))
register("read_by_id", lambda s, d: dataset(s, d).read_by_id(33).select(*META), over_episodes(f"SELECT {', '.join(META)} FROM episodes WHERE episode_id = 33 ORDER BY position LIMIT 1"))
register("meta_flags", lambda s, d: dataset(s, d).meta_flags().select("position", "has_success", "success", "has_reward", "total_reward"), over_episodes("SELECT position, success IS NOT NULL AS has_success, coalesce(success, false) AS success, total_reward IS NOT NULL AS has_reward, coalesce(total_reward, 0.0) AS total_reward FROM episodes"))
_FRAME = ["episode_id", "timestep", "quantity", "extendedprice", "discount", "tax"]
register("episode_frames", lambda s, d: dataset(s, d).read_frames(5).select(*_FRAME), over_episodes(f"SELECT {', '.join('fr.' + c for c in _FRAME)} FROM fr JOIN episodes e ON e.episode_id = fr.episode_id WHERE e.position = 5"))
register("actions_only", lambda s, d: adapters.order_frames(s, d).select(*_FRAME), over_episodes(f"SELECT {', '.join(_FRAME)} FROM fr"))
register("fetch_hits", lambda s, d: (lambda x: x.fetch(x.query("num_frames > 6")).select("episode_id", "timestep", "quantity"))(dataset(s, d)), over_episodes("SELECT episode_id, timestep, quantity FROM fr WHERE episode_id IN (SELECT episode_id FROM episodes WHERE num_frames > 6)"))

register("episode_nested", lambda s, d: dataset(s, d).read_episode(5).select("position", "embodiment", F.explode("frames").alias("f")).select("position", "embodiment", "f.timestep", F.col("f.action")[1].alias("price"), F.col("f.state")[0].alias("quantity"), "f.is_terminal", F.size("f.images").alias("images")), over_episodes("SELECT position, embodiment, timestep, extendedprice::FLOAT AS price, quantity::FLOAT AS quantity, timestep = num_frames - 1 AS is_terminal, 0 AS images FROM episodes JOIN fr USING (episode_id) WHERE position = 5"))
register("episode_nested_by_id", lambda s, d: dataset(s, d).read_episode_by_id(33, images=False).select("position", F.size("frames").alias("frames")), over_episodes("SELECT position, num_frames::INT AS frames FROM episodes WHERE episode_id = 33"))
register("episode_with_images", lambda s, d: (lambda f: f.select("f.timestep", F.posexplode("f.images").alias("k", "i")).select("timestep", "k", "i.camera", F.octet_length("i.data").alias("bytes"), F.hex(F.substring("i.data", 1, 3)).alias("first")))(synth.create_test(s, 3, 5, True).read_episode(1).select(F.explode("frames").alias("f"))), "SELECT t.range AS timestep, k.range::INT AS k, ['front', 'wrist'][(k.range + 1)::INT] AS camera, 12288 AS bytes, '0000' || printf('%02X', t.range * 51) AS first FROM range(5) t, range(2) k")
register("first_camera", lambda s, d: synth.create_test(s, 3, 4, True).first_camera().select("position", "timestep", "camera"), "SELECT e.range AS position, t.range AS timestep, 'front' AS camera FROM range(3) e, range(4) t")
register("fetch_positions", lambda s, d: (lambda x: x.fetch_positions(s.range(200).select(F.col("id").alias("place"), ((F.col("id") * 7 + 13) % 120).alias("position"))).select("place", "position", "num_frames", F.size("frames").alias("frames")))(dataset(s, d)), over_episodes("SELECT range AS place, position, num_frames, num_frames::INT AS frames FROM range(200) JOIN episodes ON position = (range * 7 + 13) % 120"))

# Reports -----------------------------------------------------------------------------
register("info_summary", lambda s, d: reports.info(dataset(s, d)), over_episodes("SELECT count(*) AS num_episodes, sum(num_frames)::BIGINT AS total_frames, sum(num_frames) / count(*)::DOUBLE AS mean_frames, count_if(success) / count(success)::DOUBLE * 100 AS success_rate_known FROM episodes"))
register("schema_frames_stats", lambda s, d: reports.schema(dataset(s, d)).drop("avg_reward"), over_episodes("SELECT min(num_frames) AS min_frames, max(num_frames) AS max_frames, avg(num_frames) AS avg_frames, count(DISTINCT language_instruction) AS num_tasks, count_if(success) / count(*)::DOUBLE * 100 AS success_rate_all FROM episodes"))
register("info_embodiments", lambda s, d: reports.values(dataset(s, d), "embodiment"), over_episodes("SELECT embodiment, count(*) AS n FROM episodes GROUP BY embodiment"))
register("info_tasks10", lambda s, d: reports.values(dataset(s, d), "language_instruction").orderBy("language_instruction").limit(10), over_episodes("SELECT language_instruction, count(*) AS n FROM episodes GROUP BY 1 ORDER BY 1 LIMIT 10"))
register("avg_reward", lambda s, d: reports.schema(dataset(s, d)).select(F.round("avg_reward", 3).alias("avg_reward")), over_episodes("SELECT round(avg(total_reward), 3) AS avg_reward FROM episodes"))
_BUDGET = "SELECT position, num_frames, (10 + octet_length(encode(embodiment)) + octet_length(encode(language_instruction)) + CASE WHEN total_reward IS NOT NULL THEN 4 ELSE 0 END)::BIGINT AS m, (num_frames * (4 * (state_dim + action_dim) + 5))::BIGINT AS a, (num_frames * 2)::BIGINT AS i FROM episodes"
register("byte_budget", lambda s, d: reports.byte_budget(dataset(s, d)), over_episodes(f"SELECT position, m AS meta_bytes, a AS action_bytes, i AS image_bytes, m + a + i AS total_bytes, (a + i) // num_frames AS bytes_per_frame FROM ({_BUDGET})"))
_CUT = "CASE WHEN length(language_instruction) > {0} THEN substr(language_instruction, 1, {0} - 3) || '...' ELSE language_instruction END AS task"
register("info_lists", lambda s, d: reports.listed(dataset(s, d), "language_instruction"), over_episodes("SELECT DISTINCT language_instruction AS value, (SELECT greatest(count(DISTINCT language_instruction) - 10, 0) FROM episodes) AS more FROM episodes ORDER BY value LIMIT 10"))
register("info_episodes", lambda s, d: reports.episodes_table(dataset(s, d)), over_episodes(f"SELECT position, episode_id, embodiment, num_frames, action_dim, state_dim, {_CUT.format(30)} FROM episodes"))
register("query_table", lambda s, d: dataset(s, d).query_table("num_frames >= 3", 40), over_episodes(f"SELECT position, embodiment, num_frames, action_dim, coalesce(success::VARCHAR, 'unknown') AS success, {_CUT.format(28)} FROM episodes WHERE num_frames >= 3 ORDER BY position LIMIT 40"))
_FPS = "printf('%.1f', x)"
_SET = "(SELECT CASE WHEN len(v) <= 4 THEN array_to_string(v, ', ') ELSE array_to_string(v[1:3], ', ') || '... (' || len(v) || ' total)' END FROM (SELECT list_transform(list_sort(list(DISTINCT {0})), lambda x: {1}) AS v FROM episodes{2}))"
register("schema_sets", lambda s, d: reports.sets(dataset(s, d)), over_episodes(f"SELECT {_SET.format('action_dim', 'x::VARCHAR', '')} AS action_dims, {_SET.format('fps', _FPS, '')} AS fps, {_SET.format('embodiment', 'x', '')} AS embodiments, {_SET.format('state_dim', 'x::VARCHAR', ' WHERE position < 10')} AS state_dims"))
register("schema_cameras", lambda s, d: reports.cameras(synth.create_test(s, 12, 3, True)), "SELECT unnest(['front', 'wrist']) AS camera, 64 AS width, 64 AS height, 3 AS channels")
register("ingest_totals", lambda s, d: reports.totals(dataset(s, d)), over_episodes("SELECT count(*) AS episodes, sum(num_frames)::BIGINT AS frames FROM episodes"))


def _vectors(e: DataFrame, f: DataFrame) -> DataFrame:
    """Frames with vectors of doubles, by episode_id."""
    elements = [F.col(c).cast("double") for c in ("quantity", "extendedprice", "discount", "tax")]
    return f.select("episode_id", "timestep", F.array(*elements).alias("action"), F.array(*elements[:2]).alias("state"), "is_terminal")


def _faulty(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, f = adapters.order_episodes(spark, d), adapters.order_frames(spark, d)
    return e.withColumn("embodiment", F.when(F.col("position") % 97 == 0, "").otherwise(F.col("embodiment"))).withColumn("num_frames", F.col("num_frames") + (F.col("position") % 89 == 0).cast("long")), _vectors(e, f)


def _faulty_frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, f = adapters.order_episodes(spark, d), adapters.order_frames(spark, d)
    k, first, nan, x = F.col("episode_id"), F.col("timestep") == 0, F.lit(float("nan")), F.col("action")
    action = F.when(first & (k % 79 == 0), F.slice(x, 1, 3)).when(first & (k % 73 == 0), F.transform(x, lambda v, i: F.when(i == 2, nan).otherwise(v))).otherwise(x)
    state = F.when((F.col("timestep") == 1) & (k % 71 == 0), F.slice("state", 1, 1)).when(first & (k % 67 == 0), F.array(F.lit(float("-inf")), nan)).otherwise(F.col("state"))
    return e, _vectors(e, f).select("episode_id", "timestep", action.alias("action"), state.alias("state"), (F.col("is_terminal") & (k % 83 != 0)).alias("is_terminal"))


register(
    "validate_findings", lambda s, d: findings(*_faulty(s, d)).select("position", "check", "severity"),
    over_episodes("SELECT position, 'id_mismatch' AS \"check\", 'warning' AS severity FROM episodes WHERE episode_id <> position UNION ALL SELECT position, 'empty_embodiment', 'warning' FROM episodes WHERE position % 97 = 0 UNION ALL SELECT position, 'frame_count', 'error' FROM episodes WHERE position % 89 = 0"),
)
register("validate_counts", lambda s, d: findings(*_faulty(s, d)).groupBy("severity").agg(F.count("*").alias("n")), over_episodes("SELECT severity, count(*) AS n FROM (SELECT 'warning' AS severity FROM episodes WHERE episode_id <> position UNION ALL SELECT 'warning' FROM episodes WHERE position % 97 = 0 UNION ALL SELECT 'error' FROM episodes WHERE position % 89 = 0) GROUP BY severity"))
_FAULT = "SELECT position, timestep, '{}' AS \"check\", '{}' AS severity FROM episodes JOIN fr USING (episode_id) WHERE {}"
register(
    "validate_terminal", lambda s, d: findings(*_faulty_frames(s, d)).where("check <> 'id_mismatch'").select("position", "timestep", "check", "severity"),
    over_episodes(" UNION ALL ".join([
        "SELECT position, NULL::BIGINT AS timestep, 'last_not_terminal' AS \"check\", 'warning' AS severity FROM episodes WHERE episode_id % 83 = 0",
        _FAULT.format("action_length", "error", "timestep = 0 AND episode_id % 79 = 0"), _FAULT.format("nonfinite_action", "warning", "timestep = 0 AND episode_id % 73 = 0 AND episode_id % 79 <> 0"),
        _FAULT.format("state_length", "error", "timestep = 1 AND episode_id % 71 = 0"), *2 * [_FAULT.format("nonfinite_state", "warning", "timestep = 0 AND episode_id % 67 = 0")],
    ])),
)
_CHECKED = "SELECT (SELECT count(*) FROM episodes) AS episodes_checked, (SELECT count(*) FROM fr) AS frames_checked, 0::BIGINT AS images_checked, count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings, 'FAILED' AS verdict FROM ({})"
register("validate_report", lambda s, d: (lambda e, f: validation.report(findings(e, f), e, f))(*_faulty(s, d)), over_episodes(_CHECKED.format("SELECT 'warning' AS severity FROM episodes WHERE episode_id <> position UNION ALL SELECT 'warning' FROM episodes WHERE position % 97 = 0 UNION ALL SELECT 'error' FROM episodes WHERE position % 89 = 0")))
register("validate_first", lambda s, d: validation.first(findings(*_faulty(s, d))).where("severity = 'error'").select("position", "check", "place"), over_episodes("SELECT position, 'frame_count' AS \"check\", row_number() OVER (ORDER BY position)::INT AS place FROM episodes WHERE position % 89 = 0 ORDER BY position LIMIT 10"))
register("validate_nonfinite", lambda s, d: adapters.table(s, d, "embeddings").select("vec_id", scalars.non_finite(F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 7 == 0) & (i == 3), F.lit(float("nan")).cast("float")).otherwise(x))).alias("bad")), "SELECT vec_id, vec_id % 7 = 0 AS bad FROM embeddings")

# Grouping in order -------------------------------------------------------------------
_STEPS = """steps AS (SELECT event_id, ts, value, event_type = 'signup' AS f, event_type IN ('purchase', 'error') AS c FROM events),
cut AS (SELECT *, f OR coalesce(lag(c) OVER (ORDER BY ts, event_id), true) AS b FROM steps),
isl AS (SELECT *, sum(b::INT) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS episode FROM cut)"""
_isl = lambda s, d: islands(adapters.event_steps(s, d), ["ts", "event_id"])
register("rlds_islands", lambda s, d: _isl(s, d).select("event_id", "episode"), f"WITH {_STEPS} SELECT event_id, episode::BIGINT AS episode FROM isl")
register("rlds_success", lambda s, d: _isl(s, d).groupBy("episode").agg(F.max_by("is_terminal", F.struct("ts", "event_id")).alias("success"), F.count("*").alias("num_frames")), f"WITH {_STEPS} SELECT episode::BIGINT AS episode, arg_max(event_type = 'error', (ts, event_id)) AS success, count(*) AS num_frames FROM isl JOIN events USING (event_id, ts) GROUP BY episode")
register("rlds_reward", lambda s, d: _isl(s, d).groupBy("episode").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total_reward")), f"WITH {_STEPS} SELECT episode::BIGINT AS episode, sum(value::DECIMAL(18,2))::DOUBLE AS total_reward FROM isl GROUP BY episode")


def _demos(path: str) -> dict:
    """The events of each user as a file of demonstrations: one mapping a user, in order of time."""
    import pyarrow.parquet as pq

    e = pq.read_table(path, columns=["user_id", "ts", "event_id", "value"]).sort_by([("user_id", "ascending"), ("ts", "ascending"), ("event_id", "ascending")]).to_pandas()
    value = lambda g: g["value"].to_numpy("float32")
    return {"data": {f"demo_{u}": {"actions": value(g)[:, None], "rewards": value(g) - 50, "obs": {"b": value(g)[:, None], "a": -value(g)[:, None]}} for u, g in e.groupby("user_id")}}


_hdf5 = lambda s, d: hdf5.read(s, f"{d}/events.parquet", "events", opener=_demos)
_HDF5 = "WITH u AS (SELECT user_id, list(value::FLOAT ORDER BY ts, event_id) AS v FROM events GROUP BY user_id) "
register("hdf5_episodes", lambda s, d: _hdf5(s, d).episodes.select("position", "language_instruction", "num_frames", "action_dim", "state_dim", "success", "total_reward"), _HDF5 + "SELECT row_number() OVER (ORDER BY user_id) - 1 AS position, 'events' AS language_instruction, len(v)::BIGINT AS num_frames, 1 AS action_dim, 2 AS state_dim, (v[-1] - 50::FLOAT)::FLOAT > 0 AS success, list_reduce(list_transform(v, lambda x: (x - 50::FLOAT)::FLOAT), lambda a, b: (a + b)::FLOAT) AS total_reward FROM u")
register("hdf5_frames", lambda s, d: _hdf5(s, d).frames.select("position", "timestep", F.col("action")[0].alias("a"), F.col("state")[0].alias("s0"), F.col("state")[1].alias("s1"), "reward", "is_terminal"), _HDF5 + ", x AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS position, v FROM u) SELECT position, (i - 1)::BIGINT AS timestep, v[i] AS a, -v[i] AS s0, v[i] AS s1, (v[i] - 50::FLOAT)::FLOAT AS reward, i = len(v) AS is_terminal FROM (SELECT position, v, unnest(range(1, len(v) + 1)) AS i FROM x)")
_NAMES = ["demo_10", "demo_2", "demo_x", "demo_1", "demo_", "demo_007"]
register("hdf5_demo_order", lambda s, d: s.createDataFrame([(n,) for n in hdf5.demos({"data": dict.fromkeys(_NAMES)})], "name string").withColumn("place", F.monotonically_increasing_id()).coalesce(1).select("name", F.row_number().over(Window.orderBy("place")).alias("place")), "SELECT unnest(['demo_', 'demo_x', 'demo_1', 'demo_2', 'demo_007', 'demo_10']) AS name, unnest(range(1, 7))::INT AS place")


def _lerobot(spark: SparkSession, d: str) -> lerobot.LeRobot:
    """The events of each user as a LeRobot folder, which is then read."""
    folder = storage.fresh_path(spark, "lerobot")
    kind = F.col("event_type")
    rows = adapters.table(spark, d, "events").select(
        F.col("user_id").alias("episode_index"), "ts", "event_id", F.when(kind == "click", 0).when(kind == "view", 1).when(kind == "purchase", 2).otherwise(9).cast("long").alias("task_index"),
        F.array(F.col("value").cast("float"), F.lit(None).cast("float")).alias("action"), F.col("value").alias("observation.state"), F.struct(F.encode("event_type", "utf-8").alias("bytes"), F.lit("x").alias("path")).alias("observation.images.top"),
    )
    rows.repartitionByRange(3, "episode_index").sortWithinPartitions("ts", "event_id").drop("ts", "event_id").write.parquet(f"{folder}/data")
    storage.put(f"{folder}/meta/info.json", b'{"fps": 12.5, "robot_type": "clicker"}')
    storage.put(f"{folder}/meta/tasks.jsonl", b'{"task_index": 0, "task": "old"}\n{"task_index": 0, "task": "browse"}\nno json\n{"task_index": 1, "task": "look"}\n{"task_index": 2, "task": "buy"}\n')
    return lerobot.LeRobot(spark, folder, "events")


_LEROBOT = "WITH u AS (SELECT *, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), p AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS position FROM (SELECT DISTINCT user_id FROM events)) "
register("lerobot_episodes", lambda s, d: _lerobot(s, d).episodes().drop("dataset"), _LEROBOT + "SELECT position, position AS episode_id, 'clicker' AS embodiment, CASE event_type WHEN 'click' THEN 'browse' WHEN 'view' THEN 'look' WHEN 'purchase' THEN 'buy' ELSE 'episode_' || user_id END AS language_instruction, n AS num_frames, 12.5::FLOAT AS fps, 1 AS action_dim, 1 AS state_dim, NULL::BOOLEAN AS success, NULL::FLOAT AS total_reward FROM u JOIN p USING (user_id) WHERE t = 0")
register("lerobot_frames", lambda s, d: _lerobot(s, d).frames().select("position", "timestep", F.col("action")[0].alias("a"), F.size("action").alias("n"), F.col("state")[0].alias("s"), "is_terminal"), _LEROBOT + "SELECT position, t AS timestep, value::FLOAT AS a, 1 AS n, value::FLOAT AS s, t = n - 1 AS is_terminal FROM u JOIN p USING (user_id)")
register("lerobot_images", lambda s, d: _lerobot(s, d).images().select("position", "timestep", "camera", F.decode("data", "utf-8").alias("shot")), _LEROBOT + "SELECT position, t AS timestep, 'top' AS camera, event_type AS shot FROM u JOIN p USING (user_id)")

# Merge and mixtures ------------------------------------------------------------------
_by = lambda s, d, x: adapters.order_episodes(s, d).where(F.col("o_orderstatus") == x)
_PART = "SELECT embodiment, num_frames, 0 AS k, position AS p FROM episodes WHERE o_orderstatus = 'F' {w} UNION ALL SELECT embodiment, num_frames, 1, position FROM episodes WHERE o_orderstatus = 'O' {w}"
for _name, _q, _w in (("merge_all", None, ""), ("merge_filtered", "num_frames > 4", "AND num_frames > 4")):
    register(_name, lambda s, d, q=_q: merge([_by(s, d, "F"), _by(s, d, "O")], q).select("episode_id", "embodiment", "num_frames"), over_episodes(f"SELECT row_number() OVER (ORDER BY k, p) - 1 AS episode_id, embodiment, num_frames FROM ({_PART.format(w=_w)})"))
register("merge_counts", lambda s, d: merge_counts([_by(s, d, "F"), _by(s, d, "O")], "num_frames > 4"), over_episodes("SELECT CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS input, count(*) AS total, count_if(num_frames > 4) AS written, count_if(num_frames <= 4) AS skipped, coalesce(sum(num_frames) FILTER (num_frames > 4), 0)::BIGINT AS frames FROM episodes WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus"))


def _split(spark: SparkSession, d: str, status: str) -> Dataset:
    """The orders of one status as a dataset of their own."""
    data = dataset(spark, d)
    return merge_datasets([data.only(data.episodes.where(F.col("o_orderstatus") == status))], name=status)


_AT = "SELECT row_number() OVER (ORDER BY k, p) - 1 AS position, episode_id, embodiment, num_frames FROM (SELECT episode_id, embodiment, num_frames, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS k, position AS p FROM episodes WHERE o_orderstatus <> 'P' AND num_frames > 4)"
register(
    "merge_frames", lambda s, d: merge_datasets([Dataset(_by(s, d, c), dataset(s, d).frames) for c in "FO"], "num_frames > 4").frames.select("position", "timestep", "quantity"),
    over_episodes(f"SELECT m.position, timestep, quantity FROM ({_AT}) m JOIN fr USING (episode_id)"),
)


def _rng(seed: int, n: int) -> str:
    m = "18446744073709551615::HUGEINT"
    a = f"xor(x, (x * 8192) & {m})"
    b = f"xor({a}, ({a}) >> 7)"
    return f"rng AS (SELECT 0 AS k, {seed}::HUGEINT AS x UNION ALL SELECT k + 1, xor({b}, (({b}) * 131072) & {m}) FROM rng WHERE k < {2 * n})"


def _epoch(seed: int, sizes: tuple[int, int], cut: float, n: int) -> str:
    return f"""WITH RECURSIVE {_rng(seed, n)}, dr AS (SELECT (a.k - 1) // 2 AS draw_no, CASE WHEN a.x::DOUBLE / 18446744073709551616.0 < {cut} THEN 0 ELSE 1 END AS source_idx, b.x AS y
FROM rng a JOIN rng b ON b.k = a.k + 1 WHERE a.k % 2 = 1), p AS (SELECT *, (y % CASE WHEN source_idx = 0 THEN {sizes[0]} ELSE {sizes[1]} END)::BIGINT AS local_idx FROM dr)
SELECT draw_no::BIGINT AS draw_no, source_idx, local_idx, local_idx + source_idx * {sizes[0]}::BIGINT AS global_idx FROM p"""


_MIX = {42: ((10, 10), (0.8, 0.2), 1000), 99: ((5, 5), (0.5, 0.5), 100)}
_mix = lambda seed: mixture.Mixture([(c, n, w) for c, n, w in zip("AB", *_MIX[seed][:2])], seed)
for _seed, (_sizes, _ws, _n) in _MIX.items():
    register(f"mix_epoch_{_seed}", lambda s, d, k=_seed: _mix(k).draws(s, _MIX[k][2], 300), _epoch(_seed, _sizes, _ws[0], _n))
register("mix_sample_distribution", lambda s, d: _mix(42).draws(s, 1000).groupBy("source_idx").agg(F.count("*").alias("n")), f"SELECT source_idx, count(*) AS n FROM ({_epoch(42, (10, 10), 0.8, 1000)}) GROUP BY source_idx")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    n = adapters.order_episodes(spark, d).groupBy("o_orderstatus").agg(F.count("*").alias("num_episodes"), F.sum("num_frames").alias("num_frames"))
    w = Window.orderBy("o_orderstatus")  # one row a source
    return n.withColumn("source_idx", (F.row_number().over(w) - 1).cast("long")).withColumn("global_start", F.sum("num_episodes").over(w) - F.col("num_episodes"))


_SRC = "SELECT o_orderstatus, count(*) AS num_episodes, sum(num_frames)::BIGINT AS num_frames, row_number() OVER (ORDER BY o_orderstatus) - 1 AS source_idx, (sum(count(*)) OVER (ORDER BY o_orderstatus) - count(*))::BIGINT AS global_start FROM episodes GROUP BY o_orderstatus"
register("mix_sources", _sources, over_episodes(_SRC))
register("mix_global_index", lambda s, d: (lambda x: merge([x.where(F.col("o_orderstatus") == c) for c in "FOP"]).select(F.col("position").alias("global_idx"), "embodiment", "num_frames"))(adapters.order_episodes(s, d)), over_episodes("SELECT row_number() OVER (ORDER BY o_orderstatus, position) - 1 AS global_idx, embodiment, num_frames FROM episodes"))
register("mix_read_global", lambda s, d: mixture.Mixture([("A", 5, 1.0), ("B", 3, 1.0)]).read_global(s, s.range(8).withColumnRenamed("id", "global_idx")), "SELECT range AS global_idx, CASE WHEN range < 5 THEN 0 ELSE 1 END AS source_idx, range - CASE WHEN range < 5 THEN 0 ELSE 5 END AS local_idx FROM range(8)")
_pair = lambda s, d: mixture.Mixture.of({"F": (_split(s, d, "F"), 0.8), "O": (_split(s, d, "O"), 0.2)})
_SIZES = tuple(f"(SELECT count(*) FROM episodes WHERE o_orderstatus = '{c}')" for c in "FO")
_BOTH = "both_ AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS source_idx, row_number() OVER (PARTITION BY o_orderstatus ORDER BY position) - 1 AS local_idx, row_number() OVER (ORDER BY o_orderstatus, position) - 1 AS global_idx FROM episodes WHERE o_orderstatus <> 'P')"


def _drawn(n: int, body: str) -> str:
    epoch = _epoch(42, _SIZES, 0.8, n)
    return f"WITH RECURSIVE {EPISODES}, {_BOTH}, {epoch[len('WITH RECURSIVE ') :].rsplit('SELECT draw_no', 1)[0]}, drawn AS (SELECT draw_no{epoch.rsplit('SELECT draw_no', 1)[1]}) {body}"


register("mix_sample", lambda s, d: _pair(s, d).sample(s, 150).select("draw_no", "source_idx", "num_frames", F.transform("frames", lambda f: f["action"][1])[0].alias("price"), F.size("frames").alias("frames")), _drawn(150, "SELECT drawn.draw_no, source_idx, num_frames, extendedprice::FLOAT AS price, num_frames::INT AS frames FROM drawn JOIN both_ USING (source_idx, local_idx) JOIN fr ON fr.episode_id = both_.episode_id AND fr.timestep = 0"))
register("mix_sample_meta", lambda s, d: _pair(s, d).sample_meta(s, 300).select("draw_no", "position", "embodiment", "num_frames"), _drawn(300, "SELECT drawn.draw_no, drawn.global_idx AS position, embodiment, num_frames FROM drawn JOIN both_ USING (source_idx, local_idx)"))
register("mix_distribution", lambda s, d: _pair(s, d).distribution(s, 300), _drawn(300, "SELECT embodiment, count(*) AS count FROM drawn JOIN both_ USING (source_idx, local_idx) GROUP BY embodiment"))
register("mix_report", lambda s, d: _pair(s, d).report(s), over_episodes(f"SELECT 0 AS source_idx, 'F' AS path, {_SIZES[0]} AS num_episodes, 0.8::DOUBLE AS norm_weight, 0::BIGINT AS global_start UNION ALL SELECT 1, 'O', {_SIZES[1]}, 0.2, {_SIZES[0]}"))
register("mix_read_episode", lambda s, d: _pair(s, d).read_episode(s, 700).select("position", "embodiment", "num_frames", F.explode("frames").alias("f")).select("position", "embodiment", "num_frames", "f.timestep", F.col("f.action")[0].alias("quantity")), over_episodes("SELECT global_idx AS position, embodiment, num_frames, timestep, quantity::FLOAT AS quantity FROM both_ JOIN fr USING (episode_id) WHERE global_idx = 700").replace(" SELECT global_idx", f", {_BOTH} SELECT global_idx", 1))
register("epoch_order", lambda s, d: training.epoch_order(dataset(s, d).episodes.select("position"), 42, 3), over_episodes("SELECT position, row_number() OVER (ORDER BY md5('45:' || position)) - 1 AS place FROM episodes"))


def _schedule(spark: SparkSession, d: str) -> DataFrame:
    weights = spark.createDataFrame([(0, 5.0), (1, 4.99), (2, 0.01)], "source_idx int, weight double")
    source = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("source_idx")
    return training.schedule(weights, dataset(spark, d).episodes.select(source, "position"), 42, 1)


register(
    "iter_schedule", _schedule,
    over_episodes("""SELECT source_idx, position, pick, row_number() OVER (ORDER BY md5('44:' || source_idx || ':' || pick)) - 1 AS place FROM (
  SELECT source_idx, position, i + turn * n AS pick FROM (SELECT *, unnest(range(0, CASE WHEN i < picks THEN (picks - 1 - i) // n + 1 ELSE 0 END)) AS turn FROM (
    SELECT source_idx, position, n, greatest(1, round_even(w / 10 * (SELECT count(*) FROM episodes), 0))::BIGINT AS picks, row_number() OVER (PARTITION BY source_idx ORDER BY md5('43:' || source_idx || ':' || position)) - 1 AS i FROM (
      SELECT position, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS source_idx, CASE o_orderstatus WHEN 'F' THEN 5.0::DOUBLE WHEN 'O' THEN 4.99 ELSE 0.01 END AS w, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM episodes))))"""),
)
register("service_info", lambda s, d: service.Service(s, _pair(s, d)).server_info(), over_episodes("SELECT count(*) AS num_episodes, sum(num_frames)::BIGINT AS num_frames, true AS is_mixture, 2 AS num_sources FROM episodes WHERE o_orderstatus <> 'P'"))
register("service_query_all", lambda s, d: service.Service(s, dataset(s, d)).query("success = true", 0).select("position", "has_success", "num_frames"), over_episodes("SELECT position, true AS has_success, num_frames FROM episodes WHERE success"))
register("service_batch", lambda s, d: service.Service(s, dataset(s, d)).get_batch(9, "sequential", 1_000_003).select("place", "position", "num_frames", F.size("frames").alias("frames")), over_episodes("SELECT range AS place, position, num_frames, num_frames::INT AS frames FROM range(9) JOIN episodes ON position = (1000003 + range) % (SELECT count(*) FROM episodes)"))
register("service_random", lambda s, d: service.Service(s, dataset(s, d)).get_batch(40, "random").select("place", "position", "num_frames"), over_episodes("SELECT draw_no AS place, position, num_frames FROM drawn JOIN episodes ON position = local_idx").replace("WITH ", "WITH RECURSIVE ", 1).replace(" SELECT draw_no AS place", ", " + _epoch(42, ("(SELECT count(*) FROM episodes)", 1), 2.0, 40)[len("WITH RECURSIVE ") :].rsplit("SELECT draw_no", 1)[0] + ", drawn AS (SELECT draw_no" + _epoch(42, ("(SELECT count(*) FROM episodes)", 1), 2.0, 40).rsplit("SELECT draw_no", 1)[1] + ") SELECT draw_no AS place", 1))
register("prefetch_order", lambda s, d: s.createDataFrame([(r["place"], r["position"], len(r["frames"])) for r in training.prefetched(dataset(s, d), [9, 0, 5, 3, 7, 9])], "place long, position long, frames int"), over_episodes("SELECT place, position, num_frames::INT AS frames FROM (SELECT unnest(range(6)) AS place, unnest([9, 0, 5, 3, 7, 9]) AS position) JOIN episodes USING (position)"))
register("batch_sequential_wrap", lambda s, d: mixture.sequential_batch(s, 95, 12, 100), "SELECT range AS place, (95 + range) % 100 AS position FROM range(12)")

# Exports, synthetic sources, scalars --------------------------------------------------
register(
    "json_export", lambda s, d: export.json_lines(dataset(s, d)),
    over_episodes("""SELECT position, '{"id":' || episode_id || ',"embodiment":"' || embodiment || '","task":"' || language_instruction || '","num_frames":' || num_frames || ',"action_dim":4,"fps":' || printf('%.1f', fps) || ',"success":' || coalesce(success::VARCHAR, 'null') || '}' AS value FROM episodes"""),
)
register("numpy_files", lambda s, d: export.file_sizes(dataset(s, d)).where("path not like '%meta.json'"), over_episodes("SELECT printf('episode_%06d/', position) || name || '.bin' AS path, num_frames * size AS bytes FROM episodes, (VALUES ('actions', 16), ('states', 8), ('rewards', 4)) AS t(name, size)"))


def _compact(spark: SparkSession, d: str) -> Dataset:
    """The orders, written as one compact file and read again."""
    path = f"{storage.fresh_path(spark, 'compact')}.traj"
    compact.write(dataset(spark, d), path, created=1711000000)
    return compact.read(spark, path)


register("compact_episodes", lambda s, d: _compact(s, d).episodes.select(*META), over_episodes("SELECT position, position AS episode_id, embodiment, language_instruction, num_frames, fps, action_dim, state_dim, success, total_reward::FLOAT AS total_reward FROM episodes"))
register("compact_frames", lambda s, d: _compact(s, d).frames.select("position", "timestep", *(F.col("action")[k].alias(f"a{k}") for k in range(4)), *(F.col("state")[k].alias(f"s{k}") for k in range(2)), "reward", "is_terminal"), over_episodes("SELECT position, timestep, quantity::FLOAT AS a0, extendedprice::FLOAT AS a1, discount::FLOAT AS a2, tax::FLOAT AS a3, quantity::FLOAT AS s0, discount::FLOAT AS s1, 0::FLOAT AS reward, timestep = num_frames - 1 AS is_terminal FROM fr JOIN episodes USING (episode_id)"))
register("compact_header", lambda s, d: _compact(s, d).catalog.select("version_major", "version_minor", "num_episodes", "num_frames", "index_offset", "index_length", "created_timestamp"), over_episodes(f"SELECT 0 AS version_major, 1 AS version_minor, count(*) AS num_episodes, sum(num_frames)::BIGINT AS num_frames, (64 + sum(m + a + i))::BIGINT AS index_offset, 64 * count(*) AS index_length, 1711000000::BIGINT AS created_timestamp FROM ({_BUDGET})"))
register("compact_by_position", lambda s, d: (lambda x: compact.read(s, x, positions=[3, 17]).frames)(_file(s, d)).groupBy("position").agg(F.count("*").alias("n")), over_episodes("SELECT position, num_frames AS n FROM episodes WHERE position IN (3, 17)"))


def _file(spark: SparkSession, d: str) -> str:
    path = f"{storage.fresh_path(spark, 'compact')}.traj"
    compact.write(dataset(spark, d), path)
    return path


def _streamed(spark: SparkSession, d: str) -> Dataset:
    """The orders, streamed in one batch into a growing dataset."""
    source, target = (storage.fresh_path(spark, n) for n in ("stream-in", "stream-out"))
    rows = dataset(spark, d).nested().select("position", "embodiment", "language_instruction", "fps", "success", F.col("total_reward").cast("float").alias("total_reward"), "action_dim", "frames")
    rows.write.parquet(source)
    append.appending(spark.readStream.schema(rows.schema).parquet(source), target, f"{target}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return append.load(spark, target)


register("stream_append", lambda s, d: (lambda x: x.episodes.join(x.frames.groupBy("position").agg(F.max("timestep").alias("last")), "position").select("position", "embodiment", "num_frames", "last"))(_streamed(s, d)), over_episodes("SELECT position, embodiment, num_frames, num_frames - 1 AS last FROM episodes"))
register("image_magic", lambda s, d: s.sql("SELECT explode(array('FFD8FFE0', '89504E47', 'FFD8', '')) AS h").select("h", images.is_encoded(F.unhex("h")).alias("encoded"), images.has_size(F.unhex("h"), F.lit(2), F.lit(1), F.lit(2)).alias("fits")), "SELECT h, h LIKE 'FFD8FF%' OR h LIKE '89504E47%' AS encoded, length(h) = 8 AS fits FROM (SELECT unnest(['FFD8FFE0', '89504E47', 'FFD8', '']) AS h)")
register("reward_fold", lambda s, d: adapters.table(s, d, "events").groupBy("user_id").agg(scalars.left_fold(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.col("value").cast("float").alias("v")))), lambda x: x["v"])).alias("total_reward")), "SELECT user_id, list_reduce(list(value::FLOAT ORDER BY ts, event_id), lambda a, b: (a + b)::FLOAT) AS total_reward FROM events GROUP BY user_id")
register("resize_index_map", lambda s, d: s.range(1).select(F.posexplode(scalars.resize_map(F.lit(84), 32)).alias("target", "source")), "SELECT range::INT AS target, (range * 84) // 32 AS source FROM range(32)")
_TASKS = ", ".join(f"'{t}'" for t in synth.TASKS)
register("synth_create_test", lambda s, d: synth.episodes(s, 20).select("position", "embodiment", "language_instruction", "success", "total_reward"), f"SELECT range AS position, ['widowx', 'franka', 'aloha', 'ur5'][(range % 4 + 1)::INT] AS embodiment, [{_TASKS}][(range % 6 + 1)::INT] AS language_instruction, range % 3 <> 0 AS success, CASE WHEN range % 3 <> 0 THEN 1.0 ELSE 0.0 END::FLOAT AS total_reward FROM range(20)")
register("synth_frames", lambda s, d: synth.frames(s, 4, 50).select("position", "timestep", *(F.col("state")[k].alias(f"s{k}") for k in (0, 2, 5)), F.col("action")[6].alias("grip"), "reward", "is_terminal"), "SELECT e.range AS position, t.range AS timestep, ((t.range::DOUBLE / 50)::FLOAT * 0.3::FLOAT)::FLOAT AS s0, (0.5::FLOAT + ((t.range::DOUBLE / 50)::FLOAT * 0.2::FLOAT)::FLOAT)::FLOAT AS s2, ((t.range::DOUBLE / 50)::FLOAT * 0.1::FLOAT)::FLOAT AS s5, CASE WHEN t.range < 48 THEN 0 ELSE 1 END::FLOAT AS grip, CASE WHEN t.range = 49 AND e.range % 3 <> 0 THEN 1 ELSE 0 END::FLOAT AS reward, t.range = 49 AS is_terminal FROM range(4) e, range(50) t")
register("synth_bench_hits", lambda s, d: synth.episodes(s, 500, bench=True).agg(*(F.count_if(kql.compiled(q)).alias(f"q{k}") for k, q in enumerate(synth.BENCH_QUERIES))), "SELECT 125 AS q0, 333 AS q1, 500 AS q2, 83 AS q3, 125 AS q4")
register("display_texts", lambda s, d: s.range(12).select("id", scalars.path_tail(F.concat(F.repeat(F.lit("ab/"), F.col("id").cast("int")), F.lit("file.traj"))).alias("path"), scalars.sanitized(F.concat(F.lit("cam é/"), F.col("id"))).alias("name")), "SELECT range AS id, CASE WHEN length(p) > 30 THEN '...' || right(p, 27) ELSE p END AS path, 'cam_é_' || range AS name FROM (SELECT range, repeat('ab/', range::INT) || 'file.traj' AS p FROM range(12))")
register("format_bytes", lambda s, d: s.sql("SELECT explode(array(0L, 1023L, 1536L, 1048576L, 5242880L, 3221225472L)) AS n").select("n", scalars.format_bytes(F.col("n")).alias("shown")), "SELECT n, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.2f GB', n / 1073741824.0) END AS shown FROM (SELECT unnest([0, 1023, 1536, 1048576, 5242880, 3221225472])::BIGINT AS n)")
register("format_timestamp", lambda s, d: s.sql("SELECT explode(array(0L, 1711000000L, 951782400L)) AS n").select("n", scalars.format_timestamp(F.col("n")).alias("shown")), "SELECT n, CASE WHEN n = 0 THEN 'unknown' ELSE strftime(make_timestamp(n * 1000000), '%Y-%m-%d %H:%M UTC') END AS shown FROM (SELECT unnest([0, 1711000000, 951782400])::BIGINT AS n)")
