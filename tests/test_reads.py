"""Reads, pushdown, samples, iterators, the service and its server."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark import server, service
from trajspark.functions import images as codecs
from trajspark.operators import mixture, reports, training, validation
from trajspark.operators.dataset import Dataset, merge_counts, merge_datasets
from trajspark.operators.ordering import with_position
from trajspark.plans import kql
from trajspark.service import InvalidArgument, NotFound
from trajspark.sinks import export
from trajspark.sources import synth


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    return synth.create_test(spark, 12, 4, True).save(str(tmp_path_factory.mktemp("d")))


def test_filters_reach_the_scan(spark, data):
    def pushed(rows):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        return plan[plan.index("PushedFilters") :].split("\n")[0]

    assert "GreaterThan(num_frames,3)" in pushed(data.query("num_frames > 3.5"))
    assert "EqualTo(num_frames,4)" in pushed(data.query("num_frames = 4.0000001"))
    got = pushed(data.query("embodiment = 'franka' AND success = true AND task CONTAINS 'pick'"))
    assert "EqualTo(embodiment,franka)" in got and "EqualTo(success,true)" in got
    plan = data.query("fps > 5").select("position")._jdf.queryExecution().executedPlan().toString()
    assert "language_instruction" not in plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "EqualTo(position,3)" in pushed(data.read_frames(3))


def test_whole_number_predicates_equal_the_plain_ones(spark):
    rows = spark.createDataFrame([(n,) for n in (None, -1, 0, 1, 2, 3, 4, 5, 2**40)], "num_frames long")
    for v in ("3", "-1", "0", "2.5", "2.9999999", "3.0000001", "3.000002", "1000000000000000000", "-0.0"):
        for op in ("=", "!=", ">", "<", ">=", "<=", "CONTAINS"):
            (c,) = kql.parse(f"num_frames {op} {v}")
            both = rows.select(kql.predicate(c), kql._number(F.col("num_frames"), op, c.value)).collect()
            assert all(r[0] is not None and r[0] == r[1] for r in both), (op, v)


def test_positions_are_stable_and_names_may_clash(spark):
    df = spark.createDataFrame([(k % 3 if k % 7 else None, k, "x") for k in range(100)], "key long, n long, _range string")
    for _ in range(2):
        got = with_position(df, "key", "at", 5).orderBy("at").collect()
        assert [r["at"] for r in got] == list(range(100)) and {r["_range"] for r in got} == {"x"}
        assert [r["key"] for r in got] == sorted((r["key"] for r in got), key=lambda v: (v is not None, v or 0))


def test_whole_episodes(spark, data):
    one = data.read_episode(5).head()
    assert len(one["frames"]) == 4 and [f["timestep"] for f in one["frames"]] == [0, 1, 2, 3]
    assert [i["camera"] for i in one["frames"][2]["images"]] == ["front", "wrist"]
    assert data.read_actions(5).head()["frames"][0]["images"] == []
    assert data.read_episode_by_id(7, False).head()["position"] == 7 and data.read_episode(99).head() is None
    wanted = spark.createDataFrame([(0, 3), (1, 0), (2, 3), (3, 77), (4, 11)], "place long, position long")
    assert [(r["place"], r["position"], len(r["frames"])) for r in data.fetch_positions(wanted).collect()] == [(0, 3, 4), (1, 0, 4), (2, 3, 4), (4, 11, 4)]
    assert data.fetch(data.query("embodiment = 'ur5'")).count() == 12 and data.first_camera("wrist").count() == 48


def test_samples(data):
    row = data.read_episode(4).head()
    got = training.arrays(row)
    assert got["actions"].shape == (4, 7) and got["states"].shape == (4, 6) and got["rewards"].tolist() == [0, 0, 0, 1] and got["is_terminal"] == [False, False, False, True]
    assert got["images"]["wrist"].shape == (4, 64, 64, 3) and list(got["images"]) == ["front", "wrist"]
    assert "images" not in training.arrays(row, images=False)
    s = training.sample(got, "wrist", (8, 4), to_tensor=True)
    assert s["image"].shape == (4, 3, 8, 4) and s["camera"] == "wrist" and 0 <= s["image"].min() and s["image"].max() <= 1
    assert "image" not in training.sample(got, "none") and training.sample(got)["camera"] == "front"
    frames = [f.asDict(True) for f in row["frames"]]
    frames[1]["images"][0]["data"] = codecs.JPEG + b"broken"
    frames[2]["images"][1]["data"] = bytearray(codecs.encode_png(np.zeros((64, 64, 3), np.uint8)))
    assert list(training.arrays({**row.asDict(), "frames": frames})["images"]) == ["wrist"]
    maps = training.MapSamples(data, "embodiment = 'aloha'")
    assert len(maps) == 3 and maps[1]["embodiment"] == "aloha" and maps[1]["episode_id"] == 6


def test_prefetch_orders_and_early_end(data):
    order = [9, 0, 5, 3, 7, 9]
    assert [r["position"] for r in training.prefetched(data, order)] == order
    assert [r["position"] for r in training.prefetched(data, images=False)] == list(range(12))
    rows = training.prefetched(data)
    assert next(rows)["position"] == 0
    rows.close()
    assert list(rows) == []


def test_epochs(spark, data):
    one = training.IterSamples(spark, data, kql_filter="num_frames > 3", seed=7)
    first, second = ([s["episode_id"] for s in one] for _ in range(2))
    assert sorted(first) == sorted(second) == list(range(12)) and first != second
    assert [s["episode_id"] for s in training.IterSamples(spark, data, seed=7)] == first
    assert [s["episode_id"] for s in training.IterSamples(spark, data, shuffle=False)] == list(range(12))
    small = synth.create_bench(spark, 3, 2)
    mixed = training.from_mixture(spark, {"a": (small, 0.8), "b": (data, 0.2)}, seed=1)
    got = [s["embodiment"] for s in mixed]
    # 15 episodes: 12 picks of the small source, 3 of the other
    assert len(got) == len(mixed) == 15
    weights = spark.createDataFrame([(0, 4.0), (1, 1.0), (2, 0.0001)], "source_idx int, weight double")
    positions = spark.createDataFrame([(0, k) for k in range(3)] + [(1, k) for k in range(12)] + [(2, 5)], "source_idx int, position long")
    plain = [(r["source_idx"], r["position"]) for r in training.schedule(weights, positions, shuffle=False).orderBy("place").collect()]
    assert plain == [(0, k % 3) for k in range(13)] + [(1, k) for k in range(3)] + [(2, 5)]
    with pytest.raises(ValueError):
        training.IterSamples(spark, "path")


def test_lanes_step_like_the_loop():
    for seed, first, n in ((42, 0, 1), (42, 0, 5000), (99, 777, 2049), (0, 3, 10), (2**64 - 1, 5, 1500)):
        x, want = mixture.jump(seed, first), []
        for _ in range(n):
            x = mixture.xorshift(x)
            want.append(x)
        assert mixture.states(seed, first, n).tolist() == want


def test_mixtures_of_datasets(spark, data):
    other = synth.create_bench(spark, 5, 2)
    mix = mixture.Mixture.of({"a": (data, 3.0), "b": (other, 1.0)})
    assert mix.totals() == (17, 58) and [tuple(r) for r in mix.report(spark).collect()] == [(0, "a", 12, 0.75, 0), (1, "b", 5, 0.25, 12)]
    drawn = [tuple(r) for r in mix.draws(spark, 40).select("draw_no", "global_idx").collect()]
    got = mix.sample(spark, 25, images=False).collect() + mix.sample(spark, 15, images=False).collect()
    assert [r["position"] for r in got] == [g for _, g in sorted(drawn)]
    assert all(len(r["frames"]) == (4 if r["position"] < 12 else 2) for r in got)
    assert mix.sample_meta(spark, 3).count() == 3 and mix.read_episode(spark, 12).head()["num_frames"] == 2
    assert sum(r["count"] for r in mix.distribution(spark, 100).collect()) == 100
    with pytest.raises(IndexError):
        mix.read_episode(spark, 17)
    assert [mixture.parse_source(t) for t in ("a.traj:0.4", "s3://b/c", "d", "x:y")] == [("a.traj", 0.4), ("s3://b/c", 1.0), ("d", 1.0), ("x:y", 1.0)]


def test_merged_datasets(spark, data):
    both = merge_datasets([data, synth.create_bench(spark, 6, 2)], "embodiment = 'franka'")
    assert [r["position"] for r in both.episodes.orderBy("position").collect()] == [0, 1, 2, 3, 4]
    assert both.frames.groupBy("position").count().orderBy("position").collect() == [(0, 4), (1, 4), (2, 4), (3, 2), (4, 2)] and both.images is None
    counts = merge_counts([data.episodes, data.episodes.limit(0)], "embodiment = 'franka'").collect()
    assert [tuple(r) for r in counts] == [(0, 12, 3, 9, 12)]


def test_reports(spark, data):
    assert reports.summary(data) == "12 episodes, 48 frames"
    assert [tuple(r) for r in reports.cameras(data).orderBy("camera").collect()] == [("front", 64, 64, 3), ("wrist", 64, 64, 3)]
    many = Dataset(data.episodes.withColumn("language_instruction", F.concat(F.lit("t"), F.lpad(F.col("position").cast("string"), 2, "0"))))
    assert [(r["value"], r["more"]) for r in reports.listed(many, "language_instruction").collect()] == [(f"t{k:02}", 2) for k in range(10)]
    sets = reports.sets(data).head()
    assert sets["embodiments"] == "aloha, franka, ur5, widowx" and sets["fps"] == "10.0" and sets["state_dims"] == "6"
    b = reports.byte_budget(data).where("position = 0").head()
    assert b["image_bytes"] == 4 * 2 + 8 * (16 + 5 + 12288) and b["total_bytes"] == b["meta_bytes"] + b["action_bytes"] + b["image_bytes"]
    none = Dataset(data.episodes.limit(0))
    assert reports.info(none).head()["num_episodes"] == 0 and reports.schema(none).head()["avg_reward"] is None and reports.listed(none, "embodiment").count() == 0
    found = validation.findings(data.episodes, data.frames, data.images, None, 12, 48)
    assert validation.report(found, data.episodes, data.frames, data.images).head()["verdict"] == "PASSED"
    bad = validation.findings(data.episodes, data.frames.where("timestep < 3"), data.images)
    assert validation.report(bad, data.episodes, data.frames).head()["verdict"] == "FAILED" and validation.first(bad, 3).count() == 6
    warned = validation.findings(data.episodes.withColumn("embodiment", F.lit("")), data.frames)
    assert validation.report(warned, data.episodes, data.frames).head()["verdict"] == "PASSED with 12 warnings"


def test_exports(spark, data, tmp_path):
    export.export(data, f"{tmp_path}/all.json", "json")
    with open(f"{tmp_path}/all.json", encoding="utf-8") as f:
        got = json.load(f)
    assert got["num_episodes"] == 12 and got["episodes"][3] == {"id": 3, "embodiment": "ur5", "task": "push the green button", "num_frames": 4, "action_dim": 7, "fps": 10.0, "success": False}
    renamed = Dataset(data.episodes, data.frames, data.images.withColumn("camera", F.concat(F.col("camera"), F.lit("/ü 1"))))
    export.export(renamed, f"{tmp_path}/arrays")
    space = {}
    exec(open(f"{tmp_path}/arrays/load_dataset.py", encoding="utf-8").read(), space)
    loaded = space["load_dataset"](f"{tmp_path}/arrays")
    assert len(loaded) == 12 and loaded[4]["actions"].shape == (4, 7) and loaded[4]["image_front/ü 1"].shape == (4, 64, 64, 3)
    want = training.arrays(data.read_episode(4).head())
    assert (loaded[4]["states"] == want["states"]).all() and (loaded[4]["image_wrist/ü 1"] == want["images"]["wrist"]).all()
    assert export.sanitized("a b/ü-_1") == "a_b_ü-_1"
    with pytest.raises(ValueError):
        export.export(data, "x", "csv")


def test_service_and_server(spark, data):
    s = service.Service(spark, data)
    assert s.server_info().head().asDict() == {"num_episodes": 12, "num_frames": 48, "is_mixture": False, "num_sources": 1}
    assert [(r["place"], r["position"]) for r in s.get_batch(4, "sequential", 10).collect()] == [(0, 10), (1, 11), (2, 0), (3, 1)]
    want = [r["local_idx"] for r in mixture.Mixture([("d", 12, 1.0)]).draws(spark, 6).orderBy("draw_no").collect()]
    assert [r["position"] for k in (2, 4) for r in s.get_batch(k, include_images=False).collect()] == want
    assert s.query("success = true").count() == 8 and s.query("success = true", 3).count() == 3 and s.total_matches("success = true", 3).head()[0] == 3
    for kind, call in ((InvalidArgument, lambda: s.get_batch(0)), (InvalidArgument, lambda: s.get_batch(1, "sorted")), (InvalidArgument, lambda: s.query("nope = 1")), (NotFound, lambda: s.get_meta(12)), (NotFound, lambda: s.get_episode(-1))):
        with pytest.raises(kind):
            call()
    running = server.serve(service.Service(spark, data), 0)
    try:
        address = f"127.0.0.1:{running.server_address[1]}"
        remote, local = server.RemoteClient(address), service.Client(service.Service(spark, data))
        assert remote.server_info() == local.server_info() and remote.get_meta(3) == local.get_meta(3)
        a, b = remote.get_episode(2), local.get_episode(2)
        assert a["meta"] == b["meta"] and (a["actions"] == b["actions"]).all() and (a["images"]["front"] == b["images"]["front"]).all()
        assert remote.query("embodiment = 'ur5'", 2) == [3, 7] and [e["meta"]["episode_id"] for e in remote.get_batch(2, mode="sequential", offset=11)] == [11, 0]
        for kind, call in ((NotFound, lambda: remote.get_meta(99)), (InvalidArgument, lambda: remote.get_batch(0)), (InvalidArgument, lambda: remote.query("fps")), (NotFound, lambda: remote._call("drop"))):
            with pytest.raises(kind):
                call()
        samples = server.RemoteSamples(address, 5, image_size=(4, 4))
        got = list(samples)
        assert len(samples) == 12 and len(got) == 15 and got[0]["image"].shape == (4, 3, 4, 4)
    finally:
        running.shutdown()
