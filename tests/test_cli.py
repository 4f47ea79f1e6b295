"""Commands end to end on files in a temporary folder, ingest by format, and streaming appends."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark import cli, schema
from trajspark.sources import compact, hdf5, ingest, synth
from trajspark.streaming import append


@pytest.fixture
def run(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)

    def go(*argv):
        code = cli.main(argv, spark)
        return code, capsys.readouterr().out

    return go


def test_commands(spark, run):
    assert run("create-test", "a.traj", "-n", "7", "--frames", "3", "--images", "--compress", "80")[0] == 0
    assert run("create-test", "b.traj", "-n", "4", "--frames", "2")[0] == 0
    code, out = run("info", "a.traj", "--episodes")
    assert code == 0 and "aloha, franka, ur5, widowx" in out and "stack the blue cube on the ..." in out
    code, out = run("query", "a.traj", "embodiment = 'franka' AND success = true", "--limit", "1")
    assert code == 0 and len(out.splitlines()) == 2 and "open the drawer" in out
    assert run("query", "a.traj", "bad query")[0] == 1 and run("info", "missing.traj")[0] == 1
    assert "wrist" in run("schema", "a.traj")[1]
    assert "PASSED" in run("validate", "a.traj", "--verbose")[1]
    code, out = run("merge", "a.traj", "b.traj", "-o", "m", "-F", "success = true")
    assert code == 0 and out.splitlines()[1].split() == ["0", "7", "4", "3", "12"]
    assert cli.opened(spark, "m").num_episodes() == 6 and "6" in run("info", "m")[1]
    code, out = run("mix", "-s", "a.traj:3", "-s", "b.traj", "--sample", "50")
    assert code == 0 and "0.8" in out and sum(int(line.split()[1]) for line in out.splitlines()[4:]) == 50
    assert run("export", "a.traj", "-o", "arrays")[0] == 0 and os.path.exists("arrays/episode_000006/front.bin")
    assert run("export", "a.traj", "-o", "all", "-F", "json")[0] == 0 and os.path.exists("all.json")
    assert run("export", "a.traj", "-F", "csv")[0] == 1
    code, out = run("bench", "-n", "12", "--frames", "2")
    assert code == 0 and "3 hits: embodiment = 'franka'" in out and "random read" in out
    assert run("ingest", "a.traj", "-F", "compact", "-o", "copy.traj")[1].strip() == "7 episodes, 21 frames"
    assert run("ingest", "a.traj", "-F", "csv")[0] == 1
    with open("broken.traj", "wb") as f:
        f.write(b"nothing of the kind, but long enough for a header of sixty-four bytes")
    assert "FATAL: BadMagic" in run("validate", "broken.traj")[1]


def lift(image=False, frames=20, n=3):
    """An opener of a file of demonstrations, made here so that workers need not import this module."""
    import numpy as np

    tree = demos(image, frames, n, np)
    return lambda path: tree


def demos(image, frames, n, np):
    out = {}
    for d in range(n):
        t = np.arange(frames, dtype=float)
        obs = {"robot0_eef_pos": np.stack([0.01 * t + 0.1 * d] * 3, 1), "robot0_gripper_qpos": np.ones((frames, 2))}
        if image:
            obs["agentview_image"] = np.add.outer(t.astype(int), np.add.outer(np.arange(8), np.add.outer(np.arange(8), np.arange(3)))).astype(np.uint8)
        last = (np.arange(frames) == frames - 1).astype(float)
        out[f"demo_{d}"] = {"actions": np.zeros((frames, 7)), "rewards": last, "dones": last, "obs": obs}
    return {"data": out}


def test_hdf5_demonstrations(spark):
    data = hdf5.read(spark, "/x/lift.hdf5", opener=lift())
    got = data.episodes.orderBy("position").collect()
    assert [tuple(r)[1:] for r in got] == [(k, k, "unknown", "lift", 20, 10.0, 7, 5, True, 1.0) for k in range(3)]
    f = data.frames.where("position = 2").orderBy("timestep").collect()
    assert f[19]["is_terminal"] and not f[18]["is_terminal"] and f[19]["reward"] == 1.0 and f[3]["state"] == pytest.approx([0.23] * 3 + [1, 1], abs=1e-6)
    pictures = hdf5.read(spark, "l.h5", opener=lift(True, 10, 2)).images.collect()
    assert len(pictures) == 20 and {(r["camera"], r["width"], r["height"], r["channels"], len(r["data"])) for r in pictures} == {("agentview_image", 8, 8, 3, 192)}
    assert hdf5.read(spark, "l.h5", max_episodes=1, task="lift it", opener=lift()).episodes.select("language_instruction").collect() == [("lift it",)]
    for kind, tree in (("MissingGroup", {}), ("NoDemonstrations", {"data": {"x": 1}})):
        with pytest.raises(compact.CompactError) as e:
            hdf5.read(spark, "x", opener=lambda p, tree=tree: tree)
        assert e.value.kind == kind
    odd = {"actions": np.zeros((3, 1)), "rewards": [0.5, -1.0], "obs": {"s": np.zeros((2, 1))}}
    with pytest.raises(compact.CompactError):
        hdf5.steps(odd)
    got = hdf5.steps({**odd, "obs": {}})
    assert got["terminal"] == [False, False, True] and got["states"].shape == (3, 0) and hdf5.outcome(got["rewards"]) == (False, -0.5) and hdf5.outcome(None) == (None, None)
    names = spark.createDataFrame([("demo_10",), ("demo_9",), ("demo_x",)], "name string")
    assert [r[0] for r in hdf5.demo_order(names, "name").collect()] == ["demo_x", "demo_9", "demo_10"]
    with pytest.raises((ImportError, OSError)):
        ingest.ingest(spark, "/no/such.hdf5", "hdf5")


def test_streamed_batches_append(spark, tmp_path):
    rows = synth.create_test(spark, 6, 2, True).nested()
    rows = rows.select(*[c.split(" ")[0] for c in ("position", "embodiment", "language_instruction", "fps", "success", "total_reward", "action_dim", "frames")])
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    kind = rows.schema
    for part, keep in enumerate(("position < 4", "position >= 4")):
        rows.where(keep).coalesce(1).write.mode("append").parquet(source)
        append.appending(spark.readStream.schema(kind).parquet(source), target, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        data = append.load(spark, target)
        assert [r["position"] for r in data.episodes.orderBy("position").collect()] == list(range((4, 6)[part]))
    assert data.frames.count() == 12 and data.images.count() == 24 and [r["embodiment"] for r in data.episodes.orderBy("position").collect()][4:] == ["widowx", "franka"]
    # a batch that runs again replaces itself
    append.append(rows.where("position >= 4"), 1, target)
    assert append.load(spark, target).episodes.count() == 6
    with pytest.raises(ValueError):
        append.append(rows.withColumn("frames", F.slice("frames", 1, 0)), 2, target)
    assert set(kind.fieldNames()) == {c.split(" ")[0] for c in schema.EPISODE_ROWS.split(", ")[:7]} | {"frames"}
