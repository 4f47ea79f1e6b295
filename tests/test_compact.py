"""The compact format: header, index, sections, round trips, refusals."""

import os
import pickle
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from trajspark import schema
from trajspark.functions import images as codecs
from trajspark.operators.dataset import Dataset
from trajspark.sources import compact, synth
from trajspark.sources.compact import CompactError, Header, Index


def refused(kind, run, *args):
    with pytest.raises(CompactError) as e:
        run(*args)
    assert e.value.kind == kind


def test_header():
    h = Header(500, 25_000, 64, 4096, 1_711_000_000)
    data = h.encode()
    assert len(data) == 64 and data[:8] == b"KINO\0\0\1\0" and data[48:] == bytes(16)
    assert Header.decode(data) == h and h.version_text == "0.1"
    refused("TooShort", Header.decode, data[:63])
    refused("BadMagic", Header.decode, b"X" + data[1:])
    refused("UnsupportedVersion", Header.decode, data[:4] + struct.pack("<HH", 1, 0) + data[8:])
    assert Header.decode(data[:4] + struct.pack("<HH", 0, 9) + data[8:]).version == (0, 9)


def test_index():
    entries = np.zeros(3, compact.INDEX)
    entries["id"], entries["num_frames"], entries["meta_offset"] = [7, 9, 7], [1, 2, 3], [64, 100, 2**40]
    index = Index(entries)
    assert len(index) == 3 and index.byte_size == 192 and len(Index()) == 0
    again = Index.decode(index.encode())
    assert (again.entries == entries).all() and [int(e["num_frames"]) for e in again] == [1, 2, 3]
    assert again.find(7) == 0 and again.find(9) == 1 and again.find(8) is None
    assert again.get(2)["meta_offset"] == 2**40 and again.get(3) is None and again.get(-1) is None
    assert len(index.appended(entries)) == 6
    refused("BadAlignment", Index.decode, index.encode()[:-1])


def test_metadata_blob():
    for row in (("widowx", "pick ü", 10.0, True, 1.5), ("", "", 0.5, False, None), ("a", "b", 1.0, None, 0.0)):
        data = compact.encode_meta(*row)
        assert compact.decode_meta(data) == row and len(data) == 10 + len(row[0].encode()) + len(row[1].encode()) + (4 if row[4] is not None else 0)
    refused("TextTooLong", compact.encode_meta, "x" * 65536, "", 1.0, None, None)
    refused("UnexpectedEnd", compact.decode_meta, compact.encode_meta("abc", "def", 1.0, None, None)[:-1])


def test_refused_episodes():
    frame = {"state": [0.0], "action": [0.0, 1.0], "reward": None, "is_terminal": True, "images": []}
    row = {"embodiment": "", "language_instruction": "", "fps": 1.0, "success": None, "total_reward": None, "action_dim": None}
    refused("EmptyEpisode", compact.encode_episode, {**row, "frames": []})
    refused("ActionDimMismatch", compact.encode_episode, {**row, "frames": [frame, {**frame, "action": [1.0]}]})
    refused("ActionDimMismatch", compact.encode_episode, {**row, "action_dim": 3, "frames": [frame]})
    refused("StateDimMismatch", compact.encode_episode, {**row, "frames": [frame, {**frame, "state": []}]})


def test_file_sizes_and_round_trip(spark, tmp_path):
    for n, size in ((20, 61_183), (10, 30_620)):
        path = str(tmp_path / f"t{n}.traj")
        data = synth.create_test(spark, n, 50)
        compact.write(data, path, created=5)
        assert os.path.getsize(path) == size and os.listdir(tmp_path) == [f"t{n}.traj"]
        header, index = compact.opened(path)
        assert (header.num_episodes, header.num_frames, header.created) == (n, n * 50, 5) and index.entries["id"].tolist() == list(range(n))
        back = compact.read(spark, path)
        same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
        assert same(data.episodes.drop("dataset"), back.episodes) and same(data.frames.drop("dataset"), back.frames)
        assert back.images.count() == 0 and back.num_frames() == n * 50 and back.version().first()["version"] == "0.1"
        with open(path, "rb") as f:
            whole = f.read()
        assert compact.from_bytes(whole)[0] == header
        refused("IndexBeyondEnd", compact.from_bytes, whole[:-1])
        os.remove(path)


def test_images_raw_encoded_and_damaged(spark, tmp_path):
    data = synth.create_test(spark, 2, 3, True)
    for quality, form, far in ((None, 0, 0), (90, 1, 24)):
        path = str(tmp_path / f"i{form}.traj")
        compact.write(data, path, quality)
        stored = compact.read(spark, path, decode=False).images
        assert {r["format"] for r in stored.collect()} == {form}
        want = {(r["position"], r["timestep"], r["camera_pos"], r["camera"]): np.frombuffer(r["data"], np.uint8).astype(int) for r in data.images.collect()}
        got = {(r["position"], r["timestep"], r["camera_pos"], r["camera"]): r for r in compact.read(spark, path).images.collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert (r["width"], r["height"], r["channels"], r["format"]) == (64, 64, 3, 0)
            assert np.abs(np.frombuffer(r["data"], np.uint8) - want[k]).max() <= far
    broken = data.images.withColumn("data", F.when(F.col("camera") == "wrist", F.lit(codecs.JPEG + b"no")).otherwise(F.lit(codecs.encode_png(np.zeros((2, 2, 3), np.uint8)))))
    compact.write(Dataset(data.episodes, data.frames, broken), path := str(tmp_path / "b.traj"))
    kept = compact.read(spark, path).images.collect()
    # undecodable images are left out, the others keep their places
    assert {(r["camera"], r["camera_pos"], r["width"]) for r in kept} == {("front", 0, 2)} and len(kept) == 6


def test_order_gaps_and_overwriting(spark, tmp_path):
    path = str(tmp_path / "o.traj")
    data = synth.create_test(spark, 9, 2)
    compact.write(data.only(data.episodes.where("position % 2 = 0")), path)
    assert [r["embodiment"] for r in compact.read(spark, path).episodes.orderBy("position").collect()] == ["widowx", "aloha", "widowx", "aloha", "widowx"]
    with pytest.raises(Exception, match="FileExists"):
        compact.write(data, path, overwrite=False)
    with pytest.raises(Exception, match="EmptyEpisode"):
        compact.write(Dataset(data.episodes, data.frames.where("position > 0")), path)
    assert os.listdir(tmp_path) == ["o.traj"] and compact.opened(path)[0].num_episodes == 5
    one = compact.read(spark, path, positions=[1, 4])
    assert sorted(r["position"] for r in one.frames.collect()) == [1, 1, 4, 4]
    compact.write(data.only(data.episodes.where("false")), path)
    assert compact.read(spark, path).episodes.count() == 0


def test_constructors():
    assert schema.episode(3, "a", "b", 5, 10.0, 7)["success"] is None
    assert schema.image("front", 2, 1, 3, b"123456")["format"] == 0
    with pytest.raises(ValueError):
        schema.image("front", 2, 1, 3, b"12345")


def written(path, sizes, tasks=2):
    """A file of episodes with so many frames, written by the sink's tasks without Spark; their messages."""
    frame = lambda p, t: {"timestep": t, "state": [p, t], "action": [t] * (1 + p % 2), "reward": None, "is_terminal": False, "images": []}
    rows = [{"position": p, "embodiment": f"e{p}", "language_instruction": "t", "fps": 1.0, "success": True, "total_reward": None, "action_dim": None, "frames": [frame(p, t) for t in range(n)]} for p, n in enumerate(sizes)]
    writer = compact._Writer({"path": path, "created": "5"}, True)
    done = [writer.write(iter([pa.RecordBatch.from_pylist(list(part))])) for part in np.array_split(np.array(rows, object), tasks)]
    writer.commit(done[::-1])
    return done


def test_driver_holds_no_index(tmp_path, monkeypatch):
    sizes = [1 + p % 3 for p in range(500)]
    path = str(tmp_path / "d.traj")
    monkeypatch.setattr(compact, "BLOCK", 7, raising=False)
    # a task's message and the plan do not grow with its episodes (64 bytes of index for each before)
    assert all(len(pickle.dumps(m)) < 600 for m in written(path, sizes))
    header, index = compact.opened(path)
    e = index.entries
    assert os.listdir(tmp_path) == ["d.traj"] and header.num_episodes == 500 and header.num_frames == sum(sizes)
    assert e["id"].tolist() == list(range(500)) and e["num_frames"].tolist() == sizes
    assert (e["meta_offset"][1:] == (e["images_offset"] + e["images_length"])[:-1]).all() and e["meta_offset"][0] == 64
    monkeypatch.setattr(Index, "decode", None)
    reader = compact._Reader({"path": path, "positions": "499,3,17,500,-1"}, "frames")
    parts = reader.partitions()
    assert [list(p.places) for p in parts] == [[3, 17, 499]]
    rows = [r for b in reader.read(parts[0]) for r in b.to_pylist()]
    assert [(r["position"], r["timestep"], r["state"], r["action"]) for r in rows] == [(p, t, [p, t], [t] * (1 + p % 2)) for p in (3, 17, 499) for t in range(sizes[p])]


def test_frames_are_read_and_encoded_in_batches(tmp_path, monkeypatch):
    sizes = [1 + p % 3 for p in range(500)]
    path = str(tmp_path / "f.traj")
    written(path, sizes)
    monkeypatch.setattr(compact, "BLOCK", 90, raising=False)
    reader = compact._Reader({"path": path}, "frames")
    monkeypatch.setattr(compact, "SPLIT", 5000)
    parts = reader.partitions()
    # every episode in one part, none beyond the bytes of a split and an episode; the plan does not grow with them
    assert [p for x in parts for p in x.places] == list(range(500)) and len(parts) > 2 and all(len(pickle.dumps(x)) < 600 for x in parts)
    size = compact.opened(path)[1].entries["actions_length"]
    assert all(size[list(x.places)][:-1].sum() < 5000 for x in parts) and all(size[list(x.places)].sum() >= 5000 for x in parts[:-1])
    batches = [b for x in parts for b in reader.read(x)]
    # one for each episode before
    assert len(batches) < 30
    rows = [r for b in batches for r in b.to_pylist()]
    assert [(r["position"], r["timestep"], r["state"], r["action"]) for r in rows] == [(p, t, [p, t], [t] * (1 + p % 2)) for p, n in enumerate(sizes) for t in range(n)]


def test_batches_are_encoded_as_single_episodes_are():
    frame = lambda **more: {"timestep": 0, "state": [1.0, 2.0], "action": [3.0], "reward": None, "is_terminal": None, "images": []} | more
    row = lambda p, frames, dim=1: {"position": p, "embodiment": "ü", "language_instruction": None, "fps": None, "success": None, "total_reward": 1.5, "action_dim": dim, "frames": frames}
    kind = pa.RecordBatch.from_pylist([row(0, [frame(reward=1.0, is_terminal=True, images=[schema.image("c", 1, 1, 1, b"1")])])]).schema
    of = lambda *rows: pa.RecordBatch.from_pylist(list(rows), kind)
    same = of(row(0, [frame(reward=-0.0, is_terminal=True), frame(reward=float("nan"), images=None)]), row(4, [frame(reward=2.0)], None), row(5, [frame()] * 3))
    shown = of(row(0, [frame(images=[schema.image("c", 1, 1, 1, b"1")])]), row(1, [frame()]))
    mixed = of(row(0, [frame(state=[])]), row(1, [frame(action=[1.0, 2.0])], 2))
    for batch, together in ((same, True), (same.slice(1), True), (same.slice(1, 1), True), (shown, False), (mixed, False)):
        assert (compact._plain(batch) is not None) == together
        assert list(compact.encoded(batch)) == [(r["position"], *compact.encode_episode(r)) for r in batch.to_pylist()]
    for bad, why in (([], "EmptyEpisode"), (None, "EmptyEpisode"), ([frame(action=[])], "ActionDimMismatch"), ([frame(), frame(state=[])], "StateDimMismatch")):
        refused(why, lambda b: list(compact.encoded(b)), of(row(0, [frame()]), row(1, bad)))


def test_episodes_are_planned_without_the_index(tmp_path, monkeypatch):
    sizes = [1 + p % 3 for p in range(500)]
    path = str(tmp_path / "e.traj")
    written(path, sizes)
    monkeypatch.setattr(compact, "SPLIT", 256 * 150)
    for name in ("BLOCK", "READ"):
        monkeypatch.setattr(compact, name, 70, raising=False)
    reader = compact._Reader({"path": path}, "episodes")
    with monkeypatch.context() as m:
        m.setattr(Index, "decode", None)
        m.setattr(compact, "_entries", None, raising=False)
        parts = reader.partitions()
    assert [len(p.places) for p in parts] == [150, 150, 150, 50] and all(len(pickle.dumps(p)) < 600 for p in parts)
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["position"], r["episode_id"], r["embodiment"], r["num_frames"], r["action_dim"], r["state_dim"]) for r in rows] == [(p, p, f"e{p}", n, 1 + p % 2, 2) for p, n in enumerate(sizes)]
    assert [list(p.places) for p in compact._Reader({"path": path, "positions": "7,2,600"}, "episodes").partitions()] == [[2, 7]]


def test_header_alone_makes_the_catalog(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h.traj")
    written(path, [2, 3])
    monkeypatch.setattr(Index, "decode", None)
    row = compact.read(spark, path).catalog.first()
    assert (row["num_episodes"], row["num_frames"], row["index_length"], row["created_timestamp"]) == (2, 5, 128, 5)
    with open(path, "r+b") as f:
        f.write(Header(2, 5, row["index_offset"], 127, 5).encode())
    refused("BadAlignment", compact.read, spark, path)


def test_catalog_loads_no_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c.traj")
    written(path, [2, 3])
    with monkeypatch.context() as m:
        m.setattr(DataFrameReader, "load", None)
        data = compact.read(spark, path)
        assert data.catalog.first()["num_episodes"] == 2 and data.num_frames() == 5
    assert data.episodes is data.episodes
    assert (data.episodes.count(), data.frames.count(), data.images.count()) == (2, 5, 0)
