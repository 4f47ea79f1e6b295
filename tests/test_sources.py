"""File sources on small folders written here."""

import json
import struct

import pytest

from trajspark.sources import lerobot, rlds


def _lerobot(spark, base):
    (base / "meta").mkdir(parents=True)
    (base / "meta" / "info.json").write_text(json.dumps({"fps": 20, "robot_type": "aloha"}))
    (base / "meta" / "tasks.jsonl").write_text('{"task_index": 0, "task": "old"}\n\nbroken\n{"task_index": 0, "task": "pick"}\n{"task_index": -1, "task": "no"}\n')
    kind = "episode_index long, task_index long, action array<float>, `observation.state.b` double, `observation.state.a` float, `observation.images.top` struct<bytes: binary, path: string>"
    for name, rows in {
        "a": [(7, 0, [1.0, None], 2.0, 1.0, (b"x", None)), (7, 0, [3.0], 4.0, 3.0, None)],
        "b": [(3, 5, [5.0], None, 6.0, (None, "p")), (7, 0, [9.0], 8.0, 7.0, (b"z", None))],
    }.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(base / "data" / name))
    return str(base)


def test_lerobot(spark, tmp_path):
    d = _lerobot(spark, tmp_path / "set")
    source = lerobot.LeRobot(spark, d)
    ep = [tuple(r) for r in source.episodes().orderBy("position").select("position", "embodiment", "language_instruction", "num_frames", "fps", "action_dim", "state_dim", "success").collect()]
    assert ep == [(0, "aloha", "episode_3", 1, 20.0, 1, 1, None), (1, "aloha", "pick", 3, 20.0, 1, 2, None)]
    fr = [tuple(r) for r in source.frames().orderBy("position", "timestep").select("position", "timestep", "state", "action", "is_terminal").collect()]
    assert fr == [(0, 0, [6.0], [5.0], True), (1, 0, [1.0, 2.0], [1.0], False), (1, 1, [3.0, 4.0], [3.0], False), (1, 2, [7.0, 8.0], [9.0], True)]
    im = [(r["position"], r["timestep"], r["camera"], bytes(r["data"])) for r in source.images().orderBy("position", "timestep").collect()]
    assert im == [(1, 0, "top", b"x"), (1, 2, "top", b"z")]
    assert lerobot.LeRobot(spark, d, task="t", max_episodes=1).episodes().select("language_instruction", "position").collect() == [("t", 0)]


def test_lerobot_needs_info(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    with pytest.raises(FileNotFoundError):
        lerobot.LeRobot(spark, str(tmp_path))


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(n, body):
    return _varint(n << 3 | 2) + _varint(len(body)) + body


def _example(packed=True, **features):
    out = b""
    for key, v in features.items():
        if isinstance(v, bytes):
            f = _field(1, _field(1, v))
        elif isinstance(v, int):
            f = _field(3, _field(1, _varint(v)) if packed else b"\x08" + _varint(v))
        else:
            floats = [struct.pack("<f", x) for x in v]
            f = _field(2, _field(1, b"".join(floats)) if packed else b"".join(b"\x0d" + x for x in floats))
        out += _field(1, _field(1, key.replace("__", "/").encode()) + _field(2, f))
    return _field(1, out)


def _record(payload):
    return struct.pack("<QI", len(payload), 0) + payload + b"\0\0\0\0"


def test_rlds(spark, tmp_path):
    one = [_example(is_first=1, action=[1, 2], reward=[0.5], observation__s=[3], observation__image=b"x", language_instruction=b"go"), b"\xff", _example(False, is_last=0, action=[4, 5], observation__s=[6])]
    two = [_example(is_terminal=1, is_last=1, reward=[1], action=[7, 8]), _example(action=[9])]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.tfrecord-00000").write_bytes(b"".join(map(_record, one)))
    (tmp_path / "sub" / "x.tfrecord-00001").write_bytes(b"".join(map(_record, two)) + b"\x09cut")
    (tmp_path / "dataset_info.json").write_text('{"description": "all"}')
    episodes, rows = rlds.read(spark, str(tmp_path))
    fr = [tuple(r) for r in rows.orderBy("position", "timestep").select("position", "timestep", "action", "state", "reward", "is_terminal").collect()]
    assert fr == [(0, 0, [1, 2], [3], 0.5, False), (0, 1, [4, 5], [6], 0.0, False), (0, 2, [7, 8], [], 1.0, True), (1, 0, [9], [], 0.0, True)]
    ep = [tuple(r) for r in episodes.orderBy("position").select("language_instruction", "num_frames", "action_dim", "state_dim", "success", "total_reward").collect()]
    assert ep == [("go", 3, 2, 1, True, 1.5), ("all", 1, 1, 0, False, 0.0)]


def test_rlds_empty(spark, tmp_path):
    (tmp_path / "e.tfrecord").write_bytes(b"")
    episodes, rows = rlds.read(spark, str(tmp_path))
    assert rows.count() == 0 and episodes.count() == 0
