"""Exports: metadata as JSON, episodes as folders of raw arrays.

Both are DataFrames of files first (``path``, ``content``), made in parallel, and written
by the tasks that hold them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from trajspark.functions import scalars
from trajspark.operators import training
from trajspark.operators.dataset import Dataset

FILES = "path string, content binary"
LOADER = '''"""Loads the episodes beside this file."""
import json
from pathlib import Path

import numpy as np


def load_episode(folder):
    folder = Path(folder)
    meta = json.loads((folder / "meta.json").read_text())
    shaped = lambda name, kind, *shape: np.fromfile(folder / name, kind).reshape(meta["num_frames"], *shape)
    out = {"meta": meta, "actions": shaped("actions.bin", "<f4", meta["action_dim"]), "rewards": shaped("rewards.bin", "<f4")}
    if meta["state_dim"]:
        out["states"] = shaped("states.bin", "<f4", meta["state_dim"])
    for c in meta["cameras"]:
        out["image_" + c["name"]] = shaped(c["file"], "u1", c["height"], c["width"], c["channels"])
    return out


def load_dataset(folder="."):
    return [load_episode(p) for p in sorted(Path(folder).glob("episode_*"))]
'''


def metadata(data: Dataset) -> DataFrame:
    """The fields of an episode that the JSON export holds."""
    return data.episodes.select(F.col("episode_id").alias("id"), "embodiment", F.col("language_instruction").alias("task"), "num_frames", "action_dim", "fps", "success", "position")


def json_lines(data: Dataset) -> DataFrame:
    """(position, value): one JSON object an episode; absent values are null."""
    rows = metadata(data)
    fields = F.struct(*(c for c in rows.columns if c != "position"))
    return rows.select("position", F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))


def export_json(data: Dataset, path: str) -> None:
    """One object with the number of episodes and the list of them, in order, written from an iterator."""
    lines = json_lines(data).orderBy("position")
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'{{"num_episodes": {data.num_episodes()}, "episodes": [')
        for k, r in enumerate(lines.toLocalIterator()):
            out.write((", " if k else "") + r["value"])
        out.write("]}\n")


def sanitized(name: str) -> str:
    """A camera's file name: all but letters, digits, _ and - become _."""
    return "".join(c if c.isalnum() or c in "_-" else "_" for c in name)


def episode_files(row: Row) -> list[tuple[str, bytes]]:
    """The files of one episode: meta.json, actions, states, rewards, and each camera that all frames have in one size."""
    got = training.arrays(row)
    folder, frames = f"episode_{row['position']:06d}", row["frames"]
    cameras, files, taken = [], [], {"actions", "states", "rewards", "meta"}
    for camera, pixels in got["images"].items():
        name = sanitized(camera)
        while name in taken:
            name += "_"
        taken.add(name)
        cameras.append({"name": camera, "file": f"{name}.bin", "width": pixels.shape[2], "height": pixels.shape[1], "channels": pixels.shape[3]})
        files.append((f"{folder}/{name}.bin", pixels.tobytes()))
    plain = lambda name, values: files.append((f"{folder}/{name}.bin", np.ascontiguousarray(values, "<f4").tobytes()))
    plain("actions", got["actions"])
    if got["states"].size:
        plain("states", got["states"])
    plain("rewards", got["rewards"])
    meta = {**got["meta"], "action_dim": got["actions"].shape[1], "state_dim": got["states"].shape[1] if frames else 0, "cameras": cameras}
    files.append((f"{folder}/meta.json", (json.dumps(meta, ensure_ascii=False, indent=2) + "\n").encode()))
    return files


def array_files(data: Dataset, images: bool = True) -> DataFrame:
    """(path, content) of all files of all episodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                paths, contents = zip(*episode_files(row))
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], names=["path", "content"])

    rows = data.nested(images)
    return rows.select(*(c for c in rows.columns if c in ("position", "episode_id", "embodiment", "language_instruction", "fps", "action_dim", "success", "total_reward", "frames"))).mapInArrow(run, FILES)


def export_numpy(data: Dataset, folder: str) -> None:
    """Write ``array_files``, a meta.json of the dataset and a loader under ``folder``, which all tasks must share."""
    import os

    def write(rows: Iterator[Row]) -> None:
        for r in rows:
            target = f"{folder}/{r['path']}"
            os.makedirs(os.path.dirname(target), exist_ok=True)
            # a task that runs again, or twice, replaces whole files
            with open(f"{target}.{os.getpid()}", "wb") as out:
                out.write(r["content"])
            os.replace(f"{target}.{os.getpid()}", target)

    array_files(data).foreachPartition(write)
    os.makedirs(folder, exist_ok=True)
    totals = {"num_episodes": data.num_episodes(), "num_frames": data.num_frames()}
    for name, text in (("meta.json", json.dumps(totals, indent=2) + "\n"), ("load_dataset.py", LOADER)):
        with open(f"{folder}/{name}", "w", encoding="utf-8") as out:
            out.write(text)


def export(data: Dataset, target: str, form: str = "numpy") -> None:
    """Export as ``numpy`` or ``json``."""
    if form not in ("numpy", "json"):
        raise ValueError(f"unknown format {form!r}: numpy or json")
    (export_numpy if form == "numpy" else export_json)(data, target)


def file_sizes(data: Dataset) -> DataFrame:
    """(path, bytes) of the exported files."""
    return array_files(data).select("path", F.octet_length("content").cast("long").alias("bytes"))


camera_file = scalars.sanitized
