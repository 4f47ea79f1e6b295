"""HDF5 files of demonstrations (``data/demo_N`` groups), each demonstration an episode.

The driver lists the groups; tasks read one demonstration after the other, and of it
only what a table needs. Files are opened by ``opener``, by default h5py's, which is
optional; anything that gives nested mappings of arrays will do.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark import schema as schemas
from trajspark.operators.dataset import Dataset
from trajspark.sources.compact import CompactError

FPS = 10.0
Opener = Callable[[str], Mapping]


def h5py_file(path: str) -> Mapping:
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs h5py, or another opener") from e
    return h5py.File(path, "r")


def demos(root: Mapping) -> list[str]:
    """The names of the demonstrations by their number; names without one come first."""
    if "data" not in root:
        raise CompactError("MissingGroup", "data")
    names = [n for n in root["data"] if n.startswith("demo_")]
    if not names:
        raise CompactError("NoDemonstrations")

    def number(name: str) -> tuple:
        tail = name[len("demo_") :]
        return (1, int(tail), name) if tail.isascii() and tail.isdigit() else (0, 0, name)

    return sorted(names, key=number)


def _optional(demo: Mapping, name: str) -> np.ndarray | None:
    try:
        return np.asarray(demo[name][()] if hasattr(demo[name], "shape") else demo[name], np.float32).ravel()
    except (KeyError, ValueError, TypeError, OSError):
        return None


def _array(values, kind=None) -> np.ndarray:
    return np.asarray(values[()] if hasattr(values, "shape") else values, kind)


def observations(demo: Mapping) -> tuple[list[str], list[str]]:
    """Names of the states (2 dimensions) and of the cameras (4 dimensions), sorted."""
    obs = demo["obs"] if "obs" in demo else {}
    dims = {k: getattr(obs[k], "ndim", None) if hasattr(obs[k], "ndim") else np.ndim(obs[k]) for k in obs}
    return sorted(k for k, n in dims.items() if n == 2), sorted(k for k, n in dims.items() if n == 4)


def steps(demo: Mapping) -> dict:
    """actions, states, rewards and terminal flags of a demonstration, by frame.

    States are joined in order of their names. A frame beyond the rewards has none; beyond
    the flags, the last frame is terminal.
    """
    actions = _array(demo["actions"], np.float32)
    if actions.ndim != 2:
        raise CompactError("BadActions", f"{actions.ndim} dimensions")
    n = len(actions)
    names, _ = observations(demo)
    parts = [_array(demo["obs"][k], np.float32) for k in names]
    if any(len(p) < n for p in parts):
        raise CompactError("StateTooShort", f"{min(map(len, parts))} of {n} frames")
    states = np.concatenate([np.zeros((n, 0), np.float32), *(p[:n] for p in parts)], 1)
    rewards, dones = _optional(demo, "rewards"), _optional(demo, "dones")
    terminal = [bool(dones[t] > 0.5) if dones is not None and t < len(dones) else t == n - 1 for t in range(n)]
    return {"actions": actions, "states": states, "rewards": rewards, "terminal": terminal}


def outcome(rewards: np.ndarray | None) -> tuple[bool | None, float | None]:
    """Success (the last reward is positive) and the float sum of the rewards in order; unknown without rewards."""
    if rewards is None:
        return None, None
    total = np.float32(0)
    for r in rewards:
        total = np.float32(total + r)
    return (bool(rewards[-1] > 0) if len(rewards) else None), float(total)


def read(spark: SparkSession, path: str, dataset: str | None = None, embodiment: str = "unknown", task: str | None = None, fps: float = FPS, max_episodes: int | None = None, opener: Opener = h5py_file) -> Dataset:
    """The demonstrations of a file, in order of their number, as a dataset; the task is the file's name unless given."""
    stem = posixpath.splitext(posixpath.basename(path))[0]
    name, instruction = dataset or stem, task if task is not None else stem
    root = opener(path)
    chosen = demos(root)[: max_episodes if max_episodes is not None else None]
    close(root)
    listed = spark.createDataFrame(list(enumerate(chosen)), "position long, demo string").repartition(max(1, min(len(chosen), 4 * spark.sparkContext.defaultParallelism)), "position")

    def table(kind: str, rows_of: Callable[[int, Mapping], Iterator[tuple]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrow, root = schemas.arrow(kind), opener(path)
            try:
                for batch in batches:
                    for r in batch.to_pylist():
                        rows = list(rows_of(r["position"], root["data"][r["demo"]]))
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
            finally:
                close(root)

        return listed.mapInArrow(run, schemas.TABLES[kind])

    def episode(position: int, demo: Mapping) -> Iterator[tuple]:
        got = steps(demo)
        success, total = outcome(got["rewards"])
        yield name, position, position, embodiment, instruction, len(got["actions"]), fps, got["actions"].shape[1], got["states"].shape[1], success, total

    def frames(position: int, demo: Mapping) -> Iterator[tuple]:
        got = steps(demo)
        for t in range(len(got["actions"])):
            reward = got["rewards"]
            yield name, position, t, got["states"][t], got["actions"][t], float(reward[t]) if reward is not None and t < len(reward) else None, got["terminal"][t]

    def images(position: int, demo: Mapping) -> Iterator[tuple]:
        n, cameras = len(demo["actions"]), observations(demo)[1]
        for t in range(n):
            k = 0
            for camera in cameras:
                if t < len(demo["obs"][camera]):
                    pixels = np.ascontiguousarray(np.asarray(demo["obs"][camera][t], np.uint8))
                    yield name, position, t, k, camera, pixels.shape[1], pixels.shape[0], pixels.shape[2], 0, pixels.tobytes()
                    k += 1

    return Dataset(table("episodes", episode), table("frames", frames), table("images", images))


def close(root: Mapping) -> None:
    if hasattr(root, "close"):
        root.close()


def demo_order(names: DataFrame, column: str) -> DataFrame:
    """Rows sorted by the number after ``demo_``, those without one first."""
    number = F.expr(f"try_cast(regexp_extract(`{column}`, '^demo_([0-9]+)$', 1) AS BIGINT)")
    return names.orderBy(number.asc_nulls_first(), column)
