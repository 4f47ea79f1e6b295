"""Canonical schemas of datasets, and constructors that check them."""

from __future__ import annotations

import pyarrow as pa

EPISODES = "dataset string, position bigint, episode_id bigint, embodiment string, language_instruction string, num_frames bigint, fps float, action_dim int, state_dim int, success boolean, total_reward float"
FRAMES = "dataset string, position bigint, timestep bigint, state array<float>, action array<float>, reward float, is_terminal boolean"
IMAGES = "dataset string, position bigint, timestep bigint, camera_pos int, camera string, width int, height int, channels int, format int, data binary"
CATALOG = "dataset string, version_major int, version_minor int, num_episodes bigint, num_frames bigint, index_offset bigint, index_length bigint, created_timestamp bigint"
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<float>": pa.list_(pa.float32())}


def arrow(table: str) -> pa.Schema:
    """The Arrow schema of a table, without a session."""
    return pa.schema([(c.split(" ")[0], _ARROW[c.split(" ")[1]]) for c in TABLES[table].split(", ")])


TABLES = {"episodes": EPISODES, "frames": FRAMES, "images": IMAGES}
IMAGE = "struct<camera: string, width: int, height: int, channels: int, format: int, data: binary>"
#: One row an episode: frames in order, each with its images.
EPISODE_ROWS = (
    "position bigint, embodiment string, language_instruction string, fps float, success boolean, total_reward float, action_dim int, "
    f"frames array<struct<timestep: bigint, state: array<float>, action: array<float>, reward: float, is_terminal: boolean, images: array<{IMAGE}>>>"
)


def episode(episode_id: int, embodiment: str, task: str, num_frames: int, fps: float, action_dim: int) -> dict:
    """The metadata of a new episode; success and reward are not known yet."""
    return {"episode_id": episode_id, "embodiment": embodiment, "language_instruction": task, "num_frames": num_frames, "fps": fps, "action_dim": action_dim, "success": None, "total_reward": None}


def image(camera: str, width: int, height: int, channels: int, data: bytes) -> dict:
    """A raw image; its bytes must fit its sizes."""
    if len(data) != width * height * channels:
        raise ValueError(f"{camera}: {len(data)} bytes, not {width} x {height} x {channels} = {width * height * channels}")
    return {"camera": camera, "width": width, "height": height, "channels": channels, "format": 0, "data": data}
