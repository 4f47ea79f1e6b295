"""Compact single-file datasets: a Python data source and sink, ``format("traj_compact")``.

A file is a header of 64 bytes, each episode's metadata, actions section and images
section, and an index of 64 bytes an episode at its end; all numbers little-endian.
Readers see three tables (option ``table``: ``episodes``, ``frames`` or ``images``). The
driver reads the header, and for frames and images passes over the index in blocks to cut
it into ranges of whole episodes, about ``SPLIT`` bytes each; tasks read their own entries and sections,
and for episodes or frames no images beyond gaps of ``GAP`` bytes. Option ``positions``
(comma-separated) reads these episodes and their entries only. Paths are local or any
that pyarrow opens.

The sink takes ``schema.EPISODE_ROWS`` (frames nested in order, images in frames). Tasks
write parts and their entries beside the target, in order of position; the commit writes
the header, appends the parts and then the entries, block by block, and moves the file
into place, so a failed job leaves no file. No step of the driver holds an index.
Positions are renumbered from 0, and ids with them.
"""

from __future__ import annotations

import os
import posixpath
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from trajspark import schema as schemas
from trajspark.functions import images as codecs

# The layout of the format.
MAGIC, VERSION = b"KINO", (0, 1)
HEADER = struct.Struct("<4sHHQQQQQ16x")
INDEX = np.dtype([("id", "<u8"), ("num_frames", "<u4"), ("action_dim", "<u2"), ("state_dim", "<u2"), *((f"{s}_{p}", "<u8") for s in ("actions", "images", "meta") for p in ("offset", "length"))])
SUCCESS = {None: 0, False: 1, True: 2}
#: Bytes of episodes that a task reads, about.
SPLIT = 32 << 20
#: Bytes of an episode's metadata, as they count for ``SPLIT``.
EPISODE = 256
#: Entries that are held at once.
BLOCK = 1 << 15
#: Sections no further apart are read together, up to so many bytes.
GAP, READ = 4 << 10, 4 << 20
#: Wanted entries no further apart in the index are read together.
ENTRY_GAP = 16


class CompactError(ValueError):
    """A file or an episode that breaks the format; ``kind`` says how."""

    def __init__(self, kind: str, detail: str = ""):
        self.kind = kind
        super().__init__(f"{kind}: {detail}" if detail else kind)


# Header, index, metadata -------------------------------------------------------------


@dataclass(frozen=True)
class Header:
    num_episodes: int
    num_frames: int
    index_offset: int
    index_length: int
    created: int = 0
    version: tuple[int, int] = VERSION

    def encode(self) -> bytes:
        return HEADER.pack(MAGIC, *self.version, self.num_episodes, self.num_frames, self.index_offset, self.index_length, self.created)

    @staticmethod
    def decode(data: bytes) -> Header:
        """Newer minor versions are read, newer major ones refused."""
        if len(data) < HEADER.size:
            raise CompactError("TooShort", f"{len(data)} of {HEADER.size} bytes")
        magic, major, minor, *rest = HEADER.unpack(data[: HEADER.size])
        if magic != MAGIC:
            raise CompactError("BadMagic", repr(magic))
        if major > VERSION[0]:
            raise CompactError("UnsupportedVersion", f"{major}.{minor}")
        return Header(*rest, version=(major, minor))

    @property
    def version_text(self) -> str:
        return ".".join(map(str, self.version))


class Index:
    """The entries of a file by position."""

    def __init__(self, entries: np.ndarray | None = None):
        self.entries = np.zeros(0, INDEX) if entries is None else entries

    @staticmethod
    def decode(data: bytes) -> Index:
        if len(data) % INDEX.itemsize:
            raise CompactError("BadAlignment", f"{len(data)} bytes")
        return Index(np.frombuffer(data, INDEX))

    def encode(self) -> bytes:
        return self.entries.tobytes()

    def __len__(self) -> int:
        return len(self.entries)

    def __iter__(self) -> Iterator[np.void]:
        return iter(self.entries)

    def get(self, position: int) -> np.void | None:
        return self.entries[position] if 0 <= position < len(self.entries) else None

    def find(self, episode_id: int) -> int | None:
        """The first position of an id."""
        at = np.flatnonzero(self.entries["id"] == episode_id)
        return int(at[0]) if len(at) else None

    def appended(self, entries: np.ndarray) -> Index:
        return Index(np.concatenate([self.entries, entries]))

    @property
    def byte_size(self) -> int:
        return self.entries.nbytes


def _text(value: str) -> bytes:
    raw = (value or "").encode()
    if len(raw) > 0xFFFF:
        raise CompactError("TextTooLong", f"{len(raw)} bytes")
    return struct.pack("<H", len(raw)) + raw


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise CompactError("UnexpectedEnd", f"{n} bytes at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, form: str) -> tuple:
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))

    def text(self) -> str:
        return self.take(self.unpack("H")[0]).decode("utf-8", "replace")


def encode_meta(embodiment: str, task: str, fps: float, success: bool | None, reward: float | None) -> bytes:
    tail = struct.pack("<B", 0) if reward is None else struct.pack("<Bf", 1, reward)
    return _text(embodiment) + _text(task) + struct.pack("<fB", fps or 0.0, SUCCESS[success]) + tail


def decode_meta(data: bytes) -> tuple[str, str, float, bool | None, float | None]:
    c = _Cursor(data)
    embodiment, task = c.text(), c.text()
    fps, success, has_reward = c.unpack("fBB")
    return embodiment, task, fps, {1: False, 2: True}.get(success), c.unpack("f")[0] if has_reward else None


# Sections ----------------------------------------------------------------------------


@lru_cache(64)
def frame_type(state_dim: int, action_dim: int) -> np.dtype:
    return np.dtype([("state", "<f4", (state_dim,)), ("action", "<f4", (action_dim,)), ("reward", "<f4"), ("terminal", "u1")])


def encode_episode(row: dict, quality: int | None = None) -> tuple[bytes, bytes, bytes, tuple[int, int, int]]:
    """(metadata, actions, images, (frames, action_dim, state_dim)) of an episode of EPISODE_ROWS."""
    frames = row["frames"] or []
    if not frames:
        raise CompactError("EmptyEpisode")
    want = row.get("action_dim")
    want = len(frames[0]["action"] or []) if want is None else want
    state_dim = len(frames[0]["state"] or [])
    if max(want, state_dim) > 0xFFFF:
        raise CompactError("TooManyDimensions", f"{want} and {state_dim}")
    out, pictures = np.zeros(len(frames), frame_type(state_dim, want)), []
    for t, f in enumerate(frames):
        for name, n in (("action", want), ("state", state_dim)):
            if len(f[name] or []) != n:
                raise CompactError("ActionDimMismatch" if name == "action" else "StateDimMismatch", f"frame {t} has {len(f[name] or [])}, not {n}")
        # a missing reward is kept as 0
        out[t] = (f["state"] or [], f["action"] or [], f["reward"] or 0.0, bool(f["is_terminal"]))
        shown = f.get("images") or []
        pictures.append(struct.pack("<H", len(shown)))
        for i in shown:
            how, data = codecs.stored(bytes(i["data"] or b""), i["width"] or 0, i["height"] or 0, i["channels"] or 0, quality)
            pictures.append(_text(i["camera"]) + struct.pack("<IIBBI", i["width"] or 0, i["height"] or 0, i["channels"] or 0, how, len(data)) + data)
    meta = encode_meta(row["embodiment"], row["language_instruction"], row["fps"], row["success"], row["total_reward"])
    return meta, out.tobytes(), b"".join(pictures), (len(frames), want, state_dim)


def encoded(batch: pa.RecordBatch, quality: int | None = None) -> Iterator[tuple]:
    """(position, *encode_episode) of each row; episodes of one shape without images are encoded together."""
    if (found := _plain(batch)) is None:
        for row in batch.to_pylist():
            yield row["position"], *encode_episode(row, quality)
        return
    sizes, raw, width, want, state_dim = found
    columns = [batch.column(c).to_pylist() for c in ("position", "embodiment", "language_instruction", "fps", "success", "total_reward")]
    at = 0
    for n, position, *about in zip(sizes, *columns):
        yield position, encode_meta(*about), raw[at : at + n * width], bytes(2 * n), (n, want, state_dim)
        at += n * width


def _plain(batch: pa.RecordBatch) -> tuple | None:
    """(frames of each row, all actions sections, bytes of a frame, action_dim, state_dim); None unless ``encode_episode`` takes each row as it is, in one shape."""
    frames = batch.column("frames")
    each = frames.flatten()
    if frames.null_count or each.null_count or not len(each) or len(each.field("images").flatten()):
        return None
    sizes = pc.list_value_length(frames).to_pylist()
    vectors = {}
    for c in ("state", "action"):
        lists = each.field(c)
        values, lengths = lists.flatten(), pc.unique(pc.list_value_length(lists))
        if lists.null_count or values.null_count or len(lengths) != 1 or lengths[0].as_py() > 0xFFFF:
            return None
        vectors[c] = values.to_numpy(zero_copy_only=False).reshape(len(each), lengths[0].as_py())
    state_dim, want = (vectors[c].shape[1] for c in ("state", "action"))
    if min(sizes) == 0 or {want, *pc.unique(batch.column("action_dim")).to_pylist()} - {want, None}:
        return None
    out = np.zeros(len(each), frame_type(state_dim, want))
    out["state"], out["action"] = vectors["state"], vectors["action"]
    # a missing reward is kept as 0
    out["reward"] = pc.fill_null(each.field("reward").cast(pa.float32()), 0.0).to_numpy(zero_copy_only=False) + np.float32(0)
    out["terminal"] = pc.fill_null(each.field("is_terminal").cast(pa.bool_()), False).to_numpy(zero_copy_only=False)
    return sizes, out.tobytes(), out.itemsize, want, state_dim


def decode_frames(data: bytes, num_frames: int, state_dim: int, action_dim: int) -> np.ndarray:
    kind = frame_type(state_dim, action_dim)
    if len(data) < num_frames * kind.itemsize:
        raise CompactError("UnexpectedEnd", f"{len(data)} bytes for {num_frames} frames")
    return np.frombuffer(data, kind, num_frames)


def decode_images(data: bytes, num_frames: int, decoded: bool = True) -> Iterator[tuple]:
    """(timestep, camera_pos, camera, width, height, channels, format, bytes); an image that can't be decoded is left out."""
    c = _Cursor(data)
    for t in range(num_frames):
        for k in range(c.unpack("H")[0]):
            camera = c.text()
            width, height, channels, how, size = c.unpack("IIBBI")
            raw = c.take(size)
            if how and decoded:
                try:
                    pixels = codecs.decode(raw)
                except codecs.ImageError:
                    continue
                height, width, channels, how, raw = *pixels.shape, 0, pixels.tobytes()
            yield t, k, camera, width, height, channels, how, raw


# Files -------------------------------------------------------------------------------


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def absolute(path: str) -> str:
    """A path that means the same to every process; those with a scheme are left."""
    return path if "://" in path or path.startswith("file:") else os.path.abspath(path)


def _header(f: pa.NativeFile) -> Header:
    header = Header.decode(f.read_at(HEADER.size, 0))
    if header.index_offset + header.index_length > f.size():
        raise CompactError("IndexBeyondEnd", f"{header.index_offset} + {header.index_length} of {f.size()}")
    if header.index_length % INDEX.itemsize:
        raise CompactError("BadAlignment", f"{header.index_length} bytes")
    return header


def header_of(path: str) -> Header:
    """The header of a file; nothing else is read."""
    files, where = _filesystem(path)
    with files.open_input_file(where) as f:
        return _header(f)


def opened(path: str) -> tuple[Header, Index]:
    """Header and whole index of a file; its data is not read."""
    files, where = _filesystem(path)
    with files.open_input_file(where) as f:
        header = _header(f)
        return header, Index.decode(f.read_at(header.index_length, header.index_offset))


def _entries(f: pa.NativeFile, index_offset: int, places: range | list[int]) -> np.ndarray:
    """The entries at ascending places; those far from each other are read by themselves."""
    def run(first: int, n: int) -> np.ndarray:
        return np.frombuffer(f.read_at(n * INDEX.itemsize, index_offset + first * INDEX.itemsize), INDEX, n)

    if isinstance(places, range):
        return run(places.start, len(places))
    wanted = np.array(places)
    runs = np.split(wanted, np.flatnonzero(np.diff(wanted) > ENTRY_GAP) + 1)
    return np.concatenate([run(int(x[0]), int(x[-1] - x[0]) + 1)[x - x[0]] for x in runs])


def from_bytes(data: bytes) -> tuple[Header, Index]:
    header = Header.decode(data)
    if header.index_offset + header.index_length > len(data):
        raise CompactError("IndexBeyondEnd", f"{header.index_offset} + {header.index_length} of {len(data)}")
    return header, Index.decode(data[header.index_offset : header.index_offset + header.index_length])


@dataclass
class _Part(InputPartition):
    path: str = ""
    index_offset: int = 0
    places: range | list = field(default_factory=list)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, table: str):
        self.paths = [p for p in options["path"].split(",") if p]
        self.table, self.decoded = table, options.get("decode", "true").lower() != "false"
        self.only = {int(p) for p in options["positions"].split(",") if p} if "positions" in options else None

    def partitions(self) -> list[_Part]:
        parts = []
        for path in self.paths:
            files, where = _filesystem(path)
            with files.open_input_file(where) as f:
                header = _header(f)
                n = header.index_length // INDEX.itemsize
                chosen = range(n) if self.only is None else sorted(p for p in self.only if 0 <= p < n)
                start, total = 0, 0
                if self.table == "episodes":
                    # of one weight each, so that the index tells nothing
                    step = max(1, SPLIT // EPISODE)
                    parts += [_Part(path, header.index_offset, chosen[k : k + step]) for k in range(0, len(chosen), step)]
                    continue
                for k in range(0, len(chosen), BLOCK):
                    ends = total + np.cumsum(self._sizes(_entries(f, header.index_offset, chosen[k : k + BLOCK])))
                    cut = 0
                    while (at := int(np.searchsorted(ends, cut + SPLIT))) < len(ends):
                        parts.append(_Part(path, header.index_offset, chosen[start : k + at + 1]))
                        start, cut = k + at + 1, int(ends[at])
                    total = int(ends[-1]) - cut
                if start < len(chosen):
                    parts.append(_Part(path, header.index_offset, chosen[start:]))
        return parts or [_Part()]

    def _sizes(self, entries: np.ndarray) -> np.ndarray:
        return (entries["actions_length"] + (entries["images_length"] if self.table == "images" else np.uint64(0))).astype(np.int64)

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if not part.places:
            return
        files, where = _filesystem(part.path)
        name = posixpath.splitext(posixpath.basename(part.path))[0]
        arrow = schemas.arrow(self.table)
        with files.open_input_file(where) as f:
            for k in range(0, len(part.places), BLOCK):
                places = part.places[k : k + BLOCK]
                yield from getattr(self, f"_{self.table}")(f, name, places, _entries(f, part.index_offset, places), arrow)

    def _episodes(self, f: pa.NativeFile, name: str, places: range | list, entries: np.ndarray, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        rows = []
        kinds = zip(*(entries[k].tolist() for k in ("id", "num_frames", "action_dim", "state_dim")))
        for position, (i, n, a, s), data in zip(places, kinds, _sections(f, entries, "meta")):
            embodiment, task, fps, success, reward = decode_meta(data)
            rows.append((name, position, i, embodiment, task, n, fps, a, s, success, reward))
            if len(rows) >= 4096:
                yield _batch(rows, arrow)
                rows = []
        if rows:
            yield _batch(rows, arrow)

    def _frames(self, f: pa.NativeFile, name: str, places: range | list, entries: np.ndarray, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        held, at, size = [], [], 0
        kinds = zip(*(entries[k].tolist() for k in ("num_frames", "state_dim", "action_dim")))
        for position, kind, data in zip(places, kinds, _sections(f, entries, "actions")):
            held.append(decode_frames(data, *kind))
            at.append(position)
            size += len(data)
            if size >= READ // 4:
                yield _frame_batch(name, at, held, arrow)
                held, at, size = [], [], 0
        if held:
            yield _frame_batch(name, at, held, arrow)

    def _images(self, f: pa.NativeFile, name: str, places: range | list, entries: np.ndarray, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        rows = []
        for position, n, data in zip(places, entries["num_frames"].tolist(), _sections(f, entries, "images")):
            rows += [(name, position, *image) for image in decode_images(data, n, self.decoded)]
            if len(rows) >= 256:
                yield _batch(rows, arrow)
                rows = []
        if rows:
            yield _batch(rows, arrow)


def _sections(f: pa.NativeFile, entries: np.ndarray, name: str) -> Iterator[bytes]:
    """The section of each entry, neighbours read together."""
    begin, length = entries[f"{name}_offset"].tolist(), entries[f"{name}_length"].tolist()
    k = 0
    while k < len(begin):
        first, end, j = begin[k], begin[k] + length[k], k + 1
        while j < len(begin) and 0 <= begin[j] - end <= GAP and begin[j] + length[j] - first <= READ:
            end, j = begin[j] + length[j], j + 1
        data = f.read_at(end - first, first)
        for i in range(k, j):
            yield data[begin[i] - first : begin[i] - first + length[i]]
        k = j


def _frame_batch(name: str, positions: list[int], held: list[np.ndarray], arrow: pa.Schema) -> pa.RecordBatch:
    """The frames of whole episodes, which may differ in their dimensions."""
    sizes = [len(x) for x in held]
    vectors = lambda c: pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(np.repeat([x[c].shape[1] for x in held], sizes))]).astype(np.int32)), pa.array(np.concatenate([x[c].ravel() for x in held]).astype(np.float32, copy=False))
    )
    every = lambda c: np.concatenate([x[c] for x in held])
    steps = np.concatenate([np.arange(n) for n in sizes])
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(steps)), pa.array(np.repeat(np.array(positions, np.int64), sizes)), pa.array(steps), vectors("state"), vectors("action"), pa.array(every("reward")), pa.array(every("terminal") != 0)],
        schema=arrow,
    )


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), kind)], schema=kind)


@dataclass
class _Done(WriterCommitMessage):
    path: str = ""
    first: int = 0
    episodes: int = 0
    frames: int = 0
    size: int = 0


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.quality = int(options["quality"]) if options.get("quality") else None
        self.created = int(options.get("created", time.time()))
        self.scratch = f"{self.path}.parts-{uuid.uuid4().hex}"
        files, where = _filesystem(self.path)
        files.create_dir(posixpath.dirname(where) or ".", recursive=True)
        if not overwrite and files.get_file_info(where).type.name != "NotFound":
            raise FileExistsError(self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Done:
        files, where = _filesystem(self.scratch)
        files.create_dir(where, recursive=True)
        target = f"{where}/{uuid.uuid4().hex}"
        entries, at, first, last, episodes, total = [], 0, None, None, 0, 0
        with files.open_output_stream(target, buffer_size=1 << 20) as out, files.open_output_stream(f"{target}.index") as index:
            for batch in batches:
                for position, meta, actions, pictures, (n, a, s) in encoded(batch, self.quality):
                    if last is not None and position <= last:
                        raise CompactError("OutOfOrder", "rows must be sorted by position; use compact.write")
                    last = position
                    first = last if first is None else first
                    begin = at, at + len(meta), at + len(meta) + len(actions)
                    entries.append((0, n, a, s, begin[1], len(actions), begin[2], len(pictures), begin[0], len(meta)))
                    at = begin[2] + len(pictures)
                    out.write(meta + actions + pictures)
                    episodes, total = episodes + 1, total + n
                    if len(entries) >= BLOCK:
                        index.write(np.array(entries, INDEX).tobytes())
                        entries = []
            index.write(np.array(entries, INDEX).tobytes())
        return _Done(target, -1 if first is None else first, episodes, total, at)

    def commit(self, messages: list) -> None:
        files, where = _filesystem(self.path)
        done = sorted((m for m in messages if m is not None and m.episodes), key=lambda m: m.first)
        target = f"{_filesystem(self.scratch)[1]}/whole"
        files.create_dir(posixpath.dirname(target), recursive=True)
        # the index's place is known before anything is written, so the header comes first and the move last
        episodes, end = sum(m.episodes for m in done), HEADER.size + sum(m.size for m in done)
        header = Header(episodes, sum(m.frames for m in done), end, episodes * INDEX.itemsize, self.created)
        with files.open_output_stream(target) as out:
            out.write(header.encode())
            for m in done:
                with files.open_input_stream(m.path) as piece:
                    while block := piece.read(8 << 20):
                        out.write(block)
            at, position = HEADER.size, 0
            for m in done:
                with files.open_input_file(f"{m.path}.index") as piece:
                    for k in range(0, m.episodes, BLOCK):
                        entries = _entries(piece, 0, range(k, min(k + BLOCK, m.episodes))).copy()
                        for section in ("actions", "images", "meta"):
                            entries[f"{section}_offset"] += np.uint64(at)
                        entries["id"] = np.arange(position, position + len(entries))
                        out.write(entries.tobytes())
                        position += len(entries)
                at += m.size
        if self.overwrite and files.get_file_info(where).type.name != "NotFound":
            files.delete_file(where)
        files.move(target, where)
        files.delete_dir(posixpath.dirname(target))

    def abort(self, messages: list) -> None:
        files, where = _filesystem(self.scratch)
        if files.get_file_info(where).type.name != "NotFound":
            files.delete_dir(where)


class CompactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "traj_compact"

    def _table(self) -> str:
        table = self.options.get("table", "episodes")
        if table not in schemas.TABLES:
            raise ValueError(f"table is one of {', '.join(schemas.TABLES)}")
        return table

    def schema(self) -> str:
        return schemas.TABLES[self._table()]

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(dict(self.options), self._table())

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def read(spark: SparkSession, *paths: str, positions: list[int] | None = None, decode: bool = True):
    """The files as one dataset; the catalog has a row for each and is made of their headers alone."""
    from trajspark.operators.dataset import OnDemand

    spark.dataSource.register(CompactSource)
    paths = tuple(map(absolute, paths))

    def table(name: str) -> DataFrame:
        r = spark.read.format("traj_compact").option("table", name).option("decode", str(decode))
        r = r if positions is None else r.option("positions", ",".join(map(str, positions)))
        return r.load(",".join(paths))

    headers = [(posixpath.splitext(posixpath.basename(p))[0], header_of(p)) for p in paths]
    catalog = spark.createDataFrame([(n, *h.version, h.num_episodes, h.num_frames, h.index_offset, h.index_length, h.created) for n, h in headers], schemas.CATALOG)
    # Spark starts Python processes on the driver for a table that is loaded
    return OnDemand(table, catalog)


def write(dataset, path: str, quality: int | None = None, overwrite: bool = True, created: int | None = None) -> None:
    """Write a dataset as one file, in order of position (and of dataset, if it has several)."""
    from trajspark.operators.ordering import with_position

    rows = dataset.nested(images=True)
    spark = rows.sparkSession
    spark.dataSource.register(CompactSource)
    names = rows.select("dataset").distinct().limit(2).count() if "dataset" in rows.columns else 1
    if names > 1:
        raise ValueError("merge datasets before writing them as one file")
    rows = rows.select(*T.StructType.fromDDL(schemas.EPISODE_ROWS).fieldNames())
    rows = with_position(rows.withColumnRenamed("position", "_key"), "_key").drop("_key").select(*T.StructType.fromDDL(schemas.EPISODE_ROWS).fieldNames())
    out = rows.repartitionByRange("position").sortWithinPartitions("position").write.format("traj_compact").mode("overwrite" if overwrite else "append")
    out = out if quality is None else out.option("quality", str(quality))
    (out if created is None else out.option("created", str(created))).save(absolute(path))
