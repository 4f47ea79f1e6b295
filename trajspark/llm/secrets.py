"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions near hits, checksums.

One automaton finds all keywords of a text in a single pass; each expression is then
tried at the keyword's place only. Hexadecimal runs have no keyword: every run of 32
covers two of the bytes sampled each 16, so the expression is tried around such pairs
alone. Beside the three base kinds the method finds ``github`` and ``npm`` tokens
whose embedded CRC-32 is right, ``jwt`` whose header is base64url JSON, and ``pem``
private-key headers. Base spans are the leftmost non-overlapping matches of each
kind; a match that fails its length test is dropped without another try.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Texts are
read whole. Rows are independent, so repeated rows and other columns don't matter.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.llm import frames

# The expressions of the base kinds and the public token formats.
BASE = {
    "assign": rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": rb"AKIA[A-Z0-9]+",
    "hex": rb"[0-9a-f]+",
}
MORE = {
    "github": rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "npm": rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "jwt": rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "pem": rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
}
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt", "-----begin": "pem",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SHORTEST = {"assign": 8, "access": 16, "hex": 32}
KINDS = [*BASE, *MORE]
#: Text that stands for a secret in cleaned documents.
MASK = "[SECRET]"

_exact = {k: re.compile(v) for k, v in (BASE | MORE).items()}
_run = re.compile(rb"[A-Za-z0-9_-]+")
_hex = np.zeros(256, bool)
_hex[[*range(48, 58), *range(97, 103)]] = True
_automaton = None


def checksum_ok(token: bytes) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of those after the prefix."""
    body, tail = token[4:-6], token[-6:].decode()
    n = 0
    for c in tail:
        n = n * 62 + BASE62.index(c)
    return n == zlib.crc32(body)


def _jwt_ok(token: bytes) -> bool:
    head = token.split(b".")[0]
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4))), dict)
    except (ValueError, UnicodeDecodeError):
        return False


def _accepted(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= SHORTEST[kind]
    if kind in SHORTEST:
        return len(m[0]) >= SHORTEST[kind]
    if kind in ("github", "npm"):
        return checksum_ok(m[0])
    return kind != "jwt" or _jwt_ok(m[0])


def _keywords():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            _automaton.add_word(word, (kind, len(word)))
        _automaton.make_automaton()
    return _automaton


def byte_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by start and then kind."""
    # Latin-1 keeps one character a byte; only ASCII letters are folded
    hits = sorted((end - size + 1, kind) for end, (kind, size) in _keywords().iter(raw.lower().decode("latin-1")))
    found, last = [], dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < last[kind]:
            continue
        if m := _exact[kind].match(raw, start):
            last[kind] = m.end()
            if _accepted(kind, m):
                found.append((kind, start, m.end()))
        elif kind == "jwt" and (m := _run.match(raw, start)):
            # a later start in the same run would fail at the same place
            last[kind] = m.end()
    sampled = _hex[np.frombuffer(raw, np.uint8)[15::16]]
    for k in np.flatnonzero(sampled[:-1] & sampled[1:]):
        at = 16 * int(k) + 15
        if at < last["hex"]:
            continue
        start = at
        while start > last["hex"] and _hex[raw[start - 1]]:
            start -= 1
        m = _exact["hex"].match(raw, start)
        last["hex"] = m.end()
        if _accepted("hex", m):
            found.append(("hex", start, m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def spans(value: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points."""
    raw = (value or "").encode("utf-8", "surrogatepass")
    found = byte_spans(raw)
    if not found or len(raw) == len(value):
        return found
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(k, int(before[a]), int(before[b])) for k, a, b in found]


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, name: str = "secrets", column: str = "text") -> DataFrame:
    """``docs`` with all spans of each text."""
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in batch.column(column).to_pylist()], arrow)]

    return frames.appended(docs, [T.StructField(frames.fresh(docs, name), _SPAN)], run, column)


def masked(value: str | None, mask: str = MASK) -> str | None:
    """The text with every secret, overlapping ones as one, replaced."""
    found = spans(value)
    if not found:
        return value
    out, at = [], 0
    for _, a, b in found:
        if a >= at:
            out += [value[at:a], mask]
        at = max(at, b)
    return "".join([*out, value[at:]])


def mask(docs: DataFrame, column: str = "text", by: str = MASK) -> DataFrame:
    """``docs``, all columns, with the secrets of ``column`` replaced by a mask."""

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index(column)
            new = pa.array([masked(t, by) for t in batch.column(k).to_pylist()], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays([new if j == k else c for j, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(number(k) for k in BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
