"""Vectorised text primitives shared by the Arrow-batched operators.

A batch of texts is one flat byte array with offsets; words and code points are
found and hashed by array arithmetic over the whole batch, so cost follows the
bytes and no Python object is made per word. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex as re

U = np.uint64
#: Odd, hence invertible modulo 2**64: the base of the prefix hash.
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
#: Bytes handled at once; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_WORD = np.zeros(256, np.uint8)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
#: Scripts that are written without spaces: each of their characters is a word.
_UNSPACED = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_kinds = None
_pow = np.ones(1, U), np.ones(1, U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (two xor-shift-multiply steps)."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow
    if len(_pow[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        grow = lambda base: np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, base, U)]))
        _pow = grow(_BASE), grow(_INV)
    return _pow[0][:n], _pow[1][:n]


def _word_kinds() -> np.ndarray:
    """Per code point: 0 outside words, 1 a letter or digit, 2 a word by itself."""
    global _kinds
    if _kinds is None:
        kinds = np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), np.uint8, 0x110000)
        whole = "".join(chr(c) for c in np.flatnonzero(kinds))
        kinds[[ord(c) for c in _UNSPACED.findall(whole)]] = 2
        _kinds = kinds
    return _kinds


def _byte_kinds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The word kind of the character that each byte belongs to, and which bytes begin one (None: all)."""
    if not len(raw) or raw.max() < 128:
        return _WORD[raw], None
    begins = (raw & 0xC0) != 0x80
    try:
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:  # not UTF-8: bytes beyond ASCII count as letters
        return np.where(raw < 128, _WORD[raw], 1).astype(np.uint8), None
    return np.repeat(_word_kinds()[points], np.diff(np.append(np.flatnonzero(begins), len(raw)))), begins


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets (one more than there are texts)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of texts, each of about ``size`` bytes."""
    _, at = flat(texts)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, "right")) - 1)
        yield a, b
        a = b


class Words:
    """The words of a range of texts: runs of letters and digits, and each character of an unspaced script.

    hash: 64 bits per word; at: first word of each text, and the end; doc: text of
    each word; start, end: byte range of each word in ``raw``.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        n = len(raw)
        kind, begins = _byte_kinds(raw)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = kind > 0
        first = np.zeros(n + 1, bool)
        first[at] = True
        if begins is not None:  # an unspaced character begins a word, and so does what follows it
            alone = begins & (kind == 2)
            first[:-1] |= alone
            first[1:-1] |= begins[1:] & (kind[:-1] == 2)
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
        power, back = _powers(n + 1)
        sums = np.zeros(n + 1, U)
        np.cumsum((raw.astype(U) + U(1)) * power[:n], out=sums[1:])
        self.hash = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U))
        self.at = np.searchsorted(starts, at)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.at))
        self.start, self.end, self.raw = starts, ends, raw

    def grams(self, *steps: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of each tuple of the words at i, i+steps[0], ... within one text."""
        reach = steps[-1] if steps else 0
        n = max(0, len(self.hash) - reach)
        keep = self.doc[:n] == self.doc[reach : reach + n]
        h = self.hash[:n].copy()
        for k, s in enumerate(steps, 1):
            h = mix(h * U(0xC2B2AE3D27D4EB4F + 2 * s) + self.hash[s : s + n] + U(k))
        return self.doc[:n][keep], h[keep]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of each k-word shingle; a shorter text that has words makes one shingle of them all."""
        doc, h = self.grams(*range(1, k))
        few = np.diff(self.at)
        short = np.flatnonzero((few > 0) & (few < k))
        if len(short):
            own = np.zeros(len(short), U)
            for j in range(k - 1):
                has = few[short] > j
                own[has] = mix(own[has] * U(0xC2B2AE3D27D4EB4F) + self.hash[self.at[short[has]] + j] + U(j + 77))
            doc, h = np.concatenate([doc, short]), np.concatenate([h, own])
            order = np.argsort(doc, kind="stable")
            doc, h = doc[order], h[order]
        return doc, h


def words(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    """For each chunk its range of texts and their words."""
    for a, b in chunks(texts):
        part = texts.slice(a, b - a)
        yield a, b, Words(*flat(pc.utf8_lower(part) if lower else part))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
