"""Image bytes: formats, PNG and baseline JPEG codecs, resize and normalisation.

The codecs are numpy, one image at a time, and run in executors' Arrow batches. PNG:
8 and 16 bits, all colour types, not interlaced. JPEG: baseline (Huffman, 8 bits, any
sampling, restarts). Anything else raises ``ImageError``, which readers turn into a
missing image.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The first bytes of the two formats.
JPEG, PNG = b"\xff\xd8\xff", b"\x89PNG"


class ImageError(ValueError):
    """Bytes that are not an image these codecs read."""


def is_encoded(data: Column) -> Column:
    """Whether image bytes are JPEG or PNG by their first bytes."""
    return F.coalesce((F.substring(data, 1, 3) == F.lit(JPEG)) | (F.substring(data, 1, 4) == F.lit(PNG)), F.lit(False))


def has_size(data: Column, width: Column, height: Column, channels: Column) -> Column:
    """Whether raw image bytes have the length that their sizes say."""
    return F.coalesce(F.octet_length(data) == width.cast("long") * height * channels, F.lit(False))


def decode(data: bytes) -> np.ndarray:
    """(height, width, 3) of a JPEG or PNG."""
    if data[:3] == JPEG:
        return decode_jpeg(data)
    if data[:4] == PNG:
        return decode_png(data)
    raise ImageError("neither JPEG nor PNG")


def stored(data: bytes, width: int, height: int, channels: int, quality: int | None) -> tuple[int, bytes]:
    """(format, bytes) as a dataset keeps them: encoded images as they are, others as JPEG if a quality is given.

    Format 0 is raw, 1 encoded. Only images of 3 channels are encoded; one whose bytes
    do not fit its sizes stays raw.
    """
    if data[:3] == JPEG or data[:4] == PNG:
        return 1, data
    if quality is None or channels != 3 or width < 1 or height < 1 or len(data) != width * height * 3:
        return 0, data
    return 1, encode_jpeg(np.frombuffer(data, np.uint8).reshape(height, width, 3), quality)


# PNG ---------------------------------------------------------------------------------


def encode_png(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], 1)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return PNG + b"\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    at, body, head, palette = 8, b"", None, None
    try:
        while at < len(data):
            size, name = struct.unpack(">I4s", data[at : at + 8])
            part = data[at + 8 : at + 8 + size]
            at += size + 12
            if name == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif name == b"PLTE":
                palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
            elif name == b"IDAT":
                body += part
        w, h, depth, kind, _, _, interlaced = head
        samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
        if interlaced or depth not in (8, 16):
            raise ImageError("PNG variant not supported")
        step, width = samples * depth // 8, w * samples * depth // 8
        lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, width + 1)
    except (struct.error, zlib.error, TypeError, KeyError) as e:
        raise ImageError(str(e)) from e
    except ValueError as e:
        raise ImageError(str(e)) from e
    out = np.zeros((h + 1, width + step), np.uint8)  # one line above and one pixel to the left are 0
    for y in range(h):
        how, line, above, here = lines[y, 0], lines[y, 1:], out[y], out[y + 1]
        if how == 0:
            here[step:] = line
        elif how == 1:
            here[step:] = np.cumsum(line.reshape(w, step), 0, dtype=np.uint8).ravel()
        elif how == 2:
            here[step:] = line + above[step:]
        elif how in (3, 4):
            a = [int(v) for v in here]
            b = [int(v) for v in above]
            for x, v in enumerate(line.tolist(), step):
                left, up = a[x - step], b[x]
                if how == 3:
                    guess = (left + up) // 2
                else:
                    corner = b[x - step]
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                a[x] = (v + guess) & 255
            here[:] = a
        else:
            raise ImageError("unknown PNG filter")
    pixels = out[1:, step:].reshape(h, w, samples, depth // 8)[..., 0]
    if kind == 3:
        if palette is None or pixels.max(initial=0) >= len(palette):
            raise ImageError("PNG palette")
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, 2) if kind in (0, 4) else np.ascontiguousarray(pixels[..., :3])


# JPEG --------------------------------------------------------------------------------

# The standard's example of a luminance quantisation table.
_QUANT = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
])
_k = np.arange(8)
_DCT = np.sqrt(np.where(_k == 0, 1 / 8, 1 / 4))[:, None] * np.cos((2 * _k + 1) * _k[:, None] * np.pi / 16)
#: Places of a block along its diagonals, turning at the edges.
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else i % 8)))
#: This encoder's codes: 4 bits for each DC size, 8 bits for each AC (run, size), in this order.
_DC_SYMBOLS = list(range(12))
_AC_SYMBOLS = [0x00, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11)]
_TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
_FROM_YCC = np.array([[1, 0, 1.402], [1, -0.344136, -0.714136], [1, 1.772, 0]])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def encode_jpeg(pixels: np.ndarray, quality: int) -> bytes:
    """Baseline JPEG without subsampling; quality is clamped to 1..100."""
    quality = min(100, max(1, quality))
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    quant = np.clip((_QUANT * scale + 50) // 100, 1, 255)
    h, w, _ = pixels.shape
    grown = np.pad(pixels.astype(float), ((0, -h % 8), (0, -w % 8), (0, 0)), "edge")
    planes = np.moveaxis(grown @ _TO_YCC.T, 2, 0)
    planes[0] -= 128
    blocks = planes.reshape(3, grown.shape[0] // 8, 8, grown.shape[1] // 8, 8).transpose(1, 3, 0, 2, 4)
    coefficients = np.rint((_DCT @ blocks @ _DCT.T).reshape(-1, 3, 64) / quant).astype(int)[..., _ZIGZAG]
    dc, ac = ({s: format(k, f"0{n}b") for k, s in enumerate(symbols)} for symbols, n in ((_DC_SYMBOLS, 4), (_AC_SYMBOLS, 8)))
    value = lambda v, n: format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""
    bits, before = [], [0, 0, 0]
    for group in coefficients.tolist():
        for c, block in enumerate(group):
            change, before[c] = block[0] - before[c], block[0]
            n = abs(change).bit_length()
            bits += [dc[n], value(change, n)]
            run = 0
            last = max((k for k in range(1, 64) if block[k]), default=0)
            for v in block[1 : last + 1]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits.append(ac[0xF0])
                    run -= 16
                n = abs(v).bit_length()
                bits += [ac[run << 4 | n], value(v, n)]
                run = 0
            if last < 63:
                bits.append(ac[0x00])
    stream = "".join(bits)
    stream += "1" * (-len(stream) % 8)
    coded = int("1" + stream, 2).to_bytes(len(stream) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\x00")
    table = lambda kind, n, symbols: bytes([kind << 4]) + bytes(len(symbols) if k == n else 0 for k in range(1, 17)) + bytes(symbols)
    frame = struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))
    return (
        b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, b"\0" + bytes(quant[_ZIGZAG].tolist())) + _segment(0xC0, frame)
        + _segment(0xC4, table(0, 4, _DC_SYMBOLS) + table(1, 8, _AC_SYMBOLS)) + _segment(0xDA, b"\3" + b"".join(bytes([c, 0]) for c in (1, 2, 3)) + b"\0\x3f\0") + coded + b"\xff\xd9"
    )


class _Bits:
    """Reads an entropy-coded segment without its stuffing bytes."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data.replace(b"\xff\x00", b"\xff") + b"\0\0\0\0", 0, 8 * len(data) + 32

    def peek(self) -> int:
        i, shift = self.at >> 3, self.at & 7
        return int.from_bytes(self.data[i : i + 3].ljust(3, b"\0"), "big") >> (8 - shift) & 0xFFFF

    def code(self, table: tuple[list, list]) -> int:
        k = self.peek()
        n = table[0][k]
        if not n or self.at > self.size:
            raise ImageError("JPEG data end early")
        self.at += n
        return table[1][k]

    def value(self, n: int) -> int:
        if not n:
            return 0
        v = self.peek() >> (16 - n)
        self.at += n
        return v if v >> (n - 1) else v - (1 << n) + 1


def _huffman(counts: bytes, symbols: bytes) -> tuple[list, list]:
    """Length and symbol of the code that begins each 16-bit number."""
    size, what, code, k = np.zeros(1 << 16, int), np.zeros(1 << 16, int), 0, 0
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            low = code << (16 - n)
            size[low : low + (1 << 16 - n)], what[low : low + (1 << 16 - n)] = n, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return size.tolist(), what.tolist()


def decode_jpeg(data: bytes) -> np.ndarray:
    try:
        return _decoded(data)
    except (struct.error, IndexError, KeyError, ValueError, TypeError) as e:
        raise ImageError(str(e)) from e


def _decoded(data: bytes) -> np.ndarray:
    at, quants, codes, parts, restart = 2, {}, {}, [], 0
    while True:
        if data[at] != 255:
            raise ImageError("JPEG marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quants[name] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(int)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                n = sum(counts)
                codes[body[0] >> 4, body[0] & 15] = _huffman(counts, body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            depth, h, w, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or n not in (1, 3) or not h or not w:
                raise ImageError("JPEG variant not supported")
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
        elif 0xC2 <= marker <= 0xCF:
            raise ImageError("JPEG variant not supported")
    tables = {body[1 + 2 * k]: (codes[0, body[2 + 2 * k] >> 4], codes[1, body[2 + 2 * k] & 15]) for k in range(body[0])}
    if len(tables) != len(parts):
        raise ImageError("JPEG of several scans")
    # the scan's data, cut at its restart markers
    pieces, start, k = [], at, at
    while (k := data.find(b"\xff", k)) >= 0 and k + 1 < len(data):
        if data[k + 1] == 0:
            k += 2
        elif 0xD0 <= data[k + 1] <= 0xD7:
            pieces.append(data[start:k])
            start = k = k + 2
        else:
            break
    pieces.append(data[start : k if k >= 0 else len(data)])
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
        across = down = 1
    wide, high = -(-w // (8 * across)), -(-h // (8 * down))
    planes = [np.zeros((high * v, wide * u, 64)) for _, u, v, _ in parts]
    unit = 0
    for piece in pieces:
        bits, before = _Bits(piece), [0] * len(parts)
        for _ in range(min(restart or wide * high, wide * high - unit)):
            my, mx = divmod(unit, wide)
            for c, (name, u, v, _) in enumerate(parts):
                dc, ac = tables[name]
                for j in range(u * v):
                    block = planes[c][my * v + j // u, mx * u + j % u]
                    before[c] += bits.value(bits.code(dc))
                    block[0], k = before[c], 1
                    while k < 64:
                        s = bits.code(ac)
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            block[k] = bits.value(s & 15)
                        k += 1
            unit += 1
    if unit < wide * high:
        raise ImageError("JPEG data end early")
    full = []
    for plane, (_, u, v, q) in zip(planes, parts):
        flat = np.zeros_like(plane)
        flat[..., _ZIGZAG] = plane * quants[q]
        pixels = _DCT.T @ flat.reshape(*plane.shape[:2], 8, 8) @ _DCT
        pixels = pixels.transpose(0, 2, 1, 3).reshape(plane.shape[0] * 8, plane.shape[1] * 8)
        full.append(np.repeat(np.repeat(pixels, down // v, 0), across // u, 1)[:h, :w])
    if len(full) == 1:
        out = np.repeat(full[0][..., None] + 128, 3, 2)
    else:
        out = (np.stack(full, 2) @ _FROM_YCC.T) + 128
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


# Shapes ------------------------------------------------------------------------------


def resized(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest neighbours of (n, h, w, c): target i takes source i * old // new."""
    rows, columns = (np.arange(new) * old // new for new, old in ((height, images.shape[1]), (width, images.shape[2])))
    return images[:, rows[:, None], columns[None, :]]


def normalised(images: np.ndarray) -> np.ndarray:
    """(n, h, w, c) of bytes as (n, c, h, w) of floats in 0..1."""
    return np.ascontiguousarray(np.moveaxis(images.astype(np.float32) / np.float32(255), 3, 1))
