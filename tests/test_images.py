"""Codecs: round trips, variants, damage."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.functions import images


def gradient(h, w):
    y, x = np.mgrid[:h, :w]
    return np.stack([255 * x // max(1, w - 1), 255 * y // max(1, h - 1), (x + y) % 256], 2).astype(np.uint8)


@pytest.mark.parametrize("size", [(16, 16), (1, 1), (9, 23), (64, 40)])
def test_jpeg_round_trip(size):
    solid = np.full((*size, 3), (200, 100, 50), np.uint8)
    for pixels, quality, far in ((solid, 85, 4), (gradient(*size), 95, 20), (solid, 1, 90), (solid, 1000, 3)):
        data = images.encode_jpeg(pixels, quality)
        assert data[:3] == images.JPEG
        assert np.abs(images.decode(data).astype(int) - pixels).max() <= far


def test_png_round_trip_and_filters():
    pixels = gradient(7, 5)
    assert (images.decode(images.encode_png(pixels)) == pixels).all()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + b"\0\0\0\0"

    def png(kind, lines, w, h, depth=8, extra=b""):
        return images.PNG + b"\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")

    # grey: the same line of 10, 20, 30 by each of the five filters
    lines = bytes([0, 10, 20, 30, 1, 10, 10, 10, 2, 0, 0, 0, 3, 5, 5, 5, 4, 0, 0, 0])
    assert (images.decode(png(0, lines, 3, 5)) == np.array([10, 20, 30])[None, :, None]).all()
    assert images.decode(png(6, bytes([0, 1, 2, 3, 255]), 1, 1)).tolist() == [[[1, 2, 3]]]
    assert images.decode(png(3, bytes([0, 1, 0]), 2, 1, extra=chunk(b"PLTE", bytes([9, 8, 7, 6, 5, 4])))).tolist() == [[[6, 5, 4], [9, 8, 7]]]
    assert images.decode(png(0, bytes([0, 77, 200]), 1, 1, 16)).tolist() == [[[77, 77, 77]]]


def test_damaged_images_raise():
    jpeg, png = images.encode_jpeg(gradient(16, 16), 80), images.encode_png(gradient(4, 4))
    for data in (b"", b"abc", jpeg[:3], jpeg[:60], jpeg[: len(jpeg) // 2], png[:20], png[:40], images.PNG + b"xxxxxxxxxxxx"):
        with pytest.raises(images.ImageError):
            images.decode(data)


def test_storage_policy():
    raw = gradient(8, 8).tobytes()
    jpeg = images.encode_jpeg(gradient(8, 8), 50)
    assert images.stored(jpeg, 8, 8, 3, None) == (1, jpeg)
    assert images.stored(raw, 8, 8, 3, None) == (0, raw)
    assert images.stored(raw, 8, 8, 3, 50) == (1, jpeg)
    assert images.stored(raw[:64], 8, 8, 1, 50) == (0, raw[:64])
    assert images.stored(raw[:5], 8, 8, 3, 50) == (0, raw[:5])


def test_columns(spark):
    rows = [(bytearray(images.JPEG + b"x"),), (bytearray(images.PNG),), (bytearray(b"\xff\xd8"),), (None,)]
    df = spark.createDataFrame(rows, "data binary")
    assert [r[0] for r in df.select(images.is_encoded(F.col("data"))).collect()] == [True, True, False, False]
    one = F.lit(1)
    assert [r[0] for r in df.select(images.has_size(F.col("data"), one, one, F.lit(4))).collect()] == [True, True, False, False]


def test_shapes():
    x = np.arange(2 * 4 * 6 * 3, dtype=np.uint8).reshape(2, 4, 6, 3)
    small = images.resized(x, 2, 4)
    assert (small == x[:, [0, 2]][:, :, [0, 1, 3, 4]]).all()
    assert images.normalised(x).shape == (2, 3, 4, 6) and images.normalised(x)[1, 2, 3, 5] == pytest.approx(x[1, 3, 5, 2] / 255)
