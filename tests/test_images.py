from __future__ import annotations

import struct
import zlib

from pyspark.sql import functions as F

from stayline.sources.images import brightness_score, read_images

COLOUR_TYPES = {1: 0, 3: 2, 4: 6}


def png(pixels: list[tuple[int, ...]], width: int) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = [pixels[i:i + width] for i in range(0, len(pixels), width)]
    data = b"".join(b"\0" + b"".join(bytes(p) for p in row) for row in rows)
    header = struct.pack(">IIBBBBB", width, len(rows), 8, COLOUR_TYPES[len(pixels[0])], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def test_brightness(spark, tmp_path):
    files = {
        "bright.png": png([(250, 120, 10), (200, 120, 60)], 2),       # mean 126.7
        "dark.png": png([(10, 120, 10), (20, 120, 60)], 1),
        "grey.png": png([(121,), (121,)], 2),
        "at_the_limit.png": png([(120,), (120,)], 2),
        "alpha.png": png([(100, 100, 100, 255), (100, 100, 100, 255)], 2),  # alpha must not count
        "corrupt.png": b"no image",
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    scored = read_images(spark, str(tmp_path)).select(
        F.substring_index("path", "/", -1).alias("name"), brightness_score(F.col("image")).alias("score")
    )
    assert {r["name"]: r["score"] for r in scored.collect()} == {
        "bright.png": 0.1, "dark.png": 0.9, "grey.png": 0.1, "at_the_limit.png": 0.9, "alpha.png": 0.9, "corrupt.png": None,
    }
