"""Pictures as pixels, with the standard library: PNG of 8 bits a channel."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from plumbline.sources.registry import Dataset, NotThisFormat, Options, reader

MOST_SIDE, MOST_PIXELS = 4096, 40_000_000
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def degrees(parts: tuple[float, float, float], reference: str) -> float:
    """Degrees from degrees, minutes and seconds and the letter of a hemisphere."""
    size = sum(p / 60**i for i, p in enumerate(parts))
    return -size if reference.upper() in ("S", "W") else size


def png_pixels(raw: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """(rows, columns, 3) bytes and the text chunks of a PNG."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise NotThisFormat("not a PNG")
    at, body, texts, palette, head = 8, [], {}, None, None
    while at < len(raw):
        (n,) = struct.unpack(">I", raw[at : at + 4])
        kind, data = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"tEXt":
            key, _, text = data.partition(b"\0")
            texts[key.decode("latin-1")] = text.decode("latin-1")
    width, height, bits, colour, _, _, interlaced = head
    if bits != 8 or interlaced:
        raise NotThisFormat("only 8 bits a channel without interlacing are read")
    size = CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width * size + 1)
    out = np.zeros((height, width * size), np.uint8)
    above = np.zeros(width * size, np.uint8)
    for y in range(height):
        how, line = lines[y, 0], lines[y, 1:].astype(np.int32)
        if how == 0:
            now = line
        elif how == 2:
            now = line + above
        elif how == 1:
            now = np.cumsum(line.reshape(width, size), 0).ravel()
        else:
            now = np.zeros(width * size, np.int32)
            up = above.astype(np.int32)
            for x in range(width * size):
                a, b, c = (int(now[x - size]), int(up[x]), int(up[x - size])) if x >= size else (0, int(up[x]), 0)
                guess = (a + b) // 2 if how == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                now[x] = (int(line[x]) + guess) & 255
        above = out[y] = (now & 255).astype(np.uint8)
    pixels = out.reshape(height, width, size)
    if colour == 3:
        return palette[pixels[:, :, 0]], texts
    return (np.repeat(pixels[:, :, :1], 3, 2) if size <= 2 else pixels[:, :, :3]), texts


@reader("png", "Image", extensions=(".png",), magic=(b"\x89PNG",), priority=5)
def read_png(spark: SparkSession, path: Path, options: Options) -> Dataset:
    """Pixels (iy, ix, r, g, b) with channels in 0 to 1, thinned evenly beyond ``MOST_PIXELS``."""
    name = str(path)
    head = struct.unpack(">II", Path(name).read_bytes()[16:24])
    step = max(1, -(-max(head) // MOST_SIDE)) if head[0] * head[1] > MOST_PIXELS else 1

    def run(parts):
        for _ in parts:
            p, _ = png_pixels(Path(name).read_bytes())
            p = p[::step, ::step] / 255.0
            for top in range(0, len(p), 256):
                band = p[top : top + 256]
                iy, ix = np.divmod(np.arange(band.shape[0] * band.shape[1]), band.shape[1])
                flat = band.reshape(-1, 3)
                yield pd.DataFrame({"iy": (iy + top).astype(np.int32), "ix": ix.astype(np.int32), "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]})

    df = spark.range(0, 1, 1, 1).mapInPandas(run, "iy int, ix int, r double, g double, b double")
    return Dataset("image", df, {"width": head[0], "height": head[1], "step": step})
