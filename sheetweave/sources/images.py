"""Page rasters: files to pages, canvases and tiles. Pixels go through numpy in Arrow batches; the rest is relational."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.functions.text import SUPPORTED, extension
from sheetweave.operators.tiling import tile_starts
from sheetweave.settings import Settings

PAGE = "path string, page int, height int, width int, bgr binary"


#: Endings that Spark's own image source decodes (fixed values); others of SUPPORTED need a decoder.
DECODED = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff")


def _glob(endings) -> str:
    """A pattern for file names with one of the endings in any case."""
    any_case = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e)
    return "*{" + ",".join(map(any_case, endings)) + "}"


def read_pages(spark: SparkSession, path: str, decoders: dict[str, Callable] | None = None, s: Settings | None = None) -> DataFrame:
    """Files below path as pages (path, page, height, width, bgr): grey is spread to three channels, alpha is dropped.

    decoders: for an ending that Spark does not decode, (bytes, dpi, most pages) -> images; a file without pages fails.
    A file with another ending, or one that does not decode, fails the job."""
    s, decoders = s or Settings(), decoders or {}
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    known = [*DECODED, *decoders]
    bad = names.where(~extension(F.col("path")).isin(*known)).limit(1).collect()
    if bad:
        raise ValueError(f"cannot read {bad[0].path}: " + ("no decoder given" if bad[0].path.lower().endswith(SUPPORTED) else "unsupported ending"))
    raw = spark.read.format("image").option("pathGlobFilter", _glob(DECODED)).option("recursiveFileLookup", "true").load(path).select("image.*")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                if r.height <= 0 or r.width <= 0:
                    raise ValueError(f"does not decode: {r.origin}")
                px = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                px = np.repeat(px, 3, axis=2) if r.nChannels == 1 else px[:, :, :3]
                rows.append((r.origin, 0, r.height, r.width, px.tobytes()))
            yield pd.DataFrame(rows, columns=["path", "page", "height", "width", "bgr"])

    out = raw.mapInPandas(spread, PAGE)
    for ending, decode in decoders.items():
        files = spark.read.format("binaryFile").option("pathGlobFilter", _glob((ending,))).option("recursiveFileLookup", "true").load(path)
        out = out.unionByName(render(files, decode, s.pdf_dpi, s.max_pages))
    return out


def render(files: DataFrame, decode: Callable[[bytes, int, int], list[np.ndarray]], dpi: int = 300, max_pages: int = 10) -> DataFrame:
    """binaryFile rows as pages through a decoder (bytes, dpi, max_pages) -> images; a document without pages fails."""
    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                images = decode(content, dpi, max_pages)[:max_pages]
                if not images:
                    raise ValueError(f"no pages: {path}")
                yield pd.DataFrame([(path, i, *im.shape[:2], im.tobytes()) for i, im in enumerate(images)], columns=["path", "page", "height", "width", "bgr"])

    return files.select("path", "content").mapInPandas(pages, PAGE)


def enhance(image: np.ndarray) -> np.ndarray:
    """Grey, stretched to the full range."""
    grey = image[:, :, :3] @ np.array([0.114, 0.587, 0.299])
    lo, hi = grey.min(), grey.max()
    grey = (grey - lo) * (255.0 / (hi - lo)) if hi > lo else grey
    return np.repeat(grey.round().astype(np.uint8)[:, :, None], 3, axis=2)


def _between(image: np.ndarray, n: int, axis: int) -> np.ndarray:
    """One axis stretched to n, each new pixel between the two that its centre lies between."""
    size = image.shape[axis]
    at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
    low = np.floor(at).astype(int)
    part = (at - low).reshape([-1, 1, 1] if axis == 0 else [1, -1, 1])
    return np.take(image, low, axis) * (1 - part) + np.take(image, np.minimum(low + 1, size - 1), axis) * part


def to_canvas(image: np.ndarray, s: Settings) -> np.ndarray:
    """Turned if portrait, scaled to fit (means of source pixels when shrinking, linear between them when growing), centred on white."""
    if image.shape[0] > image.shape[1]:
        image = np.ascontiguousarray(np.rot90(image, -1))
    h, w = image.shape[:2]
    scale = min(s.canvas_width / w, s.canvas_height / h)
    nw, nh = max(1, round(w * scale)), max(1, round(h * scale))
    if scale < 1:
        sums = np.add.reduceat(np.add.reduceat(image.astype(np.float64), np.arange(nh) * h // nh, axis=0), np.arange(nw) * w // nw, axis=1)
        n = np.diff(np.append(np.arange(nh) * h // nh, h))[:, None] * np.diff(np.append(np.arange(nw) * w // nw, w))[None, :]
        small = (sums / n[:, :, None]).round().astype(np.uint8)
    else:
        small = _between(_between(image.astype(np.float64), nh, 0), nw, 1).round().astype(np.uint8)
    out = np.full((s.canvas_height, s.canvas_width, 3), 255, np.uint8)
    y, x = (s.canvas_height - nh) // 2, (s.canvas_width - nw) // 2
    out[y : y + nh, x : x + nw] = small
    return out


def tiles(pages: DataFrame, s: Settings) -> DataFrame:
    """(path, page, tile_id, tx, ty, tw, th, bgr): enhanced canvases cut up, one row a tile."""
    xs, ys = tile_starts(s.canvas_width, s.tile_size, s.tile_overlap), tile_starts(s.canvas_height, s.tile_size, s.tile_overlap)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                canvas = to_canvas(enhance(np.frombuffer(r.bgr, np.uint8).reshape(r.height, r.width, 3)), s)
                for i, (y, x) in enumerate((y, x) for y in ys for x in xs):
                    part = canvas[y : y + s.tile_size, x : x + s.tile_size]
                    yield pd.DataFrame(
                        [(r.path, r.page, f"Tile_{i + 1:03d}", x, y, part.shape[1], part.shape[0], part.tobytes())],
                        columns=["path", "page", "tile_id", "tx", "ty", "tw", "th", "bgr"]
                    )

    return pages.mapInPandas(cut, "path string, page int, tile_id string, tx int, ty int, tw int, th int, bgr binary")


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit BGR image as PNG."""
    h, w = image.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(image[:, :, ::-1]))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


COLOURS = {"object": (40, 160, 40), "ocr": (200, 90, 0), "arrow": (30, 30, 220)}


def overlay(canvas: np.ndarray, commands: list[tuple], longest: int = 4096) -> np.ndarray:
    """A canvas with (kind, shape, g0, g1, g2, g3) of draw_commands() on it: boxes as frames, lines with a mark at their
    start; larger sides than `longest` are thinned out. Captions stay in the table."""
    out = canvas.copy()
    h, w = out.shape[:2]
    for kind, shape, *g in commands:
        x1, y1, x2, y2 = g if shape == "line" else (g[0], g[1], g[0] + g[2], g[1] + g[3])
        n = int(max(abs(x2 - x1), abs(y2 - y1))) + 1
        if shape == "line":
            xs, ys = np.linspace(x1, x2, n), np.linspace(y1, y2, n)
            mark = np.mgrid[-6:7, -6:7].reshape(2, -1)
            xs, ys = np.append(xs, x1 + mark[0]), np.append(ys, y1 + mark[1])
        else:
            across, down = np.linspace(x1, x2, n), np.linspace(y1, y2, n)
            xs = np.concatenate([across, across, np.full(n, x1), np.full(n, x2)])
            ys = np.concatenate([np.full(n, y1), np.full(n, y2), down, down])
        for d in (-1, 0, 1):
            for e in (-1, 0, 1):
                out[np.clip(ys.astype(int) + d, 0, h - 1), np.clip(xs.astype(int) + e, 0, w - 1)] = COLOURS[kind]
    step = -(-max(h, w) // longest)
    return out[::step, ::step]
