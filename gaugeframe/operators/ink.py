"""Pixels: pictures(page_id, width, height, data: RGB bytes row by row) to grey, and masks of ink to boxes.

A picture never leaves its row: each is one Arrow value, worked on in numpy where it is read.
Null or short data gives null; an empty mask gives the box back whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def cad_gray(rgb: np.ndarray) -> np.ndarray:
    """Ink as grey: darkness and three quarters of the blue beyond the red, spread over 0 to 255."""
    x = rgb.astype(np.float32)
    ink = 255.0 - x.max(axis=2) + 0.75 * np.clip(x[..., 2] - x[..., 0], 0, 255)
    gray = np.clip(ink, 0, 255).astype(np.uint8)
    low, high = (int(gray.min()), int(gray.max())) if gray.size else (0, 0)
    if high == low:
        return np.zeros_like(gray)
    return np.rint((gray.astype(np.float32) - low) * (255.0 / (high - low))).astype(np.uint8)


def gray_pictures(pictures: DataFrame) -> DataFrame:
    """page_id, width, height, gray: one byte a pixel."""

    def run(batches):
        for b in batches:
            out = []
            for w, h, data in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                whole = data is not None and w is not None and h is not None and len(data) == w * h * 3
                out.append(cad_gray(np.frombuffer(data, np.uint8).reshape(h, w, 3)).tobytes() if whole else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], names=["page_id", "width", "height", "gray"])

    d = pictures.select("page_id", "width", "height", "data")
    return d.mapInArrow(run, f"page_id {d.schema['page_id'].dataType.simpleString()}, width {d.schema['width'].dataType.simpleString()}, height {d.schema['height'].dataType.simpleString()}, gray binary")


def bands(ink: np.ndarray, char: float, min_area: float, min_gap: float = 0.0) -> list[tuple[int, int, int, int]]:
    """(top, height, left, width) of the bands of rows that hold ink, apart by blank rows; ``ink`` is
    boolean.  Turn it for bands of columns."""
    on = ink.sum(axis=1) >= max(2.0, ink.shape[1] * 0.07)
    edges = np.flatnonzero(np.diff(on, prepend=False, append=False)).reshape(-1, 2)
    if not len(edges):
        return []
    gaps = edges[1:, 0] - edges[:-1, 1]
    apart = (gaps > max(2, int(char * 0.35))) & (gaps >= min_gap)
    tops, ends = edges[np.r_[True, apart], 0], edges[np.r_[apart, True], 1]
    out = []
    for top, end in zip(tops.tolist(), ends.tolist(), strict=True):
        part = ink[top:end]
        across = np.flatnonzero(part.any(axis=0))
        if end - top >= max(3, int(char * 0.55)) and len(across) and part.sum() >= min_area:
            out.append((top, end - top, int(across[0]), int(across[-1] - across[0]) + 1))
    return out


def split_blob(x: float, y: float, w: float, h: float, ink: np.ndarray, min_area: float) -> list[tuple[float, float, float, float]]:
    """The boxes (x, y, w, h) of a blob: one an ink band where it is 2.6 times as long as it is wide."""
    char = max(4.0, min(w, h) * 0.35)
    if ink.size and (h >= 2.6 * w or w >= 2.6 * h):
        rows = [(left, top, bw, bh) for top, bh, left, bw in bands(ink, char, min_area, char * 1.4)]
        if len(rows) > 1:
            return [(x + a, y + b, float(c), float(d)) for a, b, c, d in rows]
        columns = bands(ink.T, char, min_area, char * 1.4)
        if len(columns) > 1:
            return [(x + left, y + top, float(bw), float(bh)) for left, bw, top, bh in columns]
    return [(x, y, w, h)]


def refine_blobs(blobs: DataFrame, min_area: float = 8.0) -> DataFrame:
    """blobs(page_id, box_id, x, y, w, h, mask: one byte a pixel of the box, row by row, int(w) of them
    a row): page_id, box_id, part, x, y, w, h."""
    d = blobs.select("page_id", "box_id", "x", "y", "w", "h", "mask")

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, (x, y, w, h, mask) in enumerate(zip(*(b.column(k).to_pylist() for k in range(2, 7)), strict=True)):
                width = int(x + w) - int(x)
                fits = mask and width > 0 and len(mask) % width == 0
                ink = np.frombuffer(mask, np.uint8).reshape(-1, width) > 0 if fits else np.zeros((0, 0), bool)
                for part, box in enumerate(split_blob(x, y, w, h, ink, min_area)):
                    at.append(i)
                    rows.append((part, *[round(v, 1) for v in box]))
            ids = pa.array(at, pa.int64())
            cols = [b.column(0).take(ids), b.column(1).take(ids), pa.array([r[0] for r in rows], pa.int32())]
            cols += [pa.array([r[k] for r in rows], pa.float64()) for k in range(1, 5)]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "box_id", "part", "x", "y", "w", "h"])

    kind = lambda c: d.schema[c].dataType.simpleString()
    return d.mapInArrow(run, f"page_id {kind('page_id')}, box_id {kind('box_id')}, part int, x double, y double, w double, h double")
