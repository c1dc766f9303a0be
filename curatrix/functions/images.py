"""Geometry and pixel preprocessing: letterbox and stretch to a square, normalisation, and the six deterministic views.

Geometry is column arithmetic. Pixels are NumPy arrays of shape (height, width, 3); a table of them goes through ``preprocess``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.numeric import round_half_away, round_half_even

# Mean and deviation of the channels (red, green, blue), and the fill of letterboxes that follows from them.
CHANNEL_MEAN = np.array([0.485, 0.456, 0.406], np.float32)
CHANNEL_STD = np.array([0.229, 0.224, 0.225], np.float32)
FILL = tuple(int(round(float(c) * 255)) for c in CHANNEL_MEAN)


def letterbox_geometry(width: Column, height: Column, size: int, half_even: bool = True) -> dict[str, Column]:
    """``target_width, target_height, left, top``. Two implementations round exact halves differently: half to even, or away from zero."""
    scale = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    nearest = round_half_even if half_even else round_half_away
    side = lambda x: F.greatest(F.lit(1), F.least(F.lit(size), nearest(x * scale))).cast("long")
    w, h = side(width), side(height)
    half = lambda x: F.floor((F.lit(size) - x) / 2).cast("long")
    return {"target_width": w, "target_height": h, "left": half(w), "top": half(h)}


def _area_weights(source: int, target: int) -> np.ndarray:
    """Share of each source pixel in each target pixel; an enlargement interpolates between centres."""
    out = np.zeros((target, source))
    step = source / target
    for i in range(target):
        if step >= 1:
            a, b = i * step, (i + 1) * step
            for j in range(int(a), min(source, int(np.ceil(b)))):
                out[i, j] = (min(b, j + 1) - max(a, j)) / step
        else:
            x = min(max((i + 0.5) * step - 0.5, 0), source - 1)
            j = int(x)
            out[i, j] += 1 - (x - j)
            if j + 1 < source:
                out[i, j + 1] += x - j
    return out


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area average, rounded to bytes."""
    rows, columns = _area_weights(pixels.shape[0], height), _area_weights(pixels.shape[1], width)
    mixed = np.einsum("ij,jkc,lk->ilc", rows, pixels.astype(np.float64), columns)
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


def letterboxed(pixels: np.ndarray, size: int) -> np.ndarray:
    height, width = pixels.shape[:2]
    scale = min(size / width, size / height)
    w, h = (max(1, min(size, round(x * scale))) for x in (width, height))
    canvas = np.empty((size, size, 3), np.uint8)
    canvas[...] = FILL
    left, top = (size - w) // 2, (size - h) // 2
    canvas[top : top + h, left : left + w] = resized(pixels, w, h)
    return canvas


def center_crop(pixels: np.ndarray, fraction: float) -> np.ndarray:
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be in (0, 1]")
    height, width = pixels.shape[:2]
    h, w = (max(1, min(x, round(x * fraction))) for x in (height, width))
    top, left = (height - h) // 2, (width - w) // 2
    return pixels[top : top + h, left : left + w]


def six_views(pixels: np.ndarray, size: int) -> np.ndarray:
    """The original, its two flips and both, and two centre crops, each stretched to the square."""
    whole = resized(pixels, size, size)
    crops = [resized(center_crop(pixels, f), size, size) for f in (0.9, 0.8)]
    return np.stack([whole, whole[:, ::-1], whole[::-1], whole[::-1, ::-1], *crops])


def normalized(pixels: np.ndarray) -> np.ndarray:
    """Channels first, as 32-bit floats with mean 0 and deviation 1 of the fixed statistics."""
    return np.ascontiguousarray(((pixels.astype(np.float32) / np.float32(255)) - CHANNEL_MEAN).transpose(2, 0, 1) / CHANNEL_STD[:, None, None])


def preprocess(images: DataFrame, size: int, geometry: str = "stretch") -> DataFrame:
    """``key, tensor`` (3 * size * size floats) of ``key, width, height, pixels`` (flat bytes, rows of RGB)."""
    if geometry not in ("stretch", "letterbox"):
        raise ValueError(f"no such geometry: {geometry!r}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):  # an image at a time: tensors are large
                pixels = np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width, 3)
                square = resized(pixels, size, size) if geometry == "stretch" else letterboxed(pixels, size)
                yield pd.DataFrame({"key": [row.key], "tensor": [normalized(square).ravel()]})

    return images.select("key", "width", "height", "pixels").mapInPandas(run, "key string, tensor array<float>")
