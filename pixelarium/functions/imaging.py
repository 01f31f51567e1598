"""Display expressions: stretches, colours, tints, and a PNG writer."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours of cluster labels, in order (fixed values).
PALETTE = ("#e6194b", "#3cb44b", "#4363d8", "#f58231", "#911eb4", "#42d4f4", "#f032e6", "#bfef45", "#fabed4", "#469990")


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def stretched(value: Column, low: Column, high: Column) -> Column:
    """0..255 between two levels, truncated; equal levels are taken one apart."""
    top = F.when(high <= low, low + 1.0).otherwise(high)
    return F.least(F.greatest((value - low) * 255.0 / (top - low), F.lit(0.0)), F.lit(255.0)).cast("int")


def palette_colour(label: Column, palette=PALETTE) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in palette]), (label % len(palette)).cast("int") + 1)


def mask_tint(alpha: Column) -> dict[str, Column]:
    """Red tint of a mask's visible pixels, at 0.6 of its opacity."""
    shown = alpha > 0
    level = lambda v: F.when(shown, F.lit(v)).otherwise(F.lit(0))
    return {"r": level(255), "g": level(70), "b": level(70), "a": F.when(shown, F.floor(alpha * 0.6 + 0.5)).otherwise(F.lit(0)).cast("int")}


def display_level(value: Column) -> Column:
    """A sample as a canvas level: rounded and clipped to 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(value + 0.5))).cast("int")


def canvas_pixel(samples: Column) -> Column:
    """Red, green, blue and opacity of a pixel's samples: three or four are colours,
    of fewer the first is a grey."""
    level = lambda i: display_level(F.get(samples, F.lit(i)))
    colours = F.array(level(0), level(1), level(2), F.when(F.size(samples) >= 4, level(3)).otherwise(F.lit(255)))
    return F.when(F.size(samples) >= 3, colours).otherwise(F.array(level(0), level(0), level(0), F.lit(255)))


def stretch_uint8(data: np.ndarray) -> np.ndarray:
    """Each band between its 2nd and 98th percentile; 8-bit data as it is."""
    if data.dtype == np.uint8:
        return data
    out = np.zeros(data.shape, np.uint8)
    for i, band in enumerate(data.astype(np.float32)):
        good = np.isfinite(band)
        if good.any():
            low, high = np.percentile(band[good], [2, 98])
            scaled = (band - low) * 255.0 / ((high if high > low else low + 1.0) - low)
            out[i] = np.clip(np.nan_to_num(scaled, nan=0.0), 0, 255).astype(np.uint8)
    return out


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB image (3, height, width) as a PNG file."""
    _, height, width = rgb.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), rgb.transpose(1, 2, 0).reshape(height, width * 3)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def heat_rgb(counts: np.ndarray) -> np.ndarray:
    """log1p counts (row 0 in the south) as a dark-to-bright image, north up."""
    level = np.log1p(counts.astype(float))
    level = (level / level.max() if level.size and level.max() > 0 else level)[::-1]
    red, green, blue = np.clip(level * 2.2, 0, 1), np.clip(level * 2 - 0.8, 0, 1), np.clip(np.sin(level * 3.0) * 0.6, 0, 1)
    return (np.stack([red, green, blue]) * 255).astype(np.uint8)
