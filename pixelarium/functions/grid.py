"""Grid shapes, cells and bins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_SPAN = 1e-9


def clipped_floor(x: Column, n: int) -> Column:
    return F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(n - 1)).cast("long")


@dataclass(frozen=True)
class Grid:
    """A grid over a box, row 0 in the north."""

    box: tuple[float, float, float, float]
    rows: int
    cols: int

    @staticmethod
    def over(box: Sequence[float], samples: int) -> Grid:
        """About ``samples`` cells with the box's aspect, two by two at least."""
        west, south, east, north = map(float, box)
        wide, high = max(east - west, LEAST_SPAN), max(north - south, LEAST_SPAN)
        rows = max(2, int(math.sqrt(samples / (wide / high))))
        return Grid((west, south, east, north), rows, max(2, math.ceil(samples / rows)))

    @property
    def steps(self) -> tuple[float, float]:
        west, south, east, north = self.box
        return max(east - west, LEAST_SPAN) / self.cols, max(north - south, LEAST_SPAN) / self.rows

    def col(self, lon: Column) -> Column:
        return clipped_floor((lon - F.lit(self.box[0])) / F.lit(self.steps[0]), self.cols)

    def row(self, lat: Column) -> Column:
        return clipped_floor((F.lit(self.box[3]) - lat) / F.lit(self.steps[1]), self.rows)

    def cell_box(self, row: Column, col: Column) -> tuple[Column, Column, Column, Column]:
        wide, high = self.steps
        return (
            F.lit(self.box[0]) + col * wide,
            F.lit(self.box[3]) - (row + 1) * high,
            F.lit(self.box[0]) + (col + 1) * wide,
            F.lit(self.box[3]) - row * high,
        )


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin from the low end (row 0 in the south), values beyond in the end bins."""
    return clipped_floor((value - F.lit(float(low))) / F.lit(max(float(high) - float(low), LEAST_SPAN)) * F.lit(bins), bins)


def even_indices(n: int, budget: int) -> list[int]:
    """``budget`` indices from first to last, truncated; all where there are fewer."""
    if n <= budget:
        return list(range(n))
    import numpy as np

    return np.linspace(0, n - 1, num=budget, dtype=np.int64).tolist()


def window_meet(col: Column, row: Column, width: int, height: int, window: Sequence[int]) -> dict[str, Column]:
    """Offset and size of what a window of that size at (col, row) has in common with
    another (first col, first row, end col, end row); sizes are 0 where they are apart."""
    left, top, right, bottom = window
    x, y = F.greatest(col, F.lit(left)), F.greatest(row, F.lit(top))
    wide, high = F.least(col + width, F.lit(right)) - x, F.least(row + height, F.lit(bottom)) - y
    return {"col_off": x, "row_off": y, "width": F.greatest(F.lit(0), wide), "height": F.greatest(F.lit(0), high)}


def valid_bands(bands: Column, nodata: float | None) -> Column:
    """Whether no band of a pixel has the nodata value; NaN stands for NaN."""
    if nodata is None:
        return F.lit(True)
    return ~F.exists(bands, F.isnan if nodata != nodata else lambda b: b == F.lit(float(nodata)))


def display_tile_box(box: Sequence[Column], z, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """(left, bottom, right, top) of a quadtree tile within a raster's own bounds,
    y from the top."""
    west, south, east, north = box
    n = F.pow(F.lit(2.0), z)
    wide, high = (east - west) / n, (north - south) / n
    return west + x * wide, north - (y + 1) * high, west + (x + 1) * wide, north - y * high
