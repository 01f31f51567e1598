"""Region extracts: one representative pixel per grid cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelarium.functions import geo
from pixelarium.functions.grid import Grid


def first_per_cell(pixels: DataFrame, grid: Grid) -> DataFrame:
    """(grid_row, grid_col, id): the smallest id of each cell that has pixels. The
    aggregate carries one number per cell; vectors are fetched afterwards."""
    cells = pixels.select("id", grid.row(F.col("lat")).alias("grid_row"), grid.col(F.col("lon")).alias("grid_col"))
    return cells.groupBy("grid_row", "grid_col").agg(F.min("id").alias("id"))


def grid_extract(pixels: DataFrame, box: Sequence[float], samples: int = 5000) -> tuple[DataFrame, Grid]:
    """Pixels in the box, thinned to the first of each cell of a grid of about
    ``samples`` cells, with the cell's row (0 in the north) and column."""
    grid = Grid.over(box, samples)
    inside = pixels.where(geo.in_box(F.col("lon"), F.col("lat"), box))
    cells = first_per_cell(inside, grid)
    # as many rows as the grid has cells, whatever the table's size
    table = F.broadcast(cells) if grid.rows * grid.cols <= 1_000_000 else cells
    return inside.join(table, "id"), grid
