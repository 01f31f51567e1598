"""Administrative boundaries: containment, bounds, clipping.

A boundary is a handful of rings on the driver; rows are tested by a Catalyst fold
over a literal array of its edges, so no table is joined and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelarium.functions.geo import _number

Point = tuple[float, float]


@dataclass(frozen=True)
class Boundary:
    """A set of polygons without holes, each a closed ring."""

    rings: Sequence[Sequence[Point]]

    @property
    def box(self) -> list[float]:
        xs, ys = [x for r in self.rings for x, _ in r], [y for r in self.rings for _, y in r]
        return [min(xs), min(ys), max(xs), max(ys)]

    def edges(self) -> list[tuple[Point, Point]]:
        return [(p, q) for ring in self.rings for p, q in zip(ring, ring[1:], strict=False)]

    # -- rows -------------------------------------------------------------
    def _rings(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(strictly inside some ring by the even-odd rule, on some edge)."""
        inside, touching = F.lit(False), F.lit(False)
        for ring in self.rings:
            edges = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (*p, *q), strict=True)]) for p, q in zip(ring, ring[1:], strict=False)])
            crossed = F.aggregate(edges, F.lit(False), lambda odd, e: odd != _crosses(e, lon, lat))
            on = F.exists(edges, lambda e: _on_edge(e, lon, lat))
            inside, touching = inside | (crossed & ~on), touching | on
        return inside, touching

    def contains_strict(self, lon: Column, lat: Column) -> Column:
        """Interior points only: pixels on an edge are left out."""
        return self._rings(lon, lat)[0]

    def contains(self, lon, lat) -> Column:
        """Interior and edges."""
        inside, touching = self._rings(_number(lon), _number(lat))
        return inside | touching

    # -- driver -----------------------------------------------------------
    def has_point(self, lon: float, lat: float) -> bool:
        return any(_ring_side(ring, lon, lat) >= 0 for ring in self.rings)

    def meets_box(self, box: Sequence[float]) -> bool:
        return self.clip(box) is not None

    def clip(self, box: Sequence[float]) -> list[float] | None:
        """Bounds of the intersection with a box, None where they are apart; boxes
        that only touch give flat bounds. The bounds' extremes are vertices in the
        box, corners of the box in the polygon, or crossings of their edges."""
        west, south, east, north = map(float, box)
        found = [(x, y) for r in self.rings for x, y in r if west <= x <= east and south <= y <= north]
        found += [(x, y) for x in (west, east) for y in (south, north) if self.has_point(x, y)]
        for (x1, y1), (x2, y2) in self.edges():
            for side in (west, east):
                if x1 != x2 and min(x1, x2) <= side <= max(x1, x2) and south <= (y := y1 + (side - x1) / (x2 - x1) * (y2 - y1)) <= north:
                    found.append((side, y))
            for side in (south, north):
                if y1 != y2 and min(y1, y2) <= side <= max(y1, y2) and west <= (x := x1 + (side - y1) / (y2 - y1) * (x2 - x1)) <= east:
                    found.append((x, side))
        if not found:
            return None
        xs, ys = [x for x, _ in found], [y for _, y in found]
        return [min(xs), min(ys), max(xs), max(ys)]


def _crosses(e: Column, lon: Column, lat: Column) -> Column:
    spans = (e["y1"] > lat) != (e["y2"] > lat)
    return F.when(spans, lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.when(spans, e["y2"] - e["y1"]).otherwise(F.lit(1.0)) + e["x1"]).otherwise(F.lit(False))


def _on_edge(e: Column, lon: Column, lat: Column) -> Column:
    turn = (e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lon - e["x1"])
    within = lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    return (turn == 0.0) & within


def _ring_side(ring: Sequence[Point], lon: float, lat: float) -> int:
    """1 inside, 0 on the edge, -1 outside."""
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        if (x2 - x1) * (lat - y1) == (y2 - y1) * (lon - x1) and min(x1, x2) <= lon <= max(x1, x2) and min(y1, y2) <= lat <= max(y1, y2):
            return 0
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            odd = not odd
    return 1 if odd else -1
