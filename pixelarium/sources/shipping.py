"""Arrow maps whose functions live in this package."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes sure that the workers can import this package."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="pixelarium-")) / "pixelarium_core.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
