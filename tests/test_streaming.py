"""The running density equals the batch histogram."""

from pixelarium.operators import histogram
from pixelarium.operators.build import SCHEMA
from pixelarium.streaming import density


def test_running_density(spark, tmp_path):
    box = (0.0, 0.0, 1.0, 1.0)
    for part in range(3):
        rows = [(i, (i % 17) / 17, (i % 13) / 13, "t", i, 0, [1.0]) for i in range(part * 50, part * 50 + 50)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/pixels")
    stream = density.running_density(density.arriving_pixels(spark, f"{tmp_path}/pixels", 1), box, 8)
    query = density.start(stream, "running", f"{tmp_path}/state")
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.table("running").collect()}
    assert got == {tuple(r) for r in histogram.density(spark.read.parquet(f"{tmp_path}/pixels"), box, 8).collect()}
