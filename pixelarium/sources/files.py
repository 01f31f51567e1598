"""Small files (manifests, images) in any store that Spark can reach."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _store(spark, path)
    return fs.exists(hadoop)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    hadoop, fs = _store(spark, path)
    out = fs.create(hadoop, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, payload: dict) -> None:
    write_bytes(spark, path, json.dumps(payload, ensure_ascii=False, indent=2).encode())


def read_json(spark: SparkSession, path: str) -> dict | None:
    if not exists(spark, path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])
