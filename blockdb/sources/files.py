"""Sources and sinks: raw images as chunks, telemetry lines, package lists, and sinks that never overwrite."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockdb.sources import images


def image_chunks(spark: SparkSession, paths: list[str], size: int = 4096) -> DataFrame:
    """image (the path's number in `paths`), pos, hash, len: see `images.ImageSource`, which cuts large images into ranges."""
    spark.dataSource.register(images.ImageSource)
    return spark.read.format("blocks").option("paths", json.dumps(paths)).option("size", size).load()


def telemetry(spark: SparkSession, folder: str, schema: str, stream: bool = False) -> DataFrame:
    """Lines of JSON; a line that is cut off is dropped, as is one that does not parse."""
    reader = spark.readStream if stream else spark.read
    lines = reader.text(folder)
    return lines.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def packages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="name string, version string")


def write_new(df: DataFrame, path: str) -> None:
    """Evidence is written once: an existing folder is an error."""
    df.write.mode("errorifexists").parquet(path)
