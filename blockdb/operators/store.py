"""A chunk store on disk: content by hash, appended in versions, each version visible once its row is written.

Chunks come first, then the version's row, which makes them visible; files of a version without a row are not read, and the next insertion takes their place.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS, VERSIONS = "hash string, piece string, version long", "version long, written long"


@dataclass
class Store:
    spark: SparkSession
    folder: str

    def versions(self) -> DataFrame:
        return self.spark.read.schema(VERSIONS).parquet(f"{self.folder}/versions")

    def newest(self) -> int:
        return self.versions().agg(F.max("version")).first()[0] or 0

    def chunks(self, version: int | None = None) -> DataFrame:
        """hash, piece as of a version, by default the newest."""
        last = self.newest() if version is None else version
        return self.spark.read.schema(CHUNKS).parquet(f"{self.folder}/chunks").where(F.col("version") <= last).select("hash", "piece")

    def insert(self, rows: DataFrame) -> int:
        """Appends what is missing of `rows` (hash, piece), each content once; returns how many chunks were written."""
        last = self.newest()
        fresh = rows.join(self.chunks(last).select("hash"), "hash", "left_anti").groupBy("hash").agg(F.min("piece").alias("piece"))
        path = f"{self.folder}/chunks/version={last + 1}"
        fresh.write.mode("overwrite").parquet(path)
        written = self.spark.read.schema("hash string, piece string").parquet(path).count()
        self.spark.range(1).select(F.lit(last + 1).cast("long").alias("version"), F.lit(written).cast("long").alias("written")).coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")
        return written


def create(spark: SparkSession, folder: str | None = None) -> Store:
    """An empty store in `folder`, by default a new one in the warehouse, which all executors share."""
    folder = folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stores/{uuid.uuid4().hex}"
    spark.createDataFrame([], VERSIONS).write.parquet(f"{folder}/versions")
    spark.createDataFrame([], "hash string, piece string").write.parquet(f"{folder}/chunks/version=0")
    return Store(spark, folder)
