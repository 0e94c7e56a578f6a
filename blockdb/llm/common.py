"""What the operators share: tables, the shared folder, and the number of partitions."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session without one gets a temporary folder; a cluster without one is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="blockdb-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: With it, a query's shuffle files go when the query has ended; its result is in the shared folder by then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once into the shared folder and read it back: lineage ends there, executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/blockdb/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (out, path)
    return out


_written: dict[int, tuple[DataFrame, str]] = {}


def release(df: DataFrame) -> None:
    """Delete what `materialize` has written; nothing may read it any more."""
    _forget(df.sparkSession, _written.pop(id(df))[1])


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended before
        pass


def partitions(spark: SparkSession) -> int:
    """The cluster's setting, which its owner sizes to the data; shards are counted by it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty), and further columns by name."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
