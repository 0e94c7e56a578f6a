"""Streams against their batch twins."""

from blockdb.functions import scalar
from blockdb.operators import wal
from blockdb.streaming import publication
from pyspark.sql import functions as F


def test_ordered_publication(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", publication.STATE_PROVIDER)
    for i, part in enumerate([[3, 1], [4], [2, 6]]):
        spark.createDataFrame([(0, s, s * 10) for s in part], "image long, seq long, payload long").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    source = spark.readStream.schema("image long, seq long, payload long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    publication.publish_in_order(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.seq, r.payload) for r in rows) == [(1, 10), (2, 20), (3, 30), (4, 40)]


def test_compaction(spark, tmp_path):
    df = spark.range(1, 61).select((F.col("id") % 2).cast("int").alias("image"), F.col("id").alias("seq"), F.when(F.col("id") % 7 == 0, "ZERO").otherwise("WRITE").alias("kind"), (F.col("id") * 5 % 16).alias("start"), (1 + F.col("id") % 3).alias("blocks"), F.col("id").alias("payload"))
    for i in range(3):
        df.where(F.col("seq") % 3 == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    publication.compact_stream(source, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(240)
    got = {(r.image, r.block): (r.seq, r.payload) for r in publication.read_version(spark, str(tmp_path / "store")).collect()}
    assert got == {(r.image, r.block): (r.seq, r.payload) for r in wal.overlay(df).collect()}


def stream(spark, folder, schema, parts):
    """A stream whose micro-batches are `parts`, rows of milliseconds and more columns."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_millis("ts")).coalesce(1).write.parquet(f"{folder}/in/p{i}")
    source = spark.read.parquet(f"{folder}/in/p0")
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def drain(df, folder):
    df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination(240)
    return df.sparkSession.read.parquet(f"{folder}/out")


def test_telemetry_windows(spark, tmp_path):
    rows = [(i * 130, i % 2, i * 7 % 50) for i in range(60)]
    parts = [rows[:20][::-1], rows[20:40], rows[40:], [(1_000_000, 0, 1)], [(2_000_000, 0, 1)]]
    out = drain(publication.telemetry_windows(stream(spark, tmp_path, "ts long, guest long, ns long", parts)), tmp_path)
    want = {}
    for ts, guest, ns in rows:
        want.setdefault((ts // 500, guest), []).append(ns)
    got = out.where("window.start < timestamp_millis(900000)").selectExpr("unix_millis(window.start) div 500 as slot", "guest", "n", "total_ns", "max_ns").collect()
    assert {(r.slot, r.guest): (r.n, r.total_ns, r.max_ns) for r in got} == {k: (len(v), sum(v), max(v)) for k, v in want.items()}


def test_coalesced_fetches(spark, tmp_path):
    parts = [[(1000, "a"), (3000, "a"), (1000, "b")], [(60_000, "c")], [(61_000, "c")], [(200_000, "a")]]  # 0 would be late from the start
    out = drain(publication.coalesce_fetches(stream(spark, tmp_path, "ts long, hash string", parts)), tmp_path)
    assert sorted(r.hash for r in out.collect()) == ["a", "a", "b", "c"]


def test_scalars(spark):
    r = spark.range(1).select(
        *(scalar.bit_bucket(F.lit(v)).alias(f"b{v}") for v in (0, 1, 2, 3, 4)), scalar.us_bucket(F.lit(4_500)).alias("u"), scalar.cpu_set(F.lit("2-5,8")).alias("c"),
        scalar.hex_id(F.lit("AB" * 16)).alias("h"), scalar.aligned_range(F.lit(4096), F.lit(4096), F.lit(8192)).alias("ok"), scalar.counter(F.lit('{"k": 3}'), "$.k").alias("k"),
    ).first()
    assert [r[f"b{v}"] for v in (0, 1, 2, 3, 4)] == [0, 1, 2, 2, 3] and r.u == 2 and r.c == [2, 3, 4, 5, 8] and r.h == "ab" * 16 and r.ok and r.k == 3
