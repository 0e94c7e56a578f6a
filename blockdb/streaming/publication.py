"""Streams: ordered publication of completions, compaction by micro-batches, windows over telemetry files, and coalescing of fetches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from blockdb.operators import wal

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Publisher(StatefulProcessor):
    """Publishes a key's sequences in order; what comes early waits in state. State is bounded by what is in flight."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "seq long")
        self.waiting = handle.getMapState("waiting", "seq long", "payload long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        expected = self.next.get()[0] if self.next.exists() else 1
        for part in rows:
            for r in part.itertuples():
                if r.seq >= expected:
                    self.waiting.updateValue((int(r.seq),), (int(r.payload),))
        out = []
        while self.waiting.containsKey((expected,)):
            out.append((int(key[0]), expected, int(self.waiting.getValue((expected,))[0])))
            self.waiting.removeKey((expected,))
            expected += 1
        self.next.update((expected,))
        yield pd.DataFrame(out, columns=["image", "seq", "payload"])

    def close(self) -> None:
        pass


def publish_in_order(completions: DataFrame) -> DataFrame:
    """A stream of image, seq, payload as it completes -> the same rows, each image's in sequence, as far as there is no gap. Needs RocksDB state (STATE_PROVIDER)."""
    return completions.groupBy("image").transformWithStateInPandas(Publisher(), "image long, seq long, payload long", "Append", "None")


def compact_stream(mutations: DataFrame, folder: str, checkpoint: str):
    """Each micro-batch becomes a version: payloads first, then extents, then the version's row, which makes it visible. A batch run again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()  # read three times
        try:
            rows = wal.overlay(batch)
            rows.where("payload is not null").select("payload").distinct().write.mode("overwrite").parquet(f"{folder}/chunks/batch={number}")
            rows.write.mode("overwrite").parquet(f"{folder}/extents/batch={number}")
            batch.agg(F.lit(number).alias("generation"), F.max("seq").alias("durable"), F.count(F.lit(1)).alias("mutations")).write.mode("overwrite").parquet(f"{folder}/versions/batch={number}")
        finally:
            batch.unpersist()

    return mutations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_version(spark: SparkSession, folder: str, generation: int | None = None) -> DataFrame:
    """The image contents as of a version (the newest by default): the last write of each block among published batches."""
    versions = spark.read.option("basePath", f"{folder}/versions").parquet(f"{folder}/versions")
    versions = versions if generation is None else versions.where(F.col("generation") <= generation)
    extents = spark.read.option("basePath", f"{folder}/extents").parquet(f"{folder}/extents")
    seen = extents.join(versions.select(F.col("generation").alias("batch")), "batch", "left_semi")
    best = seen.groupBy("image", "block").agg(F.max(F.struct("seq", "kind", "payload")).alias("m"))
    return best.select("image", "block", "m.seq", "m.kind", "m.payload")


def telemetry_windows(samples: DataFrame, width: str = "500 milliseconds", late: str = "5 seconds") -> DataFrame:
    """Tumbling windows over a stream of ts, guest, ns; rows later than `late` are dropped by the watermark, as streams must."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", width), "guest").agg(F.count(F.lit(1)).alias("n"), F.sum("ns").alias("total_ns"), F.max("ns").alias("max_ns"))


def coalesce_fetches(misses: DataFrame, within: str = "10 seconds") -> DataFrame:
    """Of a stream of ts, hash, the first miss of each hash within a span fetches; the others wait for it."""
    return misses.withWatermark("ts", within).dropDuplicatesWithinWatermark(["hash"])
