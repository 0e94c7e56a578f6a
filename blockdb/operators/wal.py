"""Write-ahead logs: replay, last writer wins over overlapping ranges, prefixes and cuts.

A mutation has image, seq, kind (WRITE or ZERO), start (first block), blocks and payload. Ranges are half open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockdb.operators.sequence import dense_number


def from_events(events: DataFrame) -> DataFrame:
    """Events as a log: signups are flush marks without a number; the others are mutations, numbered without gaps."""
    rows = events.where("event_type <> 'signup'").select(
        "event_id", F.when(F.col("event_type") == "error", "ZERO").otherwise("WRITE").alias("kind"),
        (F.col("user_id") % 4).cast("int").alias("image"), F.col("user_id").alias("start"), (1 + F.col("event_id") % 9).alias("blocks"), F.col("event_id").alias("payload"),
    )
    return dense_number(rows, "event_id", "seq")


def blocks_of(wal: DataFrame) -> DataFrame:
    """A row for each block that a mutation covers; requests are bounded, so are the rows of each."""
    return wal.withColumn("block", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("blocks") - 1)))


def overlay(wal: DataFrame) -> DataFrame:
    """The last mutation of each block: image, block, seq, kind, payload (null after ZERO). One partial aggregation, no sort."""
    best = blocks_of(wal).groupBy("image", "block").agg(F.max(F.struct("seq", "kind", "payload")).alias("m"))
    return best.select("image", "block", "m.seq", "m.kind", F.when(F.col("m.kind") == "WRITE", F.col("m.payload")).alias("payload"))


def intervals(wal: DataFrame) -> DataFrame:
    """The overlay as maximal disjoint ranges [start, end) of one mutation. Windows see the blocks of a single mutation."""
    rows = overlay(wal)
    island = F.col("block") - F.row_number().over(Window.partitionBy("image", "seq").orderBy("block"))
    runs = rows.withColumn("island", island).groupBy("image", "seq", "island").agg(F.min("block").alias("start"), (F.max("block") + 1).alias("end"), F.min("kind").alias("kind"), F.min("payload").alias("payload"))
    return runs.select("image", "start", "end", "seq", "kind", "payload")


def covered(wal: DataFrame) -> DataFrame:
    """Mutations that one single later mutation covers as a whole. Pairs meet at the covered range's first block."""
    later = blocks_of(wal).select("image", "block", F.col("seq").alias("by"), F.col("start").alias("s2"), (F.col("start") + F.col("blocks")).alias("e2"))
    same = (later["image"] == wal["image"]) & (later["block"] == wal["start"]) & (later["by"] > wal["seq"]) & (later["e2"] >= wal["start"] + wal["blocks"])
    return wal.join(later, same, "left_semi")


def contiguous_prefix(done: DataFrame) -> DataFrame:
    """Per image, the largest P such that 1..P are all there: the least number that is not followed by its successor. `done` has image and seq."""
    rows = done.select("image", "seq").distinct()
    follow = rows.select("image", (F.col("seq") - 1).alias("seq"))
    ends = rows.join(follow, ["image", "seq"], "left_anti").groupBy("image").agg(F.min("seq").alias("first_end"), F.lit(1).alias("one"))
    first = rows.groupBy("image").agg(F.min("seq").alias("first"))
    return first.join(ends, "image").select("image", F.when(F.col("first") == 1, F.col("first_end")).otherwise(0).cast("long").alias("published"))
