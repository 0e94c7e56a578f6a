"""Ordered folds: admission with hysteresis, deficit round robin, least-recently-used caches. One group is one host or image, in its own order.

But for hysteresis and shares of the background, state depends on all earlier rows of its group, so a group is folded in one task; groups are as parallel as there are hosts or images.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockdb.operators.sequence import dense_number, last_before

QUANTUM = 1 << 20


def hysteresis(levels: DataFrame) -> DataFrame:
    """Stopped at 100 %, open again below 60 %, compacting from 75 % or while stopped. `levels`: image, n, used (percent).

    Only levels from 100 % and below 60 % decide; between them the last decision holds, so it is carried along and nothing is folded.
    """
    used = F.col("used")
    decided = F.when(used >= 100, True).when(used < 60, False)
    rows = last_before(levels, decided, "n", "before", ["image"]).withColumn("before", F.coalesce("before", F.lit(False)))
    rows = rows.withColumn("stopped", F.coalesce(decided, F.col("before")))
    return rows.groupBy("image").agg(
        F.count(F.lit(1)).alias("steps"), F.count_if((used >= 100) & ~F.col("before")).alias("stops"), F.count_if("stopped").alias("stopped_steps"),
        F.count_if(F.col("stopped") | (used >= 75)).alias("compaction_steps"),
    )


def deficit_round_robin(requests: DataFrame) -> DataFrame:
    """The order in which a host serves its images' queues: each visit adds a quantum when the head does not fit. `requests`: host, id, image, bytes."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        queues = {i: deque() for i in sorted(rows.image.unique())}
        for r in rows.itertuples():
            queues[r.image].append((r.id, r.bytes))
        images, deficit = list(queues), dict.fromkeys(queues, 0)
        served, cursor, fresh = [], 0, True
        while any(queues.values()):
            image = images[cursor]
            queue = queues[image]
            if queue and fresh and deficit[image] < queue[0][1]:
                deficit[image] += QUANTUM
            fresh = False
            if queue and deficit[image] >= queue[0][1]:
                id_, size = queue.popleft()
                deficit[image] -= size
                served.append((rows.host.iloc[0], len(served) + 1, id_, image))
                continue
            if not queue:
                deficit[image] = 0
            cursor, fresh = (cursor + 1) % len(images), True
        return pd.DataFrame(served, columns=["host", "place", "id", "image"])

    return requests.groupBy("host").applyInPandas(fold, "host long, place long, id long, image long")


def background_share(requests: DataFrame, demand: int = 3) -> DataFrame:
    """host, id, class, place (from 0): `demand` requests of the foreground, then one of the background, as long as both wait. `requests`: host, id, class.

    A place follows from a request's number within its class, so nothing is folded.
    """
    numbered = dense_number(requests, "id", "i", ["host", "class"]).withColumn("i", F.col("i") - 1)
    sizes = requests.groupBy("host").agg(F.count_if(F.col("class") == "background").alias("back"), F.count_if(F.col("class") != "background").alias("front"))
    i, back = F.col("i"), F.col("class") == "background"
    place = F.when(back, F.least((demand + 1) * i + demand, F.col("front") + i)).otherwise(i + F.least(F.floor(i / demand), F.col("back")))
    return numbered.join(sizes, "host").select("host", "id", "class", place.cast("long").alias("place"))


def log_batches(mutations: DataFrame, most: int = 63, most_bytes: int = 1 << 20) -> DataFrame:
    """image, batch, descriptors, first, last, payload_bytes: a batch closes before a mutation that would exceed `most` rows or `most_bytes`. `mutations`: image, seq, bytes.

    Where a batch begins depends on all batches before, so an image's log is streamed through one task, in constant memory.
    """

    def stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        image = batch = held = payload = first = last = None
        for part in parts:
            out = []
            for i, seq, size in zip(part.image.tolist(), part.seq.tolist(), part.bytes.tolist()):
                if i != image or held == most or payload + size > most_bytes:
                    if image is not None:
                        out.append((image, batch, held, first, last, payload))
                    batch = batch + 1 if i == image else 0
                    image, held, payload, first = i, 0, 0, seq
                held, payload, last = held + 1, payload + size, seq
            yield pd.DataFrame(out, columns=names)
        if image is not None:
            yield pd.DataFrame([(image, batch, held, first, last, payload)], columns=names)

    names = ["image", "batch", "descriptors", "first", "last", "payload_bytes"]
    rows = mutations.repartition("image").sortWithinPartitions("image", "seq")
    return rows.mapInPandas(stream, "image long, batch long, descriptors long, first long, last long, payload_bytes long")


def lru(accesses: DataFrame, capacity: int) -> DataFrame:
    """Hits, misses and evictions of each host's cache. `accesses`: host, n (order), content."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        held: OrderedDict = OrderedDict()
        hits = misses = evictions = 0
        for content in rows.sort_values("n").content:
            if content in held:
                held.move_to_end(content)
                hits += 1
                continue
            misses += 1
            if len(held) == capacity:
                held.popitem(last=False)
                evictions += 1
            held[content] = True
        return pd.DataFrame([(rows.host.iloc[0], hits, misses, misses, evictions)], columns=["host", "hits", "misses", "fills", "evictions"])

    return accesses.groupBy("host").applyInPandas(fold, "host long, hits long, misses long, fills long, evictions long")
