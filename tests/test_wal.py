"""Logs against a flat array that replays the same random operations."""

import random

from blockdb.operators import folds, placement, wal
from blockdb.operators.sequence import dense_number, running_base
from pyspark.sql import functions as F


def log(spark, n=400, seed=7):
    r = random.Random(seed)
    rows = [(i % 2, i + 1, "ZERO" if r.random() < 0.2 else "WRITE", r.randrange(32), r.randrange(1, 9), i + 1) for i in range(n)]
    return rows, spark.createDataFrame(rows, "image int, seq long, kind string, start long, blocks long, payload long")


def test_overlay(spark):
    rows, df = log(spark)
    flat = {}
    for image, seq, kind, start, blocks, payload in rows:
        for b in range(start, start + blocks):
            flat[image, b] = (seq, kind, payload if kind == "WRITE" else None)
    assert {(r.image, r.block): (r.seq, r.kind, r.payload) for r in wal.overlay(df).collect()} == flat
    covered = {}
    for r in wal.intervals(df).collect():
        for b in range(r.start, r.end):
            assert (r.image, b) not in covered
            covered[r.image, b] = r.seq
    assert covered == {k: v[0] for k, v in flat.items()}


def test_covered(spark):
    rows, df = log(spark, 120)
    want = {s for i, s, _, a, n, _ in rows if any(i == j and t > s and b <= a and b + m >= a + n for j, t, _, b, m, _ in rows)}
    assert {r.seq for r in wal.covered(df).collect()} == want


def test_prefix(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (0, 4), (1, 2), (2, 1)], "image int, seq long")
    assert {r.image: r.published for r in wal.contiguous_prefix(df).collect()} == {0: 2, 1: 0, 2: 1}


def test_numbers(spark):
    df = spark.range(0, 30000, 3).withColumn("g", F.col("id") % 2)
    rows = dense_number(df, "id", "n", ["g"]).collect()
    for g in (0, 1):
        assert [r.n for r in sorted((r for r in rows if r.g == g), key=lambda r: r.id)] == list(range(1, 5001))
    total = running_base(df, F.col("id"), "id").agg(F.max("base")).first()[0]
    assert total == sum(range(0, 29997, 3))


def test_placement(spark):
    hashes = spark.range(512).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    rows = placement.owners(hashes, 4, 2).collect()
    assert len(rows) == 1024
    counts = [sum(r.member == m for r in rows) for m in range(4)]
    assert min(counts) > 200 and sum(counts) == 1024


def test_folds(spark):
    levels = spark.createDataFrame([(0, i, u) for i, u in enumerate([10, 100, 80, 59, 99, 120])], "image int, n long, used long")
    r = folds.hysteresis(levels).first()
    assert (r.steps, r.stops, r.stopped_steps, r.compaction_steps) == (6, 2, 3, 4)
    accesses = spark.createDataFrame([(0, i, c) for i, c in enumerate([1, 2, 1, 3, 2])], "host long, n long, content long")
    r = folds.lru(accesses, 2).first()
    assert (r.hits, r.misses, r.evictions) == (1, 4, 2)
    served = folds.deficit_round_robin(spark.createDataFrame([(0, 1, 0, 1 << 20), (0, 2, 1, 10), (0, 3, 0, 1 << 19), (0, 4, 1, 10)], "host long, id long, image long, bytes long")).orderBy("place").collect()
    assert [x.id for x in served] == [1, 2, 4, 3]
