"""The store on disk, free ranges, batches and shares against plain loops."""

import random

from blockdb.functions import scalar
from blockdb.operators import folds, store
from blockdb.operators.sequence import first_rows, last_before, previous, running_base, running_bases
from blockdb.plans import store_queries
from pyspark.sql import functions as F


def test_store(spark, tmp_path):
    at = store.create(spark, f"file://{tmp_path}/s")
    rows = lambda *x: spark.createDataFrame([(h, h * 3) for h in x], "hash string, piece string")
    assert [at.insert(rows("a", "b", "a")), at.insert(rows("b", "c")), at.insert(rows("a"))] == [2, 1, 0]
    assert sorted(r.piece for r in at.chunks().collect()) == ["aaa", "bbb", "ccc"]
    assert sorted(r.hash for r in at.chunks(1).collect()) == ["a", "b"]
    # A version whose row is missing is not there; the next insertion takes its place.
    rows("z").write.parquet(f"file://{tmp_path}/s/chunks/version=4")
    assert at.chunks().count() == 3 and at.insert(rows("y")) == 1
    assert sorted(r.hash for r in at.chunks().collect()) == ["a", "b", "c", "y"]


def test_batches(spark):
    rng = random.Random(2)
    rows = [(i % 2, i, rng.choice([0, 4096, 200_000, 2_000_000])) for i in range(900)]
    want = []
    for image in (0, 1):
        batch, held = 0, []
        for _, seq, size in [*(r for r in rows if r[0] == image), (image, None, 1 << 40)]:
            if held and (len(held) == 63 or sum(s for _, s in held) + size > 1 << 20):
                want.append((image, batch, len(held), held[0][0], held[-1][0], sum(s for _, s in held)))
                batch, held = batch + 1, []
            held.append((seq, size))
    df = spark.createDataFrame(rows, "image long, seq long, bytes long").repartition(3)
    assert sorted(tuple(r) for r in folds.log_batches(df).collect()) == want


def test_free_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.randrange(9000), rng.randrange(1, 5)) for _ in range(200)]
    want = set()
    for image in range(3):
        used = {b for i, s, n in rows if i == image for b in range(s, s + n)}
        free, start = [b for b in range(max(used)) if b not in used], None
        for b in free:
            start = b if b - 1 in used or start is None else start
            if b + 1 in used:
                want.add((image, start, b + 1))
    got = store_queries._free(spark.createDataFrame(rows, "image long, start long, blocks long"))
    assert {tuple(r) for r in got.collect()} == want


def test_background_share(spark):
    rng = random.Random(4)
    rows = [(h, i * 2 + h, rng.choice(["demand"] * (1 + 4 * h) + ["background"])) for h in range(2) for i in range(60)]
    want = set()
    for h in range(2):
        queues = {c: sorted(i for x, i, y in rows if x == h and y == c) for c in ("demand", "background")}
        place = run = 0
        while any(queues.values()):
            back = queues["background"] and (run == 3 or not queues["demand"])
            run = 0 if back else run + 1
            c = "background" if back else "demand"
            want.add((h, queues[c].pop(0), c, place))
            place += 1
    got = folds.background_share(spark.createDataFrame(rows, "host long, id long, class string"))
    assert {tuple(r) for r in got.collect()} == want


def test_levels_of_sums(spark):
    """Ranges of ranges: orders far apart."""
    rng = random.Random(5)
    orders = sorted(rng.sample(range(100_000_000), 300))
    df = spark.createDataFrame([(i, i % 2) for i in orders], "id long, g long")
    got = {r.id: r.base for r in running_base(df, F.lit(3), "id", ["g"]).collect()}
    seen = {0: 0, 1: 0}
    for i in orders:
        assert got[i] == 3 * seen[i % 2]
        seen[i % 2] += 1


def test_carried_values(spark):
    """Values carried over ranges and ranges of ranges, ties of the order included, against a loop."""
    rng = random.Random(6)
    rows = [(i, rng.choice((5, 9000, 50_000_000)) * rng.randrange(1, 9), i % 2, rng.choice((None, None, i)), rng.choice((None, i))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, t long, g long, v long, size long")
    carried = {r.id: r.last for r in last_before(df, F.col("v"), "t", "last", ["g"], "id").collect()}
    before = {r.id: r.prev for r in previous(df, "t", {"prev": "id"}, ["g"], "id").collect()}
    sums = {r.id: (r.a, r.b) for r in running_bases(df, {"a": F.col("size"), "b": F.lit(2)}, "id", ["g"]).collect()}
    last, prev = {}, {}
    for i, _, g, v, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        assert carried[i] == last.get(g) and before[i] == prev.get(g)
        last[g], prev[g] = last.get(g) if v is None else v, i
    assert sums == {i: (sum(r[4] or 0 for r in rows[:i] if r[2] == g), 2 * sum(r[2] == g for r in rows[:i])) for i, _, g, _, _ in rows}
    newest = {(r.g, r.id) for r in first_rows(df, 7, [F.desc("t"), F.desc("id")], ["g"], "id").collect()}
    assert newest == {(g, r[0]) for g in (0, 1) for r in sorted((r for r in rows if r[2] == g), key=lambda r: (-r[1], -r[0]))[:7]}


def test_hysteresis(spark):
    rng = random.Random(8)
    rows = [(i % 3, i * 700, rng.choice((10, 59, 60, 74, 75, 80, 99, 100, 120))) for i in range(300)]
    want = {}
    for image in range(3):
        stopped, steps, stops, stopped_steps, compaction = False, 0, 0, 0, 0
        for _, _, used in (r for r in rows if r[0] == image):
            stops += used >= 100 and not stopped
            stopped = used >= 100 or (stopped and used >= 60)
            steps, stopped_steps, compaction = steps + 1, stopped_steps + stopped, compaction + (stopped or used >= 75)
        want[image] = (steps, stops, stopped_steps, compaction)
    got = folds.hysteresis(spark.createDataFrame(rows, "image int, n long, used long")).collect()
    assert {r.image: (r.steps, r.stops, r.stopped_steps, r.compaction_steps) for r in got} == want


def test_scalars(spark):
    df = spark.createDataFrame([("00000000000000000012", "sent 1,234 bytes  received 56 bytes", "<b> <a> <b>"), ("00000000000000000000", "x", ""), ("12", "sent 7", "<A>")], "name string, line string, plan string")
    rows = df.select(scalar.segment_number(F.col("name")), scalar.transferred(F.col("line"), "sent"), scalar.placeholders(F.col("plan"))).collect()
    assert [tuple(r) for r in rows] == [(12, 1234, ["a", "b"]), (None, None, []), (None, 7, [])]
