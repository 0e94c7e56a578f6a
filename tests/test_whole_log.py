"""Operators over whole logs, where parts of them meet."""

from blockdb.plans import registry, views


def put(monkeypatch, name, frame):
    monkeypatch.setitem(views.VIEWS, name, (lambda spark, sf_dir: frame, "", []))


def rows(spark, name):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, "").collect())


def test_address_pack(spark, monkeypatch):
    put(monkeypatch, "chunk_log", spark.createDataFrame([("a", 1, 65535, 64), ("b", 1, 65536, 64), ("c", 1, 1_000_001, 64), ("c", 2, 0, 64), ("d", 64, 131_073, 9)], "hash string, segment long, ordinal long, len long"))
    want = [("a", 1, 65535), ("b", 65, 0), ("c", 1 + 64 * 15, 1_000_001 % 65536), ("d", 64 + 128, 1)]
    assert rows(spark, "address_pack") == [(h, (s << 16) + o, s, o) for h, s, o in want]


def test_fence_boundary(spark, monkeypatch):
    put(monkeypatch, "wal", spark.createDataFrame([(5, 1), (9, 2), (300, 3), (9000, 4)], "event_id long, seq long"))
    put(monkeypatch, "flushes", spark.createDataFrame([(1,), (7,), (256,), (4097,), (8999,), (20000,)], "event_id long"))
    found = {r.fence: r.through for r in registry.QUERIES["fence_boundary"](spark, "").collect()}
    assert found == {1: None, 7: 1, 256: 2, 4097: 3, 8999: 3, 20000: 4}


def test_breaks_at_cuts(spark, monkeypatch):
    seqs = [s for s in range(1, 5000) if s not in (63, 64, 4096)]
    put(monkeypatch, "batches", spark.createDataFrame([(0, s, (s - 1) // 63) for s in seqs], "image int, seq long, batch long"))
    kept = [s for s in seqs if s % 997]
    assert rows(spark, "sequence_gaps") == [(0, b, a) for a, b in zip(kept, kept[1:]) if b != a + 1]
    put(monkeypatch, "batches", spark.createDataFrame([(b, b + 1) for b in range(2550, 2570)], "batch long, seq long"))
    assert [r[0] for r in rows(spark, "wal_continuity") if not r[4]] == [2560]
    put(monkeypatch, "segments", spark.createDataFrame([(4095, 10, 20, 5), (4096, 21, 30, 4)], "segment long, preceding long, last long, epoch long"))
    assert rows(spark, "segment_chain")[1] == (4096, 21, 30, 20, False, False)


def test_manifest_apply(spark, monkeypatch):
    log = spark.createDataFrame([(0, 1, "WRITE", 0, 4, 10), (0, 1501, "WRITE", 2, 4, 20), (0, 9000, "ZERO", 0, 1, 30)], "image int, seq long, kind string, start long, blocks long, payload long")
    put(monkeypatch, "wal", log)
    put(monkeypatch, "edits", log.selectExpr("image", "seq", "start", "start + blocks as stop", "case when kind = 'WRITE' then payload end as payload", "1 + (seq - 1) div 500 as generation"))
    assert rows(spark, "manifest_apply") == [(0, 1, 2, 10), (0, 2, 6, 20)]
