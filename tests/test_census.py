"""Census fixtures with known results, and the additive identities."""

import json

import pytest

from blockdb.operators import census
from blockdb.sources import files, images

UNIT = 4096


def chunks(spark, *images):
    rows = [(i, p, None if b == 0 else f"{b:064d}", UNIT) for i, image in enumerate(images) for p, b in enumerate(image)]
    return spark.createDataFrame(rows, "image int, pos long, hash string, len long")


def test_classes(spark):
    df = chunks(spark, [1, 2, 0, 1], [1, 1, 3, 3], [3, 4, 0, 0])
    rows = {r.image: r for r in census.census_images(df).collect()}
    one = rows[1]
    assert (one.base_in_place_bytes, one.base_elsewhere_bytes, one.within_image_only_bytes, one.new_unique_bytes) == (UNIT, UNIT, UNIT, UNIT)
    assert rows[2].prior_image_only_bytes == UNIT
    for r in rows.values():
        assert r.logical_bytes == r.zero_bytes + r.nonzero_bytes
        assert r.nonzero_bytes == r.base_in_place_bytes + r.base_elsewhere_bytes + r.prior_image_only_bytes + r.within_image_only_bytes + r.new_unique_bytes
    assert [x // UNIT for x in census.census_totals(df).first()] == [9, 4, 3, 2]


def test_descendants(spark):
    for images in ([[1, 2], [1, 3, 3], [1, 3, 4]], [[1, 2], [1, 3, 4], [1, 3, 3]]):
        d = census.census_descendants(chunks(spark, *images)).first().asDict()
        assert [v // UNIT for v in d.values()] == [4, 3, 1, 1, 0] or d["independently_unique_bytes"] == d["fleet_unique_bytes"] + d["base_duplicate_bytes"] + d["novel_duplicate_bytes"]
    d = census.census_descendants(chunks(spark, *[[1, 2, 3, 4]] * 4)).first()
    assert [v // UNIT for v in d] == [12, 4, 4, 8, 0]


def test_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 5000 + b"\0" * 3192)
    (tmp_path / "b").write_bytes(b"\0" * 4096 + b"abc")
    rows = files.image_chunks(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).orderBy("image", "pos").collect()
    assert [(r.image, r.pos, r.hash is None, r.len) for r in rows] == [(0, 0, False, 4096), (0, 1, False, 4096), (1, 0, True, 4096), (1, 1, False, 3)]


def test_image_source(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"x" * 5000 + b"\0" * 3192 + b"tail")
    (tmp_path / "b").write_bytes(b"")
    spark.dataSource.register(images.ImageSource)
    load = lambda paths, size=4096: spark.read.format("blocks").option("paths", json.dumps(paths)).option("size", size).load()
    rows = load([str(tmp_path / "a"), str(tmp_path / "b")]).orderBy("image", "pos").collect()
    assert [(r.image, r.pos, r.hash is None, r.len) for r in rows] == [(0, 0, False, 4096), (0, 1, False, 4096), (0, 2, False, 4)]
    assert len(load([f"file://{tmp_path}/a"], 16384).collect()) == 1
    for paths, size in (([], 4096), ([str(tmp_path)], 4096), ([str(tmp_path / "none")], 4096), ([str(tmp_path / "a")], 8192)):
        with pytest.raises(Exception):
            load(paths, size).collect()
