"""Raw disk images as a Spark data source, read in ranges so that one large image is many tasks.

    spark.dataSource.register(ImageSource)
    spark.read.format("blocks").option("paths", json.dumps([...])).option("size", 4096).load()

Rows: image (the path's number in `paths`), pos, hash (SHA-256; null for zeros), len. A short tail keeps its length. Paths may be local or any URI that
pyarrow's filesystems open. An image whose length changes between planning and reading is an error.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SIZES = (4096, 16384)
RANGE = 64 << 20
BATCH = 4096


def _open(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(at)
    if info.type != fs.FileType.File:
        raise ValueError(f"not a regular file: {path}")
    return system, at, info.size


@dataclass
class Range(InputPartition):
    image: int
    path: str
    start: int
    stop: int
    length: int


class ImageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.size = json.loads(options.get("paths", "[]")), int(options.get("size", 4096))
        if self.size not in SIZES or not self.paths:
            raise ValueError("a census needs images, and chunks of 4096 or 16384 bytes")

    def partitions(self) -> list[InputPartition]:
        out = []
        for i, path in enumerate(self.paths):
            length = _open(path)[2]
            out += [Range(i, path, a, min(length, a + RANGE), length) for a in range(0, length, RANGE)]
        return out or [Range(0, self.paths[0], 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, at, length = _open(partition.path)
        if length != partition.length:
            raise OSError(f"image changed while scanning: {partition.path}")
        with system.open_input_file(at) as file:
            file.seek(partition.start)
            for a in range(partition.start, partition.stop, BATCH * self.size):
                data = file.read(min(BATCH * self.size, partition.stop - a))
                parts = [data[i : i + self.size] for i in range(0, len(data), self.size)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([partition.image] * len(parts), pa.int32()), pa.array(range(a // self.size, a // self.size + len(parts)), pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() if p.strip(b"\0") else None for p in parts], pa.string()), pa.array([len(p) for p in parts], pa.int64()),
                    ],
                    ["image", "pos", "hash", "len"],
                )


class ImageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        return "image int, pos long, hash string, len long"

    def reader(self, schema) -> DataSourceReader:
        return ImageReader(self.options)
