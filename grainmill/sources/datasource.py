"""Containers and archives as Spark data sources: spark.read.format("corpus_container").load(path)."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from grainmill.sources import formats

SCHEMA = "chunk_id long, data binary"
#: About this many bytes of corpus a partition.
PART_BYTES = 32 << 20


@dataclass
class Part(InputPartition):
    entries: tuple


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"


class ContainerReader(_Reader):
    """Chunks have one size, so partitions are ranges of chunk ids; nothing but the header is read to plan."""

    def partitions(self):
        size, step = formats.container_header(self.path)
        n, each = -(-size // step) if step else 0, max(1, PART_BYTES // max(1, step))
        return [Part((i, min(n, i + each))) for i in range(0, n, each)] or [Part((0, 0))]

    def read(self, partition):
        yield from formats.container_chunks(self.path, *partition.entries)


class ArchiveReader(_Reader):
    """The driver walks the size fields; executors inflate."""

    def partitions(self):
        parts, held, size = [], [], 0
        for i, (at, packed) in enumerate(formats.archive_entries(self.path)):
            held.append((i, at, packed))
            size += packed
            if size > PART_BYTES // 4:
                parts.append(Part(tuple(held)))
                held, size = [], 0
        return [*parts, Part(tuple(held))] if held or not parts else parts

    def read(self, partition):
        yield from formats.inflate(self.path, partition.entries, self.permissive)


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class ContainerWriter(DataSourceWriter):
    """Each task writes its chunks beside the target; the commit puts them end to end in chunk order.

    Chunks must be all of one size but the last, as sources.chunks.chunks_fixed makes them.
    """

    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.chunk_size = int(options.get("chunksize", formats.CONTAINER_CHUNK))

    def write(self, rows):
        import pickle
        import uuid

        held = sorted((r[0], bytes(r[1])) for r in rows)
        if not held:
            return Written(None)
        name = f"{self.path}.part-{held[0][0]:020d}-{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(name) or ".", exist_ok=True)
        with open(name, "wb") as f:
            pickle.dump([(i, len(d)) for i, d in held], f)
            for _, d in held:
                f.write(d)
        return Written(name)

    def commit(self, messages):
        import pickle
        import struct

        places = []
        for m in messages:
            if m and m.path:
                with open(m.path, "rb") as f:
                    sizes = pickle.load(f)
                    at = f.tell()
                for i, n in sizes:
                    places.append((i, m.path, at, n))
                    at += n
        places.sort()
        if any(n != self.chunk_size for _, _, _, n in places[:-1]) or any(n > self.chunk_size for *_, n in places[-1:]):
            self.abort(messages)
            raise ValueError(f"all chunks but the last must have {self.chunk_size} bytes")
        with open(self.path + ".tmp", "wb") as out:
            out.write(formats.CONTAINER_MAGIC + struct.pack("<QQ", sum(p[3] for p in places), self.chunk_size))
            for _, path, at, n in places:
                with open(path, "rb") as f:
                    f.seek(at)
                    out.write(f.read(n))
        os.replace(self.path + ".tmp", self.path)
        self.abort(messages)

    def abort(self, messages):
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


class ContainerSource(DataSource):
    @classmethod
    def name(cls):
        return "corpus_container"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ContainerReader(self.options)

    def writer(self, schema, overwrite):
        return ContainerWriter(self.options)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls):
        return "corpus_archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)
    spark.dataSource.register(ArchiveSource)
