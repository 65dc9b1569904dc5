"""Chunk columns of Arrow batches as numpy arrays, and the gram operators built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions import kernels


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value starts and ends; no copy."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def each(batches) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            data, ends = buffers(batch.column(1))
            for i, chunk_id in enumerate(batch.column(0).to_pylist()):
                yield chunk_id, data[ends[i] : ends[i + 1]]


def small(run, rows: int = 256):
    """``run`` over batches of at most so many rows."""
    return lambda batches: run(batch.slice(i, rows) for batch in batches for i in range(0, batch.num_rows, rows))


def rows_of(found, kind: pa.DataType, names: tuple[str, ...], at_once: int = 500_000) -> Iterator[pa.RecordBatch]:
    """(id, array) pairs as batches of rows (id, value)."""

    def out():
        ids = np.repeat(np.array([i for i, _ in held], np.int64), [len(v) for _, v in held])
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([v for _, v in held]), kind)], list(names))

    held, size = [], 0
    for i, values in found:
        held.append((i, values))
        size += len(values)
        if size >= at_once:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def minimizers_of(batches, q: int, w: int, short: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and distinct minimizer keys of the chunks of Arrow batches, some ten thousand rows at a time."""
    for batch in batches:
        if batch.num_rows:
            data, ends = buffers(batch.column(1))
            ids = batch.column(0).cast(pa.int64())
            for rows, crcs in kernels.minimizers_many(data, ends, q, w, short):
                yield ids.take(pa.array(rows)), crcs


#: Bits of the bitmap of keys that minimizers() can be held to: 4 MB.
AMONG_BITS = 25


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """The keys' lowest AMONG_BITS bits as a bitmap, whose size does not depend on the number of keys."""
    low = F.col("crc").bitwiseAND(F.lit((1 << AMONG_BITS) - 1))
    parts = keys.select(low.alias("k")).groupBy(F.shiftright("k", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("k").bitwiseAND(F.lit(32767))).alias("m"))
    out = np.zeros(1 << AMONG_BITS - 3, np.uint8)
    for r in parts.collect():
        out[r["b"] * 4096 : r["b"] * 4096 + 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def among(bitmap: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """Whether the keys' bits are set in a bitmap of bitmap_of()."""
    low = crcs & (1 << AMONG_BITS) - 1
    return (bitmap[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)


def minimizers(chunks: DataFrame, q: int = 8, w: int = 8, short: str = "self", id_: str = "chunk_id", within: np.ndarray | None = None) -> DataFrame:
    """(chunk_id, crc): the distinct minimizer keys of each chunk. The data leaves at the scan; with ``within``
    (from bitmap_of) also keys that are not in the bitmap, and a few that were not put in stay."""

    def run(batches):
        for ids, crcs in minimizers_of(batches, q, w, short):
            if within is not None:
                keep = np.flatnonzero(among(within, crcs))
                ids, crcs = ids.take(pa.array(keep)), crcs[keep]
            yield pa.RecordBatch.from_arrays([ids, pa.array(crcs)], [id_, "crc"])

    return chunks.select(chunks.columns[0], chunks.columns[1]).mapInArrow(run, f"{id_} long, crc long")


def grams(chunks: DataFrame, q: int = 8, id_: str = "chunk_id") -> DataFrame:
    """(chunk_id, crc): the keys of all q-grams, each position a row."""

    def run(batches):
        yield from rows_of(((i, kernels.gram_crcs(d, q).astype(np.int64)) for i, d in each(batches)), pa.int64(), (id_, "crc"))

    return chunks.select(chunks.columns[0], chunks.columns[1]).mapInArrow(run, f"{id_} long, crc long")
