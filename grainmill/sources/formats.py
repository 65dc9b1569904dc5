"""The binary formats: container, chunk archive, two-layer index, and the filters' files.

Headers and codecs work on single files; what is large goes through the data sources beside this
module. All numbers are little-endian.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import time
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import kernels

# Fixed values of the formats.
CONTAINER_MAGIC = b"STRIDE01"
ARCHIVE_MAGIC = b"GLYPH1"
INDEX_MAGIC = b"L0V2"
HOTSPOT_MAGIC = b"HOTS"
BLOOM_MAGIC = b"GLFP"
SKETCH_MAGIC = b"GLHS"
CONTAINER_HEADER, INDEX_HEADER, HOTSPOT_HEADER, BLOOM_HEADER, SKETCH_HEADER = 24, 64, 32, 32, 16
CONTAINER_CHUNK, ARCHIVE_CHUNK = 65536, 16384
MOST_CHUNKS = 65535


def _replace(path: str, parts: Iterable[bytes]) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".tmp", "wb") as f:
        for p in parts:
            f.write(p)
    os.replace(path + ".tmp", path)


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _blocks(path: str, size: int) -> Iterator[bytes]:
    with open(path, "rb") as f:
        while block := f.read(size):
            yield block


# ---- container -------------------------------------------------------------------------------


def write_container(source: str, target: str, chunk_size: int = CONTAINER_CHUNK) -> dict:
    size = os.path.getsize(source)
    _replace(target, (x for xs in ([CONTAINER_MAGIC + struct.pack("<QQ", size, chunk_size)], _blocks(source, 1 << 20)) for x in xs))
    return {"input": source, "output": target, "corpus_size": size, "chunk_size": chunk_size, "chunks": -(-size // chunk_size)}


def container_header(path: str) -> tuple[int, int]:
    """Corpus size and chunk size."""
    with open(path, "rb") as f:
        head = f.read(CONTAINER_HEADER)
    if head[:8] != CONTAINER_MAGIC or len(head) < CONTAINER_HEADER:
        raise ValueError(f"not a container: {path}")
    return struct.unpack("<QQ", head[8:])


def container_chunks(path: str, first: int = 0, last: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(chunk_id, data) of chunks first to last - 1; a cut file ends early."""
    size, step = container_header(path)
    n = -(-size // step) if step else 0
    with open(path, "rb") as f:
        f.seek(CONTAINER_HEADER + first * step)
        for i in range(first, n if last is None else min(last, n)):
            data = f.read(min(step, size - i * step))
            if not data:
                return
            yield i, data


# ---- archive ---------------------------------------------------------------------------------


def _archive_parts(chunks: Iterable[bytes], n: int, level: int) -> Iterator[bytes]:
    yield ARCHIVE_MAGIC + struct.pack("<BH", 1, n)
    for data in chunks:
        packed = zlib.compress(data, level)
        yield struct.pack("<I", len(packed)) + packed


def pack_archive(source: str, target: str, chunk_size: int = ARCHIVE_CHUNK, level: int = 6) -> dict:
    size = os.path.getsize(source)
    n = -(-size // chunk_size)
    if n > MOST_CHUNKS:
        raise ValueError(f"an archive has at most {MOST_CHUNKS} chunks")
    _replace(target, _archive_parts(_blocks(source, chunk_size), n, level))
    packed = os.path.getsize(target)
    return {"input": source, "output": target, "chunks": n, "bytes": size, "packed": packed, "ratio": round(size / packed, 3), "sha256": file_sha256(target)}


def write_archive(chunks: DataFrame, target: str, level: int = 6) -> int:
    """Writes (chunk_id, data) as an archive: chunks are deflated on executors and come to the driver
    one partition at a time, in order."""

    def deflate(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.compress(x or b"", level) for x in batch.column(1).to_pylist()], pa.binary())], ["chunk_id", "packed"])

    n = chunks.count()
    if n > MOST_CHUNKS:
        raise ValueError(f"an archive has at most {MOST_CHUNKS} chunks")
    rows = chunks.select("chunk_id", "data").mapInArrow(deflate, "chunk_id long, packed binary").orderBy("chunk_id").toLocalIterator()
    _replace(target, (x for xs in ([ARCHIVE_MAGIC + struct.pack("<BH", 1, n)], (struct.pack("<I", len(r[1])) + bytes(r[1]) for r in rows)) for x in xs))
    return n


def archive_entries(path: str) -> Iterator[tuple[int, int]]:
    """(offset, packed size) of each chunk; raises where the file is cut."""
    end = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(9)
        if head[:6] != ARCHIVE_MAGIC:
            raise ValueError(f"not an archive: {path}")
        if len(head) < 9:
            raise ValueError("short header")
        for i in range(struct.unpack("<H", head[7:])[0]):
            raw = f.read(4)
            if len(raw) < 4:
                raise ValueError(f"cut at chunk {i}")
            size, at = struct.unpack("<I", raw)[0], f.tell()
            if at + size > end:
                raise ValueError(f"cut within chunk {i}")
            yield at, size
            f.seek(at + size)


def inflate(path: str, entries: Iterable[tuple[int, int, int]], permissive: bool = False) -> Iterator[tuple[int, bytes]]:
    """(chunk_id, data) for (chunk_id, offset, packed size); permissive: what cannot be inflated is empty."""
    with open(path, "rb") as f:
        for i, at, size in entries:
            f.seek(at)
            try:
                yield i, zlib.decompress(f.read(size))
            except zlib.error:
                if not permissive:
                    raise
                yield i, b""


def make_offset_index(path: str, out: str | None = None, verify: bool = True) -> dict:
    began = time.perf_counter()
    entries = [(i, at, size) for i, (at, size) in enumerate(archive_entries(path))]
    sizes = [len(d) for _, d in inflate(path, entries)] if verify else [None] * len(entries)
    told = {"path": path, "sha256": file_sha256(path), "magic": ARCHIVE_MAGIC.decode(), "version": 1, "num_chunks": len(entries), "verify_decompress": verify, "chunks": [{"off": at, "csize": size, "usize": u} for (_, at, size), u in zip(entries, sizes)], "build_s": round(time.perf_counter() - began, 6)}
    _replace(out or path + ".idx.json", [json.dumps(told, indent=2).encode()])
    return told


def fetch(chunks: DataFrame, ids: Iterable[int]) -> DataFrame:
    """Random access: the chunks with the given ids; those out of range are no rows."""
    return chunks.where(F.col("chunk_id").isin(sorted(set(ids))))


# ---- index and filter files ------------------------------------------------------------------


def write_index(post: DataFrame, target: str, n_chunks: int, q: int = 8, w: int = 8, df_min: int = 1, df_max: int = 256, block_size: int = 64) -> dict:
    """The two-layer index as one file; keys come in order, a partition at a time."""
    if n_chunks > MOST_CHUNKS:
        raise ValueError(f"an index file has at most {MOST_CHUNKS} chunks")
    mask_bytes = (-(-n_chunks // block_size) + 7) // 8
    count, size = [0, 0], [0, 0]

    def parts() -> Iterator[bytes]:
        yield bytes(INDEX_HEADER)
        for i, (name, column) in enumerate((("B", F.col("chunk_id")), ("C", F.floor(F.col("chunk_id") / block_size)))):
            rows = post.where(F.col("layer") == name).groupBy("crc").agg(F.array_sort(F.collect_set(column)).alias("ids")).orderBy("crc")
            for r in rows.toLocalIterator():
                body = kernels.put_deltas(r["ids"]) if name == "B" else kernels.blocks_to_mask(r["ids"], mask_bytes)
                count[i] += 1
                size[i] += 8 + len(body)
                yield struct.pack("<Q", kernels.key64(r["crc"])) + body

    _replace(target, parts())
    head = struct.pack("<4sHBHHBIIIIBB", INDEX_MAGIC, n_chunks, q, df_min, df_max, block_size, *count, *size, mask_bytes, w)
    with open(target, "r+b") as f:
        f.write(head)
    return {"num_chunks": n_chunks, "b_count": count[0], "c_count": count[1], "b_bytes": size[0], "c_bytes": size[1]}


def read_index(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """The header, postings (crc, chunk_id) of layer B and blocks (crc, block_id) of layer C."""
    with open(path, "rb") as f:
        data = f.read()
    names = ("num_chunks", "q", "df_min", "df_max", "block_size", "b_count", "c_count", "b_bytes", "c_bytes", "mask_bytes", "w")
    magic, *values = struct.unpack_from("<4sHBHHBIIIIBB", data)
    if magic != INDEX_MAGIC:
        raise ValueError(f"not an index: {path}")
    head = dict(zip(names, values))
    b, c, at = [], [], INDEX_HEADER
    for _ in range(head["b_count"]):
        key = struct.unpack_from("<Q", data, at)[0] >> 32
        ids, at = kernels.get_deltas(data, at + 8)
        b += [(key, i) for i in ids]
    for _ in range(head["c_count"]):
        key = struct.unpack_from("<Q", data, at)[0] >> 32
        at += 8 + head["mask_bytes"]
        c += [(key, i) for i in kernels.mask_to_blocks(data[at - head["mask_bytes"] : at])]
    return head, spark.createDataFrame(b, "crc long, chunk_id long"), spark.createDataFrame(c, "crc long, block_id long")


def write_hotspots(post: DataFrame, target: str, n_chunks: int, q: int = 8, w: int = 40, max_df: int = 4096) -> dict:
    """Bounded postings as parallel arrays of keys, frequencies, byte offsets and postings."""
    rows = post.groupBy("crc").agg(F.array_sort(F.collect_set("chunk_id")).alias("ids")).orderBy("crc")
    keys, dfs, offs, posts, at = [], [], [], [], 0
    for r in rows.toLocalIterator():
        keys.append(struct.pack("<Q", kernels.key64(r["crc"])))
        dfs.append(struct.pack("<H", len(r["ids"])))
        offs.append(struct.pack("<I", at))
        posts.append(struct.pack(f"<{len(r['ids'])}H", *r["ids"]))
        at += 2 * len(r["ids"])
    head = struct.pack("<4sBIBBHH", HOTSPOT_MAGIC, 1, len(keys), q, w, n_chunks, min(max_df, 65535)).ljust(HOTSPOT_HEADER, b"\0")
    _replace(target, [head, *keys, *dfs, *offs, *posts])
    return {"keys": len(keys), "postings": at // 2}


def read_hotspots(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    with open(path, "rb") as f:
        data = f.read()
    magic, version, n, q, w, chunks, max_df = struct.unpack_from("<4sBIBBHH", data)
    if magic != HOTSPOT_MAGIC:
        raise ValueError(f"not a hotspot index: {path}")
    at = HOTSPOT_HEADER
    keys = struct.unpack_from(f"<{n}Q", data, at)
    dfs = struct.unpack_from(f"<{n}H", data, at + 8 * n)
    offs = struct.unpack_from(f"<{n}I", data, at + 10 * n)
    base = at + 14 * n
    rows = [(k >> 32, i, d) for k, d, o in zip(keys, dfs, offs) for i in struct.unpack_from(f"<{d}H", data, base + o)]
    return {"version": version, "q": q, "w": w, "num_chunks": chunks, "max_df": max_df}, spark.createDataFrame(rows, "crc long, chunk_id long, df long")


def write_bitmaps(rows: DataFrame, target: str, kind: str, q: int = 8, w: int = 40, bits: int = 16384, k: int = 11) -> int:
    """(chunk_id, bitmap) in chunk order; kind 'bloom' or 'sketch'."""
    n = rows.count()
    if n > MOST_CHUNKS:
        raise ValueError(f"a filter file has at most {MOST_CHUNKS} chunks")
    if kind == "bloom":
        head = struct.pack("<4sBHBBIB", BLOOM_MAGIC, 1, n, q, w, bits, k).ljust(BLOOM_HEADER, b"\0")
    else:
        head = struct.pack("<4sBHBBI", SKETCH_MAGIC, 7, n, q, 1, bits).ljust(SKETCH_HEADER, b"\0")
    column = rows.columns[1]
    _replace(target, (x for xs in ([head], (bytes(r[0]) for r in rows.orderBy("chunk_id").select(column).toLocalIterator())) for x in xs))
    return n


def read_bitmaps(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The header and (chunk_id, bitmap); sizes must agree, a sketch's bits must be a power of two."""
    with open(path, "rb") as f:
        data = f.read()
    if data[:4] == BLOOM_MAGIC:
        version, n, q, w, bits, k = struct.unpack_from("<BHBBIB", data, 4)
        head, at = {"kind": "bloom", "version": version, "q": q, "w": w, "bits": bits, "k": k}, BLOOM_HEADER
    elif data[:4] == SKETCH_MAGIC:
        version, n, q, k, bits = struct.unpack_from("<BHBBI", data, 4)
        head, at = {"kind": "sketch", "version": version, "q": q, "bits": bits, "k": k}, SKETCH_HEADER
        if bits & bits - 1:
            raise ValueError("the number of bits is no power of two")
    else:
        raise ValueError(f"not a filter file: {path}")
    step = bits // 8
    if len(data) < at + n * step:
        raise ValueError("the file is cut")
    return head, spark.createDataFrame([(i, data[at + i * step : at + (i + 1) * step]) for i in range(n)], "chunk_id long, bitmap binary")
