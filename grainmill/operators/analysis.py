"""Whole-corpus analyses: byte histogram, entropy, signature, profile, comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.cuts import cut
from grainmill.functions import kernels
from grainmill.functions.columns import hex64
from grainmill.operators.arrow import buffers, each
from grainmill.sources.chunks import numbers


def byte_histogram(chunks: DataFrame) -> DataFrame:
    """byte, count, and the first occurrence (chunk_id, position) of every byte value that occurs.

    Batches are counted where they are read; at most 256 rows a batch are shuffled.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, ends = buffers(batch.column(1))
            counts = np.bincount(data, minlength=256)
            present = np.flatnonzero(counts)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            first: dict[int, tuple[int, int]] = {}
            for i in np.argsort(ids, kind="stable").tolist():
                if len(first) == len(present):
                    break
                values, at = np.unique(data[ends[i] : ends[i + 1]], return_index=True)
                for v, p in zip(values.tolist(), at.tolist()):
                    first.setdefault(v, (int(ids[i]), p))
            yield pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), pa.array(counts[present], pa.int64()), pa.array([first[v][0] for v in present.tolist()], pa.int64()), pa.array([first[v][1] for v in present.tolist()], pa.int64())], ["byte", "n", "chunk_id", "at"])

    parts = chunks.select("chunk_id", "data").mapInArrow(run, "byte int, n long, chunk_id long, at long")
    return parts.groupBy("byte").agg(F.sum("n").alias("count"), F.min(F.struct("chunk_id", "at")).alias("first"))


def byte_frequency(chunks: DataFrame, top: int | None = None) -> DataFrame:
    """byte, count, pct; with ``top`` the most frequent, ties by first occurrence in the corpus."""
    counts = byte_histogram(chunks)
    total = counts.agg(F.sum("count").alias("total"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("pct", F.round(100 * F.col("count") / F.col("total"), 6))
    if top is not None:
        out = out.orderBy(F.desc("count"), "first").limit(top)
    return out.select("byte", "count", "pct")


def chunk_entropy(chunks: DataFrame) -> DataFrame:
    """chunk_id and entropy in bits a byte, to nine places; an empty chunk has 0."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                data, ends = buffers(batch.column(1))
                out = [kernels.entropy(np.bincount(data[ends[i] : ends[i + 1]], minlength=256)) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["chunk_id", "entropy"])

    return chunks.select("chunk_id", "data").mapInArrow(run, "chunk_id long, entropy double")


def entropy_hotspots(chunks: DataFrame, top: int = 20) -> DataFrame:
    """The chunks of highest entropy, ties by chunk id."""
    return chunk_entropy(chunks).orderBy(F.desc("entropy"), "chunk_id").limit(top)


def signature(chunks: DataFrame, k: int = 128, window: int = 32) -> DataFrame:
    """rank (from 0) and hash (16 hex digits) of the k smallest window hashes, repeats kept.

    Each partition keeps its own k smallest, so the sort sees k rows a partition.
    """
    flip = np.uint64(1 << 63)

    def run(batches):
        best = np.zeros(0, np.uint64)
        for _, data in each(batches):
            h = kernels.rolling_hashes(data, window)
            best = np.concatenate([best, h if len(h) <= k else np.partition(h, k - 1)[:k]])
            if len(best) > 16 * k:
                best = np.partition(best, k - 1)[:k]
        yield pa.RecordBatch.from_arrays([pa.array((np.sort(best)[:k] ^ flip).view(np.int64))], ["h"])

    from pyspark.sql import Window

    low = chunks.select("chunk_id", "data").mapInArrow(run, "h long").orderBy("h").limit(k)  # the sign bit is flipped: signed order is unsigned order
    ranked = low.withColumn("rank", F.row_number().over(Window.orderBy("h")) - 1)
    return ranked.select(F.col("rank").cast("int").alias("rank"), hex64(F.col("h").bitwiseXOR(F.lit(-(1 << 63)))).alias("hash"))


def entropy_profile(chunks: DataFrame, size: int = 64) -> DataFrame:
    """slot and value: min-max normalised entropies in chunk order, sampled down to ``size`` or padded with 0.

    Slot i takes element floor(i * n / size); no chunks give no rows.
    """
    e = cut(chunk_entropy(chunks), "entropy")
    told = e.agg(F.count("*").alias("n"), F.min("entropy").alias("lo"), F.max("entropy").alias("hi")).first()
    spark, n = chunks.sparkSession, told["n"]
    slots = spark.range(size if n else 0).select(F.col("id").cast("int").alias("slot"))
    pick = F.floor(F.col("slot").cast("long") * n / size) if n > size else F.col("slot").cast("long")
    numbered = numbers(e)
    width = (told["hi"] or 0.0) - (told["lo"] or 0.0)
    value = (F.col("entropy") - (told["lo"] or 0.0)) / width if width else F.lit(0.0)
    return slots.withColumn("pos", pick).join(numbered, "pos", "left").select("slot", F.coalesce(value, F.lit(0.0)).alias("value"))


def jaccard(a: DataFrame, b: DataFrame, column: str = "hash") -> DataFrame:
    """One row: shared distinct values over all distinct values, 0 where there are none."""
    marked = a.select(column).distinct().withColumn("l", F.lit(1)).join(b.select(column).distinct().withColumn("r", F.lit(1)), column, "full")
    n = F.count("*")
    return marked.agg(F.when(n > 0, F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()) / n).otherwise(0.0).alias("jaccard"))


def l2(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: Euclidean distance of two profiles over their common slots."""
    both = a.select("slot", F.col("value").alias("x")).join(b.select("slot", F.col("value").alias("y")), "slot")
    return both.agg(F.coalesce(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)), F.lit(0.0)).alias("l2"))


def compare(a: DataFrame, b: DataFrame, k: int = 128, window: int = 32, size: int = 64) -> DataFrame:
    """jaccard of signatures, l2 of profiles, similarity = 0.7 jaccard + 0.3 (1 - l2)."""
    j = jaccard(signature(a, k, window), signature(b, k, window))
    d = l2(entropy_profile(a, size), entropy_profile(b, size))
    similarity = 0.7 * F.col("jaccard") + 0.3 * (1 - F.col("l2"))
    return j.crossJoin(d).select(F.round("jaccard", 6).alias("jaccard"), F.round("l2", 6).alias("l2"), F.round(similarity, 6).alias("similarity"))


def container_info(chunks: DataFrame, chunk_size: int | None = None) -> DataFrame:
    size = F.octet_length("data").cast("long")
    return chunks.agg(F.coalesce(F.sum(size), F.lit(0)).alias("corpus_size"), F.coalesce(F.max(size), F.lit(0)).alias("max_chunk"), F.count("*").alias("chunks"))


def chunk_digests(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.octet_length("data").cast("long").alias("size"), F.sha2("data", 256).alias("sha256"))
