"""Corpora as DataFrames of chunks (chunk_id BIGINT, data BINARY)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def chunks_from_documents(docs: DataFrame) -> DataFrame:
    """One chunk per document; a null text is an empty chunk."""
    return docs.select(F.col("doc_id").alias("chunk_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def chunks_from_files(spark: SparkSession, path: str) -> DataFrame:
    """One chunk per file, numbered in path order."""
    files = spark.read.format("binaryFile").load(path)
    number = F.row_number().over(Window.orderBy("path")) - 1
    ids = files.select("path").withColumn("chunk_id", number.cast("long"))
    return files.join(ids, "path").select("chunk_id", F.col("content").alias("data"))


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def offsets(chunks: DataFrame, slices: int = 200) -> DataFrame:
    """chunk_id, size and the byte offset of each chunk in chunk order.

    Offsets are running sums within ranges of chunk ids plus the ranges' own running sums, so that no
    task sees all chunks.
    """
    sizes = chunks.select("chunk_id", F.octet_length("data").cast("long").alias("size"))
    span = sizes.agg(F.min("chunk_id").alias("lo"), F.max("chunk_id").alias("hi")).first()
    if span["lo"] is None:
        return sizes.withColumn("offset", F.lit(0).cast("long"))
    step = max(1, math.ceil((span["hi"] - span["lo"] + 1) / slices))
    sizes = sizes.withColumn("part", F.floor((F.col("chunk_id") - span["lo"]) / step))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.groupBy("part").agg(F.sum("size").alias("s")).select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("part").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(starts, "part").select("chunk_id", "size", (F.col("inner") + F.col("start")).alias("offset"))


def numbers(rows: DataFrame, slices: int = 200) -> DataFrame:
    """The rows with ``pos``, their number from 0 in chunk order, by ranges of chunk ids as in offsets()."""
    span = rows.agg(F.min("chunk_id").alias("lo"), F.max("chunk_id").alias("hi")).first()
    if span["lo"] is None:
        return rows.withColumn("pos", F.lit(0).cast("long"))
    step = max(1, math.ceil((span["hi"] - span["lo"] + 1) / slices))
    rows = rows.withColumn("part", F.floor((F.col("chunk_id") - span["lo"]) / step))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.count("*").alias("s")).select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy("chunk_id")) - 1
    return rows.withColumn("inner", inner).join(starts, "part").withColumn("pos", F.col("inner") + F.col("start")).drop("part", "inner", "start")


def chunks_fixed(chunks: DataFrame, size: int) -> DataFrame:
    """The same bytes, end to end in chunk order, cut anew into chunks of ``size`` (the last may be short).

    Each chunk is cut where a new border falls into it, and pieces are joined by new chunk: rows
    move once, and no task holds more than a new chunk's pieces.
    """
    placed = chunks.join(offsets(chunks).where("size > 0"), "chunk_id")
    first, last = F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.col("size") - 1) / size)
    pieces = placed.withColumn("new", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("new") * size - F.col("offset"), F.lit(0))
    end = F.least((F.col("new") + 1) * size - F.col("offset"), F.col("size"))
    piece = F.substring("data", (start + 1).cast("int"), (end - start).cast("int"))
    pieces = pieces.select(F.col("new").alias("chunk_id"), (F.col("offset") + start).alias("at"), piece.alias("piece"))
    joined = pieces.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    data = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["piece"])), ""))
    return joined.select("chunk_id", data.alias("data"))
