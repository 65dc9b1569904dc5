"""Retrieval quality: metrics of batch search, and the filters' no-false-negative property."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.cuts import cut
from grainmill.functions import kernels
from grainmill.operators.arrow import each
from grainmill.operators.filters import BLOOM_BITS, BLOOM_K, BLOOM_Q, BLOOM_W
from grainmill.operators.search import Postings, l0_both
from grainmill.sources.chunks import offsets


def trials(chunks: DataFrame, length: int, prime: int = 7919) -> DataFrame:
    """(qid, q, truth_chunk): one slice of each chunk of at least ``length`` bytes, at (id * prime) mod room."""
    n = F.octet_length("data")
    at = F.pmod(F.col("chunk_id") * prime, (n - length + 1).cast("long"))
    return chunks.where(n >= length).select(F.col("chunk_id").alias("qid"), F.substring("data", (at + 1).cast("int"), F.lit(length)).alias("q"), F.col("chunk_id").alias("truth_chunk"))


def raw_trials(chunks: DataFrame, lengths: tuple[int, ...], n: int, prime: int = 7919) -> DataFrame:
    """(qid, q, length, low, high): n slices of each length of the whole corpus, which may span chunks, and
    the first and last chunk that they touch. Slice i begins at (i * prime^2) mod room; qid = length * n + i.

    The slices are few; each meets only the chunks that it touches, whose bytes are cut before they are joined.
    """
    spark = chunks.sparkSession
    placed = offsets(chunks).where("size > 0")
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    asked = [(length * n + i, length, i * prime * prime % (total - length + 1)) for length in lengths if length <= total for i in range(n)]
    asked = spark.createDataFrame(asked, "qid long, length int, start long")
    met = placed.join(F.broadcast(asked), (F.col("start") < F.col("offset") + F.col("size")) & (F.col("start") + F.col("length") > F.col("offset")))
    low = F.greatest(F.col("start") - F.col("offset"), F.lit(0))
    high = F.least(F.col("start") + F.col("length") - F.col("offset"), F.col("size"))
    pieces = met.join(chunks, "chunk_id").select("qid", "length", "chunk_id", F.hex(F.substring("data", (low + 1).cast("int"), (high - low).cast("int"))).alias("piece"))
    made = pieces.groupBy("qid", "length").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "piece"))).alias("p"), F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high"))
    return made.select("qid", F.unhex(F.array_join("p.piece", "")).alias("q"), "length", "low", "high")


def retrieval_quality(queries: DataFrame, post: Postings, n_chunks: int, by: tuple[str, ...] = (), **how) -> DataFrame:
    """One row (for each value of ``by``) for queries (qid, q, truth_chunk or low and high): trials, hit_rate,
    effective_pct, fallback, miss, recall, recall_fail, avg_cand, med_cand. A query is found if any chunk
    from low to high is a candidate. Averages count effective queries only and are null without any."""
    if "truth_chunk" in queries.columns:
        queries = queries.withColumns({"low": F.col("truth_chunk"), "high": F.col("truth_chunk")})
    queries = cut(queries, "queries")
    rows, near = l0_both(queries.select("qid", "q"), post, n_chunks, **how)
    found = near.join(queries.select("qid", F.col("low").alias("first"), F.col("high").alias("last")), "qid").where("high >= first and low <= last").select("qid").distinct().withColumn("hit", F.lit(True))
    rows = rows.join(queries.select("qid", *by), "qid").join(found, "qid", "left").withColumn("hit", F.coalesce("hit", "all"))
    miss, broad = F.col("anchors_found") == 0, F.col("cand_count") * 2 >= n_chunks
    good = ~miss & ~broad
    told = rows.groupBy(*by).agg(
        F.count("*").alias("trials"),
        F.count_if(good).alias("eff"),
        F.count_if(~miss & broad).alias("fallback"),
        F.count_if(miss).alias("miss"),
        F.count_if(good & ~F.col("hit")).alias("recall_fail"),
        F.round(F.avg(F.when(good, F.col("cand_count"))), 1).alias("avg_cand"),
        F.floor(F.percentile(F.when(good, F.col("cand_count")), 0.5)).cast("long").alias("med_cand"),
    )
    n = F.greatest(F.col("trials"), F.lit(1))
    return told.select(*by, "trials", F.round((F.col("eff") + F.col("fallback")) / n, 4).alias("hit_rate"), F.round(100 * F.col("eff") / n, 1).alias("effective_pct"), "fallback", "miss", F.round(1 - F.col("recall_fail") / n, 4).alias("recall"), "recall_fail", "avg_cand", "med_cand")


def bloom_property(chunks: DataFrame, lengths: tuple[int, ...] | None = None, seed: int = 42, q: int = BLOOM_Q, w: int = BLOOM_W, bits: int = BLOOM_BITS, k: int = BLOOM_K) -> DataFrame:
    """length, trials and failures: slices of each length (w + q - 1, 48, 96 and 192 if not given) at a seeded
    place of every chunk that is long enough, and those whose own chunk's filter turns them away (always 0)."""
    lengths = lengths or (w + q - 1, 48, 96, 192)

    def run(batches):
        tried, failed = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for i, data in each(batches):
            on = np.zeros(bits, bool)
            on[kernels.bloom_places(kernels.minimizers(data, q, w, "empty"), bits, k)] = True
            draw = np.random.default_rng([seed, (i or 0) & 0xFFFFFFFF])
            for j, length in enumerate(lengths):
                if len(data) >= length:
                    at = int(draw.integers(len(data) - length + 1))
                    keys = kernels.minimizers(data[at : at + length], q, w, "empty")
                    tried[j] += 1
                    failed[j] += not on[kernels.bloom_places(keys, bits, k)].all(1).any()
        yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), pa.array(tried), pa.array(failed)], ["length", "trials", "failures"])

    told = chunks.select("chunk_id", "data").mapInArrow(run, "length int, trials long, failures long")
    return told.groupBy("length").agg(F.sum("trials").alias("trials"), F.sum("failures").alias("failures"))
