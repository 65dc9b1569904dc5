"""The two-layer inverted index over minimizer keys, as relations.

postings(crc, chunk_id, df, layer): layer B keeps chunk ids, layer C is queried by blocks of chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.cuts import cut, width
from grainmill.functions import kernels
from grainmill.functions.columns import layer
from grainmill.operators.arrow import among, bitmap_of, minimizers, minimizers_of


@dataclass(frozen=True)
class Policy:
    """What becomes of a key by its document frequency; ``key_cap`` keeps the rarest B keys only."""

    q: int = 8
    w: int = 8
    df_min: int = 1
    df_max: int = 256
    df_top: int | None = None
    block_size: int = 64
    key_cap: int | None = None
    short: str = "self"


STANDARD = Policy()
LEGACY = Policy(df_top=4096, key_cap=5_000_000)


def key_df(chunks: DataFrame, q: int = 8, w: int = 8, short: str = "self") -> DataFrame:
    """(crc, df) of every key, whatever its df; only partial counts are shuffled."""
    return minimizers(chunks, q, w, short).groupBy("crc").agg(F.count("*").alias("df"))


def key_layers(df: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """(crc, df, layer) of every key of (crc, df) that the policy keeps."""
    df = df.where(F.col("df") >= policy.df_min).withColumn("layer", layer(F.col("df"), policy.df_max, policy.df_top)).where("layer is not null")
    if policy.key_cap is None:
        return df
    low = df.where("layer = 'B'").orderBy("df", "crc").limit(policy.key_cap)
    return low.unionByName(df.where("layer = 'C'"))


def postings(chunks: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """(crc, chunk_id, df, layer) of every key that the policy keeps.

    df is counted with a partial aggregate and joined back, so that a key that is in every chunk is
    never gathered in one task.
    """
    keys = minimizers(chunks, policy.q, policy.w, policy.short)
    df = key_layers(key_df(chunks, policy.q, policy.w, policy.short), policy)
    return keys.join(df, "crc").select("crc", "chunk_id", "df", "layer")


class Lookup:
    """The postings of some keys, made from the chunks when they are asked for. Other keys stay where they are
    read, but for those that share a bit with one that is asked for."""

    def __init__(self, chunks: DataFrame, q: int, w: int, short: str, kept: Callable[[DataFrame], DataFrame]):
        self.chunks, self.how, self.kept, self.told = chunks, (q, w, short), kept, None

    def knowing(self, asked: DataFrame) -> Lookup:
        """The same for these keys only, whose df are looked up at once."""
        out = Lookup(self.chunks, *self.how, self.kept)
        out.told = self.df(asked)
        return out

    def df(self, asked: DataFrame) -> DataFrame:
        """(crc, df) and what else the policy tells of those of the keys (crc) that it keeps."""
        if self.told is not None:
            return self.told.join(asked.select("crc").distinct(), "crc", "left_semi")
        asked = cut(asked.select("crc").distinct(), "asked")
        counts = minimizers(self.chunks, *self.how, within=bitmap_of(asked)).groupBy("crc").agg(F.count("*").alias("df"))
        return cut(self.kept(counts.join(asked, "crc", "left_semi")), "df")

    def rows(self, keys: DataFrame, block_size: int = 1) -> DataFrame:
        """(crc, chunk_id, ...) of keys (crc, ...) from df(). Of layer C, where keys have one, some chunk of each block
        suffices: the block's first stands for the chunks that are read together."""
        keys = cut(keys, "wanted")
        block = keys.where("layer = 'C'") if "layer" in keys.columns and block_size > 1 else keys.limit(0)
        each, blocks = (bitmap_of(x) for x in (keys.join(block.select("crc"), "crc", "left_anti"), block))
        chunks, (q, w, short) = self.chunks, self.how
        if keys.isEmpty():  # not worth a scan
            chunks = chunks.limit(0)

        def run(batches):
            for ids, crcs in minimizers_of(batches, q, w, short):
                one, ids = among(each, crcs), ids.to_numpy()
                many, one = np.flatnonzero(~one & among(blocks, crcs)), np.flatnonzero(one)
                # a number for each run of chunks of one block
                block = ids[many] // block_size
                run = np.cumsum(np.diff(block, prepend=block[:1]) != 0)
                key = kernels.distinct(crcs[many] << 31 | run)
                first = block[np.searchsorted(run, key & (1 << 31) - 1)] * block_size
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([crcs[one], key >> 31])), pa.array(np.concatenate([ids[one], first]))], ["crc", "chunk_id"])

        met = chunks.select(chunks.columns[0], chunks.columns[1]).mapInArrow(run, "crc long, chunk_id long")
        return met.join(keys, "crc").select("crc", "chunk_id", *keys.columns[1:])


def lookup(chunks: DataFrame, policy: Policy = STANDARD) -> Lookup:
    """Lookup of postings()."""
    if policy.key_cap is not None:
        raise ValueError("which keys a capped policy keeps is not known from some keys alone")
    return Lookup(chunks, policy.q, policy.w, policy.short, lambda df: key_layers(df, policy))


def bounded_postings(chunks: DataFrame, q: int = 8, w: int = 40, max_df: int = 4096) -> DataFrame:
    """(crc, chunk_id, df) of keys that are in at most max_df chunks (65535 at most)."""
    keys = minimizers(chunks, q, w, "empty")
    df = key_df(chunks, q, w, "empty").where(F.col("df") <= min(max_df, 65535))
    return keys.join(df, "crc").select("crc", "chunk_id", "df")


def bounded_lookup(chunks: DataFrame, q: int = 8, w: int = 40, max_df: int = 4096) -> Lookup:
    """Lookup of bounded_postings()."""
    return Lookup(chunks, q, w, "empty", lambda df: df.where(F.col("df") <= min(max_df, 65535)))


def block_masks(post: DataFrame, block_size: int = 64) -> DataFrame:
    """(crc, block_id) of layer C."""
    return post.where("layer = 'C'").select("crc", F.floor(F.col("chunk_id") / block_size).cast("long").alias("block_id")).distinct()


def masks_of(chunks: DataFrame, policy: Policy) -> DataFrame:
    """block_masks() of postings(), of which only layer C's keys leave the scan, once for the chunks of a block read together."""
    found = lookup(chunks, policy)
    keys = found.kept(key_df(chunks, policy.q, policy.w, policy.short)).where("layer = 'C'")
    return block_masks(found.rows(keys, policy.block_size), policy.block_size)


def mask_chunks(masks: DataFrame, block_size: int, n_chunks: int) -> DataFrame:
    """(crc, chunk_id) of all chunks of the blocks; the last block ends with the corpus.

    The masks are dealt out by blocks, four neighbours together, and sorted by block and key, so that the rows, of which there are
    block_size times as many, are written in few bytes: the same few chunk ids again and again, and equal keys in runs.
    """
    low = F.col("block_id") * block_size
    span = -(-n_chunks // block_size)
    parts = max(1, min(span, max(width(masks.sparkSession), -(-span // 256))))
    masks = masks.where(low < n_chunks).repartition(parts, F.floor(F.col("block_id") / 4)).sortWithinPartitions("block_id", "crc")
    return masks.select("crc", F.explode(F.sequence(low, F.least(low + block_size, F.lit(n_chunks)) - 1)).alias("chunk_id"))


def deltas(post: DataFrame) -> DataFrame:
    """(crc, chunk_id, delta): difference to the list's chunk id before, from 0. B lists have at most df_max rows."""
    w = Window.partitionBy("crc").orderBy("chunk_id")
    return post.where("layer = 'B'").select("crc", "chunk_id", (F.col("chunk_id") - F.lag("chunk_id", 1, 0).over(w)).alias("delta"))


def undelta(rows: DataFrame) -> DataFrame:
    """(crc, chunk_id) from (crc, seq, delta)."""
    w = Window.partitionBy("crc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("crc", F.sum("delta").over(w).alias("chunk_id"))


def rank_pick(values: DataFrame, column: str, **picks) -> DataFrame:
    """One row of exact order statistics: each pick maps n to a rank from 0. Works on value counts,
    so equal values cost one row; null where there are no values."""
    counts = values.groupBy(column).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    upto = F.sum("c").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).crossJoin(F.broadcast(total))
    return ranked.agg(*(F.min(F.when(F.col("upto") > pick(F.col("n")), F.col(column))).alias(name) for name, pick in picks.items()))


MEDIAN = lambda n: F.floor(n / 2)
P95 = lambda n: F.floor((n - 1) * 95 / 100)


def index_stats(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: chunks, bytes, keys and postings of the layers; from key_layers() or postings(). A key has df postings."""
    b, c = F.col("layer") == "B", F.col("layer") == "C"
    told = keys.select("crc", "df", "layer").distinct().agg(
        F.count_if(b).alias("b_keys"), F.count_if(c).alias("c_keys"), F.coalesce(F.sum(F.when(b, F.col("df"))), F.lit(0)).alias("b_postings"), F.coalesce(F.max("df"), F.lit(0)).alias("max_df")
    )
    size = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).cast("long").alias("bytes"))
    return size.crossJoin(told)


def df_stats(post: DataFrame) -> DataFrame:
    """min, max and median (element n div 2) of df over keys, of postings or of key_df(); nulls for an empty index."""
    keys = post.select("crc", "df").distinct()
    return keys.agg(F.min("df").alias("min_df"), F.max("df").alias("max_df")).crossJoin(rank_pick(keys, "df", median_df=MEDIAN))


def minimizer_stats(chunks: DataFrame, q: int = 8, w: int = 40) -> DataFrame:
    """Minimizers a chunk: avg (one place), p50, p95, min, max. A chunk without any counts as 0."""
    counts = minimizers(chunks, q, w, "empty").groupBy("chunk_id").agg(F.count("*").alias("m"))
    every = chunks.select("chunk_id").join(counts, "chunk_id", "left").select(F.coalesce("m", F.lit(0)).alias("m"))
    return every.agg(F.round(F.avg("m"), 1).alias("avg"), F.min("m").alias("min"), F.max("m").alias("max")).crossJoin(rank_pick(every, "m", p50=MEDIAN, p95=P95))
