"""What the operators of this package share: word pattern, shared folder, durable cuts, components."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.cuts import cut, discard, discard_at_end, shared_path
from grainmill.session import ready

__all__ = ["cut", "discard", "discard_at_end", "shared_path"]

#: A word is a run of anything but space and the five control blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def sweeping(spark: SparkSession):
    """Shuffle files go with the query that made them, not when the driver next collects garbage."""
    before = spark.conf.get(_SWEEP, "false")
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SWEEP, before)


def swept(df: DataFrame, what: str = "cut") -> DataFrame:
    """cut(); what its query shuffled is deleted as soon as the rows are written."""
    with sweeping(df.sparkSession):
        return cut(df, what)


MARK_BITS = 23


def marks(keys: DataFrame, key: Column) -> DataFrame:
    """A bitmap of fixed size (1 MB) of the keys' hashes, as rows (word, bits). It only spares work."""
    spot = F.pmod(F.xxhash64(key), F.lit(1 << MARK_BITS))
    words = keys.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("word"))
    return cut(words.agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("bits")), "marks")


def marked(rows: DataFrame, bitmap: DataFrame, key: Column) -> DataFrame:
    """The rows whose key may be among the marked ones; most others go before anything is shuffled."""
    names = rows.columns
    rows = rows.withColumn("spot_", F.pmod(F.xxhash64(key), F.lit(1 << MARK_BITS)))
    rows = rows.join(F.broadcast(bitmap), F.shiftright("spot_", 6) == F.col("word"))
    return rows.where(F.expr("shiftright(bits, cast(spot_ & 63 as int)) & 1 = 1")).select(*names)


def told_by(rows: DataFrame, bitmap: DataFrame, key: Column, name: str) -> DataFrame:
    """The rows with a column ``name``: false only where their key is not among the marked ones."""
    names = rows.columns
    rows = rows.withColumn("spot_", F.pmod(F.xxhash64(key), F.lit(1 << MARK_BITS)))
    rows = rows.join(F.broadcast(bitmap.toDF("word_", "bits_")), F.shiftright("spot_", 6) == F.col("word_"), "left")
    return rows.select(*names, F.coalesce(F.expr("shiftright(bits_, cast(spot_ & 63 as int)) & 1 = 1"), F.lit(False)).alias(name))


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def n_words(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def components(nodes_with_links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the links (a, b), as (node, component = smallest node id).

    Alternates large-star and small-star until nothing changes; each round is a shuffle over the
    links, and no vertex's neighbours meet in one task other than as an aggregate (min) or a
    skew-splittable join. Rounds are cut, and a round's files go when the next one is written. Nulls,
    loops and repeated links are ignored; no links, no rows.
    """
    edges = nodes_with_links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = edges.where("u is not null and v is not null and u <> v")
    edges = swept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, state = None, (-1 if edges.isEmpty() else 0, 0)
    while state != before and state[0] >= 0:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours move to the smallest of the neighbourhood
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours and the vertex itself move to the smallest
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, swept(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        discard(last)
        before, state = state, tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).select("node", "component")


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])
