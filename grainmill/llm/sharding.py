"""K-d tree partitioning into shards of near equal bytes.

Rows with equal texts form a group and stay together. A group has three dimensions: language and
source (hashed codes; the smallest of its rows) and log size. A node is split along its widest
dimension, as a fraction of the whole range, at the weighted median of bytes (for an odd number of
leaves, at the fitting quantile), until every leaf has the target size. A level of the tree is split at
once: each group carries its node as a column, weights are added up by (node, value of the node's
dimension), a running sum over these sums finds the value that holds the quantile, and the same over a
hash of the texts finds the place within that value, to 2^-16 of its groups. A node has at most 65536
sums, whatever the number of rows; the driver sees none of them. The law is ``bytes``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import cut, text_of

DIMENSIONS = ("d_lang", "d_source", "d_size")
#: Codes of a dimension, and buckets of the hash that splits groups of one value.
VALUES = TIES = 1 << 16
#: A level's splits (a row per open node) are broadcast up to this many leaves, and joined by shuffles beyond.
MOST_BROADCAST = 50_000


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size (bytes and 1), CRC-32, 64-bit hash, codes: narrow, and cut from the texts."""
    raw = F.encode(text_of(), "UTF-8")
    code = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit(""))), F.lit(VALUES)).cast("int")
    return cut(docs.select("doc_id", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("x"), code("lang").alias("d_lang"), code("source").alias("d_source")), "shard")


def _grouped(rows: DataFrame) -> DataFrame:
    groups = rows.groupBy("size", "text_crc32", "x").agg(F.count("*").alias("n"), F.min("d_lang").alias("d_lang"), F.min("d_source").alias("d_source"))
    d_size = F.least(F.lit(VALUES - 1), F.floor(F.log2("size") * 1024)).cast("int")
    return groups.withColumns({"weight": F.col("size") * F.col("n"), "d_size": d_size, "tie": F.pmod("x", F.lit(TIES)).cast("int")})


def _crossing(sums: DataFrame, by: str) -> DataFrame:
    """Of each node's (by, w), the first ``by`` whose running sum passes what is left of the goal, with what lies below."""
    before = F.coalesce(F.sum("w").over(Window.partitionBy("node").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("below", before + F.col("below")).where("below <= goal and below + w > goal")


def _splits(held: DataFrame, spans: tuple[int, ...], small) -> DataFrame:
    """node, leaves, dim, value and tie of every open node: groups below (value, tie) go left."""
    node = ["node", "leaves"]
    each = held.where("leaves > 1")
    told = each.groupBy(*node).agg(F.sum("weight").alias("total"), *((F.max(d) - F.min(d)).alias(f"s{i}") for i, d in enumerate(DIMENSIONS)))
    wide = [F.col(f"s{i}") / max(1, spans[i]) for i in range(len(DIMENSIONS))]
    dim = F.when((wide[0] >= wide[1]) & (wide[0] >= wide[2]), 0).when(wide[1] >= wide[2], 1).otherwise(2)
    goal = F.col("total") * F.floor(F.col("leaves") / 2) / F.col("leaves")
    told = told.select(F.col("node").alias("node_"), dim.alias("dim"), goal.alias("goal"))
    each = each.join(small(told), F.col("node") == F.col("node_")).drop("node_").withColumn("value", _value("dim"))
    by_value = each.groupBy(*node, "dim", "goal", "value").agg(F.sum("weight").alias("w")).withColumn("below", F.lit(0))
    found = _crossing(by_value, "value").select(F.col("node").alias("node_"), F.col("value").alias("value_"), "below")
    # the (node, value) sums are made once more here; they are small, and a cut would cost another job
    inside = each.join(small(found), (F.col("node") == F.col("node_")) & (F.col("value") == F.col("value_")))
    by_tie = inside.groupBy(*node, "dim", "goal", "value", "below", "tie").agg(F.sum("weight").alias("w"))
    nearer = F.col("below") + F.col("w") - F.col("goal") < F.col("goal") - F.col("below")
    return cut(_crossing(by_tie, "tie").select(*node, "dim", "value", (F.col("tie") + nearer.cast("int")).alias("tie")), "splits")


def _value(dim: str):
    return F.when(F.col(dim) == 0, F.col(DIMENSIONS[0])).when(F.col(dim) == 1, F.col(DIMENSIONS[1])).otherwise(F.col(DIMENSIONS[2]))


def place(groups: DataFrame, shards: int, spans: tuple[int, ...]) -> DataFrame:
    """The groups with ``node``, the number of their shard."""
    small = F.broadcast if shards <= MOST_BROADCAST else lambda table: table
    names = [c for c in groups.columns if c != "node"]
    held = groups.withColumn("leaves", F.lit(shards))
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        if level and level % 4 == 0:  # else the plan grows with the depth
            held = cut(held, "level")
        splits = _splits(held, spans, small).toDF("node_", "leaves_", "dim_", "value_", "tie_")
        held = held.join(small(splits), F.col("node") == F.col("node_"), "left")
        half, at = F.floor(F.col("leaves") / 2).cast("int"), _value("dim_")
        left = (at < F.col("value_")) | (at == F.col("value_")) & (F.col("tie") < F.col("tie_"))
        node = F.when(F.col("node_").isNull() | left, F.col("node")).otherwise(F.col("node") + half)
        leaves = F.when(F.col("node_").isNull(), F.col("leaves")).when(left, half).otherwise(F.col("leaves") - half)
        held = held.select(*names, node.alias("node"), leaves.alias("leaves"))
    return held.select(*names, "node")


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, rows_a_slice: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot of every row; give ``shards`` or ``target_bytes``.

    Slots count from 0 without gaps in each shard; they are dealt in hashed slices of about
    ``rows_a_slice`` rows, so no task sees a whole shard. A null text counts as empty (size 1); null
    lang, source or doc_id are values like others; repeated rows get a slot each. Of equal weights at
    a split the lower ones go left. A shard may be empty where there are fewer texts than shards. An
    empty table gives no rows. Further columns are left out.
    """
    rows = keyed(docs)
    groups = cut(_grouped(rows).withColumn("node", F.lit(0)), "groups")
    told = groups.agg(F.sum("weight"), F.sum("n"), *((F.max(d) - F.min(d)) for d in DIMENSIONS)).first()
    if shards is None:
        shards = max(1, math.ceil((told[0] or 0) / target_bytes))
    placed = place(groups, shards, tuple(x or 0 for x in told[2:])).select("size", "text_crc32", "x", F.col("node").alias("shard"))
    slices = max(1, math.ceil((told[1] or 0) / shards / rows_a_slice))
    rows = rows.select("doc_id", "size", "text_crc32", "x").join(placed, ["size", "text_crc32", "x"])
    rows = cut(rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "x"), F.lit(slices)).cast("int")), "placed")
    counts = rows.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "slice", F.coalesce(before, F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "x", "size")) - 1
    out = rows.withColumn("number", number).join(starts, ["shard", "slice"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("number") + F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
