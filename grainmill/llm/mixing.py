"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, targets follow from the weights by water filling under a cap, and
each document is emitted floor(rate) times plus one copy if its hash-seeded draw falls below the
source's fraction. The draw is one of 4096 bins of an MD5 of the document's id. Independent draws
of whole documents miss the target of a small source widely (some 15 % with 50 documents of
uneven sizes), so the threshold on the draw is the bin at which the drawn words come nearest to
the fraction of the source's words: the same draw, its probability calibrated on the realised sums.
Only (source, bin) sums are shuffled, aggregated on the map side; no text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import cut, n_words, text_of

WEIGHTS = (3, 1, 2)
#: Hex digits of the draw; three give 4096 bins.
DIGITS = 3


def draw(seed: str) -> Column:
    """The bin of a row: of its id, or of its text where it has no id."""
    who = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.encode(text_of(), "UTF-8")))
    return F.conv(F.substring(F.md5(F.concat(who, F.lit(f":{seed}"))), 1, DIGITS), 16, 10).cast("int")


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, size in words and draw of every document; narrow, and cut from the texts."""
    return cut(docs.select("doc_id", "source", n_words(text_of()).alias("size"), draw(seed).alias("bin")), "mix")


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """Per source: source_size, target, whole copies and the bin below which one more is made.

    share: the words to take as a fraction of all words; it must not exceed ``cap``. A source that
    reaches ``cap`` times its size stops there, and the others share the rest by weight, which is
    the level L with sum(min(cap * size, L * weight)) = budget. With sources in order of
    cap * size / weight, L is the largest of (budget - caps so far) / (weights left).
    """
    if share[0] > cap * share[1]:
        raise ValueError("more is asked for than the cap allows")
    bins = sizes.groupBy("source", "bin").agg(F.sum("size").alias("s"))
    sources = bins.groupBy("source").agg(F.sum("s").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    sources = sources.withColumn("w", w)
    order = Window.orderBy(F.col("source_size") * cap / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) * share[0] - F.coalesce(F.sum("source_size").over(order), F.lit(0)) * cap * share[1]) / (share[1] * (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(order), F.lit(0))))
    sources = sources.withColumn("level", level.cast("double"))
    sources = sources.withColumn("target", F.least((F.col("source_size") * cap).cast("double"), F.max("level").over(everything) * F.col("w")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.select("source", "source_size", "target", F.floor(rate).cast("int").alias("whole"), ((rate - F.floor(rate)) * F.col("source_size")).alias("rest"))
    cum = F.sum("s").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    ends = bins.select("source", (F.col("bin") + 1).alias("below"), cum.alias("cum"))
    ends = ends.union(sources.select("source", F.lit(0), F.lit(0).cast("long")))
    ends = ends.join(sources.select(F.col("source").alias("source_"), "rest"), F.col("source").eqNullSafe(F.col("source_")))
    best = ends.groupBy("source").agg(F.min_by("below", F.struct(F.abs(F.col("cum") - F.col("rest")), "below")).alias("below"))
    best = best.select(F.col("source").alias("source_"), "below")
    return sources.join(best, F.col("source").eqNullSafe(F.col("source_"))).drop("source_", "rest")


def with_copies(rows: DataFrame, mix: DataFrame, bin_: Column) -> DataFrame:
    """The rows with source_size, target and copies; the plan has a row per source."""
    mix = mix.select(F.col("source").alias("source_"), "source_size", "target", "whole", "below")
    out = rows.withColumn("bin_", bin_).join(mix, F.col("source").eqNullSafe(F.col("source_")))
    copies = F.col("whole") + F.when(F.col("bin_") < F.col("below"), 1).otherwise(0)
    return out.withColumn("copies", copies).drop("source_", "bin_", "whole", "below")


def mix_sizes(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """doc_id, size, source_size, target and taken (size times copies) of every document.

    Null or empty texts have size 0 and take nothing; a null source is a source, the last in order;
    a null doc_id draws by its text; repeated rows draw alike. Ties between bins go to the lower
    one. An empty table gives no rows. Further columns are left out.
    """
    sizes = sized(docs, seed)
    out = with_copies(sizes, plan(sizes, **how), F.col("bin"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; columns as they were."""
    names = docs.columns
    taken = with_copies(docs, cut(plan(sized(docs, seed), **how), "plan"), draw(seed)).where("copies > 0")
    return taken.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*names)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':mix'), 1, 3))::INTEGER AS bin
  FROM documents),
b AS (SELECT source, bin, sum(size)::BIGINT AS s FROM d GROUP BY ALL),
t AS (SELECT source, sum(s)::BIGINT AS source_size FROM b GROUP BY ALL),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w FROM t),
l AS (SELECT *,
    (3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER before, 0))::DOUBLE
      / (2 * (sum(w) OVER () - coalesce(sum(w) OVER before, 0)))::DOUBLE AS level
  FROM w WINDOW before AS (ORDER BY 2 * source_size / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, max(level) OVER () * w) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM g),
e AS (
  SELECT source, bin + 1 AS below, sum(s) OVER (PARTITION BY source ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum FROM b
  UNION ALL SELECT source, 0, 0 FROM t),
c AS (
  SELECT e.source, below,
    row_number() OVER (PARTITION BY e.source ORDER BY abs(cum - (rate - floor(rate)) * source_size), below) AS n
  FROM e JOIN r ON e.source IS NOT DISTINCT FROM r.source)
SELECT d.doc_id, d.size::BIGINT AS size, r.source_size, r.target,
  (d.size * (floor(rate) + CASE WHEN d.bin < c.below THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
  JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.n = 1
"""
