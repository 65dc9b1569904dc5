"""Batch candidate search over the two-layer index: many queries in one plan."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.cuts import cut
from grainmill.operators.arrow import minimizers, small
from grainmill.operators.index import Lookup, block_masks

MOST = 256
#: Bytes of queries' texts that are sent to all tasks at once.
MOST_SENT = 64 << 20
#: A whole index as rows, or what gives its rows for some keys.
Postings = DataFrame | Lookup


def asked_of(queries: DataFrame, q: int, w: int) -> DataFrame:
    """(qid, crc): what is looked up. A query shorter than q is not."""
    return minimizers(queries.where(F.octet_length(queries.columns[1]) >= q), q, w, "self", "qid")


def df_of(post: Postings, keys: DataFrame) -> DataFrame:
    """(crc, df, ...) of those of the keys (crc) that the index has."""
    if isinstance(post, Lookup):
        return post.df(keys)
    return post.drop("chunk_id").join(keys.select("crc").distinct(), "crc", "left_semi").distinct()


def rows_for(post: Postings, keys: DataFrame, block_size: int = 1) -> DataFrame:
    """(crc, chunk_id, ...) of keys from df_of(); of layer C one chunk or more of each block."""
    if isinstance(post, Lookup):
        return post.rows(keys, block_size)
    return post.join(keys.select("crc"), "crc", "left_semi")


def l0_parts(queries: DataFrame, post: Postings, n_chunks: int, q: int = 8, w: int = 8, block_size: int = 64) -> tuple[DataFrame, DataFrame]:
    """Per query: (qid, method, source, b_anchors, c_anchors, best_df) and its candidates as runs (qid, low, high)
    before neighbours are added; those of a fallback, all chunks, are left out. Ties between keys of equal df go to the smaller key.

    Layer B gives the union of the two rarest lists, or the rarest alone where the union exceeds MOST.
    Layer C (blocks) stands in where B has nothing or still too much, and is looked up for those queries alone. Above
    half the corpus, or without any anchor, all chunks are candidates (source 'fallback').
    """
    qk = cut(asked_of(queries, q, w), "keys")
    hits = cut(qk.join(df_of(post, qk), "crc"), "hits")
    b, c = F.col("layer") == "B", F.col("layer") == "C"
    anchors = hits.groupBy("qid").agg(F.count_if(b).alias("nb"), F.count_if(c).alias("nc"), F.min(F.when(b, F.col("df"))).alias("df_b"))
    # the rarest list alone is over MOST, else its union with the second or itself is small enough
    anchors = cut(anchors.withColumn("by_c", ((F.col("nb") == 0) | (F.col("df_b") > MOST)) & (F.col("nc") > 0)), "anchors")
    rarest = F.row_number().over(Window.partitionBy("qid").orderBy("df", "crc"))
    two = cut(hits.where(b).withColumn("rk", rarest).where("rk <= 2").select("qid", "crc", "df", "layer", "rk"), "two")
    of_c = cut(hits.where(c).join(anchors.where("by_c").select("qid"), "qid", "left_semi"), "of_c")
    wanted = two.select("crc", "df", "layer").unionByName(of_c.select("crc", "df", "layer")).distinct()
    post = cut(rows_for(post, wanted, block_size), "post")  # no other key of the index goes further
    b_rows = post.where("layer = 'B'").select("crc", "chunk_id")
    lists = cut(two.join(b_rows, "crc").groupBy("qid", "chunk_id").agg(F.min("rk").alias("rk")), "lists")
    masks = cut(block_masks(post, block_size), "masks")
    c_df = masks.groupBy("crc").agg((F.count("*") * block_size).alias("df"))
    of_c = cut(of_c.select("qid", "crc").join(c_df, "crc").withColumn("rk", rarest).where("rk <= 2"), "two_c")
    low = F.col("block_id") * block_size
    blocks = of_c.join(masks, "crc").where(low < n_chunks)
    blocks = cut(blocks.select("qid", low.alias("low"), (F.least(low + block_size, F.lit(n_chunks)) - 1).alias("high")).distinct(), "blocks")
    sizes = lists.groupBy("qid").agg(F.count("*").alias("n12"), F.count_if(F.col("rk") == 1).alias("n1"))
    best_c = of_c.groupBy("qid").agg(F.min("df").alias("df_c"))
    s = queries.select("qid").join(anchors, "qid", "left").join(sizes, "qid", "left").join(best_c, "qid", "left")
    s = s.na.fill(0, ["nb", "nc", "n12", "n1"]).na.fill(False, ["by_c"])
    s = s.withColumn("size_b", F.when(F.col("n12") <= MOST, F.col("n12")).otherwise(F.col("n1")))
    s = s.join(blocks.groupBy("qid").agg(F.sum(F.col("high") - F.col("low") + 1).alias("ncc")), "qid", "left").na.fill(0, ["ncc"])
    s = s.withColumn("take_c", F.col("by_c") & ((F.col("nb") == 0) | (F.col("ncc") < F.col("size_b"))))
    s = s.withColumn("label_c", F.col("by_c") & ((F.col("nb") == 0) | (F.col("df_c") < F.col("df_b"))))
    s = s.withColumn("found", F.col("nb") + F.col("nc") > 0)
    s = s.withColumn("n_cand", F.when(F.col("take_c"), F.col("ncc")).otherwise(F.col("size_b")))
    s = s.withColumn("all", ~F.col("found") | (F.col("n_cand") > n_chunks // 2))
    named = F.when(F.col("all"), "fallback").when(F.col("take_c"), "c_top2").when(F.col("n12") > MOST, "b_best1").when(F.col("nb") >= 2, "b_isect").otherwise("b_best")
    source = F.when(F.col("all"), "fallback").when(F.col("label_c"), "C").when(F.col("nb") >= 2, "B_isect").otherwise("B")
    best = F.when(F.col("label_c"), F.col("df_c")).otherwise(F.col("df_b"))
    summary = cut(s.select("qid", F.when(~F.col("found"), "l0_fallback").otherwise(F.concat(F.lit("l0_"), named, F.lit("_"), (F.col("nb") + F.col("nc")).cast("string"))).alias("method"), source.alias("best_source"), F.col("nb").alias("b_anchors"), F.col("nc").alias("c_anchors"), F.coalesce(best, F.lit(0)).alias("best_df"), "all", "take_c", (F.col("n12") > MOST).alias("only_first"), "found"), "summary")
    use = summary.where("not all").select("qid", "take_c", "only_first")
    from_c = blocks.join(use.where("take_c"), "qid", "left_semi")
    from_b = lists.join(use.where("not take_c"), "qid").where("not only_first or rk = 1").select("qid", F.col("chunk_id").alias("low"), F.col("chunk_id").alias("high"))
    return summary, from_c.unionByName(from_b)


def widened(runs: DataFrame, n_chunks: int) -> DataFrame:
    """The runs (qid, low, high) with the chunks before and after, within the corpus, joined so that none touch."""
    runs = runs.select("qid", F.greatest(F.col("low") - 1, F.lit(0)).alias("low"), F.least(F.col("high") + 1, F.lit(n_chunks - 1)).alias("high")).where("low <= high")
    before = Window.partitionBy("qid").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("qid").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("low") > F.max("high").over(before) + 1, F.lit(True))
    runs = runs.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(upto))
    return runs.groupBy("qid", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def neighbours(candidates: DataFrame, n_chunks: int) -> DataFrame:
    """(qid, chunk_id) with the chunks before and after, within the corpus."""
    return listed(widened(candidates.select("qid", F.col("chunk_id").alias("low"), F.col("chunk_id").alias("high")), n_chunks))


def everything(queries: DataFrame, n_chunks: int) -> DataFrame:
    """(qid, low, high): all chunks for each query."""
    return queries.select("qid", F.lit(0).cast("long").alias("low"), F.lit(n_chunks - 1).cast("long").alias("high"))


def listed(runs: DataFrame, *more: str, at_once: int = 1 << 16) -> DataFrame:
    """(qid, chunk_id) of runs (qid, low, high) that don't overlap; long ones in pieces, so that no row holds a whole one."""
    pieces = runs.where("low <= high").select("*", F.explode(F.expr(f"sequence(0L, (high - low) div {at_once})")).alias("piece"))
    first = F.col("low") + F.col("piece") * at_once
    return pieces.select("qid", F.explode(F.sequence(first, F.least(first + at_once - 1, "high"))).alias("chunk_id"), *more)


def told(summary: DataFrame, near: DataFrame, n_chunks: int) -> DataFrame:
    """The summary's columns with the number of candidates; that of a fallback is known without listing them."""
    counts = near.groupBy("qid").agg(F.sum(F.col("high") - F.col("low") + 1).alias("near"))
    rows = summary.join(counts, "qid", "left").withColumn("cand_count", F.when(F.col("all"), F.lit(n_chunks).cast("long")).otherwise(F.coalesce("near", F.lit(0))))
    return rows.select("qid", "method", (F.col("b_anchors") + F.col("c_anchors")).alias("anchors_found"), "b_anchors", "c_anchors", "best_df", "best_source", "cand_count", F.round(100 * F.col("cand_count") / n_chunks, 6).alias("cand_pct"), F.col("found").cast("double").alias("l0_hit_rate"), "all")


def l0_runs(queries: DataFrame, post: Postings, n_chunks: int, **how) -> DataFrame:
    """l0_search() as runs (qid, low, high)."""
    summary, picked = l0_parts(queries, post, n_chunks, **how)
    return widened(picked, n_chunks).unionByName(everything(summary.where("all"), n_chunks))


def l0_search(queries: DataFrame, post: Postings, n_chunks: int, **how) -> DataFrame:
    """(qid, chunk_id): the candidates of each query (qid, q), neighbours included."""
    return listed(l0_runs(queries, post, n_chunks, **how))


def l0_summary(queries: DataFrame, post: Postings, n_chunks: int, **how) -> DataFrame:
    """qid, method, anchors_found, b_anchors, c_anchors, best_df, best_source, cand_count, cand_pct, l0_hit_rate."""
    summary, picked = l0_parts(queries, post, n_chunks, **how)
    return told(summary, widened(picked, n_chunks), n_chunks).drop("all")


def l0_both(queries: DataFrame, post: Postings, n_chunks: int, adaptive: bool = False, **how) -> tuple[DataFrame, DataFrame]:
    """The summary with ``all`` (every chunk is a candidate), and the candidates of the other queries as runs
    (qid, low, high); with ``adaptive`` also q_used."""
    if not adaptive:
        summary, picked = l0_parts(queries, post, n_chunks, **how)
        near = widened(picked, n_chunks)
        return told(summary, near, n_chunks), near
    w = how.pop("w", 8)
    passes = [(q, max(1, w >> i)) for i, q in enumerate((8, 7, 6))]
    if isinstance(post, Lookup):  # one scan tells the df of all passes' keys
        asked = [asked_of(queries, *p).select("crc") for p in passes]
        post = post.knowing(asked[0].union(asked[1]).union(asked[2]))
    rest, rows, lists = queries, None, None
    for q, w in passes:
        summary, near = l0_both(rest, post, n_chunks, q=q, w=w, **how)
        summary = cut(summary, "adaptive")
        hit = summary.where("anchors_found > 0")
        done, near = hit.withColumn("q_used", F.lit(q)), near.join(hit.select("qid"), "qid", "left_semi")
        rows, lists = (done, near) if rows is None else (rows.unionByName(done), lists.unionByName(near))
        rest = cut(rest.join(hit.select("qid"), "qid", "left_anti"), "rest")
    none = summary.where("anchors_found = 0").withColumn("best_source", F.lit("none")).withColumn("q_used", F.lit(0))
    return rows.unionByName(none), lists


def l0_adaptive(queries: DataFrame, post: Postings, n_chunks: int, **how) -> DataFrame:
    """The summary of the first of (8, w), (7, w / 2), (6, w / 4) that finds anchors, with q_used (0 if none)."""
    return l0_both(queries, post, n_chunks, adaptive=True, **how)[0].drop("all")


def hotspot_search(queries: DataFrame, post: Postings, n_chunks: int, q: int = 8, w: int = 40, most: tuple[int, int] = (1, 10)) -> DataFrame:
    """(qid, chunk_id): neighbours of the rarest key's chunks. No row means no opinion: the query is
    shorter than w + q - 1 bytes, has no key in the index, or its rarest is in over most of the chunks."""
    keys = minimizers(queries.where(F.octet_length(queries.columns[1]) >= w + q - 1), q, w, "empty", "qid")
    keys = cut(keys, "keys")
    best = keys.join(df_of(post, keys), "crc").groupBy("qid").agg(F.min_by("crc", F.struct("df", "crc")).alias("crc"), F.min("df").alias("df"))
    best = cut(best.where(F.col("df") <= n_chunks * most[0] // most[1]), "best")
    met = rows_for(post, best.select("crc", "df").distinct())  # the rarest keys' lists only
    return neighbours(best.select("qid", "crc").join(met, "crc").select("qid", "chunk_id"), n_chunks)


def exact_verify(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, across: bool = False) -> DataFrame:
    """(qid, chunk_id, at): candidates that hold the query, and where (from 0); with ``across`` also
    where it begins in a chunk and ends in the next."""
    data = chunks.select("chunk_id", "data")
    if across:
        following = chunks.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("data").alias("next"))
        data = data.join(following, "chunk_id", "left").select("chunk_id", F.concat("data", F.coalesce("next", F.unhex(F.lit("")))).alias("data"), F.octet_length("data").alias("own"))
    # by chunk, so that a text moves once for all its queries; theirs go to the tasks, in packs where they are many
    data = data if across else data.withColumn("own", F.octet_length("data") + 1)
    text = F.coalesce(F.col(queries.columns[1]), F.unhex(F.lit("")))
    queries = cut(queries.select("qid", text.alias("q_")), "texts")
    packs = -(-(queries.agg(F.sum(F.octet_length("q_") + 100)).first()[0] or 0) // MOST_SENT)

    def found(pack):
        sent = queries.where(pack).toArrow()

        def find(batches):
            texts = dict(zip(*(column.to_pylist() for column in sent.columns)))
            for batch in batches:
                out = []
                for chunk, qids, d, own in zip(*(column.to_pylist() for column in batch.columns)):
                    out += [(i, chunk, at) for i in qids if i in texts and 0 <= (at := d.find(texts[i])) < own]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (zip(*out) if out else ((), (), ()))], ["qid", "chunk_id", "at"])

        asked = candidates.where(pack).groupBy("chunk_id").agg(F.collect_list("qid").alias("qids"))
        rows = asked.join(data, "chunk_id").select("chunk_id", "qids", F.coalesce("data", F.unhex(F.lit(""))).alias("data"), F.coalesce("own", F.lit(1)))
        return rows.mapInArrow(small(find, 64), "qid long, chunk_id long, at long")

    return reduce(DataFrame.unionByName, [found(F.pmod(F.xxhash64("qid"), F.lit(packs)) == p) for p in range(packs)] or [found(F.lit(False))])
