"""Toxicity by maximum-scoring segments.

Log-odds of words and word beginnings between toxic and clean labelled texts (numbers of texts that
hold them, with an informative Dirichlet prior) are kept where they are significant, less two
standard errors. A token scores as the best of its word and beginnings; every other one costs DRIFT. All maximal scoring segments of a
text (Ruzzo and Tompa's linear-time algorithm) are found; as costs are constant between toxic
tokens, only those tokens and the gaps between them are visited. A segment's normalised score is
lambda * S - ln(K * N), with lambda from the clean texts' token scores and K fitted to the extremes
of clean texts (Gumbel), so that exp(-normalised) is its expected number by chance. The significant
segments of a text are added up and a logistic curve, fitted on the same labelled sample, gives
the probability.

Labels are learned from at most MOST_LABELLED ids, those with the smallest hashes; so the tokens that
are significant, all of which score, are bounded by that sample's too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import cut

TOKEN = re.compile(r"[^\W_]+")
MOST_LABELLED = 20_000
#: Lengths of the word beginnings that count beside whole words, which end in a blank here.
BEGINNINGS = (4, 5, 6, 7, 8)
#: PRIOR is the weight of the pooled counts in the Dirichlet prior; significance needs Z standard errors.
PRIOR, Z, DRIFT = 0.1, 4.0, 0.05
MOST_REMEMBERED = 200_000
THRESHOLD = 0.3


def remainder(column: str = "doc_id") -> Column:
    """CRC-32 of the id as text, modulo 4; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % 4


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]
    scale: float  # lambda
    log_k: float
    weights: tuple[float, ...]


def parts(token: str) -> list[str]:
    return [token + " ", *(token[:n] for n in BEGINNINGS if len(token) > n)]


class Scores(dict):
    """Token to score, 0 for most; remembers a bounded number of tokens."""

    def __init__(self, known: dict[str, float]):
        self.known = known

    def __missing__(self, token: str) -> float:
        value = max((self.known.get(x, 0.0) for x in parts(token)), default=0.0)
        if len(self) < MOST_REMEMBERED:
            self[token] = value
        return value


def positions(text: str, scores: Scores) -> tuple[list[tuple[int, float]], int]:
    """(token number, score) of the tokens that score, and the number of tokens."""
    tokens = TOKEN.findall(text.lower())
    found = list(map(scores.__getitem__, tokens))
    return [(i, s) for i, s in enumerate(found) if s] if any(found) else [], len(tokens)


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first token, last token, score).

    hits: the tokens of positive score; all between cost ``drift``. Each candidate holds the
    cumulative score before it and at its end, as in the linear-time algorithm; the search for the
    nearest candidate with a lower left sum follows links, so that the whole scan is linear.
    """
    stack: list[list] = []  # first, last, left sum, right sum, index of the nearest with a lower left sum
    total, last = 0.0, -1
    for at, score in hits:
        total -= drift * (at - last - 1)
        left, total, last = total, total + score, at
        new = [at, at, left, total, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def features(text: str, scores: Scores, scale: float, log_k: float) -> tuple[float, float, float, list]:
    """Sum of the significant segments' normalised scores, the largest score, the density of hits, the segments."""
    hits, n = positions(text, scores)
    if not hits:
        return 0.0, -1.0, 0.0, []
    found = [(a, b, s, scale * s - log_k - math.log(max(n, 1))) for a, b, s in segments(hits)]
    good = [x for x in found if x[3] > 0]
    return math.log1p(sum(x[3] for x in good)), max(-1.0, min(3.0, max(x[3] for x in found) / 5)), min(1.0, 10 * len(hits) / n), good


def _lambda(values: np.ndarray, chances: np.ndarray) -> float:
    """The positive root of sum(p * exp(lambda * s)) = 1; the mean score is negative."""
    low, high = 0.0, 1.0
    f = lambda x: float(np.dot(chances, np.exp(np.minimum(x * values, 700.0)))) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    w[0] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    damp = ridge * np.eye(len(w))
    damp[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + damp, x.T @ (y - p) - damp @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _counted(rows: DataFrame) -> DataFrame:
    """For each word and beginning, the clean and toxic texts of a sample that hold it."""

    def run(batches):
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic].update({p for w in set(TOKEN.findall((text or "").lower())) for p in parts(w)})
            tokens = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.string()), "c": pa.array([counts[0][t] for t in tokens], pa.int64()), "t": pa.array([counts[1][t] for t in tokens], pa.int64())})

    return rows.mapInArrow(run, "token string, c long, t long").groupBy("token").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """text and toxic (0 or 1) of the documents of at most ``most`` labelled ids outside the held-out quarter.

    A document labelled twice counts once, as toxic if any label says so; null labels are none. The
    ids are those with the smallest hashes; as their number is bounded they are broadcast, and no
    text is shuffled.
    """
    told = labels.where("toxic is not null and doc_id is not null").where(remainder() != 2)
    told = told.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def fit(rows: DataFrame) -> Model:
    """The model of a labelled sample (text, toxic)."""
    counts = _counted(rows).cache()
    all_c, all_t = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    alpha, weight = (F.col("c") + F.col("t")) * PRIOR, (all_c + all_t) * PRIOR
    odds = lambda n, whole: F.log((n + alpha) / (F.lit(whole + weight) - n - alpha))
    delta = odds(F.col("t"), all_t) - odds(F.col("c"), all_c)
    error = F.sqrt(1 / (F.col("t") + alpha) + 1 / (F.col("c") + alpha))
    best = counts.where("t > 0").withColumns({"delta": delta - 2 * error, "z": delta / error}).where(F.col("z") >= Z).orderBy(F.desc("z"), "token").collect()
    counts.unpersist()
    known = {r["token"]: float(r["delta"]) for r in best}
    values = np.array([*(r["delta"] for r in best), -DRIFT])
    hit = np.array([r["c"] + 0.5 for r in best])
    chances = np.append(hit, max(1.0, all_c - hit.sum()))
    scale = _lambda(values, chances / chances.sum()) if best else 1.0

    def measured(batches):
        scores = Scores(known)
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits, n = positions(text or "", scores)
                top = max((s for *_, s in segments(hits)), default=0.0)
                out.append((toxic, n, scale * top))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ([],) * 3, (pa.int32(), pa.int64(), pa.float64()))], ["toxic", "n", "top"])

    tops = rows.mapInArrow(measured, "toxic int, n long, top double").where("toxic = 0 and n > 0 and top > 0").select((F.col("top") - F.log("n")).alias("g"))
    mean, spread = tops.agg(F.avg("g"), F.count("*")).first()
    # a Gumbel of unit scale has its mean 0.5772 above its location ln K; never below ln K = ln 0.01
    log_k = max(math.log(0.01), mean - 0.5772) if spread else math.log(0.1)

    def described(batches):
        scores = Scores(known)
        for batch in batches:
            out = [(*features(text or "", scores, scale, log_k)[:3], toxic) for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ([],) * 4, (pa.float64(),) * 3 + (pa.int32(),))], ["a", "b", "c", "toxic"])

    seen = rows.mapInArrow(described, "a double, b double, c double, toxic int").groupBy("a", "b", "c").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).orderBy("a", "b", "c").collect()
    x = np.array([[r["a"], r["b"], r["c"]] for r in seen for _ in range(r["n"])]).reshape(-1, 3)
    y = np.array([float(k < r["t"]) for r in seen for k in range(r["n"])])
    weights = _logistic(x, y) if len(x) else np.zeros(4)
    return Model(known, scale, log_k, tuple(map(float, weights)))


def score(docs: DataFrame, model: Model, passages: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; with ``passages`` also the significant
    segments as (first token, last token, normalised score)."""
    w = model.weights

    def run(batches):
        scores = Scores(model.scores)
        for batch in batches:
            out, found = [], []
            for text in batch.column(2).to_pylist():
                a, b, c, segs = features(text or "", scores, model.scale, model.log_k)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + w[1] * a + w[2] * b + w[3] * c)))))
                found.append([{"first": x[0], "last": x[1], "value": x[3]} for x in segs])
            columns = [batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array([int(p >= THRESHOLD) for p in out], pa.int32())]
            names = ["doc_id", "held_out", "score", "predicted"]
            if passages:
                kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("value", pa.float64())]))
                columns, names = [*columns, pa.array(found, kind)], [*names, "passages"]
            yield pa.RecordBatch.from_arrays(columns, names)

    more = ", passages array<struct<first: long, last: long, value: double>>" if passages else ""
    rows = docs.select("doc_id", (remainder() == 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + more)


def rate_toxicity(docs: DataFrame, labels: DataFrame, passages: bool = False) -> DataFrame:
    """Learns from the labelled rows that are not held out and scores every row.

    A null text counts as empty and gets the score of a text without toxic passages; a null doc_id
    is not held out; repeated rows score alike; without labels every score is 0.5; an empty table
    gives no rows. Further columns are left out.
    """
    return score(docs, fit(cut(sample(docs, labels), "toxic")), passages)
