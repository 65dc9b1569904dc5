"""N-gram Jaccard join by a blocked sparse product of document by n-gram incidence.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Equal sets form a class, and
only classes are compared. The incidence matrix is cut down to the part that size bounds leave: in
a fixed order of all shingles (those that a sample of the texts shows to be common last, else by
hash; see common()), two sets of Jaccard similarity t share at least l shingles among the first
n - ceil(t n) + l of each (or as many as the larger set needs, if that is fewer). That part is
dealt by shingle into blocks; each block multiplies its columns with their transpose, for pairs of
fitting sizes only, overlap counts are added up over blocks, and pairs below the bound are
discarded. The rest is settled on whole sets.

A group of m near copies would give m * m pairs, above or below the threshold. Two things prevent that.
Products with a few hubs come first: each multiplies every column with HUBS of its classes only (those of
which the largest share of entries is shared, which link with most of their group); that is linear in the
entries, and what it settles is merged into components. The last product leaves out pairs that are in
one component already; the classes of wide columns go group by group into blocks that count overlaps of
their whole sets in memory and give links only. No candidate is capped or dropped.

Texts are read again for each step (they are not shuffled, and only those go to Python that a bitmap of
fixed size says may be wanted); hashes are made by numpy over the bytes of Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import components, discard, marked, marks, sweeping, text_of, told_by, width
from grainmill.llm.common import swept as cut
from grainmill.llm.decontam import _runs

N = 5
SIMILAR = (4, 5)  # 0.8
SHARED = 4  # l
#: Bits that tell common shingles; a shingle is common if COMMON texts of one in SAMPLE hold it (more, where over MOST are).
SKETCH_BITS, SAMPLE, COMMON, MOST = 24, 4, 4, 1 << 22
#: Hubs a column in each of the products before the full one.
HUBS = (2, 3)
#: Columns of more classes than this are multiplied on whole sets, in blocks of about BLOCK shingles by four times as many.
WIDE, BLOCK = 16, 1 << 20
REMEMBERED = 500_000

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_WORTH = np.random.default_rng(20240229).integers(1 << 62, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_WORTH[65:91] = _WORTH[97:123]  # A-Z count as a-z
_PRIME, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_PRIME, _INVERSE)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _POWERS[i] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def shingle_sets(data: np.ndarray, starts: np.ndarray, n: int = N) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts lie end to end in ``data``."""
    texts = len(starts) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * texts
    up, down = _powers(len(data) + 1)
    word = ~_BLANK[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = starts[:-1][starts[:-1] < len(data)]
    first[edges] = word[edges]  # a text begins a word of its own
    begin = np.flatnonzero(first)
    stop = ~word
    stop[edges] = True
    ends = np.append(np.flatnonzero(stop), len(data))
    end = ends[np.searchsorted(ends, begin, "right")] if len(begin) else begin
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_WORTH[data] * up[:-1], out=total[1:])
    h = _mix((total[end] - total[begin]) * down[begin])
    of = np.searchsorted(starts, begin, "right") - 1
    counts = np.bincount(of, minlength=texts)
    at = np.concatenate([[0], np.cumsum(counts)])
    if len(h) >= n:
        whole = sum((h[i : len(h) - n + 1 + i] * _PLACE[i] for i in range(n)), np.uint64(0))
        whole = _mix(whole)
    out = []
    for a, k in zip(at[:-1].tolist(), counts.tolist()):
        if k >= n:
            s = np.sort(whole[a : a + k - n + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif k:
            out.append(_mix((h[a : a + k] * _PLACE[:k]).sum(keepdims=True, dtype=np.uint64) + np.uint64(k)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def class_id(d: tuple[int, int], ids: "Ids") -> int:
    """A class's number: the first half of the digest, or both halves where first halves clash."""
    first = d[0] & ids.mask
    return d[0] ^ d[1] if first in ids.clash else first


@dataclass(frozen=True)
class Ids:
    """Bits of first halves (all, but in tests), and those that differing sets share."""

    mask: int = -1
    clash: frozenset = frozenset()


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    a, b = _mix(s ^ np.uint64(0x243F6A8885A308D3)).sum(dtype=np.uint64), _mix(s ^ np.uint64(0x13198A2E03707344)).sum(dtype=np.uint64)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def prefix_length(n, similar=SIMILAR, shared: int = SHARED):
    need = -(-n * similar[0] // similar[1])
    return np.minimum(n, n - need + shared)


def measured(docs: DataFrame) -> DataFrame:
    """A row per document: kind (0), doc_id, sid, n, the set's digest d1, d2 and the text's hash th."""

    def run(batches):
        for batch in batches:
            for first, data, starts in _runs(batch.column(2)):
                sets = shingle_sets(data, starts)
                d = [digest(s) for s in sets]
                k = len(sets)
                yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), batch.column(0).slice(first, k), batch.column(1).slice(first, k), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), batch.column(3).slice(first, k)], names)

    names = ["kind", "doc_id", "sid", "n", "d1", "d2", "th"]
    return cut(_identified(docs).withColumn("th", F.xxhash64(text_of())).mapInArrow(run, "kind int, doc_id long, sid long, n long, d1 long, d2 long, th long"), "sets")


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, sid, text: sid stands for a row without doc_id."""
    return docs.select("doc_id", F.coalesce("doc_id", F.xxhash64(text_of())).alias("sid"), "text")


def common(docs: DataFrame, ids: "Ids") -> np.ndarray:
    """A fixed-size bit per spot of shingle hashes: whether a common shingle lies there.

    The bits only order the shingles: any order gives the same links, but columns of common shingles
    cost most. So counts are taken from one in SAMPLE of the texts, and where more than MOST shingles
    are common, those of the higher counts are. The driver gets 4 MB, whatever the input.
    """

    def run(batches):
        held, size = [], 0
        for s, _ in _each_set(batches, ids):
            held.append(s)
            size += len(s)
            if size > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(held)))], ["h"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(held)))], ["h"])

    sample = docs.where(F.pmod(F.xxhash64(text_of()), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "h long")
    counts = cut(sample.groupBy("h").agg(F.least(F.count("*"), F.lit(1 << 16)).alias("k")).where(F.col("k") >= COMMON), "common")
    least, marked_ = (1 << 16) + 1, 0
    for k, n in sorted(map(tuple, counts.groupBy("k").agg(F.count("*")).collect()), reverse=True):
        marked_ += n
        if marked_ > MOST:
            break
        least = k
    spots = counts.where(F.col("k") >= least).select(F.shiftrightunsigned("h", 64 - SKETCH_BITS).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("bits"))
    with sweeping(docs.sparkSession):
        found = words.toArrow()
    discard(counts)
    out = np.zeros(1 << SKETCH_BITS - 6, "<u8")
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _each_set(batches, ids: Ids, column: int = 0) -> Iterator[tuple[np.ndarray, int]]:
    """(set, class id) of the texts, equal sets once while they are remembered."""
    met: set[int] = set()
    for batch in batches:
        for _, data, starts in _runs(batch.column(column)):
            for s in shingle_sets(data, starts):
                if len(s):
                    cid = class_id(digest(s), ids)
                    if cid not in met:
                        if len(met) >= REMEMBERED:
                            met.clear()
                        met.add(cid)
                        yield s, cid


def entries(docs: DataFrame, late: np.ndarray, ids: Ids) -> DataFrame:
    """(h, cid, n): the first shingles of each set in the fixed order."""
    bits = np.packbits(late)

    def run(batches):
        late = np.unpackbits(bits).astype(bool)
        hs, cids, ns, held = [], [], [], 0

        def out():
            k = [len(x) for x in hs]
            return pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(hs))), pa.array(np.repeat(np.array(cids, np.int64), k)), pa.array(np.repeat(np.array(ns, np.int64), k))], ["h", "cid", "n"])

        for s, cid in _each_set(batches, ids):
            p = int(prefix_length(len(s)))
            is_late = late[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            kept = s[~is_late][:p]
            if len(kept) < p:
                kept = np.concatenate([kept, s[is_late][: p - len(kept)]])
            hs.append(kept)
            cids.append(cid)
            ns.append(len(s))
            held += p
            if held > 200_000:
                yield out()
                hs, cids, ns, held = [], [], [], 0
        if hs:
            yield out()

    return docs.select("text").mapInArrow(run, "h long, cid long, n long")


def _columns(batches, names: int) -> Iterator[list[np.ndarray]]:
    """Arrays of whole columns of the matrix: rows come sorted by h, and a batch never ends within one."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(names)]
        h = parts[0]
        end = int(np.searchsorted(h, h[-1]))  # what belongs to the last column waits
        if end:
            head = [p[:end] for p in parts]
            yield [np.concatenate([x[i] for x in held] + [head[i]]) for i in range(names)]
            held = [[p[end:] for p in parts]]
        else:
            if held and held[-1][0][0] != h[0]:
                yield [np.concatenate([x[i] for x in held]) for i in range(names)]
                held = []
            held.append(parts)
    if held:
        yield [np.concatenate([x[i] for x in held]) for i in range(names)]


def _by_column(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("h", "n", "cid", *more).repartition(width(rows.sparkSession), "h").sortWithinPartitions("h", "n", "cid")


def shared_entries(rows: DataFrame) -> DataFrame:
    """The entries of columns with at least two classes, each once."""

    def run(batches):
        for h, n, cid in _columns(batches, 3):
            once = np.append(True, (h[1:] != h[:-1]) | (n[1:] != n[:-1]) | (cid[1:] != cid[:-1]))
            h, n, cid = h[once], n[once], cid[once]
            more = np.append(h[1:] == h[:-1], False) | np.append(False, h[1:] == h[:-1])
            if more.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[more]) for x in (h, n, cid)], ["h", "n", "cid"])

    return cut(_by_column(rows).mapInArrow(run, "h long, n long, cid long"), "columns")


def _fits(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    return small * SIMILAR[1] >= large * SIMILAR[0]


def _pairs(a, na, b, nb) -> pa.RecordBatch:
    swap = a > b
    return pa.RecordBatch.from_arrays([pa.array(np.where(swap, b, a)), pa.array(np.where(swap, a, b)), pa.array(np.where(swap, nb, na)), pa.array(np.where(swap, na, nb))], ["a", "b", "na", "nb"])


def _with(i: int, others: np.ndarray, cid: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(others):
        yield _pairs(cid[others], n[others], np.full(len(others), cid[i]), np.full(len(others), n[i]))


PAIR = "a long, b long, na long, nb long"


def counted(shared: DataFrame) -> DataFrame:
    """The entries with ``have``, how many entries their class has in columns of two classes and more."""
    have = shared.groupBy(F.col("cid").alias("cid_")).agg(F.count("*").alias("have"))
    return shared.join(have, F.col("cid") == F.col("cid_")).select("h", "n", "cid", "have")


def _places(shared: DataFrame, parts: DataFrame | None) -> DataFrame:
    """The entries with the component that each class is in so far."""
    if parts is None:
        return shared.withColumn("part", F.col("cid"))
    return shared.join(parts, shared["cid"] == parts["node"], "left").select("h", "n", "cid", "have", F.coalesce("component", "cid").alias("part"))


def _least(n, m):
    """How many entries of their first parts similar sets of these sizes share at least.

    Similar sets share at least t / (1 + t) of their joint size. What two sets share beyond the first
    parts lies past the end of that one's part which ends first, so it is at most the rest of that
    set; the count must make up for what the larger rest leaves open.
    """
    t, of = SIMILAR
    most = np.maximum(n, m)
    rest = np.maximum(-(-most * t // of) - SHARED, 0)
    return np.maximum(np.minimum(SHARED, -(-most * t // of)), -(-(n + m) * t // (t + of)) - rest)


def _may_link(n, have, m, have_m) -> np.ndarray:
    """Whether the sizes fit and both have as many shared entries as a link needs."""
    return _fits(np.minimum(n, m), np.maximum(n, m)) & (np.minimum(have, have_m) >= _least(n, m))


def star_product(placed: DataFrame, hubs: int, seed: int) -> DataFrame:
    """Pairs of each column's classes with its ``hubs`` classes of the largest share of shared entries
    (of the smallest hashes, where that is equal), unless they are in one component already. Linear in
    the entries."""
    salt = np.uint64(0xA0761D6478BD642F * (seed + 1) & 0xFFFFFFFFFFFFFFFF)

    def run(batches):
        for h, n, cid, have, part in _columns(batches, 5):
            order = np.lexsort((_mix(cid.view(np.uint64) ^ salt), -have / prefix_length(n), h))
            h, n, cid, have, part = h[order], n[order], cid[order], have[order], part[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.diff(np.append(first, len(h)))
            at, start = np.arange(len(h)), np.repeat(first, size)
            for k in range(hubs):
                hub = start + k
                ok = at > hub  # earlier ones have met this hub as hubs
                ok[ok] = (h[hub[ok]] == h[ok]) & (part[hub[ok]] != part[ok])
                hub, here = hub[ok], at[ok]
                fits = _may_link(n[here], have[here], n[hub], have[hub])
                if fits.any():
                    hub, here = hub[fits], here[fits]
                    yield _pairs(cid[here], n[here], cid[hub], n[hub])

    return _by_column(placed, "have", "part").mapInArrow(run, PAIR)


def narrow_product(placed: DataFrame) -> DataFrame:
    """Pairs of the classes of columns of up to WIDE that may link and are not in one component yet."""

    def run(batches):
        for h, n, cid, have, part in _columns(batches, 5):
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.diff(np.append(first, len(h)))
            at, d = np.flatnonzero(np.repeat(size <= WIDE, size)), 1
            while len(at):
                at = at[at + d < len(h)]
                # within a column sizes ascend, so once a partner is too large all later ones are
                at = at[(h[at + d] == h[at]) & _fits(n[at], n[at + d])]
                apart = at[part[at] != part[at + d]]
                apart = apart[_may_link(n[apart], have[apart], n[apart + d], have[apart + d])]
                if len(apart):
                    yield _pairs(cid[apart], n[apart], cid[apart + d], n[apart + d])
                d += 1

    return _by_column(placed, "have", "part").mapInArrow(run, PAIR)


def wide_entries(placed: DataFrame) -> DataFrame:
    """(h, cid, n, part) of the wider columns that hold several components, without classes that may link with no other there."""
    t, of = SIMILAR

    def run(batches):
        for h, n, cid, have, part in _columns(batches, 5):
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.diff(np.append(first, len(h)))
            for a, k in zip(first[size > WIDE].tolist(), size[size > WIDE].tolist()):
                m, p, have_, c = (x[a : a + k] for x in (n, part, have, cid))
                # sizes ascend; which sizes _least() allows for a class with so many shared entries
                low, high = -(-m * t // of), m * of // t
                to = np.minimum(m, (have_ + -(-m * t // of) - SHARED + 1) * (t + of) // t - m + 1)
                again = np.maximum(m, np.ceil((m * t / (t + of) + SHARED - 1 - have_) / (t / of - t / (t + of))).astype(np.int64) - 1)
                count = np.maximum(np.searchsorted(m, to, "right") - np.searchsorted(m, low), 0) + np.maximum(np.searchsorted(m, high, "right") - np.searchsorted(m, again), 0)
                keep = count > ((to >= m).astype(np.int64) + (again <= m))  # itself may be among them
                if keep.any() and (p[keep] != p[keep][0]).any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h[a : a + k], c, m, p)], ["h", "cid", "n", "part"])

    return cut(_by_column(placed, "have", "part").mapInArrow(run, "h long, cid long, n long, part long"), "wide")


def wide_links(docs: DataFrame, placed: DataFrame, classes: DataFrame, ids: Ids) -> DataFrame:
    """Links of the classes that share a wider column and are not in one component yet.

    Columns form groups: a class is labelled by its first wide column, and a column belongs to the
    group of its commonest label, so that the columns of near copies or of a passage are one group. The
    whole sets of a group's classes are multiplied in blocks of rows by rows, which count overlaps in
    memory and give the pairs that reach the threshold, and no others. The rows of a group's largest
    component meet the others only.
    """
    rows = wide_entries(placed)
    labels = rows.groupBy("cid").agg(F.min("h").alias("label"))
    of = rows.join(labels, "cid").groupBy("h", "label").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("label", F.struct("k", "label")).alias("g"))
    held = cut(rows.join(of, "h").select("g", "cid", "n", "part").distinct(), "groups")
    main = held.groupBy("g", "part").agg(F.count("*").alias("k")).groupBy("g").agg(F.max_by("part", F.struct("k", "part")).alias("main"))
    asks = F.col("part") != F.col("main")
    held = held.join(main, "g")
    sizes = held.groupBy("g").agg(F.ceil(F.sum(F.when(asks, F.col("n")).otherwise(0)) / BLOCK).alias("qs"), F.ceil(F.sum("n") / (4 * BLOCK)).alias("ts")).where("qs > 0")
    held = held.join(sizes, "g").withColumns({"q": F.pmod(F.xxhash64("cid"), F.col("qs")), "t": F.pmod(F.xxhash64("cid", F.lit(1)), F.col("ts"))})
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    asking = held.where(asks).select("g", "q", F.explode(upto("ts")).alias("t"), "cid", "part", F.lit(1).alias("asks"))
    asked = held.select("g", F.explode(upto("qs")).alias("q"), "t", "cid", "part", F.lit(0).alias("asks"))
    blocks = cut(asking.unionByName(asked).select(F.xxhash64("g", "q", "t").alias("block"), "g", "cid", "part", "asks"), "blocks")
    texts = members(docs, blocks.select("cid").distinct(), classes, ids)
    whole = blocks.join(texts, "cid").select("block", "g", "asks", "cid", "part", "members")
    whole = whole.repartition(width(docs.sparkSession), "block").sortWithinPartitions("block", "g", "asks", "cid")

    def product(batches):
        last, held = None, ([], [])
        for batch in batches:
            block, g, asks, cid, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            for i in range(batch.num_rows):
                if (key := (block[i], g[i])) != last:
                    yield from _block(*held)
                    last, held = key, ([], [])
                held[0].append((asks[i], cid[i], part[i]))
                held[1].append(np.frombuffer(batch.column(5)[i].as_buffer(), np.uint64))
        yield from _block(*held)

    links = cut(whole.mapInArrow(product, "a long, b long").distinct(), "links")
    discard(rows, blocks, texts)
    return links


def _block(rows: list, sets: list) -> Iterator[pa.RecordBatch]:
    """The similar pairs of asking rows with the others; those asked come first."""
    t, of = SIMILAR
    split = sum(not r[0] for r in rows)
    if not 0 < split < len(rows):
        return
    _, cid, part = (np.array(x) for x in zip(*rows))
    n = np.array([len(x) for x in sets])
    h = np.concatenate(sets[:split])
    order = np.argsort(h, kind="stable")
    column, of_row = h[order], np.repeat(np.arange(split), n[:split])[order]
    pairs = ([], [])
    for i in range(split, len(rows)):
        low, high = np.searchsorted(column, sets[i]), np.searchsorted(column, sets[i], "right")
        found = high > low
        # it shares no more than the shingles that those asked have (itself perhaps among them)
        if int(np.count_nonzero(found)) * of < n[i] * t:
            continue
        low, k = low[found], (high - low)[found]
        at = np.repeat(low - np.append(0, np.cumsum(k)[:-1]), k) + np.arange(k.sum())
        inter = np.bincount(of_row[at], minlength=split)
        ok = inter * of >= (n[:split] + n[i] - inter) * t
        met = np.flatnonzero(ok & (part[:split] != part[i]))
        pairs[0].append(cid[:split][met])
        pairs[1].append(np.full(len(met), cid[i]))
    if pairs[0]:
        a, b = np.concatenate(pairs[0]), np.concatenate(pairs[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def candidates(pairs: DataFrame) -> DataFrame:
    """Adds up the counts of pairs and discards those below the bounds of their sizes (as in _least)."""
    t, of = SIMILAR
    largest = F.ceil(F.greatest("na", "nb") * t / of)
    need = F.greatest(F.least(F.lit(SHARED), largest), F.ceil((F.col("na") + F.col("nb")) * t / (t + of)) - F.greatest(largest - SHARED, F.lit(0)))
    return cut(pairs.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c")).where(F.col("c") >= need).select("a", "b"), "pairs")


def wanted(docs: DataFrame, met: DataFrame, classes: DataFrame) -> DataFrame:
    """The texts of the classes in ``met``, and a few more: a bitmap tells most others before they go to Python."""
    bitmap = marks(met.join(classes.select("cid", "sid"), "cid"), F.col("sid"))
    return marked(_identified(docs).select("sid", "text"), bitmap, F.col("sid")).select("text")


def members(docs: DataFrame, met: DataFrame, classes: DataFrame, ids: Ids) -> DataFrame:
    """(cid, members) of the classes in ``met``, from their texts."""

    def packed(batches):
        held, size = ([], []), 0
        for s, cid in _each_set(batches, ids):
            held[0].append(cid)
            held[1].append(s.tobytes())
            size += s.nbytes
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.binary())], ["cid", "members"])
                held, size = ([], []), 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.binary())], ["cid", "members"])

    texts = wanted(docs, met, classes).mapInArrow(packed, "cid long, members binary").join(met, "cid", "left_semi")
    return cut(texts.dropDuplicates(["cid"]), "members")


def settled(docs: DataFrame, pairs: DataFrame, classes: DataFrame, ids: Ids) -> DataFrame:
    """Of the pairs of classes, those with Jaccard similarity of at least SIMILAR on whole sets."""
    met = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    texts = members(docs, met, classes, ids)
    both = pairs.join(texts.select(F.col("cid").alias("a"), F.col("members").alias("ma")), "a").join(texts.select(F.col("cid").alias("b"), F.col("members").alias("mb")), "b")

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                inter = int(np.count_nonzero(y[at] == x))
                keep.append(inter * SIMILAR[1] >= (len(x) + len(y) - inter) * SIMILAR[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = cut(both.select("a", "b", "ma", "mb").mapInArrow(compare, "a long, b long"), "links")
    discard(texts, pairs)
    return links


def _joined(docs: DataFrame, id_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, sid, n, cid, th) and classes (cid, root, first_doc, first_sid of the root)."""
    told = measured(docs)
    mask = -1 if id_bits == 64 else (1 << id_bits) - 1
    first = F.col("d1").bitwiseAND(F.lit(mask).cast("long"))
    sets = cut(told.where("kind = 0 and n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("doc_id"), F.min("sid").alias("sid")), "classes")
    # by chance two of 10^10 sets may have one first half; there are few such halves at any size
    clash = [r[0] for r in sets.groupBy(first.alias("c")).count().where("count > 1").select("c").collect()]
    ids = Ids(mask, frozenset(clash))
    cid = F.when(first.isin(clash), F.col("d1").bitwiseXOR(F.col("d2"))).otherwise(first) if clash else first
    rows = told.where("kind = 0").select("doc_id", "sid", "n", cid.alias("cid"), "th")
    classes = sets.select(cid.alias("cid"), "n", "doc_id", "sid")
    entered = shared_entries(entries(docs, common(docs, ids), ids))
    shared = cut(counted(entered), "counted")
    discard(entered)
    links, parts = None, None
    for seed, hubs in enumerate(HUBS):
        near = settled(docs, candidates(star_product(_places(shared, parts), hubs, seed).withColumn("c", F.lit(1))), classes, ids)
        links, last = near if links is None else links.union(near), parts
        parts = cut(components(links), "parts")
        discard(*(x for x in (last,) if x is not None))
    placed = _places(shared, parts)
    # pairs that share a wide column are settled there, so the counts of all others are whole
    near = settled(docs, candidates(narrow_product(placed).withColumn("c", F.lit(1))), classes, ids)
    roots = components(links.union(near).union(wide_links(docs, placed, classes, ids)))
    rooted = classes.join(roots, classes["cid"] == roots["node"], "left").select("cid", "doc_id", "sid", F.coalesce("component", "cid").alias("root"))
    first = rooted.groupBy("root").agg(F.min("doc_id").alias("first_doc"), F.coalesce(F.min("doc_id"), F.min("sid")).alias("first_sid"))
    out = cut(rooted.join(first, "root").select("cid", "root", "first_doc", "first_sid"), "roots")
    discard(shared, parts)
    return rows, out


def jaccard_components(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row.

    A text without words has an empty set and links with nothing; so does a null text. Rows with
    equal sets are linked, repeated rows among them. A row without doc_id takes part; a component
    of such rows alone has a null component_id. An empty table gives no rows. Further columns are
    left out. ``id_bits`` is for tests.
    """
    rows, roots = _joined(docs, id_bits)
    out = rows.join(roots, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first_doc")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest doc_id; rows without words stay.

    Of several rows of a component with that doc_id one stays; rows of other components with the same
    doc_id are no part of that.
    """
    names = docs.columns
    rows, roots = _joined(docs)
    placed = cut(rows.where("n > 0").join(roots, "cid").select("sid", "th", "root", "first_sid"), "placed")
    stays = placed.where("sid = first_sid").groupBy("root", "sid").agg(F.min("th").alias("th"))
    # rows that are alone in their component stay where they are; the texts of the others are shuffled
    many = placed.groupBy("root").agg(F.count("*").alias("k")).where("k > 1")
    bitmap = marks(placed.join(many, "root", "left_semi"), F.col("sid"))
    base = docs.withColumns({"sid_": F.coalesce("doc_id", F.xxhash64(text_of())), "th_": F.xxhash64(text_of()), "wordless_": ~text_of().rlike(r"[^\x20\x09-\x0D]")})
    base = told_by(base, bitmap, F.col("sid_"), "many_")
    held = base.where("many_ and not wordless_").join(stays, (F.col("sid_") == F.col("sid")) & (F.col("th_") == F.col("th")), "left_semi").dropDuplicates(["sid_", "th_"])
    return held.unionByName(base.where("not many_ or wordless_")).select(*names)
