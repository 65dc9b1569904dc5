"""Mixing, sharding, quality rules and line deduplication against plain Python."""

import math
import os
import random
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from grainmill.llm import line_dedup, mixing, quality, sharding
from tests.llm import helpers as h


def test_mixing(spark):
    rows = h.docs(spark, 200)
    got = mixing.mix_sizes(h.frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((x[0], len(h.words(x[1]))) for x in rows)
    size = Counter()
    for x in rows:
        size[x[3]] += len(h.words(x[1]))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, budget = {}, set(order), 1.5 * sum(size.values())
    while open_:  # fill, cap, share again
        share = {s: budget * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            budget -= target[s]
        open_ -= over
    source = {x[0]: x[3] for x in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == size[s] and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in order if s in ("s0", "s1", "s2") and size[s] > 6000)
    again = mixing.mix_sizes(h.frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    copies = Counter(r["doc_id"] for r in mixing.mix_documents(h.frame(spark, rows)).collect())
    assert all(copies[r["doc_id"]] * r["size"] == r["taken"] for r in got if r["size"] and r["doc_id"] not in (None, 1005))
    assert mixing.mix_sizes(h.frame(spark, [])).count() == 0


def test_sharding(spark):
    rows = h.docs(spark, 400)
    got = sharding.shard(h.frame(spark, rows), shards=16).collect()
    assert len(got) == len(rows)
    text = {x[0]: x[1] or "" for x in rows}
    total, slots, where = Counter(), defaultdict(list), {}
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert where.setdefault(raw, r["shard"]) == r["shard"]
    assert set(total) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(total.values()) / 16
    assert all(abs(total[s] - mean) <= 2600 for s in range(16))  # half of the longest text
    assert sharding.shard(h.frame(spark, []), shards=4).count() == 0


def naive_quality(text):
    w = h.words(text)
    lines = [x for x in (text or "").split("\n") if h.WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    r = random.Random(4)
    rows = h.docs(spark, 260, 9)
    rows += [(2000, "a b c d e f g h i " * 5, "en", "s0", 0), (2001, "x\ny\nx\n \n \nz " + h.prose(r, 40), "en", "s1", 0), (2002, " ".join(x + "***" for x in h.prose(r, 60).split()), "en", "s0", 0), (2003, "é ü # $ <b> " + h.prose(r, 30), "en", "s0", 0), (2004, h.prose(r, 8) + " q " + h.prose(r, 3), "en", "s0", 0)]
    got = quality.rate_quality(h.frame(spark, rows)).collect()
    text = {x[0]: x[1] for x in rows}
    assert len(got) == len(rows)
    for x in got:
        want = naive_quality(text[x["doc_id"]])
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert x["base_failed"] == failed and not (failed and x["kept"])
    kept = {x["doc_id"]: x["kept"] for x in got}
    assert not kept[2002] and kept[2003]
    plain = [i for i in range(260) if len(h.words(text[i])) >= 20]
    assert sum(kept[i] for i in plain) >= 0.98 * len(plain)
    assert quality.keep_good(h.frame(spark, rows)).count() == sum(kept[x[0]] for x in rows)
    assert quality.rate_quality(h.frame(spark, [])).count() == 0


def plain_mcd(groups):
    """group -> (mean, covariance) of smallest determinant, by concentration steps from three starts."""
    floors = np.array(quality.FLOORS)
    at = lambda v, p: np.sort(v, 0)[math.ceil(p * len(v)) - 1]
    cov = lambda x: np.cov(x.T, bias=True).reshape(5, 5) if len(x) > 1 else np.zeros((5, 5))
    out = {}
    for g, x in groups.items():
        med = at(x, 0.5)
        wide = np.maximum(1.4826 * at(np.abs(x - med), 0.5), floors)
        z = (x - med) / wide
        signs = z / np.sqrt(np.maximum((z * z).sum(1), 1e-12))[:, None] * wide
        best = None
        for mu, c in ((med, np.diag(wide**2)), (x.mean(0), cov(x)), (med, 5 * signs.T @ signs / len(x))):
            last = math.inf
            while True:
                inv = np.linalg.inv(c + np.diag(floors**2))
                d = np.einsum("ij,jk,ik->i", x - mu, inv, x - mu)
                near = x[d <= at(d, quality.SUPPORT)]
                mu, c = near.mean(0), cov(near)
                det = np.linalg.slogdet(c + np.diag(floors**2))[1]
                if det >= last - quality.SETTLED:
                    break
                last = det
            if best is None or det < best[0]:
                best = det, mu, c
        out[g] = best[1:]
    return out


def test_kept_texts_are_not_copied(spark, monkeypatch):
    cuts, cut = [], quality.cut
    monkeypatch.setattr(quality, "cut", lambda df, what="cut": cuts.append(df.columns) or cut(df, what))
    docs = h.frame(spark, h.docs(spark, 30))
    rated = {(x["doc_id"], x["kept"]) for x in quality.rate_quality(docs).collect()}
    cuts.clear()
    assert sorted(x["doc_id"] for x in quality.keep_good(docs).distinct().collect()) == sorted(i for i, kept in rated if kept)
    assert cuts and not [c for c in cuts if "text" in c]


def test_outliers_by_minimum_covariance_determinant(spark):
    """The verdict equals a numpy version's, also for groups of one to thirty rows; null and '' are two groups."""
    r = random.Random(41)
    rows = []
    for lang, source, n in (("en", "a", 150), ("en", "b", 30), ("de", "a", 5), ("fr", None, 1), ("fr", "", 12), (None, "*", 3), ("", "*", 40)):
        for i in range(n):
            w = h.prose(r, r.randint(25, 60)).split()
            if i % 9 == 4:
                w = [x * r.randint(1, 4) + "#" * r.randint(0, 3) for x in w]
            if i % 7 == 2:
                w = [x.upper() * 2 for x in w]
            rows.append((len(rows), " ".join(w) + "\n" + " ".join(w[: r.randint(0, 3)]), lang, source, 0))
    stats = quality.with_statistics(h.frame(spark, rows)).select("doc_id", "lang", "source", quality._vector().alias("v"), F.expr(quality.BASE_FAILED).alias("f")).collect()
    groups = defaultdict(list)
    for x in stats:
        if not x["f"]:
            groups[x["lang"], x["source"]].append(x["v"])
    groups = {g: np.array(v) for g, v in groups.items()}
    assert len(groups) == 7
    found = plain_mcd(groups)
    n = sum(map(len, groups.values()))
    mu0, c0 = (sum(found[g][i] * len(x) for g, x in groups.items()) / n for i in (0, 1))
    want = {}
    for g, x in groups.items():
        k, s = len(x), quality.SHRINK
        mu, c = (found[g][0] * k + mu0 * s) / (k + s), (found[g][1] * k + c0 * s) / (k + s)
        inv = np.linalg.inv(c + np.diag(np.array(quality.FLOORS) ** 2))
        d = np.einsum("ij,jk,ik->i", x - mu, inv, x - mu)
        scale = max(1.0, np.sort(d)[math.ceil(0.5 * k) - 1] / quality.CHI_MEDIAN)
        ids = [y["doc_id"] for y in stats if (y["lang"], y["source"]) == g and not y["f"]]
        want |= dict(zip(ids, (d / scale <= quality.CUT).tolist()))
    got = {x["doc_id"]: x["kept"] for x in quality.rate_quality(h.frame(spark, rows)).collect()}
    assert got == {x["doc_id"]: want.get(x["doc_id"], False) for x in stats}
    assert 5 < sum(not k for k in want.values()) < 100


def test_lines(spark):
    r = random.Random(2)
    long = [h.prose(r, 60) for _ in range(20)]
    rows = [(i, "\n".join([h.prose(r, 12), long[i % 20], "Copied line: 12", "***"]), "en", "s", 0) for i in range(40)]
    near = long[0].split()
    rows.append((100, "start\n" + " ".join(near[:30] + near[31:]) + "\nCOPIED  line 99", "en", "s", 0))
    rows += h.odd_rows()
    got = {x["doc_id"]: x for x in line_dedup.report_lines(h.frame(spark, rows)).collect()}
    assert got[0]["dropped"] == [] and got[0]["n_lines"] == 4
    assert all(got[i]["dropped"] == ([2] if i < 20 else [1, 2]) for i in range(1, 40))
    assert 2 in got[100]["dropped"]
    assert got[None]["n_dropped"] == 0 and got[None]["n_lines"] == 0
    texts = {x["doc_id"]: x["text"] for x in line_dedup.dedupe_lines(h.frame(spark, rows)).collect()}
    assert texts[25] == "\n".join(rows[25][1].split("\n")[::3]) and texts[1001] is None
    assert line_dedup.report_lines(h.frame(spark, [])).count() == 0


def similar_groups(texts):
    """Groups of two and more of distinct texts linked by edit similarity, found by comparing all pairs."""
    part = {x: x for x in texts}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            most = max(len(a), len(b)) // 5
            if abs(len(a) - len(b)) <= most and root(a) != root(b) and edit_distance(a, b) <= most:
                part[max(root(a), root(b))] = min(root(a), root(b))
    want = defaultdict(list)
    for x in texts:
        want[root(x)].append(x)
    return sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_fuzzy_lines(spark):
    """Near copies of a few lines by changed words, linked in chains and apart: groups are those of all pairs."""
    r = random.Random(6)
    base = [h.prose(r, 40) for _ in range(4)]
    texts = set()
    for i in range(48):
        w = base[i % 4].split()
        for _ in range(r.choice([0, 1, 2, 7, 9])):
            w[r.randrange(len(w))] = "zz" + "".join(r.choices("abcdef", k=r.randint(1, 9)))
        texts.add(" ".join(w))
    want = similar_groups(sorted(texts))
    assert 3 <= len(want) and grouped(spark, sorted(texts)) == want


def test_a_common_word_pair_gives_no_square(spark):
    """Lines that share nothing but a word pair stay apart, and near copies among them are found."""
    r = random.Random(16)
    texts = [f"{h.prose(r, 9)} international organisation {h.prose(r, 9)}" for _ in range(300)]
    texts += [" ".join([*x.split()[:-1], "changed"]) for x in texts[:20]]
    told = line_dedup.told_lines(h.frame(spark, [(i, x, "en", "s", 0) for i, x in enumerate(texts)]))
    per = line_dedup.sharing(line_dedup.distinct_lines(told))
    none = spark.createDataFrame([], "node long, component long")
    assert line_dedup._all_pairs(line_dedup._mixed(per, none)).count() < 20 * len(texts)
    assert sum(map(len, grouped(spark, texts))) == 40


def test_recall_of_lines(spark):
    """At least 0.9 of the pairs of edit similarity 0.8 with changed words, for lines of 1 to 200 words."""
    r, pairs = random.Random(17), defaultdict(list)
    for n in (1, 2, 4, 8, 15, 30, 60, 120, 200):
        for _ in range(30):
            w = [x + y for x, y in zip(h.prose(r, n).split(), h.prose(r, n).split())]
            v = list(w)
            for p in r.sample(range(n), max(1, r.choice([n // 20, n // 10, n // 6]))):
                v[p] = v[p][:-1] + "q" if n < 6 else "".join(r.choices("abcdef", k=len(v[p])))
            a, b = " ".join(w), " ".join(v)
            if a != b and edit_distance(a, b) <= max(len(a), len(b)) // 5:
                pairs[n].append((a, b))
    of = {x: i for i, g in enumerate(grouped(spark, sorted({x for ps in pairs.values() for p in ps for x in p}))) for x in g}
    for n, found in pairs.items():
        assert len(found) > 10 and sum(of.get(a, -1) == of.get(b, -2) for a, b in found) >= 0.9 * len(found), n


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def grouped(spark, texts):
    """The groups of line_groups over one line a row, as sets of normalised lines."""
    docs = h.frame(spark, [(i, x, "en", "s", 0) for i, x in enumerate(texts)])
    distinct = line_dedup.distinct_lines(line_dedup.told_lines(docs))
    norm = line_dedup.texts(docs, distinct, distinct)
    out = defaultdict(set)
    for x in line_dedup.line_groups(docs, distinct).join(norm, F.col("node") == F.col("id")).select("component", "norm").collect():
        out[x["component"]].add(x["norm"])
    return sorted(map(sorted, out.values()))


def test_lines_by_edit_similarity(spark):
    """Changed words and short lines: the groups are those of edit similarity alone, over all pairs."""
    r = random.Random(8)
    made = set()
    for n in (1, 2, 3, 4, 5, 7, 10, 15, 20, 30):
        for _ in range(3):
            w = h.prose(r, n).split()
            made.add(" ".join(w))
            for _ in range(2):
                v = list(w)
                for p in r.sample(range(n), max(1, n // 8)):
                    v[p] = v[p][:-1] + "q" if n < 5 else "zq" + r.choice("abcdef")
                made.add(" ".join(v))
    made |= {"token", "tokens", "broken", "abcd", "abcde", "abxde"}
    want = similar_groups(sorted(made))
    assert len(want) > 15 and grouped(spark, sorted(made)) == want


def test_very_long_lines(spark):
    """Every 20th word changed: edit similarity of about 0.95 at any length."""
    w = h.prose(random.Random(12), 2200).split()
    v = ["zq" if i % 20 == 7 else x for i, x in enumerate(w)]
    assert len(" ".join(w)) > 9000 and grouped(spark, [" ".join(w), " ".join(v)]) == [sorted([" ".join(w), " ".join(v)])]


def test_lines_of_one_word(spark):
    """A word repeated 100, 85 and 70 times: only neighbours are similar, and all are one group."""
    words = ["alpha", "bravo", "delta", "gamma", "omega", "sigma"]
    texts = [" ".join([x] * n) for x in words for n in (100, 85, 70)]
    assert grouped(spark, texts) == [sorted(" ".join([x] * n) for n in (100, 85, 70)) for x in words]


def test_lines_of_one_crowded_bucket_meet(spark):
    """Lines whose only common bucket holds more than CROWD lines are compared, as far as their lengths allow."""
    n = line_dedup.CROWD + 8
    per = spark.range(n).selectExpr("id", "if(id = 0, 90, 60) AS size", f"array(named_struct('df', {n}L, 'bucket', 7L, 'hub', 0L, 'exact', false)) AS shared")
    none = spark.createDataFrame([], "node long, component long")
    crowded = line_dedup._crowded(per, none)
    assert crowded.count() == n
    assert line_dedup._all_pairs(crowded).count() == (n - 1) * (n - 2) // 2


def test_lines_are_verified_in_blocks(spark, monkeypatch):
    """Pairs dealt into blocks give the links of one block, and what their shuffles wrote goes with them."""
    r, written = random.Random(21), []
    base = [h.prose(r, 40) for _ in range(6)]
    texts = sorted({" ".join([*x.split()[:i], "zz", *x.split()[i + 1 :]]) for x in base for i in range(0, 30, 3)})
    held = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    pairs = spark.range(len(texts)).selectExpr("id AS a").crossJoin(spark.range(len(texts)).selectExpr("id AS b")).where("a < b")
    files = lambda: set(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split())
    cut = line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df, what: [written.append(what), cut(df, what)][1])
    whole = {tuple(x) for x in line_dedup.verified(pairs, held).collect()}
    assert written.count("links") == 1 and len(whole) >= 6 * 45
    monkeypatch.setattr(line_dedup, "BLOCK", 1)
    before = files()
    dealt = line_dedup.verified(pairs, held)
    left = [x for x in files() - before if "/shuffle_" in x]
    for _ in range(50):
        left = [x for x in left if os.path.exists(x)]
        if not left:
            break
        time.sleep(0.1)
    assert written.count("links") > 10 and not left
    assert {tuple(x) for x in dealt.collect()} == whole and dealt.count() == len(whole)


def test_lines_are_normalised_once(spark):
    """Lines without letters and digits go before any line is normalised, whatever signs they hold."""
    signs = ["-", "Ⓐ", "Ⅻ", "²", "İ", "̇", "_", "٣", "ß!", " \t", "𝔸", "¼", "ª", "漢"]
    found = line_dedup.lines(spark.createDataFrame([(0, "\n".join(signs))], "doc_id long, text string"))
    assert [signs[x["line_no"]] for x in found.collect()] == [x for x in signs if any(c.isalpha() or unicodedata.category(c)[0] == "N" for c in x)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "regexp_replace" in x]


def test_giant_lines_are_compared_without_their_ends(spark):
    """Giant lines are told alike as by the whole distance; of a line that lost a passage nothing is left to compare."""
    r, pairs = random.Random(41), []
    for _ in range(400):
        a = "".join(r.choices("abü", k=r.randint(0, 40)))
        b = list(a)
        for _ in range(r.randint(0, 9)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 2)] = r.choices("abü", k=r.randint(0, 2))
        pairs.append((a, "".join(b)))
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup._giants_within(a, b, line_dedup.most_edits(F.length(a), F.length(b))).alias("near")).collect()
    assert [x["near"] for x in got] == [edit_distance(x["a"], x["b"]) <= max(len(x["a"]), len(x["b"])) // 5 for x in got]
    assert 50 < sum(x["near"] for x in got) < 350
    long = h.prose(random.Random(42), 50_000)
    lost = spark.createDataFrame([(long, long[:90_000] + long[110_000:])], "a string, b string").cache()
    lost.count()
    begin = time.time()
    assert lost.where(line_dedup.similar(a, b)).count() == 1
    assert time.time() - begin < 10
