"""Token counts, n-gram join, decontamination, secrets, toxicity and archives."""

import base64
import bz2
import gzip
import hashlib
import io
import random
import time
import urllib.parse
import zipfile
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from grainmill.llm import bpe_count, common, decontam, ngram_join, secrets, toxicity, warc_zip
from tests.llm import helpers as h


def test_token_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    r = random.Random(1)
    odd = ["", " ", "  a", "a  b ", "\n", "a\n\nb", " \n", "x▁y", "\x00a", "</s><s>", "<0x41>", "漢字かな", "é" * 50, "ab" * 400, " " * 70, "\t x"]
    odd += ["".join(r.choice("thenigorads \n▁é") for _ in range(r.randint(1, 200))) for _ in range(200)]
    rows = h.docs(spark) + [(5000 + i, x, "en", "s", 0) for i, x in enumerate(odd)]
    got = {x["doc_id"]: x for x in bpe_count.count_tokens(h.frame(spark, rows), public.path("piece_bpe_32k.model"), 50).collect()}
    for x in rows:
        n = len(sp.encode(x[1] or ""))
        assert (got[x[0]]["n_tokens"], got[x[0]]["n_bytes"], got[x[0]]["over_limit"]) == (n, len((x[1] or "").encode()), n > 50)
    assert bpe_count.count_tokens(h.frame(spark, []), public.path("piece_bpe_32k.model")).count() == 0


def shingles(text):
    w = h.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_ngram_join(spark):
    r = random.Random(8)
    passage = h.prose(r, 30)
    rows = h.docs(spark, 40)
    for f in range(8):  # families of near copies, chains among them
        w = h.prose(r, 90).split()
        for i in range(14):
            if i % 3 == 0:
                w[r.randrange(len(w))] = f"new{f}x{i}"
            rows.append((2000 + 20 * f + i, " ".join(w), "en", "s", 0))
    rows += [(3000 + i, passage + " " + h.prose(r, r.randint(0, 60)), "en", "s", 0) for i in range(40)]
    got = ngram_join.jaccard_components(h.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sets = [shingles(x[1]) for x in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                part[root(i)] = root(j)
    want = {}
    for i, x in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        want[x[0]] = (len(sets[i]), min(ids, default=None))
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == want
    kept = [x["doc_id"] for x in ngram_join.keep_one(h.frame(spark, rows)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, {c for i, c in want.values() if i} | {k for k, (i, _) in want.items() if not i}))


def test_ngram_common_shingles_come_last(spark, monkeypatch):
    """Passages that 40 texts each hold make no wide columns where the texts' other words tell them apart."""
    r = random.Random(35)
    passages, rows, wide = [h.prose(r, 30) for _ in range(6)], [], []
    for i in range(240):
        rows.append((i, passages[i % 6] + " " + h.prose(r, 70), "en", "s", 0))
    entries = ngram_join.wide_entries

    def noted(placed):
        out = entries(placed)
        wide.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "wide_entries", noted)
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.jaccard_components(h.frame(spark, rows)).collect()}
    assert got == {x[0]: x[0] for x in rows}
    assert wide == [0]


def test_swept_cuts_leave_no_shuffle_files(spark):
    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before, rows = held(), spark.range(50_000).groupBy((F.col("id") % 7000).alias("k")).count()
    assert common.swept(rows).count() == 7000
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and spark.conf.get(common._SWEEP) == "false"


def plain_components(rows):
    """doc_id to (size of its set, smallest doc_id of its component), by comparing all pairs."""
    sets, part = [shingles(x[1]) for x in rows], list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                part[root(i)] = root(j)
    first = {}
    for i, x in enumerate(rows):
        first[root(i)] = min(first.get(root(i), x[0]), x[0])
    return {x[0]: (len(sets[i]), first[root(i)]) for i, x in enumerate(rows)}


def test_ngram_group_around_the_threshold(spark):
    """Near copies with 0 to 6 changed words of 140: some link, some do not; results equal all pairs."""
    r = random.Random(31)
    base, rows = h.prose(r, 140).split(), []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(500 + i, " ".join(base[:60]) + " " + h.prose(r, r.randint(1, 90)), "en", "s", 0) for i in range(60)]
    want = plain_components(rows)
    assert 3 < len({c for _, c in want.values()}) < 170
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.jaccard_components(h.frame(spark, rows)).collect()} == want


def test_ngram_products_are_linear(spark):
    """Two of 60 words changed: all pairs share much and few link. The products give few pairs of them."""
    r = random.Random(32)
    base = h.prose(r, 60).split()
    for m in (100, 400):
        rows = []
        for i in range(m):
            w = list(base)
            w[r.randrange(25)], w[30 + r.randrange(25)] = f"y{m}x{i}", f"z{m}x{i}"
            rows.append((i, " ".join(w), "en", "s", 0))
        docs = h.frame(spark, rows).select("doc_id", "text")
        entered = ngram_join.entries(docs, np.zeros(1 << ngram_join.SKETCH_BITS, bool), ngram_join.Ids())
        shared = ngram_join.counted(ngram_join.shared_entries(entered)).cache()
        placed = ngram_join._places(shared, None)
        star = ngram_join.star_product(placed, 2, 0).count()
        told = ngram_join.measured(docs)
        classes = told.where("kind = 0").select(F.col("d1").alias("cid"), "sid")
        narrow = ngram_join.narrow_product(placed).count()
        assert star <= 2 * shared.count() and narrow <= ngram_join.WIDE * shared.count()
        assert ngram_join.wide_entries(placed).count() <= shared.count()
        sets = [shingles(x[1]) for x in rows]  # edits at both ends leave a few pairs similar
        want = sum(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        assert ngram_join.wide_links(docs, placed, classes, ngram_join.Ids()).count() == want < m
        shared.unpersist()


def test_ngram_blocks(spark, monkeypatch):
    """Many small blocks give what one block gives: the links of all pairs that share a wide column."""
    r = random.Random(34)
    base, rows = h.prose(r, 80).split(), []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    docs = h.frame(spark, rows).select("doc_id", "text")
    told = ngram_join.measured(docs).where("kind = 0").select("doc_id", F.col("d1").alias("cid"), "sid").collect()
    of = {x["doc_id"]: x["cid"] for x in told}
    classes = spark.createDataFrame([(x["cid"], x["sid"]) for x in told], "cid long, sid long").dropDuplicates(["cid"])
    sets = {of[x[0]]: shingles(x[1]) for x in rows}
    want = sorted((a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    shared = ngram_join.counted(ngram_join.shared_entries(ngram_join.entries(docs, np.zeros(1 << ngram_join.SKETCH_BITS, bool), ngram_join.Ids())))
    assert len(want) > 30
    for block in (1 << 20, 400):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        assert sorted(map(tuple, ngram_join.wide_links(docs, ngram_join._places(shared, None), classes, ngram_join.Ids()).collect())) == want


def test_clashing_class_ids(spark):
    """First halves of digests that different sets share are told apart by the second halves."""
    r = random.Random(33)
    rows = [(i, h.prose(r, 30), "en", "s", 0) for i in range(60)] + [(100, "", "en", "s", 0)]
    rows += [(200 + i, rows[i][1], "en", "s", 0) for i in range(20)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.jaccard_components(h.frame(spark, rows), id_bits=4).collect()}
    assert got == plain_components(rows)


def test_keep_one_of_repeated_ids(spark):
    """Rows of one doc_id in different components: each component keeps its row."""
    r = random.Random(21)
    texts = [h.prose(r, 60) for _ in range(6)]
    rows = [(1, x, "en", "s", 0) for x in texts] + [(1, texts[0], "en", "s", 0), (1, texts[0] + " more", "en", "s", 0), (2, texts[1], "en", "s", 0)]
    kept = [(x["doc_id"], x["text"]) for x in ngram_join.keep_one(h.frame(spark, rows)).collect()]
    first = [x for x in kept if x[1].startswith(texts[0])]
    assert len(first) == 1 and sorted(x for x in kept if x not in first) == sorted((1, x) for x in texts[1:])


def test_keep_one_shuffles_no_rows_that_are_alone(spark, monkeypatch):
    told, told_by = [], ngram_join.told_by
    monkeypatch.setattr(ngram_join, "told_by", lambda *a: told.append(told_by(*a)) or told[-1])
    r = random.Random(3)
    rows = [(i, h.prose(r, 40), "en", "s0", 0) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s0", 0) for i in range(3)] + [(200, rows[5][1] + " more", "en", "s0", 0), (300, "", "en", "s0", 0)]
    docs = h.frame(spark, rows).withColumn("word", F.lit("clash"))
    assert sorted(x["doc_id"] for x in ngram_join.keep_one(docs).collect()) == [*range(40), 300]
    assert sorted(x["doc_id"] for x in told[0].where("many_").collect()) == [0, 1, 2, 5, 100, 101, 102, 200]


def test_ngram_empty(spark):
    assert ngram_join.jaccard_components(h.frame(spark, [])).count() == 0


def edits(item, text):
    """Fewest edits of the item anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    r = random.Random(5)
    items = [(i, h.prose(r, r.randint(12, 30)).capitalize()) for i in range(12)] + [(90, None), (91, ""), (92, "tiny")]
    index = decontam.build_index(items)
    rows = h.odd_rows() + [(200, "xx tiny yy", "en", "s", 0)]
    for i, text in items[:12]:
        for k in range(8):
            s = list(text)
            for _ in range(k):
                p = r.randrange(len(s))
                s[p : p + 1] = r.choice([[], ["q"], [s[p], "w"]])
            rows.append((300 + 10 * i + k, h.prose(r, 20) + " " + "".join(s).upper() + "\t" + h.prose(r, 20), "en", "s", 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontam.matches(h.frame(spark, rows), bench).collect()}
    budget = dict(zip(index.ids, index.budget.tolist()))
    fold = lambda t: "".join(map(chr, decontam.fold(t or "")))
    for x in rows:
        for i, text in items:
            if not text:
                assert (x[0], i) not in got
            elif i == 92:
                assert ((x[0], i) in got) == (fold(text) in fold(x[1]))
            else:
                near = edits(fold(text), fold(x[1])) if x[1] and len(x[1]) < 1000 else 999
                assert ((x[0], i) in got) == (near <= budget[i])
                if (x[0], i) in got:
                    assert got[x[0], i]["edits"] >= near
    clean = {x["doc_id"] for x in decontam.decontaminate(h.frame(spark, rows), bench).collect()}
    assert clean == {x[0] for x in rows} - {d for d, _ in got}
    assert decontam.matches(h.frame(spark, []), bench).count() == 0
    assert decontam.matches(h.frame(spark, rows), bench.limit(0)).count() == 0


def test_benchmark_blocks(spark):
    bench = spark.createDataFrame([(i, "item %d" % i * 20) for i in range(50)], "item_id long, text string")
    parts = list(decontam.blocks(bench, 2000))
    assert len(parts) > 2 and sorted(i for p in parts for i, _ in p) == list(range(50))


def test_secrets(spark):
    secret = 'api_key = "Zk9fQ2mP0xYv"'
    deep = base64.b64encode(urllib.parse.quote(secret).encode()).decode()
    packed = base64.b64encode(gzip.compress(b"padding password: hunter22 more " * 3)).decode()
    escaped = "".join(f"\\u{ord(c):04x}" for c in "token=abcdef12")
    texts = ["token=token:abcdefgh", "Secret: 'abc'", "PASSWD=abcdef AKIA" + "A" * 16 + " " + "0a" * 12, "é token: " + "f" * 30, "pre " + deep + " post", "x " + packed, "y " + escaped + " z", "%74%6f%6b%65%6e%3Dsecret99", "ſecret=abcdefgh"]
    rows = h.odd_rows() + [(10 + i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x for x in secrets.scan_secrets(h.frame(spark, rows)).collect()}
    base = {10 + i: secrets.joined(secrets.scan(t)[0]) for i, t in enumerate(texts)}
    assert base[10] == base[11] == "" and base[12] == "assign:0:13,access:14:34,hex:35:59"
    assert base[13] == f"assign:2:{9 + 30},hex:9:{9 + 30}" and base[18] == ""
    for k, v in base.items():
        assert got[k]["base_sha256"] == hashlib.sha256(v.encode()).hexdigest() and set(filter(None, v.split(","))) <= set(got[k]["spans"].split(","))
    a, b = got[14]["spans"].split(":")[1:3]
    assert int(a) >= 4 and int(b) <= 4 + len(deep) and got[14]["n_assign"] == 0
    assert got[15]["spans"] == f"assign:2:{2 + len(packed.rstrip('='))}" or got[15]["spans"] == f"assign:2:{2 + len(packed)}"
    assert got[16]["spans"] == f"assign:2:{2 + len(escaped)}" and got[17]["spans"].startswith("assign:0:")
    assert got[None]["spans"] == "" and got[None]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.scan_secrets(h.frame(spark, [])).count() == 0


def test_secrets_in_damaged_and_wrapped_layers(monkeypatch):
    secret, r = b"token=abcdef1234 ", random.Random(4)
    noise = h.prose(r, 300).encode()
    found = lambda text: [x for x in secrets.scan(text)[1] if x[1] == 0]
    b64 = lambda raw: base64.b64encode(raw).decode()
    packed = gzip.compress(noise[:200] + secret + noise)
    assert found("x " + b64(gzip.compress(secret + noise)[:-200]) + " y")  # no trailer
    assert found("x " + b64(gzip.compress(noise) + gzip.compress(secret)) + " y")  # second member
    lines = base64.encodebytes(packed).decode()
    assert "\n" in lines.strip() and found("see:\n" + lines + "\nThe end") and found("see:\n" + lines.rstrip("=\n") + "\nThe end")
    assert found(base64.encodebytes(noise[:50] + b" " + secret + noise).decode())  # across a line break
    for codec in (gzip.compress, zlib.compress, bz2.compress):
        raw = codec(secret + noise)
        for text in (urllib.parse.quote(raw), "".join(f"%{c:02x}" for c in raw), "".join(f"\\x{c:02x}" for c in raw), repr(raw)[2:-1]):
            assert found("a " + text + " b"), (codec, text[:40])
    monkeypatch.setattr(secrets, "MOST_INFLATED", 1000)
    monkeypatch.setattr(secrets, "AGAIN", 100)
    assert found(b64(gzip.compress(b"word " * 990 + secret + b"word " * 990)))  # beyond the bound
    assert found(b64(bz2.compress(b"word " * 990 + secret + b"word " * 990)))


WRAPPERS = {
    "base64": lambda raw: base64.b64encode(raw).decode(),
    "url": lambda raw: base64.urlsafe_b64encode(raw).decode().rstrip("="),
    "lines": lambda raw: base64.encodebytes(raw).decode().strip(),
    "utf16": lambda raw: base64.b64encode(raw.decode().encode("utf-16-le")).decode(),
    "gzip": lambda raw: base64.b64encode(gzip.compress(raw)).decode(),
    "bzip2": lambda raw: base64.b64encode(bz2.compress(raw)).decode(),
    "deflate": lambda raw: base64.b64encode(zlib.compress(raw, 9)[2:-4]).decode(),
    "quoted zlib": lambda raw: "".join(f"%{c:02X}" for c in zlib.compress(raw)),
    "percent": lambda raw: "".join(f"%{c:02x}" for c in raw),
    "hex": lambda raw: "".join(f"\\x{c:02x}" for c in raw) if raw.isascii() else urllib.parse.quote(raw),
    "unicode": lambda raw: "".join(f"\\u{ord(c):04x}" for c in raw.decode()),
    "entities": lambda raw: "".join(f"&#{ord(c)};" for c in raw.decode()),
}


def test_secrets_in_nested_layers():
    """A secret wrapped up to five times, with other text around every layer: one span, within the outermost wrapping."""
    r = random.Random(61)
    for k in range(400):
        text, chain = f"{h.prose(r, 4)} api_key = 'Zk9{r.randrange(10**6)}fQ' {h.prose(r, 3)}", []
        for _ in range(r.randint(1, 5)):
            name = r.choice(list(WRAPPERS))
            inner, before = WRAPPERS[name](text.encode()), h.prose(r, 3) + " é "
            text = f"{before}{inner} {h.prose(r, 2)}"
            chain.append(name)
            if len(text) > 60_000:
                break
        a, b = len(before), len(before) + len(inner)
        base, every = secrets.scan(text)
        assert base == [] and every and all(a <= x and y <= b and kind == 0 for x, kind, y in every), (k, chain)


def test_secrets_in_escapes_map_exactly():
    """Escapes of every character, in any order: a character's place is known by the widths alone."""
    r, secret = random.Random(62), "token=abcdef12"
    widths = {"percent": 3, "hex": 4, "unicode": 6}
    for _ in range(50):
        chain, text = [r.choice(list(widths)) for _ in range(r.randint(1, 4))], "so " + secret
        for name in chain:
            text = WRAPPERS[name](text.encode())
        each = 1
        for name in chain:
            each *= widths[name]
        assert secrets.scan(text)[1] == [(3 * each, 0, (3 + len(secret)) * each)]


def test_secrets_of_great_depth():
    """Thirty layers with an escape beside each, and an archive that holds itself many times: layers do not multiply."""
    text = "token=abcdef1234"
    for _ in range(30):
        text = "%41 " + base64.b64encode(text.encode()).decode()
    began = time.process_time()
    assert len(secrets.scan(text)[1]) == 1 and time.process_time() - began < 5
    text = "token=abcdef1234"
    for i in range(24):
        text = base64.b64encode(text.encode()).decode() if i % 2 else "%41" + text
    assert len(secrets.scan(text)[1]) == 1
    assert secrets.scan("%" * 1000 + "%41" * 1000 + "A" * 100_000)[0] == []


def segments(scores):
    """All maximal segments by their definition: recursively the best, then what is left and right of it."""
    best = max(((sum(scores[i : j + 1]), -i, -j) for i in range(len(scores)) for j in range(i, len(scores))), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    i, j = -best[1], -best[2]
    return segments(scores[:i]) + [(i, j, best[0])] + [(a + j + 1, b + j + 1, s) for a, b, s in segments(scores[j + 1 :])]


def test_segments():
    r = random.Random(3)
    for _ in range(200):
        hits = {i: r.uniform(0.1, 3) for i in range(25) if r.random() < 0.3}
        want = [(a, b, round(s, 9)) for a, b, s in segments([hits.get(i, -0.7) for i in range(25)])]
        assert [(a, b, round(s, 9)) for a, b, s in toxicity.segments(sorted(hits.items()), 0.7)] == want


def test_toxicity(spark):
    r = random.Random(7)
    rows, labels = h.docs(spark, 0), []
    for i in range(600):
        w, bad = h.prose(r, r.randint(20, 80)).split(), i % 5 == 0
        if bad:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["idiot", "moron", "scum"])
        rows.append((i, " ".join(w), "en", "s", 0))
        labels += [(i, 1, int(bad)), (i, None, None)] if i % 2 == 0 else []
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.rate_toxicity(h.frame(spark, rows), table, True).collect()}
    import zlib

    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in got.items() if i is not None)
    hit = sum(got[i]["predicted"] == (i % 5 == 0) for i in range(600))
    assert hit > 590 and all(0 <= x["score"] <= 1 for x in got.values())
    assert got[0]["passages"] and not got[1]["passages"] and got[1000]["score"] == got[None]["score"]
    assert toxicity.rate_toxicity(h.frame(spark, []), table).count() == 0
    assert {x["score"] for x in toxicity.rate_toxicity(h.frame(spark, rows), table.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("zip64", [False, True])
def test_archives(spark, tmp_path, zip64):
    pages = [(3, "http://a/", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (2, None, None), (5, "http://c/\r\nX: y", ""), (4, "u", "x" * 100_000), (None, "n", "only"), (1, "http://b/", "<p>é</p>"), (7, "q", "<p>é</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'c' AS digest", "9 AS refers_to")
    got = sorted(((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in warc_zip.warc_round_trip(df, zip64).collect()), key=str)
    first = {}
    for i, _, t in pages:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    want = []
    for i, _, t in pages:
        raw = (t or "").encode()
        copy = i is not None and first[t or ""] != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if copy else "response", first[t or ""] if copy else None))
    assert got == sorted(want, key=str)
    where = f"file://{tmp_path}/w"
    packed = warc_zip.write_packages(df.coalesce(1), where, zip64)
    records = 0
    for x in packed.collect():
        with zipfile.ZipFile(x["path"]) as z:  # another reader agrees
            assert z.testzip() is None and z.read(warc_zip.DATA)[:2] == b"\x1f\x8b"
            found = gzip.GzipFile(fileobj=io.BytesIO(z.read(warc_zip.DATA))).read().count(b"WARC/1.1")
            assert found == x["records"]
            records += found
    assert records == len(pages)
    payloads = {x["page_id"]: x["payload"] for x in warc_zip.read_packages(packed, where, True).collect()}
    assert bytes(payloads[4]) == b"x" * 100_000
    assert warc_zip.warc_round_trip(df.limit(0)).count() == 0


def test_archives_of_many_revisits(spark):
    """With more revisits than are broadcast, bitmaps tell them from responses; small ones leave some to the join."""
    r = random.Random(51)
    pages = [(i, f"u{i}", f"<p>{r.randrange(150)}</p>" if i % 3 else h.prose(r, 5)) for i in range(600)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    first = {}
    for i, _, t in pages:
        first.setdefault(t, i)
    want = {i: ("response", None) if first[t] == i else ("revisit", first[t]) for i, _, t in pages}
    for bits in (1 << 29, 1 << 9):
        got = warc_zip.warc_round_trip(df, most_broadcast=5, most_bits=bits).collect()
        assert len(got) == 600 and {x["page_id"]: (x["record_type"], x["refers_to"]) for x in got} == want


def test_deflated_members_are_refused():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc_zip.DATA, b"a" * 1000)
        z.comment = b"PK\x05\x06 a comment that looks like an end"
    data = buffer.getvalue()
    package = warc_zip.ZipRanges(lambda at, n: data[at : at + n], len(data))
    assert package.members[warc_zip.DATA].size == 1000
    with pytest.raises(ValueError):
        package.data_offset(warc_zip.DATA)
