import random

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import settings
from hypothesis import strategies as st

from grainmill.functions import kernels
from grainmill.operators import analysis, filters, gate, index, quality, search
from grainmill.operators.arrow import grams, minimizers
from grainmill.plans import queries
from grainmill.sources import chunks as sources
from tests import naive

EDGES = [b"", b"a", b"abcdefg", b"abcdefgh", b"abcdefghijklmno", b"abcdefghijklmnop", b"A" * 64, bytes(range(256)), "é ß ñ".encode() * 5, b"x" * 31, b"ba", b"ab" * 300, b"ab" * 300]


def frame(spark, data, names="chunk_id long, data binary"):
    return spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], names)


def corpus(seed=5, n=60):
    r = random.Random(seed)
    words = [bytes(r.choices(b"abcdefghij", k=r.randint(2, 6))) for _ in range(200)]
    return [b" ".join(r.choices(words, k=r.randint(5, 80))) for _ in range(n)]


@given(st.binary(max_size=120), st.integers(4, 12), st.integers(1, 20), st.sampled_from(["self", "empty"]))
@settings(max_examples=150, deadline=None)
def test_kernels(data, q, w, short):
    array = np.frombuffer(data, np.uint8)
    assert kernels.gram_crcs(array, q).tolist() == naive.keys(data, q)
    assert set(kernels.minimizers(array, q, w, short).tolist()) == naive.minimizers(data, q, w, short)
    assert kernels.rolling_hashes(array, q).tolist() == naive.rolling(data, q)
    assert kernels.entropy(np.bincount(array, minlength=256)) == pytest.approx(naive.entropy(data), abs=1e-8)


@given(st.lists(st.integers(0, 10**9), unique=True).map(sorted))
def test_codecs(ids):
    assert kernels.get_deltas(kernels.put_deltas(ids), 0)[0] == ids
    small = sorted({i % 80 for i in ids})
    assert kernels.mask_to_blocks(kernels.blocks_to_mask(small, 10)) == small


@given(st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_key_order(a, b):
    assert (kernels.key64(a) < kernels.key64(b)) == (a < b)


def test_analyses(spark):
    c = frame(spark, EDGES)
    whole = b"".join(EDGES)
    top = [(r["byte"], r["count"]) for r in analysis.byte_frequency(c, 5).collect()]
    order = sorted(set(whole), key=lambda b: (-whole.count(b), whole.index(b)))
    assert top == [(b, whole.count(b)) for b in order[:5]]
    assert {r[0]: r[1] for r in analysis.chunk_entropy(c).collect()} == pytest.approx({i: naive.entropy(d) for i, d in enumerate(EDGES)}, abs=1e-8)
    want = sorted(h for d in EDGES for h in naive.rolling(d, 32))[:50]
    assert [r["hash"] for r in analysis.signature(c, 50).orderBy("rank").collect()] == [f"{h:016x}" for h in want]
    profile = [r["value"] for r in analysis.entropy_profile(c, 64).orderBy("slot").collect()]
    assert len(profile) == 64 and profile[len(EDGES) :] == [0.0] * (64 - len(EDGES)) and max(profile) == 1.0
    assert [r["value"] for r in analysis.entropy_profile(c, 4).orderBy("slot").collect()] == pytest.approx([profile[i * len(EDGES) // 4] for i in range(4)])
    same = analysis.compare(c, c).first()
    assert (same["jaccard"], same["l2"], same["similarity"]) == (1.0, 0.0, 1.0)
    short = frame(spark, [b"abc"])
    assert analysis.compare(short, short).first()["similarity"] == pytest.approx(0.3)


def test_empty(spark):
    none = frame(spark, [])
    assert analysis.byte_frequency(none).count() == 0
    assert analysis.entropy_profile(none).count() == 0
    assert analysis.signature(none).count() == 0
    assert index.postings(none).count() == 0
    assert index.df_stats(index.bounded_postings(none)).first()["median_df"] is None
    assert sources.chunks_fixed(none, 10).count() == 0


def test_rechunk(spark):
    c = frame(spark, EDGES)
    whole = b"".join(EDGES)
    got = [bytes(r["data"]) for r in sources.chunks_fixed(c, 100).orderBy("chunk_id").collect()]
    assert got == [whole[i : i + 100] for i in range(0, len(whole), 100)]


@pytest.mark.parametrize("short", ["self", "empty"])
def test_minimizers(spark, short):
    got = {}
    for r in minimizers(frame(spark, EDGES), 8, 8, short).collect():
        got.setdefault(r["chunk_id"], set()).add(r["crc"])
    assert got == {i: m for i, d in enumerate(EDGES) if (m := naive.minimizers(d, 8, 8, short))}
    assert grams(frame(spark, EDGES)).count() == sum(max(0, len(d) - 7) for d in EDGES)


@pytest.mark.parametrize("df_max,block,most_chunks", [(3, 4, 60), (1, 64, 60), (30, 16, 60)])
def test_search(spark, df_max, block, most_chunks):
    data = corpus(n=most_chunks)
    post = {}
    for i, d in enumerate(data):
        for k in naive.minimizers(d, 8, 8, "self"):
            post.setdefault(k, []).append(i)
    b = {k: v for k, v in post.items() if len(v) <= df_max}
    c = {k: {i // block for i in v} for k, v in post.items() if len(v) > df_max}
    queries = [data[3][5:60], data[40][:20], b"nothing at all here", b"", data[7]]
    rows = index.postings(frame(spark, data), index.Policy(df_max=df_max, block_size=block)).cache()
    q = frame(spark, queries, "qid long, q binary")
    told = {r["qid"]: r for r in search.l0_summary(q, rows, len(data), block_size=block).collect()}
    found = {}
    for r in search.l0_search(q, rows, len(data), block_size=block).collect():
        found.setdefault(r["qid"], set()).add(r["chunk_id"])
    for i, text in enumerate(queries):
        method, source, total, near = naive.search(naive.minimizers(text, 8, 8, "self"), b, c, len(data), block)
        assert (told[i]["method"], told[i]["best_source"], told[i]["anchors_found"], found[i]) == (method, source, total, near)


def test_wide_lists(spark):
    """Two rarest lists that cover more than 256 chunks together; layer C smaller than B."""
    n = 700
    rows = [(10, i, 150, "B") for i in range(150)] + [(11, 200 + i, 150, "B") for i in range(150)] + [(12, i, 300, "B") for i in range(300)]
    rows += [(13, 5, 400, "C"), (14, 699, 400, "C")]
    post = spark.createDataFrame(rows, "crc long, chunk_id long, df long, layer string")
    from unittest import mock

    cases = {0: [10, 11], 1: [12], 2: [12, 13], 3: [13, 14], 4: [99]}
    keys = spark.createDataFrame([(q, k) for q, ks in cases.items() for k in ks], "qid long, crc long")
    q = frame(spark, [b"x"] * 5, "qid long, q binary")
    with mock.patch.object(search, "minimizers", lambda *a: keys):
        got = {r["qid"]: (r["method"], r["best_source"], r["cand_count"]) for r in search.l0_summary(q, post, n, block_size=64).collect()}
    b = {k: [r[1] for r in rows if r[0] == k] for k in (10, 11, 12)}
    c = {13: {0}, 14: {10}}
    for i, ks in cases.items():
        method, source, _, near = naive.search(set(ks), b, c, n, 64)
        assert got[i] == (method, source, len(near))
    assert got[0][0] == "l0_b_best1_2" and got[2][0] == "l0_c_top2_2"


def test_adaptive(spark):
    data = corpus()
    post = index.postings(frame(spark, data))
    got = {r["qid"]: r["q_used"] for r in search.l0_adaptive(frame(spark, [data[3][5:60], b"zzzzzzzzzzz", b"abc"], "qid long, q binary"), post, len(data)).collect()}
    assert got == {0: 8, 1: 0, 2: 0}


def test_filters(spark):
    data = corpus(n=30)
    c = frame(spark, data)
    blooms = {r["chunk_id"]: bytes(r["bloom"]) for r in filters.bloom_filters(c, w=16).collect()}
    sketch = {r["chunk_id"]: bytes(r["sketch"]) for r in filters.sketches(c).collect()}
    on = lambda b: {i * 8 + j for i, x in enumerate(b) for j in range(8) if x >> j & 1}
    for i, d in enumerate(data):
        assert on(blooms[i]) == {p for k in naive.minimizers(d, 8, 16, "empty") for p in naive.bloom(k, 16384, 11)}
        assert on(sketch[i]) == {k & 32767 for k in naive.keys(d, 8)}
    queries = [data[2][3:60], b"short", data[9][:40]]
    q = frame(spark, queries, "qid long, q binary")
    got = {}
    for r in filters.bloom_scan(q, c, 2, w=16).collect():
        got.setdefault(r["qid"], {})[r["chunk_id"]] = r["hits"]
    for i, text in enumerate(queries):
        ks = naive.minimizers(text, 8, 16, "empty")
        hits = {j: sum(naive.bloom(k, 16384, 11) <= on(b) for k in ks) for j, b in blooms.items()}
        want = {j: None for j in blooms} if len(text) < 23 else {j: h for j, h in hits.items() if h >= min(2, max(1, len(ks)))}
        assert got.get(i, {}) == want
    with pytest.raises(ValueError):
        filters.bloom_bits(c, bits=1000)
    pairs = spark.createDataFrame([(i, j) for i in range(3) for j in range(30)], "qid long, chunk_id long")
    for r in filters.sketch_reorder(pairs, q, filters.sketches(c)).collect():
        assert r["hit"] == ({k & 32767 for k in naive.keys(queries[r["qid"]], 8)} <= on(sketch[r["chunk_id"]]))


def test_properties(spark):
    c = frame(spark, corpus())
    told = {r["length"]: r for r in quality.bloom_property(c).collect()}
    sizes = [len(d) for d in corpus()]
    assert {n: (r["trials"], r["failures"]) for n, r in told.items()} == {n: (sum(x >= n for x in sizes), 0) for n in (47, 48, 96, 192)}
    told = quality.retrieval_quality(quality.trials(c, 60), index.postings(c), c.count()).first()
    assert told["recall"] == 1.0 and told["trials"] > 20


@pytest.mark.parametrize("adaptive", [False, True])
def test_raw_offsets(spark, adaptive):
    """Slices of the whole corpus, which may span chunks: their bytes, the chunks they touch, and that search finds them."""
    data = corpus()
    raw, ends, at = b"".join(data), [], 0
    for d in data:
        ends.append((at, at + len(d)))
        at += len(d)
    asked = quality.raw_trials(frame(spark, data), (20, 300, 10**9), 12)
    got = {r["qid"]: r for r in asked.collect()}
    assert len(got) == 24
    for length in (20, 300):
        for i in range(12):
            a = i * 7919 * 7919 % (len(raw) - length + 1)
            touched = [j for j, (x, y) in enumerate(ends) if x < a + length and a < y]
            r = got[length * 12 + i]
            assert (bytes(r["q"]), r["low"], r["high"], r["length"]) == (raw[a : a + length], touched[0], touched[-1], length)
    rows = quality.retrieval_quality(asked, index.postings(frame(spark, data)), len(data), by=("length",), adaptive=adaptive).collect()
    assert {r["length"] for r in rows} == {20, 300} and all(r["trials"] == 12 and r["recall"] == 1.0 for r in rows)


def test_scored_order_and_skip(spark):
    data = corpus(n=30)
    c, q = frame(spark, data), frame(spark, [data[4][2:80], b"short"], "qid long, q binary")
    rows = filters.bloom_scan_scored(q, c, w=16).collect()
    for i in (0, 1):
        mine = sorted((r for r in rows if r["qid"] == i), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(len(mine)))
        assert mine == sorted(mine, key=lambda r: (-(r["score"] or 0), r["chunk_id"]))
    assert sum(r["qid"] == 1 for r in rows) == 30
    weights = {r["crc"]: (r["df"], r["weight"]) for r in filters.bloom_key_df(q, c, w=16).collect()}
    assert set(weights) == set(naive.minimizers(data[4][2:80], 8, 16, "empty")) and all(abs(w * df - 1) < 1e-9 for df, w in weights.values())
    pairs = spark.createDataFrame([(i, j) for i in range(2) for j in range(30)], "qid long, chunk_id long")
    assert filters.bloom_filter_candidates(pairs, q, c, skip=True).count() == 60
    kept = {tuple(r) for r in filters.bloom_filter_candidates(pairs, q, c, w=16).collect()}
    assert kept == {(0, r["chunk_id"]) for r in rows if r["qid"] == 0} | {(1, j) for j in range(30)}
    order = filters.sketch_reorder(pairs, q, filters.sketches(c)).where("qid = 0").orderBy("place").collect()
    assert [(not r["hit"], r["chunk_id"]) for r in order] == sorted((not r["hit"], r["chunk_id"]) for r in order) and order[0]["hit"]


def test_verify_across(spark):
    c = frame(spark, [b"hello wor", b"ld and more", b"\x12\x34\x56"])
    q = frame(spark, [b"world", b"and", b"\x34", b"\x23\x45"], "qid long, q binary")
    pairs = spark.createDataFrame([(i, j) for i in range(4) for j in range(3)], "qid long, chunk_id long")
    assert {tuple(r) for r in search.exact_verify(pairs, q, c, True).collect()} == {(0, 0, 6), (1, 1, 3), (2, 2, 1)}
    assert {tuple(r) for r in search.exact_verify(pairs, q, c).collect()} == {(1, 1, 3), (2, 2, 1)}


def test_gate_files(spark, tmp_path):
    assert gate.triage(gate.read_state(spark, str(tmp_path), str(tmp_path), str(tmp_path / "m.json"))).first()["verdict"] == "NO_MICRO_EVENT"
    (tmp_path / "m.json").write_text("{}")
    (tmp_path / "civ_state.json").write_text("{broken")
    (tmp_path / "chronicle.jsonl").write_text("\n".join(f'{{"i": {i}}}' if i % 7 else "bad" for i in range(60)) + "\n\n")
    got = gate.triage(gate.read_state(spark, str(tmp_path), str(tmp_path), str(tmp_path / "m.json"))).first()
    assert (got["verdict"], got["gate"], got["has_log"]) == ("MOVING", "FAIL", True)
    assert len(gate.jsonl_tail(str(tmp_path / "chronicle.jsonl"))) == 50 - sum(i % 7 == 0 for i in range(10, 60))
    (tmp_path / "LOCK_BY_GOV").touch()
    assert gate.triage(gate.read_state(spark, str(tmp_path), str(tmp_path), str(tmp_path / "m.json"))).first()["verdict"] == "LOCK_BY_GOV"


def test_df_stats_counts_every_key(spark, tmp_path):
    """A key in more documents than bounded_postings keeps (4096) is in df_stats, as in its SQL."""
    docs = spark.range(4200).selectExpr("id AS doc_id", "concat('the same long passage that all documents begin with, then ', if(id < 9, cast(id AS string), '')) AS text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(queries.ORACLE_SQL["df_stats"]).fetchall()[0]
    got = queries.QUERIES["df_stats"](spark, str(tmp_path)).select("min_df", "max_df", "median_df").first()
    assert tuple(got) == want and got["max_df"] == 4200


@given(st.lists(st.binary(max_size=60), max_size=8), st.integers(1, 9), st.sampled_from([1, 4, 8, 40]), st.sampled_from(["self", "empty"]), st.sampled_from([1, 40, 1000]))
@settings(max_examples=200, deadline=None)
def test_kernels_over_borders(values, q, w, short, at_once):
    """Values end to end give the keys that each gives alone."""
    ends = np.cumsum([0, *map(len, values)])
    got = {}
    for rows, crcs in kernels.minimizers_many(np.frombuffer(b"".join(values), np.uint8), ends, q, w, short, at_once):
        for i, k in zip(rows.tolist(), crcs.tolist()):
            got.setdefault(i, []).append(k)
    assert got == {i: sorted(m) for i, v in enumerate(values) if (m := naive.minimizers(v, q, w, short))}


def test_index_stats_reads_keys_once(spark, capsys):
    """Counts of the layers need each key's df, not its postings."""
    c = frame(spark, corpus())
    policy = index.Policy(df_max=4)
    got = index.index_stats(index.key_layers(index.key_df(c), policy), c)
    assert got.first() == index.index_stats(index.postings(c, policy), c).first()
    got.explain()
    plan = capsys.readouterr().out.split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and "SortMergeJoin" not in plan


def test_lookup_leaves_other_keys(spark):
    """Keys that no query asks for are left where the chunks are read; of layer C a row a block moves."""
    data = corpus()
    c, policy = frame(spark, data), index.Policy(df_max=3)
    asked = spark.createDataFrame([(k,) for k in naive.minimizers(data[5], 8, 8, "self")], "crc long")
    want = index.postings(c, policy).join(asked, "crc", "left_semi")
    found = index.lookup(c, policy)
    df = found.df(asked)
    assert set(map(tuple, df.collect())) == {(r["crc"], r["df"], r["layer"]) for r in want.collect()}
    assert sorted(map(tuple, found.rows(df).collect())) == sorted(map(tuple, want.collect()))
    thin = found.rows(df, 8)
    assert sorted(map(tuple, index.block_masks(thin, 8).collect())) == sorted(map(tuple, index.block_masks(want, 8).collect()))
    assert sorted(map(tuple, thin.where("layer = 'B'").collect())) == sorted(map(tuple, want.where("layer = 'B'").collect()))
    assert thin.count() < want.count()
    bounded, few = index.bounded_postings(c, w=8, max_df=9).join(asked, "crc", "left_semi"), index.bounded_lookup(c, w=8, max_df=9)
    assert sorted(map(tuple, few.rows(few.df(asked)).collect())) == sorted(map(tuple, bounded.collect()))


def test_common_keys_are_not_listed(spark, monkeypatch):
    """Every document has common keys and its own: what is written for the search grows with the documents, not with their square."""
    n = 400
    data = [b"a passage that all of the documents begin with, and then " + b" ".join(b"%d" % (i * 10**7 + j * 7919**2) for j in range(20)) for i in range(n)]
    c, sizes, cut = frame(spark, data), {}, search.cut

    def counted(df, what):
        out = cut(df, what)
        sizes[what] = out.count()
        return out

    monkeypatch.setattr(search, "cut", counted)
    told = quality.retrieval_quality(quality.trials(c, 96), index.lookup(c), n).first()
    assert (told["trials"], told["recall"], told["miss"]) == (n, 1.0, 0)
    assert sum(v for k, v in sizes.items() if k in ("pool", "lists", "blocks")) < 20 * n


def test_blocks_stay_runs(spark):
    """Candidates from blocks are runs until they are listed."""
    n = 6400
    rows = [(7, i * 64, 100, "C") for i in range(0, 40)]
    post = spark.createDataFrame(rows, "crc long, chunk_id long, df long, layer string")
    from unittest import mock

    keys = spark.createDataFrame([(0, 7)], "qid long, crc long")
    with mock.patch.object(search, "minimizers", lambda *a: keys):
        _, picked = search.l0_parts(frame(spark, [b"x" * 20], "qid long, q binary"), post, n, block_size=64)
        near = search.widened(picked, n)
    assert picked.count() == 40 and [tuple(r) for r in near.collect()] == [(0, 0, 2560)]
    assert sorted(r["chunk_id"] for r in search.listed(near, at_once=100).collect()) == list(range(2561))


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out.replace("BroadcastExchange", "Broadcast").split("Initial Plan")[0]


def test_bloom_scans_move_no_pairs(spark, capsys):
    """Pairs of queries and chunks are made where the chunk is read; for ranks, only residues that pass move."""
    data = corpus(n=300)
    c, q = frame(spark, data), frame(spark, [d[:80] for d in data[:20]] + [b"short"], "qid long, q binary")
    for need in (1, 2):
        assert "Exchange" not in plan_of(filters.bloom_scan(q, c, need, w=16), capsys)
    scored = filters.bloom_scan_scored(q, c, w=16)
    assert "hashpartitioning(qid" not in plan_of(scored, capsys)
    rows = scored.collect()
    hits = {(r["qid"], r["chunk_id"]) for r in filters.bloom_scan(q, c, w=16).collect()}
    assert {(r["qid"], r["chunk_id"]) for r in rows} == hits and len(rows) == len(hits)
    for i in range(21):
        mine = sorted((r for r in rows if r["qid"] == i), key=lambda r: (-(r["score"] or 0), r["chunk_id"]))
        assert [r["rank"] for r in mine] == list(range(len(mine)))
    pairs = spark.createDataFrame([(i, j) for i in range(21) for j in range(0, 300, 3)], "qid long, chunk_id long")
    kept = filters.bloom_filter_candidates(pairs, q, c, w=16)
    assert "data#" not in "".join(x for x in plan_of(kept, capsys).splitlines() if "Exchange" in x or "Join" in x)
    assert {tuple(r) for r in kept.collect()} == {p for p in hits if p[1] % 3 == 0}


def test_ranks_go_on_over_ranges(spark, monkeypatch):
    """Ranks of several ranges of chunks, and of several packs of queries, are those of one."""
    data = corpus(n=40) * 60
    c, q = frame(spark, data), frame(spark, [d[:80] for d in data[:9]], "qid long, q binary")
    want = {(r["qid"], r["chunk_id"]): r["score"] for r in filters.bloom_scan_scored(q, c, w=16).collect()}
    monkeypatch.setattr(filters, "PACK", 40)
    got = filters.bloom_scan_scored(q, c, w=16).collect()
    assert {(r["qid"], r["chunk_id"]): r["score"] for r in got} == want and len(got) == len(want)
    for i in range(9):
        mine = sorted((r for r in got if r["qid"] == i), key=lambda r: (-r["score"], r["chunk_id"]))
        assert [r["rank"] for r in mine] == list(range(len(mine)))


def test_texts_and_bitmaps_move_once_a_chunk(spark, capsys, monkeypatch):
    """Candidates carry ids alone through the shuffle: not the query's bits, not its text."""
    data = corpus(n=60)
    c, q = frame(spark, data), frame(spark, [d[3:80] for d in data[:20]] + [b"short", b""], "qid long, q binary")
    pairs = spark.createDataFrame([(i, j) for i in range(22) for j in range(0, 62, 2)], "qid long, chunk_id long")
    monkeypatch.setattr(filters, "PACK", 100)
    order = filters.sketch_reorder(pairs, q, filters.sketches(c))
    plan = plan_of(order, capsys)
    assert "collect_list(bit" not in plan and "hashpartitioning(chunk_id" in plan
    on = [{k & 32767 for k in naive.keys(d, 8)} for d in data] + [set(), set()]
    want = {(r["qid"], r["chunk_id"]): {k & 32767 for k in naive.keys((data[r["qid"]][3:80] if r["qid"] < 20 else b"short" if r["qid"] == 20 else b""), 8)} <= on[r["chunk_id"]] for r in pairs.collect()}
    got = order.collect()
    assert {(r["qid"], r["chunk_id"]): r["hit"] for r in got} == want and len(got) == len(want)
    for i in range(22):
        mine = sorted((r for r in got if r["qid"] == i), key=lambda r: r["place"])
        assert [r["chunk_id"] for r in mine] == [j for _, j in sorted((not h, j) for (k, j), h in want.items() if k == i)]
    found = search.exact_verify(pairs, q, c)
    assert "q_" not in "".join(x for x in plan_of(found, capsys).splitlines() if "Join" in x or "Exchange" in x) and "collect_list(qid" in plan_of(found, capsys)
    texts = [d[3:80] for d in data[:20]] + [b"short", b""]
    assert {tuple(r) for r in found.collect()} == {(i, j, data[j].find(texts[i])) for i in range(22) for j in range(0, 60, 2) if texts[i] in data[j]}


def test_mask_rows_are_written_small(spark, tmp_path):
    """Rows of blocks take well under a byte each, as they are dealt out by blocks."""
    masks = spark.range(40_000).selectExpr("(id * 2654435769) % 4294967291 AS crc", "(id * 7919) % 500 AS block_id")
    masks = masks.union(spark.createDataFrame([(5, 499), (5, 500)], "crc long, block_id long"))
    rows = index.mask_chunks(masks, 16, 7990)
    rows.write.parquet(f"{tmp_path}/out")
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    n = spark.read.parquet(f"{tmp_path}/out").count()
    assert n == rows.distinct().count() == 40_000 // 500 * (499 * 16 + 6) + 6 and rows.where("crc = 5").agg({"chunk_id": "max"}).first()[0] == 7989
    assert size < n


def test_masks_leave_layer_b(spark, capsys):
    """Masks are those of the postings, and the chunks' other keys are not sorted for them."""
    c, policy = frame(spark, corpus()), index.Policy(df_max=3, block_size=8)
    got = index.masks_of(c, policy)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, index.block_masks(index.postings(c, policy), 8).collect()))
    assert plan_of(got, capsys).count("MapInArrow") == 1
