import json
import zlib

import pytest

from grainmill import cli
from grainmill.operators import filters, index
from grainmill.sources import chunks as sources
from grainmill.sources import datasource, formats


@pytest.fixture
def source(tmp_path):
    path = tmp_path / "corpus.txt"
    path.write_bytes(b"".join(b"line %d of the corpus text\n" % (i * i) for i in range(5000)))
    return path


def test_container(spark, tmp_path, source):
    datasource.register(spark)
    target = str(tmp_path / "c.bin")
    told = formats.write_container(str(source), target, 1000)
    whole = source.read_bytes()
    assert told["chunks"] == -(-len(whole) // 1000)
    df = spark.read.format("corpus_container").load(target)
    assert b"".join(bytes(r["data"]) for r in df.orderBy("chunk_id").collect()) == whole
    again = str(tmp_path / "again.bin")
    sources.chunks_fixed(df, 700).repartition(3).write.format("corpus_container").option("chunksize", 700).mode("append").save(again)
    assert b"".join(d for _, d in formats.container_chunks(again)) == whole
    with pytest.raises(ValueError):
        formats.container_header(str(source))
    cut = tmp_path / "cut.bin"
    cut.write_bytes((tmp_path / "c.bin").read_bytes()[:2500])
    assert [i for i, _ in formats.container_chunks(str(cut))] == [0, 1, 2]


def test_archive(spark, tmp_path, source):
    datasource.register(spark)
    target = str(tmp_path / "a.bin")
    whole = source.read_bytes()
    formats.pack_archive(str(source), target, 1000)
    df = spark.read.format("corpus_archive").load(target)
    assert b"".join(bytes(r["data"]) for r in df.orderBy("chunk_id").collect()) == whole
    told = formats.make_offset_index(target)
    assert told["chunks"][0] == {"off": 13, "csize": len(zlib.compress(whole[:1000], 6)), "usize": 1000}
    assert json.load(open(target + ".idx.json"))["num_chunks"] == df.count()
    other = str(tmp_path / "b.bin")
    formats.write_archive(df, other)
    assert (tmp_path / "b.bin").read_bytes() == (tmp_path / "a.bin").read_bytes()
    assert {r["chunk_id"] for r in formats.fetch(df, [3, 1, 3, 999]).collect()} == {1, 3}
    raw = bytearray((tmp_path / "a.bin").read_bytes())
    raw[20] ^= 255
    (tmp_path / "bad.bin").write_bytes(raw)
    assert bytes(spark.read.format("corpus_archive").option("mode", "PERMISSIVE").load(str(tmp_path / "bad.bin")).where("chunk_id = 0").first()["data"]) == b""
    (tmp_path / "cut.bin").write_bytes(raw[:-3])
    with pytest.raises(ValueError):
        list(formats.archive_entries(str(tmp_path / "cut.bin")))


def test_index_files(spark, tmp_path, source):
    datasource.register(spark)
    target = str(tmp_path / "a.bin")
    formats.pack_archive(str(source), target, 1000)
    chunks = spark.read.format("corpus_archive").load(target)
    n = chunks.count()
    post = index.postings(chunks, index.Policy(df_max=4, block_size=8)).cache()
    formats.write_index(post, str(tmp_path / "i.bin"), n, df_max=4, block_size=8)
    head, b, c = formats.read_index(spark, str(tmp_path / "i.bin"))
    assert head["num_chunks"] == n and head["df_max"] == 4
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(b) == rows(post.where("layer = 'B'").select("crc", "chunk_id"))
    assert rows(c) == rows(index.block_masks(post, 8))
    bounded = index.bounded_postings(chunks, max_df=9).cache()
    formats.write_hotspots(bounded, str(tmp_path / "h.bin"), n, max_df=9)
    assert rows(formats.read_hotspots(spark, str(tmp_path / "h.bin"))[1]) == rows(bounded)
    for kind, made, bits in (("bloom", filters.bloom_filters(chunks), 16384), ("sketch", filters.sketches(chunks), 32768)):
        formats.write_bitmaps(made, str(tmp_path / kind), kind, bits=bits)
        head, got = formats.read_bitmaps(spark, str(tmp_path / kind))
        assert head["kind"] == kind and rows(got) == rows(made)
    back = index.undelta(index.deltas(post).withColumnRenamed("chunk_id", "seq"))
    assert rows(back) == rows(post.where("layer = 'B'").select("crc", "chunk_id"))


def test_commands(spark, tmp_path, source, capsys):
    run = lambda *a: (cli.main(list(map(str, a))), capsys.readouterr().out)[1]
    assert run("version").strip()
    run("container-write", source, tmp_path / "c.bin", "--chunk-size", 5000)
    assert json.loads(run("container-info", tmp_path / "c.bin"))["chunk_size"] == 5000
    assert len(run("container-bytefreq", tmp_path / "c.bin", "--top", 3).splitlines()) == 3
    assert len(run("container-fingerprint", tmp_path / "c.bin").splitlines()) == 128
    assert run("container-compare", tmp_path / "c.bin", tmp_path / "c.bin").split()[0] == "1.0"
    run("pack", source, tmp_path / "a.bin", "--chunk-size", 1000)
    found = json.loads(run("search", tmp_path / "a.bin", "--query", "line 2500 of the corpus text", "--json"))
    assert found["anchors_found"] > 0 and found["candidates"]
    with pytest.raises(SystemExit):
        run("info", tmp_path / "none")
