"""python -m grainmill COMMAND ...: the corpus commands over files, containers and archives."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill import __version__
from grainmill.operators import analysis, filters, gate, index, quality, search
from grainmill.session import ready
from grainmill.sources import datasource, formats


def session() -> SparkSession:
    spark = SparkSession.builder.appName("grainmill").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ready(spark)
    datasource.register(spark)
    return spark


def container(path: str) -> DataFrame:
    return session().read.format("corpus_container").load(path)


def archive(path: str) -> DataFrame:
    return session().read.format("corpus_archive").load(path)


def show(rows: DataFrame) -> None:
    for r in rows.toLocalIterator():
        print("\t".join(str(x) for x in r))


def _info(a) -> None:
    if not os.path.isfile(a.file):
        sys.exit(f"no such file: {a.file}")
    print(json.dumps({"file": os.path.abspath(a.file), "size": os.path.getsize(a.file)}))


def _index(a) -> None:
    told = formats.make_offset_index(a.archive, a.out, not a.no_verify)
    print(json.dumps({k: v for k, v in told.items() if k != "chunks"}))


def _hotspots(a) -> None:
    chunks = archive(a.archive)
    told = formats.write_hotspots(index.bounded_postings(chunks, a.q, a.w, a.max_df), a.out or a.archive + ".hotspots.bin", chunks.count(), a.q, a.w, a.max_df)
    print(json.dumps(told))


def _fingerprint(a) -> None:
    chunks = archive(a.archive)
    blooms = filters.bloom_filters(chunks, a.q, a.w, a.bloom_bits, a.k)
    n = formats.write_bitmaps(blooms, a.out_bin or a.archive + ".fingerprints.bin", "bloom", a.q, a.w, a.bloom_bits, a.k)
    stats = index.minimizer_stats(chunks, a.q, a.w).first().asDict()
    told = {"num_chunks": n, "q": a.q, "w": a.w, "bloom_bits": a.bloom_bits, "k": a.k, "min_query_len": a.w + a.q - 1, **{f"minimizers_per_chunk_{k}": v for k, v in stats.items()}}
    if a.verify:
        # as many chunks as trials, those of the smallest seeded hashes
        tried = chunks.orderBy(F.xxhash64("chunk_id", F.lit(42))).limit(a.verify_trials)
        told |= quality.bloom_property(tried, q=a.q, w=a.w, bits=a.bloom_bits, k=a.k).agg(F.sum("trials").alias("trials"), F.sum("failures").alias("failures")).first().asDict()
    with open(a.out_json or a.archive + ".fingerprints.json", "w") as f:
        json.dump(told, f, indent=2)
    print(json.dumps(told))
    if told.get("failures"):
        sys.exit(1)


def _sketch(a) -> None:
    print(formats.write_bitmaps(filters.sketches(archive(a.archive)), a.out_bin or a.archive + ".headersketch.bin", "sketch", bits=filters.SKETCH_BITS))


def _build(a) -> None:
    chunks = archive(a.archive)
    policy = index.LEGACY if a.legacy else index.Policy(a.q, a.w, a.df_min, a.df_max, None, a.block_size)
    print(json.dumps(formats.write_index(index.postings(chunks, policy), a.out, chunks.count(), a.q, a.w, a.df_min, a.df_max, policy.block_size)))


def _search(a) -> None:
    chunks = archive(a.archive)
    text = a.query.encode() if a.query is not None else open(a.qfile, "rb").read() if a.qfile else sys.stdin.buffer.read()
    queries = chunks.sparkSession.createDataFrame([(0, bytearray(text))], "qid long, q binary")
    post, n = index.lookup(chunks, index.Policy(a.q, a.w)), chunks.count()
    found, near = search.l0_both(queries, post, n, adaptive=not a.no_adaptive, **({"q": a.q} if a.no_adaptive else {}), w=a.w)
    told = found.first().asDict()
    every = told.pop("all")
    if a.json:
        told["candidates"] = list(range(n)) if every else sorted(r["chunk_id"] for r in search.listed(near).toLocalIterator())
    print(json.dumps(told))


def _gate(a) -> None:
    states = gate.read_state(session(), a.civ_dir, a.flags_dir, a.micro)
    if a.json:
        print(gate.report(states).first()["report"])
        return
    for k, v in gate.triage(states).first().asDict().items():
        print(f"{k:<16} {v}")


def _info_container(a) -> None:
    size, step = formats.container_header(a.container)
    print(json.dumps({"corpus_size": size, "chunk_size": step, "chunks": container(a.container).count()}))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="grainmill")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *args, **options):
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        for k, v in options.items():
            flag = "--" + k.replace("_", "-")
            if v is False:
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, default=v, type=int if isinstance(v, int) else str)
        p.set_defaults(run=run)

    add("version", lambda a: print(__version__))
    add("info", _info, "file")
    add("index", _index, "archive", out=None, no_verify=False)
    add("hotspots", _hotspots, "archive", q=8, w=40, max_df=4096, out=None)
    add("fingerprint", _fingerprint, "archive", q=8, w=40, bloom_bits=16384, k=11, out_bin=None, out_json=None, verify=False, verify_trials=200)
    add("headersketch", _sketch, "archive", out_bin=None)
    add("container-info", _info_container, "container")
    add("container-bytefreq", lambda a: show(analysis.byte_frequency(container(a.container), a.top)), "container", top=20)
    add("container-hotspots", lambda a: show(analysis.entropy_hotspots(container(a.container), a.top)), "container", top=20)
    add("container-fingerprint", lambda a: show(analysis.signature(container(a.container), a.k, a.window)), "container", k=128, window=32)
    add("container-headersketch", lambda a: show(analysis.entropy_profile(container(a.container), a.size).orderBy("slot")), "container", size=64)
    add("container-write", lambda a: print(json.dumps(formats.write_container(a.input, a.output, a.chunk_size))), "input", "output", chunk_size=formats.CONTAINER_CHUNK)
    add("container-compare", lambda a: show(analysis.compare(container(a.a), container(a.b), a.k, a.window, a.size)), "a", "b", k=128, window=32, size=64)
    add("pack", lambda a: print(json.dumps(formats.pack_archive(a.input, a.output, a.chunk_size, a.level))), "input", "output", chunk_size=formats.ARCHIVE_CHUNK, level=6)
    add("build-index", _build, "archive", "out", q=8, w=8, df_min=1, df_max=256, block_size=64, legacy=False)
    add("search", _search, "archive", q=8, w=8, query=None, qfile=None, no_adaptive=False, json=False)
    add("gate", _gate, civ_dir="CIV", flags_dir=".", micro="latest_trinity_micro_event.json", json=False)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(a)
