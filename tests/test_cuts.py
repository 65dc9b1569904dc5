from types import SimpleNamespace as Names

import pytest

from grainmill import cuts


@pytest.mark.parametrize("taken, collections", [(400, 0), (500, 0), (501, 1)])
def test_a_grown_heap_is_collected(taken, collections):
    calls = []
    heap = Names(totalMemory=lambda: taken, maxMemory=lambda: 1000)
    lang = Names(Runtime=Names(getRuntime=lambda: heap), System=Names(gc=lambda: calls.append(1)))
    cuts.relieve(Names(sparkContext=Names(_jvm=Names(java=Names(lang=lang)))))
    assert len(calls) == collections


def test_cuts_relieve_the_driver(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(cuts, "relieve", calls.append)
    assert cuts.cut(spark.range(3)).count() == 3 and len(calls) == 1


def test_freed_native_memory_goes_back(spark):
    """What an allocator holds free after many short allocations is the system's again after a cut."""
    jvm = spark.sparkContext._jvm
    held = lambda: int(next(x for x in open(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status") if x.startswith("VmRSS")).split()[1])
    deflaters = [jvm.java.util.zip.Deflater() for _ in range(400)]  # about 270 kB outside the heap each
    for one in deflaters:
        one.setInput(bytes(64))
        one.deflate(bytearray(64))
    last = deflaters.pop()  # at the top of the allocator's area, where free memory would go back by itself
    full = held()
    for one in deflaters:
        one.end()
    before = held()
    cuts.cut(spark.range(1))
    after = held()
    last.end()
    assert before > full - 40_000, "the allocator gave it back by itself"
    assert after < before - 40_000
