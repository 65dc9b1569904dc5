"""Lineage cuts that survive lost executors: tables written into the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from grainmill.session import ready

_SETTING = "spark.checkpoint.dir"
#: Paths that go at the end of the driver's Python process.
_WRITTEN: list[str] = []
_REGISTERED: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where the session names none and runs on one machine (tests) a temporary folder is made and set.
    """
    ready(spark)
    context = spark.sparkContext
    where = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING)
    if not where:
        if not context.master.startswith("local["):
            raise ValueError(f"{_SETTING} must name a folder that driver and executors share")
        where = getattr(spark, "_grainmill_shared", None) or "file://" + tempfile.mkdtemp(prefix="grainmill-")
        spark._grainmill_shared = where
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(where)
    return where


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Cuts the lineage: the rows are written as Parquet into the shared folder and read again.

    Survives the loss of executors. Like checkpoints, the files stay while the session lives, as a
    result may still read them; they go with discard() or at the end of the driver's Python process.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, what)
    df.write.parquet(path)
    discard_at_end(spark, path)
    relieve(spark)
    trim(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def relieve(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage (plans, broadcasts) once its heap takes over half of its most.

    Else a driver of many small queries grows to the whole of its limit, though it holds little. The
    heap is measured after each cut; where half of it is in use for good, each cut takes a collection.
    """
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        jvm.java.lang.System.gc()


def trim(spark: SparkSession) -> None:
    """Has the driver's JVM give back the memory outside its heap that its allocator holds free.

    Compilers and readers free much after each query, and the allocator keeps it: over many queries some
    hundred MB, which count as the driver's. JVMs that know no such command are left as they are.
    """
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm

    def array(kind, *items):
        out = gateway.new_array(kind, len(items))
        for i, item in enumerate(items):
            out[i] = item
        return out

    with contextlib.suppress(Py4JError):
        of, name = jvm.java.lang.Class.forName, jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        kinds = [of(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        # by reflection on the interface: the server's own class is not open to Py4J
        invoke = of("javax.management.MBeanServerConnection").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, name, "systemTrimNativeHeap", None, None))


def discard_at_end(spark: SparkSession, path: str) -> None:
    """The path is deleted at the end of the driver's Python process."""
    if not _REGISTERED:
        _REGISTERED.append(atexit.register(_clear, spark))
    _WRITTEN.append(path)


def discard(*cuts: DataFrame) -> None:
    """Deletes what cut() wrote for tables that nothing reads any more."""
    for df in cuts:
        if (path := df.__dict__.pop("_cut", None)) in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clear(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):
        for path in _WRITTEN:
            _delete(spark, path)
