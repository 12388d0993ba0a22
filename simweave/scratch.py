"""Shared scratch tables.

Lineage is cut by writing a Parquet table into the folder that the cluster
names in ``spark.checkpoint.dir``: every executor can read it again after
another one is lost. Only where that setting is absent (tests, a laptop) a
temporary folder of this machine takes its place.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="simweave-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows and bytes of an Arrow batch sent to Python while a scratch table is made: long texts must not add up.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


#: The driver keeps the text of every query's plan, and makes it anew whenever a part of the query ends: not all details of every operator.
BRIEF = {"spark.sql.ui.explainMode": "simple"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    settings = ARROW | BRIEF
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Seconds from one trim of the driver to the next.
TRIM_S = 2.0
_TRIMMED: dict[str, float] = {}


def trim_native(spark: SparkSession) -> str:
    """Have the driver's JVM give the native memory that it has freed back to the system; what it says, or nothing if it has no such command.

    Spark plans the parts of a query in threads that soon end, hundreds a
    minute. What they free stays with the allocator otherwise, 186 MB after
    four stages of the pipeline.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # its class is not open to reflection, the interface is
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return str(invoke.invoke(server, args))
    except Py4JError:
        return ""


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and return it as read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    app = spark.sparkContext.applicationId
    if time.monotonic() - _TRIMMED.get(app, 0) >= TRIM_S:
        trim_native(spark)
        _TRIMMED[app] = time.monotonic()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` returned and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
