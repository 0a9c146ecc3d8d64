"""Shared helpers of the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space bytes of the contracts: space, tab, LF, VT, FF, CR.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the one the cluster names in spark.checkpoint.dir.

    Only where it is unset and Spark runs in one process, as in tests, a temporary one is chosen.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle and checkpoint files of results that no one holds any more.

    Its cleaner waits for the driver's garbage collector, which may not run for long while disks fill. The driver also gives back
    native memory that is free: hundreds of threads plan exchanges and take memory in turn, and the C library keeps what they leave.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_native(spark)


def trim_native(spark: SparkSession) -> bool:
    """Give the driver's free native memory back to the system; False where the JVM can't (the command came with Java 17.0.9, on Linux)."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    named = jvm.java.lang.Class.forName
    try:
        # Only the interface's method may be called: the server's own class is hidden in its module.
        types = gateway.new_array(jvm.java.lang.Class, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = named(kind)
        given = gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        named("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def power_at_least(base: int, least: int) -> int:
    """The smallest power of ``base``, from the first, that is not below ``least``."""
    out = base
    while out < least:
        out *= base
    return out


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each context, for the operators that run Python there.

    Unless the user has chosen another size, Arrow batches are made smaller than Spark's: a batch of texts is in memory several times over.
    """
    context = spark.sparkContext
    if spark.conf.get(_ARROW_ROWS) == "10000":
        spark.conf.set(_ARROW_ROWS, "2000")
    if getattr(context, "_sent_package", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="source-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._sent_package = True
