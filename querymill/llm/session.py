"""Session helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import gc
import time

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch, so that a batch of long documents stays small.
BATCH_ROWS = 512
#: Seconds between two releases of what the driver holds of dropped tables, at least.
RELEASE_S = 10.0
_released = 0.0


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and make sure that checkpoints have a shared place.

    ``spark.checkpoint.dir`` names a folder which all executors share; only
    where it is unset, as in local tests, is a temporary one made.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        place = context.getConf().get("spark.checkpoint.dir")
        if not place:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            place = tempfile.mkdtemp(prefix="querymill-")
        context.setCheckpointDir(place)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stable(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder, so that later steps neither recompute nor lose it."""
    prepare(df.sparkSession)
    out = _bounded(df.checkpoint(eager=True))
    release(df.sparkSession)
    return out


def _bounded(df: DataFrame) -> DataFrame:
    """A written table without its estimated size, where that is beyond 2048 EiB.

    Spark lets it keep the estimate of the plan that it is written from, which for
    joins is the product of the sides.  A loop that joins its last result with
    something made of it doubles the digits in every round, so that some twenty
    rounds leave numbers of many MB on the driver.
    """
    spark, plan = df.sparkSession, df._jdf.queryExecution().logical()
    if "E+" not in plan.stats().simpleString():  # larger ones have an exponent
        return df
    java = spark.sparkContext._jvm
    nothing = java.scala.Option.empty()
    leaf = java.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, nothing, nothing)
    return type(df)(java.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, leaf), spark)


def release(spark: SparkSession) -> None:
    """Let the driver go of tables that nothing refers to any more.

    Spark drops map outputs, broadcasts and checkpoints of such a table only
    after the driver's garbage collector has met it.  A query of hundreds of
    short jobs leaves many behind before the heap is full, and the heap grows by
    them to its limit; a full collection also gives memory back to the system.
    So does a trim of the native heap, where the driver's Java has the command.
    """
    global _released
    if time.monotonic() - _released < RELEASE_S:
        return
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
    with contextlib.suppress(Py4JError):
        _trim(spark)
    _released = time.monotonic()


def _trim(spark: SparkSession) -> None:
    """Give free native memory of the driver's Java back to the system; by the interface's method, as the server's class is not open."""
    java, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    invoke = next(m for m in java.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    values = gateway.new_array(java.java.lang.Object, 4)
    values[0] = java.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    values[1] = "systemTrimNativeHeap"
    invoke.invoke(java.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


def private(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of one's own that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"__{n}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
