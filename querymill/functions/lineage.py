"""Cutting the lineage of a table that is used again and again, and the shared folder for it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, in ``spark.checkpoint.dir``; a temporary one only where none is set, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        place = context.getConf().get("spark.checkpoint.dir")
        if not place:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            place = tempfile.mkdtemp(prefix="querymill-")
        context.setCheckpointDir(place)
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
