"""Documents in chunks: the unit in which texts and what was decided about them meet again.

A chunk holds the documents of one hash of the id, in the order (id, text).
One step turns every chunk into packed messages for key groups, another step
answers each message, and the last reads chunk and answers together.  The
chunk's own order makes positions in a message meaningful to all steps, so an
answer needs no ids, and an exchange moves a few large rows instead of one for
every word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = "__chunk"
#: Stands for a null id, which comes last.
NO_ID = np.iinfo(np.int64).max


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def chunked(docs: DataFrame, id_col: str, name: str = CHUNK) -> DataFrame:
    """``docs`` with its chunk: four for each shuffle partition, so that one fits a task's memory several times."""
    n = 4 * shuffle_partitions(docs)
    return docs.withColumn(name, F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(n)).cast("int"))


def in_order(table: pa.Table, id_col: str, text_col: str) -> tuple[pa.Table, list[bytes], np.ndarray]:
    """A chunk's rows by (id, text), nulls last; the texts as bytes and the ids."""
    order = pc.sort_indices(pa.table({"i": table.column(id_col), "t": table.column(text_col)}), sort_keys=[("i", "ascending"), ("t", "ascending")], null_placement="at_end")
    table = table.take(order)
    ids = pc.fill_null(table.column(id_col).cast(pa.int64()), NO_ID).to_numpy()
    texts = [b or b"" for b in table.column(text_col).cast(pa.large_binary()).to_pylist()]
    return table, texts, np.asarray(ids, dtype=np.int64)


def runs(values: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values: run i is [b[i], b[i + 1])."""
    if not len(values):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]).astype(np.int64)
