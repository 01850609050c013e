"""Quality rules with host-level verdicts.

Each document is judged by base rules over its whole text; failures are summed
by host, host rates are shrunk with an empirical beta prior, and the verdict of
a host goes back to its documents.

Defined cases: a null or empty text has no words, so it fails the base rules; a
null host is a host of its own; a very long text is measured whole, as a block of
its own; a host exactly at the limit is kept; repeated rows are judged and
counted one by one; an empty table gives an empty result; further input columns
are kept, whatever their names, and those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querymill.llm import text as tx
from querymill.llm.session import prepare, private, stable

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host goes when its shrunk failure rate is above this.
HOST_LIMIT = 0.6

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_POINT = np.ones(256, dtype=np.int64)
_POINT[0x80:0xC0] = 0
_POINT[list(b" \t\n\x0b\x0c\r")] = 0

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The base measures of whole texts."""
    parts = [_measure(texts[s]) for s in tx.blocks(texts)]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for k in MEASURES}


def _measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    w = tx.words(texts)
    n = w.counts()
    doc = w.doc()
    starts, found = tx.document_windows(w, tx.word_hashes(w), WINDOW)
    # The document enters the key: only windows of one text are compared.
    again = tx.repeated(found ^ tx.mix(doc[starts].astype(np.uint64) + tx.U64(1))) if len(starts) else np.zeros(0, dtype=bool)
    words_in = tx.covered(starts[again], WINDOW, len(doc))
    lines = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            own = [x for x in t.split(b"\n") if x and not x.isspace()]
            lines[i] = len(own) - len(set(own))
    return {
        "n_words": n,
        "word_chars": np.add.reduceat(_POINT[w.data], w.bounds[:-1]),
        "n_symbols": np.add.reduceat(_SYMBOL[w.data], w.bounds[:-1]),
        "n_dup_lines": lines,
        "n_repeat_words": np.bincount(doc[words_in], minlength=len(texts)).astype(np.int64),
    }


def with_measures(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` and the base measures; ``base_failed`` says whether a base rule fails."""
    prepare(docs.sparkSession)
    docs = docs.drop(*MEASURES, "base_failed")  # in any case of their letters
    rest = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*rest, *(T.StructField(k, T.LongType()) for k in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = measure(tx.column_bytes(b.column(text_col)))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), *(pa.array(found[k], pa.int64()) for k in MEASURES)], names=[f.name for f in schema])

    wanted = dict.fromkeys([*(f.name for f in rest), text_col])
    out = docs.select(*wanted).mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(judged: DataFrame, host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """A row for each host: n_docs, n_failed, shrunk_rate, host_kept.

    The beta prior has the mean and variance of the hosts' failure rates,
    weighted by documents (moments).  Its strength is at least 2 documents and
    at most the mean number of documents of a host, so that neither a few hosts
    nor hosts that agree by chance fix every rate.
    """
    hosts = judged.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("m"),
        (F.sum(rate * rate * F.col("n_docs")) / F.sum("n_docs")).alias("m2"),
        F.avg(F.col("n_docs").cast("double")).alias("size"),
    )
    spread = F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(1e-9))
    strength = F.greatest(F.lit(2.0), F.least(F.col("m") * (1 - F.col("m")) / spread - 1, F.col("size")))
    prior = moments.select((F.col("m") * strength).alias("a"), strength.alias("s"))
    shrunk = (F.col("n_failed") + F.col("a")) / (F.col("n_docs") + F.col("s"))
    # The prior is one row, so this is a broadcast of one row.
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk <= limit).alias("host_kept"))


def quality_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT, keep_text: bool = True) -> DataFrame:
    """``docs`` with the base measures, ``base_failed``, the host's ``shrunk_rate`` and ``kept``.

    Texts are measured once: the measures are written to the shared checkpoint
    folder, and both the host sums and the join read them there.
    """
    judged = stable(with_measures(docs, text_col, keep_text))
    mine, other, verdict = private(judged, "host", "key", "verdict")
    hosts = host_verdicts(judged, host_col, limit).select(F.col("host").alias(other), "shrunk_rate", F.col("host_kept").alias(verdict))
    judged = judged.drop("shrunk_rate", "kept")
    # Hosts are few beside documents but not bounded: Spark picks the join, and splits a hot host if it sorts and merges.
    joined = judged.withColumn(mine, F.col(host_col)).join(hosts, F.col(mine).eqNullSafe(F.col(other)), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(verdict, F.lit(True))).drop(mine, other, verdict)
