"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A document's features are log counts of hashed byte trigrams of its whole text,
and terms for its shape (shares of distinct and of repeated words, of symbols
and of capitals, each in steps).
A bounded sample of labelled documents gives weights and a truncated singular
value decomposition; the sample's latent vectors, with labels, go to every
task.  There each document takes exact cosine products with all of them, in
blocks, and its nearest vote with their similarity as weight.

Defined cases: a null or empty text, and any text without a trigram, scores the
share of label 1 in the sample (0.5 if nothing was learned); a label that is
null is left out; with several labels of a document each is learned; of equally
similar neighbours the earlier ones in the sample, which is ordered by a hash of
the id, vote; a very long text is read whole, in stretches; an empty table gives
an empty result; repeated rows score alike; further columns are kept, and those
named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querymill.llm import text as tx
from querymill.llm.session import prepare

#: Bound of the labelled sample; the model has this many vectors of RANK numbers.
TRAIN_DOCS = 4000
BUCKETS = 2048
#: Shape terms: each share falls in one of STEPS steps, the first for none at all.
SHARES, STEPS = 4, 8
COLUMNS = BUCKETS + SHARES * STEPS
#: Length of the shape part of a feature vector beside the trigram part, which has 1.
SHAPE = 0.9
RANK = 48
NEIGHBOURS = 25
#: Similarities are compared in millionths, so that the order of additions hardly ever decides.
DIGITS = 1_000_000
#: Similarities are raised to this power before they weigh a vote.
SHARPNESS = 4
THRESHOLD = 0.3
BLOCK = 1024
SEED = 5


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>!=_~^{}[]@+\\")] = True


def features(texts: list[bytes]) -> np.ndarray:
    """Log counts of hashed byte trigrams and then the shape terms, a row for each text."""
    out = np.zeros((len(texts), COLUMNS), np.float32)
    for i, t in enumerate(texts):
        size = upper = lower = symbols = 0
        for at in range(0, len(t), 1 << 20):  # a very long text in stretches that overlap by two bytes
            raw = np.frombuffer(t, np.uint8)[at : at + (1 << 20) + 2]
            b = raw.astype(np.uint32)
            code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(21)
            out[i, :BUCKETS] += np.bincount(code, minlength=BUCKETS)
            seen = np.bincount(raw[: 1 << 20], minlength=256)
            size, upper, lower, symbols = size + seen.sum(), upper + seen[65:91].sum(), lower + seen[97:123].sum(), symbols + seen[_SYMBOL].sum()
        words = t.split()
        if words:
            n = len(words)
            shares = (len(set(words)) / n, sum(map(eq, words, words[1:])) / n, symbols / size, upper / max(1, upper + lower))
            for j, share in enumerate(shares):
                out[i, BUCKETS + j * STEPS + (0 if share == 0 else min(STEPS - 1, 1 + int((STEPS - 1) * share**0.5)))] = 1
    np.log1p(out[:, :BUCKETS], out=out[:, :BUCKETS])
    return out


@dataclass
class KnnModel:
    weight: np.ndarray  # BUCKETS
    axes: np.ndarray  # COLUMNS x RANK
    vectors: np.ndarray  # n x RANK, of length 1
    labels: np.ndarray  # n
    base: float

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> KnnModel | None:
        if not len(x):
            return None
        df = (x[:, :BUCKETS] > 0).sum(axis=0)
        weight = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + 1
        x = _weighted(x, weight)
        rank = min(RANK, *x.shape)
        r = np.random.default_rng(SEED)
        q = np.linalg.qr(x.T @ r.normal(size=(len(x), rank + 8)).astype(np.float32))[0]
        for _ in range(4):  # power steps
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        axes = (q @ vt[:rank].T).astype(np.float32)
        return cls(weight, axes, _unit(x @ axes), labels.astype(np.float32), float(labels.mean()))

    def latent(self, x: np.ndarray) -> np.ndarray:
        return _unit(_weighted(x, self.weight) @ self.axes)

    def scores(self, v: np.ndarray) -> np.ndarray:
        """Weighted votes of the nearest; a vector of zeros gets the base share."""
        k = min(NEIGHBOURS, len(self.vectors))
        # One number orders by similarity and, among equal ones, by place in the sample: it is exact, and tells both.
        places = 1 << len(self.vectors).bit_length()
        best = np.full((len(v), k), -np.inf)
        for i in range(0, len(self.vectors), BLOCK):
            s = np.rint((v @ self.vectors[i : i + BLOCK].T).astype(np.float64) * DIGITS)
            both = np.concatenate([best, s * places - np.arange(i, i + s.shape[1])], axis=1)
            best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        s = np.ceil(best / places)
        vote = self.labels[(s * places - best).astype(np.int64)]
        w = np.maximum(s / DIGITS, 0) ** SHARPNESS
        total = w.sum(axis=1)
        out = np.where(total > 0, (w * vote).sum(axis=1) / np.maximum(total, 1e-30), self.base)
        return np.where((v != 0).any(axis=1), np.clip(out, 0, 1), self.base)


def _weighted(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.concatenate([_unit(x[:, :BUCKETS] * weight), SHAPE * _unit(x[:, BUCKETS:])], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 1e-12, n, 1)


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column, text_col: str, id_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most TRAIN_DOCS labelled rows, chosen by a hash of the id."""
    key = F.md5(F.concat(F.lit("quality:"), F.col(id_col).cast("string")))
    chosen = labels.where(learn & F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"), key.alias("__key"))
    chosen = chosen.orderBy("__key", "label").limit(TRAIN_DOCS)
    d = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
    # At most TRAIN_DOCS short rows are broadcast.
    d = d.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("__key", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(tx.column_bytes(b.column("text"))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column("__key"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["__key", "label", "x"])

    # Features leave the tasks, never texts: 4 KB a row.
    rows = d.mapInArrow(run, "__key string, label int, x binary").orderBy("__key", "label", "x").limit(2 * TRAIN_DOCS).toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16).reshape(-1, COLUMNS).astype(np.float32)
    return x, np.array(rows.column("label").to_pylist(), np.float32)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> KnnModel | None:
    prepare(docs.sparkSession)
    return KnnModel.fit(*training_sample(docs, labels, ~held_out(id_col), text_col, id_col, label_col))


def score(docs: DataFrame, model: KnnModel | None, text_col: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """``docs`` with score and predicted; a map without any shuffle."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")  # in any case of their letters
    own = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*own, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if m is None:
                s = np.full(b.num_rows, 0.5)
            else:
                s = m.scores(m.latent(features(tx.column_bytes(b.column(text_col)))))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in own), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return docs.select(*dict.fromkeys([*(f.name for f in own), text_col])).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """``docs`` with held_out, score and predicted; labels of the held-out fold are never read."""
    model = fit(docs, labels, text_col, id_col, label_col)
    return score(docs, model, text_col, threshold, keep_text).withColumn("held_out", F.coalesce(held_out(id_col), F.lit(False)))
