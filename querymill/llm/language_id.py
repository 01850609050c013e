"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a document in both directions, labels every
byte, and a document's probabilities are the mean over all its bytes.  State is
carried through the text: it is read in windows of ``SPAN`` bytes that overlap
by ``MARGIN`` bytes on either side, so that each counted byte has its neighbours
in both directions, across words, and only the ends of a document are cold.
It is trained in numpy by backpropagation through time on a bounded sample of
labelled rows, whole texts: at most ``TRAIN_DOCS`` documents of a language and
about ``TRAIN_ROWS`` in all.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
rows without a language are predicted but never learned from; if there is
nothing to learn from every document is ``und``; of equally likely languages
the first by name is taken; a very long text is read whole, some windows at a
time; an empty table gives an empty result; repeated rows are labelled alike;
further columns are kept, and those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querymill.llm import text as tx
from querymill.llm.session import prepare, private

SPAN, MARGIN = 480, 16
HIDDEN = 8
#: Rows that the network is fitted on: of a language, and in all.
TRAIN_DOCS, TRAIN_ROWS = 300, 20_000
#: Bytes of a training window, windows of a step, steps.
TRAIN_SPAN, BATCH, STEPS, RATE = 48, 160, 300, 0.015
SEED = 17
#: Windows that are run at once.
ROWS = 2048
UNKNOWN = "und"


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


@dataclass
class ByteWindows:
    """Windows of texts: padded bytes and lengths, the document, and the counted part [lo, hi) of each."""

    data: np.ndarray
    n: np.ndarray
    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def byte_windows(texts: list[bytes], span: int = SPAN, margin: int = MARGIN) -> ByteWindows:
    every = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    pieces = -(-size // span)
    doc = np.repeat(np.arange(len(texts)), pieces)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * span
    start, end = np.maximum(at - margin, 0), np.minimum(at + span + margin, size[doc])
    n = end - start
    wide = int(n.max()) if len(n) else 0
    place = ((np.cumsum(size) - size)[doc] + start)[:, None] + np.arange(wide)
    data = every[np.minimum(place, len(every) - 1)]
    data[np.arange(wide) >= n[:, None]] = 0
    return ByteWindows(data, n, doc, at - start, np.minimum(at + span, size[doc]) - start)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


@dataclass
class ByteGru:
    """Weights: for each direction the input table ``x`` (256, 3h) and recurrent ``u`` (h, 3h); then the label layer."""

    langs: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = HIDDEN, seed: int = SEED) -> ByteGru:
        r = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w["x" + d] = r.normal(0, 0.3, (256, 3 * hidden))
            w["u" + d] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        w["o"] = r.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, len(langs)))
        w["c"] = np.zeros(len(langs))
        return cls(langs, {k: v.astype(np.float32) for k, v in w.items()})

    def states(self, data: np.ndarray, n: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """States (time, hidden, row) of one direction; rows come by falling length, so the live ones are a prefix."""
        x, u = np.ascontiguousarray(self.weights["x" + d].T), np.ascontiguousarray(self.weights["u" + d].T)
        k = u.shape[1]
        steps = int(n[0]) if len(n) else 0
        out = np.zeros((steps, k, len(n)), x.dtype)
        h = np.zeros((k, len(n)), x.dtype)
        data = np.ascontiguousarray(data.T)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            live = int(np.searchsorted(-n, -t, side="left"))
            a, prev = x.take(data[t, :live], axis=1), h[:, :live]
            m = u @ prev
            gates = _sigmoid(a[: 2 * k] + m[: 2 * k])
            r, z = gates[:k], gates[k:]
            new = r * m[2 * k :]
            new += a[2 * k :]
            np.tanh(new, out=new)
            if trace is not None:
                trace.append((t, live, prev.copy(), r, z, new, m[2 * k :]))
            step = prev - new
            step *= z
            step += new
            h[:, :live] = step
            out[t, :, :live] = step
        return out

    def label_sums(self, w: ByteWindows, rows: int = ROWS) -> np.ndarray:
        """For each window, the sum over its counted bytes of the label probabilities."""
        out = np.zeros((len(w.n), len(self.langs)))
        order = np.argsort(-w.n, kind="stable")
        for i in range(0, len(order), rows):
            o = order[i : i + rows]
            d, m = w.data[o], w.n[o]
            w_o = np.ascontiguousarray(self.weights["o"].T)
            p = np.matmul(w_o[:, : self.hidden], self.states(d, m, "f"))
            p += np.matmul(w_o[:, self.hidden :], self.states(d, m, "b"))
            p += self.weights["c"][:, None]
            p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(axis=1, keepdims=True)
            t = np.arange(len(p))[:, None]
            p *= ((t >= w.lo[o]) & (t < w.hi[o]))[:, None, :]
            out[o] = p.sum(axis=0).T
        return out

    @property
    def hidden(self) -> int:
        return self.weights["uf"].shape[0]

    def gradients(self, data: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
        k, w = self.hidden, self.weights
        traces: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self.states(data, n, d, traces[d]) for d in "fb"], axis=1)
        logits = np.matmul(w["o"].T, h) + w["c"][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        mask = np.arange(len(h))[:, None] < n
        total = mask.sum()
        rows = np.arange(len(n))
        loss = -np.log(np.maximum(p[:, y, rows], 1e-12))[mask].sum() / total
        p[:, y, rows] -= 1
        p *= (mask / total)[:, None, :].astype(p.dtype)
        g = {"o": np.einsum("thb,tcb->hc", h, p), "c": p.sum(axis=(0, 2))}
        back = np.matmul(w["o"], p)
        for d, part in (("f", back[:, :k]), ("b", back[:, k:])):
            gx, gu, dh = np.zeros_like(w["x" + d]), np.zeros_like(w["u" + d]), np.zeros((k, len(n)), p.dtype)
            for t, live, prev, r, z, new, m in reversed(traces[d]):
                dt = dh[:, :live] + part[t, :, :live]
                dn = dt * (1 - z) * (1 - new * new)
                dz = dt * (prev - new) * z * (1 - z)
                dr = dn * m * r * (1 - r)
                np.add.at(gx, data[:live, t], np.concatenate([dr, dz, dn]).T)
                dm = np.concatenate([dr, dz, dn * r])
                gu += prev @ dm.T
                dh[:, :live] = dt * z + w["u" + d] @ dm
            g["x" + d], g["u" + d] = gx, gu
        return float(loss), g

    def train(self, data: list[np.ndarray], n: list[np.ndarray], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> float:
        """Adam over random batches of windows, given by language, of which all are drawn alike; returns the last loss."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        s = {k: np.zeros_like(v) for k, v in self.weights.items()}
        some = np.flatnonzero([len(x) > 0 for x in n])
        loss = 0.0
        for i in range(1, steps + 1):
            y = some[r.integers(0, len(some), batch)]
            pick = [int(r.integers(0, len(n[c]))) for c in y]
            d, k = np.stack([data[c][p] for c, p in zip(y, pick)]), np.array([n[c][p] for c, p in zip(y, pick)])
            order = np.argsort(-k, kind="stable")
            loss, g = self.gradients(d[order], k[order], y[order])
            step = rate * (1 - (i - 1) / steps)
            for key, v in g.items():
                m[key] = 0.9 * m[key] + 0.1 * v
                s[key] = 0.99 * s[key] + 0.01 * v * v
                self.weights[key] -= (step * (m[key] / (1 - 0.9**i)) / (np.sqrt(s[key] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return loss

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities over all bytes of each whole text; zeros without any."""
        parts = [np.zeros((0, len(self.langs)))]
        for s in tx.blocks(texts):
            w = byte_windows(texts[s])
            sums = self.label_sums(w)
            own = np.stack([np.bincount(w.doc, sums[:, c], minlength=s.stop - s.start) for c in range(len(self.langs))], axis=1)
            parts.append(own / np.maximum([len(t) for t in texts[s]], 1)[:, None])
        return np.concatenate(parts)


def training_rows(docs: DataFrame, learn: Column, text_col: str, lang_col: str, id_col: str) -> list[tuple[str, str]]:
    """The bounded sample: (language, whole text) pairs in a fixed order.

    Documents are chosen by id and language alone.  Of a language with many,
    those whose hash lies in a share that holds somewhat more than enough are
    ranked.  The sizes have a row for each language, as the model itself has;
    they are broadcast, so that this share alone is shuffled.
    """
    key = F.md5(F.concat(F.lit("lang:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    c = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), key.alias("key"), F.col(id_col).alias("id"))
    sizes = c.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    quota = F.least(F.lit(TRAIN_DOCS), F.greatest(F.lit(1), F.floor(F.lit(TRAIN_ROWS) / F.count(F.lit(1)).over(Window.partitionBy()))))
    sizes = sizes.withColumn("quota", quota.cast("int"))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0**32
    c = c.join(F.broadcast(sizes), "lang").where(place * F.col("n") <= 2 * F.col("quota") + 50)
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key", "id"))).where(F.col("rank") <= F.col("quota")).select("lang", "id", "key", "rank")
    mine = private(docs, "id", "lang", "text")
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias(mine[0]), F.col(lang_col).alias(mine[1]), F.col(text_col).alias(mine[2]))
    # At most TRAIN_ROWS short rows, or one of each language, meet the texts.
    d = texts.join(F.broadcast(c), F.col(mine[0]).eqNullSafe(F.col("id")) & (F.col(mine[1]) == F.col("lang")))
    rows = d.select("rank", "lang", "key", F.col(mine[2]).alias("text")).collect()
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["rank"], r["lang"], r["key"], r["text"]))]


def fit(rows: list[tuple[str, str]]) -> ByteGru | None:
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    datas, lengths, labels = [], [], []
    for i, lang in enumerate(langs):
        w = byte_windows([t.encode() for own, t in rows if own == lang], TRAIN_SPAN, 0)
        datas.append(np.pad(w.data, ((0, 0), (0, TRAIN_SPAN - w.data.shape[1]))))
        lengths.append(w.n)
        labels.append(np.full(len(w.n), i))
    model = ByteGru.fresh(langs)
    if len(langs) > 1 and any(len(n) for n in lengths):
        model.train(datas, lengths)
    return model


def predict(docs: DataFrame, model: ByteGru | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred and score; the model, a few hundred KB at most, goes along with the function."""
    prepare(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")  # in any case of their letters
    own = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*own, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(text_col).to_pylist()]
            letters = [any(map(str.isalpha, x)) and model is not None for x in texts]
            if model is None:
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            else:
                p = model.document_probabilities([x.encode() for x in texts])
                best = p.argmax(axis=1) if len(p) else []
                names = [model.langs[i] if ok else UNKNOWN for i, ok in zip(best, letters)]
                scores = [min(1.0, float(p[j, i])) if ok else 0.0 for j, (i, ok) in enumerate(zip(best, letters))]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in own), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*dict.fromkeys([*(f.name for f in own), text_col])).mapInArrow(run, schema)


def identify(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """``docs`` with held_out, lang_pred and score; the held-out fold is never learned from."""
    out = held_out(id_col)
    model = fit(training_rows(docs, ~F.coalesce(out, F.lit(False)), text_col, lang_col, id_col))
    inputs = docs.select(*(c for c in docs.columns if keep_text or c not in (lang_col,)))
    return predict(inputs, model, text_col, keep_text).withColumn("held_out", F.coalesce(out, F.lit(False)))
