"""Byte-level BPE: encoding by a contiguous rank array, and decoding.

Defined cases: a null text counts as empty and has no ids; special tokens of
the vocabulary that stand in a text are one id each; of equal ranks the first
pair of a word merges first; a very long text is read whole, and a very long word
by a heap; an empty table gives an empty result; repeated rows are encoded
alike; further columns are kept, and those named like a result column are
replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from querymill.llm.session import prepare

# Fixed value: the pattern that splits text before the merges, with white space by its Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words of more bytes are merged with a heap; the rank array is scanned again and again, which suits short words.
SHORT = 64
#: Entries of a worker's word cache; it is emptied when full.
CACHE = 300_000

NO_PAIR = 1 << 40


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte: itself if printable in Latin-1, else the next free code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level vocabulary; ``encode`` and ``decode`` of whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(letter[c] for c in token)
        self.byte_id = [0] * 256
        for c, b in letter.items():
            self.byte_id[b] = vocab[c]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        for content, i in self.special.items():
            self.pieces[i] = content.encode()
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.split = regex.compile(PATTERN).findall
        self.odd_space = re.compile(r" \s|\s ").search
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.cache: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: a contiguous array of parts, and beside it the rank of each part with the next."""
        parts = [self.byte_id[b] for b in word]
        if len(parts) > SHORT:
            return self.merge_long(parts)
        get = self.pairs.get
        none = (NO_PAIR, -1)
        ranks = [get(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least[0] == NO_PAIR:
                break
            i = ranks.index(least)
            parts[i] = least[1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order, least rank first and leftmost among equals, in n log n."""
        n = len(parts)
        after, before, get = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs.get
        heap = [(*m, i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := get((parts[i], parts[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (m := get((parts[left], parts[after[left]]))):
                    heapq.heappush(heap, (m[0], left, m[1], parts[left], parts[after[left]]))
        return [p for p in parts if p >= 0]

    def unit(self, s: str) -> bytes:
        """Ids of a stretch of text, as little-endian 32-bit integers."""
        ids: list[int] = []
        for word in self.split(s):
            ids += self.merge(word.encode())
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian 32-bit integers."""
        if self.cut and any(s in text for s in self.special):
            return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self.plain(x) for x in self.cut(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        # A word takes at most one space, in front: a lone space between other
        # characters always begins a word, so the text may be cut there and
        # the pieces looked up.  Texts with other white space beside a space
        # are cut by the pattern alone.
        if not text:
            return b""
        pieces = self.split(text) if self.odd_space(text) else self.pieces_of(text)
        cache = self.cache
        try:
            return b"".join([cache[p] for p in pieces])
        except KeyError:
            pass
        if len(cache) > CACHE:
            cache.clear()
        out = []
        for p in pieces:
            ids = cache.get(p)
            if ids is None:
                ids = self.unit(p)
                if len(p) <= 2 * SHORT:
                    cache[p] = ids
            out.append(ids)
        return b"".join(out)

    @staticmethod
    def pieces_of(text: str) -> list[str]:
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]]

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def _mapped(docs: DataFrame, fields: list[tuple[str, T.DataType, pa.DataType]], drop: set[str], text_col: str, values) -> DataFrame:
    prepare(docs.sparkSession)
    docs = docs.drop(*(n for n, *_ in fields))  # in any case of their letters
    own = [f for f in docs.schema.fields if f.name not in drop]
    schema = T.StructType([*own, *(T.StructField(n, t) for n, t, _ in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [[] for _ in fields]
            for x in b.column(text_col).to_pylist():
                for c, v in zip(columns, values(x)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in own), *(pa.array(c, k) for c, (_, _, k) in zip(columns, fields))], names=schema.names)

    return docs.select(*dict.fromkeys([*(f.name for f in own), text_col])).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids`` (little-endian 32-bit integers)."""

    def values(x: str | None):
        ids = load(path).encode(x or "")
        return len(ids) // 4, ids

    return _mapped(docs, [("n_tokens", T.LongType(), pa.int64()), ("ids", T.BinaryType(), pa.binary())], set(), text_col, values)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the ``decoded`` text of its ids."""
    return _mapped(encoded, [("decoded", T.StringType(), pa.string())], set(), ids_col, lambda ids: (load(path).decode(ids or b""),))


def digests(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_tokens, ids_sha256 and decoded_sha256.

    The ids are encoded and decoded in the same pass, so neither ids nor
    decoded texts leave the worker.
    """

    def values(x: str | None):
        bpe = load(path)
        ids = bpe.encode(x or "")
        return len(ids) // 4, sha256(ids).hexdigest(), sha256(bpe.decode(ids).encode()).hexdigest()

    fields = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    return _mapped(docs, fields, {text_col}, text_col, values)
