"""Token counts, with overlap resynchronisation for huge documents.

A text up to ``CHUNK`` characters (longer ones: bytes) is encoded at once.  A longer one is cut into
overlapping chunks that are encoded with offsets.  Two neighbouring encodings
are spliced at a position that is a token boundary in both and is
*proven stable*: a space stands there and none before it, and no piece of the
vocabulary has a space after another character, so no merge of the whole text
crosses it.  Where an overlap has no such position the next chunk begins at the
same place and the overlap is widened, up to the rest of the text.

Defined cases: a null text counts as empty, with 0 bytes and tokens; a very long
text is encoded whole, in chunks; exactly the limit is not over it; an empty
table gives an empty result; repeated rows are counted alike; further columns
are kept, and those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querymill.llm.session import prepare

CHUNK = 16_384
OVERLAP = 256
TOKEN_LIMIT = 4096
SPACE = "▁"


class PieceCounter:
    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        #: Whether each space that follows another character begins a token, whatever the text.
        self.splits_at_space = all(SPACE not in p.lstrip(SPACE) for p in pieces)

    def boundaries(self, data: bytes, origin: int) -> list[int]:
        """Begin offsets (bytes) of the tokens of ``data``, in the coordinates of the whole text."""
        return [origin + p.begin for p in self.model.encode(data.decode(), return_type="proto").pieces]

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if len(text) <= chunk or not self.splits_at_space:
            return len(self.model.encode(text))
        return self.count_spliced(text, chunk, overlap)

    def count_spliced(self, text: str, chunk: int, overlap: int) -> int:
        data, space = text.encode(), SPACE.encode()
        total, begin = 0, 0  # tokens before `begin` are counted; it is 0 or a stable boundary
        size, lap = chunk, overlap
        while begin + size < len(data):
            end = _char_start(data, begin + size)
            # The model puts a space before what it encodes; at a stable boundary that is the text's own.
            own = begin + (begin > 0)
            left = self.boundaries(data[own:end], own)
            # The right chunk begins anywhere, so its first tokens may differ from the whole text's; the splice
            # lies at a later stable boundary.
            start = _char_start(data, end - lap)
            right = set(self.boundaries(data[start : _char_start(data, end + lap)], start))
            found = (b for b in reversed(left) if b > max(start, own) and b in right)
            splice = next((b for b in found if data[b : b + 1] == b" " and data[b - 1 : b] != b" " and data[b - 3 : b] != space), None)
            if splice is None:
                if lap * 2 < size:
                    lap *= 2
                else:
                    size, lap = size * 2, lap * 2
                continue
            total += sum(b < splice for b in left)
            begin, size, lap = splice, chunk, overlap
        if not begin:
            return len(self.model.encode(text))
        rest = data[begin + 1 :].decode()
        return total + (len(self.model.encode(rest)) if rest else 1)


def _char_start(data: bytes, i: int) -> int:
    """The nearest place at or before ``i`` where a character begins."""
    i = max(0, min(i, len(data)))
    while 0 < i < len(data) and data[i] & 0xC0 == 0x80:
        i -= 1
    return i


@lru_cache(maxsize=2)
def load(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = TOKEN_LIMIT, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit; a map without any shuffle."""
    prepare(docs.sparkSession)
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")  # in any case of their letters
    own = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*own, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for b in batches:
            texts = [x or "" for x in b.column(text_col).to_pylist()]
            sizes, tokens = [len(x.encode()) for x in texts], [counter.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in own), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=schema.names)

    out = docs.select(*dict.fromkeys([*(f.name for f in own), text_col])).mapInArrow(run, schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
