"""Exact substring deduplication by prefix-partitioned suffix trees over words.

Every window of ``MIN_WORDS`` words holds an *anchor*: the place of its least
run of ``ANCHOR`` words in a fixed random order, the first of equals.  Equal
windows have their anchors at the same place, so only the suffixes that begin
at anchors need a tree, each with the few words before it.

* Suffixes are split into groups by a prefix of variable length, the shortest
  of ``PREFIXES`` whose group stays within a memory-sized limit, or at last
  the whole window.
* Windows are screened first: a group tells which 32-bit names occur in more
  than one chunk of documents, so words are sent for these windows alone.
* For them each group builds its subtree: suffixes sorted by their words, the
  length of the common prefix of neighbours, and from it the node of each leaf
  at each depth; likewise for the words before the anchors.  Leaves of one node
  whose words before and after the anchor agree over MIN_WORDS words together
  hang from a deep internal node: their windows repeat, word by word.
* All leaves of a deep node but the first in the order (id, place) start
  earlier elsewhere.  Chains of their windows along a document are its maximal
  repeats (``repeats``), and the words that they cover are removed.

Within a chunk of documents equal windows are one leaf, so a passage that a
third of all documents hold sends one leaf from each chunk.

Words are compared by fingerprints: the screen and the anchors use one, the
trees another of 32 bits a word that is independent of it.

Defined cases: a null text has no words; words of a text without a removed word
are still joined by single spaces in ``kept_text``; a very long text is one
document of its chunk, read whole; of rows with one id the
smaller text comes first, and of equal rows either; a null id comes last; an
empty table gives an empty result; further columns are kept, whatever their
names, and those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querymill.llm import text as tx
from querymill.llm.chunks import chunked, in_order, runs, shuffle_partitions
from querymill.llm.session import prepare, private

MIN_WORDS = 20
#: Words of an anchor.
ANCHOR = 4
#: Lengths of group prefixes, in words from the anchor on; beyond them the whole window decides.
PREFIXES = (2, 4)
#: Names that each length's counts are kept for; more as the corpus grows, up to MOST_NAMES.
NAMES, MOST_NAMES = 4096, 1 << 20
#: Windows in a group: MOST fill about 100 MB of a task, and fewer than LEAST would only multiply messages,
#: of which there is one for each chunk and group.
LEAST, MOST = 1 << 18, 1 << 22
LOW = tx.U64(0xFFFFFFFF)


def anchors(h: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``width`` words the place of its anchor, and the anchor's fingerprint."""
    v = tx.window_hashes(h, size)
    span = width - size + 1
    if len(v) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # The leading bits decide, then the place.
    least = (v & ~LOW) | np.arange(len(v), dtype=np.uint64)
    have = 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    at = (least & LOW).astype(np.int64)
    return at, v[at]


class Windows:
    """The windows of some whole texts: start words, fingerprints, anchors."""

    def __init__(self, texts: list[bytes], width: int):
        self.width, self.size = width, min(ANCHOR, width)
        self.words = tx.words(texts)
        self.hashes = tx.word_hashes(self.words)
        self.starts, self.names = tx.document_windows(self.words, self.hashes, width)
        at, _ = anchors(self.hashes, width, self.size)
        self.anchor = at[self.starts]

    def prefix_names(self, level: int, names: int, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The group name of windows by a prefix length, or by the whole window."""
        if level < len(PREFIXES):
            f = tx.window_hashes(self.hashes, min(PREFIXES[level], self.size))[self.anchor[of]]
        else:
            f = self.names[of]
        return (f >> tx.U64(20)).astype(np.int64) & (names - 1)


LEVELS = len(PREFIXES) + 1


def prefix_counts(docs: DataFrame, text_col: str, names: int, width: int) -> np.ndarray:
    """How many windows of all documents have each prefix name, by prefix length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((LEVELS, names), np.int64)
        for b in batches:
            texts = tx.column_bytes(b.column(0))
            for s in tx.blocks(texts):
                w = Windows(texts[s], width)
                for i in range(LEVELS):
                    total[i] += np.bincount(w.prefix_names(i, names), minlength=names)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], names=["name", "n"])

    rows = docs.select(text_col).mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(LEVELS * names, np.int64)
    out[rows.column("name").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(LEVELS, names)


def plan_groups(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """For each prefix length and name, the group of its windows, or -1 where a longer prefix decides.

    The table has LEVELS * names entries, at most 3 * 2^20, whatever the corpus.
    """
    counts = prefix_counts(docs, text_col, NAMES, width)
    total = int(counts[0].sum())
    limit = min(MOST, max(LEAST, total // (3 * shuffle_partitions(docs))))
    names = NAMES
    while names < MOST_NAMES and total > names * limit // 8:
        names *= 2
    if names != NAMES:
        counts = prefix_counts(docs, text_col, names, width)
    own = np.where(counts <= limit, counts, 0)
    own[-1] = counts[-1]  # the whole window decides in any case
    group = np.cumsum(own.reshape(-1)) // limit
    fits = (counts <= limit).reshape(-1)
    fits[-names:] = True
    return np.where(fits, group, -1).astype(np.int32).reshape(LEVELS, names)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one range after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class ChunkWindows(Windows):
    """The windows of a chunk: which are leaves, and the messages of each group."""

    def __init__(self, texts: list[bytes], width: int, groups: np.ndarray):
        super().__init__(texts, width)
        f = self.names
        order = np.argsort(f, kind="stable")
        first = np.ones(len(f), bool)
        first[1:] = f[order][1:] != f[order][:-1]
        #: The first window of the chunk that is equal to each.
        self.same = np.empty(len(f), np.int64)
        self.same[order] = order[first][np.cumsum(first) - 1] if len(f) else order
        leaf = np.flatnonzero(self.same == np.arange(len(f)))
        group = np.full(len(leaf), -1, np.int32)
        for i in range(LEVELS):
            open_ = np.flatnonzero(group < 0)
            group[open_] = groups[i][self.prefix_names(i, groups.shape[1], leaf[open_])]
        by_group = np.argsort(group, kind="stable")
        self.leaf, self.group = leaf[by_group], group[by_group]
        self.bounds = runs(self.group)
        #: Leaves that may stand in another chunk too.
        self.again = np.zeros(len(leaf), bool)

    def screen(self) -> Iterator[tuple[int, bytes]]:
        """For each group: the 32-bit names of the leaves."""
        short = self.names[self.leaf].astype(np.uint32)
        for a, b in zip(self.bounds, self.bounds[1:]):
            yield int(self.group[a]), short[a:b].tobytes()

    def screened(self, group: int, flags: bytes) -> None:
        i = np.searchsorted(self.group[self.bounds[:-1]], group)
        a, b = self.bounds[i], self.bounds[i + 1]
        self.again[a:b] = np.unpackbits(np.frombuffer(flags, np.uint8), count=b - a).astype(bool)

    def suffixes(self, ids: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes, bytes, bytes, bytes]]:
        """For each group its suffixes: first word of the first window, windows, words before the anchor, all words; and runs of documents.

        Neighbouring windows with one anchor are one suffix with the words of all of them.
        """
        of, group = self.leaf[self.again], self.group[self.again]
        order = np.argsort(of, kind="stable")
        of, group = of[order], group[order]
        start, anchor = self.starts[of], self.anchor[of]
        if not len(of):
            return
        new = np.ones(len(of), bool)
        new[1:] = (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (group[1:] != group[:-1])
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(of)))
        by_group = np.argsort(group[head], kind="stable")
        head, n = head[by_group], n[by_group]
        start, before, group = start[head], anchor[head] - start[head], group[head]
        token = word_tokens(self.words)
        doc = self.words.doc()[start]
        bounds = runs(group)
        for a, b in zip(bounds, bounds[1:]):
            at = runs(doc[a:b])
            words = token[_ranges(start[a:b], n[a:b] + self.width - 1)]
            yield (
                int(group[a]), start[a:b].astype(np.uint32).tobytes(), n[a:b].astype(np.uint16).tobytes(), before[a:b].astype(np.uint16).tobytes(), words.tobytes(),
                ids[doc[a:b][at[:-1]]].tobytes(), np.diff(at).astype(np.uint32).tobytes(),
            )

    def removed(self, later: np.ndarray) -> np.ndarray:
        """Which words windows cover that the chunk itself holds earlier, or that start at one of ``later``."""
        own = np.flatnonzero(self.same != np.arange(len(self.same)))
        if len(own):
            # Equal by one fingerprint; the other must agree.
            other = tx.window_hashes(tx.word_hashes(self.words, second=True), self.width)
            own = own[other[self.starts[own]] == other[self.starts[self.same[own]]]]
        return tx.covered(np.concatenate([self.starts[own], later]), self.width, len(self.hashes))


def word_tokens(w: tx.Words) -> np.ndarray:
    """A number above 0 for each word, of 32 bits that the other fingerprint does not share."""
    return np.maximum((tx.word_hashes(w, second=True) >> tx.U64(32)).astype(np.uint32), 1)


def subtree(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tree of some suffixes (rows of words, 0 beyond their length): their order, and the common prefix with the one before.

    As 0 is less than any word, a suffix stands before those that it is a prefix of.
    """
    wide = words.shape[1] + words.shape[1] % 2
    even = np.zeros((len(words), wide), np.uint64)
    even[:, : words.shape[1]] = words
    pairs = (even[:, 0::2] << tx.U64(32)) | even[:, 1::2]
    order = np.lexsort(pairs.T[::-1]) if wide else np.arange(len(words))
    s, n = words[order], lengths[order]
    common = np.zeros(len(words), np.int64)
    if len(words) > 1 and wide:
        equal = np.logical_and.accumulate(s[1:] == s[:-1], axis=1).sum(axis=1)
        common[1:] = np.minimum(equal, np.minimum(n[1:], n[:-1]))
    return order, common


def nodes_at(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """The node of each suffix at a depth; those that are shorter have none of their own."""
    out = np.empty(len(order), np.int64)
    cut = common < depth
    if len(cut):
        cut[0] = False
    out[order] = np.cumsum(cut)
    return out


def later_windows(ids: np.ndarray, n: np.ndarray, before: np.ndarray, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, window of it) of all leaves of a group's deep internal nodes but the first of each.

    Suffixes come in the order of places within equal ids; ``n`` windows each, ``before`` words before the anchor.
    """
    first = np.cumsum(n + width - 1) - (n + width - 1)
    rank = np.lexsort((np.arange(len(ids)), ids))
    n, before, first = n[rank].astype(np.int64), before[rank].astype(np.int64), first[rank]
    after = n + width - 1 - before

    def matrix(at: np.ndarray, lengths: np.ndarray, step: int) -> np.ndarray:
        wide = int(lengths.max()) if len(lengths) else 0
        place = at[:, None] + step * np.arange(wide)
        inside = np.arange(wide) < lengths[:, None]
        return np.where(inside, words[np.where(inside, place, 0)], 0).astype(np.uint32)

    forth = subtree(matrix(first + before, after, 1), after)
    back = subtree(matrix(first + before - 1, before, -1), before)
    suffix, window = [], []
    for o in range(int(before.max()) + 1 if len(before) else 0):
        # Windows that begin o words before the anchor: one node at depth o backwards and width - o forwards.
        own = np.flatnonzero((o <= before) & (before - o < n))
        key = nodes_at(*forth, width - o)[own] * (len(n) + 1) + nodes_at(*back, o)[own]
        order = np.argsort(key, kind="stable")
        again = order[1:][key[order][1:] == key[order][:-1]]
        suffix.append(rank[own[again]])
        window.append(before[own[again]] - o)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *suffix]), np.concatenate([none, *window])


def spans(gone: np.ndarray) -> list[tuple[int, int]]:
    """The maximal stretches [start, end) of words that are gone."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = MIN_WORDS, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_text and repeats (the stretches of removed words, from start to before end).

    Texts are shuffled once, by chunk, and read there three times; names and
    suffixes go to groups, and answers come back by chunk.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept_text", "repeats")  # in any case of their letters
    own = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    docs = docs.select(*dict.fromkeys([*(f.name for f in own), id_col, text_col]))
    groups = docs.sparkSession.sparkContext.broadcast(plan_groups(docs, text_col, width))
    chunk = private(docs, "chunk")[0]
    by_chunk = chunked(docs, id_col, chunk)

    def opened(table: pa.Table) -> tuple[pa.Table, list[bytes], np.ndarray, ChunkWindows]:
        table, texts, ids = in_order(table, id_col, text_col)
        return table, texts, ids, ChunkWindows(texts, width, groups.value)

    def message(number: int, rows: list[tuple], names: list[str]) -> pa.Table:
        columns = list(zip(*rows)) or [()] * len(names)
        arrays = [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])]
        return pa.Table.from_arrays([pa.array([number] * len(rows), pa.int32()), *arrays], names=["chunk", *names])

    def send_names(table: pa.Table) -> pa.Table:
        return message(table.column(chunk)[0].as_py(), list(opened(table)[3].screen()), ["grp", "names"])

    def screen(table: pa.Table) -> pa.Table:
        names = [np.frombuffer(x, np.uint32) for x in table.column("names").to_pylist()]
        again = tx.repeated(np.concatenate(names))
        ends = np.cumsum([len(x) for x in names])
        flags = [np.packbits(again[e - len(x) : e]).tobytes() if again[e - len(x) : e].any() else None for x, e in zip(names, ends)]
        out = pa.Table.from_arrays([table.column("chunk"), table.column("grp"), pa.array(flags, pa.binary())], names=["chunk", "grp", "flags"])
        return out.filter(out.column("flags").is_valid())

    parts = ["first", "n", "before", "words", "ids", "counts"]

    def send_suffixes(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return message(0, [], ["grp", *parts])
        _, _, ids, windows = opened(table)
        for group, flags in zip(told.column("grp").to_pylist(), told.column("flags").to_pylist()):
            windows.screened(group, flags)
        return message(table.column(chunk)[0].as_py(), list(windows.suffixes(ids)), ["grp", *parts])

    def decide(table: pa.Table) -> pa.Table:
        def column(name: str, kind: type) -> list[np.ndarray]:
            return [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]

        first = column("first", np.uint32)
        ids = [np.repeat(i, c) for i, c in zip(column("ids", np.int64), column("counts", np.uint32))]
        n, before, words = (np.concatenate(column(*c)) for c in (("n", np.uint16), ("before", np.uint16), ("words", np.uint32)))
        suffix, window = later_windows(np.concatenate(ids), n.astype(np.int64), before, words, width)
        sender = np.repeat(np.arange(len(first)), [len(x) for x in first])
        place = np.concatenate(first)[suffix] + window.astype(np.uint32)
        order = np.argsort(sender[suffix], kind="stable")
        place, at = place[order], runs(sender[suffix][order])
        chunks = table.column("chunk").to_numpy()[sender[suffix][order][at[:-1]]]
        return pa.Table.from_arrays([pa.array(chunks, pa.int32()), pa.array([place[a:b].astype(np.uint32).tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["chunk", "places"])

    screened = by_chunk.groupBy(chunk).applyInArrow(send_names, "chunk int, grp int, names binary").groupBy("grp").applyInArrow(screen, "chunk int, grp int, flags binary")
    sent = by_chunk.groupBy(chunk).cogroup(screened.groupBy("chunk")).applyInArrow(send_suffixes, "chunk int, grp int, " + ", ".join(f"{c} binary" for c in parts))
    later = sent.groupBy("grp").applyInArrow(decide, "chunk int, places binary")

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*own, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("repeats", span)])

    def apply(table: pa.Table, told: pa.Table) -> pa.Table:
        table, texts, _, windows = opened(table)
        gone = windows.removed(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.uint32).astype(np.int64) for x in told.column("places").to_pylist())]))
        at = windows.words.first
        kept, lost, cut = [], [], []
        for t, a, b in zip(texts, at, at[1:]):
            g = gone[a:b]
            any_ = bool(g.any())
            kept.append(b" ".join(compress(t.split(), (~g).tolist()) if any_ else t.split()))
            lost.append(int(g.sum()))
            cut.append([{"start": x, "end": y} for x, y in spans(g)] if any_ else [])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        arrays = [*(table.column(f.name) for f in own), pa.array(np.diff(at)), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(cut, kind)]
        return pa.Table.from_arrays(arrays, names=schema.names)

    return by_chunk.groupBy(chunk).cogroup(later.groupBy("chunk")).applyInArrow(apply, schema)
