"""Operators on small tables: against plain versions, and in odd cases."""

import hashlib
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import plain  # noqa: E402

from querymill.llm import ann, bpe, language_id, mixing, ngram_join, quality_knn, quality_rules, substring_dedup, token_counts, url_filter  # noqa: E402
from querymill.llm.queries import op5_substring_dedup, op10_jaccard_join, tokenizer  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD_TEXTS = [None, "", "   ", "one", "a b c d e", "x" * 5000, "word " * 400]


def copies(n=6, words=60, seed=1):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        base = [r.choice("abcdefghij") + r.choice("klmnop") + str(r.randint(0, 30)) for _ in range(words)]
        out.append(" ".join(base))
        for k in (0, 1, 2, 4):
            w = list(base)
            for _ in range(k):
                w[r.randrange(len(w))] = f"new{r.randint(0, 999)}"
            out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows():
    texts = copies() + ODD_TEXTS + ["A B C D E", "one", None]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in rows], DOC)


def test_jaccard_classes(docs, rows):
    want = plain.jaccard_components(rows)
    for limit in (ngram_join.CELL, 150):  # the second makes cells recurse between tasks
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_classes(docs, limit=limit, pivots=2).collect()}
        assert [got[i] for i, _ in rows] == want


def families(seed, n=60, size=40, most=7):
    """Sets that each replace up to ``most`` elements of an earlier one: families, some linked by few pairs."""
    r = np.random.default_rng(seed)
    out = [np.unique(r.integers(0, 1 << 62, size).astype(np.uint64))]
    while len(out) < n:
        base = out[r.integers(max(0, len(out) - 20), len(out))].copy()
        m = r.integers(1, most + 1)
        base[r.choice(size, m, replace=False)] = r.integers(0, 1 << 62, m).astype(np.uint64)
        out.append(np.unique(base))
    return out


def partition(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = label[a], label[b]
        label = [x if v == y else v for v in label]
    return {tuple(i for i in range(n) if label[i] == v) for v in set(label)}


def plain_links(sets):
    held = [set(s.tolist()) for s in sets]
    return [(i, j) for i in range(len(held)) for j in range(i) if 100 * len(held[i] & held[j]) >= 80 * len(held[i] | held[j])]


def region_members(spark, regions):
    key = {(c, i): f"{c:06d}{i:010d}".encode() for c, sets in regions.items() for i in range(len(sets))}
    data = [(str(c), bytearray(key[c, i]), len(s), bytearray(s.tobytes()), s.view(np.int64).tolist()) for c, sets in regions.items() for i, s in enumerate(sets)]
    return {k: ci for ci, k in key.items()}, spark.createDataFrame(data, "cell string, key binary, size long, shingles binary, early array<long>")


def wrong_regions(spark, regions, limit, pivots, depth):
    """The regions in which region_links does not join the sets as all links do."""
    back, members = region_members(spark, regions)
    found = {c: [] for c in regions}
    for r in ngram_join.region_links(members, limit, pivots, depth).collect():
        (c, i), (_, j) = back[bytes(r["a"])], back[bytes(r["b"])]
        found[c].append((i, j))
    return [c for c, sets in regions.items() if partition(len(sets), found[c]) != partition(len(sets), plain_links(sets))]


def test_regions_in_memory_recurse_exactly():
    for seed in range(16):
        sets = families(seed, n=80, most=3 + seed % 9)
        n, want = len(sets), plain_links(sets)
        for pivots in (1, 2, 3, 12):
            r = ngram_join.RegionJoin(sets, np.ones(n, bool), np.arange(n), pivots)
            assert partition(n, [x[:2] for x in r.links]) == partition(n, want), (seed, pivots)
            assert {(max(i, j), min(i, j)) for i, j, _ in r.links} <= set(want)
            assert any(by_pivot for *_, by_pivot in r.links)


def test_visitors_meet_only_members_at_home():
    word = np.arange(200, dtype=np.uint64)
    near = [np.delete(word[:41], i) for i in range(3)]  # at home, of the region's largest class
    far = [np.delete(word[100:141], i) for i in range(5)]  # visitors
    far.append(np.concatenate([word[:38], word[100:103]]))  # linked to those at home
    home = np.array([True] * 3 + [False] * 6)
    for pivots in (1, 2, 12):
        links = ngram_join.RegionJoin(near + far, home, np.where(home, 0, 1), pivots).links
        assert [sorted((i < 3, j < 3)) for i, j, _ in links] == [[False, True]]
        links = ngram_join.RegionJoin(near + far, home, np.array([0, 1, 2] + [3] * 6), pivots).links
        assert partition(9, [x[:2] for x in links] + [(3, i) for i in range(4, 9)]) == {tuple(range(9))}


def test_families_over_several_pivots(spark):
    assert wrong_regions(spark, {c: families(c) for c in range(16)}, 700, 3, 1) == []


def test_visitors_of_a_cell_that_is_split_again(spark):
    assert wrong_regions(spark, {140: families(140)}, 700, 3, 3) == []


def test_cells_that_stay_large_are_split_by_early_shingles(spark):
    assert wrong_regions(spark, {c: families(c, n=30, size=20, most=3) for c in range(4)}, 90, 2, 0) == []


def test_classes_of_whole_documents_through_pivots(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op10_jaccard_join(spark, "/root/testdata/sf0.01").collect()}
    assert [got[i] for i, _ in rows] == plain.jaccard_components(rows)
    n = ngram_join._Names("doc_id", "text")
    nodes = ngram_join._nodes(d.withColumn("__text", F.xxhash64("text")), n)
    links = ngram_join.region_links(ngram_join.region_members(d, nodes, n)).collect()
    assert sum(r["by_pivot"] for r in links) > 0.9 * len(links) > 0


def test_repeated_rows_share_one_answer(spark):
    d = spark.createDataFrame([(1, "a b c d e f", 9), (1, "a b c d e f", 9), (None, "a b c d e f", 8)], "doc_id long, text string, component_id long")
    got = ngram_join.jaccard_classes(d)
    assert sorted(got.columns) == ["component_id", "doc_id", "n_shingles", "text"]
    assert {r["component_id"] for r in got.collect()} == {1} and got.count() == 3


def test_substring_dedup(docs, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert [got[i] for i, _ in rows] == plain.without_repeats(rows)


def test_substring_dedup_of_whole_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op5_substring_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert [got[i] for i, _ in rows] == [(n, m, hashlib.sha256(t.encode()).hexdigest()) for n, m, t in plain.without_repeats(rows)]


@pytest.mark.parametrize("width", [20, 8, 3])
def test_groups_of_suffixes_find_all_later_windows(width):
    r = random.Random(width)
    for vocabulary in (1, 2, 5, 1000):
        rows: list[tuple[int, str]] = []
        for i in range(40):
            t = [f"w{r.randrange(vocabulary)}" for _ in range(r.randint(0, 120))]
            if rows:
                o = r.choice(rows)[1].split()
                a = r.randrange(len(o) + 1)
                t[5:5] = o[a : a + r.randint(5, 60)]
            rows.append((i, " ".join(t)))
        one = substring_dedup.ChunkWindows([t.encode() for _, t in rows], width, np.zeros((substring_dedup.LEVELS, 64), np.int32))
        alone = [substring_dedup.ChunkWindows([t.encode()], width, np.zeros((substring_dedup.LEVELS, 64), np.int32)) for _, t in rows]
        later = [[] for _ in rows]
        for w in alone:
            w.again[:] = True
        sent = [next(w.suffixes(np.array([i])), None) for i, w in enumerate(alone)]
        parts = [(i, m) for i, m in enumerate(sent) if m]
        first, n, before, words = ([np.frombuffer(m[k], t) for _, m in parts] for k, t in ((1, np.uint32), (2, np.uint16), (3, np.uint16), (4, np.uint32)))
        sender = np.repeat([i for i, _ in parts], list(map(len, first)))
        suffix, window = substring_dedup.later_windows(sender, np.concatenate(n).astype(np.int64), np.concatenate(before), np.concatenate(words), width)
        for i, p in zip(sender[suffix], np.concatenate(first)[suffix].astype(np.int64) + window):
            later[i].append(p)
        whole = one.removed(np.zeros(0, np.int64))
        for i, (w, (_, m, _)) in enumerate(zip(alone, plain.without_repeats(rows, width))):
            gone = w.removed(np.array(later[i], np.int64))
            assert gone.sum() == m and (gone == whole[one.words.first[i] : one.words.first[i + 1]]).all()


def test_mixing(spark, docs):
    m = mixing.mix(docs)
    assert set(docs.columns) < set(m.columns)
    got = m.collect()
    assert len(got) == docs.count()
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in got)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    most = max(r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * most
    assert mixing.repeat_taken(m, docs.columns).count() == sum(r["copies"] for r in got)


def test_quality_rules_reject_a_bad_host(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "spam " * 50
    data = [(i, good, "good") for i in range(30)] + [(100 + i, bad, "bad") for i in range(60)] + [(200, good, "bad"), (201, None, None)]
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert out[0]["kept"] and not out[100]["kept"] and out[100]["base_failed"]
    assert not out[200]["base_failed"] and not out[200]["kept"]
    assert out[201]["n_words"] == 0 and not out[201]["kept"]


def test_language_gradients_are_right():
    m = language_id.ByteGru.fresh(["a", "b", "c"], hidden=3)
    m.weights = {k: v.astype(np.float64) for k, v in m.weights.items()}
    r = np.random.default_rng(0)
    data, n, y = r.integers(0, 256, (4, 24)).astype(np.uint8), np.array([6, 5, 2, 1]), np.array([0, 2, 1, 0])
    _, g = m.gradients(data, n, y)
    for k in m.weights:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = m.weights[k][i]
        ends = []
        for e in (1e-3, -1e-3):
            m.weights[k][i] = old + e
            ends.append(m.gradients(data, n, y)[0])
        m.weights[k][i] = old
        assert abs((ends[0] - ends[1]) / 2e-3 - g[k][i]) < 2e-3 * max(1, abs(g[k][i])), k


def plain_probabilities(m, text):
    """The mean label probabilities of a text that fits one window, byte by byte."""

    def states(order, d):
        k, h, out = m.hidden, np.zeros(m.hidden), {}
        for t in order:
            a, b = m.weights["x" + d][text[t]], h @ m.weights["u" + d]
            r, z = (1 / (1 + np.exp(-(a + b)[i * k : (i + 1) * k])) for i in (0, 1))
            new = np.tanh(a[2 * k :] + r * b[2 * k :])
            h = (1 - z) * new + z * h
            out[t] = h
        return out

    places = range(len(text))
    f, b = states(places, "f"), states(reversed(places), "b")
    p = [np.exp(np.concatenate([f[t], b[t]]) @ m.weights["o"] + m.weights["c"]) for t in places]
    return np.mean([x / x.sum() for x in p], axis=0)


def test_language_of_a_text_is_a_plain_forward_pass():
    m = language_id.ByteGru.fresh(["a", "b", "c"])
    texts = ["the cat sat".encode(), "日本語の文章には空白がない".encode() * 8, b"x", b"ab " * 100]
    got = m.document_probabilities([*texts, b""])
    for g, t in zip(got, texts):
        assert np.allclose(g, plain_probabilities(m, t), atol=1e-4)
    assert not got[-1].any()


def test_long_texts_carry_state_over_windows():
    m = language_id.fit([("a", "abc abd aab " * 60), ("b", "xyz xxy zzy " * 60), ("c", "日本語文章空白" * 60)])
    texts = [t.encode() for t in ("abcaab" * 900, "xyzzy " * 700, "空白文章" * 400)]
    p = m.document_probabilities(texts)
    assert p.argmax(axis=1).tolist() == [0, 1, 2]
    w = language_id.byte_windows(texts)
    assert (w.hi - w.lo).sum() == sum(map(len, texts)) and (w.lo[1:] >= 0).all()
    # One window over all of a text gives nearly the same.
    one = language_id.byte_windows(texts, span=10_000)
    assert np.abs(m.label_sums(one) / np.array([[len(t)] for t in texts]) - p).max() < 0.02


def test_language_and_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    p = language_id.identify(d.select("doc_id", "text", "lang"), keep_text=False).select("doc_id", "held_out", "lang_pred").join(d.select("doc_id", "lang"), "doc_id")
    hits = p.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert hits > 0.95
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    q = quality_knn.classify(d.select("doc_id", "text"), labels, keep_text=False).join(labels, "doc_id")
    assert q.where("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.9


def test_votes_equal_all_cosines_one_by_one(spark):
    """Each document of a table against each labelled vector, and ties at the last place that votes."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    m = quality_knn.fit(d, labels)
    texts = [r["text"] for r in d.orderBy("doc_id").collect()] + ["", "ab"]
    latent = m.latent(quality_knn.features([(t or "").encode() for t in texts]))
    got = m.scores(latent)
    assert len(m.vectors) > quality_knn.NEIGHBOURS
    for v, g in zip(latent, got):
        near = sorted((-round(float(np.float32(v @ u)) * 1e6), i) for i, u in enumerate(m.vectors))[: quality_knn.NEIGHBOURS]
        w = [max(-s / 1e6, 0) ** quality_knn.SHARPNESS for s, _ in near]
        want = sum(a * m.labels[i] for a, (_, i) in zip(w, near)) / sum(w) if sum(w) and v.any() else m.base
        assert abs(g - want) < 1e-4
    by_query = {r["doc_id"]: r["score"] for r in quality_knn.classify(d, labels).collect()}
    assert max(abs(by_query[r["doc_id"]] - s) for r, s in zip(d.orderBy("doc_id").collect(), got)) < 1e-4


@pytest.mark.parametrize("copies_", [10, 3000])
def test_equal_neighbours_vote_in_the_order_of_the_sample(copies_):
    """The near ones fill the places of several blocks; of the equal rest the first ones vote."""
    near, other = np.eye(2, dtype=np.float32)
    vectors = np.array([other] * 5 + [near] * copies_ + [other] * 2000)
    labels = (np.arange(len(vectors)) % 3 == 0).astype(np.float32)
    m = quality_knn.KnnModel(np.ones(1), np.eye(2), vectors, labels, 0.5)
    v = np.array([[0.8, 0.6]], np.float32)
    first = list(range(5, 5 + min(copies_, quality_knn.NEIGHBOURS)))
    rest = [i for i in range(len(vectors)) if not 5 <= i < 5 + copies_][: quality_knn.NEIGHBOURS - len(first)]
    w = np.array([0.8] * len(first) + [0.6] * len(rest)) ** quality_knn.SHARPNESS
    assert abs(m.scores(v)[0] - (w * labels[first + rest]).sum() / w.sum()) < 1e-6


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(i, t, None) for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(d).collect()} == {"und"}
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_knn.classify(d, none).collect()} == {0.5}


def test_neighbours_equal_brute_force_on_a_small_table(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8)).astype(np.float32)
    x[10:60] = x[0]  # a vector that many rows hold
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] + [1.0] * 7), (350, [1.0, None] + [1.0] * 6), (400, [1.0])]
    got = ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()
    y = x.astype(np.float64)
    n = np.sqrt((y * y).sum(1))
    for q in range(0, 300, 50):
        s = np.round(y @ y[q] / (n * n[q]), 12)
        s[q] = -9
        want = np.lexsort((np.arange(300), -s))[:5]
        assert [g["vec_id"] for g in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])] == want.tolist()
    assert {g["query_id"] for g in got} == set(range(0, 300, 50))


def test_graph_settles_from_a_poor_start(spark):
    x = np.random.default_rng(5).normal(size=(1500, 8))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>")
    points = ann.stable(ann.rounded(nodes))
    ring = [(np.arange(i + 1, i + 11) % 1500).astype(np.int64) for i in range(1500)]
    start = spark.createDataFrame([(i, bytearray(r.tobytes()), bytearray(np.full(10, -1, np.float32).tobytes())) for i, r in enumerate(ring)], ann.LISTS)
    y = x / np.sqrt((x * x).sum(1, keepdims=True))
    s = y @ y.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]

    def recall(graph):
        return np.mean([np.isin(want[r["node"]], np.frombuffer(r["ids"], np.int64)).mean() for r in graph.collect()])

    assert recall(ann.settled(start, points, 10, rounds=1)) < 0.5
    assert recall(ann.settled(start, points, 10)) > 0.95


def test_recall_comes_from_the_descent_on_many_blocks(spark):
    x = np.random.default_rng(6).normal(size=(20_000, 24)).astype(np.float32)
    d = ann.stable(spark.createDataFrame(enumerate(x.tolist()), "vec_id long, embedding array<float>"))
    u = x.astype(np.float64) / np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))

    def recall(**how):
        got: dict[int, set[int]] = {}
        for r in ann.nearest(d, every=200, **how).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        hits = []
        for q in range(0, len(u), 200):
            s = u @ u[q]
            s[q] = -9
            hits.append(len(got[q] & set(np.argsort(-s)[:5].tolist())) / 5)
        return np.mean(hits)

    start, end = recall(rounds=0), recall()
    assert start < end and end >= 0.9


def test_maps_on_odd_texts(spark, docs):
    out = bpe.digests(docs, tokenizer("byte_bpe_50k.json"))
    for r, (_, t) in zip(out.orderBy("doc_id").collect(), docs.select("doc_id", "text").orderBy("doc_id").collect()):
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    counts = token_counts.count_tokens(docs, tokenizer("piece_bpe_32k.model")).where("text IS NULL").first()
    assert counts["n_tokens"] == 0 and counts["n_bytes"] == 0


def test_empty_tables(spark):
    d = spark.createDataFrame([], DOC)
    pages = spark.createDataFrame([], "page_id long, url string, host string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (
        quality_rules.quality_rules(d), language_id.identify(d), url_filter.filter_urls(pages), quality_knn.classify(d, labels), substring_dedup.remove_repeats(d), mixing.mix(d),
        bpe.digests(d, tokenizer("byte_bpe_50k.json")), token_counts.count_tokens(d, tokenizer("piece_bpe_32k.model")), ann.nearest(vectors), ngram_join.jaccard_classes(d),
    ):
        assert out.count() == 0


@pytest.mark.parametrize(
    "names, run",
    [
        ("N_Words KEPT Base_Failed shrunk_RATE", lambda d, _: quality_rules.quality_rules(d)),
        ("SCORE Lang_Pred HELD_OUT", lambda d, _: language_id.identify(d)),
        ("HOST Path RULE Verdict", lambda d, _: url_filter.filter_urls(d, url_col="text")),
        ("SCORE Predicted HELD_OUT", quality_knn.classify),
        ("N_Words N_REMOVED Kept_Text", lambda d, _: substring_dedup.remove_repeats(d)),
        ("SIZE Source_Size TARGET Taken COPIES", lambda d, _: mixing.mix(d)),
        ("N_Tokens IDS_sha256 Decoded_SHA256", lambda d, _: bpe.digests(d, tokenizer("byte_bpe_50k.json"))),
        ("N_Tokens N_BYTES Over_Limit", lambda d, _: token_counts.count_tokens(d, tokenizer("piece_bpe_32k.model"))),
        ("N_Shingles COMPONENT_ID", lambda d, _: ngram_join.jaccard_classes(d)),
    ],
)
def test_result_names_in_other_case_are_replaced(spark, names, run):
    rows = [(i, t, "en", "s", *["old"] * len(names.split())) for i, t in enumerate([None, "", "a b c d e f", "a b c d e f"])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names.split()))
    out = run(d, spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, quality int"))
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    got = out.collect()
    assert len(got) == 4
    assert all(r[c.lower()] != "old" for r in got for c in names.split())


def test_hostile_columns_and_texts(spark):
    """Null, empty, huge and repeated texts, null ids, and columns named like private ones."""
    huge = "lorem ipsum dolor sit amet " * 20_000
    texts = [None, "", huge, "a b c d e f", "a b c d e f", "one", huge]
    extra = ["__key", "__id", "__chunk", "__text", "__set", "__host", "__k", "host_kept", "label", "node", "chunk"]
    rows = [(None if i == 5 else min(i, 5), t, "en", "s", *([str(i)] * len(extra))) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in extra))
    for out in (quality_rules.quality_rules(d), substring_dedup.remove_repeats(d), mixing.mix(d), ngram_join.jaccard_classes(d), language_id.identify(d), token_counts.count_tokens(d, tokenizer("piece_bpe_32k.model"))):
        assert set(d.columns) <= set(out.columns)
        assert sorted(r["__key"] for r in out.select("__key").collect()) == sorted(map(str, range(len(texts))))
