"""The registered queries at the smallest scale: their columns and types, whole tables, and SQL where there is some."""

import glob
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle import compare, connect  # noqa: E402

from querymill.llm import oracles, queries  # noqa: E402

SF = "/root/testdata/sf0.001"

# The columns that each query must return, at least, and the table that it must cover.
CONTRACT = {
    "op1_quality_rules": ("documents", "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"),
    "op2_language_id": ("documents", "doc_id long, held_out boolean, lang_pred string, score double"),
    "op3_url_filter": ("pages", "page_id long, host string, path string, rule string, verdict string"),
    "op4_quality_classifier": ("documents", "doc_id long, held_out boolean, score double, predicted int"),
    "op5_substring_dedup": ("documents", "doc_id long, n_words long, n_removed long, kept_sha256 string"),
    "op6_mix_sources": ("documents", "doc_id long, size long, source_size long, target double, taken long"),
    "op7_bpe": ("documents", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"),
    "op8_token_counts": ("documents", "doc_id long, n_bytes long, n_tokens long, over_limit boolean"),
    "op9_nearest_neighbours": ("embeddings", "query_id long, rank int, vec_id long, score double"),
    "op10_jaccard_join": ("documents", "doc_id long, n_shingles long, component_id long"),
}
KINDS = {"long": "bigint"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_each_query_has_a_contract():
    assert set(CONTRACT) == set(queries.QUERIES) and set(oracles.ORACLES) <= set(CONTRACT)


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_and_rows(spark, con, name):
    table, columns = CONTRACT[name]
    df = queries.QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    for c in columns.split(", "):
        column, kind = c.split()
        assert kinds[column] == KINDS.get(kind, kind), column
    rows = df.collect()
    key = df.columns[0]
    if name.startswith("op9"):
        want = con.execute("SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0").fetchall()
        assert sorted((r["query_id"], r["rank"]) for r in rows) == sorted((q, k) for (q,) in want for k in range(1, 6))
        return
    want = con.execute(f"SELECT {key} FROM {table} ORDER BY 1").fetchall()
    assert sorted(r[key] for r in rows) == [x for (x,) in want]
    for r in rows:
        if "score" in kinds:
            assert 0 <= r["score"] <= 1
        if "predicted" in kinds:
            assert r["predicted"] == int(r["score"] >= 0.3)
        if "over_limit" in kinds:
            assert r["over_limit"] == (r["n_tokens"] > 4096)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, con, name):
    compare(spark, con, queries.QUERIES[name], oracles.ORACLES[name], SF)


def test_neighbours_against_all_cosines(spark, con):
    ids, vectors = zip(*con.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall())
    v = np.array(vectors, float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    at = {x: i for i, x in enumerate(ids)}
    found = 0
    got = queries.op9_nearest_neighbours(spark, SF).orderBy("query_id", "rank").collect()
    for q in [x for x in ids if x % 50 == 0]:
        own = [r for r in got if r["query_id"] == q]
        s = v @ v[at[q]]
        assert all(abs(r["score"] - s[at[r["vec_id"]]]) < 1e-12 for r in own)
        assert [r["vec_id"] for r in own] == [r["vec_id"] for r in sorted(own, key=lambda r: (-r["score"], r["vec_id"]))]
        s[at[q]] = -2
        found += len({r["vec_id"] for r in own} & {ids[i] for i in np.argsort(-s, kind="stable")[:5]})
    assert found >= 0.9 * len(got)


def test_digests_do_not_depend_on_partitions(spark, tmp_path):
    from pyspark.sql import functions as F

    d = spark.read.parquet(glob.glob(f"{SF}/documents.parquet")[0]).select("doc_id", "text", "source")
    from querymill.llm.mixing import mix_rows

    one = mix_rows(d.coalesce(1)).select("doc_id", "taken")
    other = mix_rows(d.repartition(7, F.rand(3))).select("doc_id", "taken")
    assert sorted(one.collect()) == sorted(other.collect())
