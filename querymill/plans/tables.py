"""Queries of encoding, decoding and schema inference."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.functions.lineage import new_folder
from querymill.operators import encode as enc
from querymill.operators.schema import CATEGORICAL
from querymill.plans import base
from querymill.plans.base import BINS, COLUMNS, ENC, r6, sql_bin, sql_edges, sql_r6
from querymill.sources import config as cfg
from querymill.sources import tables as sources

# Literal rows with missing values and texts that are no numbers.
ODD = [(1, "b", "5"), (2, None, "5d"), (3, "", " 7.5 "), (4, "?", "nan"), (5, " ?", None), (6, "é", "1e2"), (7, "Z", "-0.5"), (8, "z", ""), (9, "b", "Infinity"), (10, "😀", "+3"), (11, "a", ".5"), (12, "b", "5.")]
_ODD_SQL = "odd(id, cat, num) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in ODD) + ")"
NUMBER_SQL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ODD, "id int, cat string, num string")


# Texts by c_custkey % 8: missing ones, and such as a reader must leave alone.
CSV_TEXTS = (None, "NA", "n/a", "#N/A", "", " padded ", 'say ""so"", or "not"', "na\\")


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV and read again: all texts, and the missing ones null."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    note = F.get(F.array(*map(F.lit, CSV_TEXTS)), (F.col("c_custkey") % len(CSV_TEXTS)).cast("int"))
    path = new_folder(spark, "csv")
    sources.write_csv(df.select("c_custkey", "c_nationkey", "c_mktsegment", note.alias("note")), path)
    return sources.read_csv(spark, path)


def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration written as YAML, read, overridden, and read again as JSON; a row for each leaf."""
    path = new_folder(spark, "config").removeprefix("file:")
    cfg.save_yaml({"a": {"b": 1, "text": "x y"}, "list": [1, 2.5]}, f"{path}/c.yaml")
    tokens = ["--a.b", "2", "--a.c=true", "--d.e.f", "1e-3", "--g", "None", "--list", "z", "--h=-7", "--i", "--j"]
    cfg.write_json(cfg.apply_overrides(cfg.load_yaml(f"{path}/c.yaml"), tokens), f"{path}/out/c.json")
    found = cfg.read_json(f"{path}/out/c.json")
    rows = [(k, type(v).__name__, json.dumps(v)) for k in ("a.b", "a.c", "a.text", "d.e.f", "g", "h", "i", "list") for v in [cfg.require(found, k)]]
    rows.append(("missing", "str", json.dumps(cfg.get(found, "a.none", "default"))))
    return spark.createDataFrame(rows, "name string, kind string, value string")


def encode_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted categories and their codes."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    schema = enc.fit_schema(df, ["p_brand", "p_type"], categorical=("p_brand", "p_type"))
    coded = enc.encode(df, schema, "p_partkey")
    return coded.select(F.col("row_id").alias("p_partkey"), F.col("c0").alias("brand_code"), F.col("c1").alias("type_code"))


def encode_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts as missing, and what counts as a number."""
    df = _odd(spark)
    schema = enc.fit_schema(df, ["cat", "num"], numerical=("num",), categorical=("cat",))
    coded = enc.encode(df, schema, "id").select(F.col("row_id").alias("id"), F.col("c0").alias("cat_code"), F.col("c1").alias("num_code"))
    return coded.join(df.select(F.col("id").cast("long").alias("id"), enc.category_value(F.col("cat")).alias("category"), enc.numeric_value(F.col("num")).alias("number")), "id")


def sorted_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories in code point order."""
    df = _odd(spark)
    return df.agg(F.sort_array(F.collect_set(enc.category_value(F.col("cat")))).alias("c")).select(F.posexplode("c").alias("code", "category"))


def encode_small_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal codes of small numeric domains."""
    out = base.encoded(spark, sf_dir).groupBy(F.col("c2").alias("discount_code"), F.col("c3").alias("tax_code"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


def quantile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct interpolated quantiles."""
    df = base.lineitem(spark, sf_dir)
    parts = [enc.quantile_edges(df, c, BINS).select(F.lit(c).alias("name"), F.posexplode("edges").alias("place", "edge")) for c in COLUMNS[4:]]
    return parts[0].union(parts[1]).select("name", "place", r6(F.col("edge"), "edge"))


def encode_quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by inner quantile edges."""
    return base.encoded(spark, sf_dir).select("row_id", F.col("c4").alias("quantity_bin"), F.col("c5").alias("price_bin"))


def degenerate_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6a, E6d: a column of one value beside many bins, and one without any number."""
    df = base.lineitem(spark, sf_dir).select(F.col("l_orderkey"), F.when(F.col("l_orderkey") < 0, "1").alias("empty"), F.lit(3.5).alias("same"))
    schema = enc.fit_schema(df, ["empty", "same"], numerical=("empty", "same"))
    coded = enc.encode(df, schema, "l_orderkey").groupBy("c0", "c1").agg(F.count(F.lit(1)).alias("n"))
    return coded.withColumn("k0", F.lit(schema.attributes[0].cardinality)).withColumn("k1", F.lit(schema.attributes[1].cardinality))


def bin_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of each bin's raw values represents it."""
    schema = base.schema(spark, sf_dir)
    rows = [(a.name, i, float(r)) for a in schema.attributes[4:] for i, r in enumerate(a.representatives)]
    made = spark.createDataFrame(rows, "name string, bin int, median double")
    return made.select("name", "bin", r6(F.col("median"), "median"))


def infer_column_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by one aggregate."""
    df = base.lineitem(spark, sf_dir)
    return enc.infer_kinds(df, ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey"], categorical=("l_partkey",))


def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded categories are the raw ones."""
    df = base.encoded(spark, sf_dir)
    out = enc.decode(df, base.schema(spark, sf_dir))
    return out.select("row_id", "l_returnflag", "l_linestatus", r6(F.col("l_discount").cast("double"), "l_discount"))


def decode_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes outside the domain decode to the first representative; clipping brings them in."""
    df = base.encoded(spark, sf_dir).withColumn("c0", F.col("c0") + F.pmod(F.col("row_id"), F.lit(3)).cast("int") - 1)
    k = base.schema(spark, sf_dir).cardinalities[0]
    decoded = enc.decode(df, base.schema(spark, sf_dir)).select(F.lit("decoded").alias("kind"), F.col("l_returnflag").alias("what"))
    clipped = df.select(F.lit("clipped").alias("kind"), enc.clip(F.col("c0"), k).cast("string").alias("what"))
    return decoded.union(clipped).groupBy("kind", "what").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (csv_scan, config_values, encode_categorical, encode_missing, sorted_categories, encode_small_domain, quantile_edges, encode_quantile_bins, degenerate_bins, bin_medians, infer_column_kind, decode_roundtrip, decode_out_of_range)
}

_CATEGORY = "CASE WHEN cat IS NULL OR cat IN ('', '?') THEN '__MISSING__' ELSE cat END"
_NUMBER = f"CASE WHEN regexp_matches(num, '{NUMBER_SQL}') THEN TRY_CAST(trim(num) AS DOUBLE) END"


def _kind(c: str, listed: bool = False) -> str:
    numeric = "false" if c in CATEGORICAL_TEXT else "true"
    kind = f"'{CATEGORICAL}'" if listed or numeric == "false" else f"CASE WHEN count(DISTINCT {c}) >= 10 THEN 'numerical_binned' ELSE 'categorical' END"
    return f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n_distinct, {numeric} AS numeric_like, {kind} AS kind FROM lineitem"


CATEGORICAL_TEXT = ("l_returnflag", "l_linestatus")
ORACLES = {
    "config_values": """SELECT * FROM (VALUES ('a.b', 'int', '2'), ('a.c', 'bool', 'true'), ('a.text', 'str', '"x y"'), ('d.e.f', 'float', '0.001'), ('g', 'NoneType', 'null'),
      ('h', 'int', '-7'), ('i', 'str', '"--j"'), ('list', 'str', '"z"'), ('missing', 'str', '"default"')) v(name, kind, value)""",
    "csv_scan": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment, "
    "CASE c_custkey % 8 WHEN 5 THEN ' padded ' WHEN 6 THEN 'say \"\"so\"\", or \"not\"' WHEN 7 THEN 'na\\' END AS note FROM customer",
    "encode_categorical": "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS brand_code, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS type_code FROM part",
    "encode_missing": f"""WITH {_ODD_SQL}, v AS (SELECT CAST(id AS BIGINT) AS id, {_CATEGORY} AS category, {_NUMBER} AS number FROM odd),
      n AS (SELECT number AS x, row_number() OVER (ORDER BY number) - 1 AS code FROM (SELECT DISTINCT number FROM v WHERE number IS NOT NULL))
      SELECT id, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS cat_code,
             CAST(coalesce(n.code, (SELECT count(*) FROM n)) AS INTEGER) AS num_code, category, number
      FROM v LEFT JOIN n ON v.number = n.x""",
    "sorted_categories": f"WITH {_ODD_SQL} SELECT CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS code, category FROM (SELECT DISTINCT {_CATEGORY} AS category FROM odd)",
    "encode_small_domain": f"WITH {ENC} SELECT c2 AS discount_code, c3 AS tax_code, count(*) AS n, min(row_id) AS first_row, max(row_id) AS last_row FROM enc GROUP BY 1, 2",
    "quantile_edges": " UNION ALL ".join(f"SELECT '{c}' AS name, CAST(i - 1 AS INTEGER) AS place, {sql_r6('e[i]', 'edge')} FROM (SELECT e, unnest(range(1, len(e) + 1)) AS i FROM (SELECT {sql_edges(c)} AS e))" for c in COLUMNS[4:]),
    "encode_quantile_bins": f"WITH {ENC} SELECT row_id, c4 AS quantity_bin, c5 AS price_bin FROM enc",
    "degenerate_bins": "SELECT 0 AS c0, 0 AS c1, count(*) AS n, 1 AS k0, 1 AS k1 FROM lineitem",
    "bin_medians": " UNION ALL ".join(
        f"SELECT '{c}' AS name, bin, {sql_r6('quantile_cont(x, 0.5)', 'median')} FROM (SELECT CAST({c} AS DOUBLE) AS x, {sql_bin(c, 'e')} AS bin FROM lineitem, (SELECT {sql_edges(c)} AS e)) GROUP BY bin" for c in COLUMNS[4:]
    ),
    "infer_column_kind": " UNION ALL ".join(_kind(c, c == "l_partkey") for c in ("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey")),
    "decode_roundtrip": f"SELECT l_orderkey * 100 + l_linenumber AS row_id, l_returnflag, l_linestatus, {sql_r6('CAST(l_discount AS DOUBLE)', 'l_discount')} FROM lineitem",
    "decode_out_of_range": f"""WITH {ENC}, m AS (SELECT row_id, c0 + row_id % 3 - 1 AS c FROM enc)
      SELECT 'decoded' AS kind, coalesce(d0.v, (SELECT v FROM d0 WHERE code = 0)) AS what, count(*) AS n FROM m LEFT JOIN d0 ON d0.code = m.c GROUP BY 1, 2
      UNION ALL SELECT 'clipped', CAST(greatest(0, least(c, (SELECT k FROM attrs WHERE attr = 0) - 1)) AS VARCHAR), count(*) FROM m GROUP BY 1, 2""",
}
