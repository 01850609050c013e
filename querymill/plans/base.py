"""What the registered queries share: the encoded line items, and SQL for them.

The encoding is the same text on both sides: attributes 0 and 1 are
categorical, 2 and 3 have small numeric domains, 4 and 5 are cut at quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.operators import encode as enc
from querymill.operators.schema import TableSchema

COLUMNS = ("l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_quantity", "l_extendedprice")
CATEGORICAL_COLUMNS = ("l_returnflag", "l_linestatus")
NUMERICAL_COLUMNS = ("l_discount", "l_tax", "l_quantity", "l_extendedprice")
BINS = 12
ROW_ID = "l_orderkey * 100 + l_linenumber"

_SCHEMAS: dict[tuple, TableSchema] = {}


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def listing(spark: SparkSession, path: str) -> tuple:
    """The application, and the files of a table with their sizes and times, so that changed files are noticed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return (spark.sparkContext.applicationId, *sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files))


def schema(spark: SparkSession, sf_dir: str) -> TableSchema:
    """The schema of the line items; a few hundred bytes, fitted once for each state of the table's files."""
    key = listing(spark, f"{sf_dir}/lineitem.parquet")
    if key not in _SCHEMAS:
        _SCHEMAS[key] = enc.fit_schema(lineitem(spark, sf_dir), COLUMNS, BINS, NUMERICAL_COLUMNS, CATEGORICAL_COLUMNS)
    return _SCHEMAS[key]


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enc.encode(lineitem(spark, sf_dir), schema(spark, sf_dir), F.expr(ROW_ID))


def values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


def r6(c, name: str):
    """Rounded to six places, without negative zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


# --- DuckDB ------------------------------------------------------------------


def sql_r6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def sql_uniform(salt: str, *ids: str) -> str:
    """The same draw as functions.rand.uniform."""
    key = " || ':' || ".join([f"'{salt}'", *[f"CAST({i} AS VARCHAR)" for i in ids]])
    return f"((CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def sql_integer(low: str, high: str, salt: str, *ids: str) -> str:
    return f"CAST(({low}) + floor({sql_uniform(salt, *ids)} * (({high}) - ({low}) + 1)) AS INTEGER)"


def sql_gaussian(salt: str, *ids: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln({sql_uniform(salt + '/r', *ids)})) * cos(6.283185307179586::DOUBLE * {sql_uniform(salt + '/a', *ids)}))"


def sql_gumbel(salt: str, *ids: str) -> str:
    return f"(-ln(-ln({sql_uniform(salt, *ids)})))"


def _dictionary(i: int, c: str) -> str:
    return f"d{i} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT {c} AS v FROM lineitem))"


def sql_edges(c: str, bins: int = BINS, table: str = "lineitem") -> str:
    at = ", ".join(repr(i / bins) for i in range(bins + 1))
    return f"(SELECT list_sort(list_distinct([round(x, 9) for x in quantile_cont(CAST({c} AS DOUBLE), [{at}])])) FROM {table})"


def sql_bin(c: str, edges: str) -> str:
    return f"CAST(len([e for e in {edges}[2:len({edges}) - 1] if e <= {c}]) AS INTEGER)"


#: The encoded table ``enc`` (row_id, c0 .. c5) and the attribute table ``attrs`` (attr, kind, cardinality).
ENC = f"""
{_dictionary(0, COLUMNS[0])}, {_dictionary(1, COLUMNS[1])}, {_dictionary(2, COLUMNS[2])}, {_dictionary(3, COLUMNS[3])},
edges AS (SELECT {sql_edges(COLUMNS[4])} AS e4, {sql_edges(COLUMNS[5])} AS e5),
enc AS (
  SELECT l_orderkey * 100 + l_linenumber AS row_id, d0.code AS c0, d1.code AS c1, d2.code AS c2, d3.code AS c3,
         {sql_bin("l_quantity", "e4")} AS c4, {sql_bin("l_extendedprice", "e5")} AS c5
  FROM lineitem, edges, d0, d1, d2, d3
  WHERE l_returnflag = d0.v AND l_linestatus = d1.v AND l_discount = d2.v AND l_tax = d3.v
),
attrs AS (
  SELECT 0 AS attr, 'categorical' AS kind, (SELECT CAST(count(*) AS INTEGER) FROM d0) AS k
  UNION ALL SELECT 1, 'categorical', (SELECT CAST(count(*) AS INTEGER) FROM d1)
  UNION ALL SELECT 2, 'numerical_binned', (SELECT CAST(count(*) AS INTEGER) FROM d2)
  UNION ALL SELECT 3, 'numerical_binned', (SELECT CAST(count(*) AS INTEGER) FROM d3)
  UNION ALL SELECT 4, 'numerical_binned', (SELECT CAST(len(e4) - 1 AS INTEGER) FROM edges)
  UNION ALL SELECT 5, 'numerical_binned', (SELECT CAST(len(e5) - 1 AS INTEGER) FROM edges)
)"""
#: (row_id, attr, code), a row for each code.
LONG = "long AS (" + " UNION ALL ".join(f"SELECT row_id, {i} AS attr, c{i} AS code FROM enc" for i in range(6)) + ")"
