"""Operators on the table of queries: building, keys, selection, groups."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querymill.operators.predicates import TERMS, Term

QUERY_ROW = f"qid int, name string, grp string, family string, terms {TERMS}"


class QueryBuilder:
    """A catalogue that is put together by hand; an equal query, whatever its terms' order, is added once."""

    def __init__(self, max_terms: int = 4):
        self.max_terms = max_terms
        self.rows: list[tuple[str, str, str, list[Term]]] = []
        self._keys: set[tuple[Term, ...]] = set()

    def add(self, terms: Sequence[Term], name: str, group: str, family: str) -> bool:
        key = tuple(sorted(terms))
        if not terms or len(terms) > self.max_terms or key in self._keys:
            return False
        self._keys.add(key)
        self.rows.append((name, group, family, list(terms)))
        return True

    def build(self, spark: SparkSession) -> DataFrame:
        rows = [(i, name, group, family, [tuple(t) for t in terms]) for i, (name, group, family, terms) in enumerate(self.rows)]
        return spark.createDataFrame(rows, QUERY_ROW)


def query_key(terms: str = "terms") -> Column:
    """Equal for queries with the same terms in any order; EQ v and RANGE [v, v] differ."""
    return F.to_json(F.array_sort(F.col(terms)))


def num_terms() -> Column:
    return F.size("terms")


def dedup(candidates: DataFrame, order: str = "seq", max_terms: int = 4) -> DataFrame:
    """Of equal queries the first by ``order``; empty ones and those with too many terms go.  qids follow the order."""
    c = candidates.where((F.size("terms") > 0) & (F.size("terms") <= max_terms)).withColumn("__key", query_key())
    first = c.withColumn("__r", F.row_number().over(Window.partitionBy("__key").orderBy(order))).where("__r = 1").drop("__r", "__key")
    return renumber(first, order)


def renumber(queries: DataFrame, order: str) -> DataFrame:
    """Contiguous qids by ``order``.  A catalogue is bounded, so its order may pass through one task."""
    return queries.withColumn("qid", (F.row_number().over(Window.orderBy(order)) - 1).cast("int"))


def select_queries(queries: DataFrame, keep: DataFrame) -> DataFrame:
    """The queries in ``keep`` (old_qid, place), renumbered by place; the old number stays as old_qid."""
    q = queries.withColumnRenamed("qid", "old_qid").join(keep.select("old_qid", "place"), "old_qid")
    return renumber(q, "place").drop("place")


def select_groups(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """Groups with members as in ``kept`` (old_qid, qid); empty ones go, sensitivity and is_partition stay."""
    members = groups.select("gid", F.posexplode("qids").alias("pos", "old_qid")).join(kept.select("old_qid", "qid"), "old_qid")
    qids = members.groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "qid"))), lambda x: x["qid"]).alias("qids"))
    return groups.drop("qids").join(qids, "gid")


def exclude_measured(held_out: DataFrame, measured: DataFrame) -> DataFrame:
    """Held-out queries that are not measured, by key."""
    keys = measured.select(query_key().alias("__key")).distinct()
    return held_out.withColumn("__key", query_key()).join(keys, "__key", "left_anti").drop("__key")


def family_counts(queries: DataFrame) -> DataFrame:
    return queries.groupBy("family").agg(F.count(F.lit(1)).alias("num_queries"), F.array_sort(F.collect_list("qid")).alias("qids"))


def to_json(queries: DataFrame) -> str:
    """The catalogue as JSON text; it is bounded and fits the driver."""
    rows = [r.asDict(recursive=True) for r in queries.select("qid", "name", "grp", "family", "terms").orderBy("qid").collect()]
    return json.dumps({"queries": rows}, indent=2)


def from_json(spark: SparkSession, text: str) -> DataFrame:
    data: dict[str, Any] = json.loads(text)
    names = Term._fields
    rows = [(q["qid"], q["name"], q["grp"], q["family"], [tuple(t[n] for n in names) for t in q["terms"]]) for q in data["queries"]]
    return spark.createDataFrame(rows, QUERY_ROW)
