"""Queries of predicates, catalogues, workload families and their answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.functions.lineage import written
from querymill.operators import answer as ans
from querymill.operators import catalogue as cat
from querymill.operators import metrics
from querymill.operators import predicates as p
from querymill.operators import workload as wl
from querymill.operators.predicates import between, eq, ge, le
from querymill.plans import base
from querymill.plans.base import ENC, LONG, sql_integer, sql_uniform

SEED = 7
RANGES, MIXED = 20, 10
CONFIG = wl.WorkloadConfig(range_intervals=RANGES, mixed_per_pair=MIXED, seed=SEED)


def _built(spark: SparkSession, sf_dir: str, *families: str) -> tuple[DataFrame, DataFrame]:
    schema = base.schema(spark, sf_dir)
    config = wl.WorkloadConfig(range_intervals=RANGES, mixed_per_pair=MIXED, seed=SEED, families=families or wl.FAMILIES)
    return wl.build(spark, schema, config)


def _answered(spark: SparkSession, sf_dir: str, *families: str) -> DataFrame:
    queries = written(_built(spark, sf_dir, *families)[0])
    found = ans.answer(base.encoded(spark, sf_dir), queries, base.schema(spark, sf_dir).cardinalities)
    return queries.join(found, "qid").select("family", "name", "answer")


def answer_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every family of the line items, from one scan."""
    return _answered(spark, sf_dir)


def answer_oneway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, A2."""
    return _answered(spark, sf_dir, "oneway")


def answer_twoway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2, A3."""
    return _answered(spark, sf_dir, "twoway")


def answer_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3, A4."""
    return _answered(spark, sf_dir, "prefix")


def answer_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4, A5."""
    return _answered(spark, sf_dir, "range")


def answer_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5, A6."""
    return _answered(spark, sf_dir, "mixed")


def workload_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries by name, with their terms spelt out."""
    queries, _ = _built(spark, sf_dir)
    q = queries.select("family", "name", "grp", F.posexplode("terms").alias("place", "t"))
    return q.select("family", "name", "grp", "place", "t.attr", "t.op", "t.value", "t.lo", "t.hi")


def workload_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement groups."""
    _, groups = _built(spark, sf_dir)
    return groups.select("name", "family", F.size("qids").alias("size"), base.r6(F.col("sensitivity"), "sensitivity"), "is_partition")


def workload_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first queries in the order of generation."""
    schema = base.schema(spark, sf_dir)
    queries, _ = wl.build(spark, schema, wl.WorkloadConfig(max_queries=25, families=("oneway", "prefix"), seed=SEED))
    return queries.select("qid", "name")


def answer_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 with more than two attributes: the conditional counts beside cuboids."""
    b = cat.QueryBuilder()
    b.add([eq(0, 1), le(4, 5), between(5, 2, 9)], "three", "hand", "hand")
    b.add([eq(0, 0), eq(1, 1), ge(2, 4), le(3, 6)], "four", "hand", "hand")
    b.add([eq(0, 0), eq(0, 1)], "never", "hand", "hand")
    b.add([ge(5, 6)], "one", "hand", "hand")
    queries = b.build(spark)
    found = ans.answer(base.encoded(spark, sf_dir), queries, base.schema(spark, sf_dir).cardinalities)
    return queries.join(found, "qid").select("name", "answer")


def predicate_ge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3."""
    return p.select_rows(base.encoded(spark, sf_dir), [ge(4, 8)]).select("row_id", "c4")


def conjunction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2, P4-P6."""
    return p.select_rows(base.encoded(spark, sf_dir), [eq(0, 1), le(2, 4), between(5, 3, 7)]).select("row_id", "c0", "c2", "c5")


def satisfaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows against a small catalogue, sparse."""
    b = cat.QueryBuilder()
    b.add([eq(0, 1), le(4, 3)], "q0", "hand", "hand")
    b.add([ge(5, 10)], "q1", "hand", "hand")
    b.add([between(3, 2, 3), eq(1, 0)], "q2", "hand", "hand")
    rows = p.with_codes(base.encoded(spark, sf_dir), 6)
    return p.satisfied(rows, b.build(spark))


def source_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate row against its own target query only."""
    b = cat.QueryBuilder()
    for i in range(3):
        b.add([eq(0, i), le(4, 5)], f"q{i}", "hand", "hand")
    rows = p.with_codes(base.encoded(spark, sf_dir), 6).withColumn("qid", F.pmod("row_id", F.lit(3)).cast("int"))
    own = rows.join(F.broadcast(b.build(spark).select("qid", "terms")), "qid")
    return own.select("row_id", "qid", p.holds("codes", "terms").alias("holds"))


def marginal_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: a histogram with its empty cells."""
    h = ans.marginal(base.encoded(spark, sf_dir).where("c4 <> 3"), 4, base.schema(spark, sf_dir).cardinalities[4])
    return h


def marginal_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: running counts of a histogram."""
    return ans.cumulative(ans.marginal(base.encoded(spark, sf_dir), 4, base.schema(spark, sf_dir).cardinalities[4]))


def interval_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: every interval as a difference of two running counts."""
    k = base.schema(spark, sf_dir).cardinalities[5]
    h = ans.marginal(base.encoded(spark, sf_dir), 5, k)
    every = spark.range(k).select(F.col("id").cast("int").alias("lo")).withColumn("hi", F.explode(F.sequence(F.col("lo"), F.lit(k - 1))))
    return ans.interval_counts(h, every)


def conditional_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts within each category."""
    e = base.encoded(spark, sf_dir)
    h = e.groupBy(F.col("c0").alias("category"), F.col("c4").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return ans.cumulative(h, ["category"])


# Terms in two orders, a query twice, one that is empty and one that is too long.
_CANDIDATES = [
    (0, "a", [(0, 0, 1, 0, 0), (1, 3, 0, 0, 2)]),
    (1, "b", [(1, 3, 0, 0, 2), (0, 0, 1, 0, 0)]),
    (2, "c", [(1, 1, 2, 0, 0)]),
    (3, "d", []),
    (4, "e", [(2, 0, 1, 0, 0)]),
    (5, "f", [(1, 1, 2, 0, 0)]),
    (6, "g", [(1, 3, 0, 2, 2)]),
    (7, "h", [(1, 0, 2, 0, 0)]),
    (8, "i", [(a, 0, 0, 0, 0) for a in range(5)]),
]


def _candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CANDIDATES, f"seq int, name string, terms {p.TERMS}")


def dedup_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal queries, whatever the order of terms."""
    return cat.dedup(_candidates(spark)).select("qid", "name", cat.num_terms().alias("num_terms"))


def select_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gathered and renumbered queries, and the groups that they leave."""
    queries, groups = _built(spark, sf_dir, "oneway", "prefix")
    keep = queries.where(F.pmod(F.length("name") + F.col("qid"), F.lit(3)) == 0).select(F.col("qid").alias("old_qid"), (-F.col("qid")).alias("place"))
    kept = cat.select_queries(queries, keep)
    left = cat.select_groups(groups, kept).select(F.col("name").alias("grp"), F.explode("qids").alias("qid"), base.r6(F.col("sensitivity"), "sensitivity"), "is_partition")
    return kept.select("qid", "name").join(left, "qid")


def holdout_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out queries that are not measured."""
    schema = base.schema(spark, sf_dir)
    measured, _ = _built(spark, sf_dir)
    held, _ = wl.build(spark, schema, wl.WorkloadConfig(range_intervals=RANGES, mixed_per_pair=MIXED, seed=SEED + 1, families=("range", "mixed")))
    return cat.exclude_measured(held, measured).select("family", "name")


def family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7."""
    queries, _ = _built(spark, sf_dir)
    return cat.family_counts(queries).select("family", "num_queries")


def workload_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8."""
    queries, _ = _built(spark, sf_dir)
    return metrics.workload_summary(queries, base.schema(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        answer_workload, answer_oneway, answer_twoway, answer_prefix, answer_range, answer_mixed, answer_wide, workload_catalogue, workload_groups, workload_cap,
        predicate_ge, conjunction_filter, satisfaction, source_test, marginal_histogram, marginal_cdf, interval_counts, conditional_cdf,
        dedup_queries, select_queries, holdout_antijoin, family_counts, workload_summary,
    )
}


def catalogue_sql(seed: int = SEED) -> dict[str, str]:
    """For each family a SELECT (family, name, grp, a1, op1, v1, lo1, hi1, a2, …) over ``attrs``."""
    one = "CAST({a} AS INTEGER) AS a1, {op} AS op1, CAST({v} AS INTEGER) AS v1, CAST({lo} AS INTEGER) AS lo1, CAST({hi} AS INTEGER) AS hi1"
    none = "CAST(NULL AS INTEGER) AS a2, CAST(NULL AS INTEGER) AS op2, CAST(NULL AS INTEGER) AS v2, CAST(NULL AS INTEGER) AS lo2, CAST(NULL AS INTEGER) AS hi2"
    second = "CAST({a} AS INTEGER) AS a2, {op} AS op2, CAST({v} AS INTEGER) AS v2, CAST({lo} AS INTEGER) AS lo2, CAST({hi} AS INTEGER) AS hi2"
    ids = ("a", "b", "j")
    lo = sql_integer("0", "kb - 1", f"{seed}/mixed/lo", *ids)
    return {
        "oneway": f"SELECT 'oneway' AS family, 'c' || attr || '=' || v AS name, 'oneway:' || attr AS grp, {one.format(a='attr', op=0, v='v', lo=0, hi=0)}, {none} FROM attrs, LATERAL (SELECT unnest(range(0, k)) AS v)",
        "twoway": f"SELECT 'twoway' AS family, 'c' || x.attr || '=' || va || '&c' || y.attr || '=' || vb AS name, 'twoway:' || x.attr || ':' || y.attr AS grp, {one.format(a='x.attr', op=0, v='va', lo=0, hi=0)}, {second.format(a='y.attr', op=0, v='vb', lo=0, hi=0)} FROM attrs x JOIN attrs y ON x.attr < y.attr, LATERAL (SELECT unnest(range(0, x.k)) AS va), LATERAL (SELECT unnest(range(0, y.k)) AS vb)",
        "prefix": f"SELECT 'prefix' AS family, 'c' || attr || '<=' || v AS name, 'prefix:' || attr AS grp, {one.format(a='attr', op=1, v='v', lo=0, hi=0)}, {none} FROM attrs, LATERAL (SELECT unnest(range(0, k)) AS v) WHERE kind <> 'categorical'",
        "range": f"""SELECT 'range' AS family, 'c' || attr || ' in [' || lo || ',' || hi || ']' AS name, 'range:' || attr AS grp, {one.format(a='attr', op=3, v=0, lo='lo', hi='hi')}, {none}
          FROM (SELECT attr, lo, hi, row_number() OVER (PARTITION BY attr ORDER BY md5('{seed}/range:' || attr || ':' || lo || ':' || hi)) AS r
                FROM attrs, LATERAL (SELECT unnest(range(0, k)) AS lo), LATERAL (SELECT unnest(range(lo, k)) AS hi) WHERE kind <> 'categorical') WHERE r <= {RANGES}""",
        "mixed": f"""SELECT DISTINCT 'mixed' AS family, 'c' || a || '=' || va || '&c' || b || CASE WHEN p THEN '<=' || lo ELSE ' in [' || lo || ',' || hi || ']' END AS name, 'mixed:' || a || ':' || b AS grp,
          {one.format(a='a', op=0, v='va', lo=0, hi=0)}, CAST(b AS INTEGER) AS a2, CASE WHEN p THEN 1 ELSE 3 END AS op2, CASE WHEN p THEN lo ELSE 0 END AS v2, CASE WHEN p THEN 0 ELSE lo END AS lo2, CASE WHEN p THEN 0 ELSE hi END AS hi2
          FROM (SELECT *, {sql_integer('lo', 'kb - 1', f'{seed}/mixed/hi', *ids)} AS hi FROM
            (SELECT a, b, j, kb, {sql_integer('0', 'ka - 1', f'{seed}/mixed/v', *ids)} AS va, {sql_uniform(f'{seed}/mixed/kind', *ids)} < 0.5 AS p, {lo} AS lo
             FROM (SELECT attr AS a, k AS ka FROM attrs WHERE kind = 'categorical'), (SELECT attr AS b, k AS kb FROM attrs WHERE kind <> 'categorical'), (SELECT unnest(range(0, {MIXED})) AS j)))""",
    }


def holds_sql(i: int, code: str) -> str:
    return f"CASE op{i} WHEN 0 THEN {code} = v{i} WHEN 1 THEN {code} <= v{i} WHEN 2 THEN {code} >= v{i} ELSE {code} BETWEEN lo{i} AND hi{i} END"


_PAIRS = " UNION ALL ".join(f"SELECT {i} AS xa, c{i} AS xc, {j} AS ya, c{j} AS yc, count(*) AS n FROM enc GROUP BY c{i}, c{j}" for i in range(6) for j in range(i + 1, 6))


def answer_sql(*families: str, seed: int = SEED) -> str:
    """(family, name, answer) of families by counting the rows that satisfy each query, in plain joins."""
    parts = catalogue_sql(seed)
    q = " UNION ALL ".join(f"({parts[f]})" for f in families)
    return f"""WITH {ENC}, {LONG}, q AS ({q}),
      h1 AS (SELECT attr, code, count(*) AS n FROM long GROUP BY 1, 2),
      h2 AS ({_PAIRS})
      SELECT family, name, CAST(coalesce(sum(n), 0) AS BIGINT) AS answer FROM q LEFT JOIN h1 ON attr = a1 AND ({holds_sql(1, 'code')}) WHERE a2 IS NULL GROUP BY 1, 2
      UNION ALL
      SELECT family, name, CAST(coalesce(sum(n), 0) AS BIGINT) FROM q LEFT JOIN h2 ON xa = a1 AND ya = a2 AND ({holds_sql(1, 'xc')}) AND ({holds_sql(2, 'yc')}) WHERE a2 IS NOT NULL GROUP BY 1, 2"""


_ALL = " UNION ALL ".join(f"({x})" for x in catalogue_sql().values())
_TERM = "a{0} AS attr, op{0} AS op, v{0} AS value, lo{0} AS lo, hi{0} AS hi"
ORACLES = {
    "answer_workload": answer_sql("oneway", "twoway", "prefix", "range", "mixed"),
    **{f"answer_{f}": answer_sql(f) for f in ("oneway", "twoway", "prefix", "range", "mixed")},
    "workload_catalogue": f"WITH {ENC}, q AS ({_ALL}) SELECT family, name, grp, 0 AS place, {_TERM.format(1)} FROM q UNION ALL SELECT family, name, grp, 1, {_TERM.format(2)} FROM q WHERE a2 IS NOT NULL",
    "workload_groups": f"WITH {ENC}, q AS ({_ALL}) SELECT grp AS name, family, CAST(count(*) AS INTEGER) AS size, round(CASE WHEN family IN ('oneway', 'twoway') THEN 1.0 ELSE sqrt(count(*)) END, 6) + 0.0 AS sensitivity, family IN ('oneway', 'twoway') AS is_partition FROM q GROUP BY 1, 2",
    "workload_cap": f"""WITH {ENC}, q AS (({catalogue_sql()['oneway']}) UNION ALL ({catalogue_sql()['prefix']}))
      SELECT CAST(qid AS INTEGER) AS qid, name FROM (SELECT row_number() OVER (ORDER BY CASE family WHEN 'oneway' THEN 1 ELSE 3 END, a1, v1) - 1 AS qid, name FROM q) WHERE qid < 25""",
    "answer_wide": f"""WITH {ENC} SELECT 'three' AS name, count(*) AS answer FROM enc WHERE c0 = 1 AND c4 <= 5 AND c5 BETWEEN 2 AND 9
      UNION ALL SELECT 'four', count(*) FROM enc WHERE c0 = 0 AND c1 = 1 AND c2 >= 4 AND c3 <= 6 UNION ALL SELECT 'never', 0 UNION ALL SELECT 'one', count(*) FROM enc WHERE c5 >= 6""",
    "predicate_ge": f"WITH {ENC} SELECT row_id, c4 FROM enc WHERE c4 >= 8",
    "conjunction_filter": f"WITH {ENC} SELECT row_id, c0, c2, c5 FROM enc WHERE c0 = 1 AND c2 <= 4 AND c5 BETWEEN 3 AND 7",
    "satisfaction": f"WITH {ENC} SELECT row_id, 0 AS qid FROM enc WHERE c0 = 1 AND c4 <= 3 UNION ALL SELECT row_id, 1 FROM enc WHERE c5 >= 10 UNION ALL SELECT row_id, 2 FROM enc WHERE c3 BETWEEN 2 AND 3 AND c1 = 0",
    "source_test": f"WITH {ENC} SELECT row_id, CAST(row_id % 3 AS INTEGER) AS qid, c0 = row_id % 3 AND c4 <= 5 AS holds FROM enc",
    "marginal_histogram": f"WITH {ENC} SELECT CAST(v AS INTEGER) AS v, count(row_id) AS n FROM (SELECT unnest(range(0, k)) AS v FROM attrs WHERE attr = 4) LEFT JOIN enc ON c4 = v AND c4 <> 3 GROUP BY 1",
    "marginal_cdf": f"WITH {ENC} SELECT CAST(v AS INTEGER) AS v, n, CAST(sum(n) OVER (ORDER BY v) AS BIGINT) AS upto FROM (SELECT c4 AS v, count(*) AS n FROM enc GROUP BY 1)",
    "interval_counts": f"WITH {ENC}, b AS (SELECT unnest(range(0, k)) AS v FROM attrs WHERE attr = 5), h AS (SELECT c5, count(*) AS n FROM enc GROUP BY 1) SELECT CAST(x.v AS INTEGER) AS lo, CAST(y.v AS INTEGER) AS hi, CAST(coalesce(sum(n), 0) AS BIGINT) AS answer FROM b x JOIN b y ON x.v <= y.v LEFT JOIN h ON c5 BETWEEN x.v AND y.v GROUP BY 1, 2",
    "conditional_cdf": f"WITH {ENC} SELECT category, v, n, CAST(sum(n) OVER (PARTITION BY category ORDER BY v) AS BIGINT) AS upto FROM (SELECT c0 AS category, c4 AS v, count(*) AS n FROM enc GROUP BY 1, 2)",
    "dedup_queries": "SELECT * FROM (VALUES (0, 'a', 2), (1, 'c', 1), (2, 'e', 1), (3, 'g', 1), (4, 'h', 1)) AS t(qid, name, num_terms)",
    "select_queries": f"""WITH {ENC}, q AS (SELECT *, row_number() OVER (ORDER BY CASE family WHEN 'oneway' THEN 1 ELSE 3 END, a1, v1) - 1 AS old FROM (({catalogue_sql()['oneway']}) UNION ALL ({catalogue_sql()['prefix']}))),
      g AS (SELECT grp, count(*) AS n FROM q GROUP BY 1)
      SELECT CAST(row_number() OVER (ORDER BY old DESC) - 1 AS INTEGER) AS qid, name, q.grp, round(CASE WHEN family = 'oneway' THEN 1.0 ELSE sqrt(n) END, 6) + 0.0 AS sensitivity, family = 'oneway' AS is_partition
      FROM q JOIN g ON q.grp = g.grp WHERE (length(name) + old) % 3 = 0""",
    "holdout_antijoin": f"""WITH {ENC}, q AS ({_ALL}), h AS (({catalogue_sql(SEED + 1)['range']}) UNION ALL ({catalogue_sql(SEED + 1)['mixed']}))
      SELECT family, name FROM h WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.name = h.name)""",
    "family_counts": f"WITH {ENC}, q AS ({_ALL}) SELECT family, count(*) AS num_queries FROM q GROUP BY 1",
    "workload_summary": f"""WITH {ENC}, q AS ({_ALL}), pairs AS (SELECT count(*) AS n, sum(x.k * y.k) AS cells FROM attrs x JOIN attrs y ON x.attr < y.attr)
      SELECT count(*) AS num_queries, count(*) FILTER (family = 'oneway') AS num_oneway, count(*) FILTER (family = 'twoway') AS num_twoway, count(*) FILTER (family = 'prefix') AS num_prefix,
        count(*) FILTER (family = 'range') AS num_range, count(*) FILTER (family = 'mixed') AS num_mixed, count(*) >= 10000 AS max_queries_hit, (SELECT n FROM pairs) AS possible_2way_pairs,
        count(DISTINCT CASE WHEN family = 'twoway' THEN grp END) AS constructed_2way_pairs, (SELECT CAST(cells AS BIGINT) FROM pairs) AS possible_2way_cells, count(*) FILTER (family = 'twoway') AS constructed_2way_cells FROM q""",
}
