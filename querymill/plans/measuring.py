"""Queries of privacy accounting, measurement and projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.functions.lineage import written
from querymill.operators import answer as ans
from querymill.operators import measure as ms
from querymill.operators import privacy
from querymill.operators import projection
from querymill.operators import workload as wl
from querymill.plans import base
from querymill.plans.base import ENC, r6, sql_gaussian, sql_gumbel, sql_r6
from querymill.plans.workloads import SEED, answer_sql, catalogue_sql

RHO, DELTA, SALT = 0.8, 1e-9, "9/noise"
WEIGHTS = {"oneway": 3.0, "prefix": 1.0, "range": 0.0, "absent": 2.0}
FAMILIES = ("oneway", "prefix")


def zcdp_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D2."""
    rows = spark.createDataFrame([(r, d) for r in (0.0, 0.1, 1.0, 10.0) for d in (1e-9, 1e-5, 0.5)], "rho double, delta double")
    sigma = F.when(F.col("rho") > 0, 1 / F.sqrt(2 * F.col("rho")))
    return rows.select("rho", "delta", r6(privacy.zcdp_epsilon_column(F.col("rho"), F.col("delta")), "epsilon"), r6(sigma, "sigma"))


def budget_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of groups, with a family that has no weight and one that is absent."""
    schema = base.schema(spark, sf_dir)
    _, groups = wl.build(spark, schema, wl.WorkloadConfig(range_intervals=20, seed=SEED, families=("oneway", "prefix", "range")))
    return privacy.allocate_budget(groups, RHO, WEIGHTS).select("name", "family", F.round(F.col("rho") * 1e6, 4).alias("rho_millionths"))


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    schema, encoded = base.schema(spark, sf_dir), base.encoded(spark, sf_dir)
    queries, groups = wl.build(spark, schema, wl.WorkloadConfig(seed=SEED, families=FAMILIES))
    queries, groups = written(queries), written(groups)
    total = base.lineitem(spark, sf_dir).count()
    return queries, groups, ans.answer(encoded, queries, schema.cardinalities), total


def gaussian_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy and projected targets under a seeded noise."""
    queries, groups, answers, total = _answers(spark, sf_dir)
    m = ms.measure_answers(answers, groups, float(total), ms.MeasureConfig(rho_total=RHO, salt=SALT))
    return m.join(queries, "qid").select("name", *[r6(F.col(c), c) for c in ("target_noisy", "target_projected", "variance", "inv_variance")])


def oracle_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6 without noise."""
    queries, groups, answers, total = _answers(spark, sf_dir)
    m = ms.measure_answers(answers, groups, float(total), ms.MeasureConfig(mode="oracle", oracle_variance=2.0))
    return m.join(queries, "qid").select("name", *[r6(F.col(c), c) for c in ("target_noisy", "target_projected", "variance", "inv_variance")])


def public_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view that may leave has no true answers."""
    queries, groups, answers, total = _answers(spark, sf_dir)
    m = ms.public_view(ms.measure_answers(answers, groups, float(total), ms.MeasureConfig(mode="oracle")))
    return m.select("qid", *[r6(F.col(c), c) for c in ("target_noisy", "target_projected", "variance")])


def exponential_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One supplier of each nation, by Gumbel noise on account balances."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000).alias("score"))
    out = privacy.exponential_mechanism(s, 2.0, 1.0, "3/pick", ["nation"])
    return out.select("nation", "id", r6(F.col("score"), "score"))


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_nationkey").alias("gid"), F.col("c_custkey").alias("qid"), (F.col("c_acctbal") / 100).alias("noisy"))


def simplex_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1."""
    return projection.project_simplex(_balances(spark, sf_dir), 500.0).select("gid", "qid", r6(F.col("projected"), "projected"))


def clip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2."""
    return _balances(spark, sf_dir).select("qid", r6(projection.clip_counts(F.col("noisy"), 60.0), "clipped"))


def project_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions to the simplex, the others clipped."""
    b = _balances(spark, sf_dir).withColumn("is_partition", F.col("gid") % 2 == 0)
    return projection.project_targets(b, 300.0).select("gid", "qid", r6(F.col("projected"), "projected"))


QUERIES = {f.__name__: f for f in (zcdp_epsilon, budget_allocation, gaussian_measure, oracle_measure, public_measurements, exponential_select, simplex_project, clip_counts, project_targets)}


def simplex_sql(source: str, total: str) -> str:
    """CTEs that end in ``simplex`` (gid, qid, projected) for ``source`` (gid, qid, noisy)."""
    return f"""sr AS (SELECT gid, qid, noisy, row_number() OVER (PARTITION BY gid ORDER BY noisy DESC, qid) AS k, sum(noisy) OVER (PARTITION BY gid ORDER BY noisy DESC, qid ROWS UNBOUNDED PRECEDING) - {total} AS over FROM {source}),
      sk AS (SELECT gid, coalesce(max(CASE WHEN noisy - over / k > 0 THEN k END), max(k)) AS kk FROM sr GROUP BY gid),
      st AS (SELECT sr.gid, over / k AS theta FROM sr JOIN sk ON sr.gid = sk.gid AND k = kk),
      simplex AS (SELECT sr.gid, qid, greatest(noisy - theta, 0.0) AS projected FROM sr JOIN st ON sr.gid = st.gid)"""


def _measured(noise: bool) -> str:
    """CTEs that end in ``m`` (qid, name, answer, gid, is_partition, noisy, variance)."""
    inner = answer_sql(*FAMILIES)
    rho = f"CASE WHEN n_fam > 0 THEN {RHO} * 0.5 / n_fam END"
    noisy = f"answer + std * {sql_gaussian(SALT, 'qid')}" if noise else "CAST(answer AS DOUBLE)"
    variance = "greatest(std * std, 1e-6)" if noise else "2.0::DOUBLE"
    return f"""WITH {ENC}, cat AS (SELECT *, row_number() OVER (ORDER BY CASE family WHEN 'oneway' THEN 1 ELSE 3 END, a1, v1) - 1 AS qid FROM (({catalogue_sql()['oneway']}) UNION ALL ({catalogue_sql()['prefix']}))),
      found AS ({inner}), fam AS (SELECT family, count(DISTINCT grp) AS n_fam FROM cat GROUP BY 1), size AS (SELECT grp, count(*) AS n FROM cat GROUP BY 1),
      base AS (SELECT qid, cat.name, cat.family, cat.grp AS gid, cat.family = 'oneway' AS is_partition, answer, CASE WHEN cat.family = 'oneway' THEN 1.0::DOUBLE ELSE sqrt(n) END / sqrt(2 * ({rho})) AS std
               FROM cat JOIN found ON cat.name = found.name AND cat.family = found.family JOIN fam ON cat.family = fam.family JOIN size ON size.grp = cat.grp),
      m AS (SELECT *, {noisy} AS noisy, {variance} AS variance FROM base), part AS (SELECT * FROM m WHERE is_partition), total AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM lineitem),
      {simplex_sql('part', '(SELECT t FROM total)')},
      target AS (SELECT m.*, CASE WHEN m.is_partition THEN projected ELSE greatest(0.0, least(noisy, (SELECT t FROM total))) END AS target FROM m LEFT JOIN simplex ON m.qid = simplex.qid)"""


_BALANCES = "bal AS (SELECT c_nationkey AS gid, c_custkey AS qid, c_acctbal / 100 AS noisy FROM customer)"
ORACLES = {
    "zcdp_epsilon": f"SELECT rho, delta, {sql_r6('CASE WHEN rho <= 0 THEN 0.0 ELSE rho + 2 * sqrt(rho * ln(1 / delta)) END', 'epsilon')}, {sql_r6('CASE WHEN rho > 0 THEN 1 / sqrt(2 * rho) END', 'sigma')} FROM (SELECT unnest([0.0::DOUBLE, 0.1, 1, 10]) AS rho), (SELECT unnest([1e-9::DOUBLE, 1e-5, 0.5]) AS delta)",
    "budget_allocation": f"""WITH {ENC}, q AS (({catalogue_sql()['oneway']}) UNION ALL ({catalogue_sql()['prefix']}) UNION ALL ({catalogue_sql()['range']})), g AS (SELECT DISTINCT grp AS name, family FROM q)
      SELECT name, family, round(1e6 * CASE family WHEN 'oneway' THEN {RHO} * 3 / 6 WHEN 'prefix' THEN {RHO} * 1 / 6 ELSE {RHO} * 1e-6 / count(*) OVER (PARTITION BY family) END / count(*) OVER (PARTITION BY family), 4) AS rho_millionths FROM g""",
    "gaussian_measure": f"{_measured(True)} SELECT name, {sql_r6('noisy', 'target_noisy')}, {sql_r6('target', 'target_projected')}, {sql_r6('variance', 'variance')}, {sql_r6('1 / variance', 'inv_variance')} FROM target",
    "oracle_measure": f"{_measured(False)} SELECT name, {sql_r6('noisy', 'target_noisy')}, {sql_r6('target', 'target_projected')}, {sql_r6('variance', 'variance')}, {sql_r6('1 / variance', 'inv_variance')} FROM target",
    "public_measurements": f"{_measured(False)} SELECT CAST(qid AS INTEGER) AS qid, {sql_r6('noisy', 'target_noisy')}, {sql_r6('target', 'target_projected')}, 1.0::DOUBLE AS variance FROM target",
    "exponential_select": f"SELECT nation, id, {sql_r6('score', 'score')} FROM (SELECT s_nationkey AS nation, s_suppkey AS id, s_acctbal / 1000 AS score FROM supplier) QUALIFY row_number() OVER (PARTITION BY nation ORDER BY 2.0 * score / 2.0 + {sql_gumbel('3/pick', 'nation', 'id')} DESC, id) = 1",
    "simplex_project": f"WITH {_BALANCES}, {simplex_sql('bal', '500.0')} SELECT gid, qid, {sql_r6('projected', 'projected')} FROM simplex",
    "clip_counts": f"WITH {_BALANCES} SELECT qid, {sql_r6('greatest(0.0, least(noisy, 60.0))', 'clipped')} FROM bal",
    "project_targets": f"WITH {_BALANCES}, even AS (SELECT * FROM bal WHERE gid % 2 = 0), {simplex_sql('even', '300.0')} SELECT gid, qid, {sql_r6('projected', 'projected')} FROM simplex UNION ALL SELECT gid, qid, {sql_r6('greatest(0.0, least(noisy, 300.0))', 'projected')} FROM bal WHERE gid % 2 = 1",
}
