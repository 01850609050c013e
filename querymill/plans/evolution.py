"""Queries of the evolution of a synthetic table: from the first draw to maintained answers.

They work on the orders (their key is unique): two categorical attributes and
one that is cut at quantiles.  The synthetic table has as many rows as the
real one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.functions.lineage import new_folder, written
from querymill.operators import answer as ans
from querymill.operators import encode as enc
from querymill.operators import evolve as ev
from querymill.operators import metrics
from querymill.operators import workload as wl
from querymill.operators.schema import TableSchema
from querymill.plans import base
from querymill.plans.base import r6, sql_bin, sql_edges, sql_integer, sql_r6, sql_uniform

SEED = 5
COLUMNS, BINS = ("o_orderstatus", "o_orderpriority", "o_totalprice"), 8
FAMILIES = ("oneway", "twoway", "prefix")
VARIANCE, SIGMA, LAMBDA, GAMMA = 4.0, 2.0, 0.01, 0.1
ACTIVE, PER_QUERY, ACCEPT = 10, 20, 24
TOTAL, RANDOM_SHARE, RETURNED = 120, 0.1, 40

_BUILT: dict[tuple, dict] = {}


def _world(spark: SparkSession, sf_dir: str) -> dict:
    """Schema, tables, catalogue, state and candidates; made once for each state of the table's files."""
    key = base.listing(spark, f"{sf_dir}/orders.parquet")
    if key in _BUILT:
        return _BUILT[key]
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet")
    schema = enc.fit_schema(raw, COLUMNS, BINS, COLUMNS[2:], COLUMNS[:2])
    cards, d = schema.cardinalities, schema.d
    real = written(enc.encode(raw, schema, "o_orderkey"))
    queries, _ = wl.build(spark, schema, wl.WorkloadConfig(seed=SEED, families=FAMILIES))
    queries = written(queries)
    true = written(ans.answer(real, queries, cards))
    syn = written(_draw(spark, real, true, queries, schema))
    state = written(_state(ans.answer(_columns(syn, d), queries, cards), true))
    active = written(ev.active_queries(state, ACTIVE).join(queries, "qid"))
    cands = written(_repaired(syn, active, schema))
    world = {"schema": schema, "real": real, "queries": queries, "true": true, "syn": syn, "state": state, "active": active, "cands": cands}
    _BUILT.clear()
    _BUILT[key] = world
    return world


def _columns(codes: DataFrame, d: int) -> DataFrame:
    return codes.select("row_id", *[F.col("codes")[i].alias(f"c{i}") for i in range(d)])


def _draw(spark: SparkSession, real: DataFrame, true: DataFrame, queries: DataFrame, schema: TableSchema) -> DataFrame:
    t = F.col("terms")[0]
    marginals = queries.where("family = 'oneway'").join(true, "qid").select(t["attr"].alias("attr"), t["value"].alias("v"), F.col("answer").cast("double").alias("target"))
    return ev.independent_codes(spark, ev.resolve_rows("same_as_real", real.count()), marginals, schema, f"{SEED}/init")


def _state(answers: DataFrame, true: DataFrame) -> DataFrame:
    s = answers.join(true.select("qid", F.col("answer").alias("target")), "qid")
    consts = {"variance": F.lit(VARIANCE), "inv_variance": F.lit(1 / VARIANCE), "sigma": F.lit(SIGMA), "debt": F.lit(0.0)}
    return s.select("qid", "target", "answer", (F.col("target") - F.col("answer")).alias("residual"), *[v.alias(k) for k, v in consts.items()])


def _repaired(syn: DataFrame, active: DataFrame, schema: TableSchema) -> DataFrame:
    s = ev.sample_sources(syn, active, PER_QUERY, f"{SEED}/rows")
    s = written(ev.with_enter(s, schema.cardinalities, f"{SEED}/enter", "qid", "row_id"))
    s = written(ev.with_exit(s, schema.cardinalities, f"{SEED}/exit", "qid", "row_id"))
    new = F.when(F.col("repair_type") == ev.ENTER, F.col("entered")).otherwise(F.col("left"))
    c = s.select((F.col("qid") * 1000 + F.col("place")).cast("long").alias("cand_id"), "row_id", F.col("codes").alias("old"), new.alias("new"), F.col("qid").alias("target_qid"), "repair_type").where("old <> new")
    return c.withColumn("edit_cost", ev.edit_cost("old", "new", schema, GAMMA)).select("cand_id", "row_id", "old", "new", "target_qid", "edit_cost", "repair_type")


def _spread(df: DataFrame, *arrays: str) -> DataFrame:
    """Arrays of codes as columns."""
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, *[F.col(a)[i].alias(f"{a}{i}") for a in arrays for i in range(3)])


def _scored(w: dict) -> tuple[DataFrame, DataFrame]:
    delta = ev.deltas(w["cands"], w["queries"])
    return ev.score_dense(w["cands"], delta, w["state"], LAMBDA), delta


def _selected(w: dict) -> tuple[DataFrame, DataFrame]:
    scored, delta = _scored(w)
    return ev.select_nonconflicting(scored, ACCEPT), delta


def init_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1, N2."""
    return _spread(_world(spark, sf_dir)["syn"], "codes")


def query_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of the queries over the first table."""
    return _world(spark, sf_dir)["state"].select("qid", "target", "answer", "residual")


def active_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1."""
    a = ev.active_queries(_world(spark, sf_dir)["state"], ACTIVE)
    return a.select("qid", r6(F.col("priority"), "priority"))


def active_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 where no residual exceeds the noise."""
    a = ev.active_queries(_world(spark, sf_dir)["state"], ACTIVE, kappa=1e9)
    return a.select("qid", r6(F.col("priority"), "priority"))


def sample_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2."""
    w = _world(spark, sf_dir)
    return ev.sample_sources(w["syn"], w["active"], PER_QUERY, f"{SEED}/rows").select("qid", "repair_type", "place", "row_id")


def enter_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, K5."""
    w = _world(spark, sf_dir)
    s = ev.sample_sources(w["syn"], w["active"], PER_QUERY, f"{SEED}/rows").where(F.col("repair_type") == ev.ENTER)
    s = ev.with_enter(s, w["schema"].cardinalities, f"{SEED}/enter", "qid", "row_id")
    return _spread(s.select("qid", "row_id", F.col("entered").alias("new")), "new")


def exit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K5."""
    w = _world(spark, sf_dir)
    s = ev.sample_sources(w["syn"], w["active"], PER_QUERY, f"{SEED}/rows").where(F.col("repair_type") == ev.EXIT)
    s = ev.with_exit(s, w["schema"].cardinalities, f"{SEED}/exit", "qid", "row_id")
    return _spread(s.select("qid", "row_id", F.col("left").alias("new")), "new")


def random_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6."""
    w = _world(spark, sf_dir)
    m = ev.with_mutation(w["syn"], w["schema"].cardinalities, f"{SEED}/mutate", "row_id")
    return _spread(m.select("row_id", F.col("mutated").alias("new")), "new")


def edit_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7."""
    return _spread(_world(spark, sf_dir)["cands"].select("cand_id", "row_id", r6(F.col("edit_cost"), "edit_cost"), "old", "new"), "old", "new")


def candidate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed candidates by priority up to their share, then random ones, numbered in one plan."""
    w = _world(spark, sf_dir)
    c = ev.candidates(w["syn"], w["active"], w["schema"], TOTAL, str(SEED), RANDOM_SHARE, PER_QUERY, GAMMA)
    return _spread(c.select("cand_id", "row_id", "old", "new", "target_qid", "repair_type", r6(F.col("edit_cost"), "edit_cost")), "old", "new")


def candidate_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2, attribute-pruned."""
    w = _world(spark, sf_dir)
    return ev.deltas(w["cands"], w["queries"]).select("cand_id", "qid", F.col("delta").cast("int").alias("delta"))


def score_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, T3."""
    return _scored(_world(spark, sf_dir))[0].select("cand_id", r6(F.col("advantage"), "advantage"))


def score_target_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4."""
    w = _world(spark, sf_dir)
    return ev.score_target_only(w["cands"], w["queries"], w["state"], LAMBDA).select("cand_id", r6(F.col("advantage"), "advantage"))


def returned_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the scored candidates; each partition keeps its own best before they merge."""
    return ev.top_scored(_scored(_world(spark, sf_dir))[0], RETURNED).select("cand_id", "row_id", r6(F.col("advantage"), "advantage"))


def select_nonconflicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5."""
    return _selected(_world(spark, sf_dir))[0].select("rank", "cand_id", "row_id", r6(F.col("advantage"), "advantage"))


def batch_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6."""
    w = _world(spark, sf_dir)
    s, delta = _selected(w)
    return ev.batch_advantage(s, delta, w["state"], LAMBDA).select(r6(F.col("advantage"), "advantage"))


def transport_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The advantage of every prefix of the selection."""
    w = _world(spark, sf_dir)
    s, delta = _selected(w)
    return ev.prefix_advantages(s, delta, w["state"], LAMBDA).select("rank", "cand_id", r6(F.col("prefix_advantage"), "prefix_advantage"))


def transport_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each strategy accepts."""
    w = _world(spark, sf_dir)
    s, delta = _selected(w)
    parts = [ev.choose_prefix(s, delta, w["state"], LAMBDA, x).select(F.lit(x).alias("strategy"), "rank", "cand_id", r6(F.col("batch_advantage"), "batch_advantage")) for x in ("largest_positive", "best_advantage")]
    return parts[0].union(parts[1])


def _accepted(w: dict) -> tuple[DataFrame, DataFrame]:
    s, delta = _selected(w)
    return ev.choose_prefix(s, delta, w["state"], LAMBDA), delta


def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9."""
    w = _world(spark, sf_dir)
    return _spread(ev.apply_edits(w["syn"], _accepted(w)[0]), "codes")


def incremental_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10."""
    w = _world(spark, sf_dir)
    return ev.apply_deltas(w["state"], *_accepted(w)).select("qid", "answer", "residual")


def full_recompute_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maintained answers against counted ones."""
    w = _world(spark, sf_dir)
    accepted, delta = _accepted(w)
    after = ev.apply_deltas(w["state"], accepted, delta)
    counted = ans.answer(_columns(ev.apply_edits(w["syn"], accepted), 3), w["queries"], w["schema"].cardinalities)
    return ev.drift(after, counted)


def measured_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2: the loss before and after a batch."""
    w = _world(spark, sf_dir)
    before, after = metrics.measured_loss(w["state"]), metrics.measured_loss(ev.apply_deltas(w["state"], *_accepted(w)))
    m = w["queries"].agg(F.count(F.lit(1)).alias("m"))
    both = before.select(F.lit("before").alias("moment"), "loss").union(after.select(F.lit("after").alias("moment"), "loss")).join(F.broadcast(m))
    return both.select("moment", r6(F.col("loss"), "loss"), r6(metrics.rms_column(F.col("loss"), F.col("m")), "rms"))


def _with_truth(w: dict) -> DataFrame:
    after = ev.apply_deltas(w["state"], *_accepted(w))
    first = w["state"].select("qid", F.col("answer").alias("initial_answer"), F.col("residual").alias("initial_residual"))
    return after.join(first, "qid").join(w["true"].select("qid", F.col("answer").alias("true_answer")), "qid").join(w["queries"].select("qid", "family"), "qid")


def query_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3-M5, A9."""
    w = _world(spark, sf_dir)
    n = w["real"].count()
    out = metrics.before_and_after(_with_truth(w), n, n)
    return out.select(*[r6(F.col(c) * 1000, c) for c in out.columns])


def query_error_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: an empty workload has no error."""
    w = _world(spark, sf_dir)
    return metrics.query_errors(_with_truth(w).where("family = 'none'"), 1, 1)


def metrics_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6, M7."""
    w = _world(spark, sf_dir)
    n = w["real"].count()
    out = metrics.by_family(_with_truth(w), n, n)
    return out.select("family", "num_queries", *[r6(F.col(c) * (1000 if c in ("mae", "rmse", "max_error") else 1), c) for c in out.columns if c not in ("family", "num_queries")])


def evolve_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three iterations; losses never rise and maintained answers equal counted ones."""
    from querymill.plans import engine, report

    w = _world(spark, sf_dir)
    config = engine.EvolveConfig(max_iters=3, accepted_per_iter=ACCEPT, num_active=ACTIVE, total_candidates=200, per_target=PER_QUERY, seed=SEED, full_recompute_every=1)
    result = engine.evolve(w["syn"], w["queries"], w["state"], w["schema"], config)
    series = spark.createDataFrame([tuple(r[c] for c in report.COLUMNS) for r in result.series], report.SERIES)
    return series.drop("wall_time")


RUN_VALUES = (
    "num_rows_real", "num_rows_synthetic", "num_columns", "num_queries", "num_measurement_groups", "initial_measured_loss", "initial_rms_standardized_residual",
    "initial_true_query_mae", "initial_true_query_max_error", "final_incremental_answer_drift", "num_iterations",
)
RUN_ITERS = 2


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run without noise; what its files say of the first table, and what must hold at the end."""
    from querymill.plans import engine, report
    from querymill.sources import config as cfg

    table = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", *COLUMNS)
    out = new_folder(spark, "run").removeprefix("file:")
    config = {
        "run": {"output_dir": out, "seed": SEED},
        "preprocess": {"id_column": "o_orderkey", "numerical_bins": BINS, "numerical_columns": COLUMNS[2:], "categorical_columns": COLUMNS[:2]},
        "workload": {"families": FAMILIES},
        "privacy": {"mode": "oracle", "oracle_variance": VARIANCE},
        "evolve": {"max_iters": RUN_ITERS, "accepted_per_iter": ACCEPT, "num_active": ACTIVE, "total_candidates": TOTAL, "per_target": PER_QUERY, "full_recompute_every": 1, "patience": RUN_ITERS + 1},
        "evaluation": {"heldout": True, "save_synthetic_csv": False},
    }
    engine.run(spark, config, table)
    final, runtime, work, held, families = (cfg.read_json(f"{out}/{f}.json") for f in ("metrics_final", "runtime", "workload_summary", "metrics_holdout", "metrics_by_family"))
    series = spark.read.csv(f"{out}/metrics_timeseries.csv", header=True, schema=report.SERIES).orderBy("iteration").collect()
    rows = [(k, float(final[k])) for k in RUN_VALUES]
    rows += [(f"initial_measured_loss of {f}", v["initial_measured_loss"]) for f, v in families.items()]
    rows += [(f"{k} of {f}", float(n)) for k in ("num_queries_by_family", "num_groups_by_family") for f, n in work[k].items()]
    rows += [(k, float(work[k])) for k in ("num_2way_pairs_possible", "num_2way_cells_possible", "num_2way_queries_constructed")]
    holds_ = {
        "losses never rise": all(b <= a + 1e-6 for a, b in zip([final["initial_measured_loss"], *[r["measured_loss"] for r in series]], [r["measured_loss"] for r in series])),
        "last loss is reported": abs(series[-1]["measured_loss"] - final["final_measured_loss"]) < 1e-6,
        "edits add up": sum(r["accepted_edits"] for r in series) == final["num_accepted_edits"] == runtime["candidate_funnel"]["accepted"],
        "candidates add up": sum(r["directed_candidates"] + r["random_candidates"] for r in series) == final["num_candidates_scored"],
        "held-out queries are other ones": held["num_queries"] == final["heldout_num_queries"],
    }
    rows += [(k, float(v)) for k, v in holds_.items()]
    return spark.createDataFrame(rows, "name string, x double").select("name", r6(F.col("x"), "value"))


QUERIES = {
    f.__name__: f
    for f in (
        init_independent, query_state, active_topk, active_fallback, sample_sources, enter_repair, exit_repair, random_mutation, edit_cost, candidate_batch, candidate_deltas,
        score_dense, score_target_only, returned_topk, select_nonconflicting, batch_advantage, transport_prefix, transport_choice, apply_edits, incremental_answers, full_recompute_drift,
        measured_loss, query_error, query_error_empty, metrics_by_family, evolve_loop, run_report,
    )
}

# --- DuckDB -------------------------------------------------------------------


def _case(i: int, c: str) -> str:
    return f"CASE op{i} WHEN 0 THEN {c} = v{i} WHEN 1 THEN {c} <= v{i} WHEN 2 THEN {c} >= v{i} ELSE {c} BETWEEN lo{i} AND hi{i} END"


def _code(i: int, prefix: str) -> str:
    return f"CASE a{i} WHEN 0 THEN {prefix}0 WHEN 1 THEN {prefix}1 ELSE {prefix}2 END"


def sql_holds(prefix: str) -> str:
    """Whether the codes ``prefix``0 .. 2 satisfy the query of a row of q."""
    return f"(({_case(1, '(' + _code(1, prefix) + ')')}) AND (a2 IS NULL OR ({_case(2, '(' + _code(2, prefix) + ')')})))"


def _query_tail(a1: str, op: int, v1: str, a2: str = "NULL", v2: str = "NULL") -> str:
    return f"CAST({a1} AS INTEGER) AS a1, {op} AS op1, CAST({v1} AS INTEGER) AS v1, 0 AS lo1, 0 AS hi1, CAST({a2} AS INTEGER) AS a2, CASE WHEN {a2} IS NULL THEN NULL ELSE 0 END AS op2, CAST({v2} AS INTEGER) AS v2, 0 AS lo2, 0 AS hi2"


_WORLD = f"""
 d0 AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT {COLUMNS[0]} AS v FROM orders)),
 d1 AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT {COLUMNS[1]} AS v FROM orders)),
 edges AS (SELECT {sql_edges(COLUMNS[2], BINS, 'orders')} AS e),
 enc AS MATERIALIZED (SELECT o_orderkey AS row_id, d0.code AS c0, d1.code AS c1, {sql_bin(COLUMNS[2], 'e')} AS c2 FROM orders, edges, d0, d1 WHERE {COLUMNS[0]} = d0.v AND {COLUMNS[1]} = d1.v),
 attrs AS (SELECT 0 AS attr, (SELECT CAST(count(*) AS INTEGER) FROM d0) AS k UNION ALL SELECT 1, (SELECT CAST(count(*) AS INTEGER) FROM d1) UNION ALL SELECT 2, (SELECT CAST(len(e) - 1 AS INTEGER) FROM edges)),
 ks AS (SELECT max(CASE WHEN attr = 0 THEN k END) AS k0, max(CASE WHEN attr = 1 THEN k END) AS k1, max(CASE WHEN attr = 2 THEN k END) AS k2 FROM attrs),
 q0 AS (
   SELECT 'oneway' AS family, 1 AS f, '' AS o, attr AS s1, v AS s2, 0 AS s3, {_query_tail('attr', 0, 'v')} FROM attrs, LATERAL (SELECT unnest(range(0, k)) AS v)
   UNION ALL SELECT 'twoway', 2, md5('{SEED}/pairs:' || x.attr || ':' || y.attr), 0, va, vb, {_query_tail('x.attr', 0, 'va', 'y.attr', 'vb')} FROM attrs x JOIN attrs y ON x.attr < y.attr, LATERAL (SELECT unnest(range(0, x.k)) AS va), LATERAL (SELECT unnest(range(0, y.k)) AS vb)
   UNION ALL SELECT 'prefix', 3, '', attr, v, 0, {_query_tail('attr', 1, 'v')} FROM attrs, LATERAL (SELECT unnest(range(0, k)) AS v) WHERE attr = 2),
 q AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY f, o, s1, s2, s3) - 1 AS INTEGER) AS qid, * FROM q0),
 truth AS MATERIALIZED (SELECT qid, count(row_id) AS target FROM q LEFT JOIN enc ON {sql_holds('c')} GROUP BY 1),
 marg AS (SELECT a1 AS attr, v1 AS v, CAST(target AS DOUBLE) AS t FROM q JOIN truth USING (qid) WHERE family = 'oneway'),
 cdf AS (SELECT attr, v, sum(t) OVER (PARTITION BY attr ORDER BY v) / sum(t) OVER (PARTITION BY attr) AS p FROM marg),
 ids AS (SELECT unnest(range(0, (SELECT count(*) FROM orders))) AS row_id),
 lists AS (SELECT max(CASE WHEN attr = 0 THEN l END) AS l0, max(CASE WHEN attr = 1 THEN l END) AS l1, max(CASE WHEN attr = 2 THEN l END) AS l2 FROM (SELECT attr, list(p ORDER BY v) AS l FROM cdf GROUP BY attr)),
 drawn AS (SELECT row_id, {', '.join(f"{sql_uniform(f'{SEED}/init', 'row_id', str(i))} AS u{i}" for i in range(3))} FROM ids),
 syn AS MATERIALIZED (SELECT row_id, {', '.join(f'CAST(least(len([p for p in l{i} if p <= u{i}]), k{i} - 1) AS INTEGER) AS c{i}' for i in range(3))} FROM drawn, lists, ks),
 sa AS (SELECT qid, count(row_id) AS answer FROM q LEFT JOIN syn ON {sql_holds('c')} GROUP BY 1),
 state AS MATERIALIZED (SELECT qid, target, answer, target - answer AS residual FROM truth JOIN sa USING (qid))"""


def _priority(kappa: float) -> str:
    return f"""(SELECT *, CASE WHEN (SELECT count(*) FROM state WHERE (abs(residual) - {kappa} * {SIGMA}) / {SIGMA} > 0) = 0 THEN abs(residual) / {SIGMA}
      WHEN (abs(residual) - {kappa} * {SIGMA}) / {SIGMA} > 0 THEN (abs(residual) - {kappa} * {SIGMA}) / {SIGMA} END AS priority FROM state ORDER BY priority DESC NULLS LAST, qid LIMIT {ACTIVE})"""


_SOURCES = f"""
 active AS MATERIALIZED (SELECT q.*, residual, CASE WHEN residual > 0 THEN 1 ELSE 2 END AS repair_type FROM {_priority(1.0)} JOIN q USING (qid)),
 sources AS MATERIALIZED (SELECT * FROM (SELECT active.*, row_id, c0, c1, c2, row_number() OVER (PARTITION BY qid ORDER BY {sql_uniform(f'{SEED}/rows', 'qid', 'row_id')}, row_id) AS place
   FROM active JOIN syn ON {sql_holds('c')} = (repair_type = 2)) WHERE place <= {PER_QUERY})"""


def _k(a: str) -> str:
    return f"(CASE {a} WHEN 0 THEN k0 WHEN 1 THEN k1 ELSE k2 END)"


def _entered(i: int) -> str:
    def one(j: int) -> str:
        salt, ids, top = f"{SEED}/enter", ("qid", "row_id", str(i)), f"(k{i} - 1)"
        draws = {1: sql_integer("0", f"least(v{j}, {top})", salt, *ids), 2: sql_integer(f"v{j}", top, salt, *ids), 3: sql_integer(f"lo{j}", f"hi{j}", salt, *ids)}
        return f"greatest(0, least({top}, CASE op{j} WHEN 0 THEN v{j} WHEN 1 THEN {draws[1]} WHEN 2 THEN {draws[2]} ELSE {draws[3]} END))"

    return f"CASE WHEN a1 = {i} THEN {one(1)} WHEN a2 = {i} THEN {one(2)} ELSE c{i} END AS n{i}"


def _mutated(salt: str, *ids: str) -> tuple[str, list[str]]:
    attr = f"CAST(floor({sql_uniform(salt + '/attr', *ids)} * 3) AS INTEGER)"
    draw = sql_integer("0", f"{_k(attr)} - 2", salt + "/value", *ids)
    return attr, [f"CASE WHEN {attr} = {i} THEN {draw} + CAST({draw} >= c{i} AS INTEGER) ELSE c{i} END" for i in range(3)]


def _exited() -> str:
    s, ids = f"{SEED}/exit", ("qid", "row_id")

    def open_(j: int) -> str:
        top = f"({_k(f'a{j}')} - 1)"
        return f"coalesce(CASE op{j} WHEN 0 THEN {top} > 0 WHEN 1 THEN v{j} < {top} WHEN 2 THEN v{j} > 0 ELSE lo{j} > 0 OR hi{j} < {top} END, false)"

    pick = f"""p1 AS (SELECT *, {open_(1)} AS b1, a2 IS NOT NULL AND {open_(2)} AS b2 FROM sources, ks WHERE repair_type = 2),
     p2 AS (SELECT *, CAST(b1 AS INTEGER) + CAST(b2 AS INTEGER) AS nb, CAST(floor({sql_uniform(s + '/term', *ids)} * (CAST(b1 AS INTEGER) + CAST(b2 AS INTEGER))) AS INTEGER) AS pk FROM p1),
     p3 AS (SELECT *, CASE WHEN nb = 0 THEN NULL WHEN b1 AND pk = 0 THEN 1 ELSE 2 END AS j FROM p2),
     p4 AS (SELECT *, {', '.join(f'CASE j WHEN 1 THEN {x}1 WHEN 2 THEN {x}2 END AS {y}' for x, y in (('a', 'pa'), ('op', 'po'), ('v', 'pv')))}, {_k('(CASE j WHEN 1 THEN a1 ELSE a2 END)')} - 1 AS top FROM p3)"""
    other = sql_integer("0", "top - 1", s + "/value", *ids)
    new = f"CASE po WHEN 0 THEN {other} + CAST({other} >= pv AS INTEGER) ELSE {sql_integer('pv + 1', 'top', s + '/value', *ids)} END"
    _, mutated = _mutated(s + "/random", *ids)
    columns = ", ".join(f"CASE WHEN j IS NULL THEN {mutated[i]} WHEN pa = {i} THEN greatest(0, least({new}, top)) ELSE c{i} END AS n{i}" for i in range(3))
    return f"{pick}, exited AS (SELECT qid, row_id, place, repair_type, c0, c1, c2, {columns} FROM p4)"


_COST = " + ".join(f"CAST(c{i} <> n{i} AS INTEGER)" for i in range(3)) + f" + {GAMMA}::DOUBLE / greatest(1, k2 - 1) * abs(c2 - n2)"
_CANDS = f"""{_SOURCES},
 entered AS (SELECT qid, row_id, place, repair_type, c0, c1, c2, {', '.join(_entered(i) for i in range(3))} FROM sources, ks WHERE repair_type = 1),
 {_exited()},
 cands AS MATERIALIZED (SELECT CAST(qid * 1000 + place AS BIGINT) AS cand_id, qid AS target_qid, row_id, repair_type, c0, c1, c2, n0, n1, n2, {_COST} AS edit_cost FROM (SELECT * FROM entered UNION ALL SELECT * FROM exited), ks WHERE c0 <> n0 OR c1 <> n1 OR c2 <> n2)"""
_SCORED = f"""{_CANDS},
 deltas AS MATERIALIZED (SELECT * FROM (SELECT cand_id, qid, CAST({sql_holds('n')} AS INTEGER) - CAST({sql_holds('c')} AS INTEGER) AS delta FROM cands, q) WHERE delta <> 0),
 scored AS (SELECT cands.*, coalesce(g, 0) - {LAMBDA}::DOUBLE * edit_cost AS advantage FROM cands LEFT JOIN (SELECT cand_id, sum(delta * residual / {VARIANCE} - 0.5 * delta * delta / {VARIANCE}) AS g FROM deltas JOIN state USING (qid) GROUP BY 1) USING (cand_id)),
 best AS (SELECT * FROM scored WHERE advantage > 1e-6 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY advantage DESC, cand_id) = 1),
 picked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY advantage DESC, cand_id) AS rank FROM best QUALIFY rank <= {ACCEPT}),
 prefixes AS (SELECT p.rank, p.cand_id, coalesce((SELECT sum(x * residual / {VARIANCE} - 0.5 * x * x / {VARIANCE}) FROM (SELECT qid, sum(delta) AS x FROM deltas JOIN picked o USING (cand_id) WHERE o.rank <= p.rank GROUP BY 1) JOIN state USING (qid)), 0)
   - {LAMBDA}::DOUBLE * (SELECT sum(edit_cost) FROM picked o WHERE o.rank <= p.rank) AS prefix_advantage FROM picked p),
 upto AS (SELECT max(rank) AS r FROM prefixes WHERE prefix_advantage > 0),
 bestupto AS (SELECT rank AS r FROM prefixes WHERE prefix_advantage > 0 ORDER BY prefix_advantage DESC, rank LIMIT 1),
 accepted AS MATERIALIZED (SELECT * FROM picked WHERE rank <= (SELECT r FROM upto)),
 moved AS MATERIALIZED (SELECT qid, target, answer + coalesce(s, 0) AS answer, target - answer - coalesce(s, 0) AS residual, answer AS initial_answer, residual AS initial_residual FROM state LEFT JOIN (SELECT qid, CAST(sum(delta) AS BIGINT) AS s FROM deltas JOIN accepted USING (cand_id) GROUP BY 1) USING (qid)),
 edited AS (SELECT syn.row_id, coalesce(n0, syn.c0) AS c0, coalesce(n1, syn.c1) AS c1, coalesce(n2, syn.c2) AS c2 FROM syn LEFT JOIN accepted ON syn.row_id = accepted.row_id)"""
_MUTATE = _mutated(f"{SEED}/mutate", "row_id")[1]
_PICK = sql_uniform(f"{SEED}/pick", "row_id")
_CHANGED = "(c0 <> n0 OR c1 <> n1 OR c2 <> n2)"
_BATCH = f"""{_CANDS},
 directed AS (SELECT row_id, c0, c1, c2, n0, n1, n2, qid AS target_qid, repair_type, CAST(place AS DOUBLE) AS place FROM (SELECT * FROM entered UNION ALL SELECT * FROM exited) JOIN (SELECT qid, priority FROM {_priority(1.0)}) USING (qid)
   WHERE {_CHANGED} ORDER BY priority DESC NULLS LAST, target_qid, place, row_id LIMIT {TOTAL - round(TOTAL * RANDOM_SHARE)}),
 chance AS (SELECT row_id, c0, c1, c2, {', '.join(f'{x} AS n{i}' for i, x in enumerate(_MUTATE))}, -1 AS target_qid, 0 AS repair_type, {_PICK} AS place FROM (SELECT * FROM syn ORDER BY {_PICK}, row_id LIMIT {TOTAL}), ks),
 batch AS (SELECT row_number() OVER (ORDER BY part, target_qid, place, row_id) - 1 AS cand_id, * FROM (SELECT 0 AS part, * FROM directed UNION ALL SELECT 1, * FROM chance WHERE {_CHANGED}))"""
_N = "(SELECT CAST(count(*) AS DOUBLE) FROM orders)"


def _errors(answer: str, prefix: str = "") -> str:
    e = f"abs(target / {_N} - {answer} / {_N})"
    return f"{sql_r6(f'1000 * avg({e})', prefix + 'mae')}, {sql_r6(f'1000 * sqrt(avg({e} * {e}))', prefix + 'rmse')}, {sql_r6(f'1000 * max({e})', prefix + 'max_error')}"


def _fall(m: str) -> str:
    e, f = f"abs(target / {_N} - initial_answer / {_N})", f"abs(target / {_N} - answer / {_N})"
    of = {"mae": "avg({0})", "rmse": "sqrt(avg({0} * {0}))", "max_error": "max({0})"}[m]
    return sql_r6(f"1000 * ({of.format(e)} - {of.format(f)})", m + "_reduction")


_LOSS = f"0.5 * residual * residual / {VARIANCE}"
ORACLES = {
    "init_independent": f"WITH {_WORLD} SELECT row_id, c0 AS codes0, c1 AS codes1, c2 AS codes2 FROM syn",
    "query_state": f"WITH {_WORLD} SELECT qid, target, answer, residual FROM state",
    "active_topk": f"WITH {_WORLD} SELECT qid, {sql_r6('priority', 'priority')} FROM {_priority(1.0)}",
    "active_fallback": f"WITH {_WORLD} SELECT qid, {sql_r6('priority', 'priority')} FROM {_priority(1e9)}",
    "sample_sources": f"WITH {_WORLD}, {_SOURCES} SELECT qid, repair_type, CAST(place AS INTEGER) AS place, row_id FROM sources",
    "enter_repair": f"WITH {_WORLD}, {_CANDS} SELECT qid, row_id, n0 AS new0, n1 AS new1, n2 AS new2 FROM entered",
    "exit_repair": f"WITH {_WORLD}, {_CANDS} SELECT qid, row_id, n0 AS new0, n1 AS new1, n2 AS new2 FROM exited",
    "random_mutation": f"WITH {_WORLD} SELECT row_id, {', '.join(f'{x} AS new{i}' for i, x in enumerate(_MUTATE))} FROM syn, ks",
    "edit_cost": f"WITH {_WORLD}, {_CANDS} SELECT cand_id, row_id, {sql_r6('edit_cost', 'edit_cost')}, c0 AS old0, c1 AS old1, c2 AS old2, n0 AS new0, n1 AS new1, n2 AS new2 FROM cands",
    "candidate_batch": f"WITH {_WORLD}, {_BATCH} SELECT cand_id, row_id, target_qid, repair_type, {sql_r6(_COST, 'edit_cost')}, c0 AS old0, c1 AS old1, c2 AS old2, n0 AS new0, n1 AS new1, n2 AS new2 FROM batch, ks WHERE cand_id < {TOTAL}",
    "returned_topk": f"WITH {_WORLD}, {_SCORED} SELECT cand_id, row_id, {sql_r6('advantage', 'advantage')} FROM (SELECT * FROM scored ORDER BY advantage DESC, cand_id LIMIT {RETURNED})",
    "candidate_deltas": f"WITH {_WORLD}, {_SCORED} SELECT cand_id, qid, delta FROM deltas",
    "score_dense": f"WITH {_WORLD}, {_SCORED} SELECT cand_id, {sql_r6('advantage', 'advantage')} FROM scored",
    "score_target_only": f"WITH {_WORLD}, {_SCORED} SELECT c.cand_id, {sql_r6(f'coalesce(delta, 0) * residual / {VARIANCE} - 0.5 * coalesce(delta * delta, 0) / {VARIANCE} - {LAMBDA}::DOUBLE * edit_cost', 'advantage')} FROM cands c JOIN state s ON s.qid = target_qid LEFT JOIN deltas d ON d.cand_id = c.cand_id AND d.qid = target_qid",
    "select_nonconflicting": f"WITH {_WORLD}, {_SCORED} SELECT CAST(rank AS INTEGER) AS rank, cand_id, row_id, {sql_r6('advantage', 'advantage')} FROM picked",
    "batch_advantage": f"WITH {_WORLD}, {_SCORED} SELECT {sql_r6('prefix_advantage', 'advantage')} FROM prefixes ORDER BY rank DESC LIMIT 1",
    "transport_prefix": f"WITH {_WORLD}, {_SCORED} SELECT CAST(rank AS INTEGER) AS rank, cand_id, {sql_r6('prefix_advantage', 'prefix_advantage')} FROM prefixes",
    "transport_choice": f"WITH {_WORLD}, {_SCORED} SELECT s AS strategy, CAST(rank AS INTEGER) AS rank, cand_id, (SELECT {sql_r6('prefix_advantage', 'x')} FROM prefixes WHERE prefixes.rank = b.r) AS batch_advantage FROM picked, (SELECT 'largest_positive' AS s, r FROM upto UNION ALL SELECT 'best_advantage', r FROM bestupto) b WHERE rank <= r",
    "apply_edits": f"WITH {_WORLD}, {_SCORED} SELECT row_id, c0 AS codes0, c1 AS codes1, c2 AS codes2 FROM edited",
    "incremental_answers": f"WITH {_WORLD}, {_SCORED} SELECT qid, answer, residual FROM moved",
    "full_recompute_drift": f"WITH {_WORLD}, {_SCORED} SELECT max(abs(moved.answer - n)) AS max_drift FROM moved JOIN (SELECT qid, count(row_id) AS n FROM q LEFT JOIN edited ON {sql_holds('c')} GROUP BY 1) USING (qid)",
    "measured_loss": f"WITH {_WORLD}, {_SCORED}, l AS (SELECT 'before' AS moment, sum({_LOSS}) AS loss, count(*) AS m FROM state UNION ALL SELECT 'after', sum({_LOSS}), count(*) FROM moved) SELECT moment, {sql_r6('loss', 'loss')}, {sql_r6('sqrt(2 * loss / m)', 'rms')} FROM l",
    "query_error": f"WITH {_WORLD}, {_SCORED} SELECT {_errors('initial_answer', 'initial_')}, {_errors('answer', 'final_')}, {_fall('mae')}, {_fall('rmse')}, {_fall('max_error')} FROM moved",
    "query_error_empty": "SELECT 0.0::DOUBLE AS mae, 0.0::DOUBLE AS rmse, 0.0::DOUBLE AS max_error",
    "metrics_by_family": f"WITH {_WORLD}, {_SCORED} SELECT family, count(*) AS num_queries, {sql_r6(f'sum(0.5 * initial_residual * initial_residual / {VARIANCE})', 'initial_loss')}, {sql_r6(f'sum({_LOSS})', 'final_loss')}, {_errors('answer')}, {sql_r6(f'sum(0.5 * initial_residual * initial_residual / {VARIANCE}) - sum({_LOSS})', 'loss_reduction')} FROM moved JOIN q USING (qid) GROUP BY 1",
}

_FIRST = f"0.5 * residual * residual / {VARIANCE}"
_FIRST_ERROR = f"abs(target / {_N} - answer / {_N})"
_RUN = {
    "num_rows_real": f"SELECT {_N}",
    "num_rows_synthetic": f"SELECT {_N}",
    "num_columns": "SELECT count(*) FROM attrs",
    "num_queries": "SELECT count(*) FROM q",
    "num_measurement_groups": "SELECT sum(n) FROM sizes",
    "initial_measured_loss": f"SELECT sum({_FIRST}) FROM state",
    "initial_rms_standardized_residual": f"SELECT sqrt(2 * sum({_FIRST}) / count(*)) FROM state",
    "initial_true_query_mae": f"SELECT avg({_FIRST_ERROR}) FROM state",
    "initial_true_query_max_error": f"SELECT max({_FIRST_ERROR}) FROM state",
    "final_incremental_answer_drift": "SELECT 0",
    "num_iterations": f"SELECT {RUN_ITERS}",
    "num_2way_pairs_possible": "SELECT count(*) FROM attrs x JOIN attrs y ON x.attr < y.attr",
    "num_2way_cells_possible": "SELECT sum(x.k * y.k) FROM attrs x JOIN attrs y ON x.attr < y.attr",
    "num_2way_queries_constructed": "SELECT count(*) FROM q WHERE family = 'twoway'",
    **{k: "SELECT 1" for k in ("losses never rise", "last loss is reported", "edits add up", "candidates add up", "held-out queries are other ones")},
}
ORACLES["run_report"] = f"""WITH {_WORLD}, sizes AS (SELECT family, count(DISTINCT CASE family WHEN 'twoway' THEN a1 * 3 + a2 ELSE a1 END) AS n FROM q GROUP BY 1),
 told AS ({' UNION ALL '.join(f"SELECT '{k}' AS name, CAST(({v}) AS DOUBLE) AS x" for k, v in _RUN.items())}
  UNION ALL SELECT 'initial_measured_loss of ' || family, sum({_FIRST}) FROM state JOIN q USING (qid) GROUP BY family
  UNION ALL SELECT 'num_queries_by_family of ' || family, count(*) FROM q GROUP BY family
  UNION ALL SELECT 'num_groups_by_family of ' || family, n FROM sizes)
 SELECT name, {sql_r6('x', 'value')} FROM told"""
