"""The whole run: measure a table, draw a synthetic one, edit it, report.

The loop runs on the driver with a few actions in each iteration; what an
iteration leaves is written to the shared checkpoint folder, so lineage stays
short and a lost executor costs one iteration at most.  After the first
measurement the private table is read for evaluation only: ``evolve`` is given
the state of the queries and the synthetic table, nothing else.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.functions.lineage import written as _written
from querymill.operators import answer as ans
from querymill.operators import catalogue as cat
from querymill.operators import encode as enc
from querymill.operators import evolve as ev
from querymill.operators import measure as ms
from querymill.operators import metrics
from querymill.operators import workload as wl
from querymill.operators.schema import TableSchema
from querymill.plans import report
from querymill.sources import config as cfg
from querymill.sources import tables

log = logging.getLogger("querymill")
# What a held-out workload is unless configured.
HELD_OUT = {"families": ("twoway", "prefix", "range", "mixed"), "max_queries": 10_000, "max_terms": 4, "max_2way_cells": 10_000, "range_intervals": 128, "mixed_per_pair": 128, "seed": 10_000}


@dataclass(frozen=True)
class EvolveConfig:
    max_iters: int = 20
    accepted_per_iter: int = 512
    num_active: int = 64
    kappa: float = 1.0
    lambda_cost: float = 0.01
    min_advantage: float = 1e-6
    gamma: float = 0.1
    total_candidates: int = 4096
    per_target: int = 64
    random_fraction: float = 0.05
    strategy: str = "largest_positive"
    score: str = "dense"
    random_only: bool = False
    #: "table" keeps all scored candidates for the selection, "fused" the ``returned`` best.
    candidate_backend: str = "table"
    returned: int = 1024
    range_exit: str = "uniform"
    patience: int = 5
    full_recompute_every: int = 10
    seed: int = 0


@dataclass
class EvolveResult:
    syn: DataFrame
    state: DataFrame
    series: list[dict[str, Any]]
    clock: report.Stopwatch


def evolve(syn: DataFrame, queries: DataFrame, state: DataFrame, schema: TableSchema, config: EvolveConfig) -> EvolveResult:
    """Edit ``syn`` (row_id, codes) so that its answers approach the targets in ``state``."""
    if config.candidate_backend not in ("table", "fused"):
        raise ValueError(f"unknown candidate backend {config.candidate_backend!r}")
    d, series, idle = schema.d, [], 0
    syn, state = _written(syn), _written(state)
    m = state.count()
    clock = report.Stopwatch()
    for it in range(1, config.max_iters + 1):
        salt = f"{config.seed}/{it}"
        active = _written(ev.active_queries(state, config.num_active, config.kappa).join(queries.select("qid", "terms"), "qid"))
        clock.lap("schedule")
        cands = _written(ev.candidates(syn, active, schema, config.total_candidates, salt, config.random_fraction, config.per_target, config.gamma, config.random_only, config.range_exit))
        clock.lap("propose")
        delta = _written(ev.deltas(cands, queries))
        if config.score == "target_only":
            scored = ev.score_target_only(cands, queries, state, config.lambda_cost)
        else:
            scored = ev.score_dense(cands, delta, state, config.lambda_cost)
        scored = _written(scored)
        returned = _written(ev.top_scored(scored, config.returned)) if config.candidate_backend == "fused" else scored
        clock.lap("score")
        selected = _written(ev.select_nonconflicting(returned, config.accepted_per_iter, config.min_advantage))
        accepted = _written(ev.choose_prefix(selected, delta, state, config.lambda_cost, config.strategy))
        clock.lap("select")
        if not accepted.isEmpty():
            state, syn = _written(ev.apply_deltas(state, accepted, delta)), _written(ev.apply_edits(syn, accepted))
        clock.lap("apply")
        gap = None
        if config.full_recompute_every and (it % config.full_recompute_every == 0 or it == config.max_iters):
            counted = _written(ans.answer(_columns(syn, d), queries, schema.cardinalities))
            gap = ev.drift(state, counted).first()["max_drift"]
            if gap:
                log.warning("iteration %d: answers drifted by %s; the counted ones replace them", it, gap)
                state = _written(state.drop("answer").join(counted, "qid").withColumn("residual", F.col("target") - F.col("answer")).select(*state.columns))
        clock.lap("recount")
        n_active = active.count()
        row = report.iteration_row(it, clock.began, m, n_active, 0 if config.random_only else n_active, config.total_candidates, scored, returned, selected, accepted, state, config.min_advantage, gap)
        clock.lap("report")
        series.append(row)
        log.info("iteration %d: loss %.6g, %d candidates, %.3f positive, %d accepted", it, row["measured_loss"], row["num_candidates"], row["positive_advantage_rate"], row["accepted_edits"])
        idle = 0 if row["accepted_edits"] else idle + 1
        if idle >= config.patience:
            log.info("stopped after %d iterations without an edit", idle)
            break
    return EvolveResult(syn, state, series, clock)


def _columns(codes: DataFrame, d: int) -> DataFrame:
    return codes.select("row_id", *[F.col("codes")[i].alias(f"c{i}") for i in range(d)])


# Ablations: what each variant changes in the configuration.
VARIANTS: dict[str, dict[str, Any]] = {
    "full": {},
    "random_mutation": {"evolve.random_only": True},
    "no_edit_cost": {"evolve.lambda_cost": 0.0},
    "sequential_greedy": {"evolve.accepted_per_iter": 1},
    "target_only": {"evolve.score": "target_only"},
    "no_threshold": {"evolve.kappa": 0.0},
}


def ablation(config: dict[str, Any], variant: str) -> dict[str, Any]:
    """The configuration of a variant; its results go to a folder of its own."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}; there are {', '.join(VARIANTS)}")
    out = cfg.apply_overrides(config, [])
    for k, v in VARIANTS[variant].items():
        cfg.set_nested(out, k, v)
    cfg.set_nested(out, "run.output_dir", f"{cfg.get(out, 'run.output_dir', 'outputs/run')}_{variant}")
    return out


def _workload(section: dict[str, Any], seed: int) -> wl.WorkloadConfig:
    return wl.WorkloadConfig(**{"seed": seed, **{k: tuple(v) if isinstance(v, list) else v for k, v in section.items()}})


def _write_queries(queries: DataFrame, path: str) -> None:
    cfg.write_json({"queries": [r.asDict(recursive=True) for r in queries.orderBy("qid").collect()]}, path)


def run(spark: SparkSession, config: dict[str, Any], table: DataFrame | None = None) -> dict[str, Any]:
    """Read, encode, measure, draw, evolve, evaluate and write; returns the final metrics.

    ``table`` replaces the input file.  Sections of the configuration: run,
    preprocess, workload, privacy, init, evolve, evaluation.
    """
    out_dir = cfg.ensure_dir(cfg.get(config, "run.output_dir", "outputs/run"))
    with report.run_log(f"{out_dir}/logs.txt"):
        return _run(spark, config, table, out_dir)


def _run(spark: SparkSession, config: dict[str, Any], table: DataFrame | None, out_dir: str) -> dict[str, Any]:
    clock = report.Stopwatch()
    log.info("results go to %s", out_dir)
    seed = int(cfg.get(config, "run.seed", 0))
    cfg.save_yaml(config, f"{out_dir}/config_resolved.yaml")
    raw = table if table is not None else tables.read_table(spark, cfg.require(config, "run.input"))
    pre = cfg.get(config, "preprocess", {}) or {}
    schema = enc.fit_schema(
        raw,
        [c for c in raw.columns if c != pre.get("id_column")],
        int(pre.get("numerical_bins", 32)),
        pre.get("numerical_columns") or (),
        pre.get("categorical_columns") or (),
        int(pre.get("auto_numeric_min_unique", 10)),
        bool(pre.get("force_all_categorical", False)),
        pre.get("missing_token", enc.MISSING),
        pre.get("label_column"),
    )
    cfg.write_json(schema.to_dict(), f"{out_dir}/schema.json")
    ids = F.col(pre["id_column"]) if pre.get("id_column") else F.monotonically_increasing_id()
    real = _written(enc.encode(raw, schema, ids))
    n_real = real.count()
    log.info("%d rows of %d attributes", n_real, schema.d)

    wconf = _workload(cfg.get(config, "workload", {}) or {}, seed)
    queries, groups = (_written(x) for x in wl.build(spark, schema, wconf))
    _write_queries(queries, f"{out_dir}/queries.json")
    work = report.workload_report(queries, schema, wconf)
    cfg.write_json(work, f"{out_dir}/workload_summary.json")
    log.info("%d queries", work["total_num_queries"])
    held = None
    if cfg.get(config, "evaluation.heldout", False):
        hconf = _workload({**HELD_OUT, **(cfg.get(config, "evaluation.heldout_workload", {}) or {})}, seed)
        every = _written(wl.build(spark, schema, hconf)[0])
        excluded = bool(cfg.get(config, "evaluation.exclude_measured", True))
        held = _written(cat.renumber(cat.exclude_measured(every, queries), "qid")) if excluded else every
        _write_queries(held, f"{out_dir}/queries_holdout.json")
        told = report.held_out_report(held, every.count() - held.count(), excluded, hconf)
        cfg.write_json(told, f"{out_dir}/workload_summary_holdout.json")
        log.info("%d held-out queries", told["total_num_queries"])
    clock.lap("preparation")

    priv = cfg.get(config, "privacy", {}) or {}
    mconf = ms.MeasureConfig(**{"salt": f"{seed}/noise", **priv})
    true = _written(ans.answer(real, queries, schema.cardinalities))
    measured = _written(ms.measure_answers(true, groups, float(n_real), mconf))
    public = {"mode": mconf.mode, "rho_total": mconf.rho_total, "delta": mconf.delta, "epsilon": mconf.epsilon}
    cfg.write_json({**public, "measurements": [r.asDict() for r in ms.public_view(measured).orderBy("qid").collect()]}, f"{out_dir}/measurements.json")
    clock.lap("measurement")

    n_syn = ev.resolve_rows(cfg.get(config, "init.n_syn", "same_as_real"), n_real)
    if n_syn != n_real:
        log.warning("%d synthetic rows for %d real ones: targets are at the scale of the real table", n_syn, n_real)
    t = F.col("terms")[0]
    marg = queries.where("family = 'oneway'").join(measured, "qid").select(t["attr"].alias("attr"), t["value"].alias("v"), F.col("target_projected").alias("target"))
    syn = _written(ev.independent_codes(spark, n_syn, marg, schema, f"{seed}/init"))
    first = _written(ans.answer(_columns(syn, schema.d), queries, schema.cardinalities))
    state = measured.join(first, "qid").select(
        "qid", F.col("target_projected").alias("target"), "answer", (F.col("target_projected") - F.col("answer")).alias("residual"), "variance", "inv_variance", F.sqrt("variance").alias("sigma"), F.lit(0.0).alias("debt")
    )
    clock.lap("init")
    econf = EvolveConfig(**{"seed": seed, **(cfg.get(config, "evolve", {}) or {})})
    result = evolve(syn, queries, state, schema, econf)
    clock.lap("generation")

    made = _columns(result.syn, schema.d)
    tables.write_parquet(made, f"{out_dir}/synthetic_encoded.parquet")
    if cfg.get(config, "evaluation.save_synthetic_csv", True):
        tables.write_csv(enc.decode(made, schema).drop("row_id"), f"{out_dir}/synthetic.csv")
    counted = _written(ans.answer(made, queries, schema.cardinalities))
    gap = float(ev.drift(result.state, counted).first()["max_drift"])
    final = result.state.drop("answer").join(counted, "qid").withColumn("residual", F.col("target") - F.col("answer"))
    final = final.join(first.select("qid", F.col("answer").alias("initial_answer")), "qid").join(true.select("qid", F.col("answer").alias("true_answer")), "qid").join(queries.select("qid", "family"), "qid")
    final = _written(final.withColumn("initial_residual", F.col("target") - F.col("initial_answer")))
    losses = final.agg(F.sum(0.5 * F.col("initial_residual") ** 2 * F.col("inv_variance")).alias("initial"), F.sum(metrics.loss_column()).alias("final"), F.count(F.lit(1)).alias("m")).first()
    before, after = losses["initial"] or 0.0, losses["final"] or 0.0
    n = report.totals(result.series)
    out: dict[str, Any] = {
        "dataset_name": cfg.get(config, "run.dataset_name"),
        "privacy_mode": mconf.mode,
        "rho_total": mconf.rho_total,
        "delta": mconf.delta,
        "epsilon_delta": mconf.epsilon,
        "num_rows_real": n_real,
        "num_rows_synthetic": n_syn,
        "num_columns": schema.d,
        "num_queries": losses["m"],
        "num_measurement_groups": groups.count(),
        "initial_measured_loss": before,
        "final_measured_loss": after,
        "loss_reduction": before - after,
        "initial_rms_standardized_residual": metrics.rms_standardized_residual(before, losses["m"]),
        "final_rms_standardized_residual": metrics.rms_standardized_residual(after, losses["m"]),
        "final_incremental_answer_drift": gap,
        **{k: n[k] for k in ("num_iterations", "num_candidates_scored", "num_candidates_requested", "num_candidate_shortfall", "num_accepted_edits")},
        "score_backend": econf.score,
        "candidate_backend": econf.candidate_backend,
        "positive_returned_rate_is_topk_biased": econf.candidate_backend == "fused",
        "transport_prefix_strategy": econf.strategy,
    }
    truth = bool(cfg.get(config, "evaluation.true_query_error", True))
    if truth:
        errors = report.true_query(metrics.before_and_after(final, n_real, n_syn).first())
        out |= errors | {k.removeprefix("final_"): v for k, v in errors.items() if k.startswith("final_")}
        log.info("error of true answers, for evaluation only: mean %.6g at first, %.6g at last", errors["initial_true_query_mae"], errors["final_true_query_mae"])
    if held is not None:
        three = [(real, "true_answer"), (_columns(syn, schema.d), "initial_answer"), (made, "answer")]
        both = held.select("qid", "family")
        for rows, name in three:
            both = both.join(ans.answer(rows, held, schema.cardinalities).withColumnRenamed("answer", name), "qid")
        both = _written(both)
        of_held = report.held_out_metrics(both, n_real, n_syn)
        cfg.write_json(of_held, f"{out_dir}/metrics_holdout.json")
        cfg.write_json(report.errors_by_family(both, n_real, n_syn), f"{out_dir}/metrics_by_family_holdout.json")
        out |= {f"heldout_{k}": v for k, v in of_held.items() if k != "queries_by_family"}
        log.info("error of held-out answers, for evaluation only: mean %.6g at first, %.6g at last", of_held["initial_true_query_mae"], of_held["final_true_query_mae"])
    cfg.write_json(report.metrics_by_family(final, n_real, n_syn, truth), f"{out_dir}/metrics_by_family.json")
    clock.lap("evaluation")
    out |= report.efficiency(n, before - after, result.clock.of(*result.clock.seconds))
    log.info("loss %.6g at first, %.6g at last; %d candidates, %d edits", before, after, n["num_candidates_scored"], n["num_accepted_edits"])
    cfg.write_json(out, f"{out_dir}/metrics_final.json")
    cfg.write_json(report.runtime(clock, result.clock, n, before - after), f"{out_dir}/runtime.json")
    report.write_series(result.series, f"{out_dir}/metrics_timeseries.csv")
    return out
