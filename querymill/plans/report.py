"""What a run reports beside its tables: a log, a row for each iteration, summaries, errors and rates.

All of it comes from aggregates of a few rows; nothing here reads a table row by row.
"""

from __future__ import annotations

import csv
import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from querymill.operators import metrics
from querymill.operators.evolve import RANDOM
from querymill.operators.schema import TableSchema
from querymill.operators.workload import WorkloadConfig

log = logging.getLogger("querymill")

# The columns of the series file.
SERIES = (
    "iteration int, wall_time double, measured_loss double, rms_standardized_residual double, residual_l2 double, residual_l1 double, "
    "active_queries long, num_candidates long, candidates_scored_this_iter long, positive_advantage_rate double, positive_returned_rate double, "
    "selected_nonconflicting long, accepted_edits long, accepted_rate double, mean_advantage double, batch_advantage double, "
    "requested_candidates long, directed_candidates long, random_candidates long, candidate_shortfall long, "
    "source_filter_attempts long, source_filter_failures long, incremental_answer_drift double"
)
COLUMNS = [c.split()[0] for c in SERIES.split(", ")]


@contextmanager
def run_log(path: str) -> Iterator[None]:
    """What is logged meanwhile also goes to a file, on the driver."""
    handler = logging.FileHandler(path, mode="w", encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
    level = log.level
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    try:
        yield
    finally:
        log.setLevel(level)
        log.removeHandler(handler)
        handler.close()


# --- iterations ---------------------------------------------------------------


def iteration_row(it: int, began: float, m: int, active: int, attempts: int, requested: int, scored: DataFrame, returned: DataFrame, selected: DataFrame, accepted: DataFrame, state: DataFrame, least: float, drift: float | None) -> dict[str, Any]:
    """The series row of an iteration, from a few small aggregates.

    Candidates are counted as returned, which are the best of the scored ones
    if there is such a cut.  ``attempts`` are the active queries for which
    rows that an edit can help were looked for; one failed where no candidate
    is left that aims at it.
    """
    n = F.count(F.lit(1))
    directed = F.col("repair_type") != RANDOM
    c = scored.agg(n.alias("all"), F.count_if(F.col("advantage") > least).alias("positive"), F.count_if(directed).alias("directed"), F.count_distinct(F.when(directed, F.col("target_qid"))).alias("aims")).first()
    back = c if returned is scored else returned.agg(n.alias("all"), F.count_if(F.col("advantage") > least).alias("positive")).first()
    a = accepted.agg(n.alias("n"), F.avg("advantage").alias("mean"), F.max("batch_advantage").alias("batch")).first()
    r = state.agg(F.coalesce(F.sum(metrics.loss_column()), F.lit(0.0)).alias("loss"), F.coalesce(F.sum(F.abs("residual")), F.lit(0.0)).alias("l1"), F.coalesce(F.sqrt(F.sum(F.col("residual") * F.col("residual"))), F.lit(0.0)).alias("l2")).first()
    rate = c["positive"] / max(1, c["all"])
    return {
        "iteration": it,
        "wall_time": time.perf_counter() - began,
        "measured_loss": r["loss"],
        "rms_standardized_residual": metrics.rms_standardized_residual(r["loss"], m),
        "residual_l2": r["l2"],
        "residual_l1": float(r["l1"]),
        "active_queries": active,
        "num_candidates": back["all"],
        "candidates_scored_this_iter": c["all"],
        "positive_advantage_rate": rate,
        "positive_returned_rate": back["positive"] / max(1, back["all"]),
        "selected_nonconflicting": selected.count(),
        "accepted_edits": a["n"],
        "accepted_rate": a["n"] / max(1, back["all"]),
        "mean_advantage": a["mean"] or 0.0,
        "batch_advantage": a["batch"] or 0.0,
        "requested_candidates": requested,
        "directed_candidates": c["directed"],
        "random_candidates": c["all"] - c["directed"],
        "candidate_shortfall": max(0, requested - c["all"]),
        "source_filter_attempts": attempts,
        "source_filter_failures": max(0, attempts - c["aims"]),
        "incremental_answer_drift": None if drift is None else float(drift),
    }


def write_series(series: list[dict[str, Any]], path: str) -> None:
    """A CSV file with a header, also when there was no iteration."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, COLUMNS)
        w.writeheader()
        w.writerows(series)


# --- runtime ------------------------------------------------------------------


@dataclass
class Stopwatch:
    """Seconds by phase."""

    seconds: dict[str, float] = field(default_factory=dict)
    began: float = field(default_factory=time.perf_counter)

    def __post_init__(self) -> None:
        self.at = self.began

    def lap(self, phase: str) -> None:
        now = time.perf_counter()
        self.seconds[phase] = self.seconds.get(phase, 0.0) + now - self.at
        self.at = now

    def of(self, *phases: str) -> float:
        return sum(self.seconds.get(p, 0.0) for p in phases)


def totals(series: list[dict[str, Any]]) -> dict[str, int]:
    """What the iterations add up to, under the names of the report."""
    sums = {
        "num_candidates_requested": "requested_candidates",
        "num_candidates_scored": "candidates_scored_this_iter",
        "num_candidate_shortfall": "candidate_shortfall",
        "num_directed_candidates": "directed_candidates",
        "num_random_candidates": "random_candidates",
        "num_source_filter_attempts": "source_filter_attempts",
        "num_source_filter_failures": "source_filter_failures",
        "num_selected_nonconflicting_candidates": "selected_nonconflicting",
        "num_accepted_edits": "accepted_edits",
    }
    out = {name: int(sum(r[c] for r in series)) for name, c in sums.items()}
    positive = round(sum(r["positive_returned_rate"] * r["num_candidates"] for r in series))
    return {"num_iterations": len(series), **out, "num_candidates_returned_to_cpu": sum(r["num_candidates"] for r in series), "num_positive_returned_candidates": positive}


def efficiency(n: dict[str, int], loss_reduction: float, seconds: float) -> dict[str, float]:
    """What a second of generation brought."""
    s = max(seconds, 1e-9)
    return {
        "loss_reduction_per_second": loss_reduction / s,
        "candidates_scored_per_second": n["num_candidates_scored"] / s,
        "accepted_edits_per_second": n["num_accepted_edits"] / s,
        "accepted_per_scored_candidate": n["num_accepted_edits"] / max(1, n["num_candidates_scored"]),
    }


def runtime(clock: Stopwatch, loop: Stopwatch, n: dict[str, int], loss_reduction: float) -> dict[str, Any]:
    """Seconds by phase, totals, rates and the funnel of candidates."""
    generation = loop.of(*loop.seconds)
    scored, accepted = n["num_candidates_scored"], n["num_accepted_edits"]
    returned = max(1, n["num_candidates_returned_to_cpu"])
    rates = {
        "accepted_rate": accepted / max(1, scored),
        "candidate_scoring_throughput_per_second": scored / max(1e-9, loop.of("score")),
        "positive_returned_rate": n["num_positive_returned_candidates"] / returned,
        "selected_nonconflicting_per_returned_candidate": n["num_selected_nonconflicting_candidates"] / returned,
        "source_filter_failure_rate": n["num_source_filter_failures"] / max(1, n["num_source_filter_attempts"]),
    }
    return {
        "wall_clock_seconds": time.perf_counter() - clock.began,
        "time_measurement_seconds": clock.of("measurement"),
        "time_init_seconds": clock.of("init"),
        "time_generation_seconds": generation,
        "time_candidate_generation_seconds": loop.of("propose"),
        "time_scoring_seconds": loop.of("score"),
        "time_transport_seconds": loop.of("select", "apply"),
        "time_full_recompute_seconds": loop.of("recount"),
        "seconds": dict(loop.seconds),
        **n,
        **rates,
        **efficiency(n, loss_reduction, generation),
        "candidate_funnel": {
            "requested": n["num_candidates_requested"],
            "scored": scored,
            "returned_to_cpu": n["num_candidates_returned_to_cpu"],
            "positive_returned": n["num_positive_returned_candidates"],
            "selected_nonconflicting": n["num_selected_nonconflicting_candidates"],
            "accepted": accepted,
            "accepted_per_scored": rates["accepted_rate"],
            "positive_returned_rate": rates["positive_returned_rate"],
            "selected_per_returned": rates["selected_nonconflicting_per_returned_candidate"],
        },
    }


# --- workloads ----------------------------------------------------------------


def _families(queries: DataFrame) -> dict[str, Any]:
    rows = queries.groupBy("family").agg(F.count(F.lit(1)).alias("q"), F.count_distinct("grp").alias("g")).orderBy("family").collect()
    of, groups = {r["family"]: r["q"] for r in rows}, {r["family"]: r["g"] for r in rows}
    total = sum(of.values())
    return {"total_num_queries": total, "total_queries": total, "num_queries_by_family": of, "queries_by_family": of, "num_groups_by_family": groups, "groups_by_family": groups}


def workload_report(queries: DataFrame, schema: TableSchema, config: WorkloadConfig) -> dict[str, Any]:
    """M8: counts by family, the configuration, and which limit seems to have cut the workload short."""
    s = metrics.workload_summary(queries, schema, config.max_queries).first()
    possible, made = s["possible_2way_cells"], s["constructed_2way_cells"]
    return {
        **_families(queries),
        "workload_config": asdict(config),
        "max_queries_hit": s["max_queries_hit"],
        "max_2way_cells_appears_limiting": "twoway" in config.families and not s["max_queries_hit"] and made < possible and possible > config.max_2way_cells,
        "num_2way_pairs_possible": s["possible_2way_pairs"],
        "num_2way_groups_constructed": s["constructed_2way_pairs"],
        "num_2way_cells_possible": possible,
        "num_2way_queries_constructed": made,
    }


def held_out_report(queries: DataFrame, removed: int, excluded: bool, config: WorkloadConfig) -> dict[str, Any]:
    """M9: the same of the held-out queries, and how many were measured ones."""
    return {**_families(queries), "num_removed_as_measured_duplicates": removed, "heldout_exclude_measured_queries": excluded, "workload_config": asdict(config)}


# --- errors -------------------------------------------------------------------


def true_query(row: Row | dict[str, Any]) -> dict[str, float]:
    """The errors of ``metrics.before_and_after`` under the names of the report."""
    out = {}
    for name, value in (row if isinstance(row, dict) else row.asDict()).items():
        when, _, rest = name.partition("_")
        if when in ("initial", "final"):
            out[f"{when}_true_query_{rest}"] = value
        elif name.endswith("_reduction"):
            out[f"true_query_{name}"] = value
    return out


def errors_by_family(answers: DataFrame, n_real: int, n_syn: int) -> dict[str, dict[str, Any]]:
    found = metrics.before_and_after(answers, n_real, n_syn, ["family"]).collect()
    sizes = {r["family"]: r["count"] for r in answers.groupBy("family").count().collect()}
    return {r["family"]: {"num_queries": sizes[r["family"]], **true_query(r)} for r in sorted(found, key=lambda r: r["family"])}


def metrics_by_family(final: DataFrame, n_real: int, n_syn: int, with_truth: bool) -> dict[str, dict[str, Any]]:
    """M6: losses by family, and errors where they may be evaluated."""
    losses = metrics.by_family(final.drop("true_answer")).orderBy("family").collect()
    errors = errors_by_family(final, n_real, n_syn) if with_truth else {}
    return {
        r["family"]: {
            "num_queries": r["num_queries"],
            "initial_measured_loss": r["initial_loss"],
            "final_measured_loss": r["final_loss"],
            "measured_loss_reduction": r["loss_reduction"],
            **errors.get(r["family"], {}),
        }
        for r in losses
    }


def held_out_metrics(answers: DataFrame, n_real: int, n_syn: int) -> dict[str, Any]:
    by = errors_by_family(answers, n_real, n_syn)
    of = {f: v["num_queries"] for f, v in by.items()}
    return {"num_queries": sum(of.values()), "queries_by_family": of, **true_query(metrics.before_and_after(answers, n_real, n_syn).first())}
