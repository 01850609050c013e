"""Losses, errors and summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.operators.schema import TableSchema


def loss_column() -> Column:
    return 0.5 * F.col("residual") * F.col("residual") * F.col("inv_variance")


def measured_loss(state: DataFrame) -> DataFrame:
    return state.agg(F.coalesce(F.sum(loss_column()), F.lit(0.0)).alias("loss"))


def rms_standardized_residual(loss: float, m: int) -> float:
    return math.sqrt(max(0.0, 2 * loss / m)) if m > 0 else 0.0


def rms_column(loss: Column, m: Column) -> Column:
    return F.when(m <= 0, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 * loss / m)))


def errors(n_real: float, n_syn: float, true: str = "true_answer", syn: str = "answer", prefix: str = "") -> list[Column]:
    """Mean, root mean square and largest error of the rates, 0 for an empty workload."""
    e = F.abs(F.col(true) / float(n_real) - F.col(syn) / float(n_syn))
    zero = F.lit(0.0)
    return [F.coalesce(F.avg(e), zero).alias(prefix + "mae"), F.coalesce(F.sqrt(F.avg(e * e)), zero).alias(prefix + "rmse"), F.coalesce(F.max(e), zero).alias(prefix + "max_error")]


def query_errors(answers: DataFrame, n_real: float, n_syn: float) -> DataFrame:
    return answers.agg(*errors(n_real, n_syn))


def before_and_after(answers: DataFrame, n_real: float, n_syn: float, by: list[str] | None = None) -> DataFrame:
    """Errors of ``initial_answer`` and ``answer``, and how much they fell."""
    out = answers.groupBy(*(by or [])).agg(*errors(n_real, n_syn, syn="initial_answer", prefix="initial_"), *errors(n_real, n_syn, prefix="final_"))
    return out.withColumns({f"{m}_reduction": F.col(f"initial_{m}") - F.col(f"final_{m}") for m in ("mae", "rmse", "max_error")})


def by_family(state: DataFrame, n_real: float | None = None, n_syn: float | None = None) -> DataFrame:
    """(family, num_queries, initial_loss, final_loss, loss_reduction, and errors where true answers are at hand)."""
    first = 0.5 * F.col("initial_residual") * F.col("initial_residual") * F.col("inv_variance")
    aggs = [F.count(F.lit(1)).alias("num_queries"), F.sum(first).alias("initial_loss"), F.sum(loss_column()).alias("final_loss")]
    if "true_answer" in state.columns and n_real and n_syn:
        aggs += errors(n_real, n_syn)
    return state.groupBy("family").agg(*aggs).withColumn("loss_reduction", F.col("initial_loss") - F.col("final_loss"))


def workload_summary(queries: DataFrame, schema: TableSchema, max_queries: int = 10_000) -> DataFrame:
    """One row: queries by family, whether the cap was met, two-way pairs and cells possible and built."""
    k = schema.cardinalities
    pairs = [(a, b) for a in range(len(k)) for b in range(a + 1, len(k))]
    is2 = F.col("family") == "twoway"
    return queries.agg(
        F.count(F.lit(1)).alias("num_queries"),
        *[F.count_if(F.col("family") == f).alias(f"num_{f}") for f in ("oneway", "twoway", "prefix", "range", "mixed")],
        (F.count(F.lit(1)) >= max_queries).alias("max_queries_hit"),
        F.lit(len(pairs)).cast("long").alias("possible_2way_pairs"),
        F.count_distinct(F.when(is2, F.col("grp"))).alias("constructed_2way_pairs"),
        F.lit(sum(k[a] * k[b] for a, b in pairs)).cast("long").alias("possible_2way_cells"),
        F.count_if(is2).alias("constructed_2way_cells"),
    )
