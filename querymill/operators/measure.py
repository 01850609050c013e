"""Measuring a workload on the private table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.operators.answer import answer
from querymill.operators.privacy import allocate_budget, with_gaussian_noise, zcdp_epsilon
from querymill.operators.projection import project_targets


@dataclass(frozen=True)
class MeasureConfig:
    mode: str = "dp"
    measurement_mode: str = "static_all"
    rho_total: float = 1.0
    delta: float = 1e-9
    allocation: dict[str, float] | None = None
    oracle_variance: float = 1.0
    min_variance: float = 1e-6
    project_partitions: bool = True
    clip_nonpartition: bool = True
    salt: str = "0/noise"

    @property
    def epsilon(self) -> float | None:
        return zcdp_epsilon(self.rho_total, self.delta) if self.mode == "dp" else None


def measured_groups(groups: DataFrame, config: MeasureConfig) -> DataFrame:
    """``groups`` with rho, sigma and noise_std."""
    if config.mode == "dp":
        g = allocate_budget(groups, config.rho_total, config.allocation)
        g = g.withColumn("sigma", 1 / F.sqrt(2 * F.col("rho")))
        return g.withColumn("noise_std", F.col("sensitivity") * F.col("sigma"))
    zero = F.lit(0.0)
    return groups.withColumn("rho", zero).withColumn("sigma", zero).withColumn("noise_std", zero)


def measure_answers(answers: DataFrame, groups: DataFrame, total: float, config: MeasureConfig | None = None) -> DataFrame:
    """(qid, target_noisy, target_projected, variance, inv_variance) from true answers (qid, answer).

    A query of no group keeps target 0 and variance 1.
    """
    config = config or MeasureConfig()
    if config.mode not in ("dp", "oracle"):
        raise ValueError(f"unknown privacy mode {config.mode!r}")
    if config.measurement_mode != "static_all":
        raise NotImplementedError(f"measurement mode {config.measurement_mode!r}")
    g = measured_groups(groups, config)
    members = g.select("gid", "is_partition", "sensitivity", "rho", F.explode("qids").alias("qid")).join(answers, "qid")
    if config.mode == "dp":
        m = with_gaussian_noise(members, config.salt).withColumn("variance", F.greatest(F.col("noise_std") * F.col("noise_std"), F.lit(config.min_variance)))
    else:
        m = members.withColumn("noisy", F.col("answer").cast("double")).withColumn("variance", F.lit(max(config.oracle_variance, config.min_variance)))
    m = project_targets(m.select("gid", "qid", "noisy", "variance", "is_partition"), total, config.project_partitions, config.clip_nonpartition)
    m = answers.select("qid").join(m, "qid", "left")
    variance = F.coalesce("variance", F.lit(1.0))
    return m.select(
        "qid",
        F.coalesce("noisy", F.lit(0.0)).alias("target_noisy"),
        F.coalesce("projected", F.lit(0.0)).alias("target_projected"),
        variance.alias("variance"),
        (1 / variance).alias("inv_variance"),
    )


def measure(encoded: DataFrame, queries: DataFrame, groups: DataFrame, cardinalities: Sequence[int], total: int, config: MeasureConfig | None = None) -> DataFrame:
    """Answer, add noise, project; the number of rows is taken for public."""
    return measure_answers(answer(encoded, queries, cardinalities), groups, float(total), config)


def public_view(measurements: DataFrame) -> DataFrame:
    """What may leave: noisy and projected targets with their variance, never true answers."""
    return measurements.select("qid", "target_noisy", "target_projected", "variance")
