"""Zero-concentrated differential privacy: accounting, noise, selection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.functions import rand


def zcdp_epsilon(rho: float, delta: float) -> float:
    """The epsilon of (epsilon, delta)-privacy that rho-zCDP implies."""
    if rho <= 0:
        return 0.0
    if not 0 < delta < 1:
        raise ValueError("delta must lie between 0 and 1")
    return rho + 2 * math.sqrt(rho * math.log(1 / delta))


def sigma_from_rho(rho: float) -> float:
    if rho <= 0:
        raise ValueError("rho must be positive")
    return 1 / math.sqrt(2 * rho)


def zcdp_epsilon_column(rho: Column, delta: Column) -> Column:
    return F.when(rho <= 0, 0.0).otherwise(rho + 2 * F.sqrt(rho * F.ln(1 / delta)))


def with_gaussian_noise(answers: DataFrame, salt: str) -> DataFrame:
    """``answers`` (…, qid, answer, rho, sensitivity) with sigma, noise_std and noisy.

    The salt must be secret and unpredictable in a release.
    """
    sigma = 1 / F.sqrt(2 * F.col("rho"))
    a = answers.withColumn("sigma", sigma).withColumn("noise_std", F.col("sensitivity") * F.col("sigma"))
    return a.withColumn("noisy", F.col("answer") + F.col("noise_std") * rand.gaussian(salt, "qid"))


def exponential_mechanism(scores: DataFrame, epsilon: float, sensitivity: float, salt: str, by: list[str] | None = None) -> DataFrame:
    """One (id, score) of each group, with odds exp(epsilon * score / (2 * sensitivity)): Gumbel noise and a maximum, in one pass."""
    if sensitivity <= 0:
        raise ValueError("sensitivity must be positive")
    by = by or []
    keyed = scores.withColumn("__key", epsilon * F.col("score") / (2 * sensitivity) + rand.gumbel(salt, *by, "id"))
    best = F.max_by(F.struct("id", "score"), F.struct("__key", -F.col("id"))).alias("best")
    return keyed.groupBy(*by).agg(best).select(*by, "best.id", "best.score")


def allocate_budget(groups: DataFrame, rho_total: float, weights: dict[str, float] | None = None) -> DataFrame:
    """``groups`` (gid, family, …) with their share ``rho`` of the total.

    Weights are normalised over the families that are listed (all of the
    workload, if none is), so the share of a listed family that the workload
    lacks is not spent.  A family without a positive weight gets a millionth.
    """
    in_family = F.count(F.lit(1)).over(Window.partitionBy("family"))
    if weights:
        total = sum(max(w, 0.0) for w in weights.values())
        if total <= 0:
            raise ValueError("the weights of the families add up to nothing")
        table = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w) / total))])
        share = F.coalesce(F.try_element_at(table, F.col("family")), F.lit(0.0))
    else:
        families = groups.select("family").distinct().agg(F.count(F.lit(1)).alias("__families"))
        groups = groups.join(F.broadcast(families))  # one row
        share = 1.0 / F.col("__families")
    per_family = F.when(share > 0, rho_total * share).otherwise(rho_total * 1e-6 / in_family)
    return groups.withColumn("rho", per_family / in_family).drop("__families")
