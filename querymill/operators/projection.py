"""Consistency of noisy counts: projection of partitions on a simplex, clipping of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def project_simplex(y: DataFrame, total: Column | float, by: str = "gid") -> DataFrame:
    """``y`` (by, qid, noisy) with ``projected``: each group's nearest point that is not negative and sums to ``total``.

    A group is a marginal, so its rows are at most its cells.
    """
    t = F.lit(float(total)) if isinstance(total, int | float) else total
    if isinstance(total, int | float) and total < 0:
        raise ValueError("the total must not be negative")
    w = Window.partitionBy(by).orderBy(F.desc("noisy"), "qid")
    r = y.withColumn("__k", F.row_number().over(w)).withColumn("__over", F.sum("noisy").over(w.rowsBetween(Window.unboundedPreceding, 0)) - t)
    everything = Window.partitionBy(by)
    last = F.coalesce(F.max(F.when(F.col("noisy") - F.col("__over") / F.col("__k") > 0, F.col("__k"))).over(everything), F.max("__k").over(everything))
    theta = F.max(F.when(F.col("__k") == F.col("__last"), F.col("__over") / F.col("__k"))).over(everything)
    return r.withColumn("__last", last).withColumn("__theta", theta).withColumn("projected", F.greatest(F.col("noisy") - F.col("__theta"), F.lit(0.0))).drop("__k", "__over", "__last", "__theta")


def clip_counts(noisy: Column, total: Column | float) -> Column:
    t = F.lit(float(total)) if isinstance(total, int | float) else total
    return F.greatest(F.lit(0.0), F.least(noisy, t))


def project_targets(noisy: DataFrame, total: float, project_partitions: bool = True, clip_nonpartition: bool = True) -> DataFrame:
    """(…, projected) of (gid, qid, noisy, is_partition): partitions go to the simplex, the others are clipped.

    With the first switch off, partitions are clipped like the others.
    """
    to_simplex = F.col("is_partition") & F.lit(project_partitions)
    p = project_simplex(noisy.where(to_simplex), total)
    rest = F.col("noisy") if not clip_nonpartition else clip_counts(F.col("noisy"), total)
    return p.unionByName(noisy.where(~to_simplex).withColumn("projected", rest))
