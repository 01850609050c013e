"""Command line: run a configuration, an ablation, or a smoke test.

    python -m querymill.cli run --config FILE [--key value ...]
    python -m querymill.cli ablation --config FILE --variant NAME [--key value ...]
    python -m querymill.cli smoke [--rows N]
"""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.functions import rand
from querymill.plans import engine
from querymill.sources import config as cfg

SMOKE = {
    "run": {"output_dir": "outputs/smoke", "seed": 0},
    "preprocess": {"id_column": "id", "numerical_bins": 8, "numerical_columns": ["c", "d"], "categorical_columns": ["a", "b", "label"], "label_column": "label"},
    "workload": {"max_queries": 300, "max_2way_cells": 200, "range_intervals": 8, "mixed_per_pair": 8},
    "privacy": {"mode": "dp", "rho_total": 1.0},
    "evolve": {"max_iters": 3, "total_candidates": 128, "accepted_per_iter": 16, "num_active": 16, "per_target": 16, "full_recompute_every": 1},
    "evaluation": {"heldout": True},
}


def smoke_table(spark: SparkSession, n: int = 1000) -> DataFrame:
    """A small table with dependent columns."""
    t = spark.range(n).select("id", rand.integer(0, 3, "smoke/a", "id").alias("a"), rand.integer(0, 4, "smoke/b", "id").alias("b"))
    t = t.withColumn("c", F.least(F.col("a") + rand.integer(0, 3, "smoke/c", "id"), F.lit(7))).withColumn("d", F.least(2 * F.col("b") + rand.integer(0, 2, "smoke/d", "id"), F.lit(7)))
    return t.withColumn("label", ((F.col("a") == 2) | (F.col("d") > 4)).cast("int"))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="querymill")
    p.add_argument("command", choices=("run", "ablation", "smoke", "env"))
    p.add_argument("--config")
    p.add_argument("--variant", default="full")
    p.add_argument("--rows", type=int, default=1000)
    known, rest = p.parse_known_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName("querymill").getOrCreate()
    if known.command == "env":
        print(json.dumps({"python": sys.version.split()[0], "spark": spark.version}))
        return 0
    config = cfg.load_yaml(known.config) if known.config else dict(SMOKE)
    config = cfg.apply_overrides(config, rest)
    if known.command == "ablation":
        config = engine.ablation(config, known.variant)
    table = smoke_table(spark, known.rows) if known.command == "smoke" or not known.config else None
    print(json.dumps(engine.run(spark, config, table), indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
