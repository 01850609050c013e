"""Workload generators: families of counting queries over a schema.

Queries are rows made by joins and explodes over the attribute table.  What is
chosen at random is drawn by hash from the seed, so a family does not depend on
the others or on partitions.  Two-way pairs are admitted one after another with
skips, on the driver: there are d * (d - 1) / 2 of them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querymill.functions import rand
from querymill.operators import catalogue
from querymill.operators.predicates import EQ, LE, RANGE, TERM
from querymill.operators.schema import CATEGORICAL, NUMERICAL, TableSchema

FAMILIES = ("oneway", "twoway", "prefix", "range", "mixed")


@dataclass(frozen=True)
class WorkloadConfig:
    max_terms: int = 4
    max_queries: int = 10_000
    max_2way_cells: int = 5000
    range_intervals: int = 64
    mixed_per_pair: int = 64
    seed: int = 0
    families: tuple[str, ...] = FAMILIES
    #: Whether a two-way group that the cap cuts short still counts as a partition.
    truncated_is_partition: bool = False


def term(attr: Column, op: int, value: Column | int = 0, lo: Column | int = 0, hi: Column | int = 0) -> Column:
    parts = [attr, F.lit(op), *(F.lit(x) if isinstance(x, int) else x for x in (value, lo, hi))]
    return F.struct(*[p.cast("int").alias(n) for p, n in zip(parts, ("attr", "op", "value", "lo", "hi"))]).cast(TERM)


def _names(a: str = "attr") -> Column:
    return F.concat(F.lit("c"), F.col(a).cast("string"))


def _values(attrs: DataFrame, column: str = "v", cardinality: str = "cardinality") -> DataFrame:
    return attrs.withColumn(column, F.explode(F.sequence(F.lit(0), F.col(cardinality) - 1)))


def oneway(attrs: DataFrame) -> DataFrame:
    """Each value of each attribute."""
    q = _values(attrs)
    return q.select(
        F.concat(_names(), F.lit("="), F.col("v").cast("string")).alias("name"),
        F.concat(F.lit("oneway:"), F.col("attr").cast("string")).alias("grp"),
        F.lit("oneway").alias("family"),
        F.array(term(F.col("attr"), EQ, F.col("v"))).alias("terms"),
        F.array(F.lit(1), F.col("attr"), F.col("v")).alias("seq"),
    )


def admitted_pairs(cardinalities: list[int], max_cells: int, seed: int) -> list[tuple[int, int, int]]:
    """(place, a, b): pairs in a shuffled order; one whose cells do not fit beside those before is skipped."""
    pairs = [(a, b) for a in range(len(cardinalities)) for b in range(a + 1, len(cardinalities))]
    pairs.sort(key=lambda p: hashlib.md5(f"{seed}/pairs:{p[0]}:{p[1]}".encode()).hexdigest())
    used, out = 0, []
    for a, b in pairs:
        cells = cardinalities[a] * cardinalities[b]
        if used + cells <= max_cells:
            used += cells
            out.append((len(out), a, b))
    return out


def twoway(spark: SparkSession, schema: TableSchema, config: WorkloadConfig) -> DataFrame:
    """All cells of the admitted pairs."""
    k = schema.cardinalities
    rows = [(p, a, b, k[a], k[b]) for p, a, b in admitted_pairs(k, config.max_2way_cells, config.seed)]
    pairs = spark.createDataFrame(rows, "place int, a int, b int, ka int, kb int")
    q = _values(_values(pairs, "va", "ka"), "vb", "kb")
    return q.select(
        F.concat(_names("a"), F.lit("="), F.col("va").cast("string"), F.lit("&"), _names("b"), F.lit("="), F.col("vb").cast("string")).alias("name"),
        F.concat(F.lit("twoway:"), F.col("a").cast("string"), F.lit(":"), F.col("b").cast("string")).alias("grp"),
        F.lit("twoway").alias("family"),
        F.array(term(F.col("a"), EQ, F.col("va")), term(F.col("b"), EQ, F.col("vb"))).alias("terms"),
        F.array(F.lit(2), F.col("place"), F.col("va"), F.col("vb")).alias("seq"),
    )


def prefix(attrs: DataFrame) -> DataFrame:
    """Each threshold of each numeric attribute."""
    q = _values(attrs.where(F.col("kind") == NUMERICAL))
    return q.select(
        F.concat(_names(), F.lit("<="), F.col("v").cast("string")).alias("name"),
        F.concat(F.lit("prefix:"), F.col("attr").cast("string")).alias("grp"),
        F.lit("prefix").alias("family"),
        F.array(term(F.col("attr"), LE, F.col("v"))).alias("terms"),
        F.array(F.lit(3), F.col("attr"), F.col("v")).alias("seq"),
    )


def ranges(attrs: DataFrame, limit: int, seed: int) -> DataFrame:
    """All intervals of each numeric attribute, or ``limit`` of them without replacement."""
    q = _values(attrs.where(F.col("kind") == NUMERICAL), "lo").withColumn("hi", F.explode(F.expr("sequence(lo, cardinality - 1)")))
    draw = F.md5(F.concat_ws(":", F.lit(f"{seed}/range"), *[F.col(c).cast("string") for c in ("attr", "lo", "hi")]))
    q = q.withColumn("r", F.row_number().over(Window.partitionBy("attr").orderBy(draw))).where(F.col("r") <= limit)
    return q.select(
        F.concat(_names(), F.lit(" in ["), F.col("lo").cast("string"), F.lit(","), F.col("hi").cast("string"), F.lit("]")).alias("name"),
        F.concat(F.lit("range:"), F.col("attr").cast("string")).alias("grp"),
        F.lit("range").alias("family"),
        F.array(term(F.col("attr"), RANGE, 0, F.col("lo"), F.col("hi"))).alias("terms"),
        F.array(F.lit(4), F.col("attr"), F.col("lo"), F.col("hi")).alias("seq"),
    )


def mixed(attrs: DataFrame, per_pair: int, seed: int) -> DataFrame:
    """For each categorical and numeric attribute a value of one and a prefix or an interval of the other, drawn."""
    cat = attrs.where(F.col("kind") == CATEGORICAL).select(F.col("attr").alias("a"), F.col("cardinality").alias("ka"))
    num = attrs.where(F.col("kind") == NUMERICAL).select(F.col("attr").alias("b"), F.col("cardinality").alias("kb"))
    # Attributes are few: this product has at most d * d / 4 rows.
    q = cat.join(num, F.lit(True)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(per_pair - 1)))) if per_pair > 0 else cat.join(num, F.lit(False)).withColumn("j", F.lit(0))
    ids = ("a", "b", "j")
    q = q.withColumn("va", rand.integer(0, F.col("ka") - 1, f"{seed}/mixed/v", *ids))
    q = q.withColumn("is_prefix", rand.uniform(f"{seed}/mixed/kind", *ids) < 0.5)
    q = q.withColumn("lo", rand.integer(0, F.col("kb") - 1, f"{seed}/mixed/lo", *ids))
    q = q.withColumn("hi", rand.integer(F.col("lo"), F.col("kb") - 1, f"{seed}/mixed/hi", *ids))
    second = F.when(F.col("is_prefix"), term(F.col("b"), LE, F.col("lo"))).otherwise(term(F.col("b"), RANGE, 0, F.col("lo"), F.col("hi")))
    what = F.when(F.col("is_prefix"), F.concat(F.lit("<="), F.col("lo").cast("string"))).otherwise(F.concat(F.lit(" in ["), F.col("lo").cast("string"), F.lit(","), F.col("hi").cast("string"), F.lit("]")))
    return q.select(
        F.concat(_names("a"), F.lit("="), F.col("va").cast("string"), F.lit("&"), _names("b"), what).alias("name"),
        F.concat(F.lit("mixed:"), F.col("a").cast("string"), F.lit(":"), F.col("b").cast("string")).alias("grp"),
        F.lit("mixed").alias("family"),
        F.array(term(F.col("a"), EQ, F.col("va")), second).alias("terms"),
        F.array(F.lit(5), F.col("a"), F.col("b"), F.col("j")).alias("seq"),
    )


def build(spark: SparkSession, schema: TableSchema, config: WorkloadConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """The queries (qid, name, grp, family, terms) and groups (gid, name, family, qids, sensitivity, is_partition)."""
    config = config or WorkloadConfig()
    attrs = schema.frame(spark)
    made = {
        "oneway": lambda: oneway(attrs),
        "twoway": lambda: twoway(spark, schema, config),
        "prefix": lambda: prefix(attrs),
        "range": lambda: ranges(attrs, config.range_intervals, config.seed),
        "mixed": lambda: mixed(attrs, config.mixed_per_pair, config.seed),
    }
    parts = [made[f]() for f in FAMILIES if f in config.families]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    queries = catalogue.dedup(every, "seq", config.max_terms).where(F.col("qid") < config.max_queries).drop("seq")
    return queries, groups_of(queries, schema, config)


def groups_of(queries: DataFrame, schema: TableSchema, config: WorkloadConfig | None = None) -> DataFrame:
    """Measurement groups: marginals are partitions with sensitivity 1, others have the root of their size.

    A marginal that the cap cut short is no partition, unless asked for.
    """
    config = config or WorkloadConfig()
    g = queries.groupBy("grp", "family").agg(F.min("qid").alias("first"), F.array_sort(F.collect_list("qid")).alias("qids"), F.first("terms").alias("t"))
    k = F.array(*map(F.lit, schema.cardinalities)) if schema.d else F.array(F.lit(0))
    full = F.size("qids") == F.aggregate("t", F.lit(1), lambda s, t: s * F.get(k, t["attr"]))
    marginal = F.col("family").isin("oneway", "twoway")
    whole = marginal & (full | F.lit(config.truncated_is_partition))
    gid = (F.row_number().over(Window.orderBy("first")) - 1).cast("int")
    return g.select(
        gid.alias("gid"),
        F.col("grp").alias("name"),
        "family",
        "qids",
        F.when(marginal, 1.0).otherwise(F.sqrt(F.size("qids").cast("double"))).alias("sensitivity"),
        whole.alias("is_partition"),
    )
