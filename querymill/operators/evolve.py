"""Query-directed edits of a synthetic table, and what they do to all answers.

A synthetic table is (row_id, codes); the state of the queries is (qid, target,
answer, residual, variance, inv_variance, sigma, debt); candidates are
(cand_id, row_id, old, new, target_qid, edit_cost, repair_type).  Everything is
drawn by hash, so an iteration gives the same result on any partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querymill.functions import rand
from querymill.functions.lineage import written
from querymill.operators.predicates import holds
from querymill.operators.schema import NUMERICAL, TableSchema

RANDOM, ENTER, EXIT = 0, 1, 2


# --- initial table ----------------------------------------------------------


def independent_codes(spark: SparkSession, n: int, marginals: DataFrame, schema: TableSchema, salt: str) -> DataFrame:
    """(row_id, codes): each column drawn from its marginal (attr, v, target), independently.

    Negative targets count as 0; a column whose targets are not complete, or
    sum to nothing, is drawn uniformly.  The running sums are one small row.
    """
    k = schema.frame(spark).select("attr", "cardinality")
    cells = k.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("cardinality") - 1))).join(marginals, ["attr", "v"], "left")
    g = cells.groupBy("attr", "cardinality").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("v", F.greatest("target", F.lit(0.0)).alias("w")))), lambda x: x["w"]).alias("w"), F.count("target").alias("n")
    )
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    even = F.transform(F.sequence(F.lit(1), F.col("cardinality")), lambda i: F.lit(1.0))
    g = g.withColumn("w", F.when((F.col("n") == F.col("cardinality")) & (total > 0), F.col("w")).otherwise(even))
    run = F.transform("w", lambda x, i: F.aggregate(F.slice("w", 1, i + 1), F.lit(0.0), lambda s, y: s + y))
    g = g.withColumn("run", run).withColumn("cdf", F.transform("run", lambda x: x / F.element_at("run", -1)))
    table = g.agg(F.transform(F.array_sort(F.collect_list(F.struct("attr", "cdf"))), lambda x: x["cdf"]).alias("cdfs"))
    # One row with a number for each code of each attribute.
    rows = spark.range(n).withColumnRenamed("id", "row_id").join(F.broadcast(table))
    codes = []
    for i, a in enumerate(schema.attributes):
        rows = rows.withColumn(f"__u{i}", rand.uniform(salt, "row_id", i))
        codes.append(F.least(F.size(F.expr(f"filter(cdfs[{i}], x -> x <= __u{i})")), F.lit(a.cardinality - 1)))
    return rows.select("row_id", F.array(*codes).alias("codes"))


def resolve_rows(value: int | str | None, n_real: int) -> int:
    return n_real if value in (None, "same_as_real") else int(value)


# --- schedule ---------------------------------------------------------------


def active_queries(state: DataFrame, k: int, kappa: float = 1.0, debt_alpha: float = 0.0, beta: float = 0.0) -> DataFrame:
    """The k queries (qid, priority, …) that need edits most.

    Priority is (abs(residual) - kappa * sigma) / sigma where that is positive,
    plus debt and importance; the others come last, as padding.  If no priority
    is positive, abs(residual) / sigma takes its place.  Ties go to the smaller
    qid.
    """
    s = F.greatest(F.col("sigma"), F.lit(1e-6))
    excess = (F.abs("residual") - kappa * s) / s
    extra = debt_alpha * F.col("debt") + (beta * F.col("importance") if "importance" in state.columns else F.lit(0.0))
    p = state.withColumn("__p", F.when(excess > 0, excess + extra))
    any_ = p.agg(F.count("__p").alias("__any"))
    p = p.join(F.broadcast(any_))  # one row
    p = p.withColumn("priority", F.when(F.col("__any") > 0, F.col("__p")).otherwise(F.abs("residual") / s))
    return p.orderBy(F.desc_nulls_last("priority"), "qid").limit(max(0, k)).drop("__p", "__any")


# --- candidates -------------------------------------------------------------


def sample_sources(syn: DataFrame, active: DataFrame, per_query: int, salt: str) -> DataFrame:
    """(qid, terms, repair_type, row_id, codes): for each active query rows that an edit can help.

    A query with too few rows (residual above 0) takes rows that it does not
    hold for, any other query rows that it holds for; without replacement, in
    an order drawn by hash.  Active queries are at most k, so they are
    broadcast; each task keeps at most ``per_query`` rows of a query.
    """
    a = active.select("qid", "terms", F.when(F.col("residual") > 0, ENTER).otherwise(EXIT).alias("repair_type"))
    met = syn.join(F.broadcast(a), holds("codes", "terms") == (F.col("repair_type") == EXIT))
    order = F.row_number().over(Window.partitionBy("qid").orderBy(rand.uniform(salt, "qid", "row_id"), "row_id"))
    return met.withColumn("place", order).where(F.col("place") <= per_query)


def _cards(cards: Sequence[int]) -> Column:
    return F.array(*map(F.lit, cards))


def with_enter(df: DataFrame, cards: Sequence[int], salt: str, *ids: str) -> DataFrame:
    """``df`` (codes, terms, …) with ``entered``: codes changed so that every term holds.

    EQ takes the value, the others a draw from their interval; a term that
    already holds is drawn again.
    """
    d = df
    for i, k in enumerate(cards):
        d = d.withColumn(f"__t{i}", F.expr(f"get(filter(terms, t -> t.attr = {i}), 0)")).withColumn(f"__u{i}", rand.uniform(salt, *ids, i))
        lo = f"case __t{i}.op when 1 then 0 when 2 then __t{i}.value else __t{i}.lo end"
        hi = f"case __t{i}.op when 1 then least(__t{i}.value, {k - 1}) when 2 then {k - 1} else __t{i}.hi end"
        d = d.withColumn(f"__lo{i}", F.expr(lo)).withColumn(f"__hi{i}", F.expr(hi))
    new = [f"case when __t{i} is null then codes[{i}] when __t{i}.op = 0 then greatest(0, least(__t{i}.value, {k - 1})) else greatest(0, least(__lo{i} + int(floor(__u{i} * (__hi{i} - __lo{i} + 1))), {k - 1})) end" for i, k in enumerate(cards)]
    return d.withColumn("entered", F.expr(f"array({', '.join(new)})")).drop(*[f"__{x}{i}" for i in range(len(cards)) for x in ("t", "u", "lo", "hi")])


def with_exit(df: DataFrame, cards: Sequence[int], salt: str, *ids: str, range_exit: str = "uniform") -> DataFrame:
    """``df`` (codes, terms, …) with ``left``: codes with one breakable term broken.

    EQ takes another value, the others one outside their interval;
    ``range_exit="nearest"`` steps just outside a range.  If no term can be
    broken, a random attribute changes.  What is drawn stands in columns of its
    own, so the plan evaluates it once.
    """
    k = _cards(cards)

    def top(t: Column) -> Column:
        return F.get(k, t["attr"]) - 1

    def breakable(t: Column) -> Column:
        wide = (t["lo"] > 0) | (t["hi"] < top(t))
        return F.when(t["op"] == 0, top(t) > 0).when(t["op"] == 1, t["value"] < top(t)).when(t["op"] == 2, t["value"] > 0).otherwise(wide)

    d = df.withColumn("__open", F.filter("terms", breakable)).withColumn("__u", rand.uniform(salt + "/term", *ids))
    d = d.withColumn("__pick", F.get("__open", F.floor(F.col("__u") * F.size("__open")).cast("int"))).withColumn("__w", rand.uniform(salt + "/value", *ids))
    pick = F.col("__pick")
    d = d.withColumn("__last", top(pick))
    last, below = F.col("__last"), F.greatest(pick["lo"], F.lit(0))
    above = F.greatest(last - pick["hi"], F.lit(0))
    # How many values lie outside the term, and which of them is drawn.
    room = F.when(pick["op"] == 0, last).when(pick["op"] == 1, last - pick["value"]).when(pick["op"] == 2, pick["value"]).otherwise(below + above)
    d = d.withColumn("__draw", F.floor(F.col("__w") * room).cast("int"))
    draw = F.col("__draw")
    outside = F.when(draw < below, draw).otherwise(pick["hi"] + 1 + draw - below)
    if range_exit == "nearest":
        outside = F.when(pick["lo"] > 0, pick["lo"] - 1).otherwise(pick["hi"] + 1)
    new = F.when(pick["op"] == 0, draw + (draw >= pick["value"]).cast("int")).when(pick["op"] == 1, pick["value"] + 1 + draw).when(pick["op"] == 2, draw).otherwise(outside)
    d = d.withColumn("__new", F.greatest(F.lit(0), F.least(new, last)))
    d = with_mutation(d, cards, salt + "/random", *ids)
    broken = F.expr("transform(codes, (c, i) -> if(i = __pick.attr, __new, c))")
    return d.withColumn("left", F.when(pick.isNull(), F.col("mutated")).otherwise(broken)).drop("__open", "__u", "__pick", "__w", "__last", "__draw", "__new", "mutated")


def with_mutation(df: DataFrame, cards: Sequence[int], salt: str, *ids: str) -> DataFrame:
    """``df`` with ``mutated``: codes with one attribute changed to another value of its domain, if any has more than one."""
    free = [i for i, c in enumerate(cards) if c > 1]
    if not free:
        return df.withColumn("mutated", F.col("codes"))
    attr = F.get(F.array(*map(F.lit, free)), F.floor(rand.uniform(salt + "/attr", *ids) * len(free)).cast("int"))
    d = df.withColumn("__attr", attr)
    d = d.withColumn("__value", rand.integer(0, F.get(_cards(cards), F.col("__attr")) - 2, salt + "/value", *ids))
    return d.withColumn("mutated", F.expr("transform(codes, (c, i) -> if(i = __attr, __value + int(__value >= c), c))")).drop("__attr", "__value")


def edit_cost(old: str, new: str, schema: TableSchema, gamma: float = 0.1) -> Column:
    """Changed attributes, and gamma times the distance of numeric codes relative to their domain."""
    weight = F.array(*[F.lit(gamma / max(1, a.cardinality - 1) if a.kind == NUMERICAL else 0.0) for a in schema.attributes])
    parts = F.zip_with(F.zip_with(F.col(old), F.col(new), lambda a, b: F.abs(a - b)), weight, lambda x, w: (x > 0).cast("double") + w * x)
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def candidates(
    syn: DataFrame,
    active: DataFrame,
    schema: TableSchema,
    total: int,
    salt: str,
    random_fraction: float = 0.05,
    per_target: int = 64,
    gamma: float = 0.1,
    random_only: bool = False,
    range_exit: str = "uniform",
) -> DataFrame:
    """Proposed edits: directed ones in the order of the active queries, and random ones for the rest.

    Edits that change nothing go; what the directed part lacks is filled up with
    random edits.
    """
    cards = schema.cardinalities
    n_random = total if random_only else int(round(total * random_fraction))
    order = ["target_qid", "place", "row_id"]
    if not random_only:
        s = sample_sources(syn, active, per_target, salt + "/rows")
        # The drawn columns are written: the filter below would else be expanded into all that leads to them.
        s = written(with_enter(s, cards, salt + "/enter", "qid", "row_id"))
        s = written(with_exit(s, cards, salt + "/exit", "qid", "row_id", range_exit=range_exit))
        new = F.when(F.col("repair_type") == ENTER, F.col("entered")).otherwise(F.col("left"))
        d = s.select("row_id", F.col("codes").alias("old"), new.alias("new"), F.col("qid").alias("target_qid"), "repair_type", "place").where("old <> new")
        d = d.join(F.broadcast(active.select(F.col("qid").alias("target_qid"), "priority")), "target_qid")
        d = d.orderBy(F.desc_nulls_last("priority"), *order).limit(total - n_random).drop("priority")
    draw = rand.uniform(salt + "/pick", "row_id")
    r = syn.orderBy(draw, "row_id").limit(total)
    r = with_mutation(r, cards, salt + "/mutate", "row_id")
    r = r.select("row_id", F.col("codes").alias("old"), F.col("mutated").alias("new"), F.lit(-1).alias("target_qid"), F.lit(RANDOM).alias("repair_type"), draw.alias("place"))
    r = r.where("old <> new")
    every = r.withColumn("part", F.lit(1)) if random_only else d.withColumn("place", F.col("place").cast("double")).withColumn("part", F.lit(0)).unionByName(r.withColumn("part", F.lit(1)))
    # At most 2 * total rows, a parameter: their order may pass through one task.
    number = F.row_number().over(Window.orderBy("part", *order)) - 1
    every = every.withColumn("cand_id", number.cast("long")).where(F.col("cand_id") < total)
    return every.select("cand_id", "row_id", "old", "new", "target_qid", edit_cost("old", "new", schema, gamma).alias("edit_cost"), "repair_type")


# --- deltas and scores --------------------------------------------------------


def deltas(cands: DataFrame, queries: DataFrame) -> DataFrame:
    """(cand_id, qid, delta): what each edit adds to each query's count, zeros left out.

    Only queries over a changed attribute can change: candidates meet the
    catalogue through an index of attributes, and each pair once, at the first
    changed attribute of the query.
    """
    changed = F.filter(F.transform(F.arrays_zip("old", "new"), lambda x, i: F.when(x["old"] != x["new"], i)), lambda i: i.isNotNull())
    c = cands.select("cand_id", "old", "new", changed.alias("changed")).withColumn("attr", F.explode("changed"))
    index = queries.select("qid", "terms", F.array_distinct(F.transform("terms", lambda t: t["attr"])).alias("attrs")).withColumn("attr", F.explode("attrs"))
    met = c.join(F.broadcast(index), "attr")  # the catalogue is bounded by max_queries
    met = met.where(F.col("attr") == F.array_min(F.array_intersect("attrs", "changed")))
    d = met.withColumn("delta", holds("new", "terms").cast("int") - holds("old", "terms").cast("int"))
    return d.where("delta <> 0").select("cand_id", "qid", F.col("delta").cast("tinyint").alias("delta"))


def score_dense(cands: DataFrame, delta: DataFrame, state: DataFrame, lambda_cost: float = 0.01) -> DataFrame:
    """``cands`` with ``advantage``: the fall in loss of each edit alone, less its cost."""
    d = delta.join(state.select("qid", "residual", "inv_variance"), "qid")
    x = F.col("delta").cast("double")
    g = d.groupBy("cand_id").agg(F.sum(x * F.col("residual") * F.col("inv_variance") - 0.5 * x * x * F.col("inv_variance")).alias("__gain"))
    return cands.join(g, "cand_id", "left").withColumn("advantage", F.coalesce("__gain", F.lit(0.0)) - lambda_cost * F.col("edit_cost")).drop("__gain")


def score_target_only(cands: DataFrame, queries: DataFrame, state: DataFrame, lambda_cost: float = 0.01) -> DataFrame:
    """``cands`` with the advantage by their own target query; random edits only cost."""
    q = queries.select(F.col("qid").alias("target_qid"), "terms").join(state.select(F.col("qid").alias("target_qid"), "residual", "inv_variance"), "target_qid")
    c = cands.join(F.broadcast(q), "target_qid", "left")
    x = (holds("new", "terms").cast("int") - holds("old", "terms").cast("int")).cast("double")
    gain = F.when(F.col("terms").isNull(), 0.0).otherwise(x * F.col("residual") * F.col("inv_variance") - 0.5 * x * x * F.col("inv_variance"))
    return c.withColumn("advantage", gain - lambda_cost * F.col("edit_cost")).select(*cands.columns, "advantage")


def top_scored(scored: DataFrame, k: int) -> DataFrame:
    """The k best candidates; ties go to the smaller cand_id.  Each partition keeps k at most before they merge."""
    return scored.orderBy(F.desc("advantage"), "cand_id").limit(max(0, k))


# --- selection and transport ----------------------------------------------------


def select_nonconflicting(scored: DataFrame, k: int, min_advantage: float = 1e-6) -> DataFrame:
    """The best edit of each row, and of those the k best, with ``rank`` from 1."""
    s = scored.where((F.col("advantage") > min_advantage) & ~F.isnan("advantage") & (F.col("advantage") < float("inf")))
    best = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("advantage"), "cand_id"))
    s = s.withColumn("__r", best).where("__r = 1").drop("__r").orderBy(F.desc("advantage"), "cand_id").limit(k)
    # At most k rows, a parameter.
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("advantage"), "cand_id")))


def batch_advantage(selected: DataFrame, delta: DataFrame, state: DataFrame, lambda_cost: float = 0.01) -> DataFrame:
    """One row (advantage): the fall in loss of all edits together, their interaction included."""
    d = delta.join(selected.select("cand_id"), "cand_id").groupBy("qid").agg(F.sum("delta").cast("double").alias("x"))
    gain = d.join(state, "qid").agg(F.coalesce(F.sum(F.col("x") * F.col("residual") * F.col("inv_variance") - 0.5 * F.col("x") * F.col("x") * F.col("inv_variance")), F.lit(0.0)).alias("gain"))
    cost = selected.agg(F.coalesce(F.sum("edit_cost"), F.lit(0.0)).alias("cost"))
    return gain.join(F.broadcast(cost)).select((F.col("gain") - lambda_cost * F.col("cost")).alias("advantage"))


def prefix_advantages(selected: DataFrame, delta: DataFrame, state: DataFrame, lambda_cost: float = 0.01) -> DataFrame:
    """(rank, cand_id, prefix_advantage) of the edits 1..rank together, from nonzero deltas only.

    The gain of one more edit is its own, less the interaction with the running
    sum of each query that it touches.
    """
    d = delta.join(selected.select("cand_id", "rank"), "cand_id").join(state.select("qid", "residual", "inv_variance"), "qid")
    before = F.coalesce(F.sum("delta").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    x = F.col("delta").cast("double")
    d = d.withColumn("__before", before)
    gain = d.groupBy("cand_id").agg(F.sum(F.col("inv_variance") * (x * F.col("residual") - F.col("__before") * x - 0.5 * x * x)).alias("gain"))
    s = selected.join(gain, "cand_id", "left").withColumn("step", F.coalesce("gain", F.lit(0.0)) - lambda_cost * F.col("edit_cost"))
    run = F.sum("step").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return s.select("rank", "cand_id", run.alias("prefix_advantage"))


def choose_prefix(selected: DataFrame, delta: DataFrame, state: DataFrame, lambda_cost: float = 0.01, strategy: str = "largest_positive") -> DataFrame:
    """The accepted edits: a prefix of ``selected`` by rank, with ``batch_advantage``.

    ``largest_positive`` takes the longest prefix with a positive advantage,
    ``best_advantage`` the best one if that is positive.
    """
    p = prefix_advantages(selected, delta, state, lambda_cost)
    positive = p.where("prefix_advantage > 0")
    if strategy == "largest_positive":
        order = F.struct(F.col("rank"))
    elif strategy == "best_advantage":
        order = F.struct(F.col("prefix_advantage"), -F.col("rank"))
    else:
        raise ValueError(f"unknown prefix strategy {strategy!r}")
    cut = positive.agg(F.max_by(F.struct(F.col("rank").alias("__upto"), F.col("prefix_advantage").alias("batch_advantage")), order).alias("cut")).select("cut.*")
    return selected.join(F.broadcast(cut)).where(F.col("rank") <= F.col("__upto")).drop("__upto")


def apply_edits(syn: DataFrame, accepted: DataFrame) -> DataFrame:
    """The table with the rows of accepted edits replaced; those are at most ``accepted_per_iter``."""
    e = accepted.select(F.col("row_id").alias("__row"), "new")
    return syn.join(F.broadcast(e), F.col("row_id") == F.col("__row"), "left").select("row_id", F.coalesce("new", "codes").alias("codes"))


def apply_deltas(state: DataFrame, accepted: DataFrame, delta: DataFrame) -> DataFrame:
    """The state of the queries after the accepted edits, without counting anything again."""
    own = [c for c in state.columns]
    s = delta.join(F.broadcast(accepted.select("cand_id")), "cand_id").groupBy("qid").agg(F.sum("delta").alias("__sum"))
    moved = state.join(s, "qid", "left").withColumn("answer", F.col("answer") + F.coalesce("__sum", F.lit(0)))
    return moved.withColumn("residual", F.col("target") - F.col("answer")).select(*own)


def drift(state: DataFrame, recount: DataFrame) -> DataFrame:
    """One row (max_drift): how far maintained answers are from counted ones."""
    r = recount.select("qid", F.col("answer").alias("__counted"))
    return state.join(r, "qid").agg(F.coalesce(F.max(F.abs(F.col("answer") - F.col("__counted"))), F.lit(0)).alias("max_drift"))
