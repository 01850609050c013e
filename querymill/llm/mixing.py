"""Mixing sources to target weights by weighted fair queueing.

Every document stands in its source's line in a shuffled order, up to three
times over.  Its virtual finish time is the source's cumulative tokens divided
by the source's target; all lines are range-sorted by it and cut at the budget.
The document at the cut stays if at least half of it lies within.

Cumulative sums have two levels: sums of buckets first, then rows within one
bucket, so neither a hot source nor the whole table meets in one task.

Defined cases: a null text has size 0, and nothing is taken of it; a null
source is a source of its own, ordered last; repeated rows are taken alike;
equal shuffle keys are ordered by doc_id, size and a hash of the text; a very
long text is one document, taken whole or not at all; an empty table gives an
empty result; further columns are kept, whatever their names, and those named
like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.llm.session import private, stable

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Buckets of a source's line (hex digits of the shuffle key) and of a unit of virtual time.
LINE_DIGITS = 3
TIME_BUCKETS = 65_536
SALT = "mix"


def source_targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sums`` (source, source_size; a row for each source) with ``target``.

    Weights go round the sources in code point order.  The total is shared by
    weight; a target stops at ``most`` times its source's size, and what is
    over is shared again.  In the order of size for weight the sources that
    stop come first, so one running sum finds how many they are.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sums.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    by_fill = Window.orderBy((F.col("cap").cast("double") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    # The first source that its share does not fill above its stop; from there on all have shares of the same rest.
    s = s.withColumn("free", F.col("w").cast("double") * F.col("left") <= F.col("cap").cast("double") * F.col("w_left"))
    s = s.withColumn("is_free", F.max(F.col("free")).over(by_fill.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(F.col("is_free"), F.struct(F.col("cap").cast("double") / F.col("w"), -F.col("left"), F.col("left"), F.col("w_left")))).over(everything)
    s = s.withColumn("at", first)
    share = (F.col("w") * F.col("at")["left"]).cast("double") / F.col("at")["w_left"]
    return s.select("source", "source_size", F.when(F.col("is_free"), share).otherwise(F.col("cap").cast("double")).alias("target"))


MADE = ("size", "source_size", "target", "taken", "copies")


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", salt: str = SALT) -> DataFrame:
    """``docs`` with size, source_size, target, taken (words, repeats counted) and copies (times taken).

    The plan works on a few numbers for each document; texts are moved once, to
    meet the result, and only if columns besides the id are asked for.
    """
    text_hash = F.xxhash64(text_col)
    docs = docs.drop(*MADE)  # in any case of their letters
    own = docs.columns
    plan = mix_plan(docs, text_col, id_col, source_col, salt)
    mine = private(docs, "id", "source", "text")
    keys = list(zip((F.col(id_col), F.col(source_col), text_hash), mine))
    plan = plan.select(F.col(id_col).alias(mine[0]), F.col("source").alias(mine[1]), F.col("text_hash").alias(mine[2]), *MADE)
    joined = docs.select(*own).join(plan, [a.eqNullSafe(F.col(b)) for a, b in keys])
    return joined.select(*own, *MADE)


def mix_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", salt: str = SALT) -> DataFrame:
    """A row (id, and what ``mix`` adds) for each document, without its other columns."""
    plan = mix_plan(docs, text_col, id_col, source_col, salt)
    return plan.select(id_col, *MADE, F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("__row")).drop("__row")


def mix_plan(docs: DataFrame, text_col: str, id_col: str, source_col: str, salt: str) -> DataFrame:
    """(id, source, text_hash, rows, and what ``mix`` adds): one for each distinct row."""
    made, own = MADE, [id_col, "source", "text_hash", "rows"]
    d = docs.select(F.col(id_col), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    d = d.groupBy(id_col, "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("rows"))
    # Repeated rows stand in line as one, with the words of all.
    d = d.withColumn("one", F.col("size")).withColumn("size", F.col("size") * F.col("rows"))
    d = d.withColumn("__key", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source"))))
    d = d.withColumn("__h", F.md5(F.concat(F.lit(salt + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
    d = stable(d.withColumn("__line", F.substring("__h", 1, LINE_DIGITS)))

    parts = d.groupBy("__key", "__line").agg(F.sum("size").alias("part"), F.first("source").alias("source"))
    sums = parts.groupBy("__key").agg(F.first("source").alias("source"), F.sum("part").alias("source_size"))
    targets = source_targets(sums)
    before = Window.partitionBy("__key").orderBy("__line").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("part").over(before), F.lit(0)))
    targets = targets.withColumn("__k", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source")))).drop("source")
    parts = parts.drop("source").join(targets, F.col("__key") == F.col("__k")).select(F.col("__key").alias("__k"), F.col("__line").alias("__l"), "__before", "source_size", "target")

    row = Window.partitionBy("__key", "__line").orderBy("__h", F.col(id_col).asc_nulls_first(), "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__c", F.sum("size").over(row)).join(parts, (F.col("__key") == F.col("__k")) & (F.col("__line") == F.col("__l")))
    d = stable(d.withColumn("__c", F.col("__c") + F.col("__before")).drop("__k", "__l", "__before", "__line"))

    order = ["__v", "__key", "__h", id_col, "size", "text_hash", "__e"]
    copies = F.array(*[F.struct(F.lit(e).alias("__e"), ((F.lit(e) * F.col("source_size") + F.col("__c")).cast("double") / F.col("target")).alias("__v")) for e in range(MOST_COPIES)])
    line = d.where("size > 0 AND target > 0").select("__key", "__h", id_col, "size", "text_hash", F.explode(copies).alias("__x"))
    line = line.select("__key", "__h", id_col, "size", "text_hash", "__x.__e", "__x.__v").where("__v <= 4").withColumn("__b", F.floor(F.col("__v") * TIME_BUCKETS))
    budget = d.agg(F.sum("size").alias("budget"))
    times = line.groupBy("__b").agg(F.sum("size").alias("n"))
    run = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    # At most 4 * TIME_BUCKETS rows, whatever the input.
    at = times.withColumn("upto", F.sum("n").over(run)).join(F.broadcast(budget)).withColumn("done", F.col("upto") <= F.col("budget"))
    # The bucket in which the budget ends: the first that goes beyond it, else the last.
    at = at.orderBy("done", F.when(~F.col("done"), F.col("__b")), F.col("__b").desc()).limit(1).select(F.col("__b").alias("__at"), (F.col("upto") - F.col("n")).alias("__from"), "budget")
    last = line.join(F.broadcast(at), F.col("__b") == F.col("__at"))
    cum = F.col("__from") + F.sum("size").over(Window.orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0))
    cut = last.withColumn("__cum", cum).withColumn("__in", F.col("__cum") - F.col("size") / 2 <= F.col("budget"))
    # The last document that stays, or else the place just before the bucket.
    cut = cut.agg(F.max(F.when(F.col("__in"), F.struct(*order))).alias("__cut"), F.max("__at").alias("__at"))
    d = d.join(F.broadcast(cut), how="left")

    def taken(e: int):
        v = (F.lit(e) * F.col("source_size") + F.col("__c")).cast("double") / F.col("target")
        here = F.struct(v.alias("__v"), "__key", "__h", id_col, "size", "text_hash", F.lit(e).alias("__e"))
        early = F.floor(v * TIME_BUCKETS) < F.col("__at")
        same = (F.floor(v * TIME_BUCKETS) == F.col("__at")) & F.coalesce(here <= F.col("__cut"), F.lit(False))
        return (early | same).cast("long")

    counts = F.when((F.col("size") > 0) & (F.col("target") > 0), sum((taken(e) for e in range(1, MOST_COPIES)), taken(0))).otherwise(0)
    d = d.withColumn("copies", F.coalesce(counts, F.lit(0)).cast("long")).withColumn("size", F.col("one")).withColumn("taken", F.col("copies") * F.col("size"))
    return d.select(*own, *made)


def repeat_taken(mixed: DataFrame, columns: list[str] | list[Column]) -> DataFrame:
    """The rows of the mix: each document as often as it was taken."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("__copy")).drop("__copy")
