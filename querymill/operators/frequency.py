"""Frequency tables of many columns at once, and exact order statistics from them.

One scan counts the distinct values of every column.  The table of counts is
laid out by (column, number) in ranges, so running counts have two levels: the
sums of ranges, of which there are as many as shuffle partitions, and rows
within one range.  No task holds a whole column, and nothing but the asked
order statistics reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querymill.functions.lineage import written

#: A text that a number is read from; Spark's own cast takes more ("5d").
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: Types whose cast to double is the number that their text stands for.
EXACT_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType, T.DecimalType)


def finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)


def number_of(c: Column, kind: T.DataType | None = None) -> Column:
    """The number that a value stands for, else null; infinite and undefined ones are null.

    Only where the type leaves it open is a text parsed.
    """
    if isinstance(kind, EXACT_NUMBERS):
        return finite(c.cast("double"))
    text = c.cast("string")
    return finite(F.when(text.rlike(NUMBER), F.trim(text)).try_cast("double"))


def text_of(c: Column, kind: T.DataType | None = None) -> Column:
    """The text of a value; the two zeros of a double are one value."""
    return (F.when(c == 0, F.lit(0.0)).otherwise(c) if isinstance(kind, T.DoubleType) else c).cast("string")


def steps(column: str, points: Sequence[float]) -> Column:
    """The number of ascending ``points`` at or below a column, as a search tree of comparisons; null for null."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN {column} < {float(points[mid])!r}D THEN {tree(lo, mid)} ELSE {tree(mid + 1, hi)} END"

    return F.expr(f"CASE WHEN {column} IS NOT NULL THEN {tree(0, len(points))} END")


@dataclass
class ColumnFacts:
    """What the counts of a column add up to."""

    distinct: int = 0
    #: Values that are no numbers, missing ones left out.
    texts: int = 0
    #: Rows with a number, the distinct numbers, and rows without any.
    numbers: int = 0
    distinct_numbers: int = 0
    without: int = 0


class Frequencies:
    """The counts (col, text, number, n, part) of ``columns``; ``col`` is the place of a column in that list."""

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        kinds = [df.schema[c].dataType for c in columns]
        cells = []
        for i, (c, kind) in enumerate(zip(columns, kinds)):
            col, real = F.col(f"`{c}`"), isinstance(kind, T.DoubleType)
            # Doubles are counted as they are: a text of each would cost more than the count.
            text = F.lit(None).cast("string") if real else text_of(col, kind)
            cells.append(F.struct(F.lit(i).alias("col"), text.alias("text"), (col if real else F.lit(None).cast("double")).alias("real")))
        counts = df.select(F.explode(F.array(*cells)).alias("x")).groupBy("x.col", "x.text", "x.real").agg(F.count(F.lit(1)).alias("n"))
        number = F.when(F.col("real").isNotNull(), finite(F.col("real"))).otherwise(number_of(F.col("text")))
        counts = counts.select("col", F.coalesce("text", F.col("real").cast("string")).alias("text"), number.alias("number"), "n")
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.counts = written(counts.repartitionByRange(parts, "col", "number").withColumn("part", F.spark_partition_id()))
        has, num = F.col("text").isNotNull(), F.col("number").isNotNull()
        sums = self.counts.groupBy("col", "part").agg(
            F.count_if(has).alias("distinct"),
            F.coalesce(F.sum(F.when(has & ~num, F.col("n"))), F.lit(0)).alias("texts"),
            F.coalesce(F.sum(F.when(num, F.col("n"))), F.lit(0)).alias("numbers"),
            # Equal numbers of different texts stand in one range.
            F.count_distinct(F.when(num, F.col("number") + 0.0)).alias("distinct_numbers"),
            F.coalesce(F.sum(F.when(~num, F.col("n"))), F.lit(0)).alias("without"),
        )
        #: By column; there are at most as many sums as ranges and columns together.
        self.facts = [ColumnFacts() for _ in columns]
        before: list[tuple[int, int, int]] = []
        for r in sorted(sums.collect(), key=lambda r: (r["col"], r["part"])):
            f = self.facts[r["col"]]
            before.append((r["col"], r["part"], f.numbers))
            for k in ("distinct", "texts", "numbers", "distinct_numbers", "without"):
                setattr(f, k, getattr(f, k) + r[k])
        self._before = before
        self._ranked: DataFrame | None = None

    def ranked(self) -> DataFrame:
        """(col, number, first, upto): numbers with the ranks that their rows have, [first, upto)."""
        if self._ranked is None:
            spark = self.counts.sparkSession
            before = spark.createDataFrame(self._before, "col int, part int, before long")
            merged = self.counts.where("number IS NOT NULL").groupBy("col", "part", "number").agg(F.sum("n").alias("n"))
            within = Window.partitionBy("col", "part").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
            r = merged.withColumn("cum", F.sum("n").over(within)).join(F.broadcast(before), ["col", "part"])
            upto = F.col("before") + F.col("cum")
            self._ranked = written(r.select("col", "number", (upto - F.col("n")).alias("first"), upto.alias("upto")))
        return self._ranked

    def at_ranks(self, wanted: Mapping[int, Sequence[int]]) -> dict[tuple[int, int], float]:
        """The numbers at the wanted ranks (from 0) of each column: {(col, rank): number}."""
        wanted = {c: sorted(set(r)) for c, r in wanted.items() if len(r)}
        if not wanted:
            return {}
        hit = F.lit(False)
        for c, ranks in wanted.items():
            points = [r + 0.5 for r in ranks]
            hit = F.when(F.col("col") == c, steps("upto", points) > steps("first", points)).otherwise(hit)
        rows = self.ranked().where(hit).collect()
        out = {}
        for r in rows:
            for rank in wanted[r["col"]]:
                if r["first"] <= rank < r["upto"]:
                    out[r["col"], rank] = r["number"]
        return out

    def interpolated(self, wanted: Mapping[int, Sequence[float]]) -> dict[int, list[float]]:
        """The numbers at fractional ranks, between neighbours linearly."""
        found = self.at_ranks({c: [k for p in places for k in (int(p), min(int(p) + 1, self.facts[c].numbers - 1))] for c, places in wanted.items()})
        out = {}
        for c, places in wanted.items():
            own = []
            for p in places:
                lo = int(p)
                a, b = found[c, lo], found[c, min(lo + 1, self.facts[c].numbers - 1)]
                own.append(a if p == lo else (lo + 1 - p) * a + (p - lo) * b)
            out[c] = own
        return out

    def spans(self, groups: Mapping[int, Column]) -> list[tuple[int, int, int, int]]:
        """(col, group, first rank, end) of groups that cut a column's numbers into consecutive ranges."""
        wanted = F.lit(None).cast("int")
        for c, g in groups.items():
            wanted = F.when(F.col("col") == c, g).otherwise(wanted)
        rows = self.ranked().where(F.col("col").isin(*groups)).groupBy("col", wanted.alias("grp")).agg(F.min("first").alias("first"), F.max("upto").alias("upto"))
        return [(r["col"], r["grp"], r["first"], r["upto"]) for r in rows.collect()]

    def values(self, columns: Sequence[int]) -> dict[int, list[tuple[str | None, float | None]]]:
        """All distinct (text, number) of columns whose counts are known to be small."""
        out: dict[int, list[tuple[str | None, float | None]]] = {c: [] for c in columns}
        if columns:
            for r in self.counts.where(F.col("col").isin(*columns)).select("col", "text", "number").collect():
                out[r["col"]].append((r["text"], r["number"]))
        return out
