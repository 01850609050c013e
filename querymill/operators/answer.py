"""Answering workloads of counting queries.

A generated query touches one or two attributes, so all of them can be answered
from a few small marginals (cuboids): GROUPING SETS count every marginal that
the catalogue needs in one scan.  Each term is an interval of codes, so a
query is a box of one or two intervals.  The shorter side is spelt out; along
the other a query is the difference of two running counts of the marginal's
cells, found by one sort of cells and query ends together.  A query over more
attributes, or over a marginal that would be nearly as large as the table, is
counted by a chunk of ``count_if`` sums in one more scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.operators.predicates import EQ, GE, LE, Term, conjunction

#: Cells that a marginal may have; it bounds what is joined with the catalogue.
MOST_CELLS = 1_000_000
#: Rows are counted by all codes first where these have so few combinations that every task's rows hold them many times.
FEW_CELLS = 10_000
#: Sums in one aggregate of the fallback.
CHUNK = 150
#: Attributes of one block: a scan groups by the sets of two blocks, as grouping ids have 64 bits.
BLOCK = 30
TOP = 2**31 - 1


def attribute_sets(queries: DataFrame) -> list[tuple[int, ...]]:
    """The distinct sets of attributes of a catalogue; there are at most as many as queries."""
    s = queries.select(_attributes().alias("s"))
    return sorted(tuple(r["s"]) for r in s.distinct().collect())


def _attributes() -> Column:
    return F.array_sort(F.array_distinct(F.transform("terms", lambda t: t["attr"])))


def cuboids(encoded: DataFrame, sets: Sequence[tuple[int, ...]], cardinalities: Sequence[int]) -> DataFrame:
    """(marginal, a, b, n): the cells of sets of one or two attributes, by their place in ``sets``; b is 0 for one.

    Rows are counted by all codes in use first where these have few combinations.
    """
    used = sorted({a for s in sets for a in s})
    cols = {a: F.col(f"c{a}") for a in used}
    rows = encoded.select(*cols.values(), F.lit(1).cast("long").alias("n"))
    if prod(cardinalities[a] + 1 for a in used) <= FEW_CELLS:
        rows = rows.groupBy(*cols.values()).agg(F.sum("n").alias("n"))
    grouped = rows.groupingSets([[cols[a] for a in s] for s in sets], *cols.values()).agg(F.grouping_id().alias("grouping"), F.sum("n").alias("n"))
    place = {grouping_of(s, used): (i, s) for i, s in enumerate(sets)}
    # One entry for each set: the codes that its cells have.
    known = F.create_map(*[x for g, (i, s) in place.items() for x in (F.lit(g).cast("long"), F.struct(F.lit(i).alias("i"), F.lit(used.index(s[0])).alias("a"), F.lit(used.index(s[-1])).alias("b"), F.lit(len(s) > 1).alias("two")))])
    codes = F.array(*cols.values())
    cells = grouped.select(known[F.col("grouping")].alias("s"), codes.alias("codes"), "n")
    cells = cells.select(F.col("s.i").alias("marginal"), F.get("codes", F.col("s.a")).alias("a"), F.when(F.col("s.two"), F.get("codes", F.col("s.b"))).otherwise(0).alias("b"), "n")
    return cells.where("a IS NOT NULL AND b IS NOT NULL")


def grouping_of(s: tuple[int, ...], used: Sequence[int]) -> int:
    """The grouping id of a set: a bit for each used attribute that it lacks, the first the highest."""
    return sum(1 << (len(used) - 1 - i) for i, a in enumerate(used) if a not in s)


def _interval(i: int, end: str) -> Column:
    """The lower or upper end of what a query's terms leave of its i-th attribute."""
    own = F.filter("terms", lambda t: t["attr"] == F.col("s")[i])
    if end == "lo":
        ends = F.transform(own, lambda t: F.when(t["op"].isin(EQ, GE), t["value"]).when(t["op"] == LE, F.lit(0)).otherwise(t["lo"]))
        return F.greatest(F.array_max(ends), F.lit(0))
    ends = F.transform(own, lambda t: F.when(t["op"].isin(EQ, LE), t["value"]).when(t["op"] == GE, F.lit(TOP)).otherwise(t["hi"]))
    return F.least(F.array_min(ends), F.element_at("k", F.col("s")[i] + 1) - 1)


def box_counts(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """(qid, answer) of boxes (qid, marginal, two, lo0, hi0, lo1, hi1) over the cells of their marginals."""
    # Side 0 is spelt out if it is the shorter one; a single attribute is the running one, beside a side of one code.
    first = F.col("two") & (F.col("hi0") - F.col("lo0") <= F.col("hi1") - F.col("lo1"))
    boxes = boxes.where("hi0 >= lo0 AND (NOT two OR hi1 >= lo1)").withColumn("side", F.when(first, 0).otherwise(1))
    points = F.when(first, F.sequence("lo0", "hi0")).when(F.col("two"), F.sequence("lo1", "hi1")).otherwise(F.array(F.lit(0)))
    ends = boxes.select("qid", "marginal", "side", F.explode(points).alias("at"), F.when(first, F.col("lo1")).otherwise(F.col("lo0")).alias("lo"), F.when(first, F.col("hi1")).otherwise(F.col("hi0")).alias("hi"))
    sides = F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("hi").alias("pos")), F.struct(F.lit(-1).alias("sign"), (F.col("lo") - 1).alias("pos"))))
    ends = ends.select("qid", "marginal", "side", "at", sides.alias("e")).select("qid", "marginal", "side", "at", "e.sign", "e.pos", F.lit(0).cast("long").alias("n")).where("pos >= 0")
    lines = cells.select(
        F.lit(None).cast("int").alias("qid"), "marginal", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("at"), F.col("b").alias("pos")), F.struct(F.lit(1).alias("side"), F.col("b").alias("at"), F.col("a").alias("pos")))).alias("x"), "n"
    ).select("qid", "marginal", "x.side", "x.at", F.lit(0).alias("sign"), "x.pos", "n")
    # Cells come before the ends at their code, as their sign is 0 and that of an end is not.
    upto = F.sum("n").over(Window.partitionBy("marginal", "side", "at").orderBy("pos", F.abs("sign")).rowsBetween(Window.unboundedPreceding, 0))
    counted = lines.unionByName(ends).withColumn("upto", upto).where("qid IS NOT NULL")
    return counted.groupBy("qid").agg(F.sum(F.col("sign") * F.col("upto")).alias("n"))


def answer(encoded: DataFrame, queries: DataFrame, cardinalities: Sequence[int], most_cells: int = MOST_CELLS) -> DataFrame:
    """(qid, answer) of every query, zero counts included."""
    spark = encoded.sparkSession
    sets = attribute_sets(queries)
    small = [s for s in sets if len(s) in (1, 2) and prod(cardinalities[a] for a in s) <= most_cells]
    parts: list[DataFrame] = []
    q = queries.select("qid", "terms", _attributes().alias("s"))
    if small:
        place = {s: i for i, s in enumerate(small)}
        ids = spark.createDataFrame([(list(s), i) for s, i in place.items()], "s array<int>, marginal int")
        own = q.join(F.broadcast(ids), "s").withColumn("k", F.array(*map(F.lit, cardinalities)))
        two, last = F.size("s") > 1, F.size("s") - 1
        boxes = own.select("qid", "marginal", two.alias("two"), _interval(0, "lo").alias("lo0"), _interval(0, "hi").alias("hi0"), *[_interval(last, e).alias(f"{e}1") for e in ("lo", "hi")])
        cells: DataFrame | None = None
        for batch in _scans(small):
            found = cuboids(encoded, batch, cardinalities)
            if len(batch) < len(small):
                found = found.withColumn("marginal", F.element_at(F.array(*[F.lit(place[s]) for s in batch]), F.col("marginal") + 1))
            cells = found if cells is None else cells.unionByName(found)
        counted = box_counts(boxes, cells)
        parts.append(own.select("qid").join(counted, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).cast("long").alias("answer")))
    wide = [s for s in sets if s not in set(small)]
    if wide:
        ids = spark.createDataFrame([(list(s),) for s in wide], "s array<int>")
        rows = q.join(F.broadcast(ids), "s", "left_semi").select("qid", "terms").collect()
        parts.append(count_by_conditions(encoded, [(r["qid"], [Term(*t) for t in r["terms"]]) for r in rows]))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _scans(sets: Sequence[tuple[int, ...]]) -> list[list[tuple[int, ...]]]:
    """Sets in batches that have few enough attributes for one grouping."""
    if len({a for s in sets for a in s}) <= 2 * BLOCK:
        return [list(sets)]
    batches: dict[tuple[int, int], list[tuple[int, ...]]] = {}
    for s in sets:
        batches.setdefault((s[0] // BLOCK, s[-1] // BLOCK), []).append(s)
    return list(batches.values())


def count_by_conditions(encoded: DataFrame, queries: Sequence[tuple[int, Sequence[Term]]]) -> DataFrame:
    """(qid, answer) by one conditional count for each query, CHUNK of them in a scan."""
    spark = encoded.sparkSession
    out = spark.createDataFrame([], "qid int, answer long")
    for i in range(0, len(queries), CHUNK):
        part = queries[i : i + CHUNK]
        sums = encoded.agg(*[F.count_if(conjunction(terms)).alias(f"q{qid}") for qid, terms in part])
        rows = F.array(*[F.struct(F.lit(qid).alias("qid"), F.col(f"q{qid}").alias("answer")) for qid, _ in part])
        out = out.union(sums.select(F.explode(rows).alias("r")).select("r.qid", "r.answer"))
    return out


def marginal(encoded: DataFrame, attr: int, cardinality: int) -> DataFrame:
    """(v, n): the histogram of an attribute with its empty cells."""
    spark = encoded.sparkSession
    every = spark.range(cardinality).select(F.col("id").cast("int").alias("v"))
    counts = encoded.groupBy(F.col(f"c{attr}").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "v", "left").select("v", F.coalesce("n", F.lit(0)).alias("n"))


def cumulative(histogram: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """(…, v, n, upto): running counts of a histogram, within each partition; it has a row for each code only."""
    w = Window.partitionBy(*partition).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return histogram.withColumn("upto", F.sum("n").over(w))


def interval_counts(histogram: DataFrame, intervals: DataFrame) -> DataFrame:
    """(lo, hi, answer) by the difference of two running counts, without a range join."""
    c = cumulative(histogram)
    upper = c.select(F.col("v").alias("hi"), F.col("upto").alias("__hi"))
    lower = c.select((F.col("v") + 1).alias("lo"), F.col("upto").alias("__lo"))
    joined = intervals.join(upper, "hi").join(lower, "lo", "left")
    return joined.select("lo", "hi", (F.col("__hi") - F.coalesce("__lo", F.lit(0))).alias("answer"))
