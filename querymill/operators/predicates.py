"""Predicates of counting queries: terms, conjunctions, and one filter for all queries.

A term is (attr, op, value, lo, hi).  The set of operations is closed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EQ, LE, GE, RANGE = 0, 1, 2, 3
TERM = "struct<attr: int, op: int, value: int, lo: int, hi: int>"
TERMS = f"array<{TERM}>"


class Term(NamedTuple):
    attr: int
    op: int
    value: int = 0
    lo: int = 0
    hi: int = 0


def eq(attr: int, value: int) -> Term:
    return Term(attr, EQ, value)


def le(attr: int, value: int) -> Term:
    return Term(attr, LE, value)


def ge(attr: int, value: int) -> Term:
    return Term(attr, GE, value)


def between(attr: int, lo: int, hi: int) -> Term:
    return Term(attr, RANGE, 0, lo, hi)


def term_column(t: Term) -> Column:
    """A term over the columns c0, c1, ..."""
    c = F.col(f"c{t.attr}")
    if t.op == EQ:
        return c == t.value
    if t.op == LE:
        return c <= t.value
    if t.op == GE:
        return c >= t.value
    if t.op == RANGE:
        return c.between(t.lo, t.hi)
    raise ValueError(f"unknown operation {t.op}")


def conjunction(terms: Sequence[Term]) -> Column:
    return reduce(and_, map(term_column, terms))


def select_rows(encoded: DataFrame, terms: Sequence[Term]) -> DataFrame:
    """The rows that satisfy one query; the predicate reaches the scan."""
    return encoded.where(conjunction(terms))


def holds(codes: str, terms: str) -> Column:
    """Whether an array of codes satisfies an array of terms; both are column names."""
    return F.expr(
        f"forall({terms}, t -> case t.op when 0 then {codes}[t.attr] = t.value when 1 then {codes}[t.attr] <= t.value "
        f"when 2 then {codes}[t.attr] >= t.value else {codes}[t.attr] between t.lo and t.hi end)"
    )


def with_codes(encoded: DataFrame, d: int) -> DataFrame:
    return encoded.select("row_id", F.array(*[F.col(f"c{i}") for i in range(d)]).alias("codes"))


def satisfied(rows: DataFrame, queries: DataFrame, broadcast_queries: bool = True) -> DataFrame:
    """(row_id, qid) of all rows (row_id, codes) and queries that match, sparse.

    The catalogue is bounded by ``max_queries`` (10,000 by default); pass
    ``broadcast_queries=False`` for a catalogue without a bound.
    """
    q = queries.select("qid", "terms")
    return rows.join(F.broadcast(q) if broadcast_queries else q, holds("codes", "terms")).select("row_id", "qid")
