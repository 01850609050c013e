"""Encoding of a table into small integer codes, and back.

Fitting scans the table once, for the frequency tables of all columns; kinds,
dictionaries, quantiles and medians come from these.  Encoding is a map.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querymill.operators.frequency import ColumnFacts, Frequencies, number_of, steps, text_of
from querymill.operators.schema import CATEGORICAL, MISSING, NUMERICAL, Attribute, TableSchema

#: Categories of an attribute that a plan may hold; beyond it the column is no finite domain.
MOST_CATEGORIES = 100_000
#: Larger dictionaries are joined instead of searched in an array.
INLINE = 64
#: Decimal places of bin edges, so that engines that interpolate differently in the last bit agree.
EDGE_PLACES = 9
#: Comparisons that one encoding holds as search trees; generated code beyond that is too large to be compiled.
TREE_EDGES = 128


def numeric_value(c: Column) -> Column:
    """The number that a value stands for, whatever its type; see ``number_of``."""
    return number_of(c)


def category_value(c: Column, token: str = MISSING, kind: T.DataType | None = None) -> Column:
    """The text of a category; null, empty and ``?`` are missing."""
    text = text_of(c, kind)
    return F.when(text.isNull() | text.isin("", "?"), F.lit(token)).otherwise(text)


def column_kind(name: str, f: ColumnFacts, numerical: set[str], categorical: set[str], min_unique: int, force_all_categorical: bool, numeric_detection: str) -> tuple[bool, str]:
    """Whether a column looks numeric, and its kind.

    A column that is not listed is numeric if it looks so and has ``min_unique``
    distinct values.  ``numeric_detection="compat"`` takes every column that has
    a value for numeric-like.
    """
    like = f.distinct > 0 and (numeric_detection != "strict" or f.texts == 0)
    if force_all_categorical or name in categorical:
        return like, CATEGORICAL
    return like, NUMERICAL if name in numerical or (like and f.distinct >= min_unique) else CATEGORICAL


def infer_kinds(
    df: DataFrame,
    columns: Sequence[str],
    numerical: Iterable[str] = (),
    categorical: Iterable[str] = (),
    min_unique: int = 10,
    force_all_categorical: bool = False,
    numeric_detection: str = "strict",
) -> DataFrame:
    """(name, n_distinct, numeric_like, kind) of each column, from one scan."""
    numerical, categorical = set(numerical), set(categorical)
    rows = []
    for c, f in zip(columns, Frequencies(df, columns).facts):
        like, kind = column_kind(c, f, numerical, categorical, min_unique, force_all_categorical, numeric_detection)
        rows.append((c, f.distinct, like, kind))
    return df.sparkSession.createDataFrame(rows, "name string, n_distinct long, numeric_like boolean, kind string")


def quantile_edges(df: DataFrame, column: str, bins: int) -> DataFrame:
    """One row: the distinct interpolated quantiles of the column's numbers at ``bins + 1`` points; none without a number."""
    freq = Frequencies(df, [column])
    edges = column_edges(freq, {0: bins})[0] if freq.facts[0].numbers else []
    return df.sparkSession.createDataFrame([(edges,)], "edges array<double>")


def column_edges(freq: Frequencies, bins: dict[int, int]) -> dict[int, list[float]]:
    """The rounded distinct quantiles of columns, at bins + 1 points each."""
    places = {c: [i / b * (freq.facts[c].numbers - 1) for i in range(b + 1)] for c, b in bins.items()}
    return {c: sorted({rounded(x) for x in v}) for c, v in freq.interpolated(places).items()}


def rounded(x: float) -> float:
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-EDGE_PLACES), ROUND_HALF_UP)) + 0.0 if abs(x) < 1e15 else x


def fit_schema(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    bins: int = 32,
    numerical: Iterable[str] = (),
    categorical: Iterable[str] = (),
    min_unique: int = 10,
    force_all_categorical: bool = False,
    missing_token: str = MISSING,
    label_column: str | None = None,
    numeric_detection: str = "strict",
) -> TableSchema:
    """The schema that the data suggests.

    It reads the private table without any noise; pass a schema that is known
    beforehand where that matters.  Dictionaries are checked against
    MOST_CATEGORIES before they are collected.
    """
    columns = list(columns or df.columns)
    freq = Frequencies(df, columns)
    listed = set(numerical), set(categorical)
    kinds = [column_kind(c, f, *listed, min_unique, force_all_categorical, numeric_detection)[1] for c, f in zip(columns, freq.facts)]
    for c, f, kind in zip(columns, freq.facts, kinds):
        if kind == CATEGORICAL and f.distinct > MOST_CATEGORIES:
            raise ValueError(f"{c} has {f.distinct} categories; at most {MOST_CATEGORIES} make a finite domain")
    small = [i for i, (f, kind) in enumerate(zip(freq.facts, kinds)) if kind == NUMERICAL and 0 < f.distinct_numbers <= bins]
    large = [i for i, (f, kind) in enumerate(zip(freq.facts, kinds)) if kind == NUMERICAL and f.distinct_numbers > bins]
    found = freq.values([i for i, kind in enumerate(kinds) if kind == CATEGORICAL])
    small_values = _small_domains(freq, small)
    edges = {c: e if len(e) > 2 else [e[0], e[-1]] for c, e in column_edges(freq, {c: bins for c in large}).items()}
    medians = bin_medians(freq, edges)
    made: list[Attribute] = []
    for i, c in enumerate(columns):
        f = freq.facts[i]
        gap = f.without > 0
        if kinds[i] == CATEGORICAL:
            cats = tuple(sorted({missing_token if t in (None, "", "?") else t for t, _ in found[i]}))
            made.append(Attribute(c, CATEGORICAL, len(cats), cats, None, cats, missing_token, cats.index(missing_token) if missing_token in cats else None))
        elif not f.numbers:
            made.append(Attribute(c, NUMERICAL, 1, None, None, (missing_token,), missing_token, 0))
        elif i in small_values:
            values = tuple(small_values[i])
            reps = tuple(str(x) for x in values) + ((missing_token,) if gap else ())
            made.append(Attribute(c, NUMERICAL, len(reps), None, None, reps, missing_token, len(values) if gap else None, values))
        else:
            n = max(1, len(edges[i]) - 1)
            own = [medians.get((i, b), (edges[i][b] + edges[i][min(b + 1, len(edges[i]) - 1)]) / 2) for b in range(n)]
            reps = tuple(str(float(m)) for m in own) + ((missing_token,) if gap else ())
            made.append(Attribute(c, NUMERICAL, n + gap, None, tuple(edges[i]), reps, missing_token, n if gap else None))
    return TableSchema(tuple(made), label_column)


def _small_domains(freq: Frequencies, columns: Sequence[int]) -> dict[int, list[float]]:
    """The distinct numbers of columns that have few; zero is one number, whatever its sign."""
    out: dict[int, list[float]] = {}
    if columns:
        rows = freq.counts.where(F.col("col").isin(*columns) & F.col("number").isNotNull()).select("col", (F.col("number") + 0.0).alias("x")).distinct().collect()
        out = {c: sorted({float(r["x"]) + 0.0 for r in rows if r["col"] == c}) for c in columns}
    return out


def bin_medians(freq: Frequencies, edges: dict[int, list[float]]) -> dict[tuple[int, int], float]:
    """The median of the numbers of each bin that has any: {(col, bin): median}."""
    if not edges:
        return {}
    spans = freq.spans({c: bin_code("number", e) for c, e in edges.items()})
    wanted: dict[int, list[float]] = {c: [] for c in edges}
    for c, _, first, upto in spans:
        wanted[c].append(first + (upto - first - 1) / 2)
    found = freq.interpolated(wanted)
    place = {c: iter(v) for c, v in found.items()}
    return {(c, b): next(place[c]) for c, b, _, _ in spans}


def bin_code(column: str, edges: Sequence[float], tree: bool = True) -> Column:
    """The number of inner edges at or below a column."""
    inner = [float(e) for e in edges[1:-1]]
    if tree or not inner:
        return steps(column, inner)
    return F.expr(f"CASE WHEN {column} IS NOT NULL THEN transform(array({column}), v -> size(filter(array({', '.join(f'{e!r}D' for e in inner)}), e -> e <= v)))[0] END")


def encode(df: DataFrame, schema: TableSchema, row_id: Column | str) -> DataFrame:
    """(row_id, c0 .. c{d-1}); values outside a domain that has no missing code are null.

    Numbers and texts are read once, in a projection of their own; codes are
    looked up in it.
    """
    read = []
    for i, a in enumerate(schema.attributes):
        col, kind = F.col(f"`{a.name}`"), df.schema[a.name].dataType
        read.append((category_value(col, a.missing_token, kind) if a.kind == CATEGORICAL else number_of(col, kind)).alias(f"x{i}"))
    out = df.select((F.col(row_id) if isinstance(row_id, str) else row_id).cast("long").alias("row_id"), *read)
    codes, spent = [], 0
    for i, a in enumerate(schema.attributes):
        x = F.col(f"x{i}")
        if a.kind == CATEGORICAL and a.cardinality > INLINE:
            # At most MOST_CATEGORIES short rows are broadcast.
            words = df.sparkSession.createDataFrame(list(zip(a.categories, range(a.cardinality))), f"w{i} string, k{i} int")
            out = out.join(F.broadcast(words), x == F.col(f"w{i}"), "left").drop(f"w{i}")
            code = F.col(f"k{i}")
        elif a.kind == CATEGORICAL:
            at = F.array_position(F.array(*map(F.lit, a.categories)), x)
            code = F.when(at > 0, at - 1)
        elif a.values is not None:
            at = F.array_position(F.array(*map(F.lit, a.values)), x + 0.0)
            code = F.when(at > 0, at - 1)
        elif a.bin_edges is not None:
            spent += len(a.bin_edges)
            code = bin_code(f"x{i}", a.bin_edges, tree=spent <= TREE_EDGES)
        else:
            code = F.lit(0)
        codes.append(F.coalesce(code, F.lit(a.missing_code)).cast("int").alias(f"c{i}"))
    return out.select("row_id", *codes)


def clip(code: Column, cardinality: int) -> Column:
    return F.greatest(F.lit(0), F.least(code, F.lit(cardinality - 1)))


def decode(encoded: DataFrame, schema: TableSchema) -> DataFrame:
    """Codes as the texts of their representatives; a code outside the domain as the first."""
    out = []
    for i, a in enumerate(schema.attributes):
        reps = F.array(*[F.lit(x) for x in (a.representatives or a.categories or [str(k) for k in range(a.cardinality)])])
        out.append(F.coalesce(F.get(reps, F.col(f"c{i}")), F.get(reps, F.lit(0))).alias(a.name))
    return encoded.select("row_id", *out)
