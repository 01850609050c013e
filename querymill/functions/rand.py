"""Seeded draws as DataFrame columns.

A draw depends on its salt and ids alone, so results are the same however the
rows are partitioned.  Draws are for sampling and tests; noise that is to
protect a release needs a secret salt.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Ids = Column | str | int


def _col(x: Ids) -> Column:
    return F.lit(x) if isinstance(x, int) else (F.col(x) if isinstance(x, str) else x)


def uniform(salt: str, *ids: Ids) -> Column:
    """A number in (0, 1) with 32 random bits."""
    key = F.concat_ws(":", F.lit(salt), *[_col(i).cast("string") for i in ids])
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def integer(low: Column | int, high: Column | int, salt: str, *ids: Ids) -> Column:
    """An integer from low to high, both included."""
    lo, hi = _col(low), _col(high)
    return (lo + F.floor(uniform(salt, *ids) * (hi - lo + 1))).cast("int")


def gaussian(salt: str, *ids: Ids) -> Column:
    """A standard normal number, by the Box-Muller transform."""
    return F.sqrt(-2.0 * F.ln(uniform(salt + "/r", *ids))) * F.cos(2 * math.pi * uniform(salt + "/a", *ids))


def gumbel(salt: str, *ids: Ids) -> Column:
    return -F.ln(-F.ln(uniform(salt, *ids)))
