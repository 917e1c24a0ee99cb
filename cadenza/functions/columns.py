"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores are compared after rounding to this many digits, so that sums taken in a different order
# cannot swap two tied rows.
RANK_DIGITS = 9


def rank_key(score: Column) -> Column:
    """Ordering key only: the score as a whole number of 1e-9 steps (plain arithmetic, no decimals)."""
    return F.rint(score * F.lit(10.0**RANK_DIGITS))


def try_double(c: Column, default: float | None = 0.0) -> Column:
    """Number or ``default``: text that is no number and NaN count as missing."""
    number = c.try_cast("double")
    number = F.when(~F.isnan(number), number)
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def total(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)


def mean_vector(vector: str, size: int) -> Column:
    """Element-wise mean of an array column as one aggregate (partial sums run before the shuffle)."""
    return F.array(*[F.avg(F.get(F.col(vector), F.lit(i))) for i in range(size)])


def harmonic(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), 2.0 * a * b / (a + b)).otherwise(F.lit(0.0))


def labels_where(pairs: Sequence[tuple[Column, str]]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for cond, label in pairs]))
