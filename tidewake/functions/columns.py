"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def squared_distance(a: Column | str, b: Column | str) -> Column:
    """Sum of squared differences of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def known(x: Column) -> Column:
    """NaN becomes null: the one mark of a value that cannot be estimated."""
    return F.when(~F.isnan(x), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.when(b != 0, a / b)


def pearson(x: Column, y: Column, w: Column | None = None) -> Column:
    """Weighted Pearson correlation as an aggregate of moments; null if either side is flat."""
    w = F.lit(1.0) if w is None else w
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    vx, vy = F.sum(w * x * x) / n - (sx / n) ** 2, F.sum(w * y * y) / n - (sy / n) ** 2
    cov = F.sum(w * x * y) / n - (sx / n) * (sy / n)
    return F.when((vx > 1e-15) & (vy > 1e-15), cov / F.sqrt(vx * vy))


#: Tables of query times, knots and directions are broadcast up to this many rows.
MOST_BROADCAST = 100_000


def short_table(df: DataFrame, what: str, most: int = MOST_BROADCAST) -> DataFrame:
    """df, marked for broadcast; fails where it has more than `most` rows, of which no more than one over is counted."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}: pass them in several tables")
    return F.broadcast(df)


def top_n(df: DataFrame, by: Keys, order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)
