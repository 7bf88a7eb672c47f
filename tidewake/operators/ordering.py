"""Running totals along an ordered value, of groups too large for one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Keys

#: A group's range is cut in this many cells of equal width ...
WIDTHS = 4096
#: ... and every doubling of the magnitude in this many.
OCTAVE = 64
#: Cells of the least positive double and above are numbered from 1.
_LOWEST = 1080 * OCTAVE
_FAR = 1 << 40


def attach(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Left join on keys, null meeting null; without keys, right has one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    named = {c: f"_key{i}" for i, c in enumerate(keys)}
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(k)) for c, k in named.items()])
    return left.join(right.withColumnsRenamed(named), same, "left").drop(*named.values())


def in_cells(d: DataFrame, g: Keys, value: str) -> DataFrame:
    """Adds _cell, which never falls as the value rises within g. It is the sum of a place on a logarithmic
    scale and of one between the group's least and greatest finite value, so that values crowded on either
    scale are still told apart; both are exact, hence the same whenever a task is run again."""
    v = F.col(value).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    d = attach(d, d.groupBy(*g).agg(F.min(finite).alias("_least"), F.max(finite).alias("_most")), g)
    size = F.greatest(F.floor(F.log2(F.abs(finite)) * OCTAVE) + _LOWEST, F.lit(0)) + 1
    scale = F.when(v == 0, 0).when(finite.isNotNull(), F.signum(v).cast("long") * size).when(v < 0, -_FAR).otherwise(_FAR)
    width = F.col("_most") - F.col("_least")
    place = F.when((width > 0) & (width < float("inf")) & finite.isNotNull(), F.floor((v - F.col("_least")) / width * WIDTHS)).otherwise(0)
    return d.withColumn("_cell", (scale + place).cast("long")).drop("_least", "_most")


def running_totals(d: DataFrame, g: Keys, value: str, names: Keys) -> DataFrame:
    """For d with one row for each g and value, neither value null: adds for each of names <name>_upto, its
    total up to the value (included), <name>_all, that of the group, and _cell.

    Rows are ordered inside a cell, and cells by their totals alone; no task holds a group's values."""
    placed = in_cells(d, g, value)
    cells = placed.groupBy(*g, "_cell").agg(*[F.sum(n).alias(f"{n}_cell") for n in names])
    earlier = Window.partitionBy(*g).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row a cell
    before = [F.coalesce(F.sum(f"{n}_cell").over(earlier), F.lit(0)).alias(f"{n}_before") for n in names]
    every = [F.sum(f"{n}_cell").over(Window.partitionBy(*g)).alias(f"{n}_all") for n in names]
    both = attach(placed, cells.select(*g, "_cell", *before, *every), [*g, "_cell"])
    inside = Window.partitionBy(*g, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({f"{n}_upto": F.sum(n).over(inside) + F.col(f"{n}_before") for n in names})
    return both.drop(*[f"{n}_before" for n in names])


def ranked(df: DataFrame, g: Keys, value: str, name: str, size: str | None = None) -> DataFrame:
    """Adds the average rank of value within g, from 1 (equal values share the mean of theirs), null where the
    value is null, and under `size` the number of values of the group. Only distinct values are ordered."""
    d = df.filter(F.col(value).isNotNull()).groupBy(*g, value).agg(F.count(F.lit(1)).alias("_n"))
    d = running_totals(d, g, value, ["_n"])
    found = [(F.col("_n_upto") - (F.col("_n") - 1) / 2).alias(name), *([F.col("_n_all").alias(size)] if size else [])]
    return attach(df, d.select(*g, value, *found), [*g, value])


def quantiles(df: DataFrame, g: Keys, value: str, wanted: dict[str, float]) -> DataFrame:
    """g and, for each name of wanted, the linear quantile at that share of the values of the group; groups
    without a value have no row (without g there is one row, of nulls). Only distinct values are ordered."""
    d = df.filter(F.col(value).isNotNull()).groupBy(*g, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    d = running_totals(d, g, "_v", ["_n"])
    found = []
    for name, q in wanted.items():
        at = (F.col("_n_all") - 1) * F.lit(float(q))
        low, high = F.min(F.when(F.col("_n_upto") > F.floor(at), F.col("_v"))), F.min(F.when(F.col("_n_upto") > F.ceil(at), F.col("_v")))
        at = F.max(at)
        found.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name))
    return d.groupBy(*g).agg(*found)


def numbered(df: DataFrame, g: Keys, value: str, ties: Keys, name: str, size: str | None = None) -> DataFrame:
    """Adds the place, from 1, of each row within g by value, equal values by `ties`; null for a null value. Rows
    of one value meet in a task, groups do not. Adds under `size` the number of values of the group."""
    d = df.filter(F.col(value).isNotNull()).groupBy(*g, value).agg(F.count(F.lit(1)).alias("_n"))
    d = running_totals(d, g, value, ["_n"]).select(*g, value, (F.col("_n_upto") - F.col("_n")).alias("_less"), *([F.col("_n_all").alias(size)] if size else []))
    inside = F.row_number().over(Window.partitionBy(*g, value).orderBy(*ties))
    return attach(df, d, [*g, value]).withColumn(name, (F.col("_less") + inside).cast("long")).drop("_less")


def standardized(df: DataFrame, by: Keys, value: str, name: str, flat: float | None = None, least: float = 0.0) -> DataFrame:
    """Adds (value - mean) / population deviation within `by`; `flat` where the deviation is `least` or less.
    Moments are aggregated and joined, so that no task holds a group."""
    moments = df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    z = F.when(F.col("_sd") > least, (F.col(value) - F.col("_mean")) / F.col("_sd"))
    if flat is not None:
        z = F.when(F.col("_sd") > least, z).when(F.col("_sd").isNotNull(), F.lit(flat).cast("double"))
    return attach(df, moments, by).withColumn(name, z).drop("_mean", "_sd")


def least_from(d: DataFrame, g: Keys, value: str, of: str, name: str) -> DataFrame:
    """Adds the least `of` of rows whose value is as great or greater. d: as running_totals gives it."""
    cells = d.groupBy(*g, "_cell").agg(F.min(of).alias("_m"))
    later = F.min("_m").over(Window.partitionBy(*g).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1))  # a row a cell
    inside = F.min(of).over(Window.partitionBy(*g, "_cell").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0))
    return attach(d, cells.select(*g, "_cell", later.alias("_later")), [*g, "_cell"]).withColumn(name, F.least(inside, "_later")).drop("_later")
