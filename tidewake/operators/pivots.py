"""Cells of a point set around pivots, and the cells that a query must meet by the triangle inequality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.columns import Keys, top_n
from ..functions.lineage import settled
from .ordering import attach

#: Rows of a group that a cell is meant to hold, and cells of a group at most (larger cells are compared in blocks).
CELL, MOST = 2048, 1024
#: Rows that are measured together.
PACK = 1024


def few(ref: DataFrame, on: Keys, cell: int | None = None) -> bool:
    """Whether every group of ref is one cell."""
    most = ref.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return (most or 0) <= (cell or CELL)


def chosen(ref: DataFrame, on: Keys, cell: int | None = None) -> DataFrame:
    """on, pivots: rows of each group with the least hashes of their id, one for every `cell` rows, MOST at most."""
    n = ref.groupBy(*on).agg(F.least(F.ceil(F.count(F.lit(1)) / (cell or CELL)), F.lit(MOST)).cast("int").alias("_p"))
    d = attach(ref.select(*on, "id", "x"), n, on).withColumn("_o", F.xxhash64("id", F.lit(11)))
    d = top_n(d, on, [F.col("_o"), F.col("id")], MOST, "_r").filter("_r <= _p")
    return d.groupBy(*on).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "x"))), lambda v: v["x"]).alias("pivots"))  # MOST a group


def _packed(df: DataFrame, on: Keys) -> DataFrame:
    size = df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / PACK).cast("int").alias("_parts"))
    rest = [c for c in df.columns if c not in on]
    d = attach(df, size, on).select(*on, F.pmod(F.xxhash64("id", F.lit(5)), F.col("_parts")).alias("_part"), F.struct(*rest).alias("_row"))
    return d.groupBy(*on, "_part").agg(F.collect_list("_row").alias("_rows"))


def _measured(rows, pivots) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([np.asarray(r["x"], float) for r in rows])
    p = np.array([np.asarray(v, float) for v in pivots])
    return x, np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)[None, :], 0))


def _each(df: DataFrame, table: DataFrame, on: Keys, extra: list[StructField], find) -> DataFrame:
    """Rows of df with the columns `extra`: find(rows, values of the group's row of table) gives, for the rows of a pack,
    the places of rows to keep (one may come several times) and the extra columns."""
    kept = [c for c in df.columns if c not in on]
    schema = StructType([*[df.schema[c] for c in [*on, *kept]], *extra])
    names = [c for c in table.columns if c not in on]

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rows = r.rows_
                at, *columns = find(rows, *[getattr(r, f"t_{c}") for c in names])
                out = {c: [getattr(r, c)] * len(at) for c in on}
                out |= {c: [rows[i][c] for i in at] for c in kept}
                yield pd.DataFrame(out | {f.name: v for f, v in zip(extra, columns, strict=True)})

    packs = attach(_packed(df, on).drop("_part").withColumnRenamed("_rows", "rows_"), table.withColumnsRenamed({c: f"t_{c}" for c in names}), on)
    return packs.filter(F.col(f"t_{names[0]}").isNotNull()).mapInPandas(run, schema)


def placed(df: DataFrame, pivots: DataFrame, on: Keys) -> DataFrame:
    """df (on, id, x, ...) with _cell, the nearest pivot (the first of equals), and _gap, the distance to it."""

    def nearest(rows, held):
        d = _measured(rows, held)[1]
        own = d.argmin(1)
        return np.arange(len(rows)), own.astype("int32"), d[np.arange(len(rows)), own]

    return _each(df, pivots, on, [StructField("_cell", IntegerType()), StructField("_gap", DoubleType())], nearest)


def extents(cells: DataFrame, pivots: DataFrame, on: Keys) -> DataFrame:
    """on, pivots, reach (greatest distance to the pivot) and n (rows) of every cell of the group."""
    s = cells.groupBy(*on, "_cell").agg(F.max("_gap").alias("reach"), F.count(F.lit(1)).alias("n"))
    s = s.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("_cell", F.struct("reach", "n")))).alias("_s"))  # MOST a group
    at = lambda f, none: F.transform(F.sequence(F.lit(0), F.size("pivots") - 1), lambda i: F.coalesce(F.try_element_at("_s", i)[f], F.lit(none)))
    return attach(pivots, s, on).select(*on, "pivots", at("reach", 0.0).alias("reach"), at("n", 0).alias("n"))


def asked(df: DataFrame, cells: DataFrame, on: Keys, k: int | None, skip_own: bool) -> DataFrame:
    """df, once for each cell (extents) that may hold a row within its column _bound: a row of a cell is no nearer than
    its pivot less the cell's reach, nor, as its pivot is its nearest, than half of what the pivot is farther than the
    query's own. With k, _bound is brought down to a distance within which cells surely hold k rows; with skip_own the
    query's own cell (_cell) is left out."""

    def find(rows, held, reach, n):
        _, d = _measured(rows, held)
        reach, n = np.asarray(reach, float), np.asarray(n, dtype=np.int64)
        bound = np.array([np.inf if r["_bound"] is None else r["_bound"] for r in rows], dtype=float)
        if k is not None:
            far = d + reach[None, :]
            order = far.argsort(1)
            enough = n[order].cumsum(1) >= k
            first = enough.argmax(1)
            sure = np.where(enough.any(1), far[np.arange(len(rows)), order[np.arange(len(rows)), first]], np.inf)
            bound = np.minimum(bound, sure)
        least = np.maximum(d - reach[None, :], (d - d.min(1)[:, None]) / 2)
        meet = (least <= bound[:, None] * (1 + 1e-9) + 1e-6) & (n > 0)[None, :]
        if skip_own:
            meet[np.arange(len(rows)), [r["_cell"] for r in rows]] = False
        at, cell = np.nonzero(meet)
        return at, cell.astype("int32")

    return _each(df, cells, on, [StructField("_ask", IntegerType())], find)


def cells_of(ref: DataFrame, on: Keys, cell: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pivots, ref with its cells, and the extents of these."""
    pivots = settled(chosen(ref, on, cell))
    held = settled(placed(ref, pivots, on))
    return pivots, held, settled(extents(held, pivots, on))
