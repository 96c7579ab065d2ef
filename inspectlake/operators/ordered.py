"""Running values over ordered groups of any size.

Streaks, running totals, sessions and carried states all need "the rows of one
key in order".  A plain window puts a whole key into one task, which is fine
until one station holds a third of the log.  ``Ordered`` therefore looks at the
largest group first.  Below ``hot_rows`` it is an ordinary window.  Above, the
rows are range partitioned by (key, order), so a hot key is spread over many
slices; each slice is scanned on its own and the small per-slice totals are
carried forward.  Both ways give the same values.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

HOT_GROUP_ROWS = 2_000_000
_SLICE = "_slice"

_AGG = {
    "sum": F.sum,
    "count": F.count,
    "max": F.max,
    "min": F.min,
}
_CARRY = {
    "sum": lambda carry, local: F.coalesce(carry + local, local, carry),
    "count": lambda carry, local: F.coalesce(carry + local, local),
    "max": lambda carry, local: F.greatest(carry, local),
    "min": lambda carry, local: F.least(carry, local),
    "last": lambda carry, local: F.coalesce(local, carry),
}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "inspectlake-checkpoints"))
    return df.checkpoint()


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows in the biggest group; one small aggregate, one row to the driver."""
    if not keys:
        return df.count()
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return row["n"] or 0


class Ordered:
    """Rows of ``df`` in a total ``order`` within ``keys``; chain and take ``.df``."""

    def __init__(self, df: DataFrame, keys, order, hot_rows: int | None = None):
        self.keys = list(keys)
        self.order = list(order)
        limit = HOT_GROUP_ROWS if hot_rows is None else hot_rows
        self.hot = largest_group(df, self.keys) > limit
        self.df = self._slice_up(df) if self.hot else df

    def _slice_up(self, df: DataFrame) -> DataFrame:
        # The slice number must not change if a task is retried, so it is
        # written down before anything depends on it.
        return cut_lineage(
            df.repartitionByRange(*self.keys, *self.order).withColumn(_SLICE, F.spark_partition_id())
        )

    def _sort(self):
        return [F.col(c) if isinstance(c, str) else c for c in self.order]

    def _window(self):
        parts = self.keys + ([_SLICE] if self.hot else [])
        return Window.partitionBy(*parts).orderBy(*self._sort())

    def _next(self, df: DataFrame) -> "Ordered":
        out = object.__new__(Ordered)
        out.keys, out.order, out.hot, out.df = self.keys, self.order, self.hot, df
        return out

    def with_columns(self, **columns: Column) -> "Ordered":
        return self._next(self.df.withColumns(columns))

    def running(self, **specs: tuple[str, Column]) -> "Ordered":
        """Add inclusive running values; kinds are sum, count, max, min and last (non-null)."""
        upto = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = {
            name: (F.last(expr, ignorenulls=True) if kind == "last" else _AGG[kind](expr)).over(upto)
            for name, (kind, expr) in specs.items()
        }
        if not self.hot:
            return self._next(self.df.withColumns(local))
        totals = self._slice_totals(
            {
                f"_c_{name}": F.max_by(expr, F.when(expr.isNotNull(), F.struct(*self._plain_order())))
                if kind == "last"
                else _AGG[kind](expr)
                for name, (kind, expr) in specs.items()
            }
        )
        before = Window.partitionBy(*self.keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(
            *self.keys,
            _SLICE,
            *[
                (
                    F.last(f"_c_{name}", ignorenulls=True)
                    if kind == "last"
                    else (F.sum if kind == "count" else _AGG[kind])(f"_c_{name}")
                )
                .over(before)
                .alias(f"_c_{name}")
                for name, (kind, _) in specs.items()
            ],
        )
        joined = self._join_slices(self.df.withColumns(local), carried)
        combined = {
            name: _CARRY[kind](F.col(f"_c_{name}"), F.col(name)) for name, (kind, _) in specs.items()
        }
        return self._next(joined.withColumns(combined).drop(*[f"_c_{n}" for n in specs]))

    def previous(self, **columns: Column) -> "Ordered":
        """Add each value as it was on the row before (null on a key's first row)."""
        window = self._window()
        if not self.hot:
            return self._next(self.df.withColumns({n: F.lag(c).over(window) for n, c in columns.items()}))
        last_row = self._slice_totals(
            {f"_c_{n}": F.max_by(F.struct(c.alias("v")), F.struct(*self._plain_order())) for n, c in columns.items()}
        )
        before = Window.partitionBy(*self.keys).orderBy(_SLICE)
        carried = last_row.select(
            *self.keys, _SLICE, *[F.lag(f"_c_{n}").over(before).alias(f"_c_{n}") for n in columns]
        )
        local = {n: F.lag(c).over(window) for n, c in columns.items()}
        local["_first"] = F.row_number().over(window) == 1
        joined = self._join_slices(self.df.withColumns(local), carried)
        combined = {
            n: F.when(F.col("_first"), F.col(f"_c_{n}.v")).otherwise(F.col(n)) for n in columns
        }
        return self._next(joined.withColumns(combined).drop("_first", *[f"_c_{n}" for n in columns]))

    def row_number(self, name: str) -> "Ordered":
        return self.running(**{name: ("count", F.lit(1))})

    def result(self) -> DataFrame:
        return self.df.drop(_SLICE)

    def _plain_order(self):
        for column in self.order:
            if not isinstance(column, str):
                raise ValueError("a hot group needs plain ascending order columns")
        return [F.col(c) for c in self.order]

    def _slice_totals(self, aggregates: dict[str, Column]) -> DataFrame:
        return self.df.groupBy(*self.keys, _SLICE).agg(*[c.alias(n) for n, c in aggregates.items()])

    def _join_slices(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        # Same (key, slice) hashing as the window above: the big side does not move again.
        names = self.keys + [_SLICE]
        renamed = carried.select(*[F.col(n).alias(f"_k_{n}") for n in names], *[c for c in carried.columns if c not in names])
        on = [rows[n].eqNullSafe(renamed[f"_k_{n}"]) for n in names]
        return rows.join(renamed, on, "left").drop(*[f"_k_{n}" for n in names])
