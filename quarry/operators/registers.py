"""Virtual tables of registers: latest slice, balances, turnovers. Their results are defined here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slice_last(register: DataFrame, period: str, dimensions: list[str], at: Column | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """The latest row of each combination of dimensions, not later than ``at``.

    ``ties`` order rows of one period; the greatest wins. The maximum is taken by a partial and a
    final aggregation, so a hot combination never gathers in one task.
    """
    rows = register if at is None else register.where(F.col(period) <= at)
    rest = [c for c in register.columns if c not in dimensions]
    rank = F.struct(*[F.col(c) for c in (period, *ties)])
    last = rows.groupBy(*dimensions).agg(F.max_by(F.struct(*rest), rank).alias("_last"))
    return last.select(*dimensions, "_last.*").select(*register.columns)


def balance(register: DataFrame, period: str, dimensions: list[str], resource: str, receipt: Column, at: Column | None = None) -> DataFrame:
    """Receipts less expenses up to ``at``, by dimensions, as ``<resource>_balance``."""
    rows = register if at is None else register.where(F.col(period) <= at)
    signed = F.when(receipt, F.col(resource)).otherwise(-F.col(resource))
    return rows.groupBy(*dimensions).agg(F.round(F.sum(signed), 2).alias(f"{resource}_balance"))


def turnover(register: DataFrame, period: str, dimensions: list[str], resource: str, receipt: Column, start: Column, end: Column) -> DataFrame:
    """Receipts and expenses from ``start`` to ``end`` inclusive, by dimensions."""
    rows = register.where(F.col(period).between(start, end))
    moved = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.col(resource))), F.lit(0.0)), 2)
    return rows.groupBy(*dimensions).agg(moved(receipt).alias(f"{resource}_receipt"), moved(~receipt).alias(f"{resource}_expense"))


def totals(rows: DataFrame, by: list[str], sums: list[str], overall: bool = False) -> DataFrame:
    """Detail rows and subtotal rows with ``_level``.

    Level len(by) + 1 is detail; level k sums ``sums`` over the first k fields of ``by``, from the
    last field up; level 0, with ``overall``, sums all. Columns of no use on a subtotal row are null.
    One rollup makes all subtotals.
    """
    keep = [c for c in rows.columns if c not in by and c not in sums]
    detail = rows.select(*by, *sums, *keep, F.lit(len(by) + 1).alias("_level"))
    level = F.lit(len(by)) - F.expr(" + ".join(f"CAST(grouping(`{c}`) AS INT)" for c in by))
    rolled = rows.rollup(*by).agg(*[F.round(F.sum(c), 2).alias(c) for c in sums], level.alias("_level"))
    rolled = rolled if overall else rolled.where("_level > 0")
    return detail.unionByName(rolled.select(*by, *sums, *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in keep], "_level"))


def ranked(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
