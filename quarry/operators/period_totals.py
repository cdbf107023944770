"""Balances and turnovers from kept monthly totals: detail of one month at most is read for a balance.

Below a versioned folder each month has its detail, what moved in it by dimensions, and the opening
balances of all dimensions at its first moment. Rows that come late go into their month, and the
openings of later months are made anew. Sums are exact decimals.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources.versioned import Versioned

AMOUNT = "decimal(28,6)"


class Totals:
    """Totals of one register: ``period`` (its time), ``dimensions``, ``resource`` and what is a receipt.

    ``schema`` types the dimensions and the period. ``parts`` tasks write a month.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, period: str, dimensions: list[str], resource: str, parts: int = 4):
        self.table, self.period, self.dimensions, self.resource, self.parts = Versioned(spark, folder), period, dimensions, resource, parts
        types = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema}
        dims = ", ".join(f"`{c}` {types[c]}" for c in dimensions)
        self._detail = f"month STRING, {dims}, `{period}` {types[period]}, receipt {AMOUNT}, expense {AMOUNT}"
        self._moved = f"month STRING, {dims}, receipt {AMOUNT}, expense {AMOUNT}"
        self._opening = f"month STRING, {dims}, balance {AMOUNT}"

    def _months(self, df: DataFrame) -> dict[str, str]:
        """Writes ``df`` (month, ...) by month: the folder of each. Files keep the month too, so that any months are one read."""
        dealt = df.withColumn("_month", F.col("month")).repartition(F.col("_month"), F.pmod(F.xxhash64(*self.dimensions), F.lit(self.parts)))
        path = self.table.write(dealt, "_month")
        return {n.removeprefix("_month="): f"{path}/{n}" for n in self.table.names(path) if n.startswith("_month=")}

    def _sums(self, df: DataFrame, *by: str) -> DataFrame:
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(AMOUNT).alias(c)
        return df.groupBy(*by, *self.dimensions).agg(total("receipt"), total("expense"))

    def post(self, rows: DataFrame, receipt: Column) -> int:
        """Add rows of the register, late ones too; the new version. Rows without a time are left out of all totals, as of any date."""
        base = self.table.version()
        months = {m: dict(x) for m, x in self.table.manifest(base).get("months", {}).items()}
        amount = F.col(self.resource).cast(AMOUNT)
        told = rows.where(F.col(self.period).isNotNull()).select(*self.dimensions, self.period, F.when(receipt, amount).otherwise(0).cast(AMOUNT).alias("receipt"), F.when(~F.coalesce(receipt, F.lit(False)), amount).otherwise(0).cast(AMOUNT).alias("expense"), F.date_format(self.period, "yyyy-MM").alias("month"))
        new = self._months(told)
        for m, path in new.items():
            months.setdefault(m, {"detail": []})["detail"] = [*months.get(m, {}).get("detail", []), path]
        if not new:
            return base
        held = self.table.read(self._moved, [months[m]["moved"] for m in new if "moved" in months[m]])
        added = self._sums(self.table.read(self._detail, list(new.values())), "month").unionByName(held)
        for m, path in self._months(self._sums(added, "month")).items():
            months[m]["moved"] = path
        self._open(months, min(new))
        return self.table.commit({"months": months}, base)

    def _open(self, months: dict, since: str) -> None:
        """Openings of the months after ``since``, from its own opening and what moved from then on."""
        later = sorted(m for m in months if m >= since)
        if "opening" not in months[since]:
            before = max((m for m in months if m < since), default=None)
            start = self._after(months, before) if before else self.table.read(self._opening, []).drop("month")
            months[since]["opening"] = self.table.write(start.select(F.lit(since).alias("month"), *self.dimensions, "balance"))
        opened = self.table.read(self._opening, [months[since]["opening"]]).withColumn("month", F.lit(""))
        moved = self.table.read(self._moved, [months[m]["moved"] for m in later[:-1]])
        moves = opened.unionByName(moved.select("month", *self.dimensions, (F.col("receipt") - F.col("expense")).cast(AMOUNT).alias("balance"))).withColumnRenamed("month", "_at")
        mine = Window.partitionBy(*self.dimensions).orderBy("_at")
        run = moves.withColumn("balance", F.sum("balance").over(mine).cast(AMOUNT)).withColumn("_next", F.lead("_at").over(mine))
        # A balance holds for the months behind its own, up to the next in which something moves.
        held = F.filter(F.array(*map(F.lit, later[1:])) if later[1:] else F.array().cast("array<string>"), lambda m: (m > F.col("_at")) & (F.col("_next").isNull() | (m <= F.col("_next"))) & (m > F.lit(since)))
        opened = self._months(run.select(*self.dimensions, "balance", F.explode(held).alias("month"))) if later[1:] else {}
        for m in later[1:]:
            months[m]["opening"] = opened.get(m, months[since]["opening"])

    def _after(self, months: dict, m: str) -> DataFrame:
        """Balances at the end of a month."""
        moved = self.table.read(self._moved, [months[m]["moved"]]).select(*self.dimensions, (F.col("receipt") - F.col("expense")).cast(AMOUNT).alias("balance"))
        both = self.table.read(self._opening, [months[m]["opening"]]).drop("month").unionByName(moved)
        return both.groupBy(*self.dimensions).agg(F.sum("balance").cast(AMOUNT).alias("balance"))

    def _rows(self, months: dict, m: str, low: datetime | None, high: datetime | None) -> DataFrame:
        rows = self.table.read(self._detail, months[m]["detail"])
        kind = rows.schema[self.period].dataType
        for bound, test in ((low, "__ge__"), (high, "__le__")):
            if bound is not None:
                rows = rows.where(getattr(F.col(self.period), test)(F.lit(str(bound)).cast(kind)))
        return rows

    def balance(self, at: datetime) -> DataFrame:
        """Receipts less expenses up to ``at``, as ``registers.balance``: an opening, and the detail of that month up to then."""
        months = self.table.manifest().get("months", {})
        own = at.strftime("%Y-%m")
        m = max((x for x in months if x <= own), default=None)
        if m is None:
            found = self.table.read(self._opening, [])
        elif m < own:
            found = self._after(months, m)
        else:
            moved = self._rows(months, m, None, at).select(*self.dimensions, (F.col("receipt") - F.col("expense")).cast(AMOUNT).alias("balance"))
            found = self.table.read(self._opening, [months[m]["opening"]]).drop("month").unionByName(moved).groupBy(*self.dimensions).agg(F.sum("balance").alias("balance"))
        return found.select(*self.dimensions, F.round("balance", 2).cast("double").alias(f"{self.resource}_balance"))

    def turnover(self, start: datetime, end: datetime) -> DataFrame:
        """Receipts and expenses from ``start`` to ``end`` inclusive: whole months from their totals, the first and the last from detail."""
        months = self.table.manifest().get("months", {}) if start <= end else {}
        first, last = start.strftime("%Y-%m"), end.strftime("%Y-%m")
        whole = self.table.read(self._moved, [months[m]["moved"] for m in months if first < m < last])
        for m in {first, last} & set(months):
            whole = whole.unionByName(self._rows(months, m, start if m == first else None, end if m == last else None).drop(self.period))
        out = lambda c: F.round(F.sum(c), 2).cast("double").alias(f"{self.resource}_{c}")
        return whole.groupBy(*self.dimensions).agg(out("receipt"), out("expense"))
