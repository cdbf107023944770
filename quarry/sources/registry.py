"""Business sources by kind: which table, key, standard fields, references, dimensions and resources."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    """``standard`` maps standard fields to columns; ``references`` a column to the source its values are keys of."""

    kind: str
    table: str
    key: str = ""
    standard: dict[str, str] = field(default_factory=dict)
    references: dict[str, str] = field(default_factory=dict)
    period: str = ""
    dimensions: tuple[str, ...] = ()
    resources: tuple[str, ...] = ()


SOURCES = {
    s.table: s
    for s in (
        Source("catalog", "region", "r_regionkey", {"code": "r_regionkey", "description": "r_name"}),
        Source("catalog", "nation", "n_nationkey", {"code": "n_nationkey", "description": "n_name"}, {"n_regionkey": "region"}),
        Source("catalog", "customer", "c_custkey", {"code": "c_custkey", "description": "c_name"}, {"c_nationkey": "nation"}),
        Source("catalog", "supplier", "s_suppkey", {"code": "s_suppkey", "description": "s_name"}, {"s_nationkey": "nation"}),
        Source("catalog", "part", "p_partkey", {"code": "p_partkey", "description": "p_name"}),
        Source("document", "orders", "o_orderkey", {"number": "o_orderkey", "date": "o_orderdate"}, {"o_custkey": "customer"}),
        Source("accumulation", "lineitem", "", {"period": "l_shipdate", "recorder": "l_orderkey"}, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, "l_shipdate", ("l_partkey", "l_suppkey"), ("l_quantity", "l_extendedprice")),
        Source("information", "events", "", {"period": "ts"}, {}, "ts", ("user_id", "event_type"), ("value",)),
    )
}


#: Registers of entries with two accounts, and of calculations, over the same tables.
ACCOUNTING = {"orders": {"period": "o_orderdate", "recorder": "o_orderkey", "debit": "o_custkey", "credit": "o_orderpriority", "amount": "o_totalprice"}}
CALCULATION = {"lineitem": {"period": "l_shipdate", "recorder": "l_orderkey", "l_suppkey": "l_suppkey", "result": "l_quantity"}}


class Registry:
    """Scans of the sources below one folder of Parquet tables, with optional row policies."""

    def __init__(self, spark: SparkSession, root: str, policies: dict[str, Column] | None = None):
        self.spark, self.root, self.policies = spark, root, policies or {}

    def table(self, name: str) -> DataFrame:
        """The table as it is; Catalyst prunes its columns and pushes filters into the scan."""
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def entries(self, name: str) -> DataFrame:
        """An accounting register: period, recorder, the debit and credit accounts and the amount of each entry."""
        book = ACCOUNTING[name]
        return self.table(name).select(*[F.col(c).alias(n) for n, c in book.items()])

    def calculations(self, name: str) -> DataFrame:
        """A calculation register: records with the month that they are registered in, their recorder, object and result."""
        book = CALCULATION[name]
        month = F.date_trunc("month", F.col(book["period"])).cast(dict(self.table(name).dtypes)[book["period"]])
        rest = [F.col(c).alias(n) for n, c in book.items()]
        return self.table(name).select(month.alias("registration_period"), *rest)

    def scan(self, name: str, allowed: bool = False) -> DataFrame:
        """The source under its standard field names, other columns as they are.

        With ``allowed`` only the rows that the source's policy admits; without a policy, all.
        """
        source, df = SOURCES[name], self.table(name)
        if allowed and name in self.policies:
            df = df.where(self.policies[name])
        named = set(source.standard.values())
        return df.select(*[F.col(c).alias(n) for n, c in source.standard.items()], *[c for c in df.columns if c not in named])

    def navigate(self, df: DataFrame, start: str, *paths: str) -> DataFrame:
        """``df`` (rows of source ``start``) with a column for each path such as ``o_custkey.c_nationkey.n_name``.

        Each step but the last is a reference; it becomes one left join, shared by all paths with
        that prefix. Keys are unique, so rows are not multiplied. Columns are named by the path
        with dots as underscores.
        """
        joined: dict[tuple[str, ...], str] = {(): start}
        out = df.select(*[F.col(c).alias(f"{c}") for c in df.columns])
        made: dict[tuple[str, ...], dict[str, str]] = {(): {c: c for c in df.columns}}
        for path in paths:
            steps = tuple(path.split("."))
            for depth in range(1, len(steps)):
                prefix = steps[:depth]
                if prefix in made:
                    continue
                target = SOURCES[joined[prefix[:-1]]].references[prefix[-1]]
                right = self.table(target)
                names = {c: "__" + "_".join((*prefix, c)) for c in right.columns}
                right = right.select(*[F.col(c).alias(n) for c, n in names.items()])
                out = out.join(right, F.col(made[prefix[:-1]][prefix[-1]]) == F.col(names[SOURCES[target].key]), "left")
                joined[prefix], made[prefix] = target, names
        return out.select(*df.columns, *[F.col(made[tuple(p.split("."))[:-1]][p.split(".")[-1]]).alias(p.replace(".", "_")) for p in paths])

    def navigate_tagged(self, df: DataFrame, tag: str, key: str, fields: dict[str, dict[str, str]]) -> DataFrame:
        """``df`` with fields of what its references of several types point to.

        A reference is a value of ``key`` in the source that ``tag`` names; ``fields`` has, by
        source, the column that each output is there. Rows are split by their tags, so each kind
        meets its own table only; an output that a source lacks is null, and so are all of
        references to other sources, to none, or to keys that aren't there.
        """
        outputs = list(dict.fromkeys(name for given in fields.values() for name in given))
        types = {name: self.table(t).schema[given[name]].dataType for t, given in fields.items() for name in given}
        empty = {name: F.lit(None).cast(types[name]) for name in outputs}
        parts = [df.where(F.col(tag).isNull() | ~F.col(tag).isin(list(fields))).select("*", *[empty[n].alias(n) for n in outputs])]
        for target, given in fields.items():
            right = self.table(target).select(F.col(SOURCES[target].key).alias("_key"), *[F.col(given[n]).alias(n) if n in given else empty[n].alias(n) for n in outputs])
            own = df.where(F.col(tag) == target)
            parts.append(own.join(right, own[key] == right["_key"], "left").select(*df.columns, *outputs))
        return reduce(DataFrame.unionByName, parts)
