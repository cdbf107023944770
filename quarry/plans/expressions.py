"""Types of expressions: made of ``part``, whose names hold other types in each row, and all those of the files of ``flows``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import expressions as E
from quarry.operators import flow as W
from quarry.operators import graph as G
from quarry.sources.registry import Registry

from .base import query
from .flows import _F, _P, _RETURNS, _RUN, _files, _held

_KINDS = ("Number", "String", "Boolean")
_FORMS = ("v + w * 2", "(v + w) + F(v, w)", "v = w AND NOT F()", "?(v, w, 1) - 1", "v.Len + 1 > w OR F(1)", "-w + v")

_ADD = "CASE WHEN {0} = 'Number' AND {1} = 'Number' THEN 'Number' WHEN {0} = 'String' THEN 'String' ELSE 'Unknown' END"
_NUMBER = "CASE WHEN {0} = 'Number' THEN 'Number' ELSE 'Unknown' END"
_TRUTH = "CASE WHEN {0} = 'Boolean' THEN 'Boolean' ELSE 'Unknown' END"
_BAD = "CAST({0} = 'Unknown' AS INTEGER)"
_KIND = "['Number', 'String', 'Boolean'][{0} % 3 + 1]"


@query("expr_typing", f"""WITH o AS (SELECT p_partkey, p_partkey % 6 AS form, {_KIND.format('(p_partkey // 6)')} AS v, {_KIND.format('p_size')} AS w, {_KIND.format('length(p_name)')} AS f FROM part),
 i AS (SELECT *, CASE form WHEN 0 THEN {_NUMBER.format('w')} WHEN 1 THEN {_ADD.format('v', 'w')} WHEN 2 THEN {_TRUTH.format('f')} WHEN 3 THEN w WHEN 4 THEN CASE WHEN v = 'String' THEN 'Number' ELSE 'Unknown' END ELSE {_NUMBER.format('w')} END AS m FROM o),
 t AS (SELECT *, CASE form WHEN 0 THEN {_ADD.format('v', 'm')} WHEN 1 THEN {_ADD.format('m', 'f')} WHEN 2 THEN m WHEN 3 THEN {_NUMBER.format('w')} WHEN 4 THEN {_TRUTH.format('f')} ELSE {_ADD.format('m', 'v')} END AS type FROM i)
 SELECT p_partkey, type, CAST({_BAD.format('type')} + CASE form WHEN 3 THEN CAST(v <> 'Boolean' AS INTEGER) ELSE {_BAD.format('m')} END AS INTEGER) AS problems FROM t""")
def expr_typing(spark, d):
    """Sums, comparisons, choices, members and calls of names whose types hang on the row, and how often operands don't fit."""
    part = Registry(spark, d).table("part")
    kind = lambda n: F.element_at(F.array(*map(F.lit, _KINDS)), (n % 3 + 1).cast("int"))
    form = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    told = part.select("p_partkey", form.alias("text"), kind(F.expr("p_partkey div 6")).alias("v"), kind(F.col("p_size")).alias("w"), kind(F.length("p_name")).alias("f"))
    pair = lambda name: F.struct(F.lit(name).alias("name"), F.col(name).alias("type"))
    names = told.select("p_partkey", F.inline(F.array(pair("v"), pair("w"))))
    calls = told.select("p_partkey", F.lit("F").alias("name"), F.col("f").alias("type"))
    members = spark.createDataFrame([("String", "Len", "property", "Number")], "owner string, name string, kind string, type string")
    return E.with_types(told.select("p_partkey", "text"), ["p_partkey"], names, calls, members).select("p_partkey", "type", F.size("problems").alias("problems"))


_NEXT = "coalesce((SELECT t FROM r WHERE r.path = '/parts/' || (p_partkey + 1) || '.bsl'), 'Unknown')"


@query("expr_types_files", f"""WITH r AS (SELECT path, array_to_string(list_sort(list_distinct(list(type))), '|') AS t FROM ({_RETURNS}) WHERE routine LIKE 'Price%' AND CAST(substr(routine, 6) AS BIGINT) IN (SELECT p_partkey FROM part WHERE p_size % 3 = 0) GROUP BY path)
 SELECT {_P}, {_F} AS routine, l.line, l.type, l.problems FROM part, (VALUES (3, 'Number', 0), (4, 'Number', 0), (5, 'Boolean', 0), (6, 'String', 0), (7, 'String', 0), (8, 'Boolean', 0), (9, 'Boolean', 0), (14, 'Unknown', 1), (15, 'Date', 0)) l(line, type, problems)
 UNION ALL SELECT {_P}, {_F}, 11, 'Date', 0 FROM part WHERE p_size % 5 <> 0
 UNION ALL SELECT {_P}, {_F}, 17, CASE p_size % 3 WHEN 0 THEN {_NEXT} WHEN 1 THEN 'Number' ELSE CASE p_size % 2 WHEN 0 THEN 'String' ELSE 'Number' END END, 0 FROM part
 UNION ALL SELECT {_P}, {_RUN}, l.line, 'Unknown', CASE l.line WHEN 21 THEN 1 WHEN 24 THEN CAST(p_size % 6 = 0 AS INTEGER) ELSE 0 END FROM part, (VALUES (21), (22), (23), (24)) l(line)
 UNION ALL SELECT {_P}, 'Kind', 27, CASE p_size % 2 WHEN 0 THEN 'String' ELSE 'Number' END, 0 FROM part UNION ALL SELECT '/common.bsl', 'Common', 2, 'Date', 0""")
def expr_types_files(spark, d):
    """Every value, returned value and condition of all files, from what reaches its names and what its calls return."""
    rows = G.cut(E.told(W.placed_lines(_files(spark, d))))
    _, names, returns = _held(rows, E.points(rows))
    members = spark.createDataFrame([], "owner string, name string, kind string, type string")
    return E.in_files(rows, None, returns, members, names=names).select("path", "routine", "line", "type", F.size("problems").alias("problems"))
