"""Module analysis over source files made of ``nation`` rows, one file each."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import analysis as A
from quarry.sources import markup as M
from quarry.sources.registry import Registry

from .base import query
from .pages import _shared_folder

_CODE = """Function Get%1$d(a, b = 1) Export
    x = %1$d; // comes first
    x = "text %1$d";
    If a > 0 Then
        Return Next%2$d(x);
    EndIf;
    Return "none";
EndFunction

Procedure Run()
    y = Get%1$d(1, 2, 3);
    z = Get%1$d(1);
EndProcedure
"""


def _files(spark, d):
    n = Registry(spark, d).table("nation")
    return n.select(F.concat(F.lit("/m/"), F.col("n_nationkey").cast("string"), F.lit(".bsl")).alias("path"), F.format_string(_CODE, "n_nationkey", "n_regionkey").alias("content"))


_PATH = "'/m/' || n_nationkey || '.bsl' AS path"


_EXTENSION = "['.bsl', '.os', '.txt', '.BSL'][s_suppkey % 4 + 1]"


@query("file_discovery", f"SELECT 'n' || s_nationkey || '/m' || s_suppkey || {_EXTENSION} AS path, 'M' || s_suppkey AS routine FROM supplier WHERE s_suppkey % 4 < 2")
def file_discovery(spark, d):
    """Module files found in nested folders among others, and the routine that each declares."""
    k = F.col("s_suppkey")
    ending = F.element_at(F.array(*map(F.lit, (".bsl", ".os", ".txt", ".BSL"))), (k % 4 + 1).cast("int"))
    path = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/m"), k.cast("string"), ending)
    text = F.format_string("Function M%d() Export\nEndFunction\n", k)
    folder = _shared_folder(spark)
    M.write_files(Registry(spark, d).table("supplier").select(path.alias("path"), text.alias("content")), folder)
    found = A.routines(A.source_files(spark, folder))
    return found.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path"), F.col("name").alias("routine"))


@query("routines", f"SELECT {_PATH}, r.name || CASE WHEN r.name = 'Get' THEN CAST(n_nationkey AS VARCHAR) ELSE '' END AS name, r.n_parameters, r.exported FROM nation, (VALUES ('Get', 2, TRUE), ('Run', 0, FALSE)) r(name, n_parameters, exported)")
def routines(spark, d):
    return A.routines(_files(spark, d)).select("path", "name", "n_parameters", "exported")


_CALLS = f"SELECT {_PATH}, c.line, c.caller || CASE WHEN c.caller = 'Get' THEN CAST(n_nationkey AS VARCHAR) ELSE '' END AS caller, c.callee || CASE WHEN c.callee = 'Get' THEN n_nationkey ELSE n_regionkey END AS callee FROM nation, (VALUES (5, 'Get', 'Next'), (11, 'Run', 'Get'), (12, 'Run', 'Get')) c(line, caller, callee)"


@query("call_edges", _CALLS)
def call_edges(spark, d):
    return A.call_edges(_files(spark, d))


@query("ret_types", f"SELECT {_PATH}, 'Get' || n_nationkey AS routine, 'String|Unknown' AS types FROM nation UNION ALL SELECT {_PATH}, 'Run', 'Void' FROM nation")
def ret_types(spark, d):
    return A.returns(_files(spark, d))


@query("expr_types", f"SELECT {_PATH}, a.line, a.variable, a.type FROM nation, (VALUES (2, 'x', 'Number'), (3, 'x', 'String'), (11, 'y', NULL), (12, 'z', NULL)) a(line, variable, type)")
def expr_types(spark, d):
    return A.assignments(_files(spark, d)).select("path", "line", "variable", "type")


@query("dep_edges", f"SELECT DISTINCT path, src, dst, kind FROM (SELECT {_PATH}, 'y' AS src, 'Get' || n_nationkey AS dst, 'call_result' AS kind FROM nation UNION ALL SELECT {_PATH}, 'z', 'Get' || n_nationkey, 'call_result' FROM nation UNION ALL SELECT path, caller, callee, 'call' FROM ({_CALLS}))")
def dep_edges(spark, d):
    return A.dependency_edges(_files(spark, d))


@query("diagnostics", f"SELECT {_PATH}, 11 AS line, 'error' AS severity, 'Get' || n_nationkey || ' takes 2 arguments, not 3' AS message FROM nation UNION ALL SELECT {_PATH}, 5, 'info', 'Next' || n_regionkey || ' is not declared here' FROM nation UNION ALL SELECT {_PATH}, 3, 'warning', 'x was Number and becomes String' FROM nation")
def diagnostics(spark, d):
    return A.diagnostics(_files(spark, d))


@query("narrowing", "SELECT event_id, CASE event_type WHEN 'click' THEN 'Number' WHEN 'view' THEN 'not Undefined' END AS within, CASE event_type WHEN 'click' THEN 'not Number' WHEN 'view' THEN 'Undefined' END AS other FROM events")
def narrowing(spark, d):
    t = F.col("event_type")
    condition = F.when(t == "click", 'TypeOf(v) = Type("Number")').when(t == "view", "v <> Undefined").otherwise("v > 1")
    _, within, other = A.narrowing(condition)
    return Registry(spark, d).table("events").select("event_id", within.alias("within"), other.alias("other"))
