"""Module analysis moves no lines before they are needed, whatever names are called often and however deep blocks nest."""

from __future__ import annotations

import random

from quarry.operators import analysis, expressions, flow, graph
from quarry.plans.base import QUERIES


def _files(spark, *texts):
    return spark.createDataFrame([(f"/{k}", text) for k, text in enumerate(texts)], "path string, content string")


def test_blocks_move_nothing(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(flow, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    text = "Function F(a,\n  b) Export\n  x = 1 +\n\n    2; // two\n  If a Then\n    x = \"a // b\";\n  Else\n    y = x;\n  EndIf;\n  Return x;\nEndFunction\nz = 1;"
    got = flow.blocks(_files(spark, text)).collect()
    assert len(plans) == 1 and "Exchange" not in plans[0]
    assert [(r.line, r.code.strip(), r.routine, r.kind, [tuple(p) for p in r.place]) for r in got] == [
        (1, "Function F(a, b) Export", "F", None, []), (3, "x = 1 + 2;", "F", None, []), (4, "", "F", None, []), (6, "If a Then", "F", "open", []), (7, 'x = "a // b";', "F", None, [(6, 6)]),
        (8, "Else", "F", "branch", []), (9, "y = x;", "F", None, [(6, 8)]), (10, "EndIf;", "F", "close", []), (11, "Return x;", "F", None, []), (12, "EndFunction", "F", None, []), (13, "z = 1;", None, None, []),
    ]


def test_long_lines(spark):
    text = "x = 1" + " + 1" * 20_000 + "; // end"
    assert analysis.lines(_files(spark, text)).first().code == text.removesuffix("// end")


def test_often_called_names(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW_ROWS", 3)
    own = "Function F() Export\n  Return 1;\nEndFunction"
    callers = [f"Function G{k}()\n  x = {'F' if k < 6 else 'H' if k < 8 else 'Nowhere'}();\n  y = x;\n  Return y;\nEndFunction" for k in range(10)]
    rows = flow.blocks(_files(spark, own, "Function H() Export\n  Return \"s\";\nEndFunction", *callers))
    returns = flow.return_types(flow.direct_returns(rows, flow.typed_assignments(rows)), flow.declared(rows))
    got = {(r.routine, r.variable): r.type for r in flow.typed_assignments(rows, returns).collect()}
    assert got == {(f"G{k}", v): "Number" if k < 6 else "String" if k < 8 else "Unknown" for k in range(10) for v in "xy"}
    calls = spark.createDataFrame([(f"/{k + 2}", None if k % 2 else "F") for k in range(10)], "path string, callee string")
    found = flow.find_callees(calls, flow.declared(rows))
    assert sorted((r.path, r.callee, r.callee_path) for r in found.collect()) == sorted((f"/{k + 2}", None if k % 2 else "F", None if k % 2 else "/0") for k in range(10))
    # What is no call meets no routine.
    monkeypatch.setattr(graph, "FEW_ROWS", 100)
    assert flow.find_callees(calls, flow.declared(rows))._jdf.queryExecution().optimizedPlan().toString().count("isnotnull(callee") >= 1


def test_deep_blocks_with_else(spark):
    deep = 9
    text = "Function F(a)\n  x = 0;\n" + "If a Then\n  x = 1;\nElse\n" * deep + "x = 2;\n" + "EndIf;\n" * deep + "  Return x;\nEndFunction"
    rows = flow.blocks(_files(spark, text))
    placed = flow.typed_assignments(rows).withColumnRenamed("type", "t").selectExpr("path", "routine", "line", "variable", "place", "concat('T', line) AS type")
    end = rows.where("code LIKE '%Return x%'").selectExpr("path", "routine", "line", "'x' AS variable", "place")
    want = sorted([4 + 3 * k for k in range(deep)] + [3 * deep + 3])
    assert sorted(r["at"] for r in flow.reaching(rows, placed, end, flow.covers(rows)).collect()) == want


def test_what_reaches_names_is_found_once(spark, monkeypatch):
    asked, real = [], flow.reaching
    monkeypatch.setattr(flow, "reaching", lambda *a, **k: asked.append(1) or real(*a, **k))
    assert QUERIES["expr_types_files"](spark, "/root/testdata/sf0.001").columns == ["path", "routine", "line", "type", "problems"]
    assert len(asked) == 1


def _routine(r, lines, told):
    """A routine of nested blocks; ``told`` gets, for each line with a value, its type by a walk along the statements."""

    def values(depth, held):
        for _ in range(r.randrange(1, 4)):
            form = r.random()
            if form < 0.55 or depth == 0:
                name = r.choice("xyz")
                value, types = r.choice([("1", {"Number"}), ('"s"', {"String"}), ("F()", {"Date"}), ("G()", {"Unknown"}), *[(n, held.get(n)) for n in "xyzq"] * 2])
                lines.append(f"{name} = {value};")
                told[len(lines)] = types or {"Unknown"}
                held = held | {name: told[len(lines)]}
            elif form < 0.85:
                ends = []
                for k in range(r.randrange(1, 4)):
                    lines.append("If c > 1 Then" if k == 0 else "ElsIf c > 2 Then")
                    told[len(lines)] = {"Boolean"}
                    ends.append(values(depth - 1, held))
                if r.random() < 0.6:
                    lines.append("Else")
                    ends.append(values(depth - 1, held))
                else:
                    ends.append(held)
                lines.append("EndIf;")
                held = {n: set().union(*[e.get(n, set()) for e in ends]) for n in set().union(*ends)}
            else:
                lines.append("While c < 1 Do")
                once = values(depth - 1, held)
                lines.append("EndDo;")
                held = {n: held.get(n, set()) | once.get(n, set()) for n in {*held, *once}}
        return held

    lines.append(f"Function R{len(lines)}(c)")
    held = values(3, {})
    lines.append("Return x;")
    told[len(lines)] = held.get("x") or {"Unknown"}
    lines.append("EndFunction")


def test_random_blocks_against_a_walk(spark):
    r, texts, wanted = random.Random(7), ["Function F() Export\nReturn '20240101';\nEndFunction"], {("/0", 2): "Date"}
    for k in range(1, 13):
        lines, told = [], {}
        for _ in range(6):
            _routine(r, lines, told)
        texts.append("\n".join(lines))
        wanted |= {(f"/{k}", line): "|".join(sorted(types)) for line, types in told.items()}
    rows = graph.cut(expressions.told(flow.placed_lines(_files(spark, *texts))))
    names = flow.held(rows, flow.covers(rows), expressions.points(rows))
    returns = flow.return_types(flow.direct_returns(rows, names=names), flow.declared(rows))
    members = spark.createDataFrame([], "owner string, name string, kind string, type string")
    got = expressions.in_files(rows, None, returns, members, names=names).collect()
    assert len(got) == len(wanted) and {(g.path, g.line): g.type for g in got} == wanted
    # The assignments' own types, and those of routines by either way.
    kept = {}
    for a in flow.typed_assignments(rows, returns, names=names).collect():
        kept.setdefault((a.path, a.line), set()).add(a.type)
    assert kept and all("|".join(sorted(types)) == wanted[at] for at, types in kept.items())
    plain = flow.blocks(_files(spark, *texts))
    other = flow.return_types(flow.direct_returns(plain, flow.typed_assignments(plain)), flow.declared(plain))
    rounded = lambda df: sorted((t.path, t.routine, t.type, round(t.weight, 6)) for t in df.collect())
    assert rounded(returns) == rounded(other)
