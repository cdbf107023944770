"""Types of expressions: random expressions against a recursive reading in plain Python, and texts of every odd form."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quarry.operators import expressions as E
from quarry.operators import flow as W

HELD = {"a": "Number", "b": "String", "c": "Boolean", "d": "Number|String"}
BACK = {"Sum": "Number", "Name": "String", "Имя": "String"}
MEMBERS = [("Number", "Size", "property", "Number"), ("String", "Upper", "method", "String"), ("String", "Owner", "property", "Person"), ("Person", "Known", "property", "Boolean")]
U = "Unknown"


def leaf(r):
    form = r.randrange(8)
    if form < 2:
        return r.choice([("1", "Number"), ("2.50", "Number"), ('"x + (""y"" AND 1"', "String"), ("'20240101'", "Date"), ("True", "Boolean"), ("ложь", "Boolean"), ("Undefined", "Undefined"), ("Null", "Null"), ("New Array", "Array"), ("Новый Map(1, a)", "Map")])
    if form < 5:
        name = r.choice([*HELD, "unheard"])
        return name, HELD.get(name, U)
    return r.choice([("a.Size", "Number"), ("b . Owner.Known", "Boolean"), ("b.Upper()", "String"), ("b.Upper(1, c).Upper", U), ("a[1 + a]", U), ("Sum(b, 1)", "Number"), ("Имя( )", "String"), ("Other(a)", U), ("(a).Size", U)])


def both(x, y, wanted, problem, wrong):
    if x == y == wanted:
        return wanted
    wrong.append(problem)
    return U


def atom(r, depth, wrong):
    """An operand with its type: a leaf, a bracket or a choice."""
    form = r.randrange(6) if depth else 0
    if form == 4:
        text, t = tree(r, depth - 1, wrong)
        return f"({text})", t
    if form == 5:
        parts = [tree(r, depth - 1, wrong)]
        if parts[0][1] != "Boolean":
            wrong.append(E.CONDITION)
        parts += [tree(r, depth - 1, wrong) for _ in range(2)]
        return f"?({', '.join(p for p, _ in parts)})", parts[1][1]
    return leaf(r)


def product(r, depth, wrong):
    text = t = None
    for k in range(r.choice([1, 1, 1, 2, 3])):
        minus = r.random() < 0.1
        own, o = atom(r, depth, wrong)
        if minus and o != "Number":
            wrong.append(E.SIGN)
            o = U
        own = f"-{own}" if minus else own
        text, t = (own, o) if not k else (f"{text} {r.choice('*/%')} {own}", both(t, o, "Number", E.ARITHMETIC, wrong))
    return text, t


def total(r, depth, wrong):
    text, t = product(r, depth, wrong)
    for _ in range(r.choice([0, 0, 1, 2])):
        sign = r.choice("++-")
        own, o = product(r, depth, wrong)
        text, t = f"{text}{sign} {own}", "String" if t == "String" and sign == "+" else both(t, o, "Number", E.ARITHMETIC, wrong)
    return text, t


def term(r, depth, wrong):
    denied = r.random() < 0.2
    text, t = total(r, depth, wrong)
    if r.random() < 0.5:
        own, _ = total(r, depth, wrong)
        text, t = f"{text} {r.choice(['=', '<>', '<', '>=', '<=', '>'])} {own}", "Boolean"
    if denied:
        text = f"{r.choice(['NOT', 'не'])} {text}"
        if t != "Boolean":
            wrong.append(E.NEGATION)
            t = U
    return text, t


def conjunction(r, depth, wrong):
    text, t = term(r, depth, wrong)
    for _ in range(r.choice([0, 0, 0, 1])):
        own, o = term(r, depth, wrong)
        text, t = f"{text} {r.choice(['AND', 'и'])} {own}", both(t, o, "Boolean", E.LOGIC, wrong)
    return text, t


def tree(r, depth, wrong):
    text, t = conjunction(r, depth, wrong)
    for _ in range(r.choice([0, 0, 0, 1])):
        own, o = conjunction(r, depth, wrong)
        text, t = f"{text} {r.choice(['OR', 'ИЛИ'])} {own}", both(t, o, "Boolean", E.LOGIC, wrong)
    return text, t




def test_random_expressions(spark):
    r = random.Random(31)
    rows, wanted = [], {}
    for k in range(400):
        wrong = []
        text, t = tree(r, k % 4, wrong)
        rows.append((k, text))
        wanted[k] = (t, sorted(wrong))
    keys = spark.createDataFrame([(k,) for k, _ in rows], "k int")
    named = lambda held: keys.crossJoin(F.broadcast(spark.createDataFrame(list(held.items()), "name string, type string")))
    held = {n: t for n, t in HELD.items() if "|" not in t} | {"d": "Number"}
    names = named(held).unionByName(named({"d": "String"}))
    members = spark.createDataFrame(MEMBERS, "owner string, name string, kind string, type string")
    got = E.with_types(spark.createDataFrame(rows, "k int, text string"), ["k"], names, named(BACK), members).collect()
    assert len(got) == len(rows)
    for row in got:
        assert (row.type, sorted(row.problems)) == wanted[row.k], row.text


def test_odd_texts(spark):
    texts = {
        "": (U, []), "   ": (U, []), "1 +": (U, [E.ARITHMETIC]), "(1": ("Number", []), "((1 + 2": ("Number", []), "1)": ("Number", []), ")) 1": ("Number", []), "()": (U, []), "-+-1": ("Number", []), "?()": (U, []), "?(1,)": (U, [E.CONDITION]),
        '"open': ("String", []), "f(": (U, []), "андрей": (U, []), "and1": (U, []), "NOT NOT True": ("Boolean", []), "@ # 1": ("Number", []), "1 " + "+ 1 " * 3000: ("Number", []), "(" * 300 + "1" + ")" * 300: ("Number", []), '"' + "q" * 200000 + '"': ("String", []),
    }
    df = spark.createDataFrame([(k,) for k in [*texts, None]], "text string").select("text", E.typed(F.col("text"), F.create_map().cast("map<string,string>")).alias("t"))
    for row in df.collect():
        assert (row.t and (row.t.type, row.t.problems)) == texts.get(row.text), row.text and row.text[:50]


def test_no_rows(spark):
    none = lambda columns: spark.createDataFrame([], columns)
    got = E.with_types(none("k int, text string"), ["k"], none("k int, name string, type string"), none("k int, name string, type string"), none("owner string, name string, kind string, type string"))
    assert got.columns == ["k", "text", "type", "problems"] and not got.collect()


def test_expressions_of_files(spark):
    text = "\n".join(["Function F(p) Export", "  x = 1;", '  If p Then', '    x = "a";', "  EndIf;", "  y = x;", "  z = G() + 2;", "  If z > 1 AND NOT y Then", "    Return z.Size * 2;", "  EndIf;", "  x = 3;", "  Return x + G();", "EndFunction", "Function G()", "  Return 2;", "EndFunction"])
    files = spark.createDataFrame([("/a", text), ("/b", text.replace("Return 2", 'Return "2"')), ("/empty", ""), ("/null", None)], "path string, content string")
    rows = W.blocks(files)
    returns = W.return_types(W.direct_returns(rows, W.typed_assignments(rows)), W.declared(rows))
    placed = W.typed_assignments(rows, returns)
    members = spark.createDataFrame([("Unknown", "Size", "property", "Number")], "owner string, name string, kind string, type string").where("owner = 'none'")
    got = {(r.path, r.line): (r.text, r.type, r.problems) for r in E.in_files(rows, placed, returns, members).collect()}
    assert got["/a", 6] == ("x", "Number|String", [])
    assert got["/a", 7] == ("G() + 2", "Number", []) and got["/b", 7] == ("G() + 2", "String", [])
    assert got["/a", 8][1:] == (U, [E.NEGATION, E.LOGIC])
    assert got["/a", 9][1:] == (U, [E.ARITHMETIC])
    assert got["/a", 12][1:] == ("Number", []) and got["/b", 12][1:] == (U, [E.ARITHMETIC])
    assert {p for p, _ in got} == {"/a", "/b"} and len(got) == 20
