"""Operators on small literal tables with known results."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.operators import analysis, flow, graph, metrics, registers, repository, search, unions
from quarry.sources import markup


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def merged(inputs):
    """A union of inputs (types by weight, or None, and a confidence) by the rules, plainly."""
    if len(inputs) == 1:
        return inputs[0][0] or {}, inputs[0][1]
    sums = {}
    for types, _ in inputs:
        for t, w in (types or {}).items():
            sums[t] = sums.get(t, 0) + w / len(inputs)
    for kind in ("Number", "String"):
        if sums and all(t.split("(")[0] == kind for t in sums):
            sums = {kind: sum(sums.values())}
            break
    else:
        sums = {t: w for t, w in sums.items() if round(w, 9) >= 0.05}
        total = sum(sums.values())
        sums = dict(sorted(((t, w / total) for t, w in sums.items()), key=lambda x: (-round(x[1], 9), x[0]))[:5])
    mean = sum(c for _, c in inputs) / len(inputs)
    return sums, min(mean, 0.9) if len(sums) > 1 else mean


def test_unions_of_generated_inputs(spark):
    """Plain types, unions and open results, one and many; numbers alone and strings alone."""
    rng = random.Random(21)
    cases = {}
    for k in range(120):
        pool = [["Number", "Number(10,2)", "Number(5)"], ["String", "String(9)"], [f"type{n}" for n in range(9)] + ["Number(5)", "String"]][k % 3]
        inputs = []
        for _ in range(rng.choice([1, 2, 3, 8, 20])):
            chosen = rng.sample(pool, rng.choice([0, 1, 1, 2]))
            parts = [rng.randrange(1, 99) for _ in chosen]
            inputs.append(({t: p / sum(parts) for t, p in zip(chosen, parts, strict=True)} or None, rng.randrange(0, 101) / 100))
        cases[k] = inputs
    table = [(k, n, t, w, c) for k, inputs in cases.items() for n, (types, c) in enumerate(inputs) for t, w in (types or {None: 0.0}).items()]
    got = {}
    for r in unions.combine(spark.createDataFrame(table, "k int, one int, type string, weight double, sure double").repartition(7), ["k"], "one", "sure").collect():
        got.setdefault(r.k, ({}, r.certainty))[0][r.type] = r.weight
    for k, inputs in cases.items():
        types, sure = merged(inputs)
        assert got.get(k, ({}, None))[0] == pytest.approx(types, abs=1e-8), inputs
        assert not types or got[k][1] == pytest.approx(sure, abs=1e-9)


def test_certainty_is_exact(spark):
    """A mean that ends in a five is the same in any order of rows."""
    table = spark.createDataFrame([(1, "t", k / 100) for k in [50] * 79 + [30]], "k int, type string, c double")
    for n in (1, 4, 13):
        assert unions.create(table.repartition(n), ["k"], "c").first().certainty == 0.4975


def test_unions_by_rows(spark):
    rng = random.Random(22)
    table = [(rng.randrange(9), rng.choice("pqrstuv"), rng.randrange(1, 100) / 100) for _ in range(200)]
    frame = spark.createDataFrame(table, "k int, type string, weight double")
    sums = {}
    for k, t, w in table:
        sums[k, t] = sums.get((k, t), 0) + w
    assert {(r.k, r.type): r.weight for r in unions.normalize(frame, ["k"]).collect()} == pytest.approx(sums)
    likely = {k: min((-round(w, 9), t) for (j, t), w in sums.items() if j == k)[1] for k, _ in sums}
    assert {r.k: r.likely for r in unions.look_up(unions.normalize(frame, ["k"]), ["k"], "p").collect()} == likely
    assert unions.create(frame.limit(0), ["k"], "weight").count() == 0


def distance(a, b):
    """Edits by the plain table, row by row."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_distances_of_random_words(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcжщé") for _ in range(rng.randrange(8))) for _ in range(300)]
    pairs = list(zip(words[::2], words[1::2], strict=True))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.levenshtein("a", "b")).collect()
    assert sorted(map(tuple, got)) == sorted((a, b, distance(a, b)) for a, b in pairs)


def test_similarity_of_random_words(spark):
    rng = random.Random(13)
    words = ["".join(rng.choice("abж") for _ in range(rng.randrange(1, 7))) for _ in range(120)]
    got = spark.createDataFrame([(w,) for w in words], "term string").select("term", search.similarity(F.col("term"), F.lit("aBж")).alias("s"), search.match_class(F.col("term"), F.lit("aBж")).alias("c")).collect()
    for term, s, c in got:
        d, near = distance(term, "abж"), 1 - distance(term, "abж") / max(len(term.encode()), 4)
        want = (1.0, "exact") if term == "abж" else (0.95, "prefix") if term.startswith("abж") else (0.8, "contains") if "abж" in term else (near, "fuzzy") if d <= 3 and near >= 0.6 else (None, None)
        assert (s, c) == (pytest.approx(want[0]) if want[0] else None, want[1]), term


def test_search_options(spark):
    docs = spark.createDataFrame([(1, "red ring", "the ring"), (2, "blue bolt", None), (3, None, "")], "id int, name string, about string")
    index = search.postings(docs, "id", {"name": 3.0, "about": 1.0})
    assert rows(search.search_exact(index, ["ring", "Ring"]), "doc_id", "score") == [(1, 8.0)]
    assert rows(search.search(index, ["blot"]), "doc_id") == []
    assert rows(search.search(index, ["bolt"], fuzzy=False), "doc_id", "score") == [(2, 3.0)]
    with pytest.raises(ValueError, match="page"):
        search.page(docs, 0, 10, [F.col("id")], first=1)


def test_graphs_by_brute_force(spark):
    rng = random.Random(5)
    for n, m in ((12, 14), (15, 30), (9, 6)):
        pairs = sorted({(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(m)})
        edges = spark.createDataFrame(pairs, "src string, dst string")
        nodes = sorted({v for p in pairs for v in p})
        far = {a: {a: 0} for a in nodes}
        for a in nodes:
            waiting = [a]
            for v in waiting:
                for x, y in pairs:
                    if x == v and y not in far[a]:
                        far[a][y] = far[a][v] + 1
                        waiting.append(y)
        assert rows(graph.reach(edges, spark.createDataFrame([(a,) for a in nodes], "start string")), "start", "node", "depth") == sorted((a, b, d) for a in nodes for b, d in far[a].items())
        on = {v for v in nodes if any(y in far and v in far[y] for x, y in pairs if x == v)}
        assert rows(graph.cycles(edges), "node", "cycle") == sorted((v, min(w for w in on if w in far[v] and v in far[w])) for v in on)
        goal = max(far[nodes[0]], key=lambda v: (far[nodes[0]][v], v))
        path = [r.node for r in graph.shortest_path(edges, nodes[0], goal).orderBy("place").collect()]
        assert len(path) == far[nodes[0]][goal] + 1 and all(p in pairs for p in zip(path, path[1:]))
        after = {v for v in nodes if any(v in far[w] for w in on)}
        level = {}
        for _ in nodes:
            level |= {v: max([level[x] + 1 for x, y in pairs if y == v], default=0) for v in nodes if v not in after and all(x in level for x, y in pairs if y == v)}
        assert rows(graph.levels(edges).fillna(-1), "node", "level") == sorted((v, level.get(v, -1)) for v in nodes)


def test_totals_and_slices(spark):
    t = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 4.0)], "g string, h string, v double")
    got = rows(registers.totals(t, ["g"], ["v"], overall=True).na.fill("-"), "g", "h", "v", "_level")
    assert got == [("-", "-", 7.0, 0), ("a", "-", 3.0, 1), ("a", "x", 1.0, 2), ("a", "y", 2.0, 2), ("b", "-", 4.0, 1), ("b", "x", 4.0, 2)]
    r = spark.createDataFrame([("k", 1, 10), ("k", 2, 20), ("k", 2, 30), ("n", None, 5)], "d string, p int, v int")
    assert rows(registers.slice_last(r, "p", ["d"], F.lit(2), ("v",)), "d", "v") == [("k", 30)]


def test_repository(spark):
    """Stats and look-ups over made-up rows, against the same rules in Python."""
    made = [(str(k), f"Ящик{k}", f"Box{k}", ("Platform", "Configuration", "UserDefined")[k % 3], [f"c{k % 2}"] if k % 4 else [], [f"open{k}"], ["size"], ["Object"]) for k in range(20)]
    t = spark.createDataFrame(made, "id string, name string, alt_name string, source string, category_path array<string>, methods array<string>, properties array<string>, facets array<string>")
    assert repository.stats(t).first().asDict() == {"total": 20, "platform": 7, "configuration": 7, "user_defined": 6}
    assert {r.id for r in t.where(repository.Filter(source="Configuration").predicate()).collect()} == {m[0] for m in made if m[3] == "Configuration"}
    assert {r.id for r in repository.find(t, "ящик1").collect()} == {m[0] for m in made if "ящик1" in m[1].lower()}
    assert ("7", "Ящик7") in rows(repository.look_up(t, "Ящик7"), "id", "name")
    assert rows(repository.completions(t, "Ящик3."), "label", "kind") == [("open3", "method"), ("size", "property")]


def test_cache(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    put = repository.cache_put(old, spark.createDataFrame([("b", 3), ("c", 4)], "key string, v int"), ["key"])
    assert rows(put, "key", "v") == [("a", 1), ("b", 3), ("c", 4)]
    assert rows(repository.cache_drop(put, old.select("key")), "key") == [("c",)]


def test_file_rules(spark):
    paths = spark.createDataFrame([("/x/CommonModules/a.bsl",), ("/x/Catalogs/b.bsl",), ("/x/Reports/c.bsl",), ("d.bsl",)], "path string")
    got = paths.select(metrics.path_priority(F.col("path")), metrics.parent_folder(F.col("path"))).collect()
    assert [tuple(r) for r in got] == [(1, "CommonModules"), (2, "Catalogs"), (3, "Reports"), (4, "Common")]


def test_periods(spark):
    t = spark.sql("SELECT timestamp_ntz'2024-02-10 11:12:13' AS t")
    (row,) = t.select(*[scalars.end_of_period(F.col("t"), u).cast("string").alias(u) for u in scalars.UNITS]).collect()
    assert row.month == "2024-02-29 23:59:59" and row.quarter == "2024-03-31 23:59:59" and row.day == "2024-02-10 23:59:59" and row.week == "2024-02-11 23:59:59"
    with pytest.raises(ValueError, match="unit"):
        scalars.begin_of_period(F.col("t"), "decade")


CODE = '''// a module
Функция Сумма(А, Знач Б = 1) Экспорт
    Если А > 0 Тогда
        Возврат А + Б; // not "a // string"
    КонецЕсли;
    Возврат "нет // " + А;
КонецФункции

Procedure Main()
    x = Сумма(1, 2, 3);
    x = "text";
    y = 5;
    y = New Array;
    Unknown(x);
EndProcedure
'''


def test_modules(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.bsl").write_text(CODE)
    (tmp_path / "b.os").write_text("Procedure P()\nEndProcedure")
    (tmp_path / "c.txt").write_text("no module")
    files = analysis.source_files(spark, str(tmp_path))
    assert files.count() == 2
    files = files.where(F.col("path").endswith("a.bsl"))
    assert rows(analysis.routines(files), "name", "kind", "n_parameters", "exported") == [("Main", "procedure", 0, False), ("Сумма", "function", 2, True)]
    assert rows(analysis.call_edges(files), "caller", "callee") == [("Main", "Unknown"), ("Main", "Сумма")]
    assert rows(analysis.returns(files), "routine", "types") == [("Main", "Void"), ("Сумма", "String|Unknown")]
    assert rows(analysis.flow_types(files), "variable", "types") == [("x", "String|Unknown"), ("y", "Array|Number")]
    found = {(r.severity, r.message) for r in analysis.diagnostics(files).collect()}
    assert found == {("error", "Сумма takes 2 arguments, not 3"), ("info", "Unknown is not declared here"), ("warning", "y was Number and becomes Array")}
    assert ("Main", "Сумма", "call") in rows(analysis.dependency_edges(files), "src", "dst", "kind")


FLOW = """Перем общее;
Функция Выбор(а, б)
    з = 1;
    Если а = Неопределено Тогда
        з = "т";
        Если б Тогда
            з = Истина;
        Иначе
            з = '20240101';
        КонецЕсли;
    Иначе
        н = з;
    КонецЕсли;
    Возврат з;
КонецФункции
Процедура Старт()
    в = Выбор(1, 2);
    г = в;
    общее = нет + 1;
КонецПроцедуры"""


def test_flow(spark):
    """Nested branches: an inner block whose branches all assign hides what came before it, an outer one without does not."""
    files = spark.createDataFrame([("a.bsl", FLOW)], "path string, content string")
    found = flow.blocks(files)
    placed = flow.typed_assignments(found)
    at = {(r.line, r.variable, r.type): round(r.weight, 3) for r in flow.states(found, placed).collect()}
    assert {k: v for k, v in at.items() if k[:2] == (10, "з")} == {(10, "з", "Boolean"): 0.5, (10, "з", "Date"): 0.5}
    assert {k: v for k, v in at.items() if k[:2] == (13, "з")} == {(13, "з", t): 0.333 for t in ("Boolean", "Date", "Number")}
    assert at[13, "н", "Number"] == 1.0
    returns = flow.return_types(flow.direct_returns(found, placed), flow.declared(found))
    assert {(r.routine, r.type, round(r.weight, 3)) for r in returns.collect()} == {("Выбор", "Boolean", 0.333), ("Выбор", "Date", 0.333), ("Выбор", "Number", 0.333), ("Старт", "Void", 1.0)}
    again = flow.typed_assignments(found, returns)
    assert {r.type for r in again.where("variable = 'г'").collect()} == {"Boolean", "Date", "Number"}
    assert rows(flow.undeclared(found), "line", "message") == [(19, "нет is not declared")]


def returned(found):
    return flow.return_types(flow.direct_returns(found, flow.typed_assignments(found)), flow.declared(found))


def test_names_take_what_stood_there(spark):
    """A name's value is what its source had then, through chains longer than any round count, though the source changes later."""
    chain = ["Function F()", "v0 = 1;", *[f"v{k} = v{k - 1};" for k in range(1, 40)], 'v0 = "later";', "last = v39;", "Return last;", "EndFunction"]
    found = flow.blocks(spark.createDataFrame([("a", "\n".join(chain))], "path string, content string"))
    placed = flow.typed_assignments(found)
    assert {r.type for r in placed.where("variable IN ('v39', 'last')").collect()} == {"Number"}
    assert [(r.type, r.weight) for r in returned(found).collect()] == [("Number", 1.0)]


def test_many_ways_through_calls(spark):
    """Forty diamonds have 2^40 ways; weights are merged where they meet."""
    text = "".join(f"Function A{k}()\nIf q Then\nReturn B{k}();\nEndIf;\nReturn C{k}();\nEndFunction\nFunction B{k}()\nReturn A{k + 1}();\nEndFunction\nFunction C{k}()\nReturn A{k + 1}();\nEndFunction\n" for k in range(40))
    text += 'Function A40()\nIf q Then\nReturn 1;\nEndIf;\nReturn "s";\nEndFunction'
    got = {(r.routine, r.type): r.weight for r in returned(flow.blocks(spark.createDataFrame([("a", text)], "path string, content string"))).collect()}
    assert got["A0", "Number"] == pytest.approx(0.5) and got["B39", "String"] == pytest.approx(0.5) and len(got) == 2 * 121


def test_routines_of_one_name(spark):
    """Each file keeps its own; a name that one file exports is found from elsewhere, one that two export is not."""
    files = [
        ("/a", "Function F()\nReturn 1;\nEndFunction\nFunction G()\nReturn F();\nEndFunction\nFunction Two() Export\nReturn 1;\nEndFunction"),
        ("/b", 'Function F()\nReturn "a";\nEndFunction\nFunction G()\nReturn F();\nEndFunction\nFunction Two() Export\nReturn 1;\nEndFunction\nFunction One(x) Export\nReturn True;\nEndFunction'),
        ("/c", "Function H()\nReturn F();\nEndFunction\nFunction I()\nReturn One(1);\nEndFunction\nFunction J()\nReturn Two();\nEndFunction\nProcedure K()\nOne(1, 2);\nTwo(1);\nF(1);\nEndProcedure"),
    ]
    table = spark.createDataFrame(files, "path string, content string")
    found = flow.blocks(table)
    got = {(r.path, r.routine): (r.type, r.weight) for r in returned(found).collect()}
    assert {k: v for k, v in got.items() if k[1] in "FGHIJ"} == {
        ("/a", "F"): ("Number", 1.0), ("/a", "G"): ("Number", 1.0), ("/b", "F"): ("String", 1.0), ("/b", "G"): ("String", 1.0),
        ("/c", "H"): ("Unknown", 1.0), ("/c", "I"): ("Boolean", 1.0), ("/c", "J"): ("Unknown", 1.0),
    }
    assert rows(flow.arity(table), "path", "message") == [("/c", "One takes 1 arguments, not 2")]
    calls = {(r.caller_path, r.caller, r.callee_path, r.callee) for r in flow.call_graph(found).where("way = 'out'").collect()}
    assert {("/a", "G", "/a", "F"), ("/b", "G", "/b", "F"), ("/c", "H", None, "F"), ("/c", "I", "/b", "One"), ("/c", "K", None, "Two")} <= calls


def test_rings_of_calls(spark):
    """Rings of three behind and before a chain: a call within a ring is followed one step."""
    text = "".join(f"Function R{k}()\nIf q Then\nReturn R{(k + 1) % 3}();\nEndIf;\nReturn S{k}();\nEndFunction\nFunction S{k}()\nReturn {['1', chr(34) + chr(34), 'True'][k]};\nEndFunction\n" for k in range(3))
    text += "Function Self()\nReturn Self();\nEndFunction\nFunction Use()\nReturn R0();\nEndFunction"
    got = {(r.routine, r.type): r.weight for r in returned(flow.blocks(spark.createDataFrame([("a", text)], "path string, content string"))).collect()}
    own = ["Number", "String", "Boolean"]
    for k in range(3):
        assert {t: w for (r, t), w in got.items() if r == f"R{k}"} == {own[k]: 0.5, own[(k + 1) % 3]: 0.25, "Unknown": 0.25}
    assert {t: w for (r, t), w in got.items() if r == "Use"} == {"Number": 0.5, "String": 0.25, "Unknown": 0.25} and got["Self", "Unknown"] == 1.0


def test_nesting_of_any_depth(spark):
    deep = 60
    text = "\n".join(["Procedure P()", *["If a Then"] * deep, "x = 1;", *["Else\ny = 2;\nEndIf;"] * deep, "EndProcedure", "EndIf;", "Else"])
    got = {r.line: [tuple(p) for p in r.place] for r in flow.blocks(spark.createDataFrame([("a", text)], "path string, content string")).collect()}
    assert got[deep + 2] == [(k, k) for k in range(2, deep + 2)]
    assert got[deep + 4] == [(k, k) for k in range(2, deep + 1)] + [(deep + 1, deep + 3)] and got[1] == []


def test_statements_over_lines(spark):
    """Arguments, conditions and heads that go on are one statement on the first line; lines without their semicolon end where a block's word begins."""
    text = "Function F(a,\n    b) Export // head\nx = Sum(1,\n\n  2); // two\nIf a\n  And b\nThen\n  y = 1\nEndIf;\nReturn\n  x;\nEndFunction\nProcedure G(\nc,\nd)\ny = 2;\nEndProcedure"
    table = spark.createDataFrame([("a", text)], "path string, content string")
    got = {r.line: r.code.strip() for r in analysis.statements(analysis.lines(table)).collect() if r.code.strip()}
    assert got == {1: "Function F(a, b) Export", 3: "x = Sum(1, 2);", 6: "If a And b Then", 9: "y = 1", 10: "EndIf;", 11: "Return x;", 13: "EndFunction", 14: "Procedure G( c, d)", 17: "y = 2;", 18: "EndProcedure"}
    assert [(r.routine, r.exported, r.n_parameters) for r in flow.declared(flow.blocks(table)).collect()] == [("F", True, 2), ("G", False, 2)]


def test_long_paths(spark):
    """A path of many steps takes its own type, not that of a beginning."""
    members = spark.createDataFrame([(f"T{k}", "next", "property", f"T{k + 1}") for k in range(200)], "owner string, name string, kind string, type string")
    paths = spark.createDataFrame([("T0" + ".next" * n,) for n in (0, 1, 25, 130)] + [("T0.none.next",)], "path string")
    assert {r.path.count("."): r.type for r in analysis.resolve_paths(paths.where("path <> 'T0.none.next'"), members).collect()} == {0: "T0", 1: "T1", 25: "T25", 130: "T130"}
    assert analysis.resolve_paths(paths.where("path = 'T0.none.next'"), members).first().type is None


def test_recursion_ends(spark):
    text = "Function A()\n    If q Then\n        Return B();\n    EndIf;\n    Return 1;\nEndFunction\nFunction B()\n    Return A();\nEndFunction\nFunction C()\n    Return None();\nEndFunction"
    found = flow.blocks(spark.createDataFrame([("a", text)], "path string, content string"))
    got = returned(found)
    assert {(r.routine, r.type): round(r.weight, 3) for r in got.collect()} == {("A", "Number"): 0.5, ("A", "Unknown"): 0.5, ("B", "Number"): 0.5, ("B", "Unknown"): 0.5, ("C", "Unknown"): 1.0}


def test_narrowing(spark):
    t = spark.createDataFrame([('TypeOf(x) = Type("Number")',), ("y = Undefined",), ("z <> NULL",), ("q > 1",)], "c string")
    got = [tuple(r) for r in t.select(*analysis.narrowing(F.col("c"))).collect()]
    assert got == [("x", "Number", "not Number"), ("y", "Undefined", "not Undefined"), ("z", "not Null", "Null"), (None, None, None)]


XML = {
    "Configuration.xml": "<MetaDataObject><Configuration><Properties><Name>Demo</Name></Properties><ChildObjects><Language>ru</Language><Catalog>Контрагенты</Catalog><Task>T</Task></ChildObjects></Configuration></MetaDataObject>",
    "Documents/Doc.xml": """<MetaDataObject xmlns="x"><Document uuid="1"><Properties><Name>Doc</Name></Properties><ChildObjects>
<Attribute><Properties><Name>Составное</Name><Type><v8:Type>cfg:CatalogRef.Контрагенты</v8:Type><v8:Type>xs:string</v8:Type></Type></Properties></Attribute>
<Attribute><Properties><Name>Простое</Name><Type><v8:Type>xs:decimal</v8:Type></Type></Properties></Attribute>
<Attribute><Properties><Name>Любое</Name></Properties></Attribute>
<TabularSection><Properties><Name>Товары</Name></Properties><ChildObjects><Attribute><Properties><Name>Ключ</Name><Type><v8:Type>cfg:InformationRegisterRecordKey.Цены</v8:Type></Type></Properties></Attribute></ChildObjects></TabularSection>
</ChildObjects></Document></MetaDataObject>""",
}


def test_configuration_files(spark, tmp_path):
    for name, text in XML.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files = markup.xml_files(spark, str(tmp_path))
    assert rows(markup.root_kind(files), "tag") == [("Configuration",), ("Document",)]
    assert rows(markup.references(files), "tag", "name", "kind") == [("Catalog", "Контрагенты", "Catalog"), ("Task", "T", "DataProcessor")]
    got = rows(markup.attributes(files), "section", "name", "type", "is_composite")
    assert got == [("", "Любое", "Произвольный", False), ("", "Простое", "Число", False), ("", "Составное", "Составной(СправочникСсылка.Контрагенты, Строка)", True), ("Товары", "Ключ", "КлючЗаписиРегистраСведений.Цены", False)]
    objects = spark.createDataFrame([("Doc", "Document"), ("E", "Enum"), ("T", "Report")], "name string, kind string")
    assert markup.expand_facets(objects).count() == 7 and markup.standard_attributes(objects).count() == 3


HTML = """<html><head><script>var t="<p>x</p>"</script></head><body><h1>Массив (Array)</h1><p>A&amp;B <b>collection</b></p><p> </p>
<table><tr><th>Name</th><th>Type</th></tr><tr><td>Size</td><td>Число</td><td>optional</td></tr><tr><td>one cell</td></tr></table>
<ul><li>One</li><li>Two</li></ul><pre>x = 1;</pre><a class="l" href="/a">a</a></body></html>"""


def test_help_pages(spark):
    h = F.col("html")
    df = spark.createDataFrame([(HTML,)], "html string").select(markup.title(h).alias("title"), markup.description(h).alias("about"), markup.texts(h, "li").alias("items"), markup.texts(h, "pre").alias("code"), markup.links(h).alias("links"), markup.parameters(h).alias("parameters"))
    r = df.select("*", *[c.alias(n) for n, c in zip(("ru", "en"), markup.bilingual_title(F.col("title")), strict=True)], markup.facets(F.col("title"), F.col("about")).alias("facets")).first()
    assert (r.title, r.ru, r.en, r.about) == ("Массив (Array)", "Массив", "Array", "A&B collection")
    assert (r["items"], r.code, r.links, r.facets) == (["One", "Two"], ["x = 1;"], ["/a"], ["Collection"])
    assert [tuple(p) for p in r.parameters] == [("Size", "Число", "optional", True)]
