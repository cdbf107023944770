"""What is kept between runs, and structures that spare whole scans, against plain Python on generated cases."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.operators import fuzzy_index, graph, registers, repository, search
from quarry.operators.completion import Completions
from quarry.operators.kept_cache import Cache
from quarry.operators.kept_index import Index
from quarry.operators.period_totals import Totals
from quarry.operators.positions import Ordered
from quarry.sources import markup, metadata
from quarry.sources.versioned import Versioned


def test_versions(spark, tmp_path):
    table = Versioned(spark, str(tmp_path / "t"))
    assert table.version() == 0 and table.manifest() == {}
    first = table.write(spark.range(3))
    assert table.commit({"a": first}, 0) == 1
    other = Versioned(spark.newSession(), str(tmp_path / "t"))
    second = table.write(spark.range(5))
    assert table.commit({"a": second}, 1) == 2 and other.manifest() == {"a": second} and other.manifest(1) == {"a": first}
    with pytest.raises(RuntimeError, match="another"):
        other.commit({"a": first}, 1)
    # A writer that died: data that no version names, and a manifest that was never renamed.
    dead = table.write(spark.range(9))
    (tmp_path / "t/versions/.half").write_text('{"a": ')
    assert other.version() == 2 and other.read("id long", [other.manifest()["a"]]).count() == 5
    assert table.vacuum() == 2 and table.names("data") == [second.removeprefix("data/")] and dead not in table.names("data")


def test_cache_over_sessions(spark, tmp_path):
    """Random puts, invalidations and cleanings against a dictionary; each call from a session of its own."""
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    schema = "a int, b string, v double, at timestamp_ntz"
    want: dict = {}
    open_ = lambda: Cache(spark.newSession(), str(tmp_path / "c"), schema, ["a", "b"], buckets=7)
    clock = 0
    for step in range(7):
        cache = open_()
        if step % 3 < 2:
            rows = []
            for _ in range(rng.randrange(1, 30)):
                clock += 1
                rows.append((rng.choice([None, 1, 2, 3]), rng.choice("pqr"), float(clock), start + timedelta(minutes=rng.choice([clock, clock - 50]))))
            cache.put(cache.table.spark.createDataFrame(rows, schema))
            for a, b, v, at in rows:
                old = want.get((a, b))
                if old is None or (at, v) >= (old[1], old[0]):
                    want[a, b] = (v, at)
        elif step == 2:
            cache.invalidate(cache.table.spark.createDataFrame([(1, "p"), (None, "q"), (9, "z")], "a int, b string"))
            want = {k: x for k, x in want.items() if k not in ((1, "p"), (None, "q"))}
        else:
            bound = start + timedelta(minutes=clock // 2)
            cache.clean(F.lit(str(bound)).cast("timestamp_ntz"))
            want = {k: x for k, x in want.items() if x[1] >= bound}
        assert {(r.a, r.b): (r.v, r.at) for r in open_().read().collect()} == want
    cache = open_()
    asked = spark.createDataFrame([(2, "p")], "a int, b string")
    assert {(r.a, r.b) for r in cache.get(asked).collect()} == {k for k in want if k == (2, "p")}
    before, names = cache.table.manifest(), set(cache.table.manifest())
    cache.put(spark.createDataFrame([(2, "p", 1.0, datetime(2030, 1, 1))], schema))
    assert len({b for b in names if cache.table.manifest()[b] != before[b]}) <= 1


def test_index_against_a_full_scan(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    weights = [1 / (k + 1) for k in range(40)]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.choice([3, 10, 60]))), "w0 w39" if k % 50 == 0 else "") for k in range(600)]
    table = spark.createDataFrame(docs, "id long, text string, title string")
    index = Index(spark, str(tmp_path / "i"), buckets=8, block=16)
    for low in (0, 200, 300):
        part = table.where((F.col("id") >= low) & (F.col("id") < {0: 200, 200: 300, 300: 600}[low]))
        index.add(search.postings(part, "id", {"text": 1.0, "title": 2.5}))
    full = search.postings(table, "id", {"text": 1.0, "title": 2.5})

    def agree():
        for asked in (["w0", "w39"], ["w3", "W3", "w30", "w31"], ["w38"], ["none"], ["none", "w1"], []):
            for k in (1, 10, 1000):
                want = sorted(((-round(r.score, 4), r.doc_id) for r in search.search_exact(full, asked or [""]).collect()))[:k]
                assert [(-round(r.score, 4), r.doc_id) for r in index.search(asked, k).collect()] == want, (asked, k)

    agree()
    base = index.table.version()
    assert index.merge(10**9) == base + 1 and len(index.segments()) == 1 and index.merge(10**9) == base + 1
    agree()
    # Only the folders of the words' buckets are read, and blocks that can't matter are left out.
    held = index.of(["w0", "w39"])
    assert {f.split("_b=")[1].split("/")[0] for f in held.inputFiles()} <= {str(b) for b in spark.range(1).select(F.array(*[index._bucket(F.lit(t)) for t in ("w0", "w39")])).first()[0]}
    assert index.wanted(["w0", "w39"], 3).count() < held.count() / 2


def test_index_makes_postings_once(spark, tmp_path):
    """A segment reads its postings once; a merge moves blocks and keeps their size, whatever the number of segments."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(k, f"w{k % 3}", 1.0) for k in range(300)] + [(k, "all", 2.0) for k in range(300)], "doc_id long, term string, weight double")
    index = Index(spark, str(tmp_path / "i"), buckets=4, block=16)
    for k in range(5):
        index.add(rows.where(F.col("doc_id") % 5 == k).mapInArrow(count, rows.schema))
    assert made.value == 600
    assert set(index.table.names("data")) == {s["path"].removeprefix("data/") for s in index.segments()}
    index.merge(10**9)
    (one,) = index.segments()
    held = index.of(["w0", "w1", "w2", "all"])
    assert one["postings"] == 600 and held.agg(F.max("n")).first()[0] <= 16
    assert held.where("n <> size(docs) OR most <> array_max(docs.score)").count() == 0
    want = sorted((t, d) for d, t, _ in rows.collect())
    assert sorted((r.term, r.doc_id) for r in held.select("term", F.explode("docs.doc_id").alias("doc_id")).collect()) == want


def test_totals_with_late_rows(spark, tmp_path):
    rng = random.Random(6)
    schema = "item string, place int, day timestamp_ntz, n double, sign string"
    row = lambda low, high: (rng.choice("abc"), rng.choice([1, None]), datetime(2023, 1, 1) + timedelta(hours=rng.randrange(low * 24, high * 24)), rng.randrange(1, 10_000) / 100, rng.choice("+-"))
    posts = [[row(100, 200) for _ in range(40)], [row(0, 60) for _ in range(10)], [row(90, 400) for _ in range(60)], [(rng.choice("abc"), 1, None, 5.0, "+")], [row(230, 231)]]
    totals = Totals(spark, str(tmp_path / "r"), schema, "day", ["item", "place"], "n", parts=2)
    done = []
    for rows in posts:
        done += rows
        totals.post(spark.createDataFrame(rows, schema), F.col("sign") == "+")
    all_ = spark.createDataFrame(done, schema).where("day IS NOT NULL").cache()
    near = lambda df: sorted((str(r.item), str(r.place), *[round(x, 2) + 0.0 for x in r[2:]]) for r in df.collect())
    at = lambda day: F.lit(str(day)).cast("timestamp_ntz")
    days = [datetime(2022, 5, 1), datetime(2023, 1, 9, 5), datetime(2023, 3, 31, 23, 59), datetime(2023, 4, 20), datetime(2023, 8, 19, 7), datetime(2030, 1, 1)]
    for day in days:
        assert near(totals.balance(day)) == near(registers.balance(all_, "day", ["item", "place"], "n", F.col("sign") == "+", at(day)))
    for start, end in ((days[1], days[3]), (days[0], days[5]), (days[3], days[3] + timedelta(days=2)), (days[2], days[1])):
        assert near(totals.turnover(start, end)) == near(registers.turnover(all_, "day", ["item", "place"], "n", F.col("sign") == "+", at(start), at(end)))
    months = totals.table.manifest()["months"]
    read = {f.split("/data/")[1].split("/part-")[0] for f in totals.balance(datetime(2023, 4, 20)).inputFiles()}
    assert read <= {p.removeprefix("data/") for p in [*months["2023-04"]["detail"], months["2023-04"]["opening"]]}


def test_fuzzy_pairs(spark):
    rng = random.Random(7)
    letters = "abcdeжщé"
    terms = sorted({"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 9, 12]))) for _ in range(700)} | {"Word", "word", "ab", "WORDS"})
    asked = []
    for t in rng.sample(terms, 40):
        w = list(t)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice([[], [rng.choice(letters)]])
        asked.append("".join(w))
    asked += ["WORD", "a", "é", "", None]
    frame = spark.createDataFrame([(t,) for t in [*terms, None, ""]], "term string")
    words = spark.createDataFrame([(w,) for w in asked], "word string")
    got = {(r.word, r.term): r.similarity for r in fuzzy_index.matches(fuzzy_index.postings(frame), words).collect()}
    pairs = frame.where("term <> ''").crossJoin(words.where("word <> ''").distinct()).select("word", "term", F.round(search.similarity(F.col("term"), F.col("word")), 6).alias("s")).where("s IS NOT NULL")
    assert got == {(r.word, r.term): r.s for r in pairs.collect()} and len(got) > 100


def test_few_candidates(spark):
    """Of a vocabulary of skewed letters about a hundredth is compared with a word."""
    rng = random.Random(8)
    terms = ["".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", range(26, 0, -1), k=rng.randrange(5, 14))) for _ in range(20_000)]
    words = rng.sample(terms, 50)
    frame = spark.createDataFrame([(t,) for t in terms], "term string")
    made = fuzzy_index.candidates(fuzzy_index.postings(frame), spark.createDataFrame([(w,) for w in words], "word string"))
    share = made.count() / (50 * len(set(terms)))
    assert share < 0.02, share


def test_links_by_path(spark):
    rng = random.Random(9)
    steps = ["a", "b", "cat1", "cat12", "x"]
    some = lambda: "/" + "/".join(rng.choice(steps) for _ in range(rng.randrange(1, 6)))
    paths, folders = {some() for _ in range(200)} | {"/lone/x/y", "plain"}, {some() for _ in range(12)} | {"/a/cat1", "/a/cat1/cat12"}
    folders = {f for f in folders if not f.startswith("/b")}
    got = {r.path: r.folder for r in repository.link_by_path(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(f + rng.choice(["", "/"]), f) for f in folders], "folder string, name string")).collect()}
    for p in paths:
        above = [f for f in folders if p.startswith(f + "/")]
        names = p.split("/")[:-1]
        deep = [(n, f) for n, s in enumerate(names) for f in folders if f.rsplit("/", 1)[1] == s]
        want = max(above, key=len) if above else min(f for n, f in deep if n == max(deep)[0]) if deep else None
        assert got[p] == want, p


@pytest.mark.parametrize("seed", [1, 2])
def test_witness_cycles(spark, seed):
    rng = random.Random(seed)
    n = 30
    edges = {(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(36)} | {("z", "z"), ("p", "q")}
    found: dict = {}
    for r in graph.witnesses(spark.createDataFrame(sorted(edges), "src string, dst string")).collect():
        found.setdefault(r.cycle, {})[r.place] = r.node
    reach = {a: {a} for e in edges for a in e}
    for _ in range(n):
        reach = {a: s.union(*[reach[d] for x in s for (y, d) in edges if y == x]) for a, s in reach.items()}
    after = {a: set().union(*[reach[d] for (s, d) in edges if s == a]) for a in reach}
    heads = {min(b for b in after[a] if a in reach[b]) for a in reach if a in after[a]}
    assert set(found) == heads
    for head, ring in found.items():
        nodes = [ring[k] for k in range(len(ring))]
        assert nodes[0] == head and all(e in edges for e in zip(nodes, nodes[1:] + [head], strict=True))
        near, steps = {head}, 0
        while True:
            steps += 1
            near = {d for s, d in edges if s in near}
            if head in near:
                break
        assert steps == len(nodes)


def test_doubling_over_random_graphs(spark):
    """Weights through an acyclic graph, added over all ways, and rings told without a walk of every level."""
    rng = random.Random(10)
    rows = []
    for k in range(40):
        for _ in range(rng.randrange(1, 4)):
            rows.append((f"n{k:02}", None, f"n{rng.randrange(k + 1, 42):02}", 0.5) if k < 39 and rng.random() < 0.7 else (f"n{k:02}", rng.choice("AB"), None, 0.25))
    table = spark.createDataFrame(rows, "node string, type string, to string, weight double")
    own: dict = {}
    for k in range(41, -1, -1):
        node, sums = f"n{k:02}", {}
        mine = [r for r in rows if r[0] == node]
        for _, t, to, w in mine:
            for u, x in ({t: 1.0} if t else own[to]).items():
                sums[u] = sums.get(u, 0) + w * x
        own[node] = sums if mine else {"Unknown": 1.0}
    got = {(r.node, r.type): r.weight for r in graph.substitute(table).collect()}
    assert got == pytest.approx({(n, t): w for n, x in own.items() for t, w in x.items() if any(r[0] == n for r in rows)})
    assert graph.rings(table).count() == 0
    ringed = graph.rings(table.union(spark.createDataFrame([("n39", None, "n30", 1.0), ("n30", None, "n39", 1.0), ("s", None, "s", 1.0)], table.schema)))
    assert {"n30", "n39", "s"} <= {r.node for r in ringed.collect()}


OBJECT = """<Document uuid="{k}"><!-- <Catalog/> --><Properties><Name><![CDATA[D<{k}>]]></Name><NumberLength>{k}</NumberLength><NumberType>Number</NumberType></Properties>
<ChildObjects><Attribute uuid="x"><Properties><Name>A &amp; {k}</Name><Type><v8:Type>cfg:DocumentRef.D</v8:Type><v8:Type>xs:dateTime</v8:Type></Type></Properties></Attribute></ChildObjects></Document>"""


def test_metadata_files(spark, tmp_path):
    """A file of many objects, read as a stream; comments, character data, references, prefixes; what isn't well-formed apart."""
    (tmp_path / "deep").mkdir()
    wrap = lambda text: f'<?xml version="1.0"?>\n<MetaDataObject xmlns="u" xmlns:v8="w">{text}</MetaDataObject>'
    (tmp_path / "deep/many.xml").write_text("<All>" + "\n".join(wrap(OBJECT.format(k=k)).removeprefix('<?xml version="1.0"?>') for k in range(500)) + "</All>")
    (tmp_path / "bad.xml").write_text(wrap("<Catalog><Properties></Catalog>"))
    (tmp_path / "Configuration.xml").write_text(wrap("<Configuration><Properties><Name>Root</Name></Properties></Configuration>"))
    (tmp_path / "register.xml").write_text(wrap("<InformationRegister><Properties><Name>R</Name></Properties><ChildObjects><Dimension><Properties><Name>Dim</Name></Properties></Dimension></ChildObjects></InformationRegister>"))
    objects = metadata.read_objects(spark, str(tmp_path))
    assert objects.where("bad IS NOT NULL").count() == 1 and objects.where("object IS NOT NULL").count() == 501
    fields = {(r.owner, r.role, r.name, r.type, r.is_composite) for r in metadata.attributes(objects).collect()}
    assert fields == {(f"D<{k}>", "attribute", f"A & {k}", "Составной(ДокументСсылка.D, Дата)", True) for k in range(500)} | {("R", "dimension", "Dim", "Произвольный", False)}
    standard = {(r.owner, r.name, r.type) for r in metadata.standard_attributes(objects).collect()}
    assert {("D<7>", "Номер", "Число(7, 0)"), ("D<7>", "Дата", "Дата"), ("R", "Период", "ДатаВремя")} <= standard and not any(n == "Проведен" for _, n, _ in standard)


def test_files_are_written_by_all_tasks_and_read_once(spark, tmp_path):
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan xml")
    field = "<Attribute><Properties><Name>A</Name></Properties></Attribute>"
    text = f"<MetaDataObject><Document><Properties><Name>D</Name></Properties><ChildObjects>{field}<TabularSection><Properties><Name>T</Name></Properties><ChildObjects>{field}</ChildObjects></TabularSection><TabularSection><Properties><Name>U</Name></Properties></TabularSection></ChildObjects></Document></MetaDataObject>"
    files = spark.range(0, 400, 1, 1).select(F.concat(F.lit("d"), F.col("id") % 3, F.lit("/"), "id", F.lit(".xml")).alias("path"), F.lit(text).alias("content"))
    jobs = spark.sparkContext
    jobs.setJobGroup("files", "files")
    markup.write_files(files, str(tmp_path))
    tracker = jobs.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("files") for s in tracker.getJobInfo(j).stageIds]
    jobs.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s) > 1
    fields = metadata.attributes(metadata.read_objects(spark, str(tmp_path)))
    assert scans(fields) == 1
    assert sorted((r.section, r["count"]) for r in fields.groupBy("section").count().collect()) == [("", 400), ("T", 400)]


def test_completions(spark, tmp_path):
    rng = random.Random(11)
    names = ["".join(rng.choice("abж") for _ in range(rng.randrange(1, 9))) for _ in range(400)] + ["AbAb", None, "", "a" * 30]
    kept = Completions(spark, str(tmp_path / "c"), buckets=5, most=4, longest=5)
    kept.build(spark.createDataFrame([(n,) for n in names], "name string").repartition(4))
    known = sorted({n.lower() for n in names if n}, key=lambda n: n.encode())
    for asked in ("a", "ж", "ab", "AB", "abжab", "abжabж", "aaaaaaaa", "zz", ""):
        want = [n for n in known if n.startswith(asked.lower())][:4] if len(asked.encode()) >= 2 else []
        assert [r.suggestion for r in kept.first(asked).collect()] == want, asked
    assert len({f.rsplit("/", 1)[0] for f in kept.first("ab").inputFiles()}) <= 1


def test_pages_by_position(spark, tmp_path):
    rng = random.Random(12)
    rows = [(rng.choice([None, 1, 2, 3, 9]), k) for k in range(500)]
    kept = Ordered(spark, str(tmp_path / "p"), "a int, k int", ["a", "k"], ranges=9)
    frame = spark.createDataFrame(rows, "a int, k int").repartition(3)
    kept.build(frame)
    for number, size in ((0, 7), (3, 60), (41, 12), (9, 60), (0, 1000), (2, 1000)):
        want = search.page(frame, number, size, [F.col("a"), F.col("k")])
        assert [tuple(r) for r in kept.page(number, size).collect()] == [tuple(r) for r in want.collect()], (number, size)
    assert len({f.rsplit("/", 1)[0] for f in kept.page(30, 12).inputFiles()}) <= 2
    kept.build(frame.limit(0))
    assert kept.page(0, 5).count() == 0


@pytest.mark.parametrize("nodes", [25, 400])
def test_reachable_pairs(spark, nodes):
    """Pairs over graphs with rings, of more nodes than a label has bits too; unknown nodes reach themselves only."""
    rng = random.Random(nodes)
    edges = {(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(int(nodes * 1.1))}
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    def reach(start):
        seen, front = {start}, [start]
        while front:
            for d in after.get(front.pop(), ()):
                if d not in seen:
                    seen.add(d)
                    front.append(d)
        return seen
    pairs = {(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(150)} | {("x", "x"), ("x", "n1"), ("n1", "x"), ("n1", "n1")}
    frame = spark.createDataFrame(sorted(edges), "src string, dst string")
    labels = graph.reach_labels(frame)
    got = {(r.start, r.goal): r.reaches for r in graph.reachable(frame, labels, spark.createDataFrame([*pairs, (None, "n1")], "start string, goal string")).collect()}
    assert got == {(a, b): b in reach(a) for a, b in pairs} and len(set(got.values())) == 2
