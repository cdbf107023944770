"""Fill-in-middle, whitening and decontamination against brute force."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import decontamination, fim, whitening
from quarry.llm.queries import QUERIES

from .conftest import ROWS
from .test_hostile import TEXTS

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cut(key, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    x = sha(f"42:{'null' if key is None else key}")
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return key, len(tokens), "plain", None, None, sha(text), sha(text)
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return key, len(tokens), form, len(prefix), len(middle), sha(output), sha(text)


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


def test_cuts(spark, docs, empty, corpus):
    for table in (docs, corpus):
        assert by_text(fim.digest(fim.transform(table)).collect()) == by_text(cut(r.doc_id, r.text) for r in table.collect())
    assert fim.transform(empty).count() == 0
    clash = docs.withColumnRenamed("lang", "form").withColumnRenamed("size", "output")
    assert by_text(fim.digest(fim.transform(clash)).collect()) == by_text(cut(k, t) for k, t, *_ in ROWS)


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_cuts_by_small_chunks(spark, chunk):
    """Borders, cuts and runs of white space on and across the chunks' edges; marks that only the joining would make."""
    rng = np.random.default_rng(chunk)
    bits = ["a", "bc", " ", "  ", "\n", "\t", "é", "😀", "\x0b", "\x1f", " ", "<", "P>", "<S", ">", "<M>"]
    rows = [(k, "".join(rng.choice(bits, rng.integers(0, 30)))) for k in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = fim.digest(fim.transform(table, chunk=chunk)).collect()
    assert by_text(got) == by_text(cut(*r) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_cuts_of_long_texts(spark):
    rows = [*enumerate(TEXTS), (100, "x" * 3_000_000), (101, "ab " * 2_000_000), (104, " " * 2_000_000 + "é")]
    assert by_text(fim.digest(fim.transform(spark.createDataFrame(rows, "doc_id long, text string"))).collect()) == by_text(cut(*r) for r in rows)


def whitened(rows):
    """By one eigendecomposition in numpy: n, values, vectors, deviations and trace."""
    x = [[math.floor(64 * c) + 1_000_000 for c in r] for r in rows]
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, sums = len(fit), fit.sum(axis=0)
    c = ((n * fit - sums) / n).astype(float)
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    return n, values[::-1], vectors[:, ::-1], [int(((n * np.array(r, object) - sums) ** 2).sum()) for r in x], [((n * np.array(r, object) - sums) / n).astype(float) for r in x], np.trace(v)


@pytest.mark.parametrize("spread", [1.0, 0.4])
def test_whitening(spark, spread):
    """A flat spectrum makes the basis whole; a steep one is found in the narrow basis."""
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((300, 40)) * 40 * spread ** np.arange(40)).tolist()
    rows = [(k, v) for k, v in enumerate(vectors)] + [(7, vectors[7]), (None, vectors[8]), (900, None), (901, vectors[0][:39] + [None]), (902, vectors[0][:39] + [float("nan")]), (903, [float("-inf")] * 40), (904, vectors[0][:7]), (905, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS component", "2 AS n", "3 AS _x").repartition(5)
    kept = [(k, v) for k, v in rows[:302]]
    n, values, basis, deviations, centred, trace = whitened([v for _, v in kept])
    settings = whitening.Settings(components=6, oversample=10, passes=4, tolerance=1e-11)
    model = whitening.fit(table, settings=settings)
    assert model.expanded == (spread == 1.0) and model.n == n == 300
    got = defaultdict(list)
    for r in whitening.apply(table, model).collect():
        got[r.vec_id].append(r)
    assert {k: len(v) for k, v in got.items()} == {k: 6 * (1 + (k == 7)) for k, _ in kept}
    for (k, _), d, c in zip(kept, deviations, centred, strict=True):
        for r in got[k]:
            assert (r.n, int(r.deviation)) == (n, d) and r.identity_error < 1e-9
            assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
            assert abs(r.whitened) == pytest.approx(abs(c @ basis[:, r.component - 1]) / math.sqrt(values[r.component - 1]), rel=1e-6, abs=1e-8)


def test_whitening_of_little(spark):
    shape = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], shape)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], shape)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], shape)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(5)], shape)).collect()
    assert [r.component for r in line] == [1] * 5 and all(r.explained == pytest.approx(1) for r in line)
    far = whitening.whiten(spark.createDataFrame([(1, [3e13]), (2, [-3e13]), (3, [1e30])], shape)).collect()
    x = [math.floor(64 * float(np.float32(s * 3e13))) + 1_000_000 for s in (1, -1)]
    assert {r.vec_id: int(r.deviation) for r in far} == {1: (2 * x[0] - sum(x)) ** 2, 2: (2 * x[1] - sum(x)) ** 2}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks(docs, items, window=10):
    windows = defaultdict(set)
    for k, text in items:
        w = words(text)
        for at in range(max(len(w) - window, 0) + 1 if w else 0):
            windows[tuple(w[at : at + window])].add(str(k) if k is not None else "null")
    sizes, out = {len(w) for w in windows}, []
    for k, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if (x := tuple(w[at : at + n])) in windows:
                    hit |= set(range(at, at + n))
                    found |= windows[x]
        out.append((k, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


ITEMS = "item_id long, text string, source string"


def test_leaks_of_the_corpus(spark, corpus):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = QUERIES["op13_decontamination"](spark, "/root/testdata/sf0.001").drop("n_near_items").collect()
    assert by_text(got) == by_text(leaks([(r.doc_id, r.text) for r in corpus.collect()], [(r.item_id, r.text) for r in items.collect()]))
    assert any(r.contaminated for r in got)


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_leaks_by_brute_force(spark, docs, empty, monkeypatch, few):
    """Few words, so that windows lap over, repeat and share their rarest words; short, empty, equal and nameless items."""
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", few)
    rng = np.random.default_rng(5)
    said = lambda n: " ".join(rng.choice(["a", "B", "ñ", "Ñ", "the", "of", "x9", "K", "K", "İ"], n))
    items = [(k, said(n), None) for k, n in enumerate([4, 10, 11, 14, 25, 1, 2])] + [(2, "A! b", "s"), (None, "lone word", "s"), (50, "", None), (51, None, None), (52, " .;", None), (53, "a a a a a a a a a a a", None), (3, "lone word", None)]
    passages = [t for _, t, _ in items if t]
    rows = [(int(k % 90), ["", ";", "--"][k % 3] + said(int(rng.integers(0, 30))) + " ".join(rng.choice(passages, k % 3)) + said(int(rng.integers(0, 9)))) for k in range(120)]
    rows += rows[:3] + [(None, "a lone word"), (0, "a lone word"), (200, None), (201, "a " * 60), (202, "no such thing")]
    table = spark.createDataFrame([(k, t, 1, None) for k, t in rows], "doc_id long, text string, n_words int, _term string").repartition(5)
    benchmark = spark.createDataFrame(items, ITEMS)
    for window in (10, 3):
        got = decontamination.check(table, benchmark, settings=decontamination.Settings(window=window)).drop("n_near_items").collect()
        assert by_text(got) == by_text(leaks(rows, [x[:2] for x in items], window))
    none = spark.createDataFrame([], ITEMS)
    for clean in (none, spark.createDataFrame([(1, " ", None)], ITEMS)):
        assert by_text(decontamination.check(docs, clean).drop("n_near_items").collect()) == by_text(leaks([r[:2] for r in ROWS], []))
    assert decontamination.check(empty, benchmark).count() == 0


def test_near_passages(spark):
    """One word changed, added or left out is a proximity match where enough of a window stands; words in another order are none."""
    passage = "alpha bravo charlie delta echo foxtrot golf hotel india juliet".split()
    rows = [
        (1, passage, 1, 1), (2, [*passage[:4], "zulu", *passage[5:]], 0, 1), (3, [*passage[:5], "zulu", *passage[5:]], 0, 1), (4, passage[:5] + passage[6:], 0, 1),
        (5, passage[::-1], 0, 0), (6, [w for x in passage for w in (x, "and", "so", "on")], 0, 0), (7, passage[:5], 0, 0), (8, ["alpha"] * 30, 0, 0), (9, ["echo", "foxtrot"] * 9, 0, 0),
    ]
    table = spark.createDataFrame([(k, "so " + " ".join(w) + " on") for k, w, *_ in rows], "doc_id long, text string")
    got = decontamination.check(table, spark.createDataFrame([(1, " ".join(passage).title(), None)], ITEMS)).collect()
    assert {r.doc_id: (r.n_items, r.n_near_items) for r in got} == {k: (exact, close) for k, _, exact, close in rows}
