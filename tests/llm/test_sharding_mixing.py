from __future__ import annotations

import itertools
import zlib
from collections import Counter, defaultdict

import pytest

from quarry.llm import mixing, sharding

from .conftest import ROWS


def test_shards(docs, empty):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(ROWS) and sharding.shard_documents(empty).count() == 0
    want = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("base", [1, 3, 8])
def test_growth_takes_rows_only_into_the_new_shard(spark, base):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r.shard for r in sharding.assign(keys, sharding.tree(base)).collect()}
    for added in range(1, 4):
        after = {r.doc_id: r.shard for r in sharding.assign(keys, sharding.tree(base, added)).collect()}
        moved = {after[k] for k in before if after[k] != before[k]}
        assert moved == {base + added - 1}
        before = after
    counts = Counter(before.values())
    assert max(counts.values()) < 1.3 * 4000 / (base + 3)


def test_weights_and_confined_moves(spark):
    keys = spark.range(6000).withColumnRenamed("id", "doc_id")
    place = lambda w: {r.doc_id: r.shard for r in sharding.assign(keys, sharding.tree(8, weights=w)).collect()}
    a, b = place((1.0,) * 8), place((1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 0.0001))
    # The region's weight is as before, so nothing crosses regions.
    assert all(a[k] // 4 == b[k] // 4 for k in a if b[k] != 7)
    assert Counter(b.values())[6] > 1.6 * Counter(a.values())[6]


def test_thousands_of_shards(spark):
    keys = spark.range(300).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r.shard for r in sharding.assign(keys, sharding.tree(1000)).collect()}
    after = {r.doc_id: r.shard for r in sharding.assign(keys, sharding.tree(1000, 1)).collect()}
    assert len(set(before.values())) > 200 and {after[k] for k in before if after[k] != before[k]} <= {1000}


def test_numbers_over_many_blocks(spark):
    rows = spark.range(5000).selectExpr("id AS k", "id % 3 AS g")
    got = defaultdict(list)
    for r in sharding.number(rows, "g", ["k"], block_rows=100).collect():
        got[r.g].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


def brute(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    lo, hi, total = 0.0, 1e12, 1.5 * sum(sizes.values())
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * sizes[s], mid * w[s]) for s in order) < total else (lo, mid)
    return {s: min(2 * sizes[s], hi * w[s]) for s in order}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, "c": 30}, {"a": 1, "b": 1000, None: 5}, {"x": 7}, {"a": 0, "b": 4}, {f"s{k}": (k * 37) % 101 for k in range(20)}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "_source string, source_size long").repartition(3)
    assert {r["_source"]: r["target"] for r in mixing.targets(table).collect()} == pytest.approx(brute(sizes), rel=1e-6, abs=1e-6)


def test_ranks(spark):
    values = [None, *(f"{k * 7919 % 500:03d}é" for k in range(500))]
    got = {r.v: r.place for r in mixing.ranked(spark.createDataFrame([(v,) for v in values], "v string").repartition(5), "v", "place").collect()}
    assert got == {v: k for k, v in enumerate(sorted(values[1:]) + [None])}


def test_many_sources(spark):
    """200,000 sources of one document each, and targets by plain arithmetic."""
    import time

    start = time.perf_counter()
    docs = spark.range(200_000).selectExpr("id AS doc_id", "trim(repeat('w ', int(id % 7) + 1)) AS text", "lpad(id, 7, '0') AS source")
    rows = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert time.perf_counter() - start < 90
    sizes = {f"{k:07d}": k % 7 + 1 for k in range(200_000)}
    want = brute(sizes)
    assert all(abs(r.target - want[f"{k:07d}"]) < 1e-6 and r.taken in (0, r["size"], 2 * r["size"]) and abs(r.taken - r.target) <= r["size"] / 2 + 1 for k, r in rows.items())
    assert len(rows) == 200_000


def test_flow_of_many_patterns():
    import random
    import time

    rng = random.Random(4)
    capacity = {f"p{k}": rng.randrange(1, 50) for k in range(20_000)}
    members = {p: rng.sample([f"s{k}" for k in range(300)], 3) for p in capacity}
    start = time.perf_counter()
    flow = mixing.min_cost_flow(capacity, members, {f"s{k}": 2_000 for k in range(300)})
    assert time.perf_counter() - start < 60 and sum(flow.values()) == min(600_000, 2 * sum(capacity.values()))


def test_flow_prefers_first_uses():
    flow = mixing.min_cost_flow({"p": 10, "q": 10, "both": 10}, {"p": ["A"], "q": ["B"], "both": ["A", "B"]}, {"A": 18, "B": 12})
    assert sum(x for (_, s), x in flow.items() if s == "A") == 18 and sum(x for (_, s), x in flow.items() if s == "B") == 12
    used = Counter()
    for (p, _), x in flow.items():
        used[p] += x
    assert all(x <= 10 for x in used.values())
    more = mixing.min_cost_flow({"p": 10}, {"p": ["A"]}, {"A": 50})
    assert more == {("p", "A"): 20}


def test_flow_is_optimal_by_brute_force():
    capacity, members, quota = {"p": 2, "q": 1, "r": 2}, {"p": ["A"], "q": ["A", "B"], "r": ["B"]}, {"A": 3, "B": 4}
    flow = mixing.min_cost_flow(capacity, members, quota)
    cost = lambda use: sum(max(0, x - capacity[p]) for p, x in use.items())
    routes = [(p, s) for p in members for s in members[p]]
    best = None
    for amounts in itertools.product(range(5), repeat=len(routes)):
        into, out = Counter(), Counter()
        for (p, s), x in zip(routes, amounts, strict=True):
            out[p] += x
            into[s] += x
        if all(out[p] <= 2 * capacity[p] for p in members) and all(into[s] <= quota[s] for s in quota):
            best = min(best or (1, 1), (-sum(amounts), cost(out)))
    out = Counter()
    for (p, _), x in flow.items():
        out[p] += x
    assert (-sum(flow.values()), cost(out)) == best


def test_mix(docs, empty, corpus):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and mixing.mix(empty).count() == 0
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    by = defaultdict(lambda: [0, 0, 0, 0])
    for r in mixing.mix(corpus, buckets=64).join(corpus.select("doc_id", "source"), "doc_id").collect():
        s = by[r.source]
        s[0] += r.taken
        s[1], s[2], s[3] = r.target, max(s[2], r["size"]), s[3] + r["size"]
    assert all(abs(s[0] - s[1]) <= s[2] / 2 + 1 for s in by.values())
    assert {k: s[1] for k, s in by.items()} == pytest.approx(brute({k: s[3] for k, s in by.items()}), rel=1e-6)


def test_mix_of_overlapping_sources(spark):
    rows = [(k, "w " * 10, "a" if k < 10 else "b", ["a", "b"] if k >= 5 else ["a"]) for k in range(20)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, may array<string>"), members="may")
    assert out.count() == 20 and all(r.taken % 10 == 0 and r.taken <= 20 for r in out.collect())


def test_routes_of_overlapping_sources(spark):
    """Documents are taken for sources that they may serve, in amounts of a flow of least cost over each component; null is a source too."""
    import random

    r = random.Random(8)
    pool = [["a"], ["a", "b"], ["b", "c"], ["d"], ["d", None], [None], ["e"], [], ["gone"], None]
    rows = [(k, " ".join(["w"] * r.randrange(0, 6)), r.choice(["a", "b", "c", "d", "e", None]), pool[k * k % 7] if k % 5 else r.choice(pool)) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, may array<string>").repartition(3)
    out = {x.doc_id: x for x in mixing.mix(docs, members="may").collect()}
    assert len(out) == len(rows)
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len(t.split())
    told = lambda s: "0" if s is None else f"1{s}"
    quota = {told(s): int(x) for s, x in brute(dict(size)).items()}
    held, serves = Counter(), {}
    for _, t, _, m in rows:
        p = str(m and sorted(set(map(told, m))))
        held[p] += len(t.split())
        serves[p] = [x for x in map(told, m or []) if x in quota]
    flow = mixing.min_cost_flow(dict(held), serves, quota)
    used, got, taken = Counter(), Counter(), Counter()
    for (p, _), x in flow.items():
        used[p] += x
    for k, _, _, m in rows:
        x = out[k]
        assert x.taken in (0, x["size"], 2 * x["size"])
        assert (x.served is None and not x.served_null) == (x.taken == 0)
        if x.taken:
            s = "0" if x.served_null else told(x.served)
            assert s in map(told, m)
            got[s] += x.taken
        taken[str(m and sorted(set(map(told, m))))] += x.taken
    # Flows of one cost may differ; documents are taken whole, and ranges hold one or two of them.
    again = lambda of: sum(max(0, of[p] - held[p]) for p in held)
    assert all(x <= 2 * held[p] for p, x in taken.items())
    assert abs(sum(taken.values()) - sum(flow.values())) <= 3 * len(held) and abs(again(taken) - again(used)) <= 3 * len(held)
    assert sum(got.values()) == sum(taken.values()) and all(got[s] <= quota[s] + 40 for s in quota)


def test_apply_mix_tells_rows_of_one_key(spark):
    """Key 1 has texts of its own, no text and equal rows; each is taken by its own decision."""
    rows = [(1, "one two three", "a", 1), (1, "", "a", 2), (1, None, "a", 3), (1, "one two three", "b", 4)] + [(2, "same words here", "a", 5 + k) for k in range(9)] + [(k, f"text number {k}", "ab"[k % 2], 20 + k) for k in range(3, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _row int").repartition(3)
    want = Counter()
    for r in mixing._mixed(docs, "doc_id", "text", "source", None, (5, 2, 1), (3, 2), 2, 29, 4096).collect():
        want[r._key, r._source, r["size"]] += r._times
    out = mixing.apply_mix(docs).collect()
    assert all(r.text for r in out)
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in out)
    assert got == +Counter({k: v for k, v in want.items() if k[2]})
    each = Counter(r._row for r in out if r.doc_id == 2)
    assert max(each.values()) <= 2 and max(each.values()) - min(each.get(5 + k, 0) for k in range(9)) <= 1


def test_apply_mix(docs, empty):
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.taken // r["size"] if r["size"] else 0
    got = Counter(r.doc_id for r in mixing.apply_mix(docs).collect())
    assert got == +want and mixing.apply_mix(empty).count() == 0 and mixing.apply_mix(docs).columns == docs.columns
