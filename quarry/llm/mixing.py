"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they may serve). A flow
network routes token capacity from patterns to source quotas: the k-th use of a document
costs more than the one before, so capacity is repeated only where quotas need it. The flows
then say how many tokens to take of each pattern, and seeded hashes pick the documents.

The network falls apart into components of patterns and sources that hang together, which are
solved in tasks of Spark; only sums by pattern and source get there, and none comes to the driver.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, split_join, whole
from .near_dups import components

#: Tables of sources or patterns of up to so many rows are broadcast.
BROADCAST_ROWS = 10_000

#: About so many routes of small components are solved in one task.
ROUTES = 10_000


def min_cost_flow(capacity: dict[str, int], members: dict[str, list[str]], quota: dict[str, int], uses: int = 2) -> dict[tuple[str, str], int]:
    """Tokens to route from each pattern to each of its sources, in whole tokens.

    Pattern p offers ``capacity[p]`` tokens ``uses`` times over; use number k costs k a token, a
    convex cost. Each source takes up to its quota. The flow is a maximum one of least cost: costs
    lie on the patterns' offers alone, so paths of least cost use up the first uses before any
    second one, and it takes one maximum flow by blocking flows for each use. Ties follow the
    order of the names, so reruns agree.
    """
    patterns, sources = sorted(capacity), sorted(quota)
    start, end = 0, 1 + len(patterns) + len(sources)
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    heads: list[int] = []
    room: list[int] = []

    def link(a: int, b: int, most: int) -> int:
        graph[a].append(len(heads))
        graph[b].append(len(heads) + 1)
        heads.extend((b, a))
        room.extend((most, 0))
        return len(heads) - 2

    place = {s: 1 + len(patterns) + k for k, s in enumerate(sources)}
    offers = [link(start, 1 + k, 0) for k in range(len(patterns))]
    routes = [(p, s, link(1 + k, place[s], uses * capacity[p])) for k, p in enumerate(patterns) for s in sorted(members[p])]
    for s in sources:
        link(place[s], end, quota[s])
    for _ in range(uses):
        for e, p in zip(offers, patterns, strict=True):
            room[e] += capacity[p]
        while True:
            level = [-1] * len(graph)
            level[start] = 0
            waiting = deque([start])
            while waiting:
                v = waiting.popleft()
                for e in graph[v]:
                    if room[e] > 0 and level[heads[e]] < 0:
                        level[heads[e]] = level[v] + 1
                        waiting.append(heads[e])
            if level[end] < 0:
                break
            following = [0] * len(graph)
            path: list[int] = []
            v = start
            while True:
                if v == end:
                    pushed = min(room[e] for e in path)
                    for e in path:
                        room[e] -= pushed
                        room[e ^ 1] += pushed
                    full = next(k for k, e in enumerate(path) if not room[e])
                    v = heads[path[full] ^ 1]
                    del path[full:]
                    continue
                edges = graph[v]
                while following[v] < len(edges) and not (room[edges[following[v]]] > 0 and level[heads[edges[following[v]]]] == level[v] + 1):
                    following[v] += 1
                if following[v] < len(edges):
                    path.append(edges[following[v]])
                    v = heads[path[-1]]
                elif path:
                    v = heads[path.pop() ^ 1]
                    following[v] += 1
                else:
                    break
    return {(p, s): room[e ^ 1] for p, s, e in routes if room[e ^ 1]}


def ranked(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` of distinct values with their place from 0 in the order of the column, null last."""
    spark = rows.sparkSession
    order = [F.col(f"`{column}`").isNull(), F.col(f"`{column}`")]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt)
    before = F.expr("coalesce(sum(_n) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    # One row for each partition.
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_before"))
    within = F.expr(f"row_number() OVER (PARTITION BY _part ORDER BY `{column}` IS NULL, `{column}`) - 1")
    return dealt.withColumn("_within", within).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """``sizes`` (_source, source_size) with each source's target: ``share`` of all sizes dealt by weight, none above ``most`` times its size.

    Sources in the order of code points, null last, take the weights in turn. What a source can't
    take is dealt again by weight among the others until none is above; each such round is two sums.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    weighed = materialize(ranked(sizes, "_source", "_place").withColumn("_weight", weight).drop("_place"))
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share[0] / share[1]
    most_of = most * F.col("source_size")
    fixed, left, open_weight = F.lit(False), total, weighed.agg(F.sum("_weight")).first()[0]
    while True:
        dealt = F.lit(float(left)) * F.col("_weight") / F.lit(float(open_weight or 1))
        above = fixed | (dealt > most_of)
        new, held, open_weight = weighed.agg(F.count_if(above & ~fixed), F.sum(F.when(above, most_of).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("_weight")))).first()
        if not new:
            return weighed.withColumn("target", F.when(fixed, most_of.cast("double")).otherwise(dealt)).drop("_weight")
        left, fixed = total - held, above


def _attached(rows: DataFrame, table: DataFrame, on: list[str], total: int) -> DataFrame:
    """Join a table of sources or patterns, with the number of their rows in _uses."""
    table = materialize(table)
    return rows.join(F.broadcast(table.drop("_uses")), on) if table.count() <= BROADCAST_ROWS else split_join(rows, table, on, "_uses", total)


def route(routes: DataFrame, most: int = 2) -> DataFrame:
    """_pattern, _name and _flow (words, above 0): the min-cost flow over ``routes``, component by component.

    ``routes`` has a row for each pattern and source that it may serve: _group tells the component,
    _held is the pattern's capacity (once), _quota the source's. A component is solved in one task:
    what must fit there are its patterns and sources, not their documents.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        # Components don't meet in a network, so those of a task are solved as one, each as it would be alone.
        serves: dict[str, list[str]] = {}
        for p, s in zip(rows["_pattern"], rows["_name"], strict=True):
            serves.setdefault(p, []).append(s)
        capacity = dict(zip(rows["_pattern"], rows["_held"].tolist(), strict=True))
        quota = dict(zip(rows["_name"], rows["_quota"].tolist(), strict=True))
        return pd.DataFrame([(p, s, x) for (p, s), x in min_cost_flow(capacity, serves, quota, most).items()], columns=["_pattern", "_name", "_flow"])

    dealt = routes.withColumn("_task", F.pmod(F.xxhash64("_group"), F.lit(routes.count() // ROUTES + 1)))
    return dealt.groupBy("_task").applyInPandas(solve, "_pattern string, _name string, _flow long")


def _grouped(routes: DataFrame) -> DataFrame:
    """``routes`` with _group: the component of patterns and sources that a route lies in."""
    ends = routes.select(F.concat(F.lit("p"), "_pattern").alias("a"), F.concat(F.lit("s"), "_name").alias("b"))
    found = components(ends).select(F.expr("substring(v, 2)").alias("_pattern"), F.col("c").alias("_group")).where("v LIKE 'p%'")
    return routes.join(found, "_pattern")


def _mixed(docs: DataFrame, key: str, text: str, source: str, members: str | None, weights: tuple[int, ...], share: tuple[int, int], most: int, seed: int, buckets: int) -> DataFrame:
    """_key, _source, _mark (of the text), size, source_size, target and _times (how often the mix takes the row)."""
    count = F.regexp_count(whole(text), F.lit(WORD)).cast("long")
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), F.lit("/"), F.md5(whole(text).cast("binary")))), 1, 12), 16, 10).cast("long")
    name = F.when(F.col(f"`{source}`").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(f"`{source}`")))
    own = None if members is None else F.array_distinct(F.sort_array(F.col(f"`{members}`"), asc=True))
    pattern = name if own is None else F.to_json(F.struct(own.alias("s")), {"ignoreNullFields": "false"})
    mark = F.xxhash64(F.col(f"`{text}`"))
    more = [] if own is None else [own.alias("_own")]
    slim = materialize(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").alias("_source"), name.alias("_name"), pattern.alias("_pattern"), mark.alias("_mark"), count.alias("size"), digest.alias("_hash"), *more))
    total = slim.count()
    sizes = slim.groupBy("_source", "_name").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_uses"))
    about = materialize(targets(sizes, weights, share, most))
    quota = about.select("_name", F.floor("target").alias("_quota"))
    if own is None:
        patterns = about.select(F.col("_name").alias("_pattern"), "_uses", F.col("source_size").alias("_held"))
        routes = patterns.withColumn("_name", F.col("_pattern")).withColumn("_group", F.col("_pattern")).join(quota, "_name")
    else:
        summed = materialize(slim.groupBy("_pattern").agg(F.first("_own").alias("_own"), F.sum("size").alias("_held"), F.count(F.lit(1)).alias("_uses")))
        patterns, each = summed.drop("_own"), summed.select("_pattern", "_held", F.explode("_own").alias("_s"))
        routes = _grouped(materialize(each.select("_pattern", "_held", F.when(F.col("_s").isNull(), "0").otherwise(F.concat(F.lit("1"), "_s")).alias("_name")).join(quota, "_name")))
    routed = materialize(route(materialize(routes), most))
    flows = patterns.join(routed.groupBy("_pattern").agg(F.sum("_flow").alias("_flow")), "_pattern", "left").withColumn("_flow", F.coalesce("_flow", F.lit(0)))
    some = F.col("_held") > 0
    quotas = flows.select("_pattern", "_uses", F.when(some, F.expr("_flow div _held")).otherwise(0).alias("_whole"), F.when(some, F.expr("_flow % _held")).otherwise(0).alias("_rest"))
    width = (1 << 48) // buckets
    ranged = slim.withColumn("_bucket", F.floor(F.col("_hash") / width).cast("int"))
    upto = F.expr("sum(held) OVER (PARTITION BY _pattern ORDER BY _bucket ROWS UNBOUNDED PRECEDING)")
    running = ranged.groupBy("_pattern", "_bucket").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("_docs")).withColumn("_upto", upto)
    # The margin lies in the first range whose running sum passes the rest; ranges before it are taken whole.
    margin = running.join(quotas, "_pattern").where("_upto > _rest").groupBy("_pattern").agg(F.min(F.struct("_bucket", (F.col("_rest") - F.col("_upto") + F.col("held")).alias("_left"))).alias("_m"))
    quotas = quotas.join(margin, "_pattern", "left").select("_pattern", "_uses", "_whole", F.coalesce("_m._bucket", F.lit(buckets)).alias("_edge"), F.coalesce("_m._left", F.lit(0)).alias("_left"))
    joined = _attached(ranged, quotas, ["_pattern"], total)
    columns = ["_key", "_source", "_name", "_mark", "size"] + (["_pattern", "_bucket"] if own is not None else [])
    settled = joined.where("_bucket <> _edge").select(*columns, (F.col("_whole") + F.when(F.col("_bucket") < F.col("_edge"), 1).otherwise(0)).alias("_times"))
    # At the margin equal rows are counted, not sorted; of those that straddle the cut, as many are taken as fit by half.
    same = joined.where("_bucket = _edge").groupBy(*dict.fromkeys([*columns, "_pattern", "_hash", "_whole", "_left"])).agg(F.count(F.lit(1)).alias("_n"))
    before = F.expr("coalesce(sum(size * _n) OVER (PARTITION BY _pattern ORDER BY _hash, _key, size, _mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    fit = F.when(F.col("size") > 0, F.floor((2 * F.col("_left") - 2 * F.col("_before") + F.col("size")) / (2 * F.col("size")))).otherwise(0)
    fit = F.least(F.greatest(fit, F.lit(0)), F.col("_n"))
    cut = same.withColumn("_before", before).withColumn("_fit", fit)
    runs = F.array(F.struct((F.col("_whole") + 1).alias("times"), F.col("_fit").alias("n")), F.struct(F.col("_whole").alias("times"), (F.col("_n") - F.col("_fit")).alias("n")))
    edge = cut.select(*columns, F.explode(runs).alias("_r")).where("_r.n > 0").select(*columns, F.col("_r.times").alias("_times"), F.explode(F.sequence(F.lit(1), F.col("_r.n").cast("int"))).alias("_at")).drop("_at")
    mixed = _attached(settled.unionByName(edge), about.select("_name", "_uses", "source_size", "target"), ["_name"], total)
    if own is None:
        return mixed
    # Ranges of hashes serve the pattern's sources in turn, as far as each one's flow goes.
    took = F.expr("held * _whole + CASE WHEN _bucket < _edge THEN held WHEN _bucket = _edge THEN _left ELSE 0 END")
    middle = F.expr("sum(_took) OVER (PARTITION BY _pattern ORDER BY _bucket ROWS UNBOUNDED PRECEDING) - _took / 2")
    placed = running.join(quotas.drop("_uses"), "_pattern").withColumn("_took", took).withColumn("_middle", middle).where("_took > 0")
    upto = F.expr("sum(_flow) OVER (PARTITION BY _pattern ORDER BY _name ROWS UNBOUNDED PRECEDING)")
    shares = routed.withColumn("_to", upto).select("_pattern", F.col("_name").alias("_served"), (F.col("_to") - F.col("_flow")).alias("_from"), "_to")
    last = F.max("_to").over(Window.partitionBy("_pattern"))
    shares = shares.withColumn("_to", F.when(F.col("_to") == last, F.lit(1 << 62)).otherwise(F.col("_to")))
    served = placed.join(shares, "_pattern").where("_middle >= _from AND _middle < _to").select("_pattern", "_bucket", "_served", F.col("_docs").alias("_uses"))
    named = materialize(served.unionByName(running.join(served, ["_pattern", "_bucket"], "left_anti").select("_pattern", "_bucket", F.lit(None).cast("string").alias("_served"), F.col("_docs").alias("_uses"))))
    return _attached(materialize(mixed), named, ["_pattern", "_bucket"], total)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", members: str | None = None, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 29, buckets: int = 4096) -> DataFrame:
    """One row per document: key, size, source_size, target and taken (words, repeats counted), with ``members`` also served.

    ``members`` names an array column with the sources that a document may serve; without it a
    document serves its own source (null is a source too). size is the text's words, null none.
    A pattern's flow of f tokens over capacity c takes all its documents f // c times and, for the
    rest, documents in the order of a hash of seed, key and text while at least half of them fits. Nothing comes to the
    driver but two sums a round. ``served`` is the source that a document is taken for, null where it
    isn't taken: ranges of a pattern's hashes serve its sources in turn, so a source gets its flow but
    for half a range at each end; the source null is told by ``served_null``. The documents at the
    margin are found by ``buckets`` sums of hash ranges and then a sort of the one range that holds
    the margin. Documents without words take nothing; repeated rows count each; an empty table
    gives no rows.
    """
    mixed = _mixed(docs, key, text, source, members, weights, share, most, seed, buckets)
    took = F.col("size") * F.col("_times")
    more = [] if members is None else [F.when(took > 0, F.expr("CASE WHEN _served <> '0' THEN substring(_served, 2) END")).alias("served"), F.coalesce((took > 0) & (F.col("_served") == "0"), F.lit(False)).alias("served_null")]
    return mixed.select(F.col("_key").alias(key), "size", "source_size", "target", took.alias("taken"), *more)


def apply_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", members: str | None = None, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 29, buckets: int = 4096) -> DataFrame:
    """``docs`` as the mix has them: a document appears as often as the mix takes it, or not at all.

    Documents without words, which have nothing to take, are left out. A row is told by key, source
    and text; rows that are equal in these are numbered, and the first of them take what is over.
    A null key, source or text is one like others, a null text without words; which of equal rows
    is taken is left open; an empty table gives no rows.
    """
    slim = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([key, text, source] + [members] * (members is not None))])
    same = ["_key", "_source", "_mark"]
    taken = materialize(_mixed(slim, key, text, source, members, weights, share, most, seed, buckets).where("size > 0").groupBy(*same).agg(F.sum("_times").alias("_all"), F.count(F.lit(1)).alias("_rows")).where("_all > 0"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    told = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").alias("_source"), F.xxhash64(F.col(f"`{text}`")).alias("_mark"), row)
    right = taken.select(*[F.col(c).alias(f"{c}_") for c in same], "_all", "_rows")
    met = F.expr(" AND ".join(f"{c} <=> {c}_" for c in same))
    times = lambda df: df.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_at")).select("_row.*")
    single = times(told.join(right.where("_rows = 1"), met).withColumn("_times", F.col("_all")))
    several = right.where("_rows > 1")
    if several.isEmpty():
        return single
    # Rows of one task are numbered there, and tasks by their counts, so equal rows don't gather.
    again = materialize(told.join(several, met).select(*same, "_all", "_rows", "_row", F.monotonically_increasing_id().alias("_number")).withColumn("_part", F.shiftright("_number", 33)))
    counts = again.groupBy(*same, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.expr(f"coalesce(sum(_n) OVER (PARTITION BY {', '.join(same)} ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    starts = counts.select(*[F.col(c).alias(f"{c}_") for c in same], F.col("_part").alias("_part_"), before.alias("_before"))
    within = F.expr(f"row_number() OVER (PARTITION BY {', '.join(same)}, _part ORDER BY _number)")
    numbered = again.withColumn("_within", within).join(starts, met & (F.col("_part") == F.col("_part_")))
    rest = F.when(F.col("_before") + F.col("_within") <= F.expr("_all % _rows"), 1).otherwise(0)
    return single.unionByName(times(numbered.withColumn("_times", F.expr("_all div _rows") + rest).where("_times > 0")))
