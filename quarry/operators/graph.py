"""Dependency and call graphs as edge DataFrames (src, dst), walked by frontier joins.

Each step joins only the newest frontier with the edges and cuts its lineage by a scratch table,
so a walk takes as many jobs as it has levels and no vertex set comes to the driver.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage: written as Parquet below ``spark.checkpoint.dir`` and read back, computed once.

    Only in a local run without that setting a temporary folder is taken; on a cluster its absence
    is an error, as executors would not see one another's files.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        base = context.getCheckpointDir()
    path = f"{base.rstrip('/')}/quarry/{context.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Walks join by shuffles only: small tables of many rounds, each sent to the driver to be broadcast, grow with the input in sum.
MERGE = "merge"


def drop(df: DataFrame) -> None:
    """Delete the scratch table behind a result of ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles() if "/quarry/" in f}:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: So many rows of one key are no burden on one task.
FEW_ROWS = 100_000


def join_often(rows: DataFrame, found: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join (inner or left) of ``rows`` with ``found``, which has few rows a key, whatever part of ``rows`` shares a key.

    Keys of over ``FEW_ROWS`` rows, so of these at most a ``FEW_ROWS``-th of all rows, are joined by
    broadcast where the rows are; the others meet by a shuffle. ``rows`` is read up to three times.
    """
    often = cut(rows.where(" AND ".join(f"{c} IS NOT NULL" for c in on)).groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW_ROWS).select(*on))
    if often.isEmpty():
        return rows.join(found, on, how)
    few = F.broadcast(often)
    return rows.join(few, on, "left_semi").join(F.broadcast(found.join(few, on, "left_semi")), on, how).unionByName(rows.join(few, on, "left_anti").join(found, on, how))


def reach(edges: DataFrame, starts: DataFrame, limit: int = 1000) -> DataFrame:
    """start, node and depth: all nodes reachable from each start (itself at 0) with the least number of steps.

    ``starts`` has a column ``start``. Walks of over ``limit`` steps are refused.
    """
    edges = edges.select("src", "dst").distinct()
    seen = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    front = seen
    for depth in range(1, limit + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        new = cut(step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return seen
        both = cut(seen.union(new))
        drop(seen)
        if depth > 1:
            drop(front)
        seen, front = both, new
    raise RuntimeError(f"no end after {limit} steps")


#: 64-bit words of a reachability label.
LABEL_WORDS = 4


def _bits(node: str, k: int):
    """The ``k``-th word of the label of a node alone: one bit of all words, told by its hash."""
    at = F.pmod(F.xxhash64(F.col(node)), F.lit(64 * LABEL_WORDS)).cast("int")
    return F.when(F.floor(at / 64) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), at % 64)).otherwise(F.lit(0).cast("bigint"))


def reach_labels(edges: DataFrame, limit: int = 1000) -> DataFrame:
    """node and o0, o1, ...: the bits of all nodes that can be reached from a node, itself included.

    A node whose bit isn't among them can't be reached; others may be. Labels spread against the
    edges, a step a round, until none changes: rows are nodes, whatever they reach, rings too.
    """
    words = [f"o{k}" for k in range(LABEL_WORDS)]
    edges = cut(edges.select("src", "dst").distinct())
    now = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().select("node", *[_bits("node", k).alias(w) for k, w in enumerate(words)]))
    for _ in range(limit):
        sent = edges.hint(MERGE).join(now, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), *words)
        new = cut(now.unionByName(sent).groupBy("node").agg(*[F.bit_or(w).alias(w) for w in words]))
        same = new.hint(MERGE).join(now, ["node", *words], "left_anti").isEmpty()
        drop(now)
        now = new
        if same:
            return now
    raise RuntimeError(f"no end after {limit} steps")


def reachable(edges: DataFrame, labels: DataFrame, pairs: DataFrame, limit: int = 1000) -> DataFrame:
    """start, goal and reaches for the distinct rows of ``pairs``: whether the edges lead from one to the other; a node reaches itself.

    ``labels`` (of ``reach_labels``) settle most pairs that are apart. The rest are walked from
    their starts, all at once, only by nodes whose labels allow the goal, and no further once it
    is met; so there is a row for a pair and a node between them, never one for all a node reaches.
    """
    words = [f"o{k}" for k in range(LABEL_WORDS)]
    edges = edges.select("src", "dst").distinct()
    asked = cut(pairs.select("start", "goal").where("start IS NOT NULL AND goal IS NOT NULL").distinct())

    def allowed(rows: DataFrame) -> DataFrame:
        met = rows.hint(MERGE).join(labels, "node")
        fits = F.lit(True)
        for k, w in enumerate(words):
            fits = fits & (F.col(w).bitwiseAND(_bits("goal", k)) == _bits("goal", k))
        return met.where(fits).select("start", "goal", "node")

    found = cut(asked.where("start = goal"))
    front = cut(allowed(asked.where("start <> goal").withColumn("node", F.col("start"))))
    seen = front
    for _ in range(limit):
        step = front.hint(MERGE).join(edges, F.col("node") == F.col("src")).select("start", "goal", F.col("dst").alias("node")).distinct()
        step = cut(allowed(step))
        found = cut(found.unionByName(step.where("node = goal").select("start", "goal")))
        front = cut(step.hint(MERGE).join(found, ["start", "goal"], "left_anti").hint(MERGE).join(seen, ["start", "goal", "node"], "left_anti"))
        if front.isEmpty():
            return asked.hint(MERGE).join(found.withColumn("reaches", F.lit(True)), ["start", "goal"], "left").withColumn("reaches", F.coalesce("reaches", F.lit(False)))
        seen = cut(seen.unionByName(front))
    raise RuntimeError(f"no end after {limit} steps")


def shortest_path(edges: DataFrame, start: str, goal: str, limit: int = 1000) -> DataFrame:
    """place and node along one shortest path (of the least names); no rows if there is none.

    Distances from the start are joined backwards from the goal, a node a level.
    """
    depths = reach(edges, edges.sparkSession.createDataFrame([(start,)], "start string"), limit).drop("start")
    path = depths.where(F.col("node") == goal)
    last = path.first()
    if last is None:
        return path.select(F.col("depth").alias("place"), "node")
    for depth in range(last["depth"] - 1, -1, -1):
        head = path.where(F.col("depth") == depth + 1).select(F.col("node").alias("dst"))
        before = edges.join(head, "dst").select(F.col("src").alias("node")).join(depths.where(F.col("depth") == depth), "node")
        path = path.unionByName(before.groupBy("depth").agg(F.min("node").alias("node")).select("node", "depth"))
        path = cut(path)
    return path.select(F.col("depth").alias("place"), "node")


def _spread(edges: DataFrame, colours: DataFrame, limit: int) -> DataFrame:
    """node and colour: the least colour of the nodes from which a node can be reached, its own included."""
    for _ in range(limit):
        sent = edges.hint(MERGE).join(colours, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "colour")
        new = cut(colours.unionByName(sent).groupBy("node").agg(F.min("colour").alias("colour")))
        same = new.hint(MERGE).join(colours, ["node", "colour"], "left_anti").isEmpty()
        colours = new
        if same:
            return colours
    raise RuntimeError(f"no end after {limit} steps")


def cycles(edges: DataFrame, limit: int = 1000) -> DataFrame:
    """node and cycle: nodes that lie on a cycle, and the least node of their strong component.

    Forward and backward colouring: nodes take the least node from which they can be reached; those
    of a colour that reach its own node too are its strong component and go out, then the rest is
    coloured anew. Nodes that cannot lie on a cycle are peeled off first, and a row is kept for each
    node and edge only.
    """
    core = cut(edges.select("src", "dst").distinct())
    found = core.limit(0).select(F.col("src").alias("node"), F.col("src").alias("cycle"))
    for _ in range(limit):
        size = core.count()
        while size:
            core = cut(core.hint(MERGE).join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").hint(MERGE).join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            now = core.count()
            if now == size:
                break
            size = now
        if not size:
            return found
        nodes = core.select(F.col("src").alias("node")).distinct()
        coloured = _spread(core, nodes.withColumn("colour", F.col("node")), limit)
        tinted = core.hint(MERGE).join(coloured.select(F.col("node").alias("src"), F.col("colour").alias("_a")), "src").hint(MERGE).join(coloured.select(F.col("node").alias("dst"), F.col("colour").alias("_b")), "dst")
        back = cut(tinted.where("_a = _b").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # Backwards from the colour's own node, within the colour.
        front = cut(coloured.where("node = colour"))
        seen = front
        while True:
            front = cut(back.hint(MERGE).join(front, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "colour").distinct().hint(MERGE).join(seen, ["node", "colour"], "left_anti"))
            if front.isEmpty():
                break
            seen = cut(seen.unionByName(front))
        sized = seen.groupBy("colour").agg(F.count(F.lit(1)).alias("_n"))
        loops = core.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("_loop", F.lit(True))
        on = seen.hint(MERGE).join(sized, "colour").hint(MERGE).join(loops, "node", "left").where("_n > 1 OR _loop").select("node", F.col("colour").alias("cycle"))
        found = cut(found.unionByName(on))
        core = cut(core.hint(MERGE).join(seen.select(F.col("node").alias("src")), "src", "left_anti").hint(MERGE).join(seen.select(F.col("node").alias("dst")), "dst", "left_anti"))
    raise RuntimeError(f"no end after {limit} rounds")


def witnesses(edges: DataFrame, limit: int = 1000) -> DataFrame:
    """cycle, place and node: for each strong component one shortest cycle through its least node, which has place 0.

    Distances from the least nodes spread within all components at once; then each cycle is
    followed back, a place a round, by the least node that is one nearer.
    """
    on = cycles(edges, limit)
    inner = edges.select("src", "dst").distinct().hint(MERGE).join(on.select(F.col("node").alias("src"), "cycle"), "src").hint(MERGE).join(on.select(F.col("node").alias("dst"), F.col("cycle").alias("_c")), "dst").where("cycle = _c").select("cycle", "src", "dst")
    inner = cut(inner)
    seen = front = cut(on.where("node = cycle").select("cycle", "node", F.lit(0).alias("place")))
    for place in range(1, limit + 1):
        step = front.hint(MERGE).join(inner, (front["cycle"] == inner["cycle"]) & (F.col("node") == F.col("src"))).select(front["cycle"], F.col("dst").alias("node")).distinct()
        front = cut(step.hint(MERGE).join(seen, ["cycle", "node"], "left_anti").withColumn("place", F.lit(place)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    else:
        raise RuntimeError(f"no end after {limit} steps")
    back = inner.where("dst = cycle").select("cycle", F.col("src").alias("node")).hint(MERGE).join(seen, ["cycle", "node"])
    found = cut(back.groupBy("cycle").agg(F.min(F.struct("place", "node")).alias("_l")).select("cycle", "_l.place", "_l.node"))
    last = found
    for _ in range(limit):
        last = last.where("place > 0").select("cycle", (F.col("place") - 1).alias("place"), F.col("node").alias("dst")).hint(MERGE).join(inner, ["cycle", "dst"]).select("cycle", "place", F.col("src").alias("node"))
        last = cut(last.hint(MERGE).join(seen, ["cycle", "place", "node"]).groupBy("cycle", "place").agg(F.min("node").alias("node")))
        if last.isEmpty():
            return found
        found = cut(found.unionByName(last))
    raise RuntimeError(f"no end after {limit} steps")


def levels(edges: DataFrame, nodes: DataFrame | None = None, limit: int = 1000) -> DataFrame:
    """node and level by longest path from the nodes that nothing points to; null on or behind a cycle.

    Kahn's order by rounds: each takes all nodes whose incoming edges are used up. Equal levels
    are independent; order them by name.
    """
    edges = cut(edges.select("src", "dst"))
    all_ = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    left = cut((all_ if nodes is None else all_.union(nodes.select("node"))).distinct())
    done = left.limit(0).withColumn("level", F.lit(0))
    for level in range(limit + 1):
        free = cut(left.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if free.isEmpty():
            return done.unionByName(left.withColumn("level", F.lit(None).cast("int")))
        now = cut(done.unionByName(free.withColumn("level", F.lit(level)))), cut(left.join(free, "node", "left_anti")), cut(edges.join(free, F.col("src") == F.col("node"), "left_anti"))
        for old in (free, left, edges, *[done] * (level > 0)):
            drop(old)
        done, left, edges = now
    raise RuntimeError(f"no end after {limit} levels")


def substitute(rows: DataFrame, rounds: int = 64) -> DataFrame:
    """node, type and weight of ``rows`` (node, type, to, weight) whose every ``to`` is replaced by that node's own rows.

    A row has a type, or names the node ``to`` whose rows stand for it, times its weight. A round
    replaces all of them at once, so that open rows point twice as far as before and a chain of n
    nodes takes log2(n) rounds; rows of one node that point to the same node, or have one type, are
    added up, so many ways between two nodes are one row. Nodes may be in no ring (see ``unringed``);
    one without rows of its own is Unknown.
    """
    now = cut(rows.select("node", "type", "to", F.col("weight").cast("double").alias("weight")))
    # Rows of nodes that name none and that none names stay as they are.
    asked = cut(now.where("to IS NOT NULL").select(F.explode(F.array("node", "to")).alias("node")).distinct())
    if asked.isEmpty():
        return now.select("node", "type", "weight")
    still = now.join(asked, "node", "left_anti").select("node", "type", "weight")
    now = cut(now.join(asked, "node", "left_semi"))
    for _ in range(rounds):
        open_ = now.where("to IS NOT NULL")
        if open_.isEmpty():
            return still.unionByName(now.select("node", "type", "weight"))
        brought = now.select(F.col("node").alias("to"), F.col("type").alias("_type"), F.col("to").alias("_to"), F.col("weight").alias("_w"), F.lit(True).alias("_there"))
        step = open_.select("node", "to", "weight").join(brought, "to", "left")
        moved = step.select("node", F.when(F.col("_there"), F.col("_type")).otherwise("Unknown").alias("type"), F.col("_to").alias("to"), (F.col("weight") * F.coalesce("_w", F.lit(1.0))).alias("weight"))
        before, now = now, cut(now.where("to IS NULL").unionByName(moved).groupBy("node", "type", "to").agg(F.sum("weight").alias("weight")))
        drop(before)
    raise RuntimeError(f"rows still open after {rounds} rounds: their nodes are in a ring")


def rings(rows: DataFrame) -> DataFrame:
    """node and cycle (as ``cycles``) of the nodes of ``rows`` (node, to) that are in a ring; a walk of doubling steps tells first whether there is any.

    Without rings that takes as many joins as the longest way has binary digits.
    """
    edges = rows.where("to IS NOT NULL").select(F.col("node").alias("src"), F.col("to").alias("dst")).distinct()
    edges = cut(edges)
    most, walk, steps = edges.count(), edges, 1
    while steps <= most:
        longer = cut(walk.join(walk.select(F.col("src").alias("dst"), F.col("dst").alias("_far")), "dst").select("src", F.col("_far").alias("dst")).distinct())
        if walk is not edges:
            drop(walk)
        walk, steps = longer, steps * 2
        if walk.isEmpty():
            return edges.limit(0).select(F.col("src").alias("node"), F.col("src").alias("cycle"))
    # Only what still walks can be in a ring or lead to one.
    alive = walk.select("src").distinct()
    return cycles(edges.join(alive, "src", "left_semi").join(alive.withColumnRenamed("src", "dst"), "dst", "left_semi"))


def unringed(rows: DataFrame) -> DataFrame:
    """``rows`` (node, type, to, weight) without rings: a row that points to another node of its ring takes that node's rows,
    in which what points into the ring is Unknown; so is what points to its own node."""
    found = rings(rows)
    if found.isEmpty():
        return rows
    mine, other = found.select("node", F.col("cycle").alias("_a")), found.select(F.col("node").alias("to"), F.col("cycle").alias("_b"))
    told = rows.join(mine, "node", "left").join(other, "to", "left").withColumn("_in", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)))
    closed = F.when(F.col("_in"), "Unknown").otherwise(F.col("type"))
    inner = told.where("_a IS NOT NULL").select(F.concat("node", F.lit("\u0001")).alias("node"), closed.alias("type"), F.when(~F.col("_in"), F.col("to")).alias("to"), "weight")
    self_ = F.col("_in") & (F.col("node") == F.col("to"))
    outer = told.select("node", F.when(self_, "Unknown").otherwise(F.col("type")).alias("type"), F.when(F.col("_in") & ~self_, F.concat("to", F.lit("\u0001"))).when(~self_, F.col("to")).alias("to"), "weight")
    return outer.unionByName(inner)


def dependencies(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node).select(F.col("dst").alias("node")).distinct()


def dependents(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("dst") == node).select(F.col("src").alias("node")).distinct()
