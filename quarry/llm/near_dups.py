"""MinHash near-duplicates by a signature-coordinate inverted join.

Documents are shingle sets; equal sets form a class and one row stands for it. Each class posts
its signature's coordinate-value pairs. Two sets of the wanted similarity agree in at least
``matches`` coordinates but for a known small chance, which the merging exploits twice:

* skip: a pair that one class alone has matches nothing, so a class with fewer than ``matches``
  shared pairs is skipped outright, and that is most of a corpus;
* prefix: with m shared pairs, rarest first, any partner shares one of the first
  m - matches + 1, so only those are merged.

Every class that is left lies under the leaders of its lists. The merging counts, for two classes
under one leader, the coordinates that agree; from ``matches`` on, exact intersections of the full
sets decide. It takes two rounds of tasks of bounded size, and no pairs are ever rows:

* each block of classes under a leader meets itself and the leader, in proportion to the classes.
  In a family of copies that ends it, since all hang together by their leader;
* where classes under a leader still lie in different components, those outside the largest one
  meet all the others, block by block, and only pairs of different components are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, materialize, mix, shingle_hashes, split_join, text_slices, word_hashes


#: Classes whose texts are picked by broadcast of 16 bytes each; members of a block; matrix columns at a time.
BROADCAST_ROWS, BLOCK, COLUMNS = 1 << 18, 256, 1 << 13


@dataclass(frozen=True)
class Settings:
    """Shingles of ``width`` words, links at ``above`` hundredths of similarity or more.

    At similarity 0.8 a pair agrees in 51 of 64 coordinates on average, and in fewer than 38 with a
    chance of about 3 in 100,000; at 0.85 the chance is below one in ten million.
    """

    width: int = 5
    above: int = 80
    coordinates: int = 64
    matches: int = 38
    seed: int = 7


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted. A to Z are lower-cased; nulls are empty."""
    for _, data, bounds in text_slices(texts):
        upper = (data >= 65) & (data <= 90)
        hashes, begins = shingle_hashes(*word_hashes(np.where(upper, data + np.uint8(32), data), bounds), width)
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            yield np.unique(hashes[a:b])


def _multipliers(settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(settings.seed)
    return tuple(rng.integers(0, 1 << 63, settings.coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def _mark(s: np.ndarray, settings: Settings) -> bytes:
    """A hash of 128 bits of a set."""
    return np.array([mix(s).sum(), mix(s ^ np.uint64(settings.seed)).sum()], np.uint64).tobytes()


def signed(docs: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """_id, _mark (a hash of the text), _n (distinct shingles), _set (a hash of the set), _tokens (coordinate-value pairs) and _codes (a byte of each)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        times, plus = _multipliers(settings)
        salt = mix(np.arange(1, settings.coordinates + 1, dtype=np.uint64))
        for batch in batches:
            sizes, marks, tokens, codes = [], [], [], []
            for s in shingle_sets(batch.column("_text"), settings.width):
                sizes.append(len(s))
                if not len(s):
                    marks.append(b"")
                    tokens.append(np.zeros(0, np.int64))
                    codes.append(b"")
                    continue
                least = np.full(settings.coordinates, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(s), 4096):
                    np.minimum(least, (s[at : at + 4096, None] * times + plus).min(axis=0), out=least)
                marks.append(_mark(s, settings))
                tokens.append(mix(least + salt).view(np.int64))
                codes.append(tokens[-1].astype(np.uint8).tobytes())
            ends = pa.array(np.cumsum([0, *map(len, tokens)]).astype(np.int32))
            flat = pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64))
            made = [batch.column("_id"), batch.column("_mark"), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(ends, flat), pa.array(codes, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["_id", "_mark", "_n", "_set", "_tokens", "_codes"])

    return _texts(docs, key, text).mapInArrow(work, "_id long, _mark long, _n long, _set binary, _tokens array<long>, _codes binary")


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_id, _mark and _text: key and mark tell a row's text, also where keys repeat."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_mark"), F.col(f"`{text}`").alias("_text"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """v and c: each linked vertex and the least vertex of its component.

    Large-star and small-star steps by turns: vertices hang on to ever smaller ones until the edges
    are stars. A vertex's neighbours are never gathered, only their minimum; vertices of many edges
    get it by broadcast.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    size, last = edges.count(), None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_uses")).select("u", F.least("u", "m").alias("m"), "_uses")
        large = split_join(both, least, ["u"], "_uses", 2 * size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(large.where("u <> v").distinct())
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            stars = edges.select(F.col("u").alias("v"), F.col("v").alias("c"))
            return stars.union(edges.select("v").distinct().select("v", F.col("v").alias("c")))
        size, last = now[0], now


def _shared(each: DataFrame, settings: Settings) -> DataFrame:
    """_v and shared: a class's (uses, token) pairs that others have too, rarest first; classes with too few are skipped.

    ``each`` has a row (_v, token) for every token of every class.
    """
    counted = each.groupBy("token").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")
    gathered = each.join(counted, "token").groupBy("_v").agg(F.sort_array(F.collect_list(F.struct("uses", "token"))).alias("shared"))
    return gathered.where(F.size("shared") >= settings.matches)


def agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many coordinates agree, for each row of ``left`` and of ``right``.

    Coordinates are told by a byte, so a few more may seem to agree, and never fewer.
    """
    out = np.zeros((len(left), len(right)), np.uint16)
    for k in range(left.shape[1]):
        out += left[:, k, None] == right[None, :, k]
    return out


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the common part of the sets at ``left`` and those at ``right``.

    A product of 0/1 matrices over the shingles that occur twice or more, some columns at a time.
    """
    size = np.array([len(s) for s in sets])
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    place = np.cumsum(uses > 1) - 1
    held = uses[column] > 1
    row, column = row[held], place[column[held]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(place[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        block = np.zeros((len(sets), min(COLUMNS, int(place[-1]) + 1 - at)), np.float32)
        block[row[a:b], column[a:b] - at] = 1
        common += block[left] @ block[right].T
    return common


def block_links(ids: np.ndarray, group: np.ndarray, texts: pa.Array, codes: np.ndarray, left: np.ndarray, right: np.ndarray, settings: Settings) -> list[tuple[int, int]]:
    """Links that span what is linked between the rows ``left`` and ``right`` of different groups.

    Only pairs that agree in ``matches`` coordinates are looked at, and only their texts.
    """
    wanted = (agreeing(codes[left], codes[right]) >= settings.matches) & (group[left][:, None] != group[right][None, :])
    rows, columns = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    if not len(rows):
        return []
    used, where = np.unique(np.concatenate([left[rows], right[columns]]), return_inverse=True)
    sets = list(shingle_sets(texts.take(pa.array(used)), settings.width))
    size = np.array([len(s) for s in sets])
    x, y = where[: len(rows)], where[len(rows) :]
    common = intersections(sets, x, y)
    both = size[x][:, None] + size[y][None, :] - common
    near = wanted[np.ix_(rows, columns)] & (100 * common >= settings.above * both)
    a, b = np.nonzero(near)
    root = {int(i): int(i) for i in ids}

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for i, k in zip(ids[left[rows[a]]].tolist(), ids[right[columns[b]]].tolist(), strict=True):
        i, k = find(i), find(k)
        if i != k:
            root[max(i, k)] = min(i, k)
    return [(v, find(v)) for v in root if find(v) != v]


def _merge(table: pa.Table, settings: Settings) -> pa.Table:
    """Links between the rows of side 0 and those of side 1, or between all where there is but one side."""
    claim()
    table = table.combine_chunks()
    side = table.column("_side").to_numpy()
    ids, group = table.column("_v").to_numpy(), table.column("_c").to_numpy()
    codes = np.frombuffer(b"".join(table.column("_codes").to_pylist()), np.uint8).reshape(len(ids), -1)
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side == side.max())
    made = block_links(ids, group, table.column("_text").combine_chunks(), codes, left, right, settings)
    return pa.table({"a": pa.array([a for a, _ in made], pa.int64()), "b": pa.array([b for _, b in made], pa.int64())})


def _linked(docs: DataFrame, classes: DataFrame, groups: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """Links found within ``groups`` (hub, _x, _y, _side, _v, _c), each with as many rows as two blocks at most."""
    groups = materialize(groups.join(classes.select("_v", "_id", "_mark", "_codes"), "_v"))
    needed = materialize(groups.select("_id", "_mark").distinct())
    # The few classes that are left fetch their texts by broadcast while their number is bounded, else by a shuffle.
    full = _texts(docs, key, text).join(F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed, ["_id", "_mark"])
    once = full.groupBy("_id", "_mark").agg(F.first("_text").alias("_text"))
    return groups.join(once, ["_id", "_mark"]).drop("_id", "_mark").groupBy("hub", "_x", "_y").applyInArrow(lambda table: _merge(table, settings), "a long, b long")


def links(docs: DataFrame, classes: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """v and c: the components of the classes that are linked with others.

    ``classes`` has _v (a number of its own), _id and _mark (of a row whose text it is), _tokens and _codes.
    """
    shared = materialize(_shared(classes.select("_v", F.explode(F.array_distinct("_tokens")).alias("token")), settings))
    # Skipped classes no longer count, so what the living share is told better.
    shared = _shared(shared.select("_v", F.explode("shared.token").alias("token")), settings)
    prefix = F.slice("shared", F.lit(1), F.size("shared") - settings.matches + 1)
    lists = materialize(shared.select("_v", F.size("shared").alias("_m"), F.explode(prefix).alias("p")).select("_v", "_m", "p.token"))
    # The class that shares most leads a list; all that share a list lie under its leader.
    leaders = materialize(lists.groupBy("token").agg(F.min_by("_v", F.struct(-F.col("_m"), "_v")).alias("hub"), F.count(F.lit(1)).alias("_in")).where("_in > 1"))
    under = materialize(split_join(lists.select("_v", "token"), leaders, ["token"], "_in", lists.count()).select("hub", "_v").distinct())
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sized = under.groupBy("hub").agg(F.count(F.lit(1)).alias("_uses"), blocks(F.count(F.lit(1))).alias("_blocks"))
    dealt = materialize(split_join(under, sized, ["hub"], "_uses", under.count()))
    own = F.pmod(F.xxhash64("_v"), "_blocks").cast("int")
    # The leader goes into every block, the others into one.
    block = F.explode(F.when(F.col("hub") == F.col("_v"), F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array(own))).alias("_x")
    first = dealt.select("hub", block, F.lit(0).alias("_y"), F.lit(0).alias("_side"), "_v", F.col("_v").alias("_c"))
    found = materialize(_linked(docs, classes, first, key, text, settings))
    known = materialize(components(found))
    if dealt.where("_blocks > 1").isEmpty():
        return known
    # Under leaders of several blocks: who lies outside the largest component there meets all the others.
    placed = materialize(dealt.where("_blocks > 1").join(known.withColumnRenamed("v", "_v"), "_v", "left").withColumn("_c", F.coalesce("c", "_v")).drop("c"))
    parts = placed.groupBy("hub", "_c").agg(F.count(F.lit(1)).alias("_n"))
    split = parts.groupBy("hub").agg(F.max_by("_c", F.struct("_n", "_c")).alias("_most"), blocks(F.sum("_n") - F.max("_n")).alias("_few"), F.sum("_n").alias("_uses")).where("_few > 0")
    apart = materialize(split_join(placed, split, ["hub"], "_uses", placed.count()))
    few = apart.where("_c <> _most").select("hub", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_x"), F.pmod(F.xxhash64("_v"), "_few").cast("int").alias("_y"), F.lit(0).alias("_side"), "_v", "_c")
    rest = apart.select("hub", own.alias("_x"), F.explode(F.sequence(F.lit(0), F.col("_few") - 1)).alias("_y"), F.lit(1).alias("_side"), "_v", "_c")
    more = materialize(_linked(docs, classes, few.unionByName(rest), key, text, settings))
    return known if more.isEmpty() else components(found.union(more))


def _placed(docs: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """_id, _mark and _n of every row; _first, _first_mark: the least row of its component (nulls where it has none).

    Classes are told apart by their sets, so rows that repeat a key each have their own component.
    """
    posted = materialize(signed(docs, key, text, settings))
    members = posted.where("_n > 0 AND _id IS NOT NULL").select("_id", "_mark", "_n", "_set")
    least = F.min(F.struct("_id", "_mark")).alias("_least")
    grouped = posted.where("_n > 0 AND _id IS NOT NULL").groupBy("_set").agg(least, F.first("_tokens").alias("_tokens"), F.first("_codes").alias("_codes"), F.count(F.lit(1)).alias("_uses"))
    # Numbers that are written once stay as they are.
    classes = materialize(grouped.select("_set", "_least._id", "_least._mark", "_tokens", "_codes", "_uses", F.monotonically_increasing_id().alias("_v")))
    found = materialize(links(docs, classes, key, text, settings))
    linked = materialize(found.join(classes.withColumnRenamed("_v", "v").select("v", "_set", "_id", "_mark", "_uses"), "v"))
    heads = linked.groupBy("c").agg(least, F.count(F.lit(1)).alias("_size")).select("c", "_least", "_size")
    headed = split_join(linked.select("c", "_set", "_uses"), heads, ["c"], "_size", found.count()).select("_set", "_uses", F.col("_least._id").alias("_first"), F.col("_least._mark").alias("_first_mark"))
    copies = classes.where("_uses > 1").join(linked.select("_set"), "_set", "left_anti").select("_set", "_uses", F.col("_id").alias("_first"), F.col("_mark").alias("_first_mark"))
    known = materialize(headed.unionByName(copies))
    # Classes of one row that are linked with nothing aren't in it.
    joined = split_join(members, known, ["_set"], "_uses", posted.count(), "left")
    own = joined.select("_id", "_mark", "_n", F.coalesce("_first", "_id").alias("_first"), F.when(F.col("_first").isNull(), F.col("_mark")).otherwise(F.col("_first_mark")).alias("_first_mark"))
    none = F.lit(None).cast("long")
    return own.unionByName(posted.where("_n = 0 OR _id IS NULL").select("_id", "_mark", "_n", none.alias("_first"), none.alias("_first_mark")))


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per document: key, n_shingles, component_id and kept.

    component_id is the smallest key reachable over links between shingle sets, its own included;
    kept is true for that document. A text without words has the empty set and links with nothing.
    Keys are bigints; rows that repeat a key are judged each by its own set. Null keys stand alone.
    An empty table gives no rows.
    """
    placed = _placed(docs, key, text, settings)
    component = F.coalesce("_first", "_id")
    return placed.select(F.col("_id").alias(key), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows of a group but the one with the smallest key.

    A row is told by key and text, so of rows that share a key only those of a group go, and of
    rows with the same key and text one stays. Texts without words and rows of null keys all stay.
    """
    placed = materialize(_placed(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text, settings).where("_first IS NOT NULL").select("_id", "_mark", "_first", "_first_mark"))
    stays = (F.col("_id") == F.col("_first")) & (F.col("_mark") == F.col("_first_mark"))
    gone = placed.where(~stays).select("_id", "_mark").distinct()
    again = materialize(placed.where(stays).groupBy("_id", "_mark").count().where("count > 1").select("_id", "_mark"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    told = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_mark"), row)
    if again.isEmpty():
        return told.join(gone, ["_id", "_mark"], "left_anti").select("_row.*")
    single = told.join(gone.union(again), ["_id", "_mark"], "left_anti")
    return single.union(told.join(again, ["_id", "_mark"], "left_semi").dropDuplicates(["_id", "_mark"])).select("_row.*")
