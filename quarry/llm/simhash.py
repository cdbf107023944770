"""SimHash fingerprints, and a search for all of them within a Hamming radius.

Every shingle of words votes, as often as it occurs, for the bits of its hash; a fingerprint bit
is set where the votes for it prevail. Fingerprints are lowercase hex.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, materialize, mix, shingle_hashes, split_join, text_slices, whole, word_hashes

BITS, WIDTH = 128, 5
#: Bits by which texts of similarity 0.8 may differ: 20 on average; unrelated ones differ by 64.
REACH = 32

#: Table keys of queries, or queries, that are broadcast.
BROADCAST_KEYS = 1 << 20

#: Distinct query fingerprints that a pass over all fingerprints looks up.
QUERY_BLOCK = 1 << 18

#: For each byte, its bits as the eight bytes of a word.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).reshape(-1)


def fingerprints(texts: pa.Array, bits: int = BITS, width: int = WIDTH) -> np.ndarray:
    """One row of bits // 8 bytes per text; a text without words has no votes and no set bit."""
    out = np.zeros((len(texts), bits // 8), np.uint8)
    for row, data, bounds in text_slices(texts):
        hashes, begins = shingle_hashes(*word_hashes(data, bounds), width)
        some = np.flatnonzero(np.diff(begins))
        if not len(some):
            continue
        counts = np.diff(begins)[some]
        # Runs of up to 255 shingles of one text: their votes fit in bytes, eight to a word.
        runs = -(-counts // 255)
        first = np.cumsum(runs) - runs
        starts = np.repeat(begins[some], runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
        for lane in range(bits // 64):
            lanes = mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (lane + 1) & (1 << 64) - 1)).view(np.uint8)
            votes = np.add.reduceat(_SPREAD[lanes].reshape(-1, 8), starts, axis=0).view(np.uint8)
            most = np.add.reduceat(votes, first, axis=0, dtype=np.int64) * 2 > counts[:, None]
            out[row + some, 8 * lane : 8 * lane + 8] = np.packbits(most, axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits, row by row."""
    return 1 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / (8 * a.shape[1])


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """``docs`` with the column ``name`` (it replaces one of that name). Nulls are as empty texts; equal texts get equal ones."""
    kept = docs.drop(name)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [x.tobytes().hex() for x in fingerprints(batch.column(batch.schema.get_field_index(text)), bits, width)]
            yield batch.append_column(name, pa.array(made, pa.string()))

    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, T.StructField(name, T.StringType())]))


def _first_tables(apart: np.ndarray, blocks: int, need: int) -> np.ndarray:
    """For pairs, by their differing bits (rows of bytes), the first of the tables in which they meet; -1 if in none."""
    agree = ~apart.reshape(len(apart), blocks, -1).any(axis=2)
    chosen = agree & (np.cumsum(agree, axis=1) <= need)
    codes = chosen @ (1 << np.arange(blocks))
    table = np.full(1 << blocks, -1, np.int64)
    for t, c in enumerate(itertools.combinations(range(blocks), need)):
        table[sum(1 << k for k in c)] = t
    return table[codes]


def near(prints: DataFrame, queries: DataFrame, radius: int = 6, blocks: int = 8, key: str = "doc_id", name: str = "fingerprint", bits: int = BITS, members: int = 4096, asked: int = 1024) -> DataFrame:
    """What lies within ``radius`` bits of each distinct fingerprint of ``queries``, by permuted block tables: all of it.

    The bits are cut into ``blocks``; at least blocks - radius of them agree in such a pair, so a
    table for each choice of that many blocks, keyed by their bits, brings every pair together. A
    pair counts in the first table in which it meets. Gives name, n_other (other fingerprints
    within the radius), n_rows (rows of ``prints`` that have these), other_distance and other_id
    (the least distance, and the least key there); fingerprints that find none are left out. A key
    of a table with more than ``members`` fingerprints or ``asked`` queries is dealt over several
    tasks, and each sends one row for each query. Nulls take no part; copies are one fingerprint.
    """
    if blocks <= radius:
        raise ValueError("there must be more blocks than the radius")
    size = bits // 4 // blocks
    if size * blocks * 4 != bits or size % 2:
        raise ValueError("blocks must cut the bytes evenly")
    need = blocks - radius
    part = lambda k: F.substring("_f", k * size + 1, size)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *[part(k) for k in chosen]).alias("key")) for t, chosen in enumerate(itertools.combinations(range(blocks), need))])
    told = prints.select(F.col(f"`{name}`").alias("_f"), F.col(f"`{key}`").cast("long").alias("_id")).where("_f is not null")
    distinct = materialize(told.groupBy("_f").agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_id")))
    asks = materialize(queries.select(F.col(f"`{name}`").alias("_f")).where("_f is not null").distinct())
    posted = materialize(asks.select("_f", F.explode(tables).alias("_t")).select("_f", "_t.t", "_t.key"))
    keys = posted.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / asked).cast("int").alias("_asked"))
    few = posted.count() <= BROADCAST_KEYS
    held = materialize(distinct.select("*", F.explode(tables).alias("_t")).select("_f", "_rows", "_id", "_t.t", "_t.key").join(F.broadcast(keys) if few else keys, "key"))
    parts = held.groupBy("key", "_asked").agg(F.ceil(F.count(F.lit(1)) / members).cast("int").alias("_parts"), F.count(F.lit(1)).alias("_uses"))
    place = lambda n: F.pmod(F.xxhash64("_f"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sized = split_join(held, parts.drop("_asked"), ["key"], "_uses", held.count())
    own = sized.select("key", "t", place("_parts").alias("_x"), all_of("_asked").alias("_y"), "_f", "_rows", "_id")
    ask = posted.join(parts, "key").select("key", "t", all_of("_parts").alias("_x"), place("_asked").alias("_y"), "_f", F.lit(None).cast("long").alias("_rows"), F.lit(None).cast("long").alias("_id"))

    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        f, rows, ids = group.column("_f").to_pylist(), group.column("_rows").to_pylist(), group.column("_id").to_pylist()
        t = group.column("t").to_numpy()
        asking, having = [k for k, r in enumerate(rows) if r is None], [k for k, r in enumerate(rows) if r is not None]
        bytes_of = lambda at: np.frombuffer(bytes.fromhex("".join(f[k] for k in at)), np.uint8).reshape(len(at), bits // 8)
        left, right = bytes_of(having), bytes_of(asking)
        none = np.iinfo(np.int64).max
        weight = np.array([rows[k] for k in having], np.int64)
        ids_of = np.array([none if ids[k] is None else ids[k] for k in having], np.int64)
        asked_t, held_t = t[np.array(asking, np.int64)], t[np.array(having, np.int64)]
        # Per query: fingerprints, rows, the least distance and the least key there; some pairs at a time.
        n, m = np.zeros(len(asking), np.int64), np.zeros(len(asking), np.int64)
        least, at = np.full(len(asking), bits, np.int64), np.full(len(asking), none, np.int64)
        for row, query, distance in _met(left.view(np.uint64), right.view(np.uint64), radius):
            first = _first_tables(left[row] ^ right[query], blocks, need)
            good = (distance > 0) & (first == asked_t[query]) & (first == held_t[row])
            row, query, distance = row[good], query[good], distance[good]
            np.add.at(n, query, 1)
            np.add.at(m, query, weight[row])
            order = np.lexsort((ids_of[row], distance, query))
            q, begin = np.unique(query[order], return_index=True)
            d, i = distance[order][begin], ids_of[row[order]][begin]
            nearer = (d < least[q]) | (d == least[q]) & (i < at[q])
            least[q[nearer]], at[q[nearer]] = d[nearer], i[nearer]
        some = np.flatnonzero(n)
        return pa.table({"_f": pa.array([f[asking[q]] for q in some], pa.string()), "n": pa.array(n[some]), "m": pa.array(m[some]), "d": pa.array(least[some].astype(np.int32)), "i": pa.array(at[some], mask=at[some] == none)})

    met = own.unionByName(ask).groupBy("key", "_x", "_y").applyInArrow(meet, "_f string, n long, m long, d int, i long")
    least = F.min(F.struct("d", F.col("i").isNull().alias("_none"), "i")).alias("_least")
    return met.groupBy("_f").agg(F.sum("n").alias("n_other"), F.sum("m").alias("n_rows"), least).select(F.col("_f").alias(name), "n_other", "n_rows", F.col("_least.d").alias("other_distance"), F.col("_least.i").alias("other_id"))


def _met(own: np.ndarray, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, query and distance of all pairs within the radius, some at a time; both sides are rows of 64-bit words."""
    for a in range(0, len(own), 128):
        for b in range(0, len(asked), 2048):
            apart = sum(np.bitwise_count(own[a : a + 128, None, w] ^ asked[None, b : b + 2048, w]).astype(np.uint16) for w in range(own.shape[1]))
            row, query = np.nonzero(apart <= radius)
            if len(row):
                yield row + a, query + b, apart[row, query].astype(np.int64)


def search(prints: DataFrame, queries: DataFrame, radius: int = REACH, key: str = "doc_id", name: str = "fingerprint", block: int = QUERY_BLOCK) -> DataFrame:
    """What lies within ``radius`` bits of each distinct fingerprint of ``queries``: all of it, with no chance of a miss.

    Gives name, n_same and n_near (rows of ``prints`` of that fingerprint, and of others within the
    radius), near_distance and near_id (the least distance of another, and the least key there).
    Tables by exact blocks need more blocks than the radius, so at this reach they leave nothing
    out; each fingerprint meets each query in numpy instead, and a task sends one row for each query
    that found something in a batch, however large a group is. Queries go to the workers in blocks
    of about ``block`` fingerprints, dealt by their hash, one pass over ``prints`` each; that bounds
    what the driver and a worker hold at 16 bytes a query. Work grows with rows times queries.
    """
    spark = prints.sparkSession
    asks = materialize(queries.select(F.col(f"`{name}`").alias("_f")).where("_f IS NOT NULL").distinct())
    n = max(1, -(-asks.count() // block))
    slim = prints.select(F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{name}`").alias("_f")).where("_f is not null")
    slim = materialize(slim) if n > 1 else slim

    def words(made: list[str]) -> np.ndarray:
        return np.frombuffer(bytes.fromhex("".join(made)), np.uint64).reshape(len(made), -1)

    def look_up(k: int) -> DataFrame:
        hexes = sorted(r[0] for r in asks.where(F.pmod(F.xxhash64("_f"), F.lit(n)) == k).collect())
        shared = spark.sparkContext.broadcast(hexes)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = words(shared.value) if shared.value else None
            for batch in batches if asked is not None else ():
                if not len(batch):
                    continue
                keys = batch.column("_key").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                found = list(_met(words(batch.column("_f").to_pylist()), asked, radius))
                if not found:
                    continue
                row, query, distance = map(np.concatenate, zip(*found, strict=True))
                order = np.lexsort((keys[row], np.where(distance == 0, 1 << 20, distance), query))
                row, query, distance = row[order], query[order], distance[order]
                found, first, times = np.unique(query, return_index=True, return_counts=True)
                same = np.bincount(query[distance == 0], minlength=len(asked))[found]
                other = distance[first] > 0
                yield pa.RecordBatch.from_pydict({
                    "_f": pa.array([shared.value[q] for q in found], pa.string()), "n_same": pa.array(same, pa.int64()), "n_near": pa.array(times - same, pa.int64()),
                    "near_distance": pa.array(distance[first].astype(np.int32), mask=~other), "near_id": pa.array(keys[row[first]], pa.int64(), mask=~other | (keys[row[first]] == np.iinfo(np.int64).max)),
                })

        return slim.mapInArrow(work, "_f string, n_same long, n_near long, near_distance int, near_id long")

    def summed(parts: DataFrame) -> DataFrame:
        least = F.min(F.when(F.col("near_distance").isNotNull(), F.struct("near_distance", F.col("near_id").isNull().alias("_none"), "near_id"))).alias("_least")
        return parts.groupBy("_f").agg(F.sum("n_same").alias("n_same"), F.sum("n_near").alias("n_near"), least).select("_f", "n_same", "n_near", "_least.near_distance", "_least.near_id")

    # With several blocks each is written before the next is collected, so that one at a time is held.
    found = summed(look_up(0)) if n == 1 else reduce(DataFrame.unionByName, [materialize(summed(look_up(k))) for k in range(n)])
    return found.withColumnRenamed("_f", name)


def compare_and_search(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 100, radius: int = REACH) -> DataFrame:
    """``compare_with_next``, and for keys divisible by ``every`` what is near them among all documents; nulls for the others.

    ``near`` finds by tables what lies within its radius (n_close), ``search`` by comparison what
    lies within ``radius``, which tables can't reach (n_same, n_near, near_distance, near_id). Null
    keys ask for nothing; null and empty texts have the fingerprint without bits and are near one
    another; repeated rows, and rows of one text, count each; of the nearest the least key is told.
    An empty table gives no rows.
    """
    compared = materialize(compare_with_next(docs, key, text))
    asks = F.col(f"`{key}`") % every == 0
    # A row for each query at most.
    far = search(compared, compared.where(asks), radius, key)
    close = near(compared, compared.where(asks), key=key).select("fingerprint", "n_other")
    found = far.join(close, "fingerprint", "left").select(F.col("fingerprint").alias("_f"), "n_same", "n_near", "near_distance", "near_id", F.coalesce("n_other", F.lit(0)).alias("n_close"))
    return compared.join(F.broadcast(found) if found.count() <= BROADCAST_KEYS else found, (F.col("fingerprint") == F.col("_f")) & asks, "left").drop("_f")


def _edited(batches: Iterator[pa.RecordBatch], bits: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows come in order; one that is the last of its bucket is followed by a copy of the next bucket's first."""
    claim()
    before: tuple | None = None
    for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, len(whole), 1000)):
        keys, texts = batch.column("_key").to_pylist(), [t or "" for t in batch.column("_text").to_pylist()]
        extra, buckets = batch.column("_extra").to_pylist(), batch.column("_bucket").to_pylist()
        prints = fingerprints(pa.array(texts, pa.large_string()), bits, width)
        rows = [before, *zip(keys, texts, extra, buckets, prints, strict=True)] if before else list(zip(keys, texts, extra, buckets, prints, strict=True))
        pairs = [(x, y) for x, y in itertools.pairwise(rows) if not x[2]]
        before = rows[-1] if rows else before
        if not pairs:
            continue
        new = [x[1][: len(x[1]) - len(x[1]) // 4] + y[1][: len(x[1]) // 4] for x, y in pairs]
        own, following = np.array([x[4] for x, _ in pairs]), np.array([y[4] for _, y in pairs])
        changed = fingerprints(pa.array(new, pa.large_string()), bits, width)
        yield pa.RecordBatch.from_pydict({
            "_key": pa.array([x[0] for x, _ in pairs], pa.int64()),
            "n_chars": pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
            "fingerprint": [x.tobytes().hex() for x in own],
            "edited_fingerprint": [x.tobytes().hex() for x in changed],
            "near_edited": likeness(own, changed),
            "near_next": likeness(own, following),
        })


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's.

    The next document is that of the next key (a bigint; nulls first, rows of one key by text),
    after the last the first. The edited text has its last n_chars // 4 code points replaced by
    the first as many of the next document. Gives key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next. Texts move once, into buckets of key ranges; a
    bucket also gets a copy of the first row after it. Null texts are empty; an only document
    follows itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("_key"), whole(text).alias("_text"))
    cuts = sorted(set(slim.where("_key is not null").approxQuantile("_key", [k / (8 * parts) for k in range(1, 8 * parts)], 0.2 / (8 * parts))))
    # All cuts are one constant; a row looks through every step-th of them and then through one step.
    step = max(1, math.isqrt(len(cuts)))
    constant = lambda some: F.split(F.lit(",".join(str(int(c)) for c in some)), ",").cast("array<bigint>")
    upto = lambda some: F.size(F.filter(some, lambda c: c <= F.col("_key")))
    run = upto(constant(cuts[::step])) - 1 if cuts else F.lit(-1)
    within = upto(F.slice(constant(cuts), F.col("_run") * step + 1, F.lit(step))) if cuts else F.lit(0)
    slim = slim.withColumn("_run", run)
    bucket = F.when(F.col("_key").isNull(), 0).when(F.col("_run") < 0, 1).otherwise(F.col("_run") * step + within + 1)
    cut = slim.withColumn("_bucket", bucket.cast("int")).drop("_run")
    # As many rows as there are buckets: the first key of each, then its text, then who needs it.
    firsts = cut.groupBy("_bucket").agg(F.min("_key").alias("_first")).withColumnRenamed("_bucket", "_b")
    heads = cut.join(F.broadcast(firsts), F.col("_key").eqNullSafe(F.col("_first")) & (F.col("_bucket") == F.col("_b"))).groupBy("_bucket").agg(F.first("_key").alias("_key"), F.min("_text").alias("_text"))
    # Numbers of buckets alone are put in order; the texts only join what needs them.
    needs = firsts.select("_b", F.expr("coalesce(lag(_b) OVER (ORDER BY _b), max(_b) OVER ())").alias("_to"))
    sent = heads.join(F.broadcast(needs), F.col("_bucket") == F.col("_b")).select("_key", "_text", F.col("_to").alias("_bucket"))
    both = cut.withColumn("_extra", F.lit(0)).unionByName(sent.withColumn("_extra", F.lit(1)))
    dealt = both.repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_extra", "_key", "_text")
    out = "_key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(lambda batches: _edited(batches, bits, width), out).withColumnRenamed("_key", key)
