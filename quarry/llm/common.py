"""What the operators of this subpackage share: scratch tables, text batches, word hashes.

Words everywhere are maximal runs of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import threading
import uuid
from collections import UserList
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Keys with more than this part of all rows are joined apart; there are fewer of them than this.
SHARE = 2000

#: So many rows are no burden on one task, whatever their keys.
FEW_ROWS = 10_000

#: Bytes of text that one numpy step works on; it bounds a worker's memory.
SLICE_BYTES = 2 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent in a local run (tests) a temporary folder is set; on a cluster
    its absence is an error, as executors would not see one another's files.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/quarry/{context.applicationId}/{uuid.uuid4().hex}"


class _Paths(threading.local, UserList):
    """A list of each thread's own, so that runs at one time don't see each other's tables."""


#: Scratch tables written by this thread of the driver, in order.
written: UserList[str] = _Paths()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back: lineage ends there."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_join(rows: DataFrame, found: DataFrame, on: list[str], uses: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``found``, which has one row for each key and in ``uses`` the number of its rows.

    Keys that over a ``SHARE``-th of the ``total`` rows have, so fewer than ``SHARE`` keys, are
    joined by broadcast, where no task gets more of them than of others; the rest meets by a
    shuffle. ``rows`` is read twice, so it should be a scratch table or nearly one; ``found`` is
    written to one. Few rows are joined plainly. ``how`` is inner or left; the column ``uses``
    isn't kept.
    """
    if total <= FEW_ROWS:
        return rows.join(found.drop(uses), on, how)
    found = materialize(found)
    hot = F.col(uses) * SHARE > total
    often, seldom = found.where(hot).drop(uses), found.where(~hot).drop(uses)
    rest = rows.join(F.broadcast(often.select(*on)), on, "left_anti").join(seldom, on, how)
    return rows.join(F.broadcast(often), on).unionByName(rest)


def clean_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this application once its results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark).rpartition("/")[0])
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete these scratch tables, which nothing reads any more."""
    for path in list(paths):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        if path in written:
            written.remove(path)


def whole(text: str):
    """The text with null read as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string array into runs of about ``limit`` bytes, at least one row each.

    Gives the first row, the UTF-8 bytes and the rows' bounds in them; nulls are empty.
    """
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield row, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


_held: dict[str, Callable[[], None]] = {}


def claim(owner: str = "", forget: Callable[[], None] | None = None) -> None:
    """A worker's task starts for ``owner``: what other operators remember in this worker is let go.

    Workers live on from job to job, so a vocabulary that one stage remembers would else lie
    beside the next stage's memory.
    """
    for name in [name for name in _held if name != owner]:
        _held.pop(name)()
    if forget:
        _held[owner] = forget


@contextlib.contextmanager
def no_cycles() -> Iterator[None]:
    """Keeps Python from searching for cycles of objects while many that have none are made."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes: each input bit sways each output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some rows, and where each row's words begin and end among them."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    rows = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    letters = np.flatnonzero(inside)
    at = np.searchsorted(letters, starts)
    length = np.diff(at, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(at, length)
    powers = np.full(int(length.max()), 0x9E3779B97F4A7C15 | 1, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.add.reduceat((data[letters].astype(np.uint64) + np.uint64(1)) * powers[place], at)
    return mix(sums + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles of ``width`` words, repeats included, and where each row's begin.

    A row with fewer words, but some, has one shingle: all its words.
    """
    counts = np.diff(rows)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begins = np.concatenate([[0], np.cumsum(made)])
    first = np.repeat(rows[:-1] - begins[:-1], made) + np.arange(begins[-1])
    size = np.repeat(np.minimum(counts, width), made)
    total = size.astype(np.uint64)
    for k in range(width):
        held = size > k
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(held, words[np.where(held, first + k, 0)] if len(words) else 0, 0).astype(np.uint64)
        total ^= total >> np.uint64(29)
    return mix(total), begins
