"""Whitening of embeddings by their leading principal components.

Entries become whole numbers x = floor(64 c) + 1000000. The model is fitted on each distinct
vector once. A randomised range finder multiplies a seeded basis, wider than the components asked
for, by the covariance again and again, each time in one pass over all centred rows; Rayleigh-Ritz
in that basis gives values and vectors, whose residuals the same pass tells. Residuals that stay
above the bound expand the basis to the full dimension, where Rayleigh-Ritz is exact.

Only matrices of the dimension times the basis come to the driver; rows stay on the executors, which
work in numpy on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, materialize

SCALE, SHIFT = 64, 1_000_000

#: Groups of tasks whose matrices are added first, and numbers of a matrix that are added together.
GROUPS, BLOCK = 64, 8192

#: Rows of which one numpy step makes matrices.
STEP = 4096


@dataclass(frozen=True)
class Settings:
    """components: how many at most; oversample: further columns of the basis; passes: power passes
    before the basis is expanded; tolerance: residual of a component relative to the largest value;
    seed: of the first basis; rank: values below this part of the largest are no components."""

    components: int = 16
    oversample: int = 8
    passes: int = 3
    tolerance: float = 1e-12
    seed: int = 12
    rank: float = 1e-12


@dataclass
class Model:
    """n vectors with the whole sums ``sums``; ``values`` fall, ``vectors`` are columns; passes is the number over the rows."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int = 0
    expanded: bool = False
    base: np.ndarray = field(init=False)
    part: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.base = np.array([s // self.n for s in self.sums], np.int64)
        self.part = np.array([s % self.n for s in self.sums], object)


def whole_numbers(vector: Column) -> Column:
    """x of each entry; null where the vector is null, or holds null, a number that isn't finite, or one of 2^46 and more, which has no exact x."""
    doubles = vector.cast("array<double>")
    good = F.forall(doubles, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float(1 << 46)), F.lit(False)))
    return F.when(good, F.transform(doubles, lambda c: F.floor(c * SCALE) + SHIFT))


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def _summed(fit: DataFrame, width: int, work: Callable[[np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """The sums over all rows of the matrices that ``work`` makes of some rows.

    Matrices are added within a task, then, in blocks of ``BLOCK`` numbers, over groups of tasks and
    over the groups: each step's tasks hold a bounded part, and the driver gets one sum of each.
    """
    shapes = [(m.shape, m.dtype) for m in work(np.zeros((1, width), np.int64))]
    out = "m int, block int, part binary"

    def send(m: list[int], block: list[int], part: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"m": pa.array(m, pa.int32()), "block": pa.array(block, pa.int32()), "part": pa.array(part, pa.binary())})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        total: list[np.ndarray] | None = None
        for batch in batches:
            x = _matrix(batch, "_x", width)
            for at in range(0, len(x), STEP):
                made = work(x[at : at + STEP])
                total = made if total is None else [a + b for a, b in zip(total, made, strict=True)]
        for k, matrix in enumerate(total or []):
            flat = matrix.ravel()
            for block in range(-(-len(flat) // BLOCK)):
                yield send([k], [block], [flat[block * BLOCK : (block + 1) * BLOCK].tobytes()])

    def group(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, block = key[0].as_py(), key[1].as_py()
        parts = (np.frombuffer(p.as_py(), shapes[m][1]) for batch in batches for p in batch.column("part"))
        total = next(parts).copy()
        for p in parts:
            total += p
        yield send([m], [block], [total.tobytes()])

    parts = fit.mapInArrow(task, out).withColumn("_g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    once = parts.groupBy("m", "block", "_g").applyInArrow(group, out)
    got = {(r.m, r.block): r.part for r in once.groupBy("m", "block").applyInArrow(group, out).collect()}
    return [np.frombuffer(b"".join(got[k, block] for block in range(sum(m == k for m, _ in got))), kind).reshape(shape) for k, (shape, kind) in enumerate(shapes)]


def _centred(x: np.ndarray, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x minus the mean: whole numbers are subtracted first, so nothing of the difference is lost."""
    return (x - base).astype(np.float64) - rest


def fit(vectors: DataFrame, column: str = "embedding", settings: Settings | None = None) -> Model | None:
    """The model of the distinct vectors of the most frequent length (the longer one of equals); None without any."""
    settings = settings or Settings()
    distinct = materialize(vectors.select(whole_numbers(F.col(f"`{column}`")).alias("_x")).where("size(_x) > 0").distinct())
    lengths = distinct.groupBy(F.size("_x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None:
        return None
    width, n = lengths["width"], lengths["count"]
    rows = distinct.where(F.size("_x") == width)
    sums = [int(high) * (1 << 32) + int(low) for high, low in zip(*_summed(rows, width, lambda x: [(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]), strict=True)]
    base, rest = np.array([s // n for s in sums], np.int64), np.array([float(s % n) / n for s in sums])

    def times(basis: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance times the basis, and its trace."""
        def work(x: np.ndarray) -> list[np.ndarray]:
            c = _centred(x, base, rest)
            return [c.T @ (c @ basis), np.array([np.einsum("ij,ij->", c, c)])]

        product, square = _summed(rows, width, work)
        return product / n, float(square[0]) / n

    asked = min(settings.components, width)
    columns = min(width, asked + settings.oversample)
    basis = np.linalg.qr(np.random.default_rng(settings.seed).standard_normal((width, columns)))[0] if columns < width else np.eye(width)
    passes, expanded = 0, False
    while True:
        product, trace = times(basis)
        passes += 1
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:asked], turn[:, ::-1][:, :asked]
        found = basis @ turn
        residual = np.linalg.norm(product @ turn - found * values, axis=0).max()
        if basis.shape[1] == width or residual <= settings.tolerance * max(values[0], 0):
            break
        expanded = passes > settings.passes
        basis = np.eye(width) if expanded else np.linalg.qr(product)[0]
    kept = values > settings.rank * max(values[0], 0)
    values, found = values[kept], found[:, kept]
    model = Model(n, sums, values, found, trace, 0.0, passes, expanded)
    if len(values):
        scaled = found / np.sqrt(values)

        def moments(x: np.ndarray) -> list[np.ndarray]:
            w = _centred(x, base, rest) @ scaled
            return [w.T @ w, w.sum(axis=0)]

        squares, means = _summed(rows, width, moments)
        model.identity_error = float(np.abs(squares / n - np.outer(means / n, means / n) - np.eye(len(values))).max())
        model.passes += 1
    return model


def _deviations(x: np.ndarray, model: Model) -> list[int]:
    """Sum over dimensions of (n x - S)^2 in whole numbers, however large."""
    off = x - model.base
    reach = model.n * (int(np.abs(off).max(initial=0)) + 1)
    if x.shape[1] * reach * reach < 1 << 63:
        return ((model.n * off - model.part.astype(np.int64)) ** 2).sum(axis=1).tolist()
    return [int(d) for d in ((model.n * off.astype(object) - model.part) ** 2).sum(axis=1)]


def apply(vectors: DataFrame, model: Model | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each vector and component: key, component (from 1), n, deviation (decimal), whitened, explained, identity_error."""
    out = f"{key} long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    said = vectors.select(F.col(f"`{key}`").cast("long").alias(key), whole_numbers(F.col(f"`{column}`")).alias("_x"))
    if model is None or not len(model.values):
        return said.sparkSession.createDataFrame([], out)
    width, k = len(model.sums), len(model.values)
    rest = np.array([float(p) / model.n for p in model.part])
    scaled, explained = model.vectors / np.sqrt(model.values), model.values / model.trace

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for batch in batches:
            for at in range(0, len(batch), STEP):
                some = batch.slice(at, STEP)
                x = _matrix(some, "_x", width)
                keys = some.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
                deviation = pa.array(_deviations(x, model), pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(x)), k)))
                yield pa.RecordBatch.from_pydict({
                    key: keys, "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), "n": pa.array(np.full(len(x) * k, model.n)), "deviation": deviation,
                    "whitened": pa.array((_centred(x, model.base, rest) @ scaled).ravel()), "explained": pa.array(np.tile(explained, len(x))), "identity_error": pa.array(np.full(len(x) * k, model.identity_error)),
                })

    return said.where(F.size("_x") == width).mapInArrow(work, out)


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """``fit`` and ``apply``.

    Rows whose vector is null, empty, or holds null or a number that isn't finite are dropped, and
    so are those whose length isn't the most frequent one. Repeated rows, and null keys, give their
    rows again. Components without variance (rank below the number asked for, one distinct vector)
    are left out. Equal values leave the choice of vectors among them to the arithmetic. An empty
    table gives no rows.
    """
    return apply(vectors, fit(vectors, column, settings), key, column)
