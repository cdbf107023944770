"""SentencePiece BPE with seeded merge-dropout, and its decoding.

A text falls into units (a word with the spaces before it) that no piece crosses. Within a unit
the agenda holds the possible merges, best score first; one that comes up is skipped in a share of
``dropout`` cases. How many come up before the next skip is a geometric draw by a keyed hash of the
seed, the document, its copy, the unit's place in the text and the number of skips so far, so each
occurrence of a word has draws of its own; a rerun gives the same pieces and another seed others.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FEW_ROWS, SHARE, claim, drop_scratch, materialize, mix, no_cycles, text_slices, written
from .tokens import tokenizer_path

#: Segmentations that a Python worker remembers before it starts anew; it bounds memory, not results.
REMEMBERED = 600_000
#: Units of more merges than this (below 64) are remembered only without skips: with them they hardly come again.
LONG = 48
#: Up to so many characters a scan of the possible merges is faster than an agenda.
SHORT = 40
#: The rank of a merge that there isn't.
NONE = (1 << 31) - 1
#: More merges than any unit has.
NEVER = 1 << 40

SPACE = "▁"
_MASK = (1 << 64) - 1
_models: dict[tuple, PieceModel] = {}


class PieceModel:
    """A SentencePiece BPE model file: merges with dropout, pieces to ids, ids to text."""

    def __init__(self, path: str, dropout: float = 0.0, seed: int = 0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(path))
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.byte_ids = {int(sp.id_to_piece(i)[3:-1], 16): i for i in range(size) if sp.is_byte(i)}
        if len(self.byte_ids) < 256:
            raise ValueError("the model has no byte pieces, so unknown letters would be lost")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("the model has pieces across words")
        self.bytes = [b""] * size
        for piece, i in self.ids.items():
            self.bytes[i] = piece.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.bytes[i] = bytes([b])
        # A line feed in no piece cuts units too, which makes more of them alike.
        self.units = re.compile(r" *[^ \n]+|\n| +" if not any("\n" in p for p in self.ids) else r" *[^ ]+| +").findall
        self.dropout, self.seed = dropout, seed
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.costs = {p: -score for p, score in self.scores.items()}
        self.library = sp
        # The same merges by ids: each piece cut in two pieces, sorted by both ids, and ids of single characters.
        letters = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1 and piece != SPACE:
                letters[ord(piece)] = i
        letters[ord(" ")] = self.ids.get(SPACE, -1)
        self.letters = letters
        cuts = sorted((self.ids[p[:k]] * size + self.ids[p[k:]], self.costs[p], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        wide = np.int32 if size < 46_000 else np.int64
        self.pairs = np.array([c[0] for c in cuts] + [np.iinfo(wide).max], wide)
        # Costs by their rank: only their order counts, and equal ones stay equal.
        self.pair_costs = np.concatenate([np.unique([c[1] for c in cuts], return_inverse=True)[1], [NONE]]).astype(np.int32)
        self.pair_ids = np.array([c[2] for c in cuts] + [-1], np.int32)
        self._forget()

    def _forget(self) -> None:
        """Start anew with what is remembered: segmentations by number, in which no draw is.

        Each has the merges that come up after its last skip, its ids, its unit, and the number and
        the place of that skip that led to it; ``below`` goes from these to the number.
        """
        self.known: dict[str, int] = {}
        self.steps = np.zeros(1 << 12, np.int64)
        self.made: list[bytes] = []
        self.units_of: list[str] = []
        self.parents, self.after = array("q"), array("b")
        self.below: dict[int, int] = {}

    def segment(self, unit: str, gaps: Iterable[int] = ()) -> tuple[list[int], int, int]:
        """Ids of one unit, how many merges came up after the last skip, and the number of skips.

        Before each skip as many merges as ``gaps`` says are not skipped; after the last gap none is.
        A literal space mark isn't a space: it is written in bytes.
        """
        left = [c if c != SPACE else "\0" + c for c in unit] if SPACE in unit else list(unit)
        left = [SPACE if c == " " else c for c in left]
        steps, skips = (self._scan if len(left) <= SHORT else self._agenda)(left, iter(gaps))
        out: list[int] = []
        for symbol in left:
            if symbol:
                known = self.ids.get(symbol)
                out += [known] if known is not None else [self.byte_ids[b] for b in (SPACE if symbol == "\0" + SPACE else symbol).encode()]
        return out, steps, skips

    def _scan(self, left: list[str], gaps: Iterator[int]) -> tuple[int, int]:
        """Merge the symbols in place: the least cost of all pairs comes up, the first of equal ones."""
        cost, none = self.costs.get, math.inf
        gap, steps, skips = next(gaps, NEVER), 0, 0
        costs = [cost(a + b, none) for a, b in itertools.pairwise(left)]
        while costs and (least := min(costs)) < none:
            i = costs.index(least)
            if steps == gap:
                costs[i] = none
                gap, steps, skips = next(gaps, NEVER), 0, skips + 1
                continue
            steps += 1
            left[i] += left.pop(i + 1)
            del costs[i]
            if i:
                costs[i - 1] = cost(left[i - 1] + left[i], none)
            if i < len(costs):
                costs[i] = cost(left[i] + left[i + 1], none)
        return steps, skips

    def _agenda(self, left: list[str], gaps: Iterator[int]) -> tuple[int, int]:
        """The same with a heap of merges; symbols that went into others are left empty."""
        gap, steps, skips = next(gaps, NEVER), 0, 0
        n = len(left)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        scores, agenda = self.scores, []
        for i in range(n - 1):
            merged = left[i] + left[i + 1]
            if merged in scores:
                agenda.append((-scores[merged], i, i + 1, merged))
        heapq.heapify(agenda)
        while agenda:
            _, i, k, merged = heapq.heappop(agenda)
            if not left[i] or not left[k] or after[i] != k or left[i] + left[k] != merged:
                continue
            if steps == gap:
                gap, steps, skips = next(gaps, NEVER), 0, skips + 1
                continue
            steps += 1
            left[i], left[k] = merged, ""
            after[i] = after[k]
            if after[k] >= 0:
                before[after[k]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0:
                    new = left[a] + left[b]
                    if new in scores:
                        heapq.heappush(agenda, (-scores[new], a, b, new))
        return steps, skips

    def gaps(self, stream: int | np.ndarray, places: np.ndarray, skips: int | np.ndarray) -> np.ndarray:
        """The draws of units at ``places``: how many merges come up before the next skip, after so many skips."""
        if self.dropout <= 0 or self.dropout >= 1:
            return np.full(np.broadcast(places, skips).size, NEVER if self.dropout <= 0 else 0)
        key = np.uint64(self.seed * 0xD6E8FEB86659FD93 & _MASK) + np.asarray(stream).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = mix(mix(key + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.asarray(skips).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))
        share = (h >> np.uint64(11)).astype(np.float64) / (1 << 53)
        return np.minimum(np.log1p(-share) / math.log1p(-self.dropout), NEVER).astype(np.int64)

    def _remember(self, units: list[str], parents: Iterable[int], gaps: Iterable[int], made: list[tuple[bytes, int]]) -> range:
        """Number segmentations, each with the number and the gap of the one with a skip less."""
        numbers = range(len(self.made), len(self.made) + len(made))
        while numbers.stop > len(self.steps):
            self.steps = np.concatenate([self.steps, np.zeros_like(self.steps)])
        self.steps[numbers.start : numbers.stop] = [steps for _, steps in made]
        self.made.extend([ids for ids, _ in made])
        self.units_of.extend(units)
        self.parents.extend(parents)
        self.after.extend(gaps)
        return numbers

    def _learn(self, units: Iterable[str]) -> None:
        """Remember units without skips: words by the library, whose merges are as many as it joins letters, others here."""
        units = list(units)
        words = [u for u in units if u[0] == " " and u[1:2] not in ("", " ") and SPACE not in u]
        made = self.library.encode([u[1:] for u in words], num_threads=1)
        counts = list(map(len, made))
        flat = np.fromiter(itertools.chain.from_iterable(made), self.dtype, sum(counts))
        odd = np.concatenate([[0], np.cumsum((flat >= min(self.byte_ids.values())) & (flat <= max(self.byte_ids.values())))])
        data, size, end = flat.tobytes(), self.dtype.itemsize, 0
        plain, found = [], []
        for unit, n in zip(words, counts, strict=True):
            end += n
            if odd[end] == odd[end - n]:
                plain.append(unit)
                found.append((data[(end - n) * size : end * size], len(unit) - n))
        self._put(plain, found)
        others = [u for u in units if u not in self.known]
        self._put(others, self.segment_all(others, [[]] * len(others)))

    def _put(self, units: list[str], made: list[tuple[bytes, int]]) -> None:
        self.known.update(zip(units, self._remember(units, itertools.repeat(-1, len(units)), itertools.repeat(0, len(units)), made), strict=True))

    def _joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of cost and id of the merges of ids; ``NONE`` where there is none."""
        keys = left.astype(self.pairs.dtype) * len(self.bytes) + right
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.pair_costs[at], NONE), self.pair_ids[at]

    def segment_all(self, units: list[str], gaps: list[list[int]]) -> list[tuple[bytes, int]]:
        """Ids and merges after the last skip of many units, each with gaps of its own; the same as ``segment``.

        Units of one length are the rows of a matrix of ids; in each step every row makes its
        cheapest merge or skips it.
        """
        if not units:
            return []
        out: list[tuple[bytes, int]] = [(b"", 0)] * len(units)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        lengths[lengths > SHORT] = 0
        order = np.argsort(lengths, kind="stable")
        firsts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for first, rows in zip(firsts.tolist(), np.split(order, firsts[1:]), strict=True):
            length, rows = int(lengths[order[first]]), rows.tolist()
            for at in range(0, len(rows) if length > 1 else 0, 1 << 14):
                part = rows[at : at + (1 << 14)]
                ids = self.letters[np.frombuffer("".join([units[k] for k in part]).encode("utf-32-le"), np.uint32)].reshape(len(part), length)
                plain = (ids >= 0).all(axis=1)
                left = [k for k, p in zip(part, plain.tolist(), strict=True) if p]
                if left:
                    for k, x in zip(left, self._scan_rows(ids[plain], [gaps[k] for k in left]), strict=True):
                        out[k] = x
                rows[at : at + len(part)] = [-1 if p else k for k, p in zip(part, plain.tolist(), strict=True)]
            for k in rows:
                if k >= 0:
                    ids, steps, _ = self.segment(units[k], gaps[k])
                    out[k] = np.array(ids, self.dtype).tobytes(), steps
        return out

    def _scan_rows(self, ids: np.ndarray, gaps: list[list[int]]) -> list[tuple[bytes, int]]:
        rows, length = ids.shape
        width = max(map(len, gaps)) + 1
        waits = np.array([g + [NEVER] * (width - len(g)) for g in gaps], np.int64)
        skips, steps = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        costs = np.full((rows, length), NONE, np.int32)
        into = np.zeros((rows, length), np.int32)
        costs[:, :-1], into[:, :-1] = self._joined(ids[:, :-1], ids[:, 1:])
        # Each place's neighbours; everything but ``costs`` by flat indices from here on.
        place = np.arange(length, dtype=np.int32)
        after, before = np.tile(place + 1, rows), np.tile(place - 1, rows)
        ids, into, cost = ids.astype(np.int32).reshape(-1), into.reshape(-1), costs.reshape(-1)
        open_ = np.arange(rows)
        while len(open_):
            best = costs[open_].argmin(axis=1)
            at = open_ * length + best
            going = cost[at] != NONE
            open_, at = open_[going], at[going]
            skip = waits[open_, skips[open_]] == steps[open_]
            if skip.any():
                gone = open_[skip]
                cost[at[skip]] = NONE
                skips[gone] += 1
                steps[gone] = 0
                row, at = open_[~skip], at[~skip]
            else:
                row = open_
            steps[row] += 1
            base = row * length
            # The left symbol becomes what both make, the right one goes out.
            right = base + after[at]
            ids[at], ids[right], cost[right] = into[at], -1, NONE
            far, left = after[right], before[at]
            after[at] = far
            inner, outer = far < length, left >= 0
            before[base[inner] + far[inner]] = at[inner] - base[inner]
            cost[at[~inner]] = NONE
            a = np.concatenate([at[inner], base[outer] + left[outer]])
            b = np.concatenate([base[inner] + far[inner], at[outer]])
            cost[a], into[a] = self._joined(ids[a], ids[b])
        left = (ids >= 0).reshape(rows, length).sum(axis=1)
        data, size = ids[ids >= 0].astype(self.dtype).tobytes(), self.dtype.itemsize
        ends = (np.cumsum(left) * size).tolist()
        return [(data[end - n * size : end], s) for end, n, s in zip(ends, left.tolist(), steps.tolist(), strict=True)]

    def _after(self, keys: list[int]) -> list[int]:
        """By the number of a segmentation and a gap: the one of the same unit and skips, and one more skip after so many merges."""
        fresh = [key for key in keys if key not in self.below]
        numbers, last = [key >> 6 for key in fresh], [key & 63 for key in fresh]
        gaps = []
        for at, gap in zip(numbers, last, strict=True):
            path = [gap]
            while self.parents[at] >= 0:
                path.append(self.after[at])
                at = self.parents[at]
            gaps.append(path[::-1])
        units = list(map(self.units_of.__getitem__, numbers))
        self.below.update(zip(fresh, self._remember(units, numbers, last, self.segment_all(units, gaps)), strict=True))
        return list(map(self.below.__getitem__, keys))

    def _draws(self, stream: int, place: int) -> Iterator[int]:
        """All draws of the unit at ``place``."""
        for k in itertools.count(0, 16):
            yield from self.gaps(np.array([stream]), np.array([place]), np.arange(k, k + 16)).tolist()

    def encode(self, text: str, stream: int = 0) -> np.ndarray:
        """Ids of a whole text, with the model's leading space; an empty text has none. Each ``stream`` has draws of its own."""
        return self.encode_all([text], [stream])[0]

    def encode_all(self, texts: list[str], streams: list[int]) -> list[np.ndarray]:
        """``encode`` of each text with its stream; each step takes the units of all texts at once."""
        if len(self.made) >= REMEMBERED:
            self._forget()
        split = [self.units(" " + t) if t else [] for t in texts]
        flat = list(itertools.chain.from_iterable(split))
        counts = np.array([len(units) for units in split], np.int64)
        ends = np.cumsum(counts)
        self._learn(set(flat).difference(self.known))
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        stream = np.repeat(np.array(streams, np.int64).view(np.uint64), counts)
        place = np.arange(len(flat)) - np.repeat(ends - counts, counts)
        open_, own = np.arange(len(flat)), {}
        for skips in itertools.count():
            gap = self.gaps(stream[open_], place[open_], skips)
            merges = self.steps[at[open_]]
            long = (merges > LONG) & (gap < merges)
            for k in open_[long].tolist():
                own[k] = np.array(self.segment(flat[k], self._draws(stream[k], place[k]))[0], self.dtype).tobytes()
            more = (gap < merges) & ~long
            open_, gap = open_[more], gap[more]
            if not len(open_):
                break
            keys, which = np.unique(at[open_] << 6 | gap, return_inverse=True)
            at[open_] = np.array(self._after(keys.tolist()), np.int64)[which]
        out = list(map(self.made.__getitem__, at.tolist()))
        for k, ids in own.items():
            out[k] = ids
        return [np.frombuffer(b"".join(out[a:b]), self.dtype) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text that ``encode`` got, whatever merges were skipped."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))[1:].decode()


def model(path: str, dropout: float, seed: int) -> PieceModel:
    if (path, dropout, seed) not in _models:
        _models[path, dropout, seed] = PieceModel(path, dropout, seed)
    return _models[path, dropout, seed]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", dropout: float = 0.1, seed: int = 41, copies: bool = False) -> DataFrame:
    """One row per document: key, ids, n_pieces, n_bytes and lossless (decoding gave the text back).

    The draws are keyed by the document's key and text, and by the place of each unit. With
    ``copies`` rows of equal key and text, as a mix makes them, are numbered, which moves the texts
    once, and each has draws of its own; without, repeated rows are alike and nothing is shuffled.
    Rows that over a ``SHARE``-th of all rows equal stay where they are and are told by partition
    and place there, so no task gathers them; their draws then hang on the partitions.
    Null and empty texts have no ids and are lossless; an empty table gives no rows.
    """
    stream = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"), F.lit(seed)).alias("_stream")
    slim = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"), stream)
    if copies:
        begin = len(written)
        counts = materialize(slim.groupBy("_stream").agg(F.count(F.lit(1)).alias("_n")))
        total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        # There are fewer of these than SHARE.
        hot = materialize(counts.where((F.col("_n") > FEW_ROWS) & (F.col("_n") * SHARE > total)).select("_stream"))
        copy = F.row_number().over(Window.partitionBy("_stream").orderBy("_stream"))
        several = slim.join(F.broadcast(hot), "_stream", "left_anti").withColumn("_stream", F.xxhash64("_stream", copy))
        alike = slim.join(F.broadcast(hot), "_stream", "left_semi").withColumn("_stream", F.xxhash64("_stream", F.monotonically_increasing_id()))
        if hot.isEmpty():
            several = slim.withColumn("_stream", F.xxhash64("_stream", copy))
            drop_scratch(docs.sparkSession, written[begin:])
        else:
            several = several.unionByName(alike.select(*several.columns))
            drop_scratch(docs.sparkSession, written[begin:-1])
        slim = several

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pieces", _models.clear)
        pieces = model(path, dropout, seed)
        for whole in batches:
            at = 0
            for _, _, bounds in text_slices(whole.column("_text")):
                batch = whole.slice(at, len(bounds) - 1)
                at += len(batch)
                texts = [t or "" for t in batch.column("_text").to_pylist()]
                with no_cycles():
                    made = pieces.encode_all(texts, batch.column("_stream").to_pylist())
                ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
                flat = np.concatenate(made).astype(np.int32)
                same = [pieces.decode(ids) == t for ids, t in zip(made, texts, strict=True)]
                columns = [batch.column("_key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends), pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, names=["_key", "ids", "n_pieces", "n_bytes", "lossless"])

    kind = slim.schema["_key"].dataType.simpleString()
    return slim.mapInArrow(work, f"_key {kind}, ids array<int>, n_pieces long, n_bytes long, lossless boolean").withColumnRenamed("_key", key)


def decode(encoded: DataFrame, path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """``encoded`` with the texts of its ids in ``name``; null ids give null."""
    kept = encoded.drop(name)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path, 0.0, 0)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = [None if x is None else pieces.decode(np.array(x, np.int64)) for x in rows]
            yield batch.append_column(name, pa.array(texts, pa.string()))

    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, T.StructField(name, T.StringType())]))
