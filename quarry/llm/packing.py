"""Token ids in files of fixed-width bits.

A file holds blocks of ids at the least width that fits the vocabulary, then an index: the
documents' keys and starts, the blocks' byte offsets, and a JSON trailer. Any run of ids is read
by unpacking the blocks that it touches, with numpy and without the rest of the file.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, no_cycles, scratch_dir, text_slices
from .tokens import word_encoder

MAGIC = b"QBITS001"

#: Ids in a block: a multiple of 64, so that blocks end on whole 64-bit words.
BLOCK = 1 << 16


def width_for(vocabulary: int) -> int:
    """The fewest bits that tell ``vocabulary`` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as little-endian bit fields of ``width`` bits, padded with zeros to groups of 64 ids."""
    groups = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(groups), width), "<u8")
    for k in range(64):
        word, bit = divmod(k * width, 64)
        words[:, word] |= groups[:, k] << np.uint64(bit)
        if bit + width > 64:
            words[:, word + 1] |= groups[:, k] >> np.uint64(64 - bit)
    return words.tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    """The first ``count`` ids of what ``pack`` made."""
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    groups = np.empty((len(words), 64), np.uint64)
    for k in range(64):
        word, bit = divmod(k * width, 64)
        groups[:, k] = words[:, word] >> np.uint64(bit)
        if bit + width > 64:
            groups[:, k] |= words[:, word + 1] << np.uint64(64 - bit)
    return (groups & np.uint64((1 << width) - 1)).reshape(-1)[:count].astype(np.uint32)


class PackedWriter:
    """Writes one file in whole blocks; it appears under its name only when complete."""

    def __init__(self, uri: str, width: int):
        self.files, self.path = fs.FileSystem.from_uri(uri)
        self.width, self.count, self.keys, self.starts = width, 0, [], []
        self.offsets, self.waiting, self.held = [len(MAGIC)], [], 0
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
        self.out = self.files.open_output_stream(self.part)
        self.out.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.starts.append(self.count)
        self.count += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 16 * BLOCK:
            self._write(self.held // BLOCK * BLOCK)

    def _write(self, many: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        for at in range(0, many, BLOCK):
            data = pack(ids[at : min(at + BLOCK, many)], self.width)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.waiting, self.held = [ids[many:]], len(ids) - many

    def close(self) -> None:
        self._write(self.held)
        null = np.array([k is None for k in self.keys], np.uint8)
        index = b"".join([np.array([k or 0 for k in self.keys], "<i8").tobytes(), null.tobytes(), np.array([*self.starts, self.count], "<i8").tobytes(), np.array(self.offsets, "<i8").tobytes()])
        about = json.dumps({"width": self.width, "block": BLOCK, "documents": len(self.keys), "ids": self.count, "index": self.offsets[-1]}).encode()
        self.out.write(index + about + len(about).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.files.move(self.part, self.path)


class PackedFile:
    """Random access to one file: ``keys``, ``starts`` and any run of ids."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no whole file of packed ids")
        length = int.from_bytes(tail[:8], "little")
        about = json.loads(self.file.read_at(length, size - 16 - length))
        self.width, self.block, self.count, n = about["width"], about["block"], about["ids"], about["documents"]
        index = self.file.read_at(size - 16 - length - about["index"], about["index"])
        keys, null = np.frombuffer(index, "<i8", n), np.frombuffer(index, np.uint8, n, 8 * n)
        self.keys = [None if x else int(k) for k, x in zip(keys, null, strict=True)]
        self.starts = np.frombuffer(index, "<i8", n + 1, 9 * n)
        self.offsets = np.frombuffer(index[9 * n + 8 * (n + 1) :], "<i8")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file; only the blocks that hold them are read."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        count = min(self.count, (last + 1) * self.block) - first * self.block
        return unpack(data, self.width, count)[start - first * self.block : stop - first * self.block]


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, part, writer = word_encoder(tokenizer), TaskContext.get().partitionId(), None
    uri = f"{folder}/part-{part:06d}.bits"
    end = np.array([end_id], encoder.dtype)
    for batch in batches:
        texts = batch.column("_text")
        keys = batch.column("_key").to_pylist()
        for row, data, bounds in text_slices(texts):
            held = data.tobytes()
            with no_cycles():
                made = encoder.encode(held[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))
            for k, ids in enumerate(made):
                writer = writer or PackedWriter(uri, width_for(encoder.vocabulary))
                writer.add(keys[row + k], np.concatenate([ids, end]))
    if writer:
        writer.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "uri": [uri], "ids": pa.array([writer.count], pa.int64()), "documents": pa.array([len(writer.keys)], pa.int64())})


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Encode whole texts and write them, in ascending order of the key, to files below ``folder``.

    The files' list is returned: part, uri, ids, documents. Rows are dealt by ranges of the key (a
    bigint), so file order and place in the file are key order; null keys come first, rows of one
    key are ordered by text. Null and empty texts hold the end id only. Nothing is written for an
    empty table. A task that runs again writes the same file again; ``folder`` must be a place
    that all executors reach (a fresh scratch folder by default).
    """
    folder = folder or f"{scratch_dir(docs.sparkSession)}/bits"
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{text}`").alias("_text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.repartitionByRange(parts, "_key").sortWithinPartitions("_key", "_text")
    files = dealt.mapInArrow(lambda batches: _write_part(batches, folder, tokenizer, end_id), "part int, uri string, ids long, documents long")
    return materialize(files)


def _read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
            file = PackedFile(uri)
            starts, at = file.starts, 0
            while at < len(file.keys):
                end = max(at + 1, int(np.searchsorted(starts, starts[at] + 64 * file.block, "right")) - 1)
                ids = file.ids(int(starts[at]), int(starts[end])).astype("<u4")
                places = starts[at : end + 1] - starts[at]
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(places[:-1], places[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(file.keys[at:end], pa.int64()), "start": pa.array(starts[at:end] + base, pa.int64()), "n_tokens": pa.array(np.diff(places), pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})
                at = end


def read_back(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc key, start (ids of all documents before it), n_tokens and ids_crc32, from the files alone.

    Each file is read by one task, some blocks at a time. Only the list of files, one row for each,
    is summed up in one place.
    """
    before = F.expr("coalesce(sum(ids) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    placed = files.select("uri", before.alias("base"))
    dealt = placed.repartition(max(1, files.count()), "uri")
    return dealt.mapInArrow(_read_part, "doc_id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("doc_id", key)
