"""Folders of data that change by manifests: a reader sees one version whole, a writer that dies leaves the last one.

Data lie below ``data`` in folders that are written once and never changed. ``versions`` has numbered
JSON files; each names the data folders of its version. A version is there when its file is, which
is written under another name and then renamed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Versioned:
    """A versioned folder on any file system that Spark reaches. Writers commit one after another: a second
    one that started from the same version is refused, and starts again from the new one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _place(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def names(self, path: str) -> list[str]:
        """Names of what lies in a folder of this table; none if it isn't there."""
        fs, place = self._place(f"{self.folder}/{path}")
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def version(self) -> int:
        """The number of the last version; 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in self.names("versions") if n.endswith(".json") and n[0].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{version:09d}.json", wholetext=True).first()[0])

    def fresh(self) -> str:
        """A data folder that no version has, relative to this one."""
        return f"data/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, *by: str) -> str:
        """``df`` as a fresh data folder, in folders by the columns ``by``."""
        path = self.fresh()
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(f"{self.folder}/{path}")
        return path

    def read(self, schema, paths: list[str]) -> DataFrame:
        """The rows of these data folders, whose files alone are listed; an empty table for none."""
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths])

    def commit(self, manifest: dict, base: int) -> int:
        """Make ``manifest`` the version after ``base``; an error if that is taken."""
        final = f"{self.folder}/versions/{base + 1:09d}.json"
        fs, place = self._place(final)
        _, early = self._place(f"{self.folder}/versions/.{uuid.uuid4().hex}")
        out = fs.create(early, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if fs.exists(place) or not fs.rename(early, place):
            fs.delete(early, False)
            raise RuntimeError(f"version {base + 1} was written by another; start again from it")
        return base + 1

    def remove(self, *paths: str) -> None:
        for path in paths:
            fs, place = self._place(f"{self.folder}/{path}")
            fs.delete(place, True)

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests before the last ``keep``, and data folders that no kept one names; how many folders went."""
        numbers = sorted(int(n.removesuffix(".json")) for n in self.names("versions") if n.endswith(".json") and n[0].isdigit())
        kept = numbers[-keep:]
        named = " ".join(json.dumps(self.manifest(n)) for n in kept)
        self.remove(*[f"versions/{n:09d}.json" for n in numbers[:-keep]])
        gone = [n for n in self.names("data") if n not in named]
        self.remove(*[f"data/{n}" for n in gone])
        return len(gone)
