"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as runs of small immutable files. Runs of similar size make a tier; a tier that has gathered
enough of them is merged into one run of target-sized files. Readers see what a manifest lists: each commit writes a
new version beside its place and renames it there, which fails if the version exists, so a writer that lost a race
starts again from the newest one. Files that no kept version lists are removed by vacuum.

The rename is exclusive on HDFS and local disks. Object stores without one need a store that gives it (a committer or a
lock); a plain copy-and-delete rename would let two writers commit one version.

Merging concatenates scan partitions without a shuffle. The driver holds file names and sizes, never rows.

Defined results: texts of any length are stored as they are, and rows that tie in every column are all kept; an arrival without rows is committed as a run without files' rows; nulls, repeated rows and extra
columns are stored as they are; all arrivals have the schema of the first; reading a store without runs gives an
empty table; a failed append leaves the manifest as it was.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from .common import hadoop


@dataclass(frozen=True)
class Run:
    path: str
    bytes: int
    files: int


@dataclass
class Manifest:
    version: int = 0
    schema: str | None = None
    runs: list[Run] = field(default_factory=list)


class ConflictError(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """A table of immutable files; see the module."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 256 << 20, fan_in: int = 4, most: int = 32, ratio: float = 2.0):
        self.spark, self.root, self.target_bytes = spark, root.rstrip("/"), target_bytes
        self.fan_in, self.most, self.ratio = fan_in, most, ratio

    # Manifests

    def _file(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:012d}.json"

    def versions(self) -> list[int]:
        fs, p = hadoop(self.spark, f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        return sorted(int(x[1:-5]) for x in names if x.startswith("v") and x.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        found = self.versions()
        if version is None and not found:
            return Manifest()
        fs, p = hadoop(self.spark, self._file(found[-1] if version is None else version))
        stream = fs.open(p)
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        x = json.loads(raw)
        return Manifest(x["version"], x["schema"], [Run(**r) for r in x["runs"]])

    def commit(self, new: Manifest) -> Manifest:
        """Publish a version; ConflictError if it exists."""
        hidden = f"{self.root}/manifest/.{uuid.uuid4().hex}"
        fs, p = hadoop(self.spark, hidden)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        jvm = self.spark._jvm
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(p, jvm.org.apache.hadoop.fs.Path(self._file(new.version)), self.spark.sparkContext._gateway.new_array(kind, 0))
        except Py4JJavaError as e:
            fs.delete(p, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise ConflictError(f"version {new.version} exists") from e
            raise
        return new

    def _change(self, schema: str | None, gone: list[Run], come: list[Run]) -> Manifest:
        """Commit runs that come for runs that go, on top of whatever is newest by then."""
        while True:
            now = self.manifest()
            if any(r not in now.runs for r in gone):
                raise ConflictError("a run to be replaced is no longer there")
            if now.schema and schema and now.schema != schema:
                raise ValueError("an arrival has another schema than the store")
            try:
                return self.commit(Manifest(now.version + 1, now.schema or schema, [r for r in now.runs if r not in gone] + come))
            except ConflictError:
                continue

    # Runs

    def _run(self, path: str) -> Run:
        fs, p = hadoop(self.spark, path)
        files = [x for x in fs.listStatus(p) if x.getPath().getName().startswith("part-")]
        return Run(path, sum(x.getLen() for x in files), len(files))

    def _write(self, df: DataFrame, path: str, by: str | None = None) -> None:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)

    def append(self, df: DataFrame) -> Manifest:
        """Store an arrival as a run."""
        path = f"{self.root}/shards/{uuid.uuid4().hex}"
        self._write(df, path)
        return self._change(df.schema.json(), [], [self._run(path)])

    def append_arrivals(self, df: DataFrame, arrival: Column) -> Manifest:
        """Store rows of several arrivals, each as a run, in one pass and one commit."""
        path, name = f"{self.root}/shards/{uuid.uuid4().hex}", f"arrival_{uuid.uuid4().hex}"
        self._write(df.withColumn(name, arrival), path, name)
        fs, p = hadoop(self.spark, path)
        runs = [self._run(str(x.getPath())) for x in fs.listStatus(p) if x.isDirectory()]
        return self._change(df.schema.json(), [], runs)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(m.schema)) if m.schema else T.StructType()
        if not m.runs:
            return self.spark.createDataFrame([], schema)
        return self._read(m.runs, schema)

    def _read(self, runs: list[Run], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(r.path for r in runs))

    # Compaction

    def tiers(self, runs: list[Run]) -> dict[int, list[Run]]:
        """Runs by the logarithm of their size; those whose files have the target size are done."""
        out: dict[int, list[Run]] = {}
        for r in runs:
            if r.files and r.bytes < r.files * self.target_bytes * 0.75 or not r.files:
                out.setdefault(int(math.log(max(r.bytes, 4096), self.ratio)), []).append(r)
        return out

    def candidates(self, runs: list[Run]) -> list[Run]:
        """The runs to merge next: of the lowest tier, with its neighbour, that has enough of them."""
        tiers = self.tiers(runs)
        for k in sorted(tiers):
            near = sorted(tiers[k] + tiers.get(k + 1, []), key=lambda r: (r.bytes, r.path))
            if len(near) >= self.fan_in:
                return near[: self.most]
        return []

    def compact(self, keep: int | None = None) -> Manifest:
        """Merge tiers until none has enough runs; keep: versions that vacuum leaves after each merge."""
        while True:
            now = self.manifest()
            old = self.candidates(now.runs)
            if not old:
                return now
            df = self._read(old, T.StructType.fromJson(json.loads(now.schema)))
            n = max(1, round(sum(r.bytes for r in old) / self.target_bytes))
            path = f"{self.root}/shards/{uuid.uuid4().hex}"
            self._write(df.coalesce(n), path)
            try:
                self._change(None, old, [self._run(path)])
            except ConflictError:  # another compaction took some of them
                fs, p = hadoop(self.spark, path)
                fs.delete(p, True)
                continue
            if keep:
                self.vacuum(keep)

    def vacuum(self, keep: int = 2, orphan_seconds: float = 86400) -> None:
        """Remove all versions but the last `keep`, the runs that only they list, and what writers left behind.

        Left behind is what no kept version lists and nothing has touched for `orphan_seconds`: the files of an append
        or a merge that failed before its commit. The age has to exceed the longest write.
        """
        versions = self.versions()
        kept = {r.path for v in versions[-keep:] for r in self.manifest(v).runs}
        gone = {r.path for v in versions[:-keep] for r in self.manifest(v).runs} - kept
        for path in [*gone, *(self._file(v) for v in versions[:-keep])]:
            fs, p = hadoop(self.spark, path)
            fs.delete(p, True)
        fs, p = hadoop(self.spark, f"{self.root}/shards")
        names = {x.split("/shards/", 1)[1].split("/", 1)[0] for x in kept}
        before = time.time() * 1000 - 1000 * orphan_seconds
        for x in fs.listStatus(p) if fs.exists(p) else []:
            if x.getPath().getName() not in names and self._touched(fs, x) < before:
                fs.delete(x.getPath(), True)

    def _touched(self, fs, status) -> int:
        """When a folder or anything in it changed last, in milliseconds."""
        if not status.isDirectory():
            return status.getModificationTime()
        return max([status.getModificationTime(), *(self._touched(fs, x) for x in fs.listStatus(status.getPath()))])
