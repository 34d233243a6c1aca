"""A keyed table with a commit log: batches rewrite only the buckets of keys that they touch.

Rows lie in buckets by a hash of their key. A version is a manifest ``_log/<number>.json``
that names the folder of each bucket; it is put in place by a rename that fails where the
number is taken, so a reader sees a version as a whole or not at all, and of two writers one
is told to look again. A manifest also names the last batch of each stream, so a batch that
is played again after a restart changes nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame, DataFrame], DataFrame]
BUCKET = "_bucket"
TRIES = 10


class Conflict(RuntimeError):
    """Another writer has taken the version."""


@dataclass
class Manifest:
    """One version: folder of each bucket that has rows, last batch of each stream."""

    version: int
    key: list[str]
    buckets: int
    schema: str
    folders: dict[int, str] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def of(cls, text: str) -> Manifest:
        x = json.loads(text)
        return cls(**x | {"folders": {int(k): v for k, v in x["folders"].items()}})


class VersionedTable:
    """``path`` may be in any store that Spark reaches; all calls are the driver's, rows stay on the executors."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # -- log ----------------------------------------------------------------------------

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _system(self):
        return self._place("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of all versions, none if there is no table."""
        log = self._place("_log")
        if not self._system().exists(log):
            return []
        names = (str(s.getPath().getName()) for s in self._system().listStatus(log))
        return sorted(int(m[1]) for m in map(re.compile(r"(\d+)\.json$").match, names) if m)

    def manifest(self, version: int | None = None) -> Manifest:
        at = self.versions()[-1] if version is None else version
        stream = self._system().open(self._place(f"_log/{at:020d}.json"))
        try:
            return Manifest.of(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, m: Manifest) -> None:
        """Put a version in place, or raise ``Conflict`` if its number is taken."""
        jvm = self.spark._jvm
        draft, target = self._place(f"_log/.{uuid.uuid4().hex}"), self._place(f"_log/{m.version:020d}.json")
        out = self._system().create(draft)
        out.write(bytearray(m.text().encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._system().makeQualified(draft), self._system().makeQualified(target), options)
        except Py4JJavaError as e:
            self._system().delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {m.version} of {self.path} is taken") from None
            raise

    # -- rows ---------------------------------------------------------------------------

    def _bucket(self, m: Manifest) -> Column:
        return F.pmod(F.xxhash64(*m.key), F.lit(m.buckets)).cast("int")

    def _rows(self, m: Manifest, wanted: set[int] | None = None) -> DataFrame:
        folders = [f for b, f in m.folders.items() if wanted is None or b in wanted]
        if not folders:
            return self.spark.createDataFrame([], m.schema)
        return self.spark.read.schema(m.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def create(self, schema: str, key: list[str], buckets: int) -> VersionedTable:
        """An empty first version; an existing table is left as it is."""
        if not self.versions():
            try:
                self._put(Manifest(0, key, buckets, schema))
            except Conflict:
                pass
        return self

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def commit(self, fresh: DataFrame, merge: Merge, stream: str | None = None, batch: int = 0) -> int:
        """Merge rows into the buckets of their keys; returns the version that holds them.

        ``merge(stored, fresh)`` gets the rows of the touched buckets alone and has to keep rows at
        their keys. A batch that its stream has already committed is left out. Where another
        writer was faster, its version is the new base: what was written is kept if that version
        didn't touch the same buckets, else merged again. A null key is a key.
        """
        base = self.manifest()
        if stream is not None and base.streams.get(stream, -1) >= batch:
            return base.version
        placed = fresh.withColumn(BUCKET, self._bucket(base)).persist()
        try:
            touched = {r[0] for r in placed.select(BUCKET).distinct().collect()}  # at most as many as buckets
            written = self._write(base, placed.drop(BUCKET), touched, merge) if touched else {}
            for _ in range(TRIES):
                folders = {b: f for b, f in base.folders.items() if b not in touched} | written
                streams = base.streams | ({stream: batch} if stream is not None else {})
                try:
                    self._put(Manifest(base.version + 1, base.key, base.buckets, base.schema, folders, streams))
                    return base.version + 1
                except Conflict:
                    newer = self.manifest()
                    if stream is not None and newer.streams.get(stream, -1) >= batch:
                        return newer.version
                    if any(newer.folders.get(b) != base.folders.get(b) for b in touched):
                        written = self._write(newer, placed.drop(BUCKET), touched, merge)
                    base = newer
            raise Conflict(f"{self.path}: {TRIES} other versions came first")
        finally:
            placed.unpersist()

    def _write(self, base: Manifest, fresh: DataFrame, touched: set[int], merge: Merge) -> dict[int, str]:
        """Write the touched buckets anew; their folders."""
        columns = self.spark.createDataFrame([], base.schema).columns
        merged = merge(self._rows(base, touched), fresh).select(*columns).withColumn(BUCKET, self._bucket(base))
        folder = f"data/{uuid.uuid4().hex}"
        merged.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        names = (str(s.getPath().getName()) for s in self._system().listStatus(self._place(folder)))
        found = {int(n.partition("=")[2]): f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}
        if not found.keys() <= touched:
            raise ValueError("merging moved rows to other keys")
        return found

    def vacuum(self, keep: int = 1) -> int:
        """Delete versions but for the last ``keep``, and folders that none of these names; returns the number of folders.

        Only while nothing else writes: folders of a running commit are not named yet.
        """
        numbers = self.versions()
        kept = {f.split("/")[1] for v in numbers[-keep:] for f in self.manifest(v).folders.values()}
        for v in numbers[:-keep]:
            self._system().delete(self._place(f"_log/{v:020d}.json"), False)
        gone = [s.getPath() for s in self._system().listStatus(self._place("data")) if str(s.getPath().getName()) not in kept] if self._system().exists(self._place("data")) else []
        for place in gone:
            self._system().delete(place, True)
        return len(gone)
