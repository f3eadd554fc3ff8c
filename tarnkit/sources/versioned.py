"""Stored tables that change: rows of an owner are deleted, replaced or upserted, all or nothing.

A table is a folder of data files, in buckets by a hash of the owner, and of manifests, one a
version, each naming the folders that hold every bucket. A change reads the buckets it touches,
writes them anew beside the old ones, and moves its manifest into place last; that move fails
where another writer was first, and nothing shows then. A reader takes one manifest and keeps to
it, whatever is written meanwhile. Buckets that a change doesn't touch aren't read or
written; a manifest has a line a bucket, so it doesn't grow with the table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnkit.operators import tables as T
from tarnkit.sources.shared import written

BUCKETS = 64
SPREAD = 4  # files of a bucket that a change writes at most: a hot owner is more than one task's work


class Conflict(Exception):
    """Another writer made the version first."""


class VersionedTable:
    """A table in a folder that all executors share. owner: the column by which rows are deleted and replaced."""

    def __init__(self, spark: SparkSession, folder: str, owner: str = "document_id", buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.owner, self.buckets = spark, folder.rstrip("/"), owner, buckets
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # versions

    def versions(self) -> list[int]:
        """The versions that are complete, oldest first."""
        place = self._path(f"{self.folder}/versions")
        if not self._fs.exists(place):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(place)]
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, version: int | None = None) -> dict:
        if version is None:
            known = self.versions()
            if not known:
                raise FileNotFoundError(f"no version of a table in {self.folder}")
            version = known[-1]
        stream = self._fs.open(self._path(f"{self.folder}/versions/{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> int:
        """Move a manifest into place: what makes its version, and the only step that readers see."""
        target = self._path(f"{self.folder}/versions/{manifest['version']:012d}")
        draft = self._path(f"{self.folder}/drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        self._fs.mkdirs(target.getParent())
        try:
            context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(draft, target, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} was made by another writer") from None
            raise
        return manifest["version"]

    # reading

    def _bucket(self, owner: Column) -> Column:
        return F.pmod(F.xxhash64(owner.cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, the newest by default; only: of these buckets."""
        return self._rows(self._manifest(version), only)

    def _rows(self, manifest: dict, only: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [p for b, p in manifest["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def of(self, owners: list, version: int | None = None) -> DataFrame:
        """The rows of some owners; only their buckets are read."""
        frame = self.spark.createDataFrame([(o,) for o in owners], f"{self.owner} {self._kind(version)}")
        return self.read(version, self._touched(frame)).where(F.col(self.owner).isin(owners))

    def _kind(self, version: int | None) -> str:
        return StructType.fromJson(self._manifest(version)["schema"])[self.owner].dataType.simpleString()

    # writing

    def _put(self, rows: DataFrame) -> dict[str, str]:
        """Write rows by bucket; the folder of each bucket that has some."""
        place = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket_", self._bucket(F.col(self.owner))).repartition("bucket_", F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)))
        dealt.write.partitionBy("bucket_").parquet(f"{self.folder}/{place}")
        status = self._fs.listStatus(self._path(f"{self.folder}/{place}"))
        names = [s.getPath().getName() for s in status if s.isDirectory()]
        return {n.split("=")[1]: f"{place}/{n}" for n in names if n.startswith("bucket_=")}

    def create(self, rows: DataFrame) -> int:
        """The first version."""
        return self._commit({"version": 1, "schema": rows.schema.jsonValue(), "buckets": self._put(rows)})

    def _touched(self, owners: DataFrame) -> list[int]:
        return [r.b for r in owners.select(self._bucket(F.col(self.owner)).alias("b")).distinct().collect()]  # as many as there are buckets

    def _change(self, owners: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """A new version in which change was applied to the buckets of owners."""
        old = self._manifest()
        touched = self._touched(owners)
        current = self._rows(old, touched)
        made = self._put(change(current).select(*current.columns)) if touched else {}
        kept = {b: p for b, p in old["buckets"].items() if int(b) not in touched}
        return self._commit({"version": old["version"] + 1, "schema": old["schema"], "buckets": kept | made})

    def delete(self, owners: DataFrame) -> int:
        """Drop all rows of the given owners."""
        owners = written(owners.select(self.owner).distinct(), "owners")
        return self._change(owners, lambda rows: T.delete_by(rows, owners, [self.owner]))

    def replace(self, rows: DataFrame, owners: DataFrame | None = None) -> int:
        """rows in place of all that their owners, and any further owners given, have now."""
        rows = written(rows, "rows")
        every = rows.select(self.owner) if owners is None else rows.select(self.owner).unionByName(owners.select(self.owner))
        every = written(every.distinct(), "owners")
        return self._change(every, lambda old: T.replace_for(old, rows, every, self.owner))

    def upsert(self, changes: DataFrame, key: list[str], order: str) -> int:
        """changes in place of rows with their key, of several the last by order; key holds the owner."""
        if self.owner not in key:
            raise ValueError("the key must hold the owner")
        changes = written(changes, "changes")
        return self._change(changes, lambda old: T.upsert(old, changes, key, order))

    def expire(self, keep: int = 2) -> int:
        """Drop all but the newest versions and the folders that only they name; how many versions went.

        Readers of a dropped version fail: call it when none can be left."""
        known = self.versions()
        gone, kept = known[:-keep], known[-keep:]
        named = {p.split("/")[1] for v in kept for p in self._manifest(v)["buckets"].values()}
        old = {p.split("/")[1] for v in gone for p in self._manifest(v)["buckets"].values()}
        for v in gone:
            self._fs.delete(self._path(f"{self.folder}/versions/{v:012d}"), False)
        for place in old - named:
            self._fs.delete(self._path(f"{self.folder}/data/{place}"), True)
        return len(gone)
