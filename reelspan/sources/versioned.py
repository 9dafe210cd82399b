"""The keyed store as a table on disk: hash buckets, versions, and changes that rewrite what they touch.

A folder holds bucket folders of Parquet files and one manifest for each version, which names the folder of
each bucket. A change writes new folders for the buckets that its keys fall into, beside the old ones, and then
moves a manifest of the next number into place, which is what makes it visible, all at once. A change that fails leaves
files that no manifest names; of two that start from one version the second to finish is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.sources.store import purge_test

SCHEMA = "key string, value string"
BUCKETS = 64


class Conflict(RuntimeError):
    """Another change was committed first; begin again from the version that is current now."""


class KeyedTable:
    """A table of (key, value) with one row a key. Buckets are fixed when the table is created; choose as many as keep
    one bucket's rows within a task's reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # Files, by Spark's own file systems.

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        path = self._path("")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        where, path = self._fs(), self._path(name)
        return sorted(s.getPath().getName() for s in where.listStatus(path)) if where.exists(path) else []

    def versions(self) -> list[int]:
        """The numbers of the versions that can be read, in order."""
        return [int(n.removesuffix(".json")) for n in self._names("_versions") if n.endswith(".json") and n[0].isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the last one: its number, how many buckets there are, and
        the folder of each bucket that has rows."""
        found = self.versions()
        if not found or (version is not None and version not in found):
            raise FileNotFoundError(f"{self.folder} has no version {'' if version is None else version}".strip())
        number = found[-1] if version is None else version
        text = self.spark.read.text(f"{self.folder}/_versions/{number:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> int:
        """Moves a manifest into place unless one of its number is there."""
        jvm, name = self.spark._jvm, f"_versions/{manifest['version']:08d}.json"
        fresh, where = self._path(f"_versions/_{uuid.uuid4().hex}"), self._fs()
        out = where.create(fresh)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        rules = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(where.makeQualified(fresh), where.makeQualified(self._path(name)), rules)
        except Exception as e:
            where.delete(fresh, False)
            raise Conflict(f"version {manifest['version']} of {self.folder} is there already") from e
        return manifest["version"]

    # Reading.

    def bucket(self, buckets: int, key: Column | str = "key") -> Column:
        """The bucket of a key."""
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """(key, value) of a version, or of some of its buckets."""
        manifest = self.manifest(version)
        return self._rows(manifest, buckets)

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.folder}/{p}" for b, p in sorted(manifest["folders"].items(), key=lambda x: int(x[0])) if wanted is None or b in wanted]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def values(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of some keys; only the buckets that these fall into are read."""
        manifest = self.manifest(version)
        touched = self._touched(keys.select("key"), manifest)
        return self._rows(manifest, touched).join(keys.select("key").distinct(), "key", "left_semi")

    # Changes.

    def _touched(self, keys: DataFrame, manifest: dict) -> list[int]:
        """The buckets of some keys: at most as many numbers as there are buckets."""
        return [r[0] for r in keys.where("key is not null").select(self.bucket(manifest["buckets"]).alias("b")).distinct().collect()]

    def _write(self, rows: DataFrame, buckets: int) -> dict[str, str]:
        """Writes rows by bucket into a folder of their own, a task a bucket; the folders of the buckets that have rows."""
        data = f"data/{uuid.uuid4().hex}"
        placed = rows.select("key", F.col("value").cast("string").alias("value"), self.bucket(buckets).alias("bucket"))
        placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{data}")
        return {n.removeprefix("bucket="): f"{data}/{n}" for n in self._names(data) if n.startswith("bucket=")}

    def create(self, rows: DataFrame, buckets: int = BUCKETS) -> int:
        """Version 1, of (key, value); of repeated keys the greatest value stays, rows without a key go."""
        one = rows.where("key is not null").groupBy("key").agg(F.max(F.col("value").cast("string")).alias("value"))
        return self._commit({"version": 1, "buckets": buckets, "folders": self._write(one, buckets)})

    def _changed(self, manifest: dict, touched: list[int], rows: DataFrame) -> int:
        """A version whose touched buckets hold ``rows`` and whose others stay as they are, files and all."""
        gone = {str(b) for b in touched}
        kept = {b: p for b, p in manifest["folders"].items() if b not in gone}
        return self._commit({**manifest, "version": manifest["version"] + 1, "folders": kept | self._write(rows, manifest["buckets"])})

    def upsert(self, changes: DataFrame) -> int:
        """Puts in (key, value, change_no); of several changes of a key the last one counts. No changes make no version."""
        manifest = self.manifest()
        last = changes.where("key is not null").groupBy("key").agg(F.max_by(F.col("value").cast("string"), "change_no").alias("value"))
        touched = self._touched(changes, manifest)
        if not touched:
            return manifest["version"]
        kept = self._rows(manifest, touched).join(last.select("key"), "key", "left_anti")
        return self._changed(manifest, touched, kept.unionByName(last))

    def remove(self, keys: DataFrame) -> int:
        """Takes some keys out; keys that aren't there change nothing."""
        manifest = self.manifest()
        there = self.values(keys, manifest["version"]).select("key")
        touched = self._touched(there, manifest)
        if not touched:
            return manifest["version"]
        return self._changed(manifest, touched, self._rows(manifest, touched).join(keys.select("key").distinct(), "key", "left_anti"))

    def purge(self, prefixes: list[str]) -> int:
        """Takes out all keys that begin with any prefix, as written."""
        manifest = self.manifest()
        touched = self._touched(self._rows(manifest).where(purge_test(prefixes)), manifest)
        if not touched:
            return manifest["version"]
        return self._changed(manifest, touched, self._rows(manifest, touched).where(~purge_test(prefixes)))

    def vacuum(self, versions: int = 1) -> list[str]:
        """Drops all but the last ``versions`` versions and the folders that none of them names, with what failed
        changes left; gives the names of the folders. To be run while nothing else changes the table."""
        found, where = self.versions(), self._fs()
        keep = [self.manifest(v) for v in found[-max(versions, 1) :]]
        named = {p for m in keep for p in m["folders"].values()}
        for v in found[: -max(versions, 1)]:
            where.delete(self._path(f"_versions/{v:08d}.json"), False)
        dropped = []
        for data in self._names("data"):
            inside = [f"data/{data}/{n}" for n in self._names(f"data/{data}") if n.startswith("bucket=")]
            dropped += [p for p in inside if p not in named]
            if not any(p in named for p in inside):
                where.delete(self._path(f"data/{data}"), True)
            else:
                for p in inside:
                    if p not in named:
                        where.delete(self._path(p), True)
        return dropped
