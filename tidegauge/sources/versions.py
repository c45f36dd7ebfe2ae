"""A keyed table in numbered versions, cut into buckets; a new version rewrites only the buckets it touches.

Layout under the root: ``data/v=N/bucket=B`` holds a bucket as version N wrote it, ``manifests/v=N``
one row per bucket with the version that wrote it last. A version is made from the one before it and
written under its own number, so making it again gives the same table and nothing twice. The two
newest versions stay readable; files that neither of them names are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table; a bucket should fit a few files of a sensible size.
BUCKETS = 64


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, key: str, schema: str, *, buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.schema, self.buckets = spark, root.rstrip("/"), key, schema, buckets

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> list:
        """(bucket, wrote, v) of the versions on record: buckets times versions kept."""
        try:
            return self.spark.read.schema("bucket int, wrote long").json(f"{self.root}/manifests").select("bucket", "wrote", F.col("v").cast("long").alias("v")).collect()
        except AnalysisException:
            return []

    def manifest(self, *, before: int | None = None) -> dict[int, int]:
        """Bucket -> version that wrote it, as of the newest version (before a given one)."""
        rows = [r for r in self._manifests() if before is None or r.v < before]
        newest = max((r.v for r in rows), default=None)
        return {r.bucket: r.wrote for r in rows if r.v == newest}

    def _read(self, manifest: dict[int, int], buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/data/v={v}/bucket={b}" for b, v in sorted(manifest.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The newest version."""
        return self._read(self.manifest())

    def touched(self, keys: DataFrame) -> list[int]:
        return [r[0] for r in keys.select(self.bucket()).distinct().collect()]  # as many as buckets at most

    def before(self, version: int, keys: DataFrame) -> DataFrame:
        """Rows of the version before, of the buckets that hold the given keys."""
        return self._read(self.manifest(before=version), self.touched(keys))

    def write(self, version: int, changed: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Version ``version`` as ``combine(old rows, changed rows)`` of the buckets that hold a changed key; returns those."""
        manifest, touched = self.manifest(before=version), self.touched(changed)
        if touched:
            out = combine(self._read(manifest, touched), changed).withColumn("bucket", self.bucket())
            out.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/v={version}")
        manifest |= dict.fromkeys(touched, version)
        if manifest:
            (self.spark.createDataFrame([(b, v) for b, v in sorted(manifest.items())], "bucket int, wrote long").coalesce(1)
             .write.mode("overwrite").json(f"{self.root}/manifests/v={version}"))
        self._expire()
        return touched

    def _expire(self, keep: int = 2) -> None:
        rows = self._manifests()
        versions = sorted({r.v for r in rows})
        named = {(r.bucket, r.wrote) for r in rows if r.v in versions[-keep:]}
        gone = {(r.bucket, r.wrote) for r in rows} - named
        for path in [f"data/v={v}/bucket={b}" for b, v in gone] + [f"manifests/v={v}" for v in versions[:-keep]]:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
