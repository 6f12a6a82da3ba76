"""A table that a stream's batches change in part, with one version of each changed bucket per batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Buckets:
    """Rows in buckets by the hash of their keys, below ``path/v=<batch>/bucket=<b>``.

    A batch reads versions before its own and writes the buckets that it changes, so it can be run again after a failure and
    leaves all other buckets alone. Of each bucket the versions before the last two are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, before: int | None = None) -> dict[int, list[int]]:
        """The versions of each bucket, ascending."""
        path, files = self._files()
        out: dict[int, list[int]] = {}
        for status in files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path, "v=*/bucket=*")) or ():
            version, bucket = (int(part.partition("=")[2]) for part in str(status.getPath().toString()).split("/")[-2:])
            if (before is None or version < before) and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"v={version}/_SUCCESS")):
                out.setdefault(bucket, []).append(version)
        return {b: sorted(v) for b, v in out.items()}

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows after all batches before ``before``; of some buckets ``only``."""
        paths = [f"{self.path}/v={v[-1]}/bucket={b}" for b, v in sorted(self.versions(before).items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the rows' keys, at most ``buckets`` of them."""
        return [r.b for r in rows.select(self.bucket().alias("b")).distinct().collect()]

    def write(self, rows: DataFrame, version: int) -> None:
        """Make ``rows`` the contents of their buckets."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        rows.select(*names).withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={version}")
        path, files = self._files()
        for bucket, held in self.versions().items():
            for old in held[:-2]:
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"v={old}/bucket={bucket}"), True)


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
