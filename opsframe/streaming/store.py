"""A table with one row per key, kept beside a stream and replaced bucket by bucket."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyStore:
    """Rows by key in ``buckets`` hashed buckets, versioned by batch.

    Batch N reads the newest versions before N of the buckets its keys fall into, and writes those buckets anew as version
    N.  Untouched buckets are neither read nor written.  A batch that is repeated after a failure finds what it started
    from and writes the same version again; a version is removed once a later one has a successor.  The driver sees folder
    names only, at most two for each bucket.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], schema: str, buckets: int = 64):
        self.spark, self.folder, self.keys, self.schema, self.buckets = spark, folder.rstrip("/"), list(keys), schema, buckets

    def bucket(self, keys: Sequence[str] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(keys or self.keys)), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, keys: Sequence[str] | None = None) -> list[int]:
        """Buckets the keys of ``rows`` fall into."""
        return [r[0] for r in rows.select(self.bucket(keys)).distinct().collect()]

    def _versions(self) -> list[tuple[int, int]]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v=*/bucket=*")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return [tuple(map(int, re.search(r"v=(\d+)/bucket=(\d+)$", s.getPath().toString()).groups())) for s in found]

    def _newest(self, batch_id: int) -> dict[int, int]:
        newest: dict[int, int] = {}
        for v, b in self._versions():
            if v < batch_id:
                newest[b] = max(v, newest.get(b, v))
        return newest

    def read(self, batch_id: int, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows as the batches before left them, of some buckets or of all."""
        newest = self._newest(batch_id)
        paths = [f"{self.folder}/v={v}/bucket={b}" for b, v in newest.items() if buckets is None or b in set(buckets)]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """The whole contents of the touched buckets after this batch."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        out = rows.select(*names).withColumn("bucket", self.bucket())
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/v={batch_id}")
        newest, jvm = self._newest(batch_id), self.spark._jvm.org.apache.hadoop.fs
        for v, b in self._versions():
            if v < newest.get(b, 0):
                old = jvm.Path(f"{self.folder}/v={v}/bucket={b}")
                old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def latest(self) -> DataFrame:
        return self.read(1 << 62)
