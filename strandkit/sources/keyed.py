"""A table of keyed rows in buckets, read only where a batch of keys may meet it.

Rows lie in ``n_buckets`` partitions by a hash of their key.  Each write adds, for every bucket
it touches, a Bloom filter of its keys.  A batch is first held against the filters of its
buckets (``FILTER_BITS`` bits per write and bucket); keys that no filter has are new, and
only the buckets of the others are read.  Filters of many writes are merged by ``compact_filters``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILTER_BITS, FILTER_HASHES = 1 << 16, 4


def _places(keys: list[str]) -> np.ndarray:
    """Bits of each key, [keys, FILTER_HASHES]."""
    two = np.array([divmod(xxhash.xxh3_64_intdigest(k), 1 << 32) for k in keys], dtype=np.int64).reshape(len(keys), 2)
    return (two[:, :1] + np.arange(FILTER_HASHES) * (two[:, 1:] | 1)) % FILTER_BITS


class KeyedStore:
    """Rows (key, ...) under ``path``; the key is a string column."""

    def __init__(self, spark: SparkSession, path: str, key: str = "key", n_buckets: int = 64):
        self.spark, self.path, self.key, self.n_buckets = spark, path, key, n_buckets

    def _exists(self, table: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.n_buckets)).cast("int"))

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; the scan lists only their folders."""
        if not self._exists("rows"):
            return None
        rows = self.spark.read.parquet(f"{self.path}/rows")
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def append(self, rows: DataFrame) -> None:
        """Adds rows; the filters come first, so a key without its row only costs a read."""
        if rows.isEmpty():
            return
        placed, key = self._bucketed(rows), self.key

        def build(table: pa.Table) -> pa.Table:
            bits = np.zeros(FILTER_BITS, dtype=bool)
            bits[_places(table[key].to_pylist()).ravel()] = True
            return pa.table({"bucket": table["bucket"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        # a bucket's keys meet in parts, so that no bucket of a large batch has to fit a task
        parts = placed.select(self.key, "bucket").withColumn("part", F.pmod(F.hash(self.key), F.lit(8)))
        filters = parts.groupBy("bucket", "part").applyInArrow(lambda t: build(t), "bucket int, bits binary")
        filters.withColumn("write", F.lit(uuid.uuid4().hex)).write.mode("append").parquet(f"{self.path}/filters")
        placed.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/rows")

    def may_have(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` whose key some filter of its bucket has, with their bucket."""
        placed = self._bucketed(batch.select(self.key).distinct())
        if not self._exists("filters"):
            return placed.limit(0)
        filters = self.spark.read.parquet(f"{self.path}/filters")
        tagged = placed.select("bucket", F.col(self.key).alias("k"), F.lit(None).cast("binary").alias("bits")).unionByName(
            filters.select("bucket", F.lit(None).cast("string").alias("k"), "bits").join(placed.select("bucket").distinct(), "bucket", "left_semi")
        )
        dealt = tagged.repartition("bucket").sortWithinPartitions("bucket", F.col("bits").isNull())

        def run(batches):
            now, bits = None, None
            for b in batches:
                for i, (bucket, k, raw) in enumerate(zip(*(b.column(c).to_pylist() for c in ("bucket", "k", "bits")))):
                    if bucket != now:
                        now, bits = bucket, []
                    if raw is not None:
                        one = np.unpackbits(np.frombuffer(raw, dtype=np.uint8)).astype(bool)
                        bits.append(one)
                    elif any(one[_places([k])[0]].all() for one in bits):
                        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([bucket], pa.int32())], ["k", "bucket"])

        return dealt.mapInArrow(run, "k string, bucket int").withColumnRenamed("k", self.key)

    def _near(self, batch: DataFrame) -> DataFrame | None:
        """Stored rows of the buckets in which a key of ``batch`` may be."""
        maybe = self.may_have(batch).select("bucket").distinct()
        buckets = sorted(r["bucket"] for r in maybe.collect())  # n_buckets at most
        return self.read(buckets) if buckets else None

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` whose key is not stored."""
        have = self._near(batch)
        return batch if have is None else batch.join(have.select(self.key).distinct(), self.key, "left_anti")

    def matching(self, batch: DataFrame) -> DataFrame | None:
        """The stored rows of the keys in ``batch``; nothing if there are none."""
        have = self._near(batch)
        return have if have is None else have.join(batch.select(self.key).distinct(), self.key, "left_semi").drop("bucket")

    def compact_filters(self) -> None:
        """One filter per bucket instead of one per write and bucket."""
        def merge(table: pa.Table) -> pa.Table:
            bits = np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in table["bits"].to_pylist()])
            return pa.table({"bucket": table["bucket"].slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

        target = f"{self.path}/filters-{uuid.uuid4().hex}"
        filters = self.spark.read.parquet(f"{self.path}/filters")
        filters.select("bucket", "bits").groupBy("bucket").applyInArrow(lambda t: merge(t), "bucket int, bits binary").withColumn(
            "write", F.lit(uuid.uuid4().hex)
        ).write.parquet(target)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        old, new = hadoop(f"{self.path}/filters"), hadoop(target)
        system = old.getFileSystem(self.spark._jsc.hadoopConfiguration())
        system.delete(old, True)
        system.rename(new, old)
