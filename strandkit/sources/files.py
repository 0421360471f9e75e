"""Digests of files of any size.

The driver lists the files; each file is read by one task, range by range, through the
file system of its address, so no file is ever a row.  Address kinds that Arrow's file systems
do not know are read as binary rows instead, which ends at 2 GiB a file.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 8 << 20
SCHEMA = "path string, file string, bytes bigint, sha256 string"


def list_files(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(address, bytes) of the files that a path or pattern names; folders give their files.
    Names that begin with ``_`` or ``.`` are left out, as Spark's readers do."""
    pattern_path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = pattern_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found, waiting = [], list(system.globStatus(pattern_path) or [])
    while waiting:
        status = waiting.pop()
        name = status.getPath().getName()
        if name[:1] in "_.":
            continue
        if status.isDirectory():
            waiting += list(system.listStatus(status.getPath()))
        else:
            found.append((status.getPath().toUri().toString(), status.getLen()))
    return sorted(found)


def digest(address: str, range_bytes: int = RANGE_BYTES) -> str:
    """SHA-256 of one file; no more than one range is held."""
    system, path = pafs.FileSystem.from_uri(address if "://" in address else address.replace(":/", ":///", 1))
    out = hashlib.sha256()
    with system.open_input_stream(path, compression=None) as stream:
        while part := stream.read(range_bytes):
            out.update(part)
    return out.hexdigest()


def _known(address: str) -> bool:
    try:
        pafs.FileSystem.from_uri(address if "://" in address else address.replace(":/", ":///", 1))
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, file, bytes, sha256) of each file."""
    files = list_files(spark, pattern)
    if not files:
        return spark.createDataFrame([], SCHEMA)
    if not _known(files[0][0]):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern).select(
            "path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
        )
    listed = spark.createDataFrame([(p, n, i) for i, (p, n) in enumerate(files)], "path string, bytes long, place int")
    spread = listed.repartitionById(min(len(files), 1000), F.pmod("place", F.lit(min(len(files), 1000))).cast("int"))

    def run(batches):
        for batch in batches:
            paths = batch.column("path").to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column("path"), pa.array([p.rsplit("/", 1)[-1] for p in paths]), batch.column("bytes"), pa.array([digest(p) for p in paths]),
            ], ["path", "file", "bytes", "sha256"])

    return spread.mapInArrow(run, SCHEMA)
