"""Small helpers shared by the text operators."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkit.session import ship_package

# White space of the contracts: space and the ASCII control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
# Rows and bytes handed to a Python worker at once; texts may be long.
BATCH_ROWS = "2000"
BATCH_BYTES = "32m"


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to the executors and keep Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return ship_package(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a batch; a null counts as empty."""
    for value in batch.column(batch.schema.get_field_index(column)):
        yield value.as_py() or ""


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are written.

    It does so when the driver has collected the last reference to a shuffle, which
    an idle driver may not do before the disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def arrow_rows(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n, c in columns.items()], schema=schema
    )


def hex64(column: str):
    """A long as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")
