"""Writers and readers of the tables a corpus consists of."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkit import constants as C
from strandkit.functions import columns as fc


# -- corpus -------------------------------------------------------------------

def write_corpus(df: DataFrame, path: str, mode: str = "overwrite", order: str | None = None) -> None:
    """With ``order`` the files follow each other by that column, each sorted."""
    rows = df if order is None else df.repartitionByRange(order).sortWithinPartitions(order)
    rows.write.mode(mode).parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_fasta(df: DataFrame, path: str, ident: str, name: str, seq: str, wrap: int | None = None) -> None:
    record = fc.fasta_record(F.col(ident), F.coalesce(F.col(name), F.lit("")), F.col(seq), wrap)
    df.select(record.alias("value")).write.mode("overwrite").text(path)


# -- embedding store (id, pooling, vector), one folder per pooling --------------

def write_store(vectors: DataFrame, path: str, model: str, corpus_hash: str, wall_seconds: float | None = None, mode: str = "overwrite") -> None:
    rows = vectors.withColumn("vector", F.col("vector").cast("array<float>"))
    rows.write.mode(mode).partitionBy("pooling").parquet(f"{path}/vectors")
    stored = vectors.sparkSession.read.parquet(f"{path}/vectors")
    meta = stored.agg(
        F.lit(model).alias("model"), F.lit(C.EMBEDDING_VERSION).alias("embedding_version"),
        F.max(F.size("vector")).alias("dim"), F.array_sort(F.collect_set("pooling")).alias("poolings"),
        F.countDistinct("id").alias("n_rows"), F.lit(corpus_hash).alias("corpus_hash"),
        F.lit(wall_seconds).cast("double").alias("wall_seconds"),
        F.lit(datetime.now(timezone.utc).isoformat()).alias("created_at"),
    )
    meta.coalesce(1).write.mode(mode).json(f"{path}/meta")


def read_store(spark: SparkSession, path: str, pooling: str | None = None) -> DataFrame:
    """(id, vector) of one pooling, read from its folder only; an error if unknown."""
    rows = spark.read.parquet(f"{path}/vectors")
    if pooling is None:
        return rows
    known = store_meta(spark, path)["poolings"]
    if pooling not in known:
        raise KeyError(f"no stored vectors for pooling {pooling!r}; stored: {sorted(known)}")
    return rows.filter(F.col("pooling") == pooling).drop("pooling")


def store_meta(spark: SparkSession, path: str) -> dict:
    latest = spark.read.json(f"{path}/meta").orderBy(F.desc("created_at")).first()
    return latest.asDict(recursive=True)


def stored_vector(spark: SparkSession, path: str, ident: str, pooling: str) -> DataFrame:
    row = read_store(spark, path, pooling).filter(F.col("id") == ident)
    if row.limit(1).count() == 0:
        raise KeyError(f"{ident!r} is not in the embedding store")
    return row


# -- payloads -----------------------------------------------------------------

def write_map(points: DataFrame, path: str, pooling: str, preset: str = "default") -> None:
    if preset not in C.MAP_PRESETS:
        raise KeyError(f"unknown map preset {preset!r}; options: {sorted(C.MAP_PRESETS)}")
    tagged = points.withColumn("pooling", F.lit(pooling)).withColumn("preset", F.lit(preset))
    # each run replaces its own (pooling, preset) folder only
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pooling", "preset").json(path)


def read_map(spark: SparkSession, path: str, pooling: str, preset: str = "default") -> DataFrame:
    return spark.read.json(path).filter((F.col("pooling") == pooling) & (F.col("preset") == preset))


def write_clusters(summaries: DataFrame, path: str) -> None:
    summaries.write.mode("overwrite").json(path)


def write_splits(splits: DataFrame, path: str, summary: dict) -> None:
    splits.write.mode("overwrite").parquet(f"{path}/splits")
    spark = splits.sparkSession
    spark.createDataFrame([(json.dumps(summary),)], "summary string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def read_splits(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    summary = json.loads(spark.read.text(f"{path}/summary").first()[0])
    return spark.read.parquet(f"{path}/splits"), summary


def write_report(df: DataFrame, path: str) -> None:
    """One CSV file: report tables hold one row per representation and task."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_profiles(profiles: DataFrame, path: str, ident: str = "accession", buckets: int = 256) -> None:
    """One JSON document per row, spread over a fixed number of folders by id."""
    bucket = F.pmod(F.xxhash64(ident), F.lit(buckets)).cast("int")
    profiles.select(bucket.alias("bucket"), F.to_json(F.struct("*")).alias("value")).write.mode(
        "overwrite"
    ).partitionBy("bucket").text(path)


# -- run log ------------------------------------------------------------------

RUN_SCHEMA = "run_id string, kind string, created_at timestamp, config map<string,string>, metrics map<string,double>"


def log_run(spark: SparkSession, path: str, kind: str, config: dict, metrics: dict) -> str:
    """Append one run record; returns its id."""
    run_id = str(uuid.uuid4())
    settings, figures = {k: str(v) for k, v in config.items()}, {k: float(v) for k, v in metrics.items()}
    row = spark.createDataFrame([(run_id, kind, datetime.now(timezone.utc), settings, figures)], RUN_SCHEMA)
    row.coalesce(1).write.mode("append").json(path)
    return run_id


def read_runs(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    runs = spark.read.schema(RUN_SCHEMA).json(path)
    runs = runs.select("run_id", "kind", "created_at", *[F.to_json(c).alias(c) for c in ("config", "metrics")])
    return runs if kind is None else runs.filter(F.col("kind") == kind)


# -- fingerprints -------------------------------------------------------------

def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row (n_rows, fingerprint) that ignores row order and partitioning.

    A row is the md5 of its values as text, each with its length before it; the first 60 bits
    are added in a wide decimal, so equal rows do not cancel out.
    """
    text = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *[text(c) for c in df.columns])), 1, 15), 16, 10)
    total = F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.substring(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), total.cast("string")), 256), 1, 16).alias("fingerprint"),
    )


# -- versioned projections ----------------------------------------------------

def load_or_project(points: DataFrame, path: str, params: dict, compute) -> tuple[DataFrame, bool]:
    """Coordinates for a parameter set, from the table when they fit the data.

    A version is named by the hash of a struct of the parameters together with the
    fingerprint of the data.  It counts as stored once its write has finished, and only if it
    has as many rows as the data: a folder that was copied or cut short is computed again.
    """
    spark = points.sparkSession
    named = F.struct(*[F.lit(str(params[p])).alias(p) for p in sorted(params)], F.lit(0).alias("__end"))
    key, n_rows = table_fingerprint(points).select(F.sha2(F.concat_ws(":", F.to_json(named), "fingerprint"), 256), "n_rows").first()
    target = f"{path}/version={key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        stored = spark.read.parquet(target)
        if stored.count() == n_rows:
            return stored, True
    compute(points).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target), False


def encoder_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        C.ENCODER_REGISTRY,
        "encoder string, slug string, family string, params_m int, hidden_size int, layers int, "
        "weights_gb double, min_ram_gb int, token_budget int",
    )


def encoder_slug(encoder: str) -> str:
    for row in C.ENCODER_REGISTRY:
        if row[0] == encoder:
            return row[1]
    raise KeyError(f"unknown encoder {encoder!r}; registered: {[r[0] for r in C.ENCODER_REGISTRY]}")


def write_encoder_vectors(vectors: DataFrame, path: str, slug: str) -> None:
    """Vectors of one encoder in their own folder, next to the others."""
    vectors.withColumn("encoder", F.lit(slug)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("encoder", "pooling").parquet(path)
