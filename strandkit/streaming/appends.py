"""Batch operators driven by file streams: appends, searches, cache upserts.

Each micro-batch runs the batch operator in ``foreachBatch``.  What is stored already is left
out through keyed stores, which read only the buckets that a batch may meet, so a repeated
batch changes nothing.  Of equal sequences in different batches the first one to arrive
stays: the digests of the stored sequences have a store of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from strandkit import constants as C
from strandkit.operators.embed import Encoder, embed, valid_sequences, with_keys
from strandkit.operators.knn import knn
from strandkit.operators.sampling import dedup_exact
from strandkit.plans.corpus import BuildOptions, checked_entries
from strandkit.session import drop_table, reliable_checkpoint
from strandkit.sources.entries import derive_fields
from strandkit.sources.keyed import KeyedStore


def _without(rows: DataFrame, path: str, key: str, stored: str) -> DataFrame:
    """Rows that the table at ``path`` lacks; it may not exist."""
    spark = rows.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return rows
    return rows.join(spark.read.parquet(path).select(F.col(stored).alias(key)).distinct(), key, "left_anti")


def append_stream(
    entries: DataFrame, corpus_path: str, store_path: str, encoder: Encoder, checkpoint: str,
    poolings: tuple[str, ...] = ("mean",), options: BuildOptions = BuildOptions(),
) -> DataStreamWriter:
    """New entries: validate, deduplicate, derive, embed, append.

    An entry is new if neither its accession nor its sequence is stored.  A batch leaves a mark
    while it writes; one that finds its mark did not end before, and writes only what is missing.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{corpus_path}_writing/{batch_id}")
        system = mark.getFileSystem(spark._jsc.hadoopConfiguration())
        again = system.exists(mark)
        system.mkdirs(mark)
        digests = KeyedStore(spark, f"{corpus_path}_digests", "digest")
        names = KeyedStore(spark, f"{corpus_path}_names", "accession")
        vectors_of = KeyedStore(spark, f"{store_path}_ids", "id")
        valid = checked_entries(batch, options).filter("reason is null").drop("reason")
        unique = dedup_exact(valid, "sequence", "accession").dropDuplicates(["accession"])
        fresh = names.unseen(digests.unseen(unique.withColumn("digest", F.sha2("sequence", 256))))
        if again:
            fresh = _without(fresh, corpus_path, "accession", "accession")
        rows = reliable_checkpoint(derive_fields(fresh).select(*C.CORPUS_COLUMNS, "digest"))
        missing = vectors_of.unseen(rows.select(F.col("accession").alias("id"), "sequence"))
        if again:
            missing = _without(missing, f"{store_path}/vectors", "id", "id")
        missing = reliable_checkpoint(missing)
        vectors = embed(missing, encoder, "id", "sequence", poolings, lengths=options.lengths, alphabet=options.alphabet)
        vectors.withColumn("vector", F.col("vector").cast("array<float>")).write.mode("append").partitionBy("pooling").parquet(f"{store_path}/vectors")
        vectors_of.append(missing.select("id"))
        rows.drop("digest").write.mode("append").parquet(corpus_path)
        names.append(rows.select("accession"))
        digests.append(rows.select("digest"))
        system.delete(mark, True)
        drop_table(rows)
        drop_table(missing)

    return entries.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def search_stream(
    records: DataFrame, store: DataFrame, encoder: Encoder, out_path: str, checkpoint: str, k: int = 10,
    lengths: tuple[int, int] = C.ADHOC_LENGTHS, alphabet: str = C.AMINO_ACIDS,
) -> DataStreamWriter:
    """Hits of arriving (id, sequence) records against a static store.

    Every record has its hits, also if records share an id; a sequence is searched once per batch."""
    kind = "string" if dict(store.dtypes)["id"] == "string" else "bigint"
    static = store.withColumn("id", F.col("id").cast(kind))

    def apply(batch: DataFrame, batch_id: int) -> None:
        valid = valid_sequences(batch, "id", "sequence", lengths, alphabet).filter("reason is null")
        digested = valid.select("id", F.sha2("sequence", 256).alias("digest"), "sequence")
        distinct = digested.groupBy("digest").agg(F.first("sequence").alias("sequence"))
        # the numbers stand for sequences in both joins, so they are written once
        texts = reliable_checkpoint(distinct.withColumn("key", F.monotonically_increasing_id().cast(kind)))
        vectors = reliable_checkpoint(embed(texts, encoder, "key", lengths=lengths, alphabet=alphabet))
        hits = knn(vectors, static, k, exclude_self=False).withColumnRenamed("query_id", "key")
        records = digested.select(F.col("id").alias("query_id"), "digest").join(texts.select("digest", "key"), "digest")
        # one folder per batch: a repeated batch replaces its own output
        records.join(hits, "key").select("query_id", "rank", "id", "similarity").write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        drop_table(texts)
        drop_table(vectors)

    return records.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def cache_stream(
    records: DataFrame, cache_path: str, encoder: Encoder, checkpoint: str, pooling: str = "mean",
    lengths: tuple[int, int] = C.ADHOC_LENGTHS, alphabet: str = C.AMINO_ACIDS,
) -> DataStreamWriter:
    """Vectors of arriving sequences, appended under their key; the last write of a
    key wins when the cache is read."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        cache = KeyedStore(batch.sparkSession, cache_path)
        valid = valid_sequences(batch, "id", "sequence", lengths, alphabet).filter("reason is null")
        keyed = with_keys(valid, "sequence", encoder.name, pooling)
        distinct = keyed.groupBy("key").agg(F.first("sequence").alias("sequence"))
        missing = cache.unseen(distinct)
        vectors = embed(missing, encoder, "key", "sequence", (pooling,), lengths=lengths, alphabet=alphabet)
        written = reliable_checkpoint(vectors.select(F.col("id").alias("key"), "vector", F.lit(batch_id).cast("long").alias("written")))
        cache.append(written)
        drop_table(written)

    return records.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
