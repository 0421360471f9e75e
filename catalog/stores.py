"""Round trips through the sinks and streams: written to the checkpoint folder, read back.

Every call writes under a folder of its own, so reruns never meet older files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import query, table, vector_digest, vector_digest_sql
from catalog.corpus import DERIVED_SQL, ENTRIES_SQL, LETTERS, entries
from strandkit import constants as C
from strandkit.operators import embed as em
from strandkit.plans import corpus as pc
from strandkit.session import checkpoint_folder
from strandkit.sources import entries as en
from strandkit.sources import tables as tb
from strandkit.sources.files import file_digests
from strandkit.sources.keyed import KeyedStore
from strandkit.streaming import appends as ap

OPTIONS = pc.BuildOptions(lengths=(1, 2048), alphabet=LETTERS)


def folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}"


def vectors(spark, sf):
    """Two poolings of every stored vector, the second with opposite signs."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    flipped = e.withColumn("embedding", F.transform("embedding", lambda x: -x))
    return e.withColumn("pooling", F.lit("mean")).unionByName(flipped.withColumn("pooling", F.lit("max"))).withColumnRenamed(
        "embedding", "vector"
    )


# -- tables ------------------------------------------------------------------------

@query("sink_corpus_table", f"""
WITH {DERIVED_SQL} SELECT accession, protein_name, length, family, array_to_string(pfam_all, '|') AS pfam_all, ec_class, localization FROM d""")
def sink_corpus_table(spark, sf):
    path = folder(spark)
    tb.write_corpus(en.derive_fields(entries(spark, sf)), path)
    return tb.read_corpus(spark, path).select(
        "accession", "protein_name", "length", "family", F.array_join("pfam_all", "|").alias("pfam_all"), "ec_class", "localization"
    )


@query("sink_fasta", f"""
WITH {ENTRIES_SQL}, l AS (SELECT '>' || accession || ' ' || gene AS line FROM raw UNION ALL
  SELECT unnest(regexp_extract_all(sequence, '.{{1,8}}')) FROM raw)
SELECT line, count(*) AS n FROM l GROUP BY line""")
def sink_fasta(spark, sf):
    path = folder(spark)
    tb.write_fasta(entries(spark, sf), path, "accession", "gene", "sequence", 8)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("sink_embedding_store", f"""
SELECT vec_id AS id, round(-(embedding[1]::DOUBLE), 6) AS first, -{vector_digest_sql('embedding')} AS digest, len(embedding)::INTEGER AS dim FROM embeddings""")
def sink_embedding_store(spark, sf):
    path = folder(spark)
    tb.write_store(vectors(spark, sf), path, "base", "hash")
    first = F.round(F.element_at("vector", 1).cast("double"), 6)
    return tb.read_store(spark, path, "max").select("id", first.alias("first"), vector_digest(F.col("vector")).alias("digest"), F.size("vector").alias("dim"))


@query("sink_store_meta", """
SELECT 'base' AS model, '1' AS embedding_version, max(len(embedding))::BIGINT AS dim, 'max,mean' AS poolings, count(DISTINCT vec_id) AS n_rows, 'hash' AS corpus_hash FROM embeddings""")
def sink_store_meta(spark, sf):
    path = folder(spark)
    tb.write_store(vectors(spark, sf), path, "base", "hash")
    return spark.read.json(f"{path}/meta").select(
        "model", "embedding_version", "dim", F.array_join("poolings", ",").alias("poolings"), "n_rows", "corpus_hash"
    )


@query("sink_encoder_vectors", f"""
SELECT slug AS encoder, vec_id AS id, {vector_digest_sql('embedding')} AS digest FROM embeddings, (VALUES ('prostt5'), ('other')) AS s(slug)""")
def sink_encoder_vectors(spark, sf):
    path = folder(spark)
    mean = vectors(spark, sf).filter("pooling = 'mean'")
    # the second write leaves the folder of the first encoder alone
    for slug in (tb.encoder_slug("Rostlab/ProstT5"), "other"):
        tb.write_encoder_vectors(mean, path, slug)
    return spark.read.parquet(path).select("encoder", "id", vector_digest(F.col("vector")).alias("digest"))


# -- payloads ----------------------------------------------------------------------

@query("sink_map_payload", """
SELECT vec_id AS id, round(embedding[2]::DOUBLE, 6) AS x, round(embedding[1]::DOUBLE, 6) AS y, 'mean' AS pooling, 'local' AS preset FROM embeddings""")
def sink_map_payload(spark, sf):
    path = folder(spark)
    at = lambda i: F.round(F.element_at("embedding", i).cast("double"), 6)
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    tb.write_map(e.select("id", at(1).alias("x"), at(2).alias("y")), path, "mean")
    tb.write_map(e.select("id", at(2).alias("x"), at(1).alias("y")), path, "mean", "local")
    return tb.read_map(spark, path, "mean", "local").select("id", "x", "y", "pooling", "preset")


@query("sink_cluster_payload", """
SELECT label::BIGINT AS cluster, count(*) AS n, min(vec_id) AS smallest FROM embeddings GROUP BY label""")
def sink_cluster_payload(spark, sf):
    path = folder(spark)
    e = table(spark, sf, "embeddings")
    tb.write_clusters(e.groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("smallest")), path)
    return spark.read.json(path).select("cluster", "n", "smallest")


@query("sink_split_table", """
SELECT doc_id AS id, source AS group_id, CASE doc_id % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, 42::BIGINT AS seed FROM documents""")
def sink_split_table(spark, sf):
    path = folder(spark)
    part = F.col("doc_id") % 5
    splits = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("group_id"), F.when(part == 0, "val").when(part == 1, "test").otherwise("train").alias("split")
    )
    tb.write_splits(splits, path, {"seed": 42})
    back, summary = tb.read_splits(spark, path)
    return back.select("id", "group_id", "split", F.lit(summary["seed"]).cast("long").alias("seed"))


@query("sink_report_csv", """
SELECT l_returnflag AS task, l_linestatus AS method, count(*)::VARCHAR AS n FROM lineitem GROUP BY ALL""")
def sink_report_csv(spark, sf):
    path = folder(spark)
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("task"), F.col("l_linestatus").alias("method"))
    tb.write_report(rows.agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.option("header", True).csv(path).select("task", "method", "n")


@query("sink_profile_bundle", f"""
WITH {DERIVED_SQL} SELECT accession, protein_name, length::BIGINT AS length, len(pfam_all)::INTEGER AS n_domains FROM d""")
def sink_profile_bundle(spark, sf):
    path = folder(spark)
    tb.write_profiles(en.derive_fields(entries(spark, sf)).select("accession", "protein_name", "length", "pfam_all"), path, buckets=8)
    parsed = F.from_json("value", "accession string, protein_name string, length long, pfam_all array<string>").alias("p")
    return spark.read.text(path).select(parsed).select("p.accession", "p.protein_name", "p.length", F.size("p.pfam_all").alias("n_domains"))


@query("sink_run_log", """
SELECT 'bench' AS kind, '42' AS seed, round(avg(l_discount), 6) AS mean FROM lineitem""")
def sink_run_log(spark, sf):
    path = folder(spark)
    mean = table(spark, sf, "lineitem").agg(F.avg("l_discount")).first()[0]
    tb.log_run(spark, path, "bench", {"seed": 42}, {"mean": mean})
    tb.log_run(spark, path, "other", {}, {"mean": 0.0})
    runs = tb.read_runs(spark, path, "bench")
    return runs.select("kind", F.get_json_object("config", "$.seed").alias("seed"), F.round(F.get_json_object("metrics", "$.mean").cast("double"), 6).alias("mean"))


@query("sink_projection_versions", """
SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS x, hit FROM embeddings, (VALUES (false), (true)) AS h(hit)""")
def sink_projection_versions(spark, sf):
    path = folder(spark)
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    compute = lambda p: p.select("id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))
    # the second call finds the stored version; other parameters would not
    found = [tb.load_or_project(e, path, {"seed": 1}, compute) for _ in range(2)]
    return found[0][0].withColumn("hit", F.lit(found[0][1])).unionByName(found[1][0].withColumn("hit", F.lit(found[1][1])))


# -- sources -----------------------------------------------------------------------

@query("source_entries", f"""
WITH {ENTRIES_SQL} SELECT accession, protein_name, sequence, pfam, length FROM raw""")
def source_entries(spark, sf):
    """Entries written as gzip TSV files and read by header name."""
    path = folder(spark)
    e = entries(spark, sf)
    columns = [(F.col(c) if c in e.columns else F.lit("-")).alias(title) for title, c in C.ENTRY_COLUMNS.items()]
    e.select(*columns).write.option("sep", "\t").option("header", True).option("quote", "").option("compression", "gzip").csv(path)
    return en.read_entries(spark, path, 4).select("accession", "protein_name", "sequence", "pfam", "length")


@query("source_file_manifest", """
SELECT count(*) AS rows, true AS digests, true AS sizes FROM part""")
def source_file_manifest(spark, sf):
    """Rows of all files of a written source; every file has the digest of its bytes and a size."""
    path = folder(spark)
    e = entries(spark, sf)
    columns = [(F.col(c) if c in e.columns else F.lit("-")).alias(title) for title, c in C.ENTRY_COLUMNS.items()]
    e.select(*columns).write.option("sep", "\t").option("header", True).option("quote", "").option("compression", "gzip").csv(path)
    files = f"{path}/*.csv.gz"
    manifest = en.file_manifest(spark, files, en.read_entries(spark, files))
    # the files are small, so the digests can be held against those of binary rows
    whole = spark.read.format("binaryFile").load(files).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("want"))
    checked = manifest.join(whole, "file", "left")
    return checked.agg(F.sum("rows").alias("rows"), F.every(F.coalesce(F.col("sha256") == F.col("want"), F.lit(False))).alias("digests"), F.every(F.col("bytes") > 0).alias("sizes"))


@query("source_file_digests", """
SELECT o_orderpriority AS priority, sum(length(l) + 1)::BIGINT AS bytes, sha256(string_agg(l || chr(10), '' ORDER BY o_orderkey)) AS sha256
FROM (SELECT o_orderpriority, o_orderkey, o_orderkey || ' ' || o_custkey || ' ' || o_orderstatus AS l FROM orders) GROUP BY o_orderpriority""")
def source_file_digests(spark, sf):
    """Digests and sizes of text files, one per order priority, read in ranges."""
    path = folder(spark)
    o = table(spark, sf, "orders")
    lines = o.select("o_orderpriority", "o_orderkey", F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus").alias("value"))
    # a file is one task's lines in order, so a priority is one partition here
    placed = lines.repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "o_orderkey")
    placed.select("o_orderpriority", "value").write.partitionBy("o_orderpriority").text(path)
    priority = F.regexp_extract(F.url_decode(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))), "o_orderpriority=([^/]*)/", 1)
    return file_digests(spark, path).select(priority.alias("priority"), "bytes", "sha256")


@query("source_assay_scores", """
SELECT l_orderkey, l_linenumber, 'G' AS wt, l_suppkey::INTEGER + 1 AS pos, 'R' AS mut, l_discount AS score FROM lineitem
WHERE l_linenumber <> 2 AND l_linenumber <> 3""")
def source_assay_scores(spark, sf):
    """Scores written as CSV: unchanged residues and rows without a score are left out."""
    path = folder(spark)
    l = table(spark, sf, "lineitem")
    place = (F.col("l_suppkey") + 1).cast("string")
    label = F.concat(F.lit("p.Gly"), place, F.when(F.col("l_linenumber") == 2, "=").otherwise("Arg"))
    score = F.when(F.col("l_linenumber") == 3, "NaN").otherwise(F.col("l_discount").cast("string"))
    l.select("l_orderkey", "l_linenumber", label.alias("hgvs_pro"), score.alias("score")).write.option("header", True).csv(path)
    got = en.read_assay_scores(spark, path)
    return got.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast(l.schema["l_linenumber"].dataType), "wt", F.col("pos").cast("int"), "mut", "score")


# -- appends and streams -------------------------------------------------------------

# Entries with letters only: parts of one name have one sequence.
NAMED_SQL = f"""{ENTRIES_SQL},
n AS (SELECT accession, protein_name, upper(regexp_replace(protein_name, '[^A-Za-z]', '', 'g')) AS s FROM raw),
u AS (SELECT s, min(accession) AS accession FROM n GROUP BY s)"""


def named(spark, sf):
    e = entries(spark, sf).withColumn("sequence", F.upper(F.regexp_replace("protein_name", "[^A-Za-z]", "")))
    return e.select(*[(F.col(c) if c in e.columns else F.lit(None).cast("string")).alias(c) for c in C.ENTRY_COLUMNS.values()])


def inbox(spark, df) -> tuple[str, str]:
    """Writes rows as JSON files for a stream; returns the folder and the schema."""
    path = folder(spark)
    df.write.json(path)
    return path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def run_to_end(writer) -> None:
    stream = writer.trigger(availableNow=True).start()
    stream.awaitTermination()


@query("append_states", f"""
WITH {NAMED_SQL}, w AS (SELECT accession FROM raw UNION ALL SELECT 'X' || accession FROM raw WHERE p_partkey % 100 = 0),
c AS (SELECT accession FROM u WHERE accession < 'Q000100')
SELECT accession, CASE WHEN accession IN (SELECT accession FROM c) THEN 'present' WHEN starts_with(accession, 'X') THEN 'not_found' ELSE 'found' END AS state FROM w""")
def append_states(spark, sf):
    """What becomes of each requested id: stored before, found now, or unknown."""
    rows = named(spark, sf)
    corpus = pc.named_entries(rows.withColumn("protein_name", F.concat(F.lit("n"), "protein_name")), OPTIONS).filter("accession < 'Q000100'")
    wanted = rows.select("accession").unionByName(
        table(spark, sf, "part").filter("p_partkey % 100 = 0").select(F.concat(F.lit("XQ"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("accession"))
    )
    _, _, states = pc.append_entries(wanted, rows, corpus, em.HashingEncoder(8), ["mean"], options=OPTIONS)
    return states.select("accession", "state")


# The rows that an append adds, with the vectors that are written before them.
@query("append_rows", f"""
WITH {NAMED_SQL}, w AS (SELECT DISTINCT accession FROM raw WHERE accession NOT IN (SELECT accession FROM u WHERE accession < 'Q000100'))
SELECT n.accession, n.s AS sequence, 'max,mean' AS poolings, {len(LETTERS)}::INTEGER AS dim,
  list_sum(list_transform(string_split('{LETTERS}', ''), lambda x, i: i * round((length(n.s) - length(replace(n.s, x, '')))::DOUBLE / length(n.s) * 1000000)::BIGINT))::BIGINT AS mean_digest
FROM n JOIN w ON w.accession = n.accession""")
def append_rows(spark, sf):
    rows = named(spark, sf)
    corpus = pc.named_entries(rows.withColumn("protein_name", F.concat(F.lit("n"), "protein_name")), OPTIONS).filter("accession < 'Q000100'")
    fresh, found, _ = pc.append_entries(rows.select("accession"), rows, corpus, em.OneHotEncoder(LETTERS), ["mean", "max"], options=OPTIONS)
    per = found.groupBy(F.col("id").alias("accession"), "digest").agg(
        F.array_join(F.array_sort(F.collect_set("pooling")), ",").alias("poolings"), F.max(F.size("vector")).alias("dim"),
        F.max(F.when(F.col("pooling") == "mean", vector_digest(F.col("vector")))).alias("mean_digest"),
    )
    rows = fresh.select("accession", "sequence", F.sha2("sequence", 256).alias("digest")).join(per, ["accession", "digest"])
    return rows.select("accession", "sequence", "poolings", "dim", "mean_digest")


@query("stream_append", f"""
WITH {NAMED_SQL} SELECT s AS sequence, 2::BIGINT AS n_vectors FROM u""")
def stream_append(spark, sf):
    """The corpus after two runs over files that arrive one by one: of equal sequences in
    different batches one stays, and nothing is stored twice."""
    path, schema = inbox(spark, named(spark, sf).repartition(4, "accession"))
    corpus, store = folder(spark), folder(spark)
    for _ in range(2):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)
        run_to_end(ap.append_stream(source, corpus, store, em.HashingEncoder(8), folder(spark), ("mean", "max"), OPTIONS))
    counts = spark.read.parquet(f"{store}/vectors").groupBy(F.col("id").alias("accession")).agg(F.count(F.lit(1)).alias("n_vectors"))
    return spark.read.parquet(corpus).select("accession", "sequence").join(counts, "accession").select("sequence", "n_vectors")


@query("stream_search", f"""
WITH {NAMED_SQL} SELECT accession AS query_id, 1.0::DOUBLE AS similarity FROM n""")
def stream_search(spark, sf):
    """Arriving entries find a stored vector equal to their own."""
    rows = named(spark, sf).select(F.col("accession").alias("id"), "sequence")
    encoder = em.HashingEncoder(8)
    store = em.embed(rows.groupBy("sequence").agg(F.min("id").alias("id")), encoder, lengths=OPTIONS.lengths, alphabet=LETTERS)
    path, schema = inbox(spark, rows)
    out = folder(spark)
    source = spark.readStream.schema(schema).json(path)
    run_to_end(ap.search_stream(source, store.select("id", "vector"), encoder, out, folder(spark), 1, OPTIONS.lengths, LETTERS))
    return spark.read.parquet(out).select("query_id", F.round("similarity", 6).alias("similarity"))


@query("stream_cache", f"""
WITH {NAMED_SQL} SELECT sha256('one_hot|mean|v1|-|' || s) AS key, {len(LETTERS)}::INTEGER AS dim FROM u""")
def stream_cache(spark, sf):
    """One cached vector for each distinct sequence, also after a second run."""
    path, schema = inbox(spark, named(spark, sf).select(F.col("accession").alias("id"), "sequence").repartition(3, "id"))
    cache = folder(spark)
    for _ in range(2):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)
        run_to_end(ap.cache_stream(source, cache, em.OneHotEncoder(LETTERS), folder(spark), "mean", OPTIONS.lengths, LETTERS))
    return em.latest_vectors(KeyedStore(spark, cache).read()).select("key", F.size("vector").alias("dim"))
