"""Readers for annotated entries, assay scores, domain features, cross-references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkit import constants as C
from strandkit.functions import columns as fc
from strandkit.sources.files import file_digests


class MissingColumnsError(ValueError):
    """An input lacks required columns."""


def _tsv(spark: SparkSession, path: str | list[str]):
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").option("mode", "PERMISSIVE")


def read_entries(spark: SparkSession, path: str | list[str], partitions: int | None = None) -> DataFrame:
    """Raw entries from (gzip) TSV files, all columns as text, with ``source_file``.

    Columns are matched by header name.  Gzip files cannot be split, so the rows
    are spread over the cluster after reading.
    """
    header = _tsv(spark, path).csv(path).columns
    missing = sorted(set(C.ENTRY_COLUMNS) - set(header))
    if missing:
        raise MissingColumnsError(f"raw files lack columns: {missing}")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    raw = _tsv(spark, path).option("enforceSchema", False).schema(schema).csv(path)
    named = raw.select("*", F.col("_metadata.file_name").alias("source_file")).withColumnsRenamed(C.ENTRY_COLUMNS)
    return named.repartition(partitions) if partitions else named


def file_manifest(spark: SparkSession, path: str, entries: DataFrame) -> DataFrame:
    """(file, rows, bytes, sha256) per source file."""
    files = file_digests(spark, path).select("file", "bytes", "sha256")
    rows = entries.groupBy(F.col("source_file").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    return files.join(rows, "file", "left").select("file", F.coalesce("rows", F.lit(0)).alias("rows"), "bytes", "sha256")


def derive_fields(entries: DataFrame) -> DataFrame:
    """All derived columns of the corpus, from raw entry columns."""
    tokens = fc.token_list(F.col("pfam"))
    return entries.select(
        "*", F.col("protein_name").alias("protein_name_full"),
        fc.name_head(F.col("protein_name")).alias("__name"),
        fc.family(F.col("protein_families")).alias("family"),
        tokens.alias("pfam_all"), fc.first_token(tokens).alias("pfam_primary"),
        fc.ec_class(F.col("ec")).alias("ec_class"), fc.is_enzyme(F.col("ec")).alias("is_enzyme"),
        fc.localization(F.col("subcellular_location")).alias("localization"),
        fc.organism_short(F.col("organism")).alias("organism_short"),
    ).withColumn("length", F.col("length").cast("int")).withColumn("protein_name", F.col("__name")).drop("__name")


def parse_domain_features(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, name, start, end) of every DOMAIN feature in a feature text."""
    group = lambda i: F.regexp_extract_all(F.col(text), F.lit(C.DOMAIN_FEATURE_PATTERN), F.lit(i))
    found = rows.select(ident, F.explode(F.arrays_zip(
        group(1).alias("start"), group(2).alias("end"), group(3).alias("note")
    )).alias("f"))
    note = F.col("f.note")
    return found.select(
        ident, F.when(note == "", "domain").otherwise(F.trim(note)).alias("name"),
        F.col("f.start").cast("int").alias("start"), F.col("f.end").cast("int").alias("end"),
    )


def domain_table(rows: DataFrame, corpus: DataFrame, ident: str, text: str) -> DataFrame:
    return parse_domain_features(rows.join(corpus.select(ident), ident, "left_semi"), ident, text)


def structure_table(rows: DataFrame, corpus: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, pdb_ids): trimmed cross-references of corpus rows that have any."""
    ids = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")
    kept = rows.join(corpus.select(ident), ident, "left_semi")
    return kept.select(ident, ids.alias("pdb_ids")).filter(F.size("pdb_ids") > 0)


def parse_assay_scores(rows: DataFrame, label: str = "hgvs_pro", score: str = "score") -> DataFrame:
    """Rows with a clean single substitution and a score: adds wt, pos, mut."""
    return (
        rows.withColumn("__v", fc.hgvs_substitution(F.col(label)))
        .withColumn(score, F.col(score).try_cast("double"))
        .filter(F.col("__v").isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
        .select("*", "__v.wt", "__v.pos", "__v.mut").drop("__v")
    )


def read_assay_scores(spark: SparkSession, path: str) -> DataFrame:
    return parse_assay_scores(spark.read.option("header", True).csv(path))
