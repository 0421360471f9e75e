"""From raw entries to the corpus table, its manifest, and appends to it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkit import constants as C
from strandkit.functions import columns as fc
from strandkit.operators.aggregates import value_counts
from strandkit.operators.embed import Encoder, embed
from strandkit.operators.metrics import one_row
from strandkit.operators.pooling import AttentionWeights
from strandkit.operators.sampling import (
    cap_per_group, dedup_exact, drop_uncharacterized, missing_requests, proportional_sample,
)
from strandkit.sources.entries import derive_fields


@dataclass(frozen=True)
class BuildOptions:
    lengths: tuple[int, int] = C.CORPUS_LENGTHS
    alphabet: str = C.AMINO_ACIDS
    family_cap: int = 80
    target: int = 12000
    showcase: tuple[str, ...] = tuple(C.SHOWCASE_ACCESSIONS)
    seed: int = 42


def checked_entries(entries: DataFrame, options: BuildOptions) -> DataFrame:
    """Entries with the cleaned sequence stored and the reason of a refusal."""
    cleaned = entries.withColumn("sequence", fc.clean_sequence(F.col("sequence")))
    return cleaned.withColumn("reason", fc.validation_reason(F.col("sequence"), *options.lengths, options.alphabet))


def named_entries(entries: DataFrame, options: BuildOptions) -> DataFrame:
    """Valid, deduplicated entries with a meaningful name, derived fields added.

    The name filter comes after deduplication and reads the raw name.
    """
    valid = checked_entries(entries, options).filter("reason is null").drop("reason")
    unique = dedup_exact(valid, "sequence", "accession")
    return derive_fields(drop_uncharacterized(unique, "protein_name"))


def build_corpus(entries: DataFrame, options: BuildOptions = BuildOptions()) -> DataFrame:
    """Capped and sampled corpus; sort by accession only when writing it."""
    kept = F.col("accession").isin(*options.showcase)
    capped = cap_per_group(named_entries(entries, options), "family", options.family_cap, "accession", kept, options.seed)
    sampled = proportional_sample(capped, "organism", options.target, "accession", kept, options.seed)
    return sampled.select(*C.CORPUS_COLUMNS)


def drop_counts(entries: DataFrame, options: BuildOptions = BuildOptions()) -> DataFrame:
    """One row: raw, refused, duplicate and uncharacterized counts."""
    checked = checked_entries(entries, options)
    base = checked.agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count("reason").alias("n_invalid"),
    )
    unique = dedup_exact(checked.filter("reason is null"), "sequence", "accession")
    named = unique.agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.count_if(F.coalesce(F.col("protein_name").rlike(C.UNCHARACTERIZED_PATTERN), F.lit(False))).alias("n_uncharacterized"),
    )
    return one_row(base, named).select(
        "n_raw", "n_invalid",
        (F.col("n_raw") - F.col("n_invalid") - F.col("n_unique")).alias("n_duplicates"),
        "n_uncharacterized",
    )


def corpus_manifest(corpus: DataFrame, family: str = "family", top: int = 25) -> DataFrame:
    """Long table (section, label, n): totals, organisms, locations, top families."""
    totals = corpus.agg(
        F.count(F.lit(1)).alias("n_final"), F.countDistinct(family).alias("n_families"),
        F.count("pfam_primary").alias("n_with_pfam"), F.count_if("is_enzyme").alias("n_enzymes"),
    )
    names = totals.columns
    flat = totals.select(F.explode(F.array(*[
        F.struct(F.lit("total").alias("section"), F.lit(n).alias("label"), F.col(n).cast("long").alias("n")) for n in names
    ])).alias("r")).select("r.*")
    part = lambda section, col, limit=None: value_counts(corpus, col, limit).select(
        F.lit(section).alias("section"), F.col(col).alias("label"), "n"
    )
    return flat.unionByName(part("organism", "organism")).unionByName(
        part("localization", "localization")
    ).unionByName(part("top_family", family, top))


class PartialAppendError(ValueError):
    """Not every stored pooling can be computed."""


def append_entries(
    wanted: DataFrame, entries: DataFrame, corpus: DataFrame, encoder: Encoder, stored_poolings: list[str],
    weights: AttentionWeights | None = None, options: BuildOptions = BuildOptions(),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, vectors, states) for requested ids that the corpus lacks.

    Write the vectors first and the rows after them: a reader then never meets a
    row without vectors.  Records may share an id: each has a row and its own vectors
    (id, digest, pooling, vector), told apart by the SHA-256 of the sequence; a sequence is
    encoded once.  There is one state per request, ``invalid`` if no record of the id is valid.
    """
    computable = {p for p in C.POOLINGS if p != "attention" or weights is not None}
    if not set(stored_poolings) <= computable:
        raise PartialAppendError(f"stored poolings {stored_poolings}, computable {sorted(computable)}")
    known = missing_requests(wanted, corpus, entries, "accession")
    new = entries.join(known.filter("state = 'found'").select("accession"), "accession", "left_semi")
    checked = checked_entries(new, options)
    # the smallest reason, if no record of the id is without one
    reasons = checked.groupBy("accession").agg(
        F.when(F.every(F.col("reason").isNotNull()), F.min("reason")).alias("reason")
    )
    states = wanted.select("accession").join(known, "accession").join(reasons, "accession", "left").withColumn(
        "state", F.when(F.col("reason").isNotNull(), "invalid").otherwise(F.col("state"))
    )
    rows = derive_fields(checked.filter("reason is null").drop("reason")).select(*C.CORPUS_COLUMNS)
    named = rows.select(F.col("accession").alias("id"), F.sha2("sequence", 256).alias("digest"), "sequence")
    distinct = named.groupBy("digest").agg(F.first("sequence").alias("sequence"))
    encoded = embed(distinct, encoder, "digest", "sequence", tuple(stored_poolings), weights,
                    lengths=options.lengths, alphabet=options.alphabet).withColumnRenamed("id", "digest")
    vectors = named.select("id", "digest").distinct().join(encoded, "digest").select("id", "digest", "pooling", "vector")
    return rows, vectors, states
