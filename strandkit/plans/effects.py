"""Substitution reports: single effects, landscapes and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkit import constants as C
from strandkit.functions import columns as fc
from strandkit.operators import variants as va
from strandkit.operators.embed import Encoder, embed, encode_changes
from strandkit.operators.pooling import AttentionWeights
from strandkit.session import reliable_checkpoint


def parsed_requests(requests: DataFrame, seq: str, alphabet: str = C.AMINO_ACIDS) -> DataFrame:
    """Requests (id, sequence, mutation) with wt, pos, mut and the reason of a refusal."""
    parsed = requests.withColumn("__m", fc.substitution(F.col("mutation"), alphabet)).select("*", "__m.*").drop("__m")
    return parsed.withColumn(
        "reason",
        F.coalesce("reason", fc.substitution_reason(F.col(seq), F.col("wt"), F.col("pos"), F.col("mut"))),
    )


def substitution_effects(
    variants: DataFrame, encoder: Encoder, seq: str = "sequence", pooling: str = "mean",
    lengths: tuple[int, int] = C.ADHOC_LENGTHS, alphabet: str = C.AMINO_ACIDS, window: int = C.SITE_WINDOW,
    weights: AttentionWeights | None = None,
) -> DataFrame:
    """Effect of each (id, sequence, pos, wt, mut) row at both levels."""
    ok = fc.validation_reason(F.col(seq), *lengths, alphabet).isNull()
    rows = va.mutated(variants.filter(ok), seq).withColumn(
        "variant", F.concat_ws(":", F.col("id").cast("string"), F.concat("wt", F.col("pos").cast("string"), "mut"))
    )
    effect = va.pooled_effect(encode_changes(rows, encoder, seq, "mutated", pooling, weights), "z", "m")
    near = F.slice(
        "deltas", F.greatest(F.col("pos") - window, F.lit(1)),
        F.least(F.col("pos") + window, F.size("deltas")) - F.greatest(F.col("pos") - window, F.lit(1)) + 1,
    )
    mean = lambda values: F.aggregate(values, F.lit(0.0), lambda x, d: x + d) / F.size(values)
    return effect.select(
        "id", "variant", "pos", "wt", "mut",
        F.round("displacement", 5).alias("displacement"),
        F.round("relative_displacement", 5).alias("relative_displacement"),
        F.round("cosine", 6).alias("cosine"), F.round(mean(near), 5).alias("local_delta"),
        F.round(mean(F.col("deltas")), 5).alias("global_delta"),
        F.transform("deltas", lambda d: F.round(d, 5)).alias("per_residue_delta"), "top_dimensions",
    )


def landscapes(
    sites: DataFrame, encoder: Encoder, log_probs: DataFrame | None = None, seq: str = "sequence",
    alphabet: str = C.AMINO_ACIDS, **options,
) -> DataFrame:
    """All substitutions of the given (id, sequence, pos) sites, with LLR if known."""
    rows = va.landscape_sites(sites, "id", seq, "pos", alphabet)
    effects = substitution_effects(rows, encoder, seq, alphabet=alphabet, **options)
    if log_probs is None:
        return effects
    return va.variant_llr(effects, log_probs).withColumn("llr", F.round("llr", 4))


def trajectories(
    chains: DataFrame, encoder: Encoder, ident: str = "id", seq: str = "sequence", mutations: str = "mutations",
    lengths: tuple[int, int] = C.ADHOC_LENGTHS, alphabet: str = C.AMINO_ACIDS, pooling: str = "mean",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(steps, summary, problems) of mutation chains; bad chains are never encoded."""
    cleaned = chains.withColumn(seq, fc.clean_sequence(F.col(seq)))
    refused = fc.validation_reason(F.col(seq), *lengths, alphabet)
    built = va.build_chains(cleaned.filter(refused.isNull()), ident, seq, mutations, alphabet=alphabet)
    problems = cleaned.filter(refused.isNotNull()).select(ident, refused.alias("reason")).unionByName(
        built.filter("reason is not null").select(ident, "reason")
    )
    # written once: the folds, the steps and their labels below all read it
    points = reliable_checkpoint(va.chain_steps(built, ident).withColumn("__key", F.sha2("sequence", 256)))
    # a sequence that several chains visit is encoded once
    distinct = points.groupBy(F.col("__key").alias("id")).agg(F.first("sequence").alias("sequence"))
    vectors = embed(distinct, encoder, poolings=(pooling,), lengths=lengths, alphabet=alphabet).select(
        F.col("id").alias("__key"), "vector"
    )
    placed = reliable_checkpoint(points.join(vectors, "__key").select(
        ident, F.col("step").alias("position"), F.col("label").alias("mutation"), "vector"
    ))
    labels = placed.select(ident, "position", "mutation").hint("merge")
    steps = reliable_checkpoint(va.trajectory_steps(placed, ident, ["position"], "vector").join(labels, [ident, "position"]))
    return va.cumulative_labels(steps.drop("position"), ident, "mutation"), va.path_summary(steps, ident), problems
