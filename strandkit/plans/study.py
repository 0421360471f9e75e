"""Evaluation studies: benchmark suites, pair study, split comparison, assays."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkit import constants as C
from strandkit.functions import vectors as fv
from strandkit.operators import metrics as mt
from strandkit.operators.align import Aligner, pair_identity
from strandkit.operators import ann
from strandkit.operators.cluster import kmeans_clusters, map_coordinates, outlier_scores
from strandkit.operators.embed import Encoder, embed
from strandkit.operators.groups import group_statistics
from strandkit.operators.knn import knn, mean_distance
from strandkit.operators.lookup import pair_agreement
from strandkit.operators.probe import metric_rows, run_probe
from strandkit.operators.sampling import discordant, downsample, random_pairs, substituted_pairs
from strandkit.operators.splits import audit_leakage, make_splits, split_summary
from strandkit.operators.variants import variant_llr
from strandkit.session import fits_broadcast, reliable_checkpoint

METRIC_SCHEMA = "representation string, axis string, task string, metric string, value double"


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), tables)


# -- representations ------------------------------------------------------------

def retrieval_metrics(store: DataFrame, labels: DataFrame, label: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Precision@k; only queries are restricted, candidates are the whole store."""
    rows = labels.select("id", F.col(label).alias("label"))
    queries = store.join(mt.eligible_queries(rows, "label").select("id"), "id", "left_semi")
    return mt.precision_at_k(knn(queries, store, max(ks)), rows, list(ks))


def clustering_metrics(store: DataFrame, labels: DataFrame, label: str, k: int = 25, seed: int = 42) -> DataFrame:
    placed, _ = kmeans_clusters(store, "id", "vector", k, seed)
    rows = reliable_checkpoint(placed.join(labels.select("id", F.col(label).alias("label")), "id"))
    return mt.one_row(mt.purity(rows, "cluster", "label"), mt.normalized_mutual_information(rows, "cluster", "label"))


def stability_metrics(
    corpus: DataFrame, encoder: Encoder, seq: str, n: int = 150, seed: int = 42, pooling: str = "mean",
    lengths: tuple[int, int] = C.ADHOC_LENGTHS, alphabet: str = C.AMINO_ACIDS,
) -> DataFrame:
    pairs = substituted_pairs(corpus, "id", seq, n, seed, alphabet)
    both = pairs.select(F.concat(F.col("id").cast("string"), F.lit("|w")).alias("id"), F.col("wild").alias("sequence")).unionByName(
        pairs.select(F.concat(F.col("id").cast("string"), F.lit("|m")).alias("id"), F.col("mutated").alias("sequence"))
    )
    vectors = embed(both, encoder, poolings=(pooling,), lengths=lengths, alphabet=alphabet)
    kind = F.substring_index("id", "|", -1)
    base = vectors.select(F.regexp_replace("id", r"\|[wm]$", "").alias("key"), kind.alias("kind"), "vector")
    wild = base.filter("kind = 'w'").select("key", F.col("vector").alias("w"))
    mutant = base.filter("kind = 'm'").select("key", F.col("vector").alias("m"))
    return mt.stability(wild.join(mutant, "key").select(fv.cosine(F.col("w"), F.col("m")).alias("cosine")))


def benchmark_suite(
    stores: dict[str, DataFrame], labels: DataFrame, tasks: dict[str, int], retrieval_labels: list[str],
    cluster_label: str, n_clusters: int = 25, seed: int = 42, encoders: dict[str, Encoder] | None = None,
    corpus: DataFrame | None = None, seq: str = "sequence", lengths: tuple[int, int] = C.ADHOC_LENGTHS,
    alphabet: str = C.AMINO_ACIDS,
) -> DataFrame:
    """Long metric table of every representation on every axis.

    ``labels`` holds id, split and the label columns.  The parameters of the
    subset study are smaller class thresholds and fewer clusters.
    """
    parts = []
    for name, store in stores.items():
        labelled = store.join(labels, "id")
        for task, least in tasks.items():
            parts.append(metric_rows(run_probe(labelled, "vector", task, "split", least), name, "probe", task))
        for label in retrieval_labels:
            parts.append(metric_rows(retrieval_metrics(store, labels, label), name, "retrieval", f"same_{label}"))
        parts.append(metric_rows(
            clustering_metrics(store, labels, cluster_label, n_clusters, seed), name, "clustering", f"kmeans_vs_{cluster_label}"
        ))
        if encoders and name in encoders and corpus is not None:
            result = stability_metrics(corpus, encoders[name], seq, seed=seed, lengths=lengths, alphabet=alphabet)
            parts.append(metric_rows(result, name, "stability", "one_substitution"))
    return _union(parts)


# -- pairs ------------------------------------------------------------------------

def pair_study(
    corpus: DataFrame, store: DataFrame, ident: str, seq: str, family: str, n_pairs: int = 4000, seed: int = 42,
    aligner: Aligner | None = None,
) -> DataFrame:
    """(a, b, stratum, identity, cosine, same_family) of random and neighbour pairs."""
    random = reliable_checkpoint(random_pairs(corpus, ident, n_pairs // 2, seed))
    seeds = downsample(store, n_pairs // 8, "id", seed)
    near = knn(seeds, store, 4).select(
        F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")
    ).distinct().join(random, ["a", "b"], "left_anti")
    pairs = reliable_checkpoint(
        random.withColumn("stratum", F.lit("random")).unionByName(near.withColumn("stratum", F.lit("nn")))
    )
    # the sampled rows are found in one pass over each table; pairs are joined to them only
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    named = F.broadcast(named) if fits_broadcast(2 * n_pairs, 64) else named
    texts = reliable_checkpoint(corpus.select(F.col(ident).alias("id"), F.col(seq).alias("seq"), F.col(family).alias("f")).join(named, "id"))
    vectors = reliable_checkpoint(store.select("id", "vector").join(named, "id"))
    rows = lambda s: texts.select(F.col("id").alias(s), F.col("seq").alias(f"seq_{s}"), F.col("f").alias(f"f_{s}"))
    vecs = lambda s: vectors.select(F.col("id").alias(s), F.col("vector").alias(f"v_{s}"))
    wide = pairs.join(rows("a"), "a").join(rows("b"), "b").join(vecs("a"), "a").join(vecs("b"), "b").select(
        "a", "b", "stratum", "seq_a", "seq_b",
        F.round(fv.cosine(F.col("v_a"), F.col("v_b")), 4).alias("cosine"),
        F.coalesce(F.col("f_a") == F.col("f_b"), F.lit(False)).alias("same_family"),
    )
    scored = pair_identity(wide, aligner=aligner)
    return scored.select("a", "b", "stratum", F.round("identity", 4).alias("identity"), "cosine", "same_family")


def pair_study_summary(study: DataFrame) -> DataFrame:
    """Counts per stratum; the correlation uses the random stratum only."""
    high, low = discordant()
    on_random = lambda c: F.when(F.col("stratum") == "random", F.col(c))
    return study.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(high).alias("low_identity_high_cosine"),
        F.count_if(low).alias("high_identity_low_cosine"),
        mt.correlation(on_random("identity"), on_random("cosine")).alias("pearson_r"),
    )


# -- approximate search ---------------------------------------------------------

def folder_bytes(spark, path: str) -> int:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def recall_study(store: DataFrame, k: int = 10, n_queries: int = 1000, seed: int = 42, regime: str = "stored") -> DataFrame:
    """Per search plan: seconds to build, bytes stored, queries per second, recall@k, and the share of
    cells or pairs that a query meets."""
    spark = store.sparkSession
    store = reliable_checkpoint(store)
    queries = reliable_checkpoint(downsample(store, n_queries, "id", seed))
    n_q, n = queries.count(), store.count()
    cells, signs = [], []

    def build_cells() -> str:
        cells.append(ann.build_cells(store, k=k, seed=seed))
        return f"{cells[0].path}/vectors"

    def build_codes() -> str:
        ann.build_codes(cells[0], seed=seed)
        return f"{cells[0].path}/codes"

    def build_signatures() -> str:
        signs.append(ann.build_signatures(store, k=k, seed=seed))
        return f"{signs[0].path}/vectors"

    def visited(index) -> float:
        return index.settings()["nprobe"] / index.settings()["n_cells"]

    def by_signatures():
        found = ann.search_signatures(signs[0], queries, k)
        return found.hits, found.n_pairs / max(n_q * n, 1)

    plans = {
        "exact": (None, lambda: (knn(queries, store, k), 1.0)),
        "cells": (build_cells, lambda: (ann.search_cells(cells[0], queries, k), visited(cells[0]))),
        "quantized": (build_codes, lambda: (ann.search_codes(cells[0], queries, k), visited(cells[0]))),
        "signatures": (build_signatures, by_signatures),
    }
    found, rows = {}, []
    for name, (build, search) in plans.items():
        start = time.monotonic()
        size = folder_bytes(spark, build()) if build else 0
        built = time.monotonic() - start
        hits, share = search()
        found[name] = reliable_checkpoint(hits)
        spent = time.monotonic() - start - built
        recall = mt.recall_at_k(found["exact"], found[name], k).first()[f"recall_at_{k}"]
        rows.append((regime, name, n, round(built, 2), size, round(n_q / max(spent, 1e-9), 1), round(float(recall), 4), round(share, 4)))
    return spark.createDataFrame(
        rows, f"regime string, plan string, n_vectors long, build_s double, stored_bytes long, qps double, recall_at_{k} double, share_met double"
    )


def clustered_vectors(spark, n: int, dim: int = 64, centres: int = 256, spread: float = 0.3, seed: int = 42) -> DataFrame:
    """(id, vector): Gaussian clusters on the unit sphere, for the large regime."""
    centre = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(centres))
    # a centre's coordinate depends on the centre and dimension only (Box-Muller)
    uniform = lambda salt, d: (F.pmod(F.xxhash64("c", d, F.lit(salt)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    rows = spark.range(n).withColumn("c", centre)
    coords = [
        F.sqrt(-2 * F.log(uniform(seed, F.lit(d)))) * F.cos(2 * 3.141592653589793 * uniform(seed + 1, F.lit(d)))
        + spread * F.randn(seed * 1000 + d)
        for d in range(dim)
    ]
    return rows.select("id", fv.unit(F.array(*coords)).alias("vector"))


# -- splits -----------------------------------------------------------------------

def compare_split_methods(
    corpus: DataFrame, groupings: dict[str, DataFrame], ident: str, seq: str, store: DataFrame,
    labels: DataFrame, tasks: dict[str, int], n_pairs: int = 200_000, seed: int = 42,
    alphabet: str | None = C.AMINO_ACIDS, audit_pairs: int = 2000,
) -> DataFrame:
    """Long table (method, axis, task, metric, value) of two or more groupings."""
    parts = []
    fixed = {name: reliable_checkpoint(g.select("id", "group_id")) for name, g in groupings.items()}
    for name, groups in fixed.items():
        splits = reliable_checkpoint(make_splits(groups, seed=seed))
        parts.append(metric_rows(group_statistics(groups, kind=None), name, "groups", "all"))
        parts.append(metric_rows(split_summary(splits), name, "split", F.col("split")))
        # the tables grow with the corpus, their files much less: the hints keep them from the driver
        dealt = splits.select("id", "split").hint("merge")
        placed = corpus.select(F.col(ident).alias("id"), F.col(seq).alias("seq")).join(dealt, "id")
        audit = audit_leakage(placed, "id", "seq", "split", audit_pairs, 4, seed, alphabet)
        parts.append(metric_rows(audit, name, "audit", F.col("stratum")))
        labelled = store.join(labels.hint("merge"), "id").join(dealt, "id")
        for task, least in tasks.items():
            parts.append(metric_rows(run_probe(labelled, "vector", task, "split", least), name, "probe", task))
    names = list(fixed)
    pairs = reliable_checkpoint(random_pairs(fixed[names[0]], "id", n_pairs, seed))
    agreement = mt.sampled_disagreement(pair_agreement(pairs, fixed[names[0]], fixed[names[1]]))
    parts.append(metric_rows(agreement, f"{names[0]}|{names[1]}", "disagreement", "pairs"))
    return _union(parts).withColumnRenamed("representation", "method")


# -- assays -----------------------------------------------------------------------

def assay_validation(
    variants: DataFrame, log_probs: DataFrame, wild: DataFrame, mutants: DataFrame, assay: str = "assay"
) -> tuple[DataFrame, DataFrame]:
    """(rows, correlations) for (assay, pos, wt, mut, score) tables.

    ``wild`` is (assay, vector); ``mutants`` is (assay, pos, mut, vector).
    """
    scored = variant_llr(variants, log_probs, assay)
    rows = (
        scored.join(wild.select(assay, F.col("vector").alias("__w")), assay)
        .join(mutants.select(assay, "pos", "mut", F.col("vector").alias("__m")), [assay, "pos", "mut"])
        .select(
            assay, "pos", "wt", "mut", "score", "llr",
            fv.distance(F.col("__m"), F.col("__w")).alias("displacement"),
            fv.cosine(F.col("__w"), F.col("__m")).alias("cosine"),
        )
    )
    rows = reliable_checkpoint(rows.withColumn("neg_displacement", -F.col("displacement")))
    tables = []
    for name in ("llr", "neg_displacement", "cosine"):
        rho = mt.spearman(rows, name, "score", [assay])
        tables.append(rho.select(assay, F.lit(name).alias("statistic"), "n", "rho", "p_value"))
    return rows, _union(tables)


# -- rows -------------------------------------------------------------------------

def representation_stats(store: DataFrame, k: int = 10, n_clusters: int = 25, seed: int = 42) -> DataFrame:
    """Norm, dimension, neighbour distances, outlier rank, cluster and map position."""
    distances = reliable_checkpoint(mean_distance(knn(store, store, k), k))
    clusters, _ = kmeans_clusters(store, "id", "vector", n_clusters, seed)
    places, _ = map_coordinates(store, "id", "vector")
    base = store.select(
        "id", F.round(fv.norm(F.col("vector")), 4).alias("embedding_norm"), F.size("vector").alias("dim")
    )
    return (
        base.join(outlier_scores(distances), "id", "left").join(clusters, "id", "left").join(places, "id", "left")
        .select(
            "id", "embedding_norm", "dim", F.round("nn_dist", 5).alias("nn_distance"),
            F.round("knn_dist", 5).alias("knn_mean_distance"), "cluster",
            F.round("outlier", 4).alias("outlier"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"),
        )
    )


def map_points(corpus: DataFrame, ident: str, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Corpus fields and figures of every point, the payload of a 2-D map."""
    return corpus.select(F.col(ident).alias("id"), *columns).join(
        stats.select("id", "cluster", F.col("knn_mean_distance").alias("knn_dist"), "outlier", "x", "y"), "id"
    )
