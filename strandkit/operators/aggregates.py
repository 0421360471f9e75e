"""Corpus summaries: counts, tops, folds, clusters, coverage and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandkit.operators.metrics import one_row
from strandkit.operators.ranking import group_quantiles, top_per_group


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Non-null values by frequency, ties by value."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.orderBy(F.desc("n"), F.col(col))
    return ordered if top is None else ordered.limit(top)


def top_counts_per_group(df: DataFrame, group: str, col: str, top: int, out: str) -> DataFrame:
    """(group, out): array of (value, n) of the most frequent values."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(group, F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    first = top_per_group(counts, [group], [F.desc("n"), F.col("value")], top)
    return first.groupBy(group).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value", "n"))),
            lambda e: F.struct(e["value"].alias("value"), e["n"].alias("n")),
        ).alias(out)
    )


def cluster_summaries(
    df: DataFrame, cluster: str, length: str, family: str, organism: str, enzyme: str, top: int = 3
) -> DataFrame:
    """Size, mean length, dominant families and organisms, enzyme share."""
    base = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"),
        F.avg(length).alias("mean_length"),
        F.avg(F.col(enzyme).cast("double")).alias("enzyme_fraction"),
    )
    families = top_counts_per_group(df, cluster, family, top, "top_families")
    organisms = top_counts_per_group(df, cluster, organism, top, "top_organisms")
    return base.join(families, cluster, "left").join(organisms, cluster, "left")


def fold_other(df: DataFrame, col: str, top: int = 7) -> DataFrame:
    """Legend (label, n): the most frequent values, ``Other`` and ``n/a`` for nulls."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    best = counts.filter(F.col(col).isNotNull()).orderBy(F.desc("n"), F.col(col)).limit(top).select(
        F.col(col).alias("__top")
    )
    marked = counts.join(F.broadcast(best), F.col(col) == F.col("__top"), "left")
    label = F.when(F.col(col).isNull(), "n/a").when(F.col("__top").isNotNull(), F.col(col)).otherwise("Other")
    return marked.groupBy(label.alias("label")).agg(F.sum("n").alias("n"))


def scaled(df: DataFrame, col: str, out: str = "scaled") -> DataFrame:
    """Min-max position of a value, clamped to [0, 1]; a zero span counts as 1."""
    low = df.agg(F.min(col).alias("x")).scalar()
    span = df.agg((F.max(col) - F.min(col)).alias("x")).scalar()
    position = (F.col(col) - low) / F.when(span == 0, F.lit(1)).otherwise(span)
    return df.withColumn(out, F.least(F.greatest(position.cast("double"), F.lit(0.0)), F.lit(1.0)))


def coverage(features: DataFrame, corpus: DataFrame, ident: str, n_items: Column | None = None) -> DataFrame:
    """Records, ids with records, share of the corpus covered, total items."""
    held = features.join(corpus.select(ident), ident, "left_semi")
    a = held.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.countDistinct(ident).alias("n_ids"),
        (F.sum(n_items) if n_items is not None else F.count(F.lit(1))).alias("n_items"),
    )
    b = corpus.agg(F.countDistinct(ident).alias("n_corpus"))
    return one_row(a, b).withColumn("coverage", F.round(F.try_divide(F.col("n_ids"), F.col("n_corpus")), 4))


def cluster_positions(df: DataFrame, cluster: str, x: str, y: str) -> DataFrame:
    """Median coordinates and size of each cluster."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(group_quantiles(df, [cluster], x, {"x": 0.5}), cluster).join(
        group_quantiles(df, [cluster], y, {"y": 0.5}), cluster
    ).select(cluster, "x", "y", "n")


def noise_fraction(df: DataFrame, cluster: str) -> DataFrame:
    return df.agg(F.avg((F.col(cluster) == -1).cast("double")).alias("noise_fraction"))


def landscape_extremes(df: DataFrame, by: list[str], label: str, value: str) -> DataFrame:
    """Labels of the largest and the smallest value and the span; ties by label."""
    return df.groupBy(*by).agg(
        F.min_by(label, F.struct((-F.col(value)).alias("v"), F.col(label))).alias("max_label"),
        F.min_by(label, F.struct(F.col(value), F.col(label))).alias("min_label"),
        (F.max(value) - F.min(value)).alias("span"),
    )


def best_rows(metrics: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows that reach the best value of their group."""
    best = metrics.groupBy(*by).agg(F.max(value).alias("__best"))
    return metrics.join(best, by).filter(F.col(value) == F.col("__best")).drop("__best")


def ranked_report(metrics: DataFrame, by: list[str], value: str, label: str) -> DataFrame:
    """Metric rows numbered inside each task, best first."""
    window = W.partitionBy(*by).orderBy(F.desc(value), F.col(label))
    return metrics.withColumn("rank", F.row_number().over(window))


def headline(metrics: DataFrame) -> DataFrame:
    """One row per representation from (representation, axis, task, metric, value)."""
    def pick(axis: str, metric: str, task: str | None = None) -> Column:
        hit = (F.col("axis") == axis) & (F.col("metric") == metric)
        return F.when(hit if task is None else hit & (F.col("task") == task), F.col("value"))

    return metrics.groupBy("representation").agg(
        F.avg(pick("probe", "macro_f1")).alias("mean_macro_f1"),
        F.max(pick("retrieval", "precision_at_10", "same_pfam_primary")).alias("precision_at_10"),
        F.max(pick("clustering", "nmi")).alias("nmi"),
        F.max(pick("stability", "cosine_mean")).alias("stability"),
    )


def extended_table(metrics: DataFrame, registry: DataFrame, tasks: list[str]) -> DataFrame:
    """Probe F1 per task, their mean, P@1, P@10 and NMI per representation."""
    f1 = (
        metrics.filter("axis = 'probe' and metric = 'macro_f1'")
        .groupBy("representation").pivot("task", tasks).agg(F.max("value"))
    )
    rest = metrics.groupBy("representation").agg(
        F.avg(F.when((F.col("axis") == "probe") & (F.col("metric") == "macro_f1"), F.col("value"))).alias("mean_f1"),
        F.max(F.when(F.col("metric") == "precision_at_1", F.col("value"))).alias("precision_at_1"),
        F.max(F.when(F.col("metric") == "precision_at_10", F.col("value"))).alias("precision_at_10"),
        F.max(F.when(F.col("metric") == "nmi", F.col("value"))).alias("nmi"),
    )
    return rest.join(f1, "representation", "left").join(registry, "representation", "left").orderBy(
        "group", "params_m", "representation"
    )


def assay_summary(rhos: DataFrame, assay: str = "assay") -> DataFrame:
    """Each assay's correlations and a final row with the means."""
    mean = rhos.agg(
        F.lit("mean").alias(assay), F.sum("n").alias("n"),
        F.avg("rho_llr").alias("rho_llr"), F.avg("rho_neg_displacement").alias("rho_neg_displacement"),
    )
    return rhos.select(assay, "n", "rho_llr", "rho_neg_displacement").unionByName(mean)


def corpus_statistics(corpus: DataFrame, ident: str, family: str, domains: DataFrame, appended: DataFrame | None = None) -> DataFrame:
    a = corpus.agg(F.count(F.lit(1)).alias("corpus_size"), F.countDistinct(family).alias("n_families"))
    b = domains.join(corpus.select(ident), ident, "left_semi").agg(F.countDistinct(ident).alias("n_with_domains"))
    if appended is None:
        return one_row(a, b)
    c = corpus.join(appended.select(ident), ident, "left_semi").agg(F.count(F.lit(1)).alias("n_appended"))
    return one_row(a, b, c)
