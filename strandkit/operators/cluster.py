"""Clusters, density islands, outlier ranks and projections of vector tables."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkit.functions import vectors as fv
from strandkit.operators.groups import connected_components
from strandkit.operators.knn import knn
from strandkit.operators.ranking import global_row_number
from strandkit.session import reliable_checkpoint


def kmeans_clusters(
    df: DataFrame, ident: str, vec: str, k: int = 25, seed: int = 42, n_init: int = 4, max_iter: int = 50
) -> tuple[DataFrame, dict]:
    """(id, cluster) on unit vectors, the best of ``n_init`` starts, and its figures."""
    points = df.select(ident, array_to_vector(fv.unit(F.col(vec))).alias("features")).persist()
    try:
        models: list[KMeansModel] = [
            KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(points)
            for i in range(n_init)
        ]
        best = min(models, key=lambda m: m.summary.trainingCost)
        placed = best.transform(points)
        silhouette = ClusteringEvaluator(
            featuresCol="features", predictionCol="cluster", distanceMeasure="cosine"
        ).evaluate(placed)
        info = {
            "algorithm": "kmeans", "n_clusters": k,
            "inertia": float(best.summary.trainingCost), "silhouette_cosine": float(silhouette),
        }
        # assigned again from the source, so the cached points can go
        fresh = best.transform(df.select(ident, array_to_vector(fv.unit(F.col(vec))).alias("features")))
        return fresh.select(ident, "cluster"), info
    finally:
        points.unpersist()


def outlier_scores(distances: DataFrame, ident: str = "id", value: str = "knn_dist") -> DataFrame:
    """Adds ``outlier``: ordinal rank of the distance over n - 1, ties by id."""
    n = distances.count()
    ranked = global_row_number(distances, [F.col(value), F.col(ident)], "__row")
    return ranked.withColumn("outlier", (F.col("__row") - 1) / float(max(n - 1, 1))).drop("__row")


def pca_projection(df: DataFrame, ident: str, vec: str, dim: int = 50) -> tuple[DataFrame, dict]:
    """(id, vector): centred principal components, and the explained variance."""
    first = df.select(F.size(vec).alias("d")).first()
    n = df.count()
    k = min(dim, first["d"], n)
    rows = df.select(ident, array_to_vector(fv.doubles(F.col(vec))).alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="features").fit(rows).transform(rows)
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(centred)
    info = {"pca_dim": k, "pca_explained_variance": float(sum(model.explainedVariance)), "n": n}
    return model.transform(centred).select(ident, vector_to_array("scores").alias("vector")), info


def map_coordinates(df: DataFrame, ident: str, vec: str) -> tuple[DataFrame, dict]:
    """(id, x, y): the first two principal components."""
    scores, info = pca_projection(df, ident, vec, 50)
    return scores.select(ident, F.get("vector", F.lit(0)).alias("x"), F.get("vector", F.lit(1)).alias("y")), info


def density_islands(
    df: DataFrame, ident: str, vec: str, min_size: int = 15, min_samples: int = 5,
    radius: float | None = None, radius_quantile: float = 0.1,
) -> DataFrame:
    """(id, island): dense regions of the neighbour graph, -1 for noise.

    The core distance of a row is the distance to its ``min_samples``-th
    neighbour.  Neighbours whose mutual reachability stays within the radius are
    linked; components below ``min_size`` are noise.  Islands are numbered by
    their smallest id.  This is a density grouping, not a leaf selection of a
    density tree.
    """
    hits = reliable_checkpoint(knn(df, df, min_samples, ident, vec)).withColumn("d", 1 - F.col("similarity"))
    core = hits.filter(F.col("rank") == min_samples).select("query_id", F.col("d").alias("core"))
    if radius is None:
        radius = core.agg(F.percentile_approx("core", radius_quantile, 10000).alias("r")).first()["r"] or 0.0
    near = (
        hits.filter(F.col("d") <= radius)
        .join(core.filter(F.col("core") <= radius).select("query_id"), "query_id", "left_semi")
        .join(core.filter(F.col("core") <= radius).select(F.col("query_id").alias("id")), "id", "left_semi")
    )
    parts = connected_components(near.select(F.col("query_id").alias("a"), F.col("id").alias("b")))
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size)
    members = parts.join(sizes.select("component"), "component").select(F.col("node").alias(ident), "component")
    return df.select(ident).join(members, ident, "left").select(
        ident, F.coalesce(F.col("component").cast("long"), F.lit(-1).cast("long")).alias("island")
    )
