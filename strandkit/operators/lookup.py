"""Joins and lookups around the corpus: text search, profiles, comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandkit.functions import columns as fc
from strandkit.functions import vectors as fv
from strandkit.operators.align import Aligner, pair_identity


class IncompleteStoreError(ValueError):
    """Corpus and vectors do not hold the same ids."""


def with_split(corpus: DataFrame, splits: DataFrame, ident: str) -> DataFrame:
    """Rows without a split keep a null."""
    return corpus.join(splits.select(F.col("id").alias(ident), "split"), ident, "left")


def aligned(corpus: DataFrame, vectors: DataFrame, ident: str) -> DataFrame:
    """Corpus and vectors by id; both sides must be complete."""
    lost = corpus.select(ident).join(vectors.select(ident), ident, "left_anti").limit(1).count()
    extra = vectors.select(ident).join(corpus.select(ident), ident, "left_anti").limit(1).count()
    if lost or extra:
        raise IncompleteStoreError("corpus and embedding store hold different ids")
    return corpus.join(vectors, ident)


def hit_summaries(hits: DataFrame, corpus: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    return hits.withColumn("similarity", F.round("similarity", 4)).join(
        corpus.select(F.col(ident).alias("id"), *columns), "id"
    )


def text_lookup(
    df: DataFrame, query: str, name: Column, gene: Column, accession: Column, family: Column,
    ident: str, limit: int = 20,
) -> DataFrame:
    """Rows ranked by summed match weights; ties by id; blank queries find nothing."""
    needle = query.strip().lower()
    fields = {n: F.lower(F.coalesce(c.cast("string"), F.lit(""))) for n, c in
              (("name", name), ("gene", gene), ("accession", accession), ("family", family))}
    q = F.lit(needle)
    weights = [
        (fields["accession"] == q, 120), (fields["gene"] == q, 100),
        (F.startswith(fields["name"], q), 80), (F.contains(fields["name"], q), 40),
        (F.contains(fields["gene"], q), 25), (F.contains(fields["family"], q), 10),
        (F.contains(fields["accession"], q), 8),
    ]
    score = reduce(lambda x, y: x + y, [F.when(c, w).otherwise(0) for c, w in weights])
    found = df.withColumn("score", score).filter((F.col("score") > 0) & F.lit(needle != ""))
    return found.orderBy(F.desc("score"), F.col(ident)).limit(limit)


def resorted_hits(hits: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    order = F.col(column).asc() if ascending else F.col(column).desc()
    return hits.orderBy(order, F.col("rank"))


def neighbours_within(hits_all: DataFrame, subset: DataFrame, ident: str, k: int) -> DataFrame:
    """Hits restricted to a subset and ranked again."""
    kept = hits_all.join(subset.select(F.col(ident).alias("id")), "id", "left_semi")
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), F.col("id"))
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def with_similarity(points: DataFrame, hits: DataFrame, ident: str, query_id) -> DataFrame:
    """Similarity of each point to one query: itself 1.0, non-neighbours null."""
    near = hits.filter(F.col("query_id") == query_id).select(F.col("id").alias(ident), "similarity")
    return points.join(F.broadcast(near), ident, "left").withColumn(
        "similarity", F.when(F.col(ident) == query_id, 1.0).otherwise(F.col("similarity"))
    )


def profiles(
    corpus: DataFrame, ident: str, points: DataFrame, hits: DataFrame,
    domains: DataFrame | None = None, structures: DataFrame | None = None, max_structures: int = 12,
) -> DataFrame:
    """One nested row per record: fields, point figures, neighbours, features.

    ``hits`` holds at most k rows per record, so the collected lists stay small.
    """
    near = hits.groupBy(F.col("query_id").alias(ident)).agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", F.round("similarity", 4).alias("similarity")))).alias("neighbors"),
        F.round(1 - F.max("similarity"), 5).alias("nn_distance"),
    )
    out = corpus.join(points, ident, "left").join(near, ident, "left").withColumn(
        "neighbors", F.coalesce("neighbors", F.array())
    )
    if domains is not None:
        listed = domains.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct("start", "end", "name"))).alias("domains"))
        out = out.join(listed, ident, "left")
    if structures is not None:
        out = out.join(
            structures.select(ident, F.slice("pdb_ids", 1, max_structures).alias("pdb")), ident, "left"
        ).withColumn("pdb", F.coalesce("pdb", F.array()))
    return out


def compare_pairs(
    pairs: DataFrame, corpus: DataFrame, store: DataFrame, ident: str, family: str, tokens: str, poolings: list[str],
    seq: str | None = None, domains: DataFrame | None = None, aligner: Aligner | None = None,
) -> DataFrame:
    """(a, b, same_family, shared, cosine_<pooling>...) for a pair table.

    With ``seq``, ``identity`` of the two sequences; with ``domains`` (id, start, end, name),
    ``a_domains`` and ``b_domains`` in order of their starts, empty if there are none.  Every row
    of either side is fetched by an equi-join on its id.
    """
    extra = [] if seq is None else [F.col(seq)]
    side = lambda s: corpus.select(
        F.col(ident).alias(s), F.col(family).alias(f"__f{s}"), F.col(tokens).alias(f"__t{s}"), *[c.alias(f"__s{s}") for c in extra]
    )
    base = pairs.join(side("a"), "a").join(side("b"), "b").select(
        "a", "b",
        F.coalesce(F.col("__fa") == F.col("__fb"), F.lit(False)).alias("same_family"),
        F.array_sort(F.array_intersect("__ta", "__tb")).alias("shared"),
        *([] if seq is None else ["__sa", "__sb"]),
    )
    vec = lambda s: store.select(F.col(ident).alias(s), "pooling", F.col("vector").alias(f"__v{s}"))
    cosines = (
        pairs.join(vec("a"), "a").join(vec("b"), ["b", "pooling"])
        .withColumn("c", F.round(fv.cosine(F.col("__va"), F.col("__vb")), 4))
        .groupBy("a", "b").pivot("pooling", poolings).agg(F.first("c"))
        .withColumnsRenamed({p: f"cosine_{p}" for p in poolings})
    )
    out = base.join(cosines, ["a", "b"], "left")
    if seq is not None:
        out = pair_identity(out, "__sa", "__sb", aligner).withColumn("identity", F.round("identity", 4)).drop("__sa", "__sb")
    if domains is not None:
        wanted = pairs.select(F.col("a").alias(ident)).unionByName(pairs.select(F.col("b").alias(ident))).distinct()
        listed = domains.join(wanted, ident, "left_semi").groupBy(ident).agg(
            F.array_sort(F.collect_list(F.struct("start", "end", "name"))).alias("__d")
        )
        for s in ("a", "b"):
            out = out.join(listed.select(F.col(ident).alias(s), F.col("__d").alias(f"{s}_domains")), s, "left")
        empty = F.array().cast(dict(listed.dtypes)["__d"])
        out = out.withColumns({f"{s}_domains": F.coalesce(f"{s}_domains", empty) for s in ("a", "b")})
    return out


def pair_agreement(pairs: DataFrame, groups_a: DataFrame, groups_b: DataFrame) -> DataFrame:
    """(a, b, same_a, same_b): whether each grouping joins the pair."""
    both = groups_a.select("id", F.col("group_id").alias("ga")).join(groups_b.select("id", F.col("group_id").alias("gb")).hint("merge"), "id")
    left = both.select(F.col("id").alias("a"), F.col("ga").alias("ga1"), F.col("gb").alias("gb1"))
    right = both.select(F.col("id").alias("b"), F.col("ga").alias("ga2"), F.col("gb").alias("gb2"))
    return pairs.join(left, "a").join(right, "b").select(
        "a", "b", (F.col("ga1") == F.col("ga2")).alias("same_a"), (F.col("gb1") == F.col("gb2")).alias("same_b")
    )


def combine_representations(candidates: dict[str, DataFrame | None]) -> tuple[DataFrame, list[str]]:
    """(representation, id, vector) of the available candidates and the names skipped."""
    skipped = [n for n, df in candidates.items() if df is None]
    tables = [
        df.select(F.lit(n).alias("representation"), "id", F.col("vector").cast("array<double>").alias("vector"))
        for n, df in candidates.items() if df is not None
    ]
    return reduce(lambda x, y: x.unionByName(y), tables), skipped
