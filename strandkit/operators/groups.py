"""Grouping of records: shared tokens, orphan linking and identity groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandkit import constants as C
from strandkit.operators.containment import containment_pairs
from strandkit.operators.kmers import best_match, similar_sequences
from strandkit.operators.metrics import one_row
from strandkit.session import drop_table, reliable_checkpoint

MAX_ROUNDS = 60


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Alternates two star contractions until nothing changes.  Each round works on
    an edge list that never grows, minima combine on the map side, and a hub node
    is a hot join key whose other side is one row, which adaptive skew splitting
    handles.  Rounds end in a reliable checkpoint, so lost executors cost one round.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    current = reliable_checkpoint(pairs.filter("u <> v"))
    state = None
    for _ in range(MAX_ROUNDS):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # link every larger neighbour to the smallest one; repeats go away below
        large = both.filter("v > u").join(_smallest_neighbour(both), "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        # link the node and its smaller neighbours to the smallest one
        lows = _smallest_neighbour(large)
        small = (
            large.join(lows, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lows.select("u", F.col("m").alias("v")))
            .distinct()
        )
        # the written edge set is compared by count and hash sum; the round before is read
        # for the last time when this one is written
        before, current = current, reliable_checkpoint(small)
        drop_table(before)
        seen = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(current, nodes["node"] == current["u"], "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )


def annotation_tokens(family: Column, domains: Column) -> Column:
    """All tokens that link a row: its family and every domain."""
    fam = F.when(family.isNotNull(), F.array(F.concat(F.lit("fam:"), family))).otherwise(
        F.array().cast("array<string>")
    )
    dom = F.transform(F.coalesce(domains, F.array().cast("array<string>")), lambda d: F.concat(F.lit("pfam:"), d))
    return F.array_distinct(F.concat(fam, dom))


def token_groups(df: DataFrame, ident: str, tokens: str) -> DataFrame:
    """(id, group_id) of the rows that carry tokens; a group is named by its smallest token.

    Tokens may be long texts, so they stay in their rows: a row keeps its smallest token and the
    digests of all.  The graph has one number per row; each row is linked to the first one that
    shares a token.  Rows that share none are their own group and meet no other.
    """
    digest = lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 16)
    rows = df.filter(F.size(tokens) > 0).select(
        F.col(ident).alias("__id"), F.array_min(tokens).alias("low"), F.transform(tokens, digest).alias("ds"),
    ).filter("low is not null")
    # the checkpoint keeps the numbers fixed
    marked = reliable_checkpoint(rows.withColumn("n", F.monotonically_increasing_id()))
    held = marked.select("n", F.explode("ds").alias("d")).filter("d is not null")
    shared = held.groupBy("d").agg(F.min("n").alias("a"), F.max("n").alias("z")).filter("a < z").select("d", "a")
    edges = reliable_checkpoint(held.join(shared, "d").filter("n <> a").select("a", F.col("n").alias("b")).distinct())
    parts = connected_components(edges)
    low = marked.select("__id", "low", "n")
    names = low.join(parts, F.col("n") == F.col("node")).groupBy("component").agg(F.min("low").alias("group_id"))
    named = parts.join(names, "component").select("node", "group_id")
    return low.join(named, F.col("n") == F.col("node"), "left").select(
        F.col("__id").alias(ident), F.coalesce("group_id", "low").alias("group_id")
    )


def assign_groups(
    df: DataFrame, ident: str, tokens: str, seq: str, k: int = C.LINK_K, threshold: float = C.LINK_THRESHOLD
) -> DataFrame:
    """(id, group_id, kind) for every row; kind is annotated, linked or own.

    Rows without tokens join the most similar annotated row.  The remaining ones
    form components over similar pairs, which does not depend on input order.
    """
    grouped = token_groups(df, ident, tokens).select(F.col(ident).alias("id"), "group_id")
    slim = df.select(F.col(ident), F.col(seq), (F.size(tokens) > 0).alias("has"))
    orphans = slim.filter(~F.col("has"))
    links = reliable_checkpoint(best_match(orphans, slim.filter("has"), ident, seq, k, threshold))
    linked = links.join(grouped, links["b"] == grouped["id"]).select(
        F.col("a").alias("id"), "group_id", F.lit("linked").alias("kind")
    )
    rest = orphans.join(links.select(F.col("a").alias(ident)), ident, "left_anti")
    own = similarity_groups(rest, ident, seq, k, threshold).select(
        "id", F.concat(F.lit("kmer:"), F.col("group_id").cast("string")).alias("group_id"), F.lit("own").alias("kind")
    )
    return grouped.select("id", "group_id", F.lit("annotated").alias("kind")).unionByName(linked).unionByName(own)


def similarity_groups(df: DataFrame, ident: str, seq: str, k: int, threshold: float) -> DataFrame:
    """(id, group_id): components over sequence pairs at the Jaccard threshold.

    Copies are one node; a group is named by its smallest row id.
    """
    rows = df.select(F.col(ident).alias("id"), F.col(seq).alias("seq"))
    near, members = similar_sequences(rows.filter("seq is not null"), None, k, threshold)
    parts = connected_components(near, "ka", "kb")
    placed = members.join(parts, F.col("key") == F.col("node"), "left").select(
        "id", F.coalesce("component", "key").alias("part")
    )
    names = placed.groupBy("part").agg(F.min("id").alias("name"))
    grouped = placed.join(names, "part").select("id", F.col("name").alias("group_id"))
    # rows too short for one k-mer stay alone
    return rows.select("id").join(grouped, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def identity_groups(
    df: DataFrame, ident: str, seq: str, k: int = 5, threshold: float = 0.3, coverage: float = 0.8
) -> DataFrame:
    """(id, group_id) by shared windows instead of annotations: components over pairs of which the
    longer one contains ``threshold`` of the shorter one's windows, along ``coverage`` of its
    length, and is not longer than 1 / ``coverage`` times.

    This stands in for clustering by alignment identity (30 % identity, 80 % coverage) and is
    not equal to it.  A group is named by its smallest id; rows without text, and rows too
    short for one window, stay alone (copies of such a text together).
    """
    pairs, members = containment_pairs(df, ident, seq, k, threshold, coverage)
    parts = connected_components(pairs, "a", "b")
    placed = members.join(parts, F.col("key") == F.col("node"), "left").select("id", F.coalesce("component", "key").alias("group_id"))
    return df.select(F.col(ident).alias("id")).join(placed, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def group_statistics(groups: DataFrame, group: str = "group_id", kind: str | None = "kind") -> DataFrame:
    """Number of groups, largest group, its share, singleton share, rows per kind."""
    sizes = groups.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    stats = sizes.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.max("n").alias("largest_group"),
        (F.max("n") / F.sum("n")).alias("largest_group_fraction"),
        F.avg((F.col("n") == 1).cast("double")).alias("singleton_fraction"),
    )
    if kind is None:
        return stats
    kinds = groups.agg(
        F.count_if(F.col(kind) == "annotated").alias("annotated"),
        F.count_if(F.col(kind) == "linked").alias("linked"),
        F.count_if(F.col(kind) == "own").alias("own"),
    )
    return one_row(stats, kinds)
