"""Group-wise train / validation / test splits and the leakage audit."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkit import constants as C
from strandkit.functions import columns as fc
from strandkit.operators.groups import assign_groups, identity_groups
from strandkit.operators.kmers import kmer_frequencies, sparse_cosine
from strandkit.operators.metrics import pair_distribution
from strandkit.operators.ranking import rank_in_group
from strandkit.operators.sampling import split_pairs
from strandkit.session import reliable_checkpoint

METHODS = ("annotation", "identity")


def fill_plan(
    sizes: list[tuple[int, int]], targets: list[float]
) -> list[tuple[int, list[int]]]:
    """How many groups of each size go to each split.

    Groups come largest first; each goes to the split with the largest deficit
    relative to its target, ties to the larger target.  Groups of one size are
    interchangeable, so a run of equal sizes is dealt at once: split i reaches a
    deficit level after a countable number of groups, and bisection finds the
    level at which the run is used up.
    """
    filled = [0.0] * len(targets)
    plan = []
    for size, count in sorted(sizes, reverse=True):
        steps = [size / max(t, 1.0) for t in targets]
        start = [(t - f) / max(t, 1.0) for t, f in zip(targets, filled)]

        def taken(level: float) -> list[int]:
            return [max(0, math.floor((d - level) / s)) for d, s in zip(start, steps)]

        low, high = min(start) - (count + 1) * max(steps), max(start)
        given = [0] * len(targets)
        if count > 64:
            for _ in range(200):
                mid = (low + high) / 2
                if mid in (low, high):
                    break
                low, high = (mid, high) if sum(taken(mid)) > count - 16 else (low, mid)
            given = taken(high)
        while sum(given) < count:
            level = [d - g * s for d, g, s in zip(start, given, steps)]
            best = max(range(len(targets)), key=lambda i: (round(level[i], 12), targets[i]))
            given[best] += 1
        filled = [f + g * size for f, g in zip(filled, given)]
        plan.append((size, given))
    return plan


def make_splits(
    groups: DataFrame, ratios: tuple[float, ...] = C.SPLIT_RATIOS, seed: int = 42,
    names: tuple[str, ...] = C.SPLIT_NAMES, group: str = "group_id",
) -> DataFrame:
    """Adds ``split`` so that no group straddles two splits.

    Only the histogram of group sizes reaches the driver: n rows have fewer than
    sqrt(2 n) distinct group sizes.  Groups of a size are dealt in random order.
    """
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError("ratios must sum to 1")
    # both are read several times
    groups = reliable_checkpoint(groups)
    sizes = reliable_checkpoint(groups.groupBy(group).agg(F.count(F.lit(1)).alias("size")))
    histogram = [(r["size"], r["n"]) for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()]
    total = sum(s * n for s, n in histogram)
    rows = []
    for size, given in fill_plan(histogram, [r * total for r in ratios]):
        first = 1
        for name, n in zip(names, given):
            if n:
                rows.append((size, first, first + n - 1, name))
                first += n
    plan = groups.sparkSession.createDataFrame(rows, "size long, first long, last long, split string")
    ranked = rank_in_group(
        sizes, ["size"], fc.hash_fraction(seed, F.col(group)),
        [fc.hash_order(seed, F.col(group)), F.col(group)], "__rank", "__n",
    )
    dealt = ranked.join(F.broadcast(plan), "size").filter(F.col("__rank").between(F.col("first"), F.col("last")))
    return groups.join(dealt.select(group, "split"), group)


def split_corpus(
    df: DataFrame, ident: str, seq: str, tokens: str | None = None, method: str = "annotation",
    ratios: tuple[float, ...] = C.SPLIT_RATIOS, seed: int = 42,
) -> DataFrame:
    """(id, group_id, kind, split) of a corpus under a named grouping method."""
    if method == "annotation":
        groups = assign_groups(df, ident, tokens, seq)
    elif method == "identity":
        groups = identity_groups(df, ident, seq).withColumn("kind", F.lit("identity"))
    else:
        raise ValueError(f"unknown split method {method!r}; use one of {METHODS}")
    return make_splits(groups, ratios, seed)


def split_summary(splits: DataFrame, group: str = "group_id") -> DataFrame:
    return splits.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups")
    )


def audit_leakage(
    df: DataFrame, ident: str, seq: str, split: str = "split", n_pairs: int = 2000, k: int = 4,
    seed: int = 42, alphabet: str | None = C.AMINO_ACIDS,
) -> DataFrame:
    """k-mer cosine of sampled train-test pairs against train-train pairs."""
    pairs = reliable_checkpoint(split_pairs(df, split, ident, n_pairs, seed))
    named = pairs.select(F.col("a").alias(ident)).unionByName(pairs.select(F.col("b").alias(ident))).distinct()
    sampled = df.select(ident, seq).join(named, ident, "left_semi")
    # the features of the sampled rows only, read on both sides of every pair
    features = reliable_checkpoint(kmer_frequencies(sampled, ident, seq, k, alphabet))
    return pair_distribution(sparse_cosine(pairs, features, ident), "stratum", "cosine")
