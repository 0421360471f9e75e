"""Filters, deduplication and reproducible sampling.

Every draw orders rows by md5(seed | key): the same rows are chosen for any
partitioning, and no random state travels between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandkit import constants as C
from strandkit.functions import columns as fc
from strandkit.operators.ranking import random_rank_in_group, rank_in_group, top_per_group


def _flag(protected: Column | None) -> Column:
    return F.lit(False) if protected is None else F.coalesce(protected, F.lit(False))


def reject_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows per kind of rejection; the kind is the part before the colon."""
    kind = F.coalesce(F.substring_index(F.col(reason), ":", 1), F.lit("valid"))
    return df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def dedup_exact(df: DataFrame, seq: str, ident: str) -> DataFrame:
    """One row per sequence, the one with the smallest id.

    Grouping by digest keeps the shuffle key short; the aggregate combines on the
    map side, so a sequence with very many copies costs one row per map task.
    """
    others = [c for c in df.columns if c != ident]
    row = F.struct(F.col(ident), *[F.col(c) for c in others])
    best = df.groupBy(F.sha2(F.col(seq), 256).alias("__digest")).agg(F.min_by(row, F.col(ident)).alias("r"))
    return best.select("r.*").select(*df.columns)


def drop_uncharacterized(df: DataFrame, name: str) -> DataFrame:
    return df.filter(~F.coalesce(F.col(name).rlike(C.UNCHARACTERIZED_PATTERN), F.lit(False)))


def cap_per_group(
    df: DataFrame, key: str, cap: int, ident: str, protected: Column | None = None, seed: int = 42
) -> DataFrame:
    """At most ``cap`` rows per key; protected rows stay and count, null keys are free."""
    tagged = df.withColumn("__keep", _flag(protected))
    free = tagged.filter(F.col(key).isNull() | F.col("__keep"))
    pool = tagged.filter(F.col(key).isNotNull() & ~F.col("__keep"))
    order = [fc.hash_order(seed, F.col(ident)), F.col(ident)]
    first = top_per_group(pool, [key], order, cap, "__rank")
    held = tagged.filter(F.col("__keep") & F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("__held")
    )
    chosen = first.join(held, key, "left").filter(
        F.col("__rank") <= F.lit(cap) - F.coalesce("__held", F.lit(0))
    )
    return free.select(*df.columns).unionByName(chosen.select(*df.columns))


def proportional_sample(
    df: DataFrame, stratum: str, target: int, ident: str, protected: Column | None = None, seed: int = 42
) -> DataFrame:
    """About ``target`` rows, each stratum by its share and at least one; all rows
    when the table is not larger than the target.  Protected rows always stay."""
    tagged = df.withColumn("__keep", _flag(protected))
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    quotas = counts.select(
        F.col(stratum).alias("__stratum"),
        F.when(total <= target, F.col("__n"))
        .otherwise(F.greatest(F.lit(1), F.bround(F.col("__n") * F.try_divide(F.lit(float(target)), total)).cast("long")))
        .alias("__quota"),
    )
    pool = random_rank_in_group(tagged.filter(~F.col("__keep")), [stratum], [ident], seed, rank="__rank", size="__size")
    chosen = pool.join(quotas, F.col(stratum).eqNullSafe(F.col("__stratum"))).filter(
        F.col("__rank") <= F.col("__quota")
    )
    return tagged.filter("__keep").select(*df.columns).unionByName(chosen.select(*df.columns))


def weighted_stratified_sample(
    df: DataFrame, stratum: str, weight: Column, size: int, ident: str,
    protected: Column | None = None, seed: int = 42,
) -> DataFrame:
    """Weighted draw without replacement in each stratum (Efraimidis-Spirakis keys
    u^(1/w)); protected rows are always in and reduce the share of the rest."""
    tagged = df.withColumn("__keep", _flag(protected)).withColumn("__w", weight.cast("double"))
    rest = tagged.filter(~F.col("__keep"))
    n_all = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_kept = tagged.filter("__keep").agg(F.count(F.lit(1)).alias("n")).scalar()
    # 1 - u^(1/w) grows from 0 to 1 as the sampling key falls
    place = 1 - F.pow(fc.hash_fraction(seed, F.col(ident)), 1 / F.col("__w"))
    ranked = rank_in_group(rest, [stratum], place, [F.col(ident)], "__rank", "__size")
    share = F.coalesce(F.try_divide(F.lit(size) - n_kept, n_all), F.lit(0.0))
    quota = F.greatest(F.lit(1), F.bround(F.col("__size") * share).cast("long"))
    chosen = ranked.filter(F.col("__rank") <= quota)
    return tagged.filter("__keep").select(*df.columns).unionByName(chosen.select(*df.columns))


def top_classes(df: DataFrame, label: str, n: int, least: int = 1) -> DataFrame:
    """The ``n`` most frequent labels with at least ``least`` rows, ties by label."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least).orderBy(F.desc("n"), F.col(label)).limit(n)


def bundle_subset(
    df: DataFrame, group: str, stratum: str, size: int, ident: str,
    protected: Column | None = None, n_groups: int = 12, seed: int = 42,
) -> DataFrame:
    """Protected rows, every row of the largest groups, and a stratified rest."""
    top = top_classes(df, group, n_groups).select(F.col(group).alias("__g"))
    tagged = df.join(F.broadcast(top), F.col(group) == F.col("__g"), "left").withColumn(
        "__in", _flag(protected) | F.col("__g").isNotNull()
    ).drop("__g")
    fixed, rest = tagged.filter("__in"), tagged.filter(~F.col("__in"))
    n_fixed = fixed.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_rest = rest.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.coalesce(F.try_divide(F.greatest(F.lit(size) - n_fixed, F.lit(0)), n_rest), F.lit(0.0))
    ranked = random_rank_in_group(rest, [stratum], [ident], seed, rank="__rank", size="__size")
    quota = F.when(share > 0, F.greatest(F.lit(1), F.bround(F.col("__size") * share).cast("long"))).otherwise(0)
    chosen = ranked.filter(F.col("__rank") <= quota)
    return fixed.select(*df.columns).unionByName(chosen.select(*df.columns))


def training_pool(
    df: DataFrame, label: str, ident: str, least: int = 8, n_classes: int = 120, per_class: int = 20, seed: int = 42
) -> DataFrame:
    """At most ``per_class`` rows of each of the most frequent classes."""
    classes = top_classes(df, label, n_classes, least).select(label)
    pool = df.join(F.broadcast(classes), label, "left_semi")
    order = [fc.hash_order(seed, F.col(ident)), F.col(ident)]
    return top_per_group(pool, [label], order, per_class, "__rank").select(*df.columns)


def stratified_holdout(df: DataFrame, label: str, ident: str, fraction: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds ``holdout``: max(1, round(n * fraction)) rows of each class."""
    ranked = random_rank_in_group(df, [label], [ident], seed, rank="__rank", size="__size")
    quota = F.greatest(F.lit(1), F.bround(F.col("__size") * fraction).cast("long"))
    return ranked.withColumn("holdout", F.col("__rank") <= quota).select(*df.columns, "holdout")


def balanced_batches(
    df: DataFrame, label: str, ident: str, n_batches: int, classes: int = 8, per_class: int = 4, seed: int = 42
) -> DataFrame:
    """(batch, label, id): ``classes`` classes, drawn without replacement, with up to ``per_class``
    members each, drawn without replacement.

    Classes and members are numbered once.  A keyed permutation maps (batch, i) to the number
    of a class, and (batch, class, j) to that of a member, so nothing is ordered per batch.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).filter("__n >= 2")
    eligible = df.join(sizes.select(label), label, "left_semi")
    numbered = random_rank_in_group(eligible.select(label, ident), [label], [ident], seed, rank="__rank", size="__n")
    order = sizes.withColumn("__pos", fc.hash_fraction(seed, F.col(label)))
    placed = rank_in_group(order, [], F.col("__pos"), [F.col(label)], "__c", "__classes").drop("__pos")
    n_classes = sizes.agg(F.count(F.lit(1)).alias("n")).scalar()
    batches = df.sparkSession.range(n_batches).withColumnRenamed("id", "batch").withColumn("__classes_n", n_classes)
    take = F.least(F.lit(classes), F.col("__classes_n")).cast("int")
    draws = batches.filter("__classes_n > 0").withColumn("__i", F.explode(F.sequence(F.lit(0), take - 1)))
    picked = draws.withColumn("__c", fc.permuted(seed, F.col("__classes_n"), F.col("__i"), F.col("batch")) + 1).join(
        placed.select(label, F.col("__n").alias("__size"), "__c"), "__c"
    )
    some = F.least(F.lit(per_class).cast("long"), F.col("__size")).cast("int")
    members = picked.withColumn("__j", F.explode(F.sequence(F.lit(0), some - 1))).withColumn(
        "__rank", fc.permuted(seed + 2, F.col("__size"), F.col("__j"), F.col("batch"), F.col(label)) + 1
    )
    return members.join(numbered.drop("__n"), [label, "__rank"]).select("batch", label, ident)


def numbered_rows(df: DataFrame, ident: str, seed: int, keys: list[str] = ()) -> DataFrame:
    """Dense row numbers 1..n (per key) in random order, for hashed lookups."""
    return random_rank_in_group(df, list(keys), [ident], seed, rank="row", size="n_rows")


def random_pairs(df: DataFrame, ident: str, n_pairs: int, seed: int = 42) -> DataFrame:
    """``n_pairs`` distinct unordered pairs (a, b) of different rows, or all pairs if
    the table has fewer.  Draws are doubled until there are enough; the first ones
    count, so the number of draws does not change the result."""
    rows = numbered_rows(df.select(ident), ident, seed).select("row", F.col(ident).alias("__id"))
    n = df.count()
    wanted, n_draws = min(n_pairs, n * (n - 1) // 2), 2 * n_pairs
    bound = F.lit(max(n, 1))
    i = fc.hash_index(seed, bound, F.col("id"), F.lit("a"))
    j = fc.hash_index(seed, bound, F.col("id"), F.lit("b"))
    while True:
        drawn = (
            df.sparkSession.range(n_draws)
            .select(F.col("id").alias("draw"), (F.least(i, j) + 1).alias("i"), (F.greatest(i, j) + 1).alias("j"))
            .filter("i <> j").groupBy("i", "j").agg(F.min("draw").alias("draw"))
        )
        if drawn.count() >= wanted:
            break
        n_draws *= 2
    pairs = drawn.orderBy("draw").limit(n_pairs)
    left = rows.select(F.col("row").alias("i"), F.col("__id").alias("x"))
    right = rows.select(F.col("row").alias("j"), F.col("__id").alias("y"))
    return pairs.join(left, "i").join(right, "j").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
    )


def split_pairs(df: DataFrame, split: str, ident: str, n_pairs: int, seed: int = 42) -> DataFrame:
    """With-replacement pairs (stratum, pair, a, b): train-test and train-train."""
    rows = numbered_rows(df.select(split, ident), ident, seed, [split])
    draws = df.sparkSession.range(n_pairs).select(
        F.col("id").alias("pair"),
        F.explode(F.array(
            F.struct(F.lit("cross").alias("stratum"), F.lit("train").alias("sa"), F.lit("test").alias("sb")),
            F.struct(F.lit("train").alias("stratum"), F.lit("train").alias("sa"), F.lit("train").alias("sb")),
        )).alias("d"),
    ).select("pair", "d.*")
    sizes = rows.groupBy(split).agg(F.max("n_rows").alias("n"))

    def side(name: str, out: str):
        look = sizes.select(F.col(split).alias(f"s{name}"), F.col("n").alias(f"n{name}"))
        pick = rows.select(F.col(split).alias(f"s{name}"), F.col("row").alias(f"row{name}"), F.col(ident).alias(out))
        return look, pick

    for name, out in (("a", "a"), ("b", "b")):
        look, pick = side(name, out)
        draws = draws.join(look, f"s{name}").withColumn(
            f"row{name}",
            fc.hash_index(seed, F.col(f"n{name}"), F.col("stratum"), F.col("pair"), F.lit(name)) + 1,
        ).join(pick, [f"s{name}", f"row{name}"])
    return draws.select("stratum", "pair", "a", "b")


def substituted_pairs(
    df: DataFrame, ident: str, seq: str, n: int | None = None, seed: int = 42, alphabet: str = C.AMINO_ACIDS
) -> DataFrame:
    """(id, pos, wild, mutated): one hashed substitution in each of n hashed rows."""
    rows = df.select(ident, F.col(seq).alias("wild")).filter(F.length("wild") > 0)
    if n is not None:
        rows = rows.orderBy(fc.hash_order(seed, F.col(ident)), ident).limit(n)
    pos = fc.hash_index(seed, F.length("wild"), F.col(ident), F.lit("pos")) + 1
    rows = rows.withColumn("pos", pos.cast("int")).withColumn("__wt", F.substring("wild", F.col("pos"), F.lit(1)))
    pick = fc.hash_index(seed, F.length(F.col("__alt")), F.col(ident), F.lit("mut")) + 1
    return rows.withColumn("__alt", F.replace(F.lit(alphabet), F.col("__wt"), F.lit(""))).withColumn(
        "mutated", F.overlay("wild", F.substring("__alt", pick.cast("int"), F.lit(1)), F.col("pos"), F.lit(1))
    ).select(ident, "pos", "wild", "mutated")


def trainable_labels(df: DataFrame, split: str, label: str, least: int) -> DataFrame:
    """Rows whose label has at least ``least`` rows in the training split."""
    counts = df.filter((F.col(split) == "train") & F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("__n")
    )
    return df.join(counts.filter(F.col("__n") >= least).select(label), label, "left_semi")


def downsample(df: DataFrame, n: int, ident: str, seed: int = 0) -> DataFrame:
    """Seeded sample of n rows (all when fewer), a feature of report payloads."""
    return df.orderBy(fc.hash_order(seed, F.col(ident)), ident).limit(n)


def missing_requests(wanted: DataFrame, corpus: DataFrame, source: DataFrame, ident: str) -> DataFrame:
    """State of each requested id: present, found (in the source) or not_found."""
    have = corpus.select(ident, F.lit(True).alias("__have")).distinct()
    known = source.select(ident, F.lit(True).alias("__known")).distinct()
    return wanted.select(ident).distinct().join(have, ident, "left").join(known, ident, "left").select(
        ident,
        F.when(F.col("__have"), "present").when(F.col("__known"), "found").otherwise("not_found").alias("state"),
    )


def discordant(identity: str = "identity", cosine: str = "cosine") -> tuple[Column, Column]:
    """Predicates (low identity, high cosine) and (high identity, low cosine)."""
    i, c = F.col(identity), F.col(cosine)
    return (i < 0.20) & (c > 0.90), (i > 0.50) & (c < 0.70)
