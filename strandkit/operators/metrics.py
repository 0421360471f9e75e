"""Evaluation metrics as aggregations over prediction, pair and cluster tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandkit import constants as C
from strandkit.functions.stats import spearman_p_value
from strandkit.operators.knn import BATCH_BYTES
from strandkit.operators.ranking import cumulative_before, group_quantiles, ranks_from, slice_bounds
from strandkit.session import reliable_checkpoint, shuffle_width


def one_row(*tables: DataFrame) -> DataFrame:
    """Columns of several one-row tables side by side, by a union and one aggregate."""
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of each pair of labels; rows with a null on either side drop out."""
    return df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Share of rows that carry the majority label of their cluster; NaN if none."""
    best = contingency(df, cluster, label).groupBy(cluster).agg(
        F.max("n").alias("best"), F.sum("n").alias("total")
    )
    return best.agg(
        F.coalesce(F.sum("best") / F.sum("total"), F.lit(float("nan"))).alias("purity")
    )


def normalized_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information over the arithmetic mean of both entropies."""
    cells = contingency(df, a, b)
    rows = cells.groupBy(a).agg(F.sum("n").alias("n_a"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n_b"))

    def entropy(table: DataFrame, count: str, name: str) -> DataFrame:
        # sum of n ln n gives the entropy without joining the total to every row
        return table.agg(F.sum(F.col(count) * F.log(F.col(count))).alias(name))

    joint = cells.join(rows, a).join(cols, b).agg(
        F.sum(F.col("n") * F.log(F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))).alias("s"),
        F.sum("n").alias("n_all"),
    )
    sums = one_row(joint, entropy(rows, "n_a", "ea"), entropy(cols, "n_b", "eb"))
    n = F.col("n_all").cast("double")
    mi = F.greatest(F.col("s") / n + F.log(n), F.lit(0.0))
    mean_entropy = F.log(n) - (F.col("ea") + F.col("eb")) / (2 * n)
    return sums.select(
        F.when(mean_entropy <= 1e-15, F.lit(1.0)).otherwise(mi / mean_entropy).alias("nmi")
    )


def accuracy_and_macro_f1(df: DataFrame, truth: str, predicted: str, by: list[str] = ()) -> DataFrame:
    """Accuracy and unweighted mean F1 over the classes of truth and prediction."""
    by = list(by)
    cells = df.groupBy(*by, truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)
    sides = cells.select(
        *by, "n", hit.alias("hit"),
        F.explode(F.array(
            F.struct(F.col(truth).alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p")),
            F.struct(F.col(predicted).alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p")),
        )).alias("side"),
    )
    per_class = sides.groupBy(*by, F.col("side.cls").alias("cls")).agg(
        F.sum(F.col("hit") * F.col("side.t")).alias("tp"),
        F.sum(F.col("n") * F.col("side.t")).alias("n_true"),
        F.sum(F.col("n") * F.col("side.p")).alias("n_pred"),
    )
    return per_class.groupBy(*by).agg(
        F.sum("n_true").alias("n"),
        (F.sum("tp") / F.sum("n_true")).alias("accuracy"),
        F.avg(2 * F.col("tp") / (F.col("n_true") + F.col("n_pred"))).alias("macro_f1"),
    )


def auroc(df: DataFrame, positive: Column, score: str, by: list[str] = ()) -> DataFrame:
    """Mann-Whitney AUROC per group; groups without both classes are absent.

    Rows without a label or without a score (null or NaN) do not count.  Rows
    collapse to distinct scores first, so heavy ties cost nothing.
    """
    by = list(by)
    known = df.filter(positive.isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    values = known.groupBy(*by, score).agg(
        F.sum(F.when(positive, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(positive, 0).otherwise(1)).alias("neg"),
    )
    ranked = cumulative_before(values, by, score, ["neg"])
    return (
        ranked.groupBy(*by)
        .agg(
            F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("wins"),
            F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        )
        .filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
        .select(*by, "n_pos", "n_neg", (F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"))
    )


def auroc_one_vs_rest(df: DataFrame, truth: str, class_scores: str, by: list[str] = ()) -> DataFrame:
    """Macro mean of one-vs-rest AUROC from a map column class -> score; null as
    soon as one class is undefined."""
    by = list(by)
    long = df.select(*by, truth, F.explode(class_scores).alias("cls", "score"))
    classes = long.select(*by, "cls").distinct()
    each = auroc(long, F.col(truth) == F.col("cls"), "score", by=[*by, "cls"])
    joined = classes.join(each, [*by, "cls"], "left")
    return joined.groupBy(*by).agg(
        F.when(F.count("auroc") == F.count(F.lit(1)), F.avg("auroc")).alias("auroc_macro_ovr")
    )


def correlation(x: Column, y: Column) -> Column:
    """Pearson r as an aggregate; null where one side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def pearson(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(F.col(x), F.col(y)).alias("pearson_r"))


def spearman(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """Rank correlation with average ranks, and its two-sided p value."""
    by = list(by)
    rows = df.dropna(subset=[x, y])
    cells = rows.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("w"))
    bounds = dict(zip((x, y), slice_bounds(rows, [x, y])))
    ranks = lambda col, rank: ranks_from(rows, by, col, rank, bounds[col]).drop("n")
    joined = cells.join(ranks(x, "rx"), [*by, x]).join(ranks(y, "ry"), [*by, y])
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    # ranks of n rows always average (n + 1) / 2
    sums = joined.groupBy(*by).agg(
        F.sum("w").alias("n"),
        F.sum(w * rx * ry).alias("sxy"), F.sum(w * rx * rx).alias("sxx"), F.sum(w * ry * ry).alias("syy"),
    )
    n = F.col("n")
    mean = n * ((n + 1) / 2) * ((n + 1) / 2)
    cov, vx, vy = F.col("sxy") - mean, F.col("sxx") - mean, F.col("syy") - mean
    rho = F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    out = sums.select(*by, "n", rho.alias("rho"))
    return out.withColumn("p_value", spearman_p_value(F.col("rho"), F.col("n")))


def stability(pairs: DataFrame, cosine: str = "cosine", by: list[str] = ()) -> DataFrame:
    """Count, mean, population deviation, 5 % quantile and minimum of cosines."""
    by = list(by)
    basic = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(cosine).alias("cosine_mean"),
        F.stddev_pop(cosine).alias("cosine_std"), F.min(cosine).alias("cosine_min"),
    )
    low = group_quantiles(pairs, by, cosine, {"cosine_p05": 0.05})
    both = basic.join(low, by) if by else one_row(basic, low)
    return both.select(*by, "n_pairs", "cosine_mean", "cosine_std", "cosine_p05", "cosine_min")


def pair_distribution(pairs: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, 95 %, 99 % quantile and maximum per stratum."""
    basic = pairs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(value).alias("mean"), F.max(value).alias("max")
    )
    high = group_quantiles(pairs, [by], value, {"p95": 0.95, "p99": 0.99})
    return basic.join(high, by).select(by, "n_pairs", "mean", "p95", "p99", "max")


def eligible_queries(df: DataFrame, label: str, least: int = 2) -> DataFrame:
    """Rows whose label is not null and occurs at least ``least`` times."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(counts.filter(F.col("__n") >= least).select(label), label, "left_semi")


def precision_at_k(hits: DataFrame, labels: DataFrame, ks: list[int], id_col: str = "id", label: str = "label") -> DataFrame:
    """Mean share of same-label neighbours among the first k hits of each query.

    ``hits`` comes from a search over the whole corpus; an unlabelled neighbour
    is a miss, and the divisor is the number of hits returned.
    """
    q = labels.select(F.col(id_col).alias("query_id"), F.col(label).alias("__lq"))
    c = labels.select(F.col(id_col).alias("id"), F.col(label).alias("__lc"))
    match = F.coalesce((F.col("__lq") == F.col("__lc")).cast("double"), F.lit(0.0))
    scored = hits.join(c, "id").join(q, "query_id").withColumn("match", match)
    inside = lambda k: F.when(F.col("rank") <= k, F.col("match"))
    per_query = scored.groupBy("query_id").agg(*[F.avg(inside(k)).alias(f"p{k}") for k in ks])
    return per_query.agg(
        F.count(F.lit(1)).alias("n_evaluated"),
        *[F.avg(f"p{k}").alias(f"precision_at_{k}") for k in ks],
    )


def recall_at_k(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Share of exact neighbours that the other result also returns."""
    truth = exact.filter(F.col("rank") <= k).select("query_id", "id")
    hits = found.filter(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("__hit"))
    per_query = truth.join(hits, ["query_id", "id"], "left").groupBy("query_id").agg(
        F.count("__hit").alias("hits")
    )
    return per_query.agg(
        F.count(F.lit(1)).alias("n_queries"),
        (F.sum("hits") / (F.count(F.lit(1)) * k)).alias(f"recall_at_{k}"),
    )


def nearest_label_accuracy(hits: DataFrame, truth: DataFrame, reference: DataFrame, label: str = "label") -> DataFrame:
    """Share of queries whose first hit carries their own label."""
    q = truth.select(F.col("id").alias("query_id"), F.col(label).alias("__lq"))
    c = reference.select(F.col("id"), F.col(label).alias("__lc"))
    return hits.filter(F.col("rank") == 1).join(q, "query_id").join(c, "id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce((F.col("__lq") == F.col("__lc")).cast("double"), F.lit(0.0))).alias("accuracy"),
    )


def grouping_disagreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exact pair counts over all pairs of rows, from group sizes alone."""
    cells = contingency(df, a, b)
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2).cast("long")
    both = cells.agg(pairs("n").alias("both_join"), F.sum("n").alias("n_rows"))
    in_a = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs("n").alias("join_a"))
    in_b = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs("n").alias("join_b"))
    return one_row(both, in_a, in_b).select(
        "n_rows", "both_join",
        (F.col("join_a") - F.col("both_join")).alias("only_a"),
        (F.col("join_b") - F.col("both_join")).alias("only_b"),
    )


def sampled_disagreement(pairs: DataFrame) -> DataFrame:
    """The same counts over a pair table with columns same_a and same_b."""
    a, b = F.col("same_a"), F.col("same_b")
    return pairs.agg(
        F.count(F.lit(1)).alias("sampled_pairs"),
        F.count_if(a & b).alias("both_join"),
        F.count_if(a & ~b).alias("only_a"),
        F.count_if(~a & b).alias("only_b"),
    )


# Bytes of the anchors that a task of the loss holds; lanes of a large batch.
HELD_BYTES, LANES = 256 << 20, 6


def contrastive_loss(
    rows: DataFrame, batch: str, ident: str, label: str, vec: str, temperature: float = 0.1, block_rows: int = 1024
) -> DataFrame:
    """Supervised contrastive loss per batch; a batch without positives scores 0.

    A batch may hold any number of rows: it is cut into blocks.  Its blocks of anchors are dealt to
    super-blocks that fit a task's memory, all its blocks to lanes; a (super-block, lane) holds its
    anchors and streams the blocks of its lane past them, so a row is sent as often as there are
    super-blocks and lanes, not blocks.  Only partial sums per anchor leave a task.  A row without a
    label has no positives.
    """
    vec_type = dict(rows.dtypes)[vec]
    base = rows.select(
        F.col(batch).alias("batch"), F.col(ident).cast("string").alias("i"), F.col(label).cast("string").alias("y"),
        F.col(vec).cast(vec_type if vec_type == "array<float>" else "array<double>").alias("z"),
    )
    held = F.ceil(F.sum(F.size("z")) * 8 / HELD_BYTES)
    sizes = base.groupBy("batch").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("n_blocks"), held.alias("held")).select(
        "batch", "n_blocks", F.least("n_blocks", F.greatest("held", F.lit(LANES))).cast("int").alias("supers"),
        F.least("n_blocks", F.lit(LANES)).alias("lanes"),
    )
    packed = reliable_checkpoint(
        base.join(sizes, "batch").withColumn("block", F.pmod(F.xxhash64("i"), F.col("n_blocks")).cast("int"))
        .groupBy("batch", "supers", "lanes", "block").agg(F.collect_list(F.struct("i", "y", "z")).alias("r"))
        .select("batch", "supers", "lanes", "block", F.col("r.i").alias("i"), F.col("r.y").alias("y"), F.flatten("r.z").alias("z"))
    )
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    # every block of anchors meets every block of its batch; a task's anchors come first
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    anchors = packed.select("batch", F.pmod("block", "supers").alias("s"), every("lanes").alias("lane"), F.lit(0).alias("side"), "block", "i", "y", "z")
    others = packed.select("batch", every("supers").alias("s"), F.pmod("block", "lanes").alias("lane"), F.lit(1).alias("side"), "block", "i", "y", "z")
    task = ["batch", "s", "lane"]
    streams = anchors.unionByName(others).repartition(shuffle_width(rows.sparkSession), *task).sortWithinPartitions(*task, "side", "block")
    batch_type = dict(packed.dtypes)["batch"]
    # similarities are bounded by 1 / temperature: shifting by it keeps exp in range
    top = 1.0 / temperature

    def numbers(left: list, right: list) -> list[np.ndarray]:
        known = {None: -1}
        return [np.array([known.setdefault(x, len(known)) for x in side]) for side in (left, right)]

    def sums(key: pa.Array, slabs: list):
        for ids, _, _, total in slabs:
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.to_pylist() * len(ids), key.type), pa.array(ids, pa.string()), pa.array(total[0]), pa.array(total[1]), pa.array(total[2].astype(np.int64))],
                ["batch", "i", "exps", "positive", "n_positive"],
            )

    def run(batches):
        now, key, slabs = None, None, []
        for b in batches:
            column = lambda name: b.column(b.schema.get_field_index(name))
            for row in range(b.num_rows):
                here = tuple(column(name)[row].as_py() for name in task)
                if here != now:
                    if slabs:
                        yield from sums(key, slabs)
                    now, key, slabs = here, column("batch").slice(row, 1), []
                ids, labels = column("i")[row].as_py(), column("y")[row].as_py()
                m = column("z")[row].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), C.EPSILON)
                if not column("side")[row].as_py():
                    slabs.append((ids, labels, unit, np.zeros((3, len(ids)))))
                    continue
                for a_ids, a_labels, a_unit, total in slabs:
                    s = a_unit @ unit.T / temperature
                    (ai, i), (ay, y) = numbers(a_ids, ids), numbers(a_labels, labels)
                    other = ai[:, None] != i[None, :]
                    same = other & (ay[:, None] == y[None, :]) & (ay >= 0)[:, None]
                    total += (np.exp(s - top) * other).sum(axis=1), (s * same).sum(axis=1), same.sum(axis=1)
        if slabs:
            yield from sums(key, slabs)

    part = streams.mapInArrow(run, f"batch {batch_type}, i string, exps double, positive double, n_positive bigint")
    whole = part.groupBy("batch", "i").agg(*[F.sum(c).alias(c) for c in ("exps", "positive", "n_positive")])
    gain = F.when(F.col("n_positive") > 0, F.col("positive") / F.col("n_positive") - (F.log("exps") + top))
    return whole.groupBy("batch").agg(F.coalesce(-F.avg(gain), F.lit(0.0)).alias("loss"))
