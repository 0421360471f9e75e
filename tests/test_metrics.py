import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandkit.functions.stats import incomplete_beta, t_two_sided
from strandkit.operators import aggregates as ag
from strandkit.operators import metrics as mt
from strandkit.operators import ranking as rk


def test_purity_ignores_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, None)], "c int, y string")
    assert mt.purity(df, "c", "y").first()["purity"] == pytest.approx(3 / 4)
    assert math.isnan(mt.purity(df.filter("y is null"), "c", "y").first()["purity"])


def test_nmi_extremes(spark):
    same = spark.createDataFrame([(i % 3, str(i % 3)) for i in range(30)], "c int, y string")
    assert mt.normalized_mutual_information(same, "c", "y").first()["nmi"] == pytest.approx(1.0)
    apart = spark.createDataFrame([(i % 2, str(i // 2 % 2)) for i in range(40)], "c int, y string")
    assert mt.normalized_mutual_information(apart, "c", "y").first()["nmi"] == pytest.approx(0.0, abs=1e-9)


def test_auroc_undefined_group_is_absent(spark):
    df = spark.createDataFrame([("x", 1, 0.9), ("x", 0, 0.1), ("y", 1, 0.5)], "g string, y int, s double")
    got = mt.auroc(df, F.col("y") == 1, "s", ["g"]).collect()
    assert [(r["g"], r["auroc"]) for r in got] == [("x", 1.0)]


def test_ties_share_ranks(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 6, 300).astype(float), rng.normal(size=300).round(1)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")

    def ranks(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    want = np.corrcoef(ranks(a), ranks(b))[0, 1]
    row = mt.spearman(df, "a", "b").first()
    assert row["rho"] == pytest.approx(want) and 0 <= row["p_value"] <= 1
    assert mt.spearman(df.withColumn("a", F.lit(1.0)), "a", "b").first()["rho"] is None
    table = {r["a"]: r["r"] for r in rk.average_ranks(df, [], "a", "r").collect()}
    assert table == {float(x): pytest.approx(ranks(a)[list(a).index(x)]) for x in set(a)}


def test_incomplete_beta_values():
    assert incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)
    assert incomplete_beta(0.5, 0.5, 0.25) == pytest.approx(1 / 3)
    assert incomplete_beta(1, 1, 0.3) == pytest.approx(0.3)
    # Student's t with 2 degrees of freedom has a closed form
    rho, n = 0.6, 4
    t = rho * math.sqrt(2 / (1 - rho * rho))
    assert t_two_sided(rho, n) == pytest.approx(1 - t / math.sqrt(2 + t * t))


def test_contrastive_loss(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(8, 5))
    y = [0, 0, 1, 1, 1, 2, 3, 3]
    df = spark.createDataFrame([(0, i, y[i], [float(v) for v in z[i]]) for i in range(8)], "b int, i int, y int, v array<double>")
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    s = u @ u.T / 0.1
    terms = []
    for i in range(8):
        others = [j for j in range(8) if j != i]
        positives = [j for j in others if y[j] == y[i]]
        if positives:
            lse = np.log(np.exp(s[i, others]).sum())
            terms.append(-np.mean([s[i, j] - lse for j in positives]))
    assert mt.contrastive_loss(df, "b", "i", "y", "v").first()["loss"] == pytest.approx(np.mean(terms))
    alone = df.withColumn("y", F.col("i"))
    assert mt.contrastive_loss(alone, "b", "i", "y", "v").first()["loss"] == 0.0


def test_ranks_inside_a_hot_group(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") < 2900, "hot").otherwise("cold"))
    ranked = rk.random_rank_in_group(df, ["g"], ["id"], 42)
    rows = ranked.collect()
    for g, n in (("hot", 2900), ("cold", 100)):
        mine = [r for r in rows if r["g"] == g]
        assert sorted(r["group_rank"] for r in mine) == list(range(1, n + 1))
        assert {r["group_size"] for r in mine} == {n}
    import hashlib
    order = sorted((i for i in range(2900)), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    got = {r["group_rank"]: r["id"] for r in rows if r["g"] == "hot"}
    assert [got[i + 1] for i in range(2900)] == order


def test_global_row_numbers(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v")).repartition(5)
    got = {r["id"]: r["row_number"] for r in rk.global_row_number(df, [F.col("v"), F.col("id")]).collect()}
    order = sorted(range(500), key=lambda i: (i % 7, i))
    assert [order[got[i] - 1] for i in range(500)] == list(range(500))


def test_fold_and_scale(spark):
    df = spark.createDataFrame([(v,) for v in ["a"] * 5 + ["b"] * 3 + ["c", "d"] + [None] * 2], "v string")
    got = {r["label"]: r["n"] for r in ag.fold_other(df, "v", 2).collect()}
    assert got == {"a": 5, "b": 3, "Other": 2, "n/a": 2}
    flat = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r["scaled"] for r in ag.scaled(flat, "x").collect()] == [0.0, 0.0]


def test_disagreement_counts_pairs(spark):
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (2, 1)]
    got = mt.grouping_disagreement(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    both = only_a = only_b = 0
    for i in range(5):
        for j in range(i):
            x, y = rows[i][0] == rows[j][0], rows[i][1] == rows[j][1]
            both, only_a, only_b = both + (x and y), only_a + (x and not y), only_b + (y and not x)
    assert (got["both_join"], got["only_a"], got["only_b"]) == (both, only_a, only_b)


def test_quantiles_and_order_in_a_hot_group(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=900).round(2)
    df = spark.createDataFrame([(i, "hot" if i < 800 else "cold", float(v)) for i, v in enumerate(x)], "id long, g string, x double")
    got = {r["g"]: r for r in rk.group_quantiles(df, ["g"], "x", {"lo": 0.05, "mid": 0.5, "top": 1.0}).collect()}
    for g, part in (("hot", x[:800]), ("cold", x[800:])):
        assert [got[g][n] for n in ("lo", "mid", "top")] == pytest.approx([np.quantile(part, p) for p in (0.05, 0.5, 1.0)])
    rows = rk.number_in_order(df.repartition(5), ["g"], ["x", "id"], "n", {"before": "id"}).collect()
    for g in ("hot", "cold"):
        mine = sorted((r for r in rows if r["g"] == g), key=lambda r: r["n"])
        assert [r["n"] for r in mine] == list(range(1, len(mine) + 1))
        order = sorted((r["x"], r["id"]) for r in mine)
        assert [r["id"] for r in mine] == [i for _, i in order]
        assert [r["before"] for r in mine] == [None, *[i for _, i in order[:-1]]]


def test_auroc_skips_missing_labels_and_scores(spark):
    rows = [(1, 0.9), (0, 0.1), (None, 0.95), (1, 0.8), (0, 0.2), (0, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "label int, score double")
    row = mt.auroc(df, F.col("label") == 1, "score").first()
    assert (row["n_pos"], row["n_neg"], row["auroc"]) == (2, 2, 1.0)
