"""Batches encoded at once, and plans that send no growing table to the driver."""

import numpy as np

import __spark_entry__ as entry
from strandkit.operators import embed as em

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_landscapes_join_their_sites_by_sorting(spark):
    df = entry.queries()["variant_landscapes"](spark, SF)
    assert "Broadcast" not in plan_of(df) and plan_of(df).count("SortMergeJoin") == 1


def test_effects_read_their_rows_once(spark):
    assert "Broadcast" not in plan_of(entry.queries()["variant_effects"](spark, SF))


def test_a_batch_is_encoded_as_its_rows():
    texts = ["ACCA", "B", "CABBAGE", "é𝄞A"]
    encoder = em.OneHotEncoder("ABC")
    for text, (lead, rows) in zip(texts, encoder.encode(texts), strict=True):
        want = np.array([[float(c == a) for a in "ABC"] for c in text])
        assert np.array_equal(rows, want) and np.array_equal(lead, want.mean(axis=0))
    assert np.array_equal(em._pools(encoder.encode(texts), "mean", None), [lead for lead, _ in encoder.encode(texts)])
    assert encoder.encode([]) == []


def test_growing_tables_of_a_comparison_are_joined_by_sorting(spark):
    from strandkit.operators.lookup import pair_agreement

    groups = spark.range(100).selectExpr("id", "id % 7 AS group_id")
    pairs = spark.createDataFrame([(1, 8), (2, 3)], "a long, b long")
    got = pair_agreement(pairs, groups, groups.selectExpr("id", "id % 2 AS group_id"))
    assert "SortMergeJoin" in plan_of(got)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 8, True, False), (2, 3, False, False)]


def test_rows_of_a_loss_are_sent_a_few_times(spark, monkeypatch):
    from strandkit.operators import metrics as mt

    sent = []
    keep = mt.reliable_checkpoint
    monkeypatch.setattr(mt, "reliable_checkpoint", lambda df: sent.append(keep(df)) or sent[-1])
    rows = spark.range(600).selectExpr("'all' AS batch", "id", "id % 5 AS label", "array(sin(id), cos(id), 0.5D) AS vector")
    small = mt.contrastive_loss(rows, "batch", "id", "label", "vector", block_rows=10).first()["loss"]
    n_sent = sent[0].selectExpr("sum(size(i) * (supers + lanes))").first()[0]
    assert n_sent <= 600 * 2 * mt.LANES and sent[0].count() > 50
    whole = mt.contrastive_loss(rows, "batch", "id", "label", "vector", block_rows=1000).first()["loss"]
    assert abs(small - whole) < 1e-9


def test_trajectories_are_computed_once(spark):
    # the summary reads written steps instead of folding and encoding the chains again
    plan = plan_of(entry.queries()["traj_mutations"](spark, SF))
    assert "Broadcast" not in plan and "MapInArrow" not in plan


def test_hashed_contexts_are_summed_in_order():
    encoder = em.HashingEncoder(4, window=1)
    (lead, rows), = encoder.encode(["ABé"])
    codes = [0, 65, 66, 233, 0]
    want = np.tanh([sum(encoder._table[o][codes[i + o]] for o in range(3)) for i in range(3)])
    assert np.array_equal(rows, want) and np.array_equal(lead, np.tanh(rows.sum(axis=0) / np.sqrt(3)))
