import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandkit import constants as C
from strandkit.operators import embed as em
from strandkit.operators import pooling as po
from strandkit.operators import variants as va
from strandkit.operators.align import Aligner, pair_identity, score_matrix
from strandkit.operators.probe import run_probe
from strandkit.plans import effects as ef
from strandkit.plans import search as se

AA = C.AMINO_ACIDS


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    spark.sparkContext.addPyFile(__file__)  # encoders of this module run on workers


class CodeEncoder:
    """Residue value = character code: displacements are easy to reason about."""

    name = "codes"

    def encode(self, sequences):
        out = []
        for s in sequences:
            rows = np.array([[float(ord(c))] * 4 for c in s])
            out.append((rows[0], rows))
        return out


def residues_of(spark, encoder, seqs):
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, sequence string")
    return df, em.encode_residues(df, encoder)


def weights(dim=16, hidden=5, seed=1):
    rng = np.random.default_rng(seed)
    return po.AttentionWeights(rng.normal(size=(hidden, dim)), rng.normal(size=hidden), rng.normal(size=hidden))


def test_one_pass_equals_table_pooling(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice(AA) for _ in range(n)) for n in (10, 25, 60)]
    encoder, w = em.HashingEncoder(16), weights()
    df, residues = residues_of(spark, encoder, seqs)
    one = em.embed(df, encoder, poolings=C.POOLINGS, weights=w, token_budget=64)
    two = po.pool_all(residues, C.POOLINGS, w)
    a = {(r["id"], r["pooling"]): r["vector"] for r in one.collect()}
    b = {(r["id"], r["pooling"]): r["vector"] for r in two.collect()}
    assert a.keys() == b.keys() and len(a) == 12
    assert all(np.allclose(a[k], b[k]) for k in a)
    big = po.AttentionWeights(w.w1, w.b1, w.w2 * 400)  # beyond the fixed shift
    direct = em.embed(df, encoder, poolings=("attention",), weights=big)
    table = po.attention_pool(residues.filter("pos > 0"), ["id"], big)
    x = {r["id"]: r["vector"] for r in direct.collect()}
    assert all(np.allclose(x[r["id"]], r["vector"]) for r in table.collect())


def test_attention_weights_sum_to_one(spark):
    _, residues = residues_of(spark, em.HashingEncoder(16), ["ACDEFGHIKLMN", "WYWYWYWYWYWY"])
    body = residues.filter("pos > 0")
    profile = po.attention_profile(body, ["id"], weights())
    assert all(r["s"] == pytest.approx(1.0) for r in profile.groupBy("id").agg(F.sum("weight").alias("s")).collect())
    assert po.top_positions(profile, ["id"]).count() == 20
    masked = body.withColumn("seen", F.col("pos") <= 3)
    a = po.attention_pool(masked, ["id"], weights(), mask="seen").collect()
    b = {r["id"]: r["vector"] for r in po.attention_pool(body.filter("pos <= 3"), ["id"], weights()).collect()}
    assert all(np.allclose(r["vector"], b[r["id"]]) for r in a)
    with pytest.raises(po.PoolingUnavailableError):
        po.attention_pool(body, ["id"], None)
    with pytest.raises(ValueError):
        po.pool_all(residues, ("median",))


def test_refused_sequences_are_not_embedded(spark):
    df = spark.createDataFrame([(0, "ACDEFGHIKL"), (1, "ACD"), (2, "ACDEFGHIKU"), (3, None), (4, " acdefghikl* ")], "id long, sequence string")
    got = {r["id"]: r["vector"] for r in em.embed(df, em.OneHotEncoder()).collect()}
    assert set(got) == {0, 4} and got[0] == got[4]


def test_cache(spark):
    encoder = em.HashingEncoder(8)
    df = spark.createDataFrame([(0, "ACDEFGHIKL"), (1, "ACDEFGHIKL"), (2, "WWWWWWWWWWWW")], "id long, sequence string")
    empty = spark.createDataFrame([], "key string, vector array<double>, written long")
    first, fresh = em.embed_with_cache(df.filter("id < 2"), empty, encoder)
    assert fresh.count() == 1 and {r["cache_hit"] for r in first.collect()} == {False}
    cache = fresh.withColumn("written", F.lit(1).cast("long"))
    second, fresh2 = em.embed_with_cache(df, cache, encoder)
    assert {r["id"]: r["cache_hit"] for r in second.collect()} == {0: True, 1: True, 2: False}
    assert fresh2.count() == 1
    other, _ = em.embed_with_cache(df, cache, encoder, pooling="attention", weights=weights(8), fingerprint="w2")
    assert {r["cache_hit"] for r in other.collect()} == {False}


def test_scores_from_log_probs(spark):
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(6, 20))
    lp = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    seq = "ACDEFG"
    table = spark.createDataFrame(
        [("p", i + 1, a, float(lp[i, j])) for i in range(6) for j, a in enumerate(AA)], "id string, pos int, symbol string, log_prob double"
    )
    sites = spark.createDataFrame([("p", i + 1, c) for i, c in enumerate(seq)], "id string, pos int, wt string")
    got = {(r["pos"], r["mut"]): r["llr"] for r in va.log_likelihood_ratios(table, sites).collect()}
    assert got[(2, "C")] == 0.0 and got[(2, "W")] == pytest.approx(lp[1, AA.index("W")] - lp[1, AA.index("C")])
    rows = va.conservation(table, sites).collect()
    p = np.exp(lp)
    for r in rows:
        q = p[r["pos"] - 1] / p[r["pos"] - 1].sum()
        assert r["entropy"] == pytest.approx(-(q * np.log(q)).sum(), abs=1e-4)
        assert r["max_entropy"] == pytest.approx(math.log(20), abs=1e-4)
    variants = spark.createDataFrame([("p", 2, "C", "W"), ("p", 99, "C", "W")], "id string, pos int, wt string, mut string")
    scored = {r["pos"]: r["llr"] for r in va.variant_llr(variants, table).collect()}
    assert scored[2] == pytest.approx(got[(2, "W")]) and scored[99] is None


def test_offsets(spark):
    seqs = spark.createDataFrame([("a", "MACDEFGHIK"), ("b", "MACDEFGHIK"), ("c", "MACDEFGHIK")], "assay string, s string")
    rows = [("a", i + 1, c, "W", 1.0) for i, c in enumerate("MACDEFGHIK")]
    rows += [("b", i + 1, c, "W", 1.0) for i, c in enumerate("ACDEFGHIK")]
    rows += [("c", i + 1, "Y", "W", 1.0) for i in range(9)]
    rows += [("a", 1, "M", "W", 3.0)]
    scores = spark.createDataFrame(rows, "assay string, pos int, wt string, mut string, score double")
    offsets = va.detect_offset(scores, seqs, "assay", "s")
    assert {r["assay"]: r["offset"] for r in offsets.collect()} == {"a": 0, "b": 1}
    merged = {(r["assay"], r["pos"]): r["score"] for r in va.align_assay(scores, seqs, offsets, "assay", "s").collect()}
    assert merged[("a", 1)] == 2.0 and ("b", 2) in merged and len(merged) == 19


def test_effects_match_numpy(spark):
    seq = "ACDEFGHIKLMNPQRSTVWY"
    rows = spark.createDataFrame([(1, seq, 10)], "id long, sequence string, pos int")
    encoder = em.HashingEncoder(12)
    got = {r["mut"]: r for r in ef.landscapes(rows, encoder).collect()}
    assert len(got) == 19
    (_, w), = encoder.encode([seq])
    (_, m), = encoder.encode([seq[:9] + "W" + seq[10:]])
    d = np.linalg.norm(m - w, axis=1)
    assert got["W"]["displacement"] == pytest.approx(np.linalg.norm(m.mean(0) - w.mean(0)), abs=1e-5)
    assert got["W"]["local_delta"] == pytest.approx(d[1:18].mean(), abs=1e-5)
    assert got["W"]["global_delta"] == pytest.approx(d.mean(), abs=1e-5)
    assert got["W"]["per_residue_delta"] == pytest.approx(list(np.round(d, 5)), abs=1e-5)
    delta = m.mean(0) - w.mean(0)
    assert [t["dim"] for t in got["W"]["top_dimensions"]] == list(np.argsort(-np.abs(delta), kind="stable")[:10])


def test_chains(spark):
    s = "ACDEHFGHIK"
    rows = [
        (0, s, ["H5Y", "Y5H"]), (1, s, ["H5Y", "H5W"]), (2, s, ["H5Y"] * 12), (3, s, []), (4, s, ["H5Y"]), (5, s, ["5Y"]), (6, "ACB", ["A1C"]),
    ]
    df = spark.createDataFrame(rows, "id long, sequence string, mutations array<string>")
    steps, summary, problems = ef.trajectories(df, CodeEncoder())
    by = {r["id"]: r for r in summary.collect()}
    assert by[0]["directness"] == pytest.approx(0.0) and by[0]["n_steps"] == 2
    assert by[4]["directness"] == pytest.approx(1.0)
    bad = {r["id"]: r["reason"] for r in problems.collect()}
    assert bad == {1: "wild-type:Y", 2: "too long", 3: "no mutation", 5: "unparsed", 6: "short:3"}
    last = steps.filter("id = 0 and step = 2").first()
    assert last["cumulative"] == ["H5Y", "Y5H"] and last["displacement_from_start"] == pytest.approx(0.0)
    assert set(by) == {0, 4}


def naive_score(a, b, tool):
    from functools import lru_cache

    @lru_cache(None)
    def best(i, j, state):
        if i == 0 and j == 0:
            return 0 if state == "m" else -10 ** 9
        options = [-10 ** 9]
        if state == "m" and i and j:
            options.append(max(best(i - 1, j - 1, s) for s in "mxy") + tool.scores[a[i - 1], b[j - 1]])
        if state == "x" and i:
            options += [best(i - 1, j, s) + (tool.gap_extend if s == "x" else tool.gap_open) for s in "mxy"]
        if state == "y" and j:
            options += [best(i, j - 1, s) + (tool.gap_extend if s == "y" else tool.gap_open) for s in "mxy"]
        return max(options)

    return max(best(len(a), len(b), s) for s in "mxy")


def test_alignment_scores_and_identity(spark):
    rng = random.Random(3)
    tool = Aligner()
    for _ in range(40):
        a = "".join(rng.choice(AA) for _ in range(rng.randint(1, 12)))
        b = "".join(rng.choice(AA) for _ in range(rng.randint(1, 12)))
        assert tool.score(a, b) == naive_score(a, b, tool)
        assert 0.0 <= tool.identity(a, b) <= 1.0
    # a gap inside either sequence: 7 matches in 10 columns
    assert tool.identity("WWWWACDWWW", "WWWWWWW") == pytest.approx(0.7)
    assert tool.identity("WWWWWWW", "WWWWACDWWW") == pytest.approx(0.7)
    assert score_matrix()["W", "W"] == 11 and score_matrix()["A", "R"] == -1 and len(score_matrix()) == 400
    df = spark.createDataFrame([("ACDEFGHIKL", "ACDEFGHIKL"), ("ACDEFGHIKL", "ACDEFGHIKLWWWW"), ("ACDEFGHIKL", "ACDEWGHIKL")], "seq_a string, seq_b string")
    got = {r["seq_b"]: r["identity"] for r in pair_identity(df).collect()}
    assert got == {"ACDEFGHIKL": 1.0, "ACDEFGHIKLWWWW": pytest.approx(10 / 14), "ACDEWGHIKL": pytest.approx(0.9)}


def test_probe_separates_classes(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        y = i % 3
        v = rng.normal(size=5)
        v[y] += 4
        rows.append((i, [float(x) for x in v], f"c{y}" if i % 17 else None, "train" if i % 4 else "test"))
    df = spark.createDataFrame(rows, "id long, v array<double>, y string, split string")
    got = run_probe(df, "v", "y", least=10, max_iter=50).first()
    assert got["n_classes"] == 3 and got["accuracy"] > 0.9 and got["macro_f1"] > 0.9 and got["auroc"] > 0.95
    two = run_probe(df.filter("y <> 'c2'"), "v", "y", least=10, max_iter=50).first()
    assert two["auroc"] > 0.95


def test_search_requests(spark):
    encoder = em.OneHotEncoder()
    rows = spark.createDataFrame(
        [("P00001", "ACDEFGHIKL"), ("P00002", "ACDEFGHIKM"), ("P00003", "WWWWWWWWWW")], "accession string, sequence string"
    )
    store = em.embed(rows, encoder, "accession").select("id", "vector")
    with pytest.raises(ValueError):
        se.search(store, rows, ["sequence"], 3)
    with pytest.raises(ValueError):
        se.search(store, rows, ["sequence"], 0, ids=rows.select("accession"))
    by_id = se.search(store, rows, ["sequence"], 1, ids=rows.select("accession").filter("accession = 'P00001'")).first()
    assert by_id["id"] == "P00002"
    fresh = spark.createDataFrame([("q", "ACDEFGHIKL")], "id string, sequence string")
    by_seq = se.search(store, rows, ["sequence"], 1, sequences=fresh, encoder=encoder).first()
    assert by_seq["id"] == "P00001" and by_seq["similarity"] == 1.0
    records = spark.createDataFrame([("Q99999", "WWWWWWWWWC")], "accession string, sequence string")
    wanted = spark.createDataFrame([(" p00001 ",), ("q99999",), ("zz",), ("X00000",)], "accession string")
    states = {r["accession"]: r["source"] for r in se.request_states(wanted, records, rows).collect()}
    assert states == {"P00001": "corpus", "Q99999": "external", "ZZ": "malformed", "X00000": "not_found"}
    hits = se.external_search(wanted, records, rows, store, encoder, 1).collect()
    assert {(r["query_id"], r["source"], r["id"]) for r in hits} == {("P00001", "corpus", "P00002"), ("Q99999", "external", "P00003")}


def test_equal_sequences_are_searched_once(spark, monkeypatch):
    encoder = em.OneHotEncoder()
    rows = spark.createDataFrame([("P00001", "ACDEFGHIKL"), ("P00003", "WWWWWWWWWW")], "accession string, sequence string")
    store = em.embed(rows, encoder, "accession").select("id", "vector")
    search, sizes = se.neighbours, []
    monkeypatch.setattr(se, "neighbours", lambda vectors, *args, **options: sizes.append(vectors.count()) or search(vectors, *args, **options))
    wanted = [(f"q{i}", ("ACDEFGHIKL", "WWWWWWWWWC")[i % 2]) for i in range(9)] + [("none", None)]
    hits = se.search(store, rows, ["sequence"], 1, "accession", sequences=spark.createDataFrame(wanted, "id string, sequence string"), encoder=encoder)
    got = [(r["query_id"], r["id"]) for r in hits.collect()]
    assert sorted(got) == [(f"q{i}", ("P00001", "P00003")[i % 2]) for i in range(9)] and sizes == [2]


def test_new_sequences_are_searched_exactly_in_a_store_of_any_size(spark, monkeypatch):
    from strandkit.operators import ann, knn as kn

    monkeypatch.setattr(kn, "APPROXIMATE_FROM", 2)
    monkeypatch.setattr(ann, "build_cells", lambda *args, **kwargs: pytest.fail("an index was built"))
    rows = spark.createDataFrame([(f"P{i:05d}", "ACDEFGHIKL"[i % 10:] + "MNPQ" * 4 + "ACDEFGHIKL"[:i % 7]) for i in range(30)], "accession string, sequence string")
    encoder = em.OneHotEncoder()
    store = em.embed(rows, encoder, "accession", "sequence", ("mean",)).select(F.col("id").alias("accession"), F.col("id"), "vector")
    wanted = rows.limit(5).select(F.col("accession").alias("id"), "sequence")
    hits = se.search(store, rows, ["sequence"], 1, "accession", sequences=wanted, encoder=encoder)
    assert hits.count() == 5 and hits.filter("similarity < 0.9999").count() == 0


def test_region_search_drops_its_own_record(spark):
    encoder = em.HashingEncoder(8)
    rows = spark.createDataFrame([("a", "ACDEFGHIKLMNPQ"), ("b", "ACDEFGHIKLMNPR"), ("c", "WYWYWYWYWYWYWY")], "id string, sequence string")
    residues = em.encode_residues(rows, encoder)
    store = em.embed(rows, encoder).select("id", "vector")
    lengths = rows.select("id", F.length("sequence").alias("length"))
    regions = spark.createDataFrame([("a", 2, 12), ("a", 0, 5), ("c", 3, 5)], "id string, start int, end int")
    hits = se.region_search(regions, residues, lengths, store, 2).collect()
    assert {r["region"] for r in hits} == {"a:2:12"} and [r["id"] for r in sorted(hits, key=lambda r: r["rank"])] == ["b", "c"]
    assert {r["reason"] for r in se.region_problems(regions, lengths).collect()} == {None, "outside", "short"}


def test_pair_study_joins_sampled_rows_only(spark):
    from strandkit.operators.kmers import composition
    from strandkit.plans.study import pair_study

    sequence = F.substring(F.lit("ACDEFGHIKLMNPQRSTVWY"), F.col("id").cast("int") % 7 + 1, F.col("id").cast("int") % 5 + 5)
    corpus = spark.range(40).select("id", sequence.alias("seq"), (F.col("id") % 3).cast("string").alias("family"))
    study = pair_study(corpus, composition(corpus, "id", "seq"), "id", "seq", "family", 16)
    assert "Range (" not in study._jdf.queryExecution().optimizedPlan().toString()
    rows = study.collect()
    assert {r["stratum"] for r in rows} == {"random", "nn"} and len({(r["a"], r["b"]) for r in rows}) == len(rows) >= 9
