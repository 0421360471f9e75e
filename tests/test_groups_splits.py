import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from strandkit.operators import groups as gr
from strandkit.operators import kmers as km
from strandkit.operators import metrics as mt
from strandkit.operators import splits as sp
from strandkit.operators import sampling as sa

AA = "ACDEFGHIKLMNPQRSTVWY"


def sequence(rng, n=80):
    return "".join(rng.choice(AA) for _ in range(n))


def jaccard(a, b, k):
    x = {a[i:i + k] for i in range(len(a) - k + 1)}
    y = {b[i:i + k] for i in range(len(b) - k + 1)}
    return len(x & y) / len(x | y) if x and y else 0.0


def mutate(rng, s, n):
    s = list(s)
    for i in rng.sample(range(len(s)), n):
        s[i] = rng.choice(AA)
    return "".join(s)


@pytest.fixture(scope="module")
def family_rows():
    rng = random.Random(5)
    rows = []
    for f in range(30):
        for m in range(2 + f % 10):
            fam = f"F{f}" if f < 24 else None
            dom = [f"D{f}"] if 20 <= f < 28 else []
            rows.append((len(rows), fam, dom, sequence(rng)))
    return rows


def corpus(spark, rows):
    df = spark.createDataFrame(rows, "id long, family string, pfam array<string>, seq string")
    return df.withColumn("tokens", gr.annotation_tokens(F.col("family"), F.col("pfam")))


def test_chain_of_a_thousand(spark):
    edges = spark.range(999).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = gr.connected_components(edges).groupBy("component").count().collect()
    assert [(r["component"], r["count"]) for r in got] == [(0, 1000)]


def test_components_match_union_find(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(500, i) for i in range(501, 560)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    names = {}
    for n in list(parent):
        names.setdefault(find(n), []).append(n)
    want = {n: min(members) for members in names.values() for n in members}
    got = gr.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_bridges(spark):
    rows = [(0, "A", ["P1"], "x"), (1, None, ["P1"], "x"), (2, "B", ["P2"], "x"), (3, None, ["P2", "P3"], "x"), (4, "C", ["P3"], "x"), (5, "Z", [], "x")]
    got = {r["id"]: r["group_id"] for r in gr.token_groups(corpus(spark, rows), "id", "tokens").collect()}
    assert got[0] == got[1] and got[2] == got[3] == got[4]
    assert len({got[0], got[2], got[5]}) == 3


def test_jaccard_join_matches_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(12):
        base = sequence(rng, 60)
        rows += [base, base, mutate(rng, base, 2), mutate(rng, base, 5), mutate(rng, base, 12)]
    rows += ["ACD", sequence(rng, 30)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, seq string")
    first = {}
    for i, s in enumerate(rows):
        first.setdefault(s, i)
    for threshold in (0.3, 0.5, 0.8):
        want = {
            (min(i, j), max(i, j)): jaccard(a, b, 4)
            for (a, i), (b, j) in combinations(first.items(), 2) if jaccard(a, b, 4) >= threshold
        }
        got = {(r["a"], r["b"]): r["jaccard"] for r in km.jaccard_pairs(df, "id", "seq", 4, threshold).collect()}
        assert got == pytest.approx(want)


def test_orphans(spark):
    rng = random.Random(3)
    base, other = sequence(rng), sequence(rng)
    rows = [
        (0, "A", [], base), (1, None, [], base[:-1] + "A"), (2, None, [], other), (3, None, [], other[:-1] + "C"),
        (4, None, [], sequence(rng)), (5, "B", [], sequence(rng)), (6, None, [], base),
    ]
    got = {r["id"]: (r["group_id"], r["kind"]) for r in gr.assign_groups(corpus(spark, rows), "id", "tokens", "seq").collect()}
    assert len(got) == 7
    assert got[1] == (got[0][0], "linked") and got[6] == (got[0][0], "linked")
    assert got[2][0] == got[3][0] and got[2][1] == "own"
    assert len({got[i][0] for i in (0, 2, 4, 5)}) == 4


def test_identity_groups_need_coverage(spark):
    rng = random.Random(4)
    base = sequence(rng, 100)
    rows = [(0, base), (1, mutate(rng, base, 3)), (2, base[:55]), (3, sequence(rng, 100)), (4, "AC")]
    df = spark.createDataFrame(rows, "id long, seq string")
    got = {r["id"]: r["group_id"] for r in gr.identity_groups(df, "id", "seq").collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


def test_fill_plan_equals_one_by_one():
    rng = random.Random(8)
    for _ in range(100):
        sizes = {rng.randint(1, 60): rng.randint(1, 300) for _ in range(rng.randint(1, 25))}
        total = sum(s * n for s, n in sizes.items())
        targets = [0.7 * total, 0.15 * total, 0.15 * total]
        filled, want = [0, 0, 0], {}
        for s in sorted(sizes, reverse=True):
            want[s] = [0, 0, 0]
            for _ in range(sizes[s]):
                best = max(range(3), key=lambda i: (round((targets[i] - filled[i]) / max(targets[i], 1), 12), targets[i]))
                want[s][best] += 1
                filled[best] += s
        assert dict(sp.fill_plan(list(sizes.items()), targets)) == want


def test_splits_keep_groups_and_ratios(spark, family_rows):
    df = corpus(spark, family_rows)
    groups = gr.assign_groups(df, "id", "tokens", "seq")
    splits = sp.make_splits(groups).collect()
    assert len(splits) == len(family_rows)
    by_group = {}
    for r in splits:
        by_group.setdefault(r["group_id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by_group.values())
    share = sum(r["split"] == "train" for r in splits) / len(splits)
    assert 0.6 < share < 0.8 and {r["split"] for r in splits} == {"train", "val", "test"}
    again = sp.make_splits(groups.repartition(7)).collect()
    assert {r["id"]: r["split"] for r in again} == {r["id"]: r["split"] for r in splits}


def test_unknown_method(spark, family_rows):
    with pytest.raises(ValueError):
        sp.split_corpus(corpus(spark, family_rows), "id", "seq", "tokens", method="magic")
    with pytest.raises(ValueError):
        sp.make_splits(spark.createDataFrame([(1, "a")], "id long, group_id string"), (0.5, 0.1, 0.1))


def test_audit_sees_planted_leakage(spark):
    rng = random.Random(6)
    bases = [sequence(rng) for _ in range(4)]
    rows = [(i, bases[i % 4], "train" if i < 20 else "test") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, seq string, split string")
    got = {r["stratum"]: r for r in sp.audit_leakage(df, "id", "seq", n_pairs=100).collect()}
    assert got["cross"]["max"] == pytest.approx(1.0) and got["cross"]["n_pairs"] == 100
    assert got["train"]["mean"] < 0.6


def test_caps_and_shares(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "a").when(F.col("id") < 900, "b").alias("g"))
    capped = sa.cap_per_group(df, "g", 50, "id", F.col("id").isin(1, 2, 3, 750))
    counts = {r["g"]: r["count"] for r in capped.groupBy("g").count().collect()}
    assert counts == {"a": 50, "b": 50, None: 100}
    assert capped.filter("id in (1, 2, 3, 750)").count() == 4
    strata = df.fillna("c")
    sample = sa.proportional_sample(strata, "g", 100, "id")
    assert {r["g"]: r["count"] for r in sample.groupBy("g").count().collect()} == {"a": 70, "b": 20, "c": 10}
    assert sa.proportional_sample(strata, "g", 5000, "id").count() == 1000
    again = sa.proportional_sample(strata.repartition(9), "g", 100, "id")
    assert {r["id"] for r in again.collect()} == {r["id"] for r in sample.collect()}


def test_weights_shift_the_sample(spark):
    df = spark.range(2000).select("id", F.lit("s").alias("g"), (F.col("id") % 2).alias("heavy"))
    got = sa.weighted_stratified_sample(df, "g", F.when(F.col("heavy") == 1, 3.0).otherwise(1.0), 400, "id")
    share = got.agg(F.avg("heavy")).first()[0]
    assert got.count() == 400 and 0.62 < share < 0.85


def test_batches_and_pairs(spark):
    df = spark.range(200).select("id", (F.col("id") % 10).cast("string").alias("y"))
    rows = sa.balanced_batches(df, "y", "id", 12, 4, 3).collect()
    for b in range(12):
        mine = [r for r in rows if r["batch"] == b]
        assert len(mine) == 12 and len({r["y"] for r in mine}) == 4 and len({r["id"] for r in mine}) == 12
    pairs = [(r["a"], r["b"]) for r in sa.random_pairs(df, "id", 300).collect()]
    assert len(set(pairs)) == len(pairs) == 300 and all(a < b for a, b in pairs)
    changed = sa.substituted_pairs(spark.createDataFrame([(i, "ACDEFGHIK") for i in range(50)], "id long, s string"), "id", "s", 20)
    rows = changed.collect()
    assert len(rows) == 20
    assert all(sum(x != y for x, y in zip(r["wild"], r["mutated"])) == 1 for r in rows)


def test_pair_agreement_totals(spark):
    df = spark.range(30).select("id", (F.col("id") % 3).alias("group_id"))
    from strandkit.operators.lookup import pair_agreement

    pairs = sa.random_pairs(df, "id", 50)
    got = mt.sampled_disagreement(pair_agreement(pairs, df, df.withColumn("group_id", F.col("id") % 2))).first()
    assert got["sampled_pairs"] == 50


def test_random_pairs_reach_the_wanted_number(spark):
    for n, wanted in ((10, 40), (50, 1000), (10, 45), (5, 400), (1, 3), (0, 3)):
        pairs = {(r["a"], r["b"]) for r in sa.random_pairs(spark.range(n), "id", wanted).collect()}
        assert len(pairs) == min(wanted, n * (n - 1) // 2)


def test_hashed_numbers_pass_32_bits(spark):
    from strandkit.functions import columns as fc

    rows = spark.range(200).select(
        fc.hash_index(1, F.lit(1 << 59), F.col("id")).alias("i"), fc.hash_fraction(1, F.col("id")).alias("f")
    ).collect()
    assert sum(r["i"] > 1 << 33 for r in rows) > 190 and all(0 < r["f"] < 1 for r in rows)


def test_packed_classes_lose_no_pair(spark, monkeypatch):
    from strandkit.operators import overlap

    monkeypatch.setattr(overlap, "CLASS_ROWS", 60)  # several classes in each band
    monkeypatch.setattr(overlap, "PRODUCTS", 50)
    monkeypatch.setattr(overlap, "COUNTED", 500)  # the order comes from a part of the sets
    rng = random.Random(9)
    rows = []
    for n in (6, 20, 45, 90, 160):
        base = sequence(rng, n)
        # near copies, and prefixes down to half, where the threshold is just met
        rows += [base, mutate(rng, base, 2), base[:n // 2 + 3], base[:n // 2 + 2], base + sequence(rng, n // 3), base]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, seq string")
    first = {}
    for i, s in enumerate(rows):
        first.setdefault(s, i)
    for threshold in (0.2, 0.5):
        want = {
            (min(i, j), max(i, j)): jaccard(a, b, 4)
            for (a, i), (b, j) in combinations(first.items(), 2) if jaccard(a, b, 4) >= threshold
        }
        got = {(r["a"], r["b"]): r["jaccard"] for r in km.jaccard_pairs(df, "id", "seq", 4, threshold).collect()}
        assert got == pytest.approx(want) and len(got) >= 20
    left, right = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    got = {r["a"]: (r["b"], r["jaccard"]) for r in km.best_match(left, right, "id", "seq", 4, 0.2).collect()}
    want = {}
    for i, a in enumerate(rows):
        if i % 2 == 0:
            j, b = min(((-jaccard(a, b, 4), j) for j, b in enumerate(rows) if j % 2), default=(0, None))
            if -j >= 0.2:
                want[i] = (b, pytest.approx(-j))
    assert got == want and len(got) >= 10


def test_few_left_rows_meet_without_pairs(spark, monkeypatch):
    rng = random.Random(8)
    seeds = [sequence(rng, 60) for _ in range(12)]
    left = [(f"q{i}", mutate(rng, s, i % 7)) for i, s in enumerate(seeds)] + [("copy", seeds[0]), ("short", "AC"), ("none", None)]
    right = [(f"r{i}", mutate(rng, s, j)) for i, s in enumerate(seeds) for j in (0, 3, 9)] + [("twin", seeds[0]), ("r0", "AC"), ("null", None)]
    frames = [spark.createDataFrame(rows, "id string, seq string") for rows in (left, right)]
    matches = lambda: {tuple(r) for r in km.best_match(*frames, "id", "seq", 4, 0.3).collect()}
    with monkeypatch.context() as patch:
        patch.setattr(km, "FEW_SYMBOLS", -1)
        by_pairs = matches()
    monkeypatch.setattr(km, "similar_sequences", None)  # no join of pairs
    assert matches() == by_pairs and {"q0", "copy"} <= {r[0] for r in by_pairs}


def test_token_groups_keep_long_tokens_in_their_rows(spark, monkeypatch):
    written = []
    keep = gr.reliable_checkpoint
    monkeypatch.setattr(gr, "reliable_checkpoint", lambda df: written.append(keep(df)) or written[-1])
    long = ["z" * 500 + str(i) for i in range(6)]
    rows = [(0, ["a", long[0]]), (1, ["b", long[0], long[1]]), (2, [long[1], "c"]), (3, ["d", long[2]]), (4, ["d"]), (5, [long[3], "e"]), (6, [None, "e"]), (7, [])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    got = {r["id"]: r["group_id"] for r in gr.token_groups(df, "id", "tokens").collect()}
    assert got == {0: "a", 1: "a", 2: "a", 3: "d", 4: "d", 5: "e", 6: "e"}
    texts = [r[0] for table in written for name, kind in table.dtypes if kind == "string" for r in table.select(name).collect()]
    assert max(map(len, texts)) < 500


def test_splits_read_the_groups_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def name(i):
        seen.add(1)
        return f"g{i % 7}"

    splits = sp.make_splits(spark.range(60).select("id", name("id").alias("group_id")))
    assert splits.count() == 60 and splits.select("group_id", "split").distinct().count() == 7
    assert seen.value == 60


def test_window_counts_match_plain_counting():
    rng = random.Random(4)
    for k, symbols in ((1, "AC"), (3, AA + "xé\U0001F600"), (16, "".join(map(chr, range(200, 500)))), (30, "AC")):
        for n in (0, k - 1, k, 400):
            text = "".join(rng.choice(symbols) for _ in range(n)) * 2
            for alphabet in (None, AA):
                want = {}
                for i in range(len(text) - k + 1):
                    w = text[i:i + k]
                    if alphabet is None or set(w) <= set(alphabet):
                        want[w] = want.get(w, 0) + 1
                assert km.window_counts(text, k, alphabet) == want


def test_frequencies_count_one_id_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(km, "COUNT_ROWS", 2)
    rows = [("a", "ACDACD"), ("b", "AXC"), ("a", "ACD"), ("c", None), ("d", "AC"), ("e", "ACDX")]
    out = km.kmer_frequencies(spark.createDataFrame(rows, "id string, seq string"), "id", "seq", 3)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["id"], r["kmer"]): (r["n"], round(r["freq"], 6)) for r in out.collect()}
    assert got == {("a", "ACD"): (3, 0.6), ("a", "CDA"): (1, 0.2), ("a", "DAC"): (1, 0.2), ("e", "ACD"): (1, 1.0)}
