"""Pairs of sets: memory of a task, sizes of classes, and pairs of texts."""

import random
import tracemalloc

import numpy as np

from strandkit.operators import kmers as km
from strandkit.operators import overlap as ov

HALF = lambda sizes: (np.searchsorted(sizes, sizes * 0.5 - 1e-9), np.searchsorted(sizes, sizes / 0.5 + 1e-6, side="right"))


def test_a_class_takes_little_memory_per_element(monkeypatch):
    monkeypatch.setattr(ov, "PRODUCTS", 1 << 14)
    rng, size, sets = np.random.default_rng(2), 400, 1500
    codes = rng.integers(0, 1 << 20, size=size * sets).astype("<u4")
    codes[:size] = codes[size:2 * size]
    heads = np.zeros(sets, dtype=ov.SET)
    heads["key"], heads["size"], heads["n"], heads["lead"], heads["left"], heads["right"] = np.arange(sets), size, size, size, True, True
    need = lambda a, b: (a["size"].astype(float) + b["size"]) / 3
    tracemalloc.start()
    found = list(ov.met_pairs(heads, codes, HALF, need, True, 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(a.tolist(), b.tolist()) for a, b, *_ in found] == [([0], [1])]
    assert peak < 55 * len(codes)


def test_what_is_looked_up_in_a_band_counts_for_its_classes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ov, "CLASS_ROWS", 1000)
    monkeypatch.setattr(ov, "LEAST_ROWS", 1000)
    sets = spark.createDataFrame([(i, 40 if i < 10 else 70, 40 if i < 10 else 70) for i in range(500)], "key long, size int, mass int")
    classes_of_bands = ov.classes_of_bands
    monkeypatch.setattr(ov, "classes_of_bands", lambda *args: seen.append(classes_of_bands(*args)) or seen[-1])
    ov.candidates(sets, lambda batch: (), 2.0, HALF, lambda a, b: a["size"], True)
    # 10 sets of 40 elements, but 490 of 70 are looked up among them
    assert seen[0][1][2] >= 490 * 70 // 1000


def test_jaccard_pairs_equal_those_of_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc") for _ in range(rng.randrange(4, 80))) for _ in range(40)]
    texts = base + [x[:len(x) - rng.randrange(len(x) // 2)] + "abcabc"[:rng.randrange(6)] for x in base]
    texts = sorted(set(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
    grams = [{t[i:i + 3] for i in range(len(t) - 2)} for t in texts]
    for threshold in (0.3, 0.5, 0.8):
        want = {
            (i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))
            if grams[i] and grams[j] and len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= threshold - 1e-12
        }
        assert {(r["a"], r["b"]) for r in km.jaccard_pairs(df, "id", "seq", 3, threshold).collect()} == want
        half = [df.filter("id % 2 = 0"), df.filter("id % 2 = 1")]
        best = {r["a"]: r["jaccard"] for r in km.best_match(*half, "id", "seq", 3, threshold).collect()}
        near, members = km.similar_sequences(*half, 3, threshold)
        ids = {r["key"]: r["id"] for r in members.collect()}
        met = {(ids[r["ka"]], ids[r["kb"]]) for r in near.collect()}
        assert met == {tuple(sorted(p, key=lambda i: i % 2)) for p in want if (p[0] + p[1]) % 2}
        assert set(best) == {a for a, _ in met}
