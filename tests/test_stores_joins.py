import hashlib
import os
import random
import tracemalloc
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandkit.functions import columns as fc
from strandkit.operators import containment as ct
from strandkit.operators import embed as em
from strandkit.operators import groups as gr
from strandkit.operators import metrics as mt
from strandkit.operators import sampling as sa
from strandkit.operators.align import Aligner
from strandkit.plans import corpus as pc
from strandkit.session import drop_table, reliable_checkpoint
from strandkit.sources import files
from strandkit.sources import tables as tb
from strandkit.sources.keyed import KeyedStore
from strandkit.streaming import appends as ap


def letters(rng, n, alphabet="ACDEFGHIKL"):
    return "".join(rng.choices(alphabet, k=n))


# -- alignment

def plain_alignment(tool, a, b):
    """(score, matches, length) by a table of tuples."""
    low = (-10**9, 0, 0)

    @lru_cache(None)
    def cell(i, j, s):
        if i == 0 and j == 0:
            return (0, 0, 0) if s == 0 else low
        if s == 0:
            if i == 0 or j == 0:
                return low
            x, y = a[i - 1], b[j - 1]
            p = max(cell(i - 1, j - 1, t) for t in range(3))
            return (p[0] + tool.scores.get((x, y), tool.match if x == y else tool.mismatch), p[1] + (x == y), p[2] - 1)
        if (i if s == 1 else j) == 0:
            return low
        came = [cell(i - 1, j, t) if s == 1 else cell(i, j - 1, t) for t in range(3)]
        return max((p[0] + (tool.gap_extend if t == s else tool.gap_open), p[1], p[2] - 1) for t, p in enumerate(came))

    best = max(cell(len(a), len(b), t) for t in range(3))
    return best[0], best[1], -best[2]


@pytest.mark.parametrize("tool", [Aligner(), Aligner({}, -3, -1, 2, -1)])
def test_alignments_equal_the_plain_table(tool):
    rng = random.Random(1)
    pairs = [(letters(rng, rng.randint(1, 14), "ACDWzé"), letters(rng, rng.randint(1, 14), "ACDWzé")) for _ in range(300)]
    want = [plain_alignment(tool, *p) for p in pairs]
    assert tool.align(pairs) == want
    assert tool.identities(pairs) == pytest.approx([m / n for _, m, n in want])
    assert tool.identities([("", "AC"), ("AC", "AC")]) == [0.0, 1.0]


def test_long_texts_need_rows_only():
    rng = random.Random(2)
    a = letters(rng, 100_000)
    tracemalloc.start()
    got = Aligner().align([(a, a[:50] + a[60:100])])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0][1] == 90 and got[0][2] == 100_000 and peak < 200e6


# -- containment

def test_codes_and_minimizers():
    text = "a naïve text: 日本語 and a naïve text"
    codes = ct.window_codes(text, 4)
    assert len(codes) == len(text) - 3 and len(set(codes)) < len(codes)
    number = 0
    for c in text[:4]:
        number = (number * ct.BASE + ord(c)) % ct.MODULUS
    assert codes[0] == number * ct.MULTIPLIER % ct.MODULUS
    want = {min(codes[i:i + 5]) for i in range(len(codes) - 4)}
    assert set(ct.minimizers(text, 4, 5)) == want
    assert list(ct.minimizers("abcd", 4, 5)) == [ct.window_codes("abcd", 4)[0]] and len(ct.minimizers("abc", 4, 5)) == 0


@pytest.mark.parametrize("salt_rows", [3, 10_000])
def test_containment_equals_brute_force(spark, monkeypatch, salt_rows):
    monkeypatch.setattr(ct, "SALT_ROWS", salt_rows)
    rng = random.Random(3)
    bases = [letters(rng, 120) for _ in range(6)]
    rows = [(i, rng.choice(bases)[rng.randint(0, 20):][:rng.randint(60, 120)]) for i in range(60)] + [(100, None), (101, "AC"), (102, "AC")]
    rows += [(200 + i, bases[0]) for i in range(20)]  # copies are one sequence
    k, threshold, coverage = 5, 0.5, 0.7
    pairs, members = ct.containment_pairs(spark.createDataFrame(rows, "id long, seq string"), "id", "seq", k, threshold, coverage)
    got = {(r["a"], r["b"]): (r["containment"], r["coverage"]) for r in pairs.collect()}
    texts = {}
    for i, t in rows:
        if t is not None:
            texts.setdefault(t, i)
    want = {}
    for x, a in texts.items():
        for y, b in texts.items():
            if (len(x), a) < (len(y), b) and len(x) >= len(y) * coverage:
                mine, other = set(ct.minimizers(x, k)), set(ct.minimizers(y, k))
                if mine & other and len(mine & other) >= len(mine) * threshold / 2:
                    c, v = ct.measure(x, y, k)
                    if c >= threshold and v >= coverage:
                        want[a, b] = (c, v)
    assert got == want and len(want) > 20
    keys = {r["id"]: r["key"] for r in members.collect()}
    assert len({keys[i] for i in range(200, 220)}) == 1 and 100 not in keys and keys[101] == keys[102]


def test_groups_by_containment(spark):
    rng = random.Random(4)
    base = letters(rng, 100)
    rows = [(5, base), (6, base[4:]), (7, base), (8, letters(rng, 100)), (9, None), (10, "AC"), (11, base[:40])]
    got = {r["id"]: r["group_id"] for r in gr.identity_groups(spark.createDataFrame(rows, "id long, seq string"), "id", "seq").collect()}
    assert got == {5: 5, 6: 5, 7: 5, 8: 8, 9: 9, 10: 10, 11: 11}


def test_components_leave_no_old_rounds(spark, tmp_path):
    from pathlib import Path

    folder = Path(spark.sparkContext.getCheckpointDir().split(":", 1)[-1]) if spark.sparkContext.getCheckpointDir() else None
    before = set(os.listdir(folder)) if folder else set()
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in gr.connected_components(edges).collect()} == {0}
    folder = Path(spark.sparkContext.getCheckpointDir().split(":", 1)[-1])
    assert len({f for f in set(os.listdir(folder)) - before if f.startswith("table-")}) == 1


def test_dropped_tables_are_gone(spark):
    df = reliable_checkpoint(spark.range(10))
    paths = [f.split(":", 1)[-1].replace("//", "/") for f in df.inputFiles()]
    assert all(os.path.exists(p) for p in paths)
    drop_table(df)
    assert not any(os.path.exists(p) for p in paths)


# -- draws

def test_permutations_of_any_size(spark):
    for n in (1, 2, 7, 64, 101):
        rows = spark.range(n).select(*[fc.permuted(5, F.lit(n), F.col("id"), F.lit(key)).alias(key) for key in ("x", "y")])
        found = rows.collect()
        assert sorted(r["x"] for r in found) == list(range(n)) == sorted(r["y"] for r in found)
        if n > 60:
            assert [r["x"] for r in found] != [r["y"] for r in found]


def test_batches_draw_different_classes(spark):
    df = spark.range(300).select("id", (F.col("id") % 12).cast("string").alias("y"))
    rows = sa.balanced_batches(df, "y", "id", 60, classes=3, per_class=4).collect()
    sets, members = {}, {}
    for r in rows:
        sets.setdefault(r["batch"], set()).add(r["y"])
        members.setdefault((r["batch"], r["y"]), set()).add(r["id"])
    assert all(len(s) == 3 for s in sets.values()) and len({frozenset(s) for s in sets.values()}) > 40
    assert all(len(m) == 4 for m in members.values())
    assert sa.balanced_batches(df.limit(0), "y", "id", 5).count() == 0


# -- files

def test_digests_in_ranges(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.gz").write_bytes(b"not really packed" * 1000)
    (tmp_path / "in" / "empty").write_bytes(b"")
    (tmp_path / "in" / "_hidden").write_bytes(b"x")
    got = {r["file"].replace("%20", " "): (r["bytes"], r["sha256"]) for r in files.file_digests(spark, str(tmp_path / "in")).collect()}
    want = {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in (("a b.gz", b"not really packed" * 1000), ("empty", b""))}
    assert got == want
    assert files.digest(f"file://{tmp_path}/in/a%20b.gz", 7) == want["a b.gz"][1]
    assert files.file_digests(spark, str(tmp_path / "none")).count() == 0


# -- keyed stores

def test_keyed_store_reads_few_files(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), n_buckets=16)
    rows = lambda a, b: spark.range(a, b).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("v"))
    assert store.unseen(rows(0, 5)).count() == 5 and store.read() is None
    store.append(rows(0, 200))
    store.append(rows(200, 400))
    store.append(rows(0, 0))
    assert store.read().count() == 400
    # two stored keys and fifty new ones: no more buckets are read than those of the stored, and of few false hits
    batch = rows(398, 450)
    assert store.may_have(batch).count() <= 2 + 3
    assert {r["v"] for r in store.unseen(batch).collect()} == set(range(400, 450))
    files_read = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files_read(store._near(batch)) <= 10 and files_read(store.read()) == 32
    assert {r["v"] for r in store.matching(batch).collect()} == {398, 399}
    # new keys only: at most a false hit is read
    fresh = store._near(rows(1000, 1010))
    assert fresh is None or files_read(fresh) <= 4
    store.compact_filters()
    assert store.spark.read.parquet(f"{store.path}/filters").count() == 16
    assert {r["v"] for r in store.unseen(batch).collect()} == set(range(400, 450))


def test_cache_hits_come_from_the_keyed_store(spark, tmp_path):
    cache = KeyedStore(spark, str(tmp_path / "cache"))
    df = spark.createDataFrame([(1, "ACDEFGHIKLMN"), (2, "ACDEFGHIKLMN"), (3, "WWWWWWWWWWWW")], "id long, sequence string")
    first, fresh = em.embed_with_cache(df, cache, em.HashingEncoder(8))
    assert {r["cache_hit"] for r in first.collect()} == {False} and fresh.count() == 2
    cache.append(fresh.withColumn("written", F.lit(0).cast("long")))
    again, rest = em.embed_with_cache(df, cache, em.HashingEncoder(8))
    assert {r["cache_hit"] for r in again.collect()} == {True} and again.count() == 3 and rest.count() == 0


def entries(spark, rows):
    from strandkit import constants as C

    named = [{c: None for c in C.ENTRY_COLUMNS.values()} | {"accession": a, "protein_name": "x", "sequence": s, "length": str(len(s))} for a, s in rows]
    return spark.createDataFrame(named, ", ".join(f"{c} string" for c in C.ENTRY_COLUMNS.values()))


def test_equal_sequences_of_different_batches(spark, tmp_path):
    rng = random.Random(6)
    one, two = letters(rng, 60), letters(rng, 60)
    source, corpus, store = tmp_path / "in", str(tmp_path / "corpus"), str(tmp_path / "store")
    schema = entries(spark, []).schema
    options = pc.BuildOptions(lengths=(10, 100))
    for i, rows in enumerate(([("P00001", one)], [("P00002", one), ("P00003", two)], [("P00003", one + "A"), ("P00004", two)])):
        entries(spark, rows).coalesce(1).write.mode("append").json(str(source / str(i)))
        stream = spark.readStream.schema(schema).json(str(source / "*"))
        ap.append_stream(stream, corpus, store, em.HashingEncoder(8), str(tmp_path / "cp"), ("mean",), options).trigger(availableNow=True).start().awaitTermination()
    assert {(r["accession"], r["sequence"]) for r in spark.read.parquet(corpus).collect()} == {("P00001", one), ("P00003", two)}
    assert sorted(r["id"] for r in spark.read.parquet(f"{store}/vectors").collect()) == ["P00001", "P00003"]


def test_a_batch_that_did_not_end_is_completed(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    rows = [(f"P0000{i}", letters(rng, 60)) for i in range(1, 6)]
    source, corpus, store = str(tmp_path / "in"), str(tmp_path / "corpus"), str(tmp_path / "store")
    entries(spark, rows).write.json(source)
    options = pc.BuildOptions(lengths=(10, 100))

    def run():
        stream = spark.readStream.schema(entries(spark, []).schema).json(source)
        ap.append_stream(stream, corpus, store, em.HashingEncoder(8), str(tmp_path / "cp"), ("mean",), options).trigger(availableNow=True).start().awaitTermination()

    append = KeyedStore.append

    def broken(self, some):
        if self.key == "digest":
            raise RuntimeError("lost")
        append(self, some)

    monkeypatch.setattr(KeyedStore, "append", broken)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(KeyedStore, "append", append)
    run()
    assert sorted(r["accession"] for r in spark.read.parquet(corpus).collect()) == [a for a, _ in rows]
    assert sorted(r["id"] for r in spark.read.parquet(f"{store}/vectors").collect()) == [a for a, _ in rows]


# -- projections and losses

def test_a_truncated_version_is_computed_again(spark, tmp_path):
    df = spark.range(30).select("id", F.col("id").cast("double").alias("x"))
    path, calls = str(tmp_path / "p"), []

    def compute(points):
        calls.append(1)
        return points.select("id", (F.col("x") * 2).alias("y"))

    assert tb.load_or_project(df, path, {"a": 1}, compute)[1] is False
    assert tb.load_or_project(df, path, {"a": 1}, compute)[1] is True
    version = next(f for f in os.listdir(path) if f.startswith("version="))
    spark.range(3).select("id", F.lit(0.0).alias("y")).write.mode("overwrite").parquet(f"{path}/{version}")
    again, hit = tb.load_or_project(df, path, {"a": 1}, compute)
    assert hit is False and again.count() == 30 and len(calls) == 2


def test_loss_by_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 6))
    y = [None if i % 11 == 0 else str(i % 4) for i in range(90)]
    df = spark.createDataFrame([(i, i // 45, y[i], v[i].tolist()) for i in range(90)], "id long, batch long, label string, vector array<double>")
    got = {r["batch"]: r["loss"] for r in mt.contrastive_loss(df, "batch", "id", "label", "vector", block_rows=10).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for b in (0, 1):
        rows = range(45 * b, 45 * b + 45)
        losses = []
        for i in rows:
            others = [j for j in rows if j != i]
            s = {j: u[i] @ u[j] / 0.1 for j in others}
            mates = [j for j in others if y[i] is not None and y[j] == y[i]]
            if mates:
                losses.append(np.log(sum(np.exp(x) for x in s.values())) - np.mean([s[j] for j in mates]))
        assert got[b] == pytest.approx(np.mean(losses))


def test_containment_over_several_classes(spark, monkeypatch):
    from strandkit.operators import overlap

    monkeypatch.setattr(overlap, "CLASS_ROWS", 15)
    test_containment_equals_brute_force(spark, monkeypatch, 10_000)
