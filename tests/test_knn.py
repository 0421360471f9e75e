import numpy as np
import pytest
from pyspark.sql import functions as F

from strandkit.functions import vectors as fv
from strandkit.operators import ann, cluster, knn as kn, metrics as mt


def frame(spark, matrix, labels=None):
    rows = [(i, [float(x) for x in row], None if labels is None else labels[i]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "id long, vector array<double>, label string")


def brute(matrix, queries, k, skip_self=True):
    matrix = matrix.astype(np.float32).astype(np.float64)  # stored precision
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    out = {}
    for q in queries:
        sims = np.round(unit @ unit[q], 10)
        order = sorted((i for i in range(len(matrix)) if not (skip_self and i == q)), key=lambda i: (-sims[i], i))
        out[q] = order[:k]
    return out


def as_lists(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(7)
    m = rng.normal(size=(150, 24)).astype(np.float32)
    m[1] = m[0] + rng.normal(size=24) * 0.01
    m[40] = m[10]  # an exact copy
    m[99] = 0.0  # a zero vector
    return m


@pytest.mark.parametrize("strategy", ["grid", "broadcast"])
def test_all_pairs_match_brute_force(spark, planted, strategy):
    df = frame(spark, planted)
    hits = kn.knn(df, df, 5, strategy=strategy, block_rows=32)
    assert as_lists(hits) == brute(planted, range(150), 5)
    assert as_lists(hits)[0][0] == 1


def test_broadcast_and_unknown_ids(spark, planted):
    df = frame(spark, planted)
    wanted = df.filter("id in (0, 10, 99)").select("id")
    assert as_lists(kn.neighbours_of(wanted, df, 4, strategy="broadcast")) == brute(planted, [0, 10, 99], 4)
    with pytest.raises(KeyError):
        kn.neighbours_of(spark.createDataFrame([(777,)], "id long"), df, 3)


@pytest.mark.parametrize("tasks", [1, 7, 40])
def test_super_blocks_and_lanes(spark, planted, tasks):
    df = frame(spark, planted)
    assert as_lists(kn.knn(df, df, 5, strategy="grid", block_rows=16, tasks=tasks)) == brute(planted, range(150), 5)
    some = df.filter("id % 3 = 0")
    assert as_lists(kn.knn(some, df, 5, strategy="grid", block_rows=16, tasks=tasks)) == brute(planted, range(0, 150, 3), 5)


def test_each_side_is_read_once(spark, planted):
    """A grid of many tasks evaluates its inputs once; a table searched among itself is one input."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = frame(spark, planted).select("id", "vector").mapInArrow(counted, "id long, vector array<double>")
    kn.knn(df, df, 5, strategy="grid", block_rows=16, tasks=20).count()
    assert reads.value == 150
    kn.knn(df.filter("id < 30"), df, 5, strategy="grid", block_rows=16, tasks=20).count()
    assert reads.value == 3 * 150


def test_grid_shape():
    for n_q, n_c, tasks in ((10, 10, 1), (60_000, 60_000, 64), (10**6, 10**8, 1000), (10**8, 10**6, 1000), (5, 10**9, 500)):
        supers, lanes = kn.grid_shape(n_q, n_c, 64, tasks)
        assert supers * lanes >= tasks and supers * lanes * kn.TASK_PAIRS >= n_q * n_c / 2
        assert n_q * 64 * 8 / supers <= kn.SUPER_BYTES
    # 60,000 rows among themselves in 64 tasks: 8 x 8, so each side is sent 8 times: 2 x 8 x 60,000 x 264 bytes = 253 MB
    assert kn.grid_shape(60_000, 60_000, 64, 64) == (8, 8)


def test_partitioning_and_scale_do_not_matter(spark, planted):
    df = frame(spark, planted)
    base = as_lists(kn.knn(df, df, 3, strategy="grid"))
    scaled = df.withColumn("vector", F.transform("vector", lambda x: x * 4)).repartition(7)
    assert as_lists(kn.knn(scaled, scaled, 3, strategy="grid")) == base


def test_string_ids(spark, planted):
    df = frame(spark, planted[:40]).withColumn("id", F.format_string("s%03d", "id"))
    got = as_lists(kn.knn(df, df, 3))
    want = {f"s{q:03d}": [f"s{i:03d}" for i in v] for q, v in brute(planted[:40], range(40), 3).items()}
    assert got == want


def test_all_rows_in_one_cell(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(1, 8)) + rng.normal(size=(200, 8)) * 1e-3
    df = frame(spark, m)
    got = as_lists(ann.cell_knn(df, df, 4, n_cells=4, nprobe=4, block_rows=16))
    assert got == brute(m, range(200), 4)


def test_approximate_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 16)) * 3
    m = np.vstack([c + rng.normal(size=(30, 16)) * 0.3 for c in centres])
    df = frame(spark, m)
    exact = kn.knn(df, df, 5)
    for found in (
        ann.cell_knn(df, df, 5, n_cells=12, nprobe=4),
        ann.quantized_knn(df, df, 5),
        ann.signature_knn(df, df, 5, bits=3),
    ):
        assert mt.recall_at_k(exact, found, 5).first()["recall_at_5"] >= 0.7


def test_thin_buckets_still_give_k_hits(spark):
    rng = np.random.default_rng(6)
    df = frame(spark, rng.normal(size=(200, 16)))
    hits = ann.signature_knn(df, df, 5, bits=12).groupBy("query_id").count().collect()
    assert len(hits) == 200 and {r["count"] for r in hits} == {5}


def test_buckets_come_in_order_of_margins():
    margins = np.array([0.5, -0.1, 0.3, 0.2])
    found = list(ann.probe_order(margins))
    assert sorted(f for _, f in found) == list(range(16)) and [c for c, _ in found] == sorted(c for c, _ in found)
    assert all(abs(c - sum(m * m for b, m in enumerate(margins) if f >> b & 1)) < 1e-12 for c, f in found)
    d = ann.planes(24, 10, 1)
    assert np.allclose(d.T @ d, np.eye(10))


def test_full_reach_is_exact(spark, planted):
    df = frame(spark, planted)
    index = ann.build_signatures(df, bits=5, block_rows=16)
    assert as_lists(ann.search_signatures(index, df, 5, reach=1.0).hits) == brute(planted, range(150), 5)


def test_cells_are_stored_and_extended(spark, planted):
    df = frame(spark, planted)
    index = ann.build_cells(df.filter("id < 100"), n_cells=8, block_rows=16)
    # vectors far from all others open cells that had no rows
    ann.add_to_cells(index, df.filter("id >= 100"))
    stored = [i for r in index.read("vectors").collect() for i in r["ids"]]
    assert sorted(stored) == list(range(150))
    again = ann.Cells(spark, index.path)  # a search needs the folder only
    assert as_lists(ann.search_cells(again, df, 5, nprobe=8)) == brute(planted, range(150), 5)


def test_search_scans_the_shelves_it_needs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 4
    df = frame(spark, np.vstack([c + rng.normal(size=(25, 16)) * 0.1 for c in centres]))
    monkeypatch.setattr(ann, "SHELF_ROWS", 50)
    index = ann.build_cells(df, n_cells=40)
    n_shelves = index.read("vectors").select("shelf").distinct().count()
    one = df.filter("id = 3")
    visits = ann._cell_visits(index, ann._base(one, "id", "vector"), 2, "bigint")
    blocks = ann._shelves(index, index.read("vectors"), visits, True)
    scans = [line for line in blocks._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in line]
    assert n_shelves >= 10 and scans and all("shelf#" in line for line in scans)
    assert blocks.select(F.input_file_name()).distinct().count() <= 4
    assert ann.search_cells(index, one, 5, nprobe=2).count() == 5


def test_codes_scan_builds_no_vectors(spark, planted, monkeypatch):
    rng = np.random.default_rng(2)
    units = kn.unit_rows(rng.normal(size=300 * 64), 300)
    books = np.stack([units[:32, s * 4:(s + 1) * 4] for s in range(16)])
    codes = ann.encode(units, books)
    assert codes.dtype == np.uint8 and codes.shape == (300, 16) and codes.max() < 32
    decoded = books[np.arange(16)[None, :], codes].reshape(300, 64)
    got = ann.table_scores(units[:7], books, codes, np.zeros(7))
    assert np.allclose(got, units[:7] @ decoded.T)
    # what a scan holds per stored vector are its m bytes; the tables of a query have m x 256 numbers
    df = frame(spark, planted)
    index = ann.build_cells(df, n_cells=4)
    ann.build_codes(index, m=6)
    assert index.read("codes").columns == ["cell", "sub", "n", "ids", "codes", "shelf"]
    assert index.read("codes").agg(F.sum(F.length("codes"))).first()[0] == 150 * 6
    scan = ann._code_hits(index, df.select("id", F.col("vector").cast("array<float>").alias("vec")), 4, 10, True)
    assert "flat" not in scan._jdf.queryExecution().optimizedPlan().toString().replace("q_flat", "")
    hits = ann.search_codes(index, df, 5, nprobe=4, rerank=30)
    assert as_lists(hits) == brute(planted, range(150), 5)


def test_backend_choice(spark, planted):
    df = frame(spark, planted)
    assert as_lists(ann.neighbours(df, df, 3)) == brute(planted, range(150), 3)
    with pytest.raises(ValueError):
        ann.neighbours(df, df, 3, backend="graph")
    assert kn.auto_backend(49_999) == "exact" and kn.auto_backend(50_000) == "approximate"


def test_auto_is_exact_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(kn, "APPROXIMATE_FROM", 50)
    monkeypatch.setattr(ann, "build_cells", lambda *args, **kwargs: pytest.fail("an index was built"))
    rng = np.random.default_rng(11)
    # close groups, of which an index leaves most out
    m = np.repeat(rng.normal(size=(40, 16)), 10, axis=0) + 0.05 * rng.normal(size=(400, 16))
    df = frame(spark, m)
    assert as_lists(ann.neighbours(df, df, 15)) == brute(m, range(400), 15)


def test_unlabelled_copies_are_misses(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(4, 16) * 6
    m = np.vstack([c + rng.normal(size=(10, 16)) * 0.2 for c in centres])
    labels = [str(i // 10) for i in range(40)]
    clean = frame(spark, m, labels)
    rows = clean.select("id", "label")
    good = mt.precision_at_k(kn.knn(clean, clean, 5), rows, [1, 5]).first()
    assert good["precision_at_1"] == 1.0
    thieves = frame(spark, np.vstack([m, m + 1e-4]), labels + [None] * 40)
    rows = thieves.select("id", "label")
    queries = thieves.join(mt.eligible_queries(rows, "label").select("id"), "id", "left_semi")
    bad = mt.precision_at_k(kn.knn(queries, thieves, 5), rows, [1]).first()
    assert bad["n_evaluated"] == 40 and bad["precision_at_1"] < 0.2


def test_zero_vector_and_norms(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    got = df.select(fv.cosine(F.col("a"), F.col("b")).alias("c"), fv.norm(F.col("a")).alias("n"), fv.unit(F.col("a")).alias("u")).collect()
    assert [r["c"] for r in got] == [0.0, pytest.approx(1.0)]
    assert got[1]["u"] == [0.6, 0.8] and got[0]["u"] == [0.0, 0.0]


def test_outliers_are_ordinal(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.1), (3, 0.5), (4, 0.9)], "id long, knn_dist double")
    got = {r["id"]: r["outlier"] for r in cluster.outlier_scores(df).collect()}
    assert got == {2: 0.0, 1: pytest.approx(1 / 3), 3: pytest.approx(2 / 3), 4: 1.0}


def test_density_islands_find_tight_groups(spark):
    rng = np.random.default_rng(9)
    tight = np.vstack([c + rng.normal(size=(20, 10)) * 0.01 for c in np.eye(3, 10) * 5])
    noise = rng.normal(size=(20, 10))
    df = frame(spark, np.vstack([tight, noise]))
    got = {r["id"]: r["island"] for r in cluster.density_islands(df, "id", "vector", 15, 4, radius=0.01).collect()}
    assert len(got) == 80
    assert [len({got[i] for i in range(g * 20, g * 20 + 20)}) for g in range(3)] == [1, 1, 1]
    assert len({got[i] for i in range(60)}) == 3 and all(got[i] == -1 for i in range(60, 80))


def test_pca_and_kmeans(spark):
    rng = np.random.default_rng(9)
    m = np.vstack([c + rng.normal(size=(20, 6)) * 0.05 for c in np.eye(3, 6) * 5])
    df = frame(spark, m)
    scores, info = cluster.pca_projection(df, "id", "vector", 50)
    assert info["pca_dim"] == 6 and info["pca_explained_variance"] == pytest.approx(1.0)
    centred = m - m.mean(axis=0)
    want = np.sort((np.linalg.svd(centred, compute_uv=False) ** 2))[::-1]
    got = np.array([r["vector"] for r in scores.orderBy("id").collect()])
    assert np.allclose((got ** 2).sum(axis=0), want, atol=1e-6)
    placed, figures = cluster.kmeans_clusters(df, "id", "vector", 3, n_init=4)
    by = {r["id"]: r["cluster"] for r in placed.collect()}
    assert [len({by[i] for i in range(g * 20, g * 20 + 20)}) for g in range(3)] == [1, 1, 1]
    assert figures["silhouette_cosine"] > 0.9


@pytest.mark.parametrize("store", ["sf0.001", "sf0.1", "clustered"])
def test_recall_at_defaults(spark, store):
    from strandkit.plans.study import clustered_vectors
    from strandkit.session import reliable_checkpoint

    if store == "clustered":
        df = reliable_checkpoint(clustered_vectors(spark, 6000))
    else:
        df = spark.read.parquet(f"/root/testdata/{store}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    exact = reliable_checkpoint(kn.knn(df, df, 10))
    recalls = {f.__name__: float(mt.recall_at_k(exact, f(df, df, 10), 10).first()["recall_at_10"]) for f in (ann.cell_knn, ann.signature_knn)}
    assert min(recalls.values()) >= 0.9


def test_centres_of_a_large_sample_are_drawn_in_tasks(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("rows of the sample came to the driver")

    rng = np.random.default_rng(3)
    middles = kn.unit_rows(rng.normal(size=(12 * 16,)), 12)
    points = np.repeat(middles, 40, axis=0) + rng.normal(size=(480, 16)) * 0.01
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, vec array<float>").repartition(5)
    monkeypatch.setattr(ann, "DRIVER_BYTES", 0)
    monkeypatch.setattr(ann, "_seeds", refuse)
    centres = ann.train_centres(df, 24, 1)
    assert centres.shape == (24, 16)
    # every cluster has a centre of its own
    assert ((middles @ centres.T).max(axis=1) > 0.99).all()
    # fewer rows than cells
    assert ann.train_centres(df.filter("id < 3"), 8, 1).shape == (3, 16)


def test_products_with_centres_are_taken_in_slices(monkeypatch):
    rng = np.random.default_rng(4)
    units, centres = kn.unit_rows(rng.normal(size=(50 * 8,)), 50), kn.unit_rows(rng.normal(size=(20 * 8,)), 20)
    cell = rng.integers(20, size=50)
    whole = ann._nearest(units, centres), ann._cell_places(units, cell, centres), ann._far(units, centres)
    monkeypatch.setattr(ann, "SLICE_PAIRS", 64)
    for a, b in zip(whole, (ann._nearest(units, centres), ann._cell_places(units, cell, centres), ann._far(units, centres))):
        assert np.allclose(a, b)
    assert (np.sort(ann._nearest_cells(units, centres, 20)[1].reshape(50, 20), axis=1) == np.arange(20)).all()
