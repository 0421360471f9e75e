"""Similarity search and vector metrics over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, table
from strandkit.functions import vectors as fv
from strandkit.operators import knn as kn
from strandkit.operators import metrics as mt
from strandkit.operators import ann
from strandkit.operators.ann import cell_knn, quantized_knn, signature_knn
from strandkit.operators.cluster import outlier_scores
from strandkit.operators.lookup import hit_summaries, with_similarity
from strandkit.operators.pooling import region_pool
from strandkit.operators.ranking import number_in_order
from strandkit.operators.sampling import stratified_holdout

E_SQL = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
SIM = "round(list_cosine_similarity(a.v, b.v), 10)"


def hits_sql(k: int, where: str = "a.id <> b.id", a: str = "e", b: str = "e") -> str:
    return (
        f"h AS (SELECT a.id AS query_id, b.id AS id, {SIM} AS s, "
        f"row_number() OVER (PARTITION BY a.id ORDER BY {SIM} DESC, b.id) AS rank "
        f"FROM {a} a, {b} b WHERE {where} QUALIFY rank <= {k})"
    )


def store(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def residues(e):
    """The vectors of a label, in id order, as the residue rows of one sequence."""
    numbered = number_in_order(e.select("label", "id", "vector"), ["label"], ["id"], "pos")
    return numbered.select(F.col("label").cast("long").alias("id"), F.col("pos").cast("int").alias("pos"), "vector")


@query("vec_unit_and_norm", """
SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm,
       round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS unit_sum,
       len(embedding)::INTEGER AS dim
FROM embeddings""")
def vec_unit_and_norm(spark, sf):
    v = F.col("vector")
    return store(spark, sf).select(
        "id", F.round(fv.norm(v), 6).alias("norm"),
        F.round(F.aggregate(fv.unit(v), F.lit(0.0), lambda a, x: a + x), 6).alias("unit_sum"),
        F.size(v).alias("dim"),
    )


@query("vec_pair_cosine", f"""
WITH {E_SQL} SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine,
       round(1 - list_cosine_similarity(a.v, b.v), 6) AS cosine_distance
FROM e a JOIN e b ON b.id = a.id + 1""")
def vec_pair_cosine(spark, sf):
    e = store(spark, sf)
    left = e.select(F.col("id").alias("a"), F.col("vector").alias("va"), (F.col("id") + 1).alias("b"))
    right = e.select(F.col("id").alias("b"), F.col("vector").alias("vb"))
    c = fv.cosine(F.col("va"), F.col("vb"))
    return left.join(right, "b").select("a", "b", F.round(c, 6).alias("cosine"), F.round(1 - c, 6).alias("cosine_distance"))


@query("vec_neighbors", f"""
WITH {E_SQL}, {hits_sql(10)} SELECT query_id, rank::INTEGER AS rank, id, round(s, 6) AS similarity FROM h""")
def vec_neighbors(spark, sf):
    e = store(spark, sf)
    return kn.knn(e, e, 10).withColumn("similarity", F.round("similarity", 6))


# Super-blocks of queries and lanes of the corpus, as for large tables.
@query("vec_neighbors_grid", f"""
WITH {E_SQL}, {hits_sql(10)} SELECT query_id, rank::INTEGER AS rank, id, round(s, 6) AS similarity FROM h""")
def vec_neighbors_grid(spark, sf):
    e = store(spark, sf)
    return kn.knn(e, e, 10, strategy="grid", block_rows=256).withColumn("similarity", F.round("similarity", 6))


# Exact at any size.
@query("vec_neighbors_auto", f"""
WITH {E_SQL}, {hits_sql(7)} SELECT query_id, rank::INTEGER AS rank, id, round(s, 6) AS similarity FROM h""")
def vec_neighbors_auto(spark, sf):
    e = store(spark, sf)
    return ann.neighbours(e, e, 7).withColumn("similarity", F.round("similarity", 6))


@query("vec_precision_at_k", f"""
WITH {E_SQL}, q AS (SELECT * FROM e WHERE label IN (SELECT label FROM e GROUP BY label HAVING count(*) >= 2)),
{hits_sql(10, a="q")},
m AS (SELECT h.query_id, h.rank, (x.label = y.label)::INT AS hit FROM h JOIN e x ON x.id = h.query_id JOIN e y ON y.id = h.id),
p AS (SELECT query_id, avg(hit) FILTER (rank <= 1) AS p1, avg(hit) FILTER (rank <= 5) AS p5, avg(hit) AS p10 FROM m GROUP BY query_id)
SELECT count(*) AS n_evaluated, round(avg(p1), 6) AS precision_at_1, round(avg(p5), 6) AS precision_at_5,
       round(avg(p10), 6) AS precision_at_10 FROM p""")
def vec_precision_at_k(spark, sf):
    e = store(spark, sf)
    labels = e.select("id", "label")
    queries = e.join(mt.eligible_queries(labels, "label").select("id"), "id", "left_semi")
    out = mt.precision_at_k(kn.knn(queries, e.select("id", "vector"), 10), labels, [1, 5, 10])
    return out.select("n_evaluated", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("vec_precision_with_missing_labels", f"""
WITH {E_SQL}, y AS (SELECT e.id, e.v, CASE WHEN e.v[1] > 0.05 THEN NULL WHEN e.v[2] = (SELECT max(v[2]) FROM e) THEN 99 ELSE e.label END AS label FROM e),
q AS (SELECT * FROM y WHERE label IN (SELECT label FROM y WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 2)),
{hits_sql(10, a="q", b="y")},
m AS (SELECT h.query_id, h.rank, coalesce((x.label = y2.label)::INT, 0) AS hit FROM h JOIN y x ON x.id = h.query_id JOIN y y2 ON y2.id = h.id),
p AS (SELECT query_id, avg(hit) FILTER (rank <= 1) AS p1, avg(hit) AS p10 FROM m GROUP BY query_id)
SELECT count(*) AS n_evaluated, round(avg(p1), 6) AS precision_at_1, round(avg(p10), 6) AS precision_at_10 FROM p""")
def vec_precision_with_missing_labels(spark, sf):
    e = store(spark, sf)
    x, y = F.col("vector")[0].cast("double"), F.col("vector")[1].cast("double")
    # some labels are missing and one occurs once
    e = e.withColumn("label", F.when(x > 0.05, None).when(y == e.agg(F.max(y)).scalar(), 99).otherwise(F.col("label")))
    labels = e.select("id", "label")
    queries = e.join(mt.eligible_queries(labels, "label").select("id"), "id", "left_semi")
    out = mt.precision_at_k(kn.knn(queries, e.select("id", "vector"), 10), labels, [1, 10])
    return out.select("n_evaluated", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


D_SQL = "d AS (SELECT query_id AS id, avg(1 - s) AS knn_dist, 1 - max(s) AS nn_dist FROM h GROUP BY query_id)"


@query("vec_knn_distance", f"""
WITH {E_SQL}, {hits_sql(10)}, {D_SQL} SELECT id, round(knn_dist, 6) AS knn_dist, round(nn_dist, 6) AS nn_dist FROM d""")
def vec_knn_distance(spark, sf):
    e = store(spark, sf)
    d = kn.mean_distance(kn.knn(e, e, 10), 10)
    return d.select("id", F.round("knn_dist", 6).alias("knn_dist"), F.round("nn_dist", 6).alias("nn_dist"))


@query("vec_outlier_rank", f"""
WITH {E_SQL}, {hits_sql(10)}, {D_SQL}
SELECT id, round((row_number() OVER (ORDER BY round(knn_dist, 9), id) - 1) / greatest((SELECT count(*) FROM d) - 1, 1), 6) AS outlier FROM d""")
def vec_outlier_rank(spark, sf):
    e = store(spark, sf)
    d = kn.mean_distance(kn.knn(e, e, 10), 10).select("id", F.round("knn_dist", 9).alias("knn_dist"))
    return outlier_scores(d).select("id", F.round("outlier", 6).alias("outlier"))


@query("vec_top_outliers", f"""
WITH {E_SQL}, {hits_sql(10)}, {D_SQL} SELECT id, round(knn_dist, 6) AS knn_dist FROM d ORDER BY round(knn_dist, 9) DESC, id LIMIT 8""")
def vec_top_outliers(spark, sf):
    e = store(spark, sf)
    d = kn.mean_distance(kn.knn(e, e, 10), 10)
    return d.orderBy(F.round("knn_dist", 9).desc(), "id").limit(8).select("id", F.round("knn_dist", 6).alias("knn_dist"))


@query("vec_region_search", f"""
WITH {E_SQL}, r AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY id) AS pos FROM e),
x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM r WHERE pos BETWEEN 5 AND 20),
c AS (SELECT label, d, avg(x) AS x FROM x GROUP BY label, d),
p AS (SELECT label::BIGINT AS id, list(x ORDER BY d) AS v FROM c GROUP BY label),
{hits_sql(5, where="true", a="p")} SELECT query_id, rank::INTEGER AS rank, id, round(s, 6) AS similarity FROM h""")
def vec_region_search(spark, sf):
    e = store(spark, sf)
    ranked = residues(e)
    regions = e.select(F.col("label").cast("long").alias("id")).distinct().select("id", F.lit(5).alias("start"), F.lit(20).alias("end"))
    pooled = region_pool(ranked, regions)
    hits = kn.knn(pooled, e, 5, exclude_self=False)
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("vec_neighbors_in_subset", f"""
WITH {E_SQL}, sub AS (SELECT * FROM e WHERE label IN (SELECT label FROM e GROUP BY label ORDER BY count(*) DESC, label LIMIT 3)),
{hits_sql(5, a="e", b="sub")} SELECT query_id, rank::INTEGER AS rank, id, round(s, 6) AS similarity FROM h""")
def vec_neighbors_in_subset(spark, sf):
    from strandkit.operators.sampling import top_classes

    e = store(spark, sf)
    subset = e.join(F.broadcast(top_classes(e, "label", 3).select("label")), "label", "left_semi")
    return kn.knn(e, subset, 5).withColumn("similarity", F.round("similarity", 6))


@query("vec_hit_summaries", f"""
WITH {E_SQL}, {hits_sql(3)} SELECT h.id, h.query_id, h.rank::INTEGER AS rank, round(h.s, 4) AS similarity, e.label FROM h JOIN e ON e.id = h.id""")
def vec_hit_summaries(spark, sf):
    e = store(spark, sf)
    return hit_summaries(kn.knn(e, e, 3), e, "id", ["label"])


@query("vec_similarity_overlay", f"""
WITH {E_SQL}, o AS (SELECT min(id) AS id FROM e),
{hits_sql(10, where="a.id <> b.id AND a.id = (SELECT id FROM o)")}
SELECT e.id, e.label, CASE WHEN e.id = (SELECT id FROM o) THEN 1.0 ELSE round(h.s, 6) END AS similarity FROM e LEFT JOIN h ON h.id = e.id""")
def vec_similarity_overlay(spark, sf):
    e = store(spark, sf)
    first = e.agg(F.min("id").alias("id"))
    hits = kn.knn(e.join(F.broadcast(first), "id", "left_semi"), e, 10).withColumn("similarity", F.round("similarity", 6))
    return with_similarity(e.select("id", "label"), hits, "id", first.scalar())


@query("vec_nearest_label_accuracy", f"""
WITH {E_SQL}, r AS (SELECT *, count(*) OVER (PARTITION BY label) AS n,
  row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id) AS rn FROM e),
f AS (SELECT id, v, label, rn <= greatest(1, round_even(n * 0.15, 0)) AS holdout FROM r),
q AS (SELECT * FROM f WHERE holdout), t AS (SELECT * FROM f WHERE NOT holdout),
{hits_sql(1, where="true", a="q", b="t")}
SELECT count(*) AS n, round(avg((q.label = t.label)::INT), 6) AS accuracy FROM h JOIN q ON q.id = h.query_id JOIN t ON t.id = h.id""")
def vec_nearest_label_accuracy(spark, sf):
    marked = stratified_holdout(store(spark, sf), "label", "id")
    held, train = marked.filter("holdout"), marked.filter("not holdout")
    out = mt.nearest_label_accuracy(kn.knn(held, train, 1), held, train)
    return out.select("n", F.round("accuracy", 6).alias("accuracy"))


# With every cell probed, cell search must return the exact neighbours.
@query("ann_cells_all_probed", f"""
WITH {E_SQL}, {hits_sql(10)} SELECT query_id, rank::INTEGER AS rank, id, round(s, 6) AS similarity FROM h""")
def ann_cells_all_probed(spark, sf):
    e = store(spark, sf)
    return cell_knn(e, e, 10, n_cells=16, nprobe=16).withColumn("similarity", F.round("similarity", 6))


COPIES = 12


def scattered(spark, sf):
    """Each stored vector with ``COPIES`` neighbours of its own, so that the approximate plans have something
    to leave out: copies moved a little by numbers hashed from (id, copy, dimension)."""
    e = store(spark, sf)
    copy = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy")
    # the sum of four uniform numbers stands in for a normal one
    noise = lambda i: sum((F.pmod(F.xxhash64("id", "copy", i, F.lit(s)), F.lit(1 << 20)) / float(1 << 20) - 0.5 for s in range(4)), F.lit(0.0))
    moved = F.transform("vector", lambda x, i: (x + noise(i) * 0.06).cast("float"))
    return e.select("id", "vector", copy).select((F.col("id") * COPIES + F.col("copy")).alias("id"), moved.alias("vector"))


def kept_promises(e, hits, k: int):
    """k hits for each query, exact similarities of what is returned, and 0.9 of the true neighbours."""
    from strandkit.session import reliable_checkpoint

    exact, hits = reliable_checkpoint(kn.knn(e, e, k)), reliable_checkpoint(hits)
    pairs = hits.join(e.select(F.col("id").alias("query_id"), F.col("vector").alias("q")), "query_id").join(
        e.select("id", F.col("vector").alias("c")), "id"
    )
    wrong = F.abs(fv.cosine(F.col("q"), F.col("c")) - F.col("similarity")) > 1e-6
    counts = pairs.agg(F.count(F.lit(1)).alias("n_hits"), F.count_if(wrong).alias("n_wrong"))
    recall = mt.recall_at_k(exact, hits, k).select((F.col(f"recall_at_{k}") >= 0.9).alias("recall_holds"))
    return mt.one_row(counts, recall)


@query("ann_cells", f"""
SELECT {COPIES} * count(*) AS n_stored, {COPIES * 10} * count(*) AS n_hits, 0::BIGINT AS n_wrong, true AS recall_holds, true AS few_cells FROM embeddings""")
def ann_cells(spark, sf):
    from strandkit.session import reliable_checkpoint

    e = reliable_checkpoint(scattered(spark, sf))
    # a tenth is added later, without training again
    old, new = e.filter("id % 10 <> 3"), e.filter("id % 10 = 3")
    index = ann.build_cells(old)
    ann.add_to_cells(index, new)
    settings = index.settings()
    few = settings["nprobe"] < 0.2 * settings["n_cells"]
    stored = index.read("vectors").agg(F.sum("n").alias("n_stored"))
    return mt.one_row(stored, kept_promises(e, ann.search_cells(index, e, 10), 10)).withColumn("few_cells", F.lit(few))


@query("ann_quantized", f"""
SELECT {COPIES} * count(*) AS n_coded, 64 * {COPIES} * count(*) AS code_bytes, {COPIES * 10} * count(*) AS n_hits, 0::BIGINT AS n_wrong, true AS recall_holds FROM embeddings""")
def ann_quantized(spark, sf):
    from strandkit.session import reliable_checkpoint

    e = reliable_checkpoint(scattered(spark, sf))
    index = ann.build_cells(e)
    ann.build_codes(index)
    coded = index.read("codes").agg(F.sum("n").alias("n_coded"), F.sum(F.length("codes")).alias("code_bytes"))
    return mt.one_row(coded, kept_promises(e, ann.search_codes(index, e, 10), 10))


@query("ann_signatures", f"""
SELECT {COPIES} * count(*) AS n_stored, true AS has_bits, true AS few_pairs, {COPIES * 10} * count(*) AS n_hits, 0::BIGINT AS n_wrong, true AS recall_holds FROM embeddings""")
def ann_signatures(spark, sf):
    from strandkit.session import reliable_checkpoint

    e = reliable_checkpoint(scattered(spark, sf))
    index = ann.build_signatures(e)
    settings = index.settings()
    found = ann.search_signatures(index, e, 10)
    stored = index.read("vectors").agg(F.sum("n").alias("n_stored")).withColumn("has_bits", F.lit(settings["bits"] > 0))
    stored = stored.withColumn("few_pairs", F.lit(found.n_pairs < 0.8 * settings["n"] ** 2))
    return mt.one_row(stored, kept_promises(e, found.hits, 10))


# A reach of 1 makes the margins a proof: the result is exact.
@query("ann_signatures_exact", f"""
WITH {E_SQL}, {hits_sql(10)} SELECT query_id, rank::INTEGER AS rank, id, round(s, 6) AS similarity FROM h""")
def ann_signatures_exact(spark, sf):
    e = store(spark, sf)
    index = ann.build_signatures(e, bits=4)
    return ann.search_signatures(index, e, 10, reach=1.0).hits.withColumn("similarity", F.round("similarity", 6))


@query("ann_recall", f"""
SELECT plan, {COPIES} * count(*) AS n_vectors, true AS recall_holds, true AS timed FROM embeddings, (VALUES ('exact'), ('cells'), ('quantized'), ('signatures')) AS p(plan) GROUP BY plan""")
def ann_recall(spark, sf):
    from strandkit.plans.study import recall_study

    out = recall_study(scattered(spark, sf), 10, n_queries=500)
    return out.select("plan", "n_vectors", (F.col("recall_at_10") >= 0.9).alias("recall_holds"), ((F.col("qps") > 0) & (F.col("share_met") <= 1)).alias("timed"))


# What every approximate plan must keep: k hits for each query, exact similarities of what it
# returns, and a share of the true neighbours.
RECALL_FLOORS = {"cells": 0.9, "quantized": 0.9, "signatures": 0.9}


@query("ann_checks", f"""
SELECT plan, 10 * count(*) AS n_hits, 0::BIGINT AS n_wrong, true AS recall_holds
FROM embeddings, (VALUES {', '.join(f"('{p}')" for p in RECALL_FLOORS)}) AS p(plan) GROUP BY plan""")
def ann_checks(spark, sf):
    from strandkit.session import reliable_checkpoint

    e = store(spark, sf)
    exact = reliable_checkpoint(kn.knn(e, e, 10))
    out = None
    for plan, search in {"cells": cell_knn, "quantized": quantized_knn, "signatures": signature_knn}.items():
        hits = reliable_checkpoint(search(e, e, 10))
        pairs = hits.join(e.select(F.col("id").alias("query_id"), F.col("vector").alias("q")), "query_id").join(
            e.select("id", F.col("vector").alias("c")), "id"
        )
        wrong = F.abs(fv.cosine(F.col("q"), F.col("c")) - F.col("similarity")) > 1e-6
        counts = pairs.agg(F.count(F.lit(1)).alias("n_hits"), F.count_if(wrong).alias("n_wrong"))
        recall = mt.recall_at_k(exact, hits, 10).select((F.col("recall_at_10") >= RECALL_FLOORS[plan]).alias("recall_holds"))
        row = mt.one_row(counts, recall).select(F.lit(plan).alias("plan"), "n_hits", "n_wrong", "recall_holds")
        out = row if out is None else out.unionByName(row)
    return out


# -- metrics over other tables ----------------------------------------------------

C_SQL = "c AS (SELECT l_returnflag AS a, l_linestatus || l_linenumber AS b FROM lineitem)"


def flags(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("a"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("b")
    )


@query("metric_purity", f"""
WITH {C_SQL}, n AS (SELECT a, b, count(*) AS n FROM c GROUP BY a, b), m AS (SELECT b, max(n) AS best, sum(n) AS total FROM n GROUP BY b)
SELECT round(sum(best) / sum(total), 6) AS purity FROM m""")
def metric_purity(spark, sf):
    return mt.purity(flags(spark, sf), "b", "a").select(F.round("purity", 6).alias("purity"))


@query("metric_nmi", f"""
WITH {C_SQL}, n AS (SELECT a, b, count(*)::DOUBLE AS n FROM c GROUP BY a, b), t AS (SELECT sum(n) AS t FROM n),
x AS (SELECT a, sum(n) AS n FROM n GROUP BY a), y AS (SELECT b, sum(n) AS n FROM n GROUP BY b)
SELECT round((SELECT sum(n.n / t * ln(n.n * t / (x.n * y.n))) FROM n JOIN x USING (a) JOIN y USING (b), t)
 / (((SELECT -sum(x.n / t * ln(x.n / t)) FROM x, t) + (SELECT -sum(y.n / t * ln(y.n / t)) FROM y, t)) / 2), 6) AS nmi""")
def metric_nmi(spark, sf):
    return mt.normalized_mutual_information(flags(spark, sf), "a", "b").select(F.round("nmi", 6).alias("nmi"))


@query("metric_auroc", """
WITH d AS (SELECT lang, n_chars AS s, quality FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS r FROM d),
g AS (SELECT lang, sum(r) FILTER (quality = 1) AS rs, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n FROM r GROUP BY lang)
SELECT lang, p AS n_pos, n AS n_neg, round((rs - p * (p + 1) / 2.0) / (p * n), 6) AS auroc FROM g WHERE p > 0 AND n > 0""")
def metric_auroc(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return mt.auroc(d, F.col("quality") == 1, "n_chars", ["lang"]).withColumn("auroc", F.round("auroc", 6))


@query("metric_auroc_one_vs_rest", """
WITH e AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT DISTINCT label AS cls FROM embeddings),
x AS (SELECT c.cls, e.v[c.cls + 1] AS s, (e.label = c.cls) AS pos FROM e, c),
r AS (SELECT *, rank() OVER (PARTITION BY cls ORDER BY s) + (count(*) OVER (PARTITION BY cls, s) - 1) / 2.0 AS r FROM x),
g AS (SELECT cls, sum(r) FILTER (pos) AS rs, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM r GROUP BY cls)
SELECT round(avg((rs - p * (p + 1) / 2.0) / (p * n)), 6) AS auroc_macro_ovr FROM g""")
def metric_auroc_one_vs_rest(spark, sf):
    e = store(spark, sf)
    classes = F.array(*[F.lit(i) for i in range(10)])
    scores = F.map_from_arrays(classes, F.slice(fv.doubles(F.col("vector")), 1, 10))
    out = mt.auroc_one_vs_rest(e.withColumn("scores", scores), "label", "scores")
    return out.select(F.round("auroc_macro_ovr", 6).alias("auroc_macro_ovr"))


@query("metric_macro_f1", """
WITH p AS (SELECT label AS t, (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::INTEGER AS y FROM embeddings),
k AS (SELECT t AS c FROM p UNION SELECT y FROM p),
f AS (SELECT c, 2.0 * (SELECT count(*) FROM p WHERE t = c AND y = c) / ((SELECT count(*) FROM p WHERE t = c) + (SELECT count(*) FROM p WHERE y = c)) AS f FROM k)
SELECT (SELECT count(*) FROM p) AS n, round((SELECT avg((t = y)::INT) FROM p), 6) AS accuracy, round((SELECT avg(f) FROM f), 6) AS macro_f1""")
def metric_macro_f1(spark, sf):
    head = F.slice("vector", 1, 10)
    p = store(spark, sf).select("label", (F.array_position(head, F.array_max(head)) - 1).cast("int").alias("y"))
    out = mt.accuracy_and_macro_f1(p, "label", "y")
    return out.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query("metric_pearson", """
SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS pearson_r FROM lineitem GROUP BY l_returnflag""")
def metric_pearson(spark, sf):
    out = mt.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.withColumn("pearson_r", F.round("pearson_r", 6))


@query("metric_spearman", """
WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY l_returnflag""")
def metric_spearman(spark, sf):
    out = mt.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "n", F.round("rho", 6).alias("rho"))


@query("metric_spearman_events", """
WITH e AS (SELECT value AS a, json_extract_string(props, '$.k')::INT AS b FROM events),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM e)
SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r""")
def metric_spearman_events(spark, sf):
    e = table(spark, sf, "events").select(F.col("value").alias("a"), F.get_json_object("props", "$.k").cast("int").alias("b"))
    return mt.spearman(e, "a", "b").select("n", F.round("rho", 6).alias("rho"))


@query("metric_group_disagreement", """
WITH n AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY ALL),
x AS (SELECT sum(n) AS n FROM n GROUP BY a), y AS (SELECT sum(n) AS n FROM n GROUP BY b),
j AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS j, sum(n)::BIGINT AS t FROM n)
SELECT t AS n_rows, j AS both_join, (SELECT sum(n * (n - 1) // 2) FROM x)::BIGINT - j AS only_a, (SELECT sum(n * (n - 1) // 2) FROM y)::BIGINT - j AS only_b FROM j""")
def metric_group_disagreement(spark, sf):
    return mt.grouping_disagreement(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query("metric_stability", f"""
WITH {E_SQL}, p AS (SELECT a.label, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON b.id = a.id + 1)
SELECT label, count(*) AS n_pairs, round(avg(c), 6) AS cosine_mean, round(stddev_pop(c), 6) AS cosine_std,
       round(quantile_cont(c, 0.05), 6) AS cosine_p05, round(min(c), 6) AS cosine_min FROM p GROUP BY label""")
def metric_stability(spark, sf):
    e = store(spark, sf)
    pairs = e.select("label", F.col("vector").alias("a"), (F.col("id") + 1).alias("next")).join(
        e.select(F.col("id").alias("next"), F.col("vector").alias("b")), "next"
    ).select("label", fv.cosine(F.col("a"), F.col("b")).alias("cosine"))
    out = mt.stability(pairs, by=["label"])
    return out.select("label", "n_pairs", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("metric_pair_distribution", f"""
WITH {E_SQL}, p AS (SELECT CASE WHEN a.label = b.label THEN 'within' ELSE 'cross' END AS stratum, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON b.id = a.id + 3)
SELECT stratum, count(*) AS n_pairs, round(avg(c), 6) AS mean, round(quantile_cont(c, 0.95), 6) AS p95, round(quantile_cont(c, 0.99), 6) AS p99, round(max(c), 6) AS max FROM p GROUP BY stratum""")
def metric_pair_distribution(spark, sf):
    e = store(spark, sf)
    pairs = e.select("label", F.col("vector").alias("a"), (F.col("id") + 3).alias("next")).join(
        e.select(F.col("id").alias("next"), F.col("vector").alias("b"), F.col("label").alias("l2")), "next"
    ).select(F.when(F.col("label") == F.col("l2"), "within").otherwise("cross").alias("stratum"), fv.cosine(F.col("a"), F.col("b")).alias("c"))
    out = mt.pair_distribution(pairs, "stratum", "c")
    return out.select("stratum", "n_pairs", *[F.round(c, 6).alias(c) for c in ("mean", "p95", "p99", "max")])


@query("contrastive_loss", f"""
WITH {E_SQL}, b AS (SELECT id // 32 AS batch, id, label, v FROM e),
s AS (SELECT x.batch, x.id AS i, (x.label = y.label) AS pos, list_cosine_similarity(x.v, y.v) / 0.1 AS s FROM b x JOIN b y ON x.batch = y.batch AND x.id <> y.id),
a AS (SELECT batch, i, ln(sum(exp(s - 10))) + 10 AS lse, avg(s) FILTER (pos) AS mp FROM s GROUP BY batch, i)
SELECT batch, round(coalesce(-avg(mp - lse), 0), 6) AS loss FROM a GROUP BY batch""")
def contrastive_loss(spark, sf):
    e = store(spark, sf).withColumn("batch", F.floor(F.col("id") / 32))
    return mt.contrastive_loss(e, "batch", "id", "label", "vector").withColumn("loss", F.round("loss", 6))


# One batch of all vectors: its pairs are met block by block.
@query("contrastive_loss_whole", f"""
WITH {E_SQL}, s AS (SELECT x.id AS i, (x.label = y.label) AS pos, list_cosine_similarity(x.v, y.v) / 0.1 AS s FROM e x JOIN e y ON x.id <> y.id),
a AS (SELECT i, ln(sum(exp(s - 10))) + 10 AS lse, avg(s) FILTER (pos) AS mp FROM s GROUP BY i)
SELECT 'all' AS batch, round(coalesce(-avg(mp - lse), 0), 6) AS loss FROM a""")
def contrastive_loss_whole(spark, sf):
    e = store(spark, sf).withColumn("batch", F.lit("all"))
    return mt.contrastive_loss(e, "batch", "id", "label", "vector", block_rows=200).withColumn("loss", F.round("loss", 6))


@query("metric_average_ranks", """
WITH r AS (SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS r FROM lineitem)
SELECT l_returnflag, l_quantity::DOUBLE AS l_quantity, max(r) AS mean_rank, count(*) AS n FROM r GROUP BY ALL""")
def metric_average_ranks(spark, sf):
    from strandkit.operators.ranking import average_ranks

    out = average_ranks(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity", "mean_rank")
    return out.select("l_returnflag", F.col("l_quantity").cast("double"), "mean_rank", "n")
