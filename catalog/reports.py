"""Lookups, profiles, comparisons, learned models and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import alignment_sql, query, table
from catalog.effects import LETTERS, assay_tables, names
from catalog.samples import with_hashed_split
from catalog.vectors import E_SQL, hits_sql, store
from strandkit.functions import vectors as fv
from strandkit.operators import aggregates as ag
from strandkit.operators import cluster as cl
from strandkit.operators import embed as em
from strandkit.operators import lookup as lo
from strandkit.operators import metrics as mt
from strandkit.operators.kmers import composition
from strandkit.operators.knn import knn
from strandkit.operators.probe import run_probe
from strandkit.plans import search as se
from strandkit.plans import study as st


@query("text_lookup", """
WITH f AS (SELECT p_partkey, p_name, CASE WHEN lower(p_brand) = 'brand#1' THEN 100 ELSE 0 END + CASE WHEN lower(p_name) LIKE 'brand#1%' THEN 80 ELSE 0 END
 + CASE WHEN contains(lower(p_name), 'brand#1') THEN 40 ELSE 0 END + CASE WHEN contains(lower(p_brand), 'brand#1') THEN 25 ELSE 0 END
 + CASE WHEN contains(lower(p_type), 'brand#1') THEN 10 ELSE 0 END AS score FROM part)
SELECT p_partkey, p_name, score FROM f WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 100""")
def text_lookup(spark, sf):
    p = table(spark, sf, "part")
    out = lo.text_lookup(p, "  Brand#1 ", F.col("p_name"), F.col("p_brand"), F.col("p_partkey"), F.col("p_type"), "p_partkey", 100)
    return out.select("p_partkey", "p_name", "score")


@query("text_lookup_names", """
WITH f AS (SELECT p_partkey, CASE WHEN starts_with(p_name, 'red') THEN 80 ELSE 0 END + CASE WHEN contains(p_name, 'red') THEN 40 ELSE 0 END
 + CASE WHEN contains(lower(p_type), 'red') THEN 10 ELSE 0 END AS score FROM part)
SELECT p_partkey, score FROM f WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 20""")
def text_lookup_names(spark, sf):
    p = table(spark, sf, "part")
    out = lo.text_lookup(p, "red", F.col("p_name"), F.col("p_brand"), F.col("p_partkey"), F.col("p_type"), "p_partkey")
    return out.select("p_partkey", "score")


@query("hits_resorted", f"""
WITH {E_SQL}, {hits_sql(4)} SELECT query_id, rank::INTEGER AS rank, h.id, e.label FROM h JOIN e ON e.id = h.id""")
def hits_resorted(spark, sf):
    e = store(spark, sf)
    hits = knn(e, e, 4).join(e.select("id", "label"), "id")
    return lo.resorted_hits(hits, "label").select("query_id", "rank", "id", "label")


@query("row_profile", f"""
WITH {E_SQL}, {hits_sql(5)}, n AS (SELECT query_id AS id, string_agg(id || ':' || printf('%.4f', round(s, 4)), '|' ORDER BY rank) AS neighbors, round(1 - max(s), 5) AS nn_distance FROM h GROUP BY query_id),
d AS (SELECT o_custkey AS id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS domains FROM orders GROUP BY o_custkey)
SELECT e.id, e.label, n.neighbors, n.nn_distance, d.domains FROM e LEFT JOIN n ON n.id = e.id LEFT JOIN d ON d.id = e.id""")
def row_profile(spark, sf):
    e = store(spark, sf)
    domains = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("start"), F.col("o_orderkey").alias("end"), F.lit("order").alias("name")
    )
    p = lo.profiles(e.select("id", "label"), "id", e.select("id"), knn(e, e, 5), domains)
    shown = lambda x: F.concat(x["id"].cast("string"), F.lit(":"), F.format_string("%.4f", x["similarity"]))
    return p.select(
        "id", "label", F.concat_ws("|", F.transform("neighbors", shown)).alias("neighbors"), "nn_distance",
        F.when(F.col("domains").isNotNull(), F.concat_ws(",", F.transform("domains", lambda d: d["start"].cast("string")))).alias("domains"),
    )


@query("pair_compare", f"""
WITH RECURSIVE e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, ['t' || label, 'u' || (vec_id % 3), 'w' || (vec_id % 5)] AS ts,
  CASE WHEN vec_id % 50 = 0 THEN '' ELSE upper(translate(substr(md5('' || vec_id // 3), 1, 20), '0123456789', 'GHIKLMNPQR')) END AS s FROM embeddings),
o AS (SELECT o_custkey AS id, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS d FROM orders GROUP BY o_custkey),
q AS (SELECT a.id AS a, b.id AS b, a.s AS sa, b.s AS sb FROM e a JOIN e b ON b.id = a.id + 7), {alignment_sql('q')}
SELECT a.id AS a, b.id AS b, a.label = b.label AS same_family, array_to_string(list_sort(list_intersect(a.ts, b.ts)), ',') AS shared,
  round(list_cosine_similarity(a.v, b.v), 4) AS cosine_mean, round(list_cosine_similarity(a.v, list_reverse(a.v)), 4) AS cosine_self, round(ai.identity, 4) AS identity,
  coalesce(x.d, '') AS a_domains, coalesce(y.d, '') AS b_domains
FROM e a JOIN e b ON b.id = a.id + 7 JOIN ai ON ai.a = a.id AND ai.b = b.id LEFT JOIN o x ON x.id = a.id LEFT JOIN o y ON y.id = b.id""")
def pair_compare(spark, sf):
    e = store(spark, sf)
    key = F.substring(F.md5(F.floor(F.col("id") / 3).cast("string")), 1, 20)
    sequence = F.when(F.col("id") % 50 == 0, F.lit("")).otherwise(F.upper(F.translate(key, "0123456789", "GHIKLMNPQR")))
    corpus = e.select("id", "label", sequence.alias("sequence"), F.array(
        F.concat(F.lit("t"), F.col("label").cast("string")), F.concat(F.lit("u"), (F.col("id") % 3).cast("string")),
        F.concat(F.lit("w"), (F.col("id") % 5).cast("string")),
    ).alias("tokens"))
    pairs = e.select(F.col("id").alias("a"), (F.col("id") + 7).alias("b"))
    poolings = e.select("id", F.lit("mean").alias("pooling"), "vector")
    orders = table(spark, sf, "orders")
    domains = orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("start"), F.col("o_orderkey").alias("end"), F.col("o_orderstatus").alias("name"))
    out = lo.compare_pairs(pairs, corpus, poolings, "id", "label", "tokens", ["mean"], "sequence", domains)
    own = e.select(F.col("id").alias("a"), F.round(fv.cosine(F.col("vector"), F.reverse("vector")), 4).alias("cosine_self"))
    shown = lambda c: F.concat_ws(",", F.transform(c, lambda d: F.concat(d["start"].cast("string"), F.lit(":"), d["name"])))
    return out.join(own, "a").withColumns({"shared": F.concat_ws(",", "shared"), "a_domains": shown("a_domains"), "b_domains": shown("b_domains")})


@query("join_with_split", """
SELECT d.doc_id, l.quality AS split FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def join_with_split(spark, sf):
    splits = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("split"))
    return lo.with_split(table(spark, sf, "documents").select("doc_id"), splits, "doc_id")


@query("join_aligned_store", """
SELECT a.vec_id AS id, a.label, round(list_sum(a.embedding::DOUBLE[]), 6) AS total FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id""")
def join_aligned_store(spark, sf):
    e = store(spark, sf)
    out = lo.aligned(e.select("id", "label"), e.select("id", "vector"), "id")
    total = F.aggregate(fv.doubles(F.col("vector")), F.lit(0.0), lambda a, x: a + x)
    return out.select("id", "label", F.round(total, 6).alias("total"))


@query("combine_representations", """
SELECT 'first' AS representation, vec_id AS id, len(embedding)::INTEGER AS dim FROM embeddings
UNION ALL SELECT 'letters', p_partkey, 26 FROM part""")
def combine_representations(spark, sf):
    letters = composition(names(spark, sf), "id", "sequence", LETTERS)
    both, _ = lo.combine_representations({"first": store(spark, sf), "letters": letters, "absent": None})
    return both.select("representation", "id", F.size("vector").alias("dim"))


# -- search requests --------------------------------------------------------------------

COMP_SQL = f"""s AS (SELECT p_partkey AS id, upper(replace(p_name, ' ', '')) AS s, p_type FROM part),
u AS (SELECT DISTINCT s FROM s), c AS (SELECT s, list_transform(string_split('{LETTERS}', ''), lambda x: (length(s) - length(replace(s, x, '')))::DOUBLE / length(s)) AS v FROM u)"""


# The store holds compositions; a new sequence finds the rows nearest to its own.
@query("search_by_sequence", f"""
WITH {COMP_SQL}, q AS (SELECT c_custkey AS qid, upper(c_mktsegment) AS t FROM customer),
w AS (SELECT qid, list_transform(string_split('{LETTERS}', ''), lambda x: (length(t) - length(replace(t, x, '')))::DOUBLE / length(t)) AS v FROM q),
d AS (SELECT DISTINCT v FROM w), m AS (SELECT d.v, s.id, s.p_type, round(list_cosine_similarity(d.v, c.v), 10) AS sim FROM d, c JOIN s ON s.s = c.s),
r AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY sim DESC, id) AS rank FROM m QUALIFY rank <= 3)
SELECT w.qid AS query_id, r.rank::INTEGER AS rank, r.id, round(sim, 4) AS similarity, p_type FROM w JOIN r ON r.v = w.v""")
def search_by_sequence(spark, sf):
    rows = names(spark, sf)
    vectors = composition(rows, "id", "sequence", LETTERS)
    corpus = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_type")
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.upper("c_mktsegment").alias("sequence"))
    return se.search(
        vectors, corpus, ["p_type"], 3, "id", sequences=wanted, encoder=em.OneHotEncoder(LETTERS), lengths=(1, 2048), alphabet=LETTERS
    )


@query("search_by_id", f"""
WITH {E_SQL}, q AS (SELECT * FROM e WHERE id IN (SELECT n_nationkey FROM nation)), {hits_sql(5, a="q")}
SELECT query_id, rank::INTEGER AS rank, h.id, round(s, 4) AS similarity, e.label FROM h JOIN e ON e.id = h.id""")
def search_by_id(spark, sf):
    e = store(spark, sf)
    wanted = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return se.search(e, e, ["label"], 5, "id", ids=wanted)


@query("search_request_states", """
WITH w AS (SELECT DISTINCT 'C' || lpad((o_custkey + 700)::VARCHAR, CASE WHEN o_orderpriority = '1-URGENT' THEN 3 ELSE 6 END, '0') AS accession FROM orders),
c AS (SELECT 'C' || lpad(c_custkey::VARCHAR, 6, '0') AS accession, c_nationkey FROM customer)
SELECT w.accession, CASE WHEN w.accession IN (SELECT accession FROM c WHERE c_nationkey < 10) THEN 'corpus'
  WHEN NOT regexp_matches(w.accession, '^[A-Z][A-Z0-9]{5,9}$') THEN 'malformed' WHEN w.accession IN (SELECT accession FROM c) THEN 'external' ELSE 'not_found' END AS source FROM w""")
def search_request_states(spark, sf):
    wide = F.when(F.col("o_orderpriority") == "1-URGENT", 3).otherwise(6)
    number = (F.col("o_custkey") + 700).cast("string")
    text = F.when(wide == 3, F.lpad(number, 3, "0")).otherwise(F.lpad(number, 6, "0"))
    wanted = table(spark, sf, "orders").select(F.lower(F.concat(F.lit(" C"), text)).alias("accession"))
    records = table(spark, sf, "customer").select(
        F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("accession"), "c_nationkey"
    )
    return se.request_states(wanted, records, records.filter("c_nationkey < 10"))


# -- learned models: results depend on the solver, so only rows are checked ----------------

@query("kmeans_summary")
def kmeans_summary(spark, sf):
    e = store(spark, sf)
    placed, _ = cl.kmeans_clusters(e, "id", "vector", 10, n_init=2, max_iter=20)
    return placed.join(e.select("id", "label"), "id").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.countDistinct("label").alias("n_labels")
    )


@query("pca_coordinates")
def pca_coordinates(spark, sf):
    places, _ = cl.map_coordinates(store(spark, sf), "id", "vector")
    return places.select("id", F.round(F.abs("x"), 4).alias("x"), F.round(F.abs("y"), 4).alias("y"))


@query("density_islands")
def density_islands(spark, sf):
    reduced, _ = cl.pca_projection(store(spark, sf), "id", "vector", 50)
    return cl.density_islands(reduced, "id", "vector", min_size=5, min_samples=3, radius_quantile=0.5)


@query("probe_metrics")
def probe_metrics(spark, sf):
    return run_probe(with_hashed_split(store(spark, sf), "id"), "vector", "label", least=10, max_iter=50)


@query("representation_stats")
def representation_stats(spark, sf):
    return st.representation_stats(store(spark, sf).select("id", "vector"), 10, 10)


@query("benchmark_suite")
def benchmark_suite(spark, sf):
    e = store(spark, sf)
    labels = with_hashed_split(e.select("id", F.col("label").cast("string").alias("label")), "id")
    return st.benchmark_suite({"stored": e.select("id", "vector")}, labels, {"label": 10}, ["label"], "label", 10)


@query("split_comparison")
def split_comparison(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("sequence"), "p_type", "p_brand")
    groupings = {
        "brand": rows.select("id", F.col("p_brand").alias("group_id")),
        "name": rows.select("id", F.col("sequence").alias("group_id")),
    }
    vectors = composition(names(spark, sf), "id", "sequence", LETTERS)
    labels = rows.select("id", "p_type")
    return st.compare_split_methods(rows, groupings, "id", "sequence", vectors, labels, {"p_type": 20}, 2000, alphabet=None, audit_pairs=300)


@query("assay_validation")
def assay_validation(spark, sf):
    rows, targets = assay_tables(spark, sf)
    from strandkit.operators import variants as va

    aligned = va.align_assay(rows, targets, va.detect_offset(rows, targets, "assay", "s"), "assay", "s")
    encoder = em.OneHotEncoder(LETTERS + " ")
    options = {"lengths": (1, 2048), "alphabet": LETTERS + " "}
    wild = em.embed(targets, encoder, "assay", "s", **options).select(F.col("id").alias("assay"), "vector")
    changed = aligned.join(targets, "assay").withColumn("seq", F.overlay("s", F.col("mut"), F.col("pos"), F.lit(1))).withColumn(
        "key", F.concat_ws(":", "assay", F.col("pos").cast("string"), "mut")
    )
    mutants = em.embed(changed, encoder, "key", "seq", **options).select(
        F.substring_index("id", ":", 1).alias("assay"), F.element_at(F.split("id", ":"), 2).cast("int").alias("pos"),
        F.element_at(F.split("id", ":"), 3).alias("mut"), "vector",
    )
    symbols = targets.select("assay", F.posexplode(F.split("s", "")).alias("p", "here"))
    lp = symbols.select(
        "assay", (F.col("p") + 1).alias("pos"), "here", F.explode(F.array(*[F.lit(x) for x in LETTERS + " "])).alias("symbol")
    ).select("assay", "pos", "symbol", F.when(F.col("symbol") == F.col("here"), -0.1).otherwise(-4.0 - F.col("pos") / 10).alias("log_prob"))
    _, rho = st.assay_validation(aligned, lp, wild, mutants)
    return rho.select("assay", "statistic", "n", F.round("rho", 4).alias("rho"))


# -- report tables over a metric table derived from lineitem -------------------------------

METRIC_SQL = """
m AS (SELECT l_returnflag || l_linestatus AS representation, CASE l_linenumber WHEN 1 THEN 'probe' WHEN 2 THEN 'probe' WHEN 3 THEN 'retrieval' WHEN 4 THEN 'clustering' ELSE 'stability' END AS axis,
  CASE l_linenumber WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'same_pfam_primary' ELSE 'x' END AS task,
  CASE l_linenumber WHEN 1 THEN 'macro_f1' WHEN 2 THEN 'macro_f1' WHEN 3 THEN 'precision_at_10' WHEN 4 THEN 'nmi' ELSE 'cosine_mean' END AS metric,
  round(avg(l_quantity), 4) AS value FROM (SELECT * REPLACE (least(l_linenumber, 5) AS l_linenumber) FROM lineitem) GROUP BY l_returnflag, l_linestatus, l_linenumber)"""


def metric_table(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("l_linenumber", F.least("l_linenumber", F.lit(5)).cast("int"))
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("l_linenumber"))
    return l.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.round(F.avg("l_quantity"), 4).alias("value")).select(
        F.concat("l_returnflag", "l_linestatus").alias("representation"),
        pick("probe", "probe", "retrieval", "clustering", "stability").alias("axis"),
        pick("a", "b", "same_pfam_primary", "x", "x").alias("task"),
        pick("macro_f1", "macro_f1", "precision_at_10", "nmi", "cosine_mean").alias("metric"), "value",
    )


@query("report_headline", f"""
WITH {METRIC_SQL} SELECT representation, round(avg(value) FILTER (axis = 'probe'), 6) AS mean_macro_f1, max(value) FILTER (axis = 'retrieval') AS precision_at_10,
  max(value) FILTER (axis = 'clustering') AS nmi, max(value) FILTER (axis = 'stability') AS stability FROM m GROUP BY representation""")
def report_headline(spark, sf):
    return ag.headline(metric_table(spark, sf)).withColumn("mean_macro_f1", F.round("mean_macro_f1", 6))


@query("report_extended", f"""
WITH {METRIC_SQL}, g AS (SELECT l_returnflag || l_linestatus AS representation, min(l_linestatus) AS "group", count(DISTINCT l_suppkey)::BIGINT AS params_m FROM lineitem GROUP BY ALL)
SELECT representation, round(avg(value) FILTER (metric = 'macro_f1'), 6) AS mean_f1, NULL::DOUBLE AS precision_at_1, max(value) FILTER (metric = 'precision_at_10') AS precision_at_10,
  max(value) FILTER (metric = 'nmi') AS nmi, max(value) FILTER (task = 'a') AS a, max(value) FILTER (task = 'b') AS b, any_value("group") AS "group", any_value(params_m) AS params_m
FROM m JOIN g USING (representation) GROUP BY representation""")
def report_extended(spark, sf):
    registry = table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("representation")).agg(
        F.min("l_linestatus").alias("group"), F.countDistinct("l_suppkey").alias("params_m")
    )
    return ag.extended_table(metric_table(spark, sf), registry, ["a", "b"]).withColumn("mean_f1", F.round("mean_f1", 6))


@query("report_best_rows", f"""
WITH {METRIC_SQL} SELECT * FROM m QUALIFY value = max(value) OVER (PARTITION BY axis, task, metric)""")
def report_best_rows(spark, sf):
    return ag.best_rows(metric_table(spark, sf), ["axis", "task", "metric"], "value")


@query("report_ranked", f"""
WITH {METRIC_SQL} SELECT *, (row_number() OVER (PARTITION BY axis, task, metric ORDER BY value DESC, representation))::INTEGER AS rank FROM m""")
def report_ranked(spark, sf):
    return ag.ranked_report(metric_table(spark, sf), ["axis", "task", "metric"], "value", "representation")


@query("report_filtered", f"WITH {METRIC_SQL} SELECT representation, value FROM m WHERE axis = 'probe' AND task = 'b'")
def report_filtered(spark, sf):
    return metric_table(spark, sf).filter("axis = 'probe' and task = 'b'").select("representation", "value")


@query("report_assays", """
WITH r AS (SELECT l_shipdate, l_returnflag AS assay, l_quantity AS q, l_extendedprice AS p, -l_discount AS d FROM lineitem),
k AS (SELECT assay, rank() OVER (PARTITION BY assay ORDER BY q) + (count(*) OVER (PARTITION BY assay, q) - 1) / 2.0 AS q,
  rank() OVER (PARTITION BY assay ORDER BY p) + (count(*) OVER (PARTITION BY assay, p) - 1) / 2.0 AS p,
  rank() OVER (PARTITION BY assay ORDER BY d) + (count(*) OVER (PARTITION BY assay, d) - 1) / 2.0 AS d FROM r),
s AS (SELECT assay, count(*) AS n, corr(q, p) AS a, corr(d, p) AS b FROM k GROUP BY assay)
SELECT assay, n, round(a, 6) AS rho_llr, round(b, 6) AS rho_neg_displacement FROM s
UNION ALL SELECT 'mean', sum(n)::BIGINT, round(avg(a), 6), round(avg(b), 6) FROM s""")
def report_assays(spark, sf):
    l = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("assay"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), (-F.col("l_discount")).alias("d")
    )
    a = mt.spearman(l, "q", "p", ["assay"]).select("assay", "n", F.col("rho").alias("rho_llr"))
    b = mt.spearman(l, "d", "p", ["assay"]).select("assay", F.col("rho").alias("rho_neg_displacement"))
    out = ag.assay_summary(a.join(b, "assay"))
    return out.select("assay", "n", F.round("rho_llr", 6).alias("rho_llr"), F.round("rho_neg_displacement", 6).alias("rho_neg_displacement"))
