"""Studies, searches and landscapes through their library functions, each with SQL.

Where a part of a study depends on a solver, its query keeps the parts that do not, or
checks what every solution must satisfy."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import alignment_sql, query, table
from catalog.effects import ASSAY_SQL, LETTERS, S_SQL, assay_tables, names
from catalog.groups import greedy_sql
from catalog.samples import with_hashed_split
from catalog.vectors import D_SQL, E_SQL, hits_sql, residues, store
from strandkit.functions import columns as fc
from strandkit.operators import ann, cluster as cl, embed as em, metrics as mt
from strandkit.operators import variants as va
from strandkit.operators.kmers import composition
from strandkit.operators.knn import knn
from strandkit.operators.lookup import neighbours_within
from strandkit.operators.probe import probe_predictions, run_probe
from strandkit.operators.sampling import top_classes
from strandkit.plans import search as se
from strandkit.plans import study as st
from strandkit.plans.effects import landscapes, parsed_requests
from strandkit.session import checkpoint_folder, reliable_checkpoint
from strandkit.sources import tables as tb

ENCODER = {"lengths": (1, 2048), "alphabet": LETTERS}
# Composition of a text over the letters, in the order of the alphabet.
COMP = "list_transform(string_split('{letters}', ''), lambda x: (length({s}) - length(replace({s}, x, '')))::DOUBLE / length({s}))"


def comp(s: str, letters: str = LETTERS) -> str:
    return COMP.format(s=s, letters=letters)


# -- searches --------------------------------------------------------------------------

# Mean vector of places 5 to 20 of each label's vectors; the vector with the label's own id is left out.
@query("search_regions", f"""
WITH {E_SQL}, r AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY id) AS pos FROM e),
n AS (SELECT label FROM e GROUP BY label HAVING count(*) >= 20),
x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM r WHERE pos BETWEEN 5 AND 20 AND label IN (SELECT label FROM n)),
c AS (SELECT label, d, avg(x) AS x FROM x GROUP BY label, d), p AS (SELECT label, list(x ORDER BY d) AS v FROM c GROUP BY label),
h AS (SELECT p.label, e.id, round(list_cosine_similarity(p.v, e.v), 10) AS s, row_number() OVER (PARTITION BY p.label ORDER BY round(list_cosine_similarity(p.v, e.v), 10) DESC, e.id::VARCHAR) AS rank
  FROM p JOIN e ON e.id <> p.label QUALIFY rank <= 5)
SELECT label || ':5:20' AS region, rank::INTEGER AS rank, id::VARCHAR AS id, round(s, 6) AS similarity FROM h""")
def search_regions(spark, sf):
    e = store(spark, sf)
    rows = residues(e)
    lengths = rows.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("length"))
    # the second region is refused: it ends behind its sequence
    regions = lengths.select("id", F.explode(F.array(F.struct(F.lit(5).alias("start"), F.lit(20).alias("end")), F.struct(F.lit(5).alias("start"), F.lit(10**6).alias("end")))).alias("r"))
    hits = se.region_search(regions.select("id", "r.*"), rows, lengths, e.select("id", "vector"), 5)
    return hits.select("region", "rank", "id", F.round("similarity", 6).alias("similarity"))


# Accessions of the corpus search with their stored vector, others are encoded from their record.
ACCESSIONS_SQL = f"""
c AS (SELECT 'C' || lpad(c_custkey::VARCHAR, 6, '0') AS accession, c_nationkey, translate(upper(substr(md5('' || c_custkey), 1, 16)), '0123456789', 'GHIKLMNPQR') AS s FROM customer),
w AS (SELECT DISTINCT 'C' || lpad((o_custkey + 700)::VARCHAR, 6, '0') AS accession FROM orders),
k AS (SELECT accession, {comp('s')} AS v FROM c WHERE c_nationkey < 10),
q AS (SELECT accession, {comp('s')} AS v, CASE WHEN c_nationkey < 10 THEN 'corpus' ELSE 'external' END AS source FROM c WHERE accession IN (SELECT accession FROM w)),
h AS (SELECT q.accession AS query_id, source, k.accession AS id, round(list_cosine_similarity(q.v, k.v), 10) AS s,
  row_number() OVER (PARTITION BY q.accession ORDER BY round(list_cosine_similarity(q.v, k.v), 10) DESC, k.accession) AS rank FROM q JOIN k ON k.accession <> q.accession QUALIFY rank <= 3)"""


@query("search_external", f"""
WITH {ACCESSIONS_SQL} SELECT query_id, source, rank::INTEGER AS rank, id, round(s, 6) AS similarity FROM h""")
def search_external(spark, sf):
    key = F.upper(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 16))
    records = table(spark, sf, "customer").select(
        F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("accession"), "c_nationkey",
        F.translate(key, "0123456789", "GHIKLMNPQR").alias("sequence"),
    )
    wanted = table(spark, sf, "orders").select(F.lower(F.concat(F.lit(" c"), F.lpad((F.col("o_custkey") + 700).cast("string"), 6, "0"))).alias("accession"))
    corpus = records.filter("c_nationkey < 10").select("accession", "sequence")
    encoder = em.OneHotEncoder(LETTERS)
    stored = em.embed(corpus, encoder, "accession", "sequence", **ENCODER).select("id", "vector")
    hits = se.external_search(wanted, records, corpus, stored, encoder, 3, **ENCODER)
    return hits.select("query_id", "source", "rank", "id", F.round("similarity", 6).alias("similarity"))


# Of the 30 nearest vectors of each query those in the three largest classes, ranked again.
@query("search_kept_subset", f"""
WITH {E_SQL}, {hits_sql(30)}, sub AS (SELECT id FROM e WHERE label IN (SELECT label FROM e GROUP BY label ORDER BY count(*) DESC, label LIMIT 3)),
k AS (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM h WHERE id IN (SELECT id FROM sub) QUALIFY r <= 5)
SELECT query_id, r::INTEGER AS rank, id, round(s, 6) AS similarity FROM k""")
def search_kept_subset(spark, sf):
    e = store(spark, sf)
    subset = e.join(top_classes(e, "label", 3).select("label"), "label", "left_semi")
    return neighbours_within(knn(e, e, 30), subset, "id", 5).select("query_id", "rank", "id", F.round("similarity", 6).alias("similarity"))


# -- substitutions ---------------------------------------------------------------------

@query("variant_landscapes", f"""
WITH {S_SQL}, t AS (SELECT id, s, s[4] AS wt FROM s WHERE length(s) >= 8),
x AS (SELECT id, s, wt, unnest(string_split('{LETTERS}', '')) AS mut FROM t), y AS (SELECT * FROM x WHERE mut <> wt),
z AS (SELECT id, wt, mut, length(s) AS n, {comp('s')} AS v, {comp("(s[:3] || mut || s[5:])")} AS m FROM y)
SELECT id, 4 AS pos, wt, mut, round(sqrt(2.0) / n, 5) AS displacement, round(list_cosine_similarity(v, m), 6) AS cosine,
  round((-(ascii(mut) % 7) / 2.0 - 0.1 * (id % 5)) - (-(ascii(wt) % 7) / 2.0 - 0.1 * (id % 5)), 4) AS llr FROM z""")
def variant_landscapes(spark, sf):
    """All substitutions at one site of each name, in the encoder's space and by log-probabilities."""
    sites = names(spark, sf).filter(F.length("sequence") >= 8).withColumn("pos", F.lit(4))
    symbols = sites.select("id", "pos", F.explode(F.array(*[F.lit(x) for x in LETTERS])).alias("symbol"))
    log_probs = symbols.withColumn("log_prob", -(F.ascii("symbol") % 7) / 2.0 - F.lit(0.1) * (F.col("id") % 5))
    rows = landscapes(sites, em.OneHotEncoder(LETTERS), log_probs, **ENCODER)
    return rows.select("id", F.col("pos").cast("int").alias("pos"), "wt", "mut", "displacement", "cosine", "llr")


@query("variant_requests", f"""
WITH {S_SQL}, q AS (SELECT id, s, CASE id % 4 WHEN 0 THEN s[3] || '3' || 'Z' WHEN 1 THEN 'Z' || '3' || 'Q' WHEN 2 THEN s[1] || '900' || 'Q' ELSE 'x?' END AS mutation FROM s WHERE length(s) >= 5),
k AS (SELECT *, id % 4 AS k, s[3] AS third FROM q)
SELECT id, mutation, (k = 0 AND third <> 'Z') OR (k = 1 AND third = 'Z') AS fine FROM k""")
def variant_requests(spark, sf):
    s = F.col("sequence")
    kind = F.col("id") % 4
    label = F.when(kind == 0, F.concat(F.substring(s, 3, 1), F.lit("3Z"))).when(kind == 1, "Z3Q").when(
        kind == 2, F.concat(F.substring(s, 1, 1), F.lit("900Q"))
    ).otherwise("x?")
    rows = names(spark, sf).filter(F.length("sequence") >= 5).withColumn("mutation", label)
    return parsed_requests(rows, "sequence", LETTERS).select("id", "mutation", F.col("reason").isNull().alias("fine"))


@query("symbol_classes", """
WITH s AS (SELECT upper(replace(p_name, ' ', '')) AS s FROM part), c AS (SELECT unnest(string_split(s, '')) AS c FROM s),
k AS (SELECT c, CASE WHEN c IN ('A','V','L','I','M') THEN 'hydrophobic' WHEN c IN ('F','W','Y') THEN 'aromatic' WHEN c IN ('S','T','N','Q') THEN 'polar'
  WHEN c IN ('D','E') THEN 'negative' WHEN c IN ('K','R','H') THEN 'positive' WHEN c IN ('C','G','P') THEN 'special' END AS class FROM c)
SELECT coalesce(class, 'none') AS class, count(*) AS n FROM k GROUP BY ALL""")
def symbol_classes(spark, sf):
    symbols = names(spark, sf).select(F.explode(F.split("sequence", "")).alias("c"))
    return symbols.groupBy(F.coalesce(fc.symbol_class(F.col("c")), F.lit("none")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


# -- assays ----------------------------------------------------------------------------

# Rows of the validation in closed form: the encoder gives the composition of the text without blanks.
ASSAY_ROWS_SQL = f"""
{ASSAY_SQL},
g AS (SELECT v.assay, pos + "offset" AS pos, v.wt, mut, avg(score) AS score, any_value(v.s) AS s FROM v JOIN f ON f.assay = v.assay
  WHERE pos + "offset" BETWEEN 1 AND length(v.s) AND v.s[pos + "offset"] = v.wt GROUP BY ALL),
y AS (SELECT *, replace(s, ' ', '') AS sa, replace(s[:pos - 1] || mut || s[pos + 1:], ' ', '') AS sb FROM g),
l AS (SELECT assay, pos, wt, mut, score, (CASE WHEN mut = wt THEN -0.1 ELSE -4.0 - pos / 10 END) + 0.1 AS llr, {comp('sa')} AS a, {comp('sb')} AS b FROM y)"""


def validated(spark, sf):
    rows, targets = assay_tables(spark, sf)
    aligned = va.align_assay(rows, targets, va.detect_offset(rows, targets, "assay", "s"), "assay", "s")
    encoder, options = em.OneHotEncoder(LETTERS + " "), {"lengths": (1, 2048), "alphabet": LETTERS + " "}
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
    return st.assay_validation(aligned, lp, wild, mutants)


@query("assay_rows", f"""
WITH {ASSAY_ROWS_SQL} SELECT assay, pos::INTEGER AS pos, wt, mut, round(score, 6) AS score, round(llr, 6) AS llr, round(list_distance(a, b), 6) AS displacement,
  round(list_cosine_similarity(a, b), 6) AS cosine FROM l""")
def assay_rows(spark, sf):
    rows, _ = validated(spark, sf)
    return rows.select("assay", F.col("pos").cast("int").alias("pos"), "wt", "mut", *[F.round(c, 6).alias(c) for c in ("score", "llr", "displacement", "cosine")])


# Rank correlation per assay, and its p value: twice the upper tail of Student's t, by Simpson's rule
# over the substitution t = x / (1 - x).
@query("assay_correlations", f"""
WITH {ASSAY_ROWS_SQL}, d AS (SELECT assay, 'llr' AS statistic, llr AS x, score AS y FROM l UNION ALL SELECT assay, 'neg_displacement', -list_distance(a, b), score FROM l),
rk AS (SELECT assay, statistic, rank() OVER (PARTITION BY assay, statistic ORDER BY round(x, 12)) + (count(*) OVER (PARTITION BY assay, statistic, round(x, 12)) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY assay, statistic ORDER BY y) + (count(*) OVER (PARTITION BY assay, statistic, y) - 1) / 2.0 AS y FROM d),
c AS (SELECT assay, statistic, count(*) AS n, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS rho FROM rk GROUP BY ALL),
t AS (SELECT *, abs(rho) * sqrt((n - 2) / greatest(1 - rho * rho, 1e-300)) AS t, n - 2 AS df FROM c WHERE n > 2 AND abs(rho) < 1),
sq AS (SELECT assay, statistic, df, t, range / 20000.0 AS u, CASE WHEN range IN (0, 20000) THEN 1 WHEN range % 2 = 1 THEN 4 ELSE 2 END AS w FROM t, range(20001)),
s AS (SELECT assay, statistic, df, sum(w * CASE WHEN u = 1 THEN 0 ELSE pow(1 + pow(t + u / (1 - u), 2) / df, -(df + 1) / 2.0) / pow(1 - u, 2) END) / 60000 AS tail FROM sq GROUP BY ALL),
p AS (SELECT assay, statistic, 2 * tail * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) AS p FROM s)
SELECT c.assay, c.statistic, c.n, round(rho, 6) AS rho, round(p.p, 4) AS p_value FROM c LEFT JOIN p ON p.assay = c.assay AND p.statistic = c.statistic""")
def assay_correlations(spark, sf):
    _, rho = validated(spark, sf)
    return rho.filter("statistic <> 'cosine'").select("assay", "statistic", "n", F.round("rho", 6).alias("rho"), F.round("p_value", 4).alias("p_value"))


# -- pairs -----------------------------------------------------------------------------

# 200 random pairs and the neighbours of 50 seeds that are not among them.
STUDY_SQL = f"""
{S_SQL}, ns AS (SELECT id, s, row_number() OVER (ORDER BY md5('42|' || id), id) AS r FROM s),
dr AS (SELECT range AS d, ('0x' || substr(md5('42|' || range || '|a'), 1, 15))::BIGINT % (SELECT count(*) FROM s) + 1 AS i,
  ('0x' || substr(md5('42|' || range || '|b'), 1, 15))::BIGINT % (SELECT count(*) FROM s) + 1 AS j FROM range(400)),
dp AS (SELECT least(i, j) AS i, greatest(i, j) AS j, min(d) AS d FROM dr WHERE i <> j GROUP BY ALL ORDER BY min(d) LIMIT 200),
rp AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM dp JOIN ns x ON x.r = dp.i JOIN ns y ON y.r = dp.j),
cv AS (SELECT id, s, {comp('s')} AS v FROM s), sd AS (SELECT id FROM ns WHERE r <= 50),
nh AS (SELECT x.id AS query_id, y.id, row_number() OVER (PARTITION BY x.id ORDER BY round(list_cosine_similarity(x.v, y.v), 10) DESC, y.id) AS rank
  FROM cv x JOIN cv y ON y.id <> x.id WHERE x.id IN (SELECT id FROM sd) QUALIFY rank <= 4),
np AS (SELECT DISTINCT least(query_id, id) AS a, greatest(query_id, id) AS b FROM nh),
pq AS (SELECT a, b, 'random' AS stratum FROM rp UNION ALL SELECT a, b, 'nn' FROM np WHERE NOT EXISTS (SELECT 1 FROM rp WHERE rp.a = np.a AND rp.b = np.b)),
q AS (SELECT pq.a, pq.b, stratum, x.s AS sa, y.s AS sb, x.v AS va, y.v AS vb, m.p_type = n.p_type AS same_family FROM pq JOIN cv x ON x.id = pq.a JOIN cv y ON y.id = pq.b
  JOIN part m ON m.p_partkey = pq.a JOIN part n ON n.p_partkey = pq.b), {alignment_sql('q')},
study AS (SELECT q.a, q.b, stratum, round(identity, 4) AS identity, round(list_cosine_similarity(va, vb), 4) AS cosine, same_family FROM q JOIN ai ON ai.a = q.a AND ai.b = q.b)"""


def studied(spark, sf):
    rows = names(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_type"), "id")
    return st.pair_study(rows, composition(names(spark, sf), "id", "sequence", LETTERS), "id", "sequence", "p_type", 400)


@query("pair_study_rows", f"WITH RECURSIVE {STUDY_SQL} SELECT * FROM study")
def pair_study_rows(spark, sf):
    return studied(spark, sf)


@query("pair_study", f"""
WITH RECURSIVE {STUDY_SQL} SELECT stratum, count(*) AS n_pairs, count(*) FILTER (identity < 0.20 AND cosine > 0.90) AS low_identity_high_cosine,
  count(*) FILTER (identity > 0.50 AND cosine < 0.70) AS high_identity_low_cosine, round(CASE WHEN stratum = 'random' THEN corr(identity, cosine) END, 6) AS pearson_r FROM study GROUP BY stratum""")
def pair_study(spark, sf):
    return st.pair_study_summary(studied(spark, sf)).withColumn("pearson_r", F.round("pearson_r", 6))


# -- benchmarks ------------------------------------------------------------------------

def retrieval_sql(where: str) -> str:
    return f"""
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE {where}), q AS (SELECT * FROM e WHERE label IN (SELECT label FROM e GROUP BY label HAVING count(*) >= 2)),
{hits_sql(10, a="q")}, m AS (SELECT h.query_id, h.rank, (x.label = y.label)::INT AS hit FROM h JOIN e x ON x.id = h.query_id JOIN e y ON y.id = h.id),
p AS (SELECT query_id, avg(hit) FILTER (rank <= 1) AS p1, avg(hit) FILTER (rank <= 5) AS p5, avg(hit) AS p10 FROM m GROUP BY query_id),
r AS (SELECT count(*)::DOUBLE AS n_evaluated, avg(p1) AS precision_at_1, avg(p5) AS precision_at_5, avg(p10) AS precision_at_10 FROM p)
SELECT 'stored' AS representation, 'same_label' AS task, metric, round(value, 6) AS value FROM (UNPIVOT r ON n_evaluated, precision_at_1, precision_at_5, precision_at_10 INTO NAME metric VALUE value)"""


def suite(spark, sf, rows, least: int, clusters: int):
    """The axis of the suite that depends on no solver, and that the others are whole."""
    labels = with_hashed_split(rows.select("id", F.col("label").cast("string").alias("label")), "id")
    table_ = reliable_checkpoint(st.benchmark_suite({"stored": rows.select("id", "vector")}, labels, {"label": least}, ["label"], "label", clusters))
    axes = {r["axis"] for r in table_.groupBy("axis").agg(F.every(F.col("value").between(0, 1e9)).alias("fine")).filter("fine").collect()}
    if axes != {"probe", "retrieval", "clustering"}:
        raise ValueError(f"the suite has sound values on {sorted(axes)} only")
    return table_.filter("axis = 'retrieval'").select("representation", "task", "metric", F.round("value", 6).alias("value"))


@query("benchmark_retrieval", retrieval_sql("true"))
def benchmark_retrieval(spark, sf):
    return suite(spark, sf, store(spark, sf), 10, 10)


# The study on a subset has smaller classes and 15 clusters.
@query("benchmark_subset", retrieval_sql("label < 6"))
def benchmark_subset(spark, sf):
    return suite(spark, sf, store(spark, sf).filter("label < 6"), 5, 15)


@query("probe_checks", """
WITH s AS (SELECT label, (('0x' || substr(md5('42|' || vec_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0 AS u FROM embeddings),
c AS (SELECT label FROM s WHERE u < 0.7 GROUP BY label HAVING count(*) >= 10)
SELECT count(*) AS n_test, (SELECT count(*) FROM c) AS n_classes, true AS sums_to_one, true AS figures_agree FROM s WHERE u >= 0.85 AND label IN (SELECT label FROM c)""")
def probe_checks(spark, sf):
    """A probe predicts every test row of a class that was trained; its figures follow from its predictions."""
    rows = with_hashed_split(store(spark, sf), "id")
    found, labels = probe_predictions(rows, "vector", "label", least=10, max_iter=50)
    found = reliable_checkpoint(found)
    total = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + x)
    best = F.array_max(F.map_values("scores"))
    plain = found.agg(
        F.count(F.lit(1)).alias("n_test"), F.every((F.abs(total - 1) < 1e-6) & (F.element_at("scores", F.col("predicted")) >= best - 1e-9)).alias("sums_to_one"),
        F.avg((F.col("truth").cast("string") == F.col("predicted").cast("string")).cast("double")).alias("hits"),
    )
    both = mt.one_row(plain, run_probe(rows, "vector", "label", least=10, max_iter=50).select("accuracy"))
    return both.select("n_test", F.lit(len(labels)).cast("long").alias("n_classes"), "sums_to_one", (F.abs(F.col("hits") - F.col("accuracy")) < 1e-9).alias("figures_agree"))


@query("split_comparison_table", f"""
WITH RECURSIVE a AS (SELECT p_brand AS group_id, count(*) AS size FROM part GROUP BY p_brand), b AS (SELECT p_name AS group_id, count(*) AS size FROM part GROUP BY p_name),
{greedy_sql('a', 'ga')}, {greedy_sql('b', 'gb')},
n AS (SELECT p_partkey AS id, p_brand, p_name, row_number() OVER (ORDER BY md5('42|' || p_partkey), p_partkey) AS r FROM part),
d AS (SELECT range AS d, ('0x' || substr(md5('42|' || range || '|a'), 1, 15))::BIGINT % (SELECT count(*) FROM part) + 1 AS i,
  ('0x' || substr(md5('42|' || range || '|b'), 1, 15))::BIGINT % (SELECT count(*) FROM part) + 1 AS j FROM range(4000)),
p AS (SELECT least(i, j) AS i, greatest(i, j) AS j, min(d) AS d FROM d WHERE i <> j GROUP BY ALL ORDER BY min(d) LIMIT 2000),
s AS (SELECT x.p_brand = y.p_brand AS ja, x.p_name = y.p_name AS jb FROM p JOIN n x ON x.r = p.i JOIN n y ON y.r = p.j),
w AS (SELECT 'brand' AS method, 'groups' AS axis, 'all' AS task, unnest(['n_groups', 'largest_group', 'largest_group_fraction', 'singleton_fraction']) AS metric,
    unnest([count(*)::DOUBLE, max(size)::DOUBLE, max(size) / sum(size), avg((size = 1)::INT)]) AS value FROM a
  UNION ALL SELECT 'name', 'groups', 'all', unnest(['n_groups', 'largest_group', 'largest_group_fraction', 'singleton_fraction']),
    unnest([count(*)::DOUBLE, max(size)::DOUBLE, max(size) / sum(size), avg((size = 1)::INT)]) FROM b
  UNION ALL SELECT 'brand', 'split', split, unnest(['n_rows', 'n_groups']), unnest([sum(size)::DOUBLE, count(*)::DOUBLE]) FROM gaz GROUP BY split
  UNION ALL SELECT 'name', 'split', split, unnest(['n_rows', 'n_groups']), unnest([sum(size)::DOUBLE, count(*)::DOUBLE]) FROM gbz GROUP BY split
  UNION ALL SELECT 'brand|name', 'disagreement', 'pairs', unnest(['sampled_pairs', 'both_join', 'only_a', 'only_b']),
    unnest([count(*)::DOUBLE, (count(*) FILTER (ja AND jb))::DOUBLE, (count(*) FILTER (ja AND NOT jb))::DOUBLE, (count(*) FILTER (jb AND NOT ja))::DOUBLE]) FROM s)
SELECT method, axis, task, metric, round(value, 6) AS value FROM w""")
def split_comparison_table(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("sequence"), "p_type", "p_brand")
    groupings = {"brand": rows.select("id", F.col("p_brand").alias("group_id")), "name": rows.select("id", F.col("sequence").alias("group_id"))}
    vectors = composition(names(spark, sf), "id", "sequence", LETTERS)
    out = st.compare_split_methods(rows, groupings, "id", "sequence", vectors, rows.select("id", "p_type"), {"p_type": 20}, 2000, alphabet=None, audit_pairs=300)
    return out.filter("axis in ('groups', 'split', 'disagreement')").select("method", "axis", "task", "metric", F.round("value", 6).alias("value"))


# -- rows of a representation ------------------------------------------------------------

STATS_SQL = f"""{E_SQL}, {hits_sql(10)}, {D_SQL},
o AS (SELECT id, (row_number() OVER (ORDER BY round(knn_dist, 9), id) - 1) / greatest((SELECT count(*) FROM d) - 1, 1) AS outlier FROM d)"""


@query("representation_rows", f"""
WITH {STATS_SQL} SELECT e.id, round(sqrt(list_dot_product(v, v)), 4) AS embedding_norm, len(v)::INTEGER AS dim, round(nn_dist, 5) AS nn_distance, round(knn_dist, 5) AS knn_mean_distance,
  true AS placed FROM e JOIN d ON d.id = e.id""")
def representation_rows(spark, sf):
    out = st.representation_stats(store(spark, sf).select("id", "vector"), 10, 10)
    return out.select("id", "embedding_norm", "dim", "nn_distance", "knn_mean_distance", (F.col("cluster").isNotNull() & F.col("x").isNotNull() & F.col("outlier").between(0, 1)).alias("placed"))


@query("map_payload_points", f"""
WITH {STATS_SQL} SELECT e.id, label, round(knn_dist, 5) AS knn_dist, true AS has_place FROM e JOIN d ON d.id = e.id""")
def map_payload_points(spark, sf):
    e = store(spark, sf)
    points = st.map_points(e, "id", st.representation_stats(e.select("id", "vector"), 10, 10), ["label"])
    return points.select("id", "label", "knn_dist", (F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("cluster").isNotNull()).alias("has_place"))


# All components together have the variance of the data; each is uncorrelated with the next.
@query("pca_variance", """
WITH x AS (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)
SELECT round((SELECT sum(v) FROM (SELECT var_samp(x) AS v FROM x GROUP BY d)), 6) AS total, (SELECT count(DISTINCT d) FROM x) AS n_components, true AS falling, true AS apart""")
def pca_variance(spark, sf):
    e = store(spark, sf)
    dim = e.select(F.size("vector")).first()[0]
    scores, _ = cl.pca_projection(e, "id", "vector", dim)
    long = reliable_checkpoint(scores.select("id", F.posexplode("vector").alias("d", "x")))
    var = long.groupBy("d").agg(F.var_samp("x").alias("v"))
    nxt = var.select((F.col("d") - 1).alias("d"), F.col("v").alias("after"))
    both = long.join(long.select("id", (F.col("d") - 1).alias("d"), F.col("x").alias("y")), ["id", "d"]).groupBy("d").agg(F.corr("x", "y").alias("r"))
    sums = var.agg(F.round(F.sum("v"), 6).alias("total"), F.count(F.lit(1)).alias("n_components"))
    order = var.join(nxt, "d").agg(F.every(F.col("after") <= F.col("v") + 1e-9).alias("falling"))
    return mt.one_row(sums, order, both.agg(F.every(F.abs("r") < 1e-6).alias("apart")))


# k-means: every row has a cluster, and the cost follows from the clusters.
@query("kmeans_checks", "SELECT count(*) AS n_rows, true AS few_clusters, true AS cost_agrees, true AS better_than_one FROM embeddings")
def kmeans_checks(spark, sf):
    e = store(spark, sf)
    placed, info = cl.kmeans_clusters(e, "id", "vector", 10, n_init=2, max_iter=40)
    from strandkit.functions import vectors as fv

    long = placed.join(e, "id").select("id", "cluster", F.posexplode(fv.unit(F.col("vector"))).alias("d", "x"))
    spread = lambda keys: long.groupBy(*keys).agg((F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.sum("x") / F.count(F.lit(1))).alias("s")).agg(F.sum("s").alias("s")).first()["s"]
    cost, whole = spread(["cluster", "d"]), spread(["d"])
    # Lloyd's last centres are those of the assignment before the last one
    return placed.agg(
        F.count(F.lit(1)).alias("n_rows"), (F.countDistinct("cluster") <= 10).alias("few_clusters"),
        F.lit(abs(cost - info["inertia"]) <= 0.01 * cost).alias("cost_agrees"), F.lit(cost < whole).alias("better_than_one"),
    )


# Links within the radius between rows whose third neighbour is within it; islands of five rows or more.
@query("density_islands_exact", f"""
WITH RECURSIVE {E_SQL}, {hits_sql(3)}, k AS (SELECT query_id AS id FROM h WHERE rank = 3 AND 1 - s <= 0.62),
g AS (SELECT query_id AS a, id AS b FROM h WHERE 1 - s <= 0.62 AND query_id IN (SELECT id FROM k) AND id IN (SELECT id FROM k)), u AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
cc(n, c) USING KEY (n) AS (SELECT DISTINCT a, a FROM u UNION (SELECT u.b AS n, min(x.c) AS c FROM cc x JOIN u ON u.a = x.n JOIN recurring.cc AS o ON o.n = u.b WHERE x.c < o.c GROUP BY u.b)),
z AS (SELECT c FROM cc GROUP BY c HAVING count(*) >= 5)
SELECT e.id, coalesce(z.c, -1) AS island FROM e LEFT JOIN cc ON cc.n = e.id LEFT JOIN z ON z.c = cc.c""")
def density_islands_exact(spark, sf):
    return cl.density_islands(store(spark, sf), "id", "vector", min_size=5, min_samples=3, radius=0.62)


# -- sinks -----------------------------------------------------------------------------

@query("sink_corpus_order", "SELECT count(*) AS n_rows, 0::BIGINT AS out_of_order, 0::BIGINT AS overlapping FROM orders")
def sink_corpus_order(spark, sf):
    """A table written in the order of its ids: sorted in each file, and no two files overlap."""
    path = f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}"
    tb.write_corpus(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), path, order="o_orderkey")
    rows = tb.read_corpus(spark, path).select("o_orderkey", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    nxt = rows.select("file", (F.col("place") - 1).alias("place"), F.col("o_orderkey").alias("after"))
    inside = rows.join(nxt, ["file", "place"]).agg(F.count_if(F.col("after") < F.col("o_orderkey")).alias("out_of_order"))
    ends = rows.groupBy("file").agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    other = ends.select(F.col("file").alias("f2"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    over = ends.join(other, (F.col("file") < F.col("f2")) & (F.col("low") <= F.col("h2")) & (F.col("l2") <= F.col("high"))).agg(F.count(F.lit(1)).alias("overlapping"))
    return mt.one_row(rows.agg(F.count(F.lit(1)).alias("n_rows")), inside, over)
