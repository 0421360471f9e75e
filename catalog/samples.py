"""Sampling operators over the shared tables; SQL uses the same md5 order."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, table
from strandkit.operators import sampling as sa
from strandkit.operators.metrics import eligible_queries

FRAC = "((('0x' || substr(md5('42|' || {k}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0)"


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


@query("sample_cap_group", """
WITH d AS (SELECT doc_id, CASE WHEN lang = 'es' THEN NULL ELSE lang END AS lang, n_chars > 20000 AS keep FROM documents),
p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS r FROM d WHERE lang IS NOT NULL AND NOT keep),
h AS (SELECT lang, count(*) AS h FROM d WHERE keep GROUP BY lang)
SELECT doc_id, lang FROM d WHERE lang IS NULL OR keep
UNION ALL SELECT p.doc_id, p.lang FROM p LEFT JOIN h ON h.lang = p.lang WHERE r <= 80 - coalesce(h.h, 0)""")
def sample_cap_group(spark, sf):
    d = docs(spark, sf).withColumn("lang", F.when(F.col("lang") != "es", F.col("lang")))
    return sa.cap_per_group(d, "lang", 80, "doc_id", F.col("n_chars") > 20000).select("doc_id", "lang")


# A cap above the number of rows that Spark limits inside map tasks.
@query("sample_cap_large", """
SELECT l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('42|' || l_orderkey || ':' || l_linenumber), l_orderkey || ':' || l_linenumber) AS r FROM lineitem) WHERE r <= 1500""")
def sample_cap_large(spark, sf):
    l = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber").withColumn("key", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    return sa.cap_per_group(l, "l_returnflag", 1500, "key", F.lit(False)).select("l_returnflag", "l_orderkey", "l_linenumber")


@query("sample_proportional", """
WITH d AS (SELECT doc_id, source, n_chars > 20000 AS keep FROM documents), t AS (SELECT count(*) AS t FROM d),
n AS (SELECT source, count(*) AS n FROM d GROUP BY source),
p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS r FROM d WHERE NOT keep)
SELECT doc_id, source FROM d WHERE keep
UNION ALL SELECT doc_id, p.source FROM p JOIN n ON n.source = p.source, t WHERE r <= greatest(1, round_even(n * (300.0 / t), 0))""")
def sample_proportional(spark, sf):
    return sa.proportional_sample(docs(spark, sf), "source", 300, "doc_id", F.col("n_chars") > 20000).select("doc_id", "source")


@query("sample_weighted", f"""
WITH d AS (SELECT doc_id, source, n_chars > 20000 AS keep, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 3.0 ELSE 1.0 END AS w FROM documents),
p AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n,
  row_number() OVER (PARTITION BY source ORDER BY 1 - pow({FRAC.format(k='doc_id')}, 1 / w), doc_id) AS r FROM d WHERE NOT keep)
SELECT doc_id, source FROM d WHERE keep
UNION ALL SELECT doc_id, source FROM p WHERE r <= greatest(1, round_even(n * ((250 - (SELECT count(*) FROM d WHERE keep)) / (SELECT count(*) FROM d)), 0))""")
def sample_weighted(spark, sf):
    marked = table(spark, sf, "labels").select("doc_id", F.lit(3.0).alias("w")).distinct()
    d = docs(spark, sf).join(marked, "doc_id", "left")
    return sa.weighted_stratified_sample(
        d, "source", F.coalesce("w", F.lit(1.0)), 250, "doc_id", F.col("n_chars") > 20000
    ).select("doc_id", "source")


@query("sample_bundle_subset", """
WITH g AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 12),
d AS (SELECT p_partkey, p_type, p_brand IN (SELECT p_brand FROM g) OR p_size = 50 AS fixed FROM part),
c AS (SELECT count(*) FILTER (fixed) AS f, count(*) FILTER (NOT fixed) AS r FROM d),
p AS (SELECT p_partkey, p_type, count(*) OVER (PARTITION BY p_type) AS n, row_number() OVER (PARTITION BY p_type ORDER BY md5('42|' || p_partkey), p_partkey) AS k FROM d WHERE NOT fixed)
SELECT p_partkey, p_type FROM d WHERE fixed
UNION ALL SELECT p_partkey, p_type FROM p, c WHERE (1500 - f) > 0 AND k <= greatest(1, round_even(n * ((1500 - f) / r), 0))""")
def sample_bundle_subset(spark, sf):
    return sa.bundle_subset(table(spark, sf, "part"), "p_brand", "p_type", 1500, "p_partkey", F.col("p_size") == 50).select("p_partkey", "p_type")


@query("sample_training_pool", """
WITH c AS (SELECT source FROM documents GROUP BY source HAVING count(*) >= 8 ORDER BY count(*) DESC, source LIMIT 12)
SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM c)
QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) <= 20""")
def sample_training_pool(spark, sf):
    return sa.training_pool(docs(spark, sf), "source", "doc_id", 8, 12, 20).select("doc_id", "source")


@query("sample_holdout", """
WITH r AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents)
SELECT doc_id, lang, r <= greatest(1, round_even(n * 0.15, 0)) AS holdout FROM r""")
def sample_holdout(spark, sf):
    return sa.stratified_holdout(docs(spark, sf), "lang", "doc_id").select("doc_id", "lang", "holdout")


def permuted_sql(seed: int, bound: str, position: str, keys: str, rounds: int = 24) -> str:
    """The swap-or-not shuffle of ``functions.columns.permuted``."""
    def index(s, n, k):
        return f"(('0x' || substr(md5('{s}|' || {k}), 1, 15))::BIGINT % {n})"

    other = f"(({index(seed, bound, keys + ' || chr(124) || r')} - x) % {bound} + {bound}) % {bound}"
    flip = index(seed + 1, 2, f"{keys} || '|' || r || '|' || greatest(x, {other})")
    return f"list_reduce(list_concat([({position})::BIGINT], range(1, {rounds + 1})), lambda x, r: CASE WHEN {flip} = 1 THEN {other} ELSE x END)"


@query("sample_batches", f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 2),
c AS (SELECT source, n, row_number() OVER (ORDER BY {FRAC.format(k='source')}, source) AS c, count(*) OVER () AS k FROM n),
m AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents WHERE source IN (SELECT source FROM n)),
b AS (SELECT b.range AS batch, i.range AS i, (SELECT count(*) FROM n) AS k FROM range(20) b, range(3) i),
q AS (SELECT batch, {permuted_sql(42, 'k', 'i', 'batch')} + 1 AS c FROM b WHERE i < k),
d AS (SELECT batch, c.source, c.n FROM q JOIN c USING (c)),
x AS (SELECT batch, source, {permuted_sql(44, 'n', 'j.range', "batch || '|' || source")} + 1 AS r FROM d, range(4) j WHERE j.range < n)
SELECT batch, x.source, m.doc_id FROM x JOIN m ON m.source = x.source AND m.r = x.r""")
def sample_batches(spark, sf):
    return sa.balanced_batches(docs(spark, sf), "source", "doc_id", 20, classes=3)


@query("sample_random_pairs", """
WITH n AS (SELECT vec_id AS id, row_number() OVER (ORDER BY md5('42|' || vec_id), vec_id) AS r, count(*) OVER () AS n FROM embeddings),
d AS (SELECT range AS d, ('0x' || substr(md5('42|' || range || '|a'), 1, 15))::BIGINT % (SELECT count(*) FROM embeddings) + 1 AS i,
  ('0x' || substr(md5('42|' || range || '|b'), 1, 15))::BIGINT % (SELECT count(*) FROM embeddings) + 1 AS j FROM range(2000)),
p AS (SELECT least(i, j) AS i, greatest(i, j) AS j, min(d) AS d FROM d WHERE i <> j GROUP BY ALL ORDER BY min(d) LIMIT 1000)
SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM p JOIN n x ON x.r = p.i JOIN n y ON y.r = p.j""")
def sample_random_pairs(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return sa.random_pairs(e, "id", 1000)


SPLIT_SQL = "CASE WHEN " + FRAC.format(k="doc_id") + " < 0.7 THEN 'train' WHEN " + FRAC.format(k="doc_id") + " < 0.85 THEN 'val' ELSE 'test' END"


def with_hashed_split(df, ident):
    from strandkit.functions.columns import hash_fraction

    f = hash_fraction(42, F.col(ident))
    return df.withColumn("split", F.when(f < 0.7, "train").when(f < 0.85, "val").otherwise("test"))


SPLIT_PAIRS_SQL = f"""
s AS (SELECT doc_id AS id, {SPLIT_SQL} AS split FROM documents),
r AS (SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY md5('42|' || id), id) AS r, count(*) OVER (PARTITION BY split) AS n FROM s),
z AS (SELECT split, any_value(n) AS n FROM r GROUP BY split),
d AS (SELECT p.range AS pair, k.* FROM range(500) p, (VALUES ('cross', 'train', 'test'), ('train', 'train', 'train')) k(stratum, sa, sb)),
q AS (SELECT stratum, pair, sa, sb, ('0x' || substr(md5('42|' || stratum || '|' || pair || '|a'), 1, 15))::BIGINT % za.n + 1 AS ra,
  ('0x' || substr(md5('42|' || stratum || '|' || pair || '|b'), 1, 15))::BIGINT % zb.n + 1 AS rb FROM d JOIN z za ON za.split = sa JOIN z zb ON zb.split = sb),
pairs AS (SELECT stratum, pair, x.id AS a, y.id AS b FROM q JOIN r x ON x.split = sa AND x.r = ra JOIN r y ON y.split = sb AND y.r = rb)"""


@query("sample_split_pairs", f"WITH {SPLIT_PAIRS_SQL} SELECT * FROM pairs")
def sample_split_pairs(spark, sf):
    return sa.split_pairs(with_hashed_split(docs(spark, sf), "doc_id"), "split", "doc_id", 500)


@query("sample_substituted_pairs", """
WITH p AS (SELECT p_partkey, upper(replace(p_name, ' ', '')) AS s FROM part),
x AS (SELECT *, (('0x' || substr(md5('42|' || p_partkey || '|pos'), 1, 15))::BIGINT % length(s) + 1)::INTEGER AS pos FROM p),
y AS (SELECT *, replace('ACDEFGHIKLMNPQRSTVWY', substr(s, pos, 1), '') AS alt FROM x)
SELECT p_partkey, pos, s AS wild, substr(s, 1, pos - 1) || substr(alt, (('0x' || substr(md5('42|' || p_partkey || '|mut'), 1, 15))::BIGINT % length(alt) + 1)::INTEGER, 1) || substr(s, pos + 1) AS mutated FROM y""")
def sample_substituted_pairs(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("s"))
    return sa.substituted_pairs(p, "p_partkey", "s")


@query("sample_trainable_labels", f"""
WITH s AS (SELECT doc_id, source, {SPLIT_SQL} AS split FROM documents), c AS (SELECT source FROM s WHERE split = 'train' GROUP BY source HAVING count(*) >= 36)
SELECT doc_id, source, split FROM s WHERE source IN (SELECT source FROM c)""")
def sample_trainable_labels(spark, sf):
    d = with_hashed_split(docs(spark, sf).select("doc_id", "source"), "doc_id")
    return sa.trainable_labels(d, "split", "source", 36).select("doc_id", "source", "split")


@query("sample_eligible_queries", """
WITH p AS (SELECT p_partkey, CASE WHEN p_size > 30 THEN NULL ELSE p_name || p_brand END AS label FROM part)
SELECT p_partkey, label FROM p WHERE label IN (SELECT label FROM p WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 2)""")
def sample_eligible_queries(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") <= 30, F.concat("p_name", "p_brand")).alias("label"))
    return eligible_queries(p, "label").select("p_partkey", "label")


@query("sample_missing_requests", """
WITH w AS (SELECT DISTINCT o_custkey + 500 AS c_custkey FROM orders), h AS (SELECT c_custkey FROM customer WHERE c_nationkey < 12)
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT c_custkey FROM h) THEN 'present' WHEN c_custkey IN (SELECT c_custkey FROM customer) THEN 'found' ELSE 'not_found' END AS state FROM w""")
def sample_missing_requests(spark, sf):
    wanted = table(spark, sf, "orders").select((F.col("o_custkey") + 500).alias("c_custkey"))
    customer = table(spark, sf, "customer")
    return sa.missing_requests(wanted, customer.filter("c_nationkey < 12"), customer, "c_custkey")


@query("sample_downsample", "SELECT doc_id, lang FROM documents ORDER BY md5('0|' || doc_id), doc_id LIMIT 400")
def sample_downsample(spark, sf):
    return sa.downsample(docs(spark, sf), 400, "doc_id").select("doc_id", "lang")


@query("sample_discordant", """
WITH p AS (SELECT l_returnflag, l_discount * 10 AS i, l_quantity / 50 AS c FROM lineitem)
SELECT l_returnflag, count(*) FILTER (i < 0.2 AND c > 0.9) AS low_identity_high_cosine, count(*) FILTER (i > 0.5 AND c < 0.7) AS high_identity_low_cosine FROM p GROUP BY l_returnflag""")
def sample_discordant(spark, sf):
    p = table(spark, sf, "lineitem").select(
        "l_returnflag", (F.col("l_discount") * 10).alias("identity"), (F.col("l_quantity") / 50).alias("cosine")
    )
    high, low = sa.discordant()
    return p.groupBy("l_returnflag").agg(
        F.count_if(high).alias("low_identity_high_cosine"), F.count_if(low).alias("high_identity_low_cosine")
    )
