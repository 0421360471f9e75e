"""Pooling, embedding jobs, substitutions, assays and trajectories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalog.base import alignment_sql, query, table
from catalog.vectors import residues, store
from strandkit import constants as C
from strandkit.functions import columns as fc
from strandkit.functions import vectors as fv
from strandkit.operators import aggregates as ag
from strandkit.operators import embed as em
from strandkit.operators import kmers as km
from strandkit.operators import metrics as mt
from strandkit.operators import pooling as po
from strandkit.operators import variants as va
from strandkit.operators.align import pair_identity
from strandkit.operators.sampling import random_pairs
from strandkit.plans.effects import substitution_effects, trajectories

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
AA = C.AMINO_ACIDS

RES_SQL = "r AS (SELECT label::BIGINT AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos, embedding::DOUBLE[] AS v FROM embeddings)"
DIM_SQL = "x AS (SELECT id, pos, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM r)"


def dims(df, *keys):
    """Long form of pooled vectors for comparison: one row per dimension."""
    return df.select(*keys, F.posexplode("vector").alias("p", "x")).select(
        *keys, (F.col("p") + 1).cast("long").alias("d"), F.round("x", 6).alias("x")
    )


@query("pool_mean", f"WITH {RES_SQL}, {DIM_SQL} SELECT id, d, round(avg(x), 6) AS x FROM x GROUP BY id, d")
def pool_mean(spark, sf):
    return dims(po.mean_pool(residues(store(spark, sf)), ["id"]), "id")


@query("pool_max", f"WITH {RES_SQL}, {DIM_SQL} SELECT id, d, round(max(x), 6) AS x FROM x GROUP BY id, d")
def pool_max(spark, sf):
    return dims(po.max_pool(residues(store(spark, sf)), ["id"]), "id")


@query("pool_region", f"""
WITH {RES_SQL}, {DIM_SQL}, g AS (SELECT DISTINCT id, 3 AS start, 12 AS "end" FROM r UNION ALL SELECT DISTINCT id, 20, 40 FROM r)
SELECT x.id, start, "end", d, round(avg(x), 6) AS x FROM x JOIN g ON g.id = x.id AND pos BETWEEN start AND "end" GROUP BY ALL""")
def pool_region(spark, sf):
    r = residues(store(spark, sf))
    regions = r.select("id").distinct().select("id", F.explode(F.array(
        F.struct(F.lit(3).alias("start"), F.lit(12).alias("end")), F.struct(F.lit(20).alias("start"), F.lit(40).alias("end"))
    )).alias("g")).select("id", "g.*")
    return dims(po.region_pool(r, regions), "id", "start", "end")


WEIGHTS = po.AttentionWeights(
    w1=np.array([[((h + 1) * (d + 1) % 7 - 3) / 10 for d in range(64)] for h in range(3)]),
    b1=np.array([0.1, -0.2, 0.3]), w2=np.array([1.5, -2.0, 0.7]),
)
SCORE_SQL = " + ".join(
    f"{w} * tanh(list_sum(list_transform(v, lambda x, i: x * ((({h + 1} * i) % 7) - 3) / 10.0)) + {b})"
    for h, (w, b) in enumerate(zip((1.5, -2.0, 0.7), (0.1, -0.2, 0.3)))
)
ATT_SQL = f"a AS (SELECT id, pos, v, exp({SCORE_SQL}) AS e FROM r), w AS (SELECT id, pos, v, e / sum(e) OVER (PARTITION BY id) AS w FROM a)"


@query("pool_attention", f"""
WITH {RES_SQL}, {ATT_SQL}, x AS (SELECT id, w, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM w) SELECT id, d, round(sum(w * x), 6) AS x FROM x GROUP BY id, d""")
def pool_attention(spark, sf):
    return dims(po.attention_pool(residues(store(spark, sf)), ["id"], WEIGHTS), "id")


@query("pool_attention_masked", f"""
WITH {RES_SQL}, m AS (SELECT * FROM r WHERE v[1] > 0), a AS (SELECT id, pos, v, exp({SCORE_SQL}) AS e FROM m),
w AS (SELECT id, v, e / sum(e) OVER (PARTITION BY id) AS w FROM a), x AS (SELECT id, w, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM w)
SELECT id, d, round(sum(w * x), 6) AS x FROM x GROUP BY id, d""")
def pool_attention_masked(spark, sf):
    r = residues(store(spark, sf)).withColumn("seen", F.col("vector")[0] > 0)
    return dims(po.attention_pool(r, ["id"], WEIGHTS, mask="seen"), "id")


@query("attention_profile", f"WITH {RES_SQL}, {ATT_SQL} SELECT id, pos::INTEGER AS pos, round(w, 6) AS weight FROM w")
def attention_profile(spark, sf):
    return po.attention_profile(residues(store(spark, sf)), ["id"], WEIGHTS).withColumn("weight", F.round("weight", 6))


@query("attention_top_positions", f"""
WITH {RES_SQL}, {ATT_SQL} SELECT id, pos::INTEGER AS pos, (row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, pos))::INTEGER AS rank FROM w QUALIFY rank <= 10""")
def attention_top_positions(spark, sf):
    profile = po.attention_profile(residues(store(spark, sf)), ["id"], WEIGHTS).withColumn("weight", F.round("weight", 9))
    return po.top_positions(profile, ["id"]).select("id", "pos", "rank")


@query("pool_all_strategies", f"""
WITH {RES_SQL}, z AS (SELECT id, pos - 1 AS pos, v FROM r), x AS (SELECT id, pos, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM z)
SELECT id, 'mean' AS pooling, d, round(avg(x), 6) AS x FROM x WHERE pos > 0 GROUP BY ALL
UNION ALL SELECT id, 'max', d, round(max(x), 6) FROM x WHERE pos > 0 GROUP BY ALL
UNION ALL SELECT id, 'bos', d, round(x, 6) FROM x WHERE pos = 0""")
def pool_all_strategies(spark, sf):
    r = residues(store(spark, sf)).withColumn("pos", F.col("pos") - 1)
    return dims(po.pool_all(r, ("mean", "max", "bos")), "id", "pooling")


@query("residue_norms", f"WITH {RES_SQL} SELECT id, pos::INTEGER AS pos, round(sqrt(list_dot_product(v, v)), 4) AS norm FROM r")
def residue_norms(spark, sf):
    return po.residue_norms(residues(store(spark, sf)))


# -- the embedding job --------------------------------------------------------------

S_SQL = "s AS (SELECT p_partkey AS id, upper(replace(p_name, ' ', '')) AS s FROM part)"


def names(spark, sf, *others):
    """Part names without blanks, as short sequences over the Latin letters, and other columns of the rows."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("sequence"), *others
    )


@query("embed_composition", f"""
WITH {S_SQL}, a AS (SELECT id, s, unnest(string_split('{LETTERS}', '')) AS c FROM s)
SELECT id, (strpos('{LETTERS}', c))::BIGINT AS d, round((length(s) - length(replace(s, c, ''))) / length(s), 6) AS x FROM a""")
def embed_composition(spark, sf):
    v = em.embed(names(spark, sf), em.OneHotEncoder(LETTERS), lengths=(1, 2048), alphabet=LETTERS)
    return dims(v, "id")


@query("embed_hashing_documents")
def embed_hashing_documents(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace(F.upper("text"), "[^A-Z]", "").alias("sequence"))
    v = em.embed(d, em.HashingEncoder(16), poolings=("mean", "max", "bos"), lengths=(1, 1000000), alphabet=LETTERS)
    return v.select("id", "pooling", F.size("vector").alias("dim"))


@query("embed_cache", f"""
WITH {S_SQL}, k AS (SELECT id, s, sha256('one_hot|mean|v1|-|' || s) AS key FROM s), c AS (SELECT DISTINCT key FROM k JOIN part ON p_partkey = k.id WHERE p_size <= 10)
SELECT id, key, key IN (SELECT key FROM c) AS cache_hit FROM k""")
def embed_cache(spark, sf):
    encoder = em.OneHotEncoder(LETTERS)
    rows = names(spark, sf)
    small = table(spark, sf, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("id"))
    options = {"lengths": (1, 2048), "alphabet": LETTERS}
    empty = spark.createDataFrame([], "key string, vector array<double>, written long")
    _, fresh = em.embed_with_cache(rows.join(small, "id", "left_semi"), empty, encoder, **options)
    cache = fresh.withColumn("written", F.lit(1).cast("long"))
    result, _ = em.embed_with_cache(rows, cache, encoder, **options)
    return result.select("id", "key", "cache_hit")


@query("embed_cache_latest", """
SELECT user_id::VARCHAR AS key, round(arg_max(value, event_id), 6) AS x FROM events GROUP BY user_id""")
def embed_cache_latest(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("key"), F.array("value").alias("vector"), F.col("event_id").alias("written")
    )
    return em.latest_vectors(e).select("key", F.round(F.col("vector")[0], 6).alias("x"))


# -- labels and checks ----------------------------------------------------------------

@query("variant_parse_labels", """
WITH l AS (SELECT l_orderkey, l_linenumber, ' ' || lower(l_returnflag) || l_suppkey || CASE WHEN l_discount > 0.08 THEN 'Z' WHEN l_discount > 0.06 THEN '' ELSE upper(l_linestatus) END AS t FROM lineitem),
p AS (SELECT *, upper(trim(t)) AS u FROM l)
SELECT l_orderkey, l_linenumber, CASE WHEN m THEN u[1] END AS wt, CASE WHEN m THEN u[2:-2]::INTEGER END AS pos, CASE WHEN m THEN u[-1] END AS mut,
  CASE WHEN NOT m THEN 'unparsed' WHEN strpos('ACDEFGHIKLMNPQRSTVWY', u[1]) = 0 THEN 'wild-type symbol' WHEN strpos('ACDEFGHIKLMNPQRSTVWY', u[-1]) = 0 THEN 'mutant symbol' END AS reason
FROM (SELECT *, regexp_full_match(u, '[A-Z][0-9]+[A-Z]') AS m FROM p)""")
def variant_parse_labels(spark, sf):
    l = table(spark, sf, "lineitem")
    text = F.concat(
        F.lit(" "), F.lower("l_returnflag"), F.col("l_suppkey").cast("string"),
        F.when(F.col("l_discount") > 0.08, "Z").when(F.col("l_discount") > 0.06, "").otherwise(F.upper("l_linestatus")),
    )
    return l.select("l_orderkey", "l_linenumber", fc.substitution(text).alias("m")).select("l_orderkey", "l_linenumber", "m.*")


CODES = list(C.THREE_LETTER_CODES.items())
CODES_SQL = "['" + "', '".join(k for k, _ in CODES) + "']"
ONES_SQL = "['" + "', '".join(v for _, v in CODES) + "']"


@query("variant_parse_hgvs", f"""
WITH e AS (SELECT event_id, (user_id % 20) + 1 AS i, (event_id // 7 % 21) + 1 AS j, event_id % 300 + 1 AS pos FROM events),
t AS (SELECT event_id, 'p.' || ({CODES_SQL})[i] || pos || CASE WHEN j = 21 THEN 'Ter' ELSE ({CODES_SQL})[j] END AS hgvs, i, j, pos FROM e)
SELECT event_id, hgvs, CASE WHEN i <> j AND j <= 20 THEN ({ONES_SQL})[i] END AS wt, CASE WHEN i <> j AND j <= 20 THEN pos::INTEGER END AS pos,
  CASE WHEN i <> j AND j <= 20 THEN ({ONES_SQL})[j] END AS mut FROM t""")
def variant_parse_hgvs(spark, sf):
    codes = F.array(*[F.lit(k) for k, _ in CODES])
    e = table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 20 + 1).cast("int").alias("i"), (F.floor(F.col("event_id") / 7) % 21 + 1).cast("int").alias("j"),
        (F.col("event_id") % 300 + 1).alias("pos"),
    )
    text = F.concat(
        F.lit("p."), F.element_at(codes, F.col("i")), F.col("pos").cast("string"),
        F.coalesce(F.get(codes, F.col("j") - 1), F.lit("Ter")),
    )
    parsed = e.select("event_id", text.alias("hgvs"), fc.hgvs_substitution(text).alias("m"))
    return parsed.select("event_id", "hgvs", "m.wt", "m.pos", "m.mut")


@query("variant_region_checks", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber - 2 AS s, l_quantity::INTEGER - 6 AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN s < 1 OR e > 40 THEN 'outside' WHEN e < s THEN 'inverted' WHEN e - s + 1 < 5 THEN 'short' END AS reason FROM r""")
def variant_region_checks(spark, sf):
    r = table(spark, sf, "lineitem")
    start, end = F.col("l_linenumber") - 2, F.col("l_quantity").cast("int") - 6
    return r.select("l_orderkey", "l_linenumber", fc.region_reason(start, end, F.lit(40)).alias("reason"))


@query("variant_apply", f"""
WITH {S_SQL}, v AS (SELECT s.id, s.s, p_size % 14 AS pos, substr(s, greatest(p_size % 14, 1), 1) AS found, CASE WHEN p_size % 3 = 0 THEN 'A' ELSE substr(s, greatest(p_size % 14, 1), 1) END AS wt,
  CASE WHEN p_size % 5 = 0 THEN substr(s, greatest(p_size % 14, 1), 1) ELSE 'W' END AS mut FROM s JOIN part ON p_partkey = s.id),
c AS (SELECT *, CASE WHEN pos < 1 OR pos > length(s) THEN 'position' WHEN found <> wt THEN 'wild-type:' || found WHEN found = mut THEN 'identity' END AS reason FROM v)
SELECT id, reason, CASE WHEN reason IS NULL THEN substr(s, 1, pos - 1) || mut || substr(s, pos + 1) END AS mutated FROM c""")
def variant_apply(spark, sf):
    size = F.col("p_size")
    rows = names(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size"), "id")
    pos = size % 14
    found = F.substring("sequence", F.greatest(pos, F.lit(1)), F.lit(1))
    rows = rows.withColumn("pos", pos).withColumn("wt", F.when(size % 3 == 0, "A").otherwise(found)).withColumn(
        "mut", F.when(size % 5 == 0, found).otherwise("W")
    )
    reason = fc.substitution_reason(F.col("sequence"), F.col("wt"), F.col("pos"), F.col("mut"))
    return rows.select(
        "id", reason.alias("reason"),
        F.when(reason.isNull(), fc.apply_substitution(F.col("sequence"), F.col("pos"), F.col("mut"))).alias("mutated"),
    )


# -- landscapes -----------------------------------------------------------------------

@query("variant_full_scan", f"""
WITH {S_SQL}, p AS (SELECT id, unnest(string_split(s, '')) AS wt, unnest(range(1, length(s) + 1)) AS pos FROM s), a AS (SELECT unnest(string_split('{AA}', '')) AS mut)
SELECT id, pos::INTEGER AS pos, wt, mut FROM p JOIN a ON a.mut <> p.wt""")
def variant_full_scan(spark, sf):
    return va.full_scan(names(spark, sf), "id", "sequence")


LP_SQL = f"""
n AS (SELECT length(s) AS len, s FROM s), c AS (SELECT len, unnest(string_split(s, '')) AS symbol, unnest(range(1, len + 1)) AS pos FROM n),
k AS (SELECT len, pos, symbol, count(*) AS n FROM c GROUP BY ALL), a AS (SELECT unnest(string_split('{LETTERS}', '')) AS symbol),
m AS (SELECT DISTINCT len, pos FROM c), t AS (SELECT len, pos, sum(n) AS t FROM k GROUP BY ALL),
lp AS (SELECT m.len AS id, m.pos, a.symbol, ln((coalesce(k.n, 0) + 1) / (t.t + 26)) AS log_prob FROM m JOIN a ON true JOIN t ON t.len = m.len AND t.pos = m.pos
  LEFT JOIN k ON k.len = m.len AND k.pos = m.pos AND k.symbol = a.symbol)"""


def profile(spark, sf):
    """Log-probabilities (id, pos, symbol) of names of each length, add-one smoothed."""
    sites = names(spark, sf).select(F.length("sequence").alias("id"), F.posexplode(F.split("sequence", "")).alias("p", "symbol")).withColumn("pos", F.col("p") + 1)
    counts = sites.groupBy("id", "pos", "symbol").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("id", "pos").agg(F.sum("n").alias("t"))
    grid = totals.withColumn("symbol", F.explode(F.array(*[F.lit(a) for a in LETTERS])))
    filled = grid.join(counts, ["id", "pos", "symbol"], "left")
    return filled.select("id", "pos", "symbol", F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("t") + 26)).alias("log_prob"))


def profile_sites(spark, sf):
    """The most frequent symbol of each position is its wild type."""
    lp = profile(spark, sf)
    return lp.groupBy("id", "pos").agg(F.min_by("symbol", F.struct((-F.round("log_prob", 9)).alias("l"), "symbol")).alias("wt"))


WT_SQL = "wt AS (SELECT id, pos, arg_min(symbol, (-round(log_prob, 9), symbol)) AS wt FROM lp GROUP BY id, pos)"


@query("variant_llr", f"""
WITH {S_SQL}, {LP_SQL}, {WT_SQL} SELECT lp.id::INTEGER AS id, lp.pos::INTEGER AS pos, wt, lp.symbol AS mut, round(lp.log_prob - w.log_prob, 6) AS llr
FROM lp JOIN wt ON wt.id = lp.id AND wt.pos = lp.pos JOIN lp w ON w.id = lp.id AND w.pos = lp.pos AND w.symbol = wt.wt""")
def variant_llr(spark, sf):
    out = va.log_likelihood_ratios(profile(spark, sf), profile_sites(spark, sf))
    return out.select("id", "pos", "wt", "mut", F.round("llr", 6).alias("llr"))


@query("variant_conservation", f"""
WITH {S_SQL}, {LP_SQL}, {WT_SQL}, z AS (SELECT id, pos, sum(exp(log_prob)) AS z FROM lp GROUP BY ALL),
h AS (SELECT lp.id, lp.pos, -sum(exp(log_prob) / z * ln(exp(log_prob) / z)) AS h FROM lp JOIN z USING (id, pos) GROUP BY ALL)
SELECT h.id::INTEGER AS id, h.pos::INTEGER AS pos, wt, round(h, 4) AS entropy, round(lp.log_prob, 4) AS wt_logprob, round(ln(26), 4) AS max_entropy
FROM h JOIN wt ON wt.id = h.id AND wt.pos = h.pos JOIN lp ON lp.id = h.id AND lp.pos = h.pos AND lp.symbol = wt.wt""")
def variant_conservation(spark, sf):
    return va.conservation(profile(spark, sf), profile_sites(spark, sf))


@query("variant_landscape_extremes", f"""
WITH {S_SQL}, {LP_SQL}, {WT_SQL}, l AS (SELECT lp.id, lp.pos, wt || lp.pos || lp.symbol AS m, round(w.log_prob - lp.log_prob, 9) AS v
FROM lp JOIN wt ON wt.id = lp.id AND wt.pos = lp.pos JOIN lp w ON w.id = lp.id AND w.pos = lp.pos AND w.symbol = wt.wt WHERE lp.symbol <> wt.wt)
SELECT id::INTEGER AS id, pos::INTEGER AS pos, arg_min(m, (-v, m)) AS max_label, arg_min(m, (v, m)) AS min_label, round(max(v) - min(v), 6) AS span FROM l GROUP BY id, pos""")
def variant_landscape_extremes(spark, sf):
    l = va.log_likelihood_ratios(profile(spark, sf), profile_sites(spark, sf)).filter("mut <> wt").select(
        "id", "pos", F.concat("wt", F.col("pos").cast("string"), "mut").alias("m"), F.round(fc.perturbation("llr"), 9).alias("v")
    )
    return ag.landscape_extremes(l, ["id", "pos"], "m", "v").withColumn("span", F.round("span", 6))


@query("variant_landscape_rank", f"""
WITH {S_SQL}, {LP_SQL}, {WT_SQL}, l AS (SELECT lp.id, lp.pos, lp.symbol AS mut, round(w.log_prob - lp.log_prob, 9) AS v
FROM lp JOIN wt ON wt.id = lp.id AND wt.pos = lp.pos JOIN lp w ON w.id = lp.id AND w.pos = lp.pos AND w.symbol = wt.wt WHERE lp.symbol <> wt.wt)
SELECT id::INTEGER AS id, pos::INTEGER AS pos, mut, (row_number() OVER (PARTITION BY id, pos ORDER BY v DESC, mut))::INTEGER AS rank FROM l""")
def variant_landscape_rank(spark, sf):
    l = va.log_likelihood_ratios(profile(spark, sf), profile_sites(spark, sf)).filter("mut <> wt").withColumn(
        "v", F.round(fc.perturbation("llr"), 9)
    )
    return ag.ranked_report(l, ["id", "pos"], "v", "mut").select("id", "pos", "mut", "rank")


# A substitution moves one count of a composition: displacement sqrt(2) / L for every variant.
@query("variant_effects", f"""
WITH {S_SQL}, v AS (SELECT id, s, p_size % length(s) + 1 AS pos FROM s JOIN part ON p_partkey = id), a AS (SELECT unnest(string_split('{LETTERS}', '')) AS mut),
l AS (SELECT v.*, substr(s, pos, 1) AS wt, mut FROM v JOIN a ON a.mut <> substr(s, pos, 1)),
c AS (SELECT *, (length(s) - length(replace(s, wt, '')))::DOUBLE AS nw, (length(s) - length(replace(s, mut, '')))::DOUBLE AS nm FROM l),
q AS (SELECT id, sum(n * n)::DOUBLE AS q FROM (SELECT id, ch, count(*) AS n FROM (SELECT id, unnest(string_split(s, '')) AS ch FROM s) GROUP BY ALL) GROUP BY id)
SELECT c.id, pos::INTEGER AS pos, wt, mut, round(sqrt(2.0) / length(s), 5) AS displacement, round(sqrt(2.0) / sqrt(q), 5) AS relative_displacement,
  round((q - nw + nm) / sqrt(q * (q - 2 * nw + 2 * nm + 2)), 6) AS cosine, round(sqrt(2.0) / length(s), 5) AS global_delta,
  round(sqrt(2.0) / (least(length(s), pos + 8) - greatest(1, pos - 8) + 1), 5) AS local_delta
FROM c JOIN q ON q.id = c.id""")
def variant_effects(spark, sf):
    sites = names(spark, sf, "p_size").withColumn("pos", (F.col("p_size") % F.length("sequence") + 1).cast("int"))
    rows = va.landscape_sites(sites, "id", "sequence", "pos", LETTERS)
    out = substitution_effects(rows, em.OneHotEncoder(LETTERS), lengths=(1, 2048), alphabet=LETTERS)
    return out.select("id", "pos", "wt", "mut", "displacement", "relative_displacement", "cosine", "global_delta", "local_delta")


@query("variant_residue_deltas", f"""
WITH {RES_SQL}, d AS (SELECT id, pos, list_distance(v, list_reverse(v)) AS d FROM r),
m AS (SELECT id, round(avg(d) FILTER (pos BETWEEN 12 AND 28), 6) AS local_delta, round(avg(d), 6) AS global_delta FROM d GROUP BY id)
SELECT id, pos::INTEGER AS pos, round(d, 6) AS delta, local_delta, global_delta FROM d JOIN m USING (id)""")
def variant_residue_deltas(spark, sf):
    wild = residues(store(spark, sf))
    mutant = wild.select("id", F.col("id").alias("variant"), "pos", F.reverse("vector").alias("vector"))
    sites = wild.select(F.col("id").alias("variant")).distinct().withColumn("pos", F.lit(20))
    deltas = va.residue_deltas(wild, mutant)
    means = va.delta_profile(deltas, sites, listed=False)
    return deltas.join(means, "variant").select(
        F.col("variant").alias("id"), F.col("pos").cast("int").alias("pos"), *[F.round(c, 6).alias(c) for c in ("delta", "local_delta", "global_delta")]
    )


@query("variant_top_dimensions", """
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.id, list_transform(list_zip(a.v, b.v), lambda z: z[2] - z[1]) AS d FROM e a JOIN e b ON b.id = a.id + 1),
x AS (SELECT id, unnest(d) AS x, generate_subscripts(d, 1) - 1 AS dim FROM p)
SELECT id, dim::INTEGER AS dim, round(x, 5) AS delta FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(x) DESC, dim) <= 10""")
def variant_top_dimensions(spark, sf):
    e = store(spark, sf)
    nxt = e.select((F.col("id") - 1).alias("id"), F.col("vector").alias("v2"))
    top = e.join(nxt, "id").select("id", F.explode(fv.largest_dimensions(fv.difference(F.col("v2"), F.col("vector")))).alias("t"))
    return top.select("id", "t.dim", "t.delta")


# -- assays ---------------------------------------------------------------------------

ASSAY_SQL = """
q AS (SELECT p_brand AS assay, min(upper(p_name)) AS s FROM part GROUP BY p_brand),
v AS (SELECT p_brand AS assay, (p_partkey % 12)::INTEGER AS pos, substr(q.s, p_partkey % 12 + (p_brand > 'Brand#2')::INT, 1) AS wt, 'W' AS mut, p_retailprice AS score, q.s
  FROM part JOIN q ON q.assay = p_brand),
o AS (SELECT *, k.k AS off, pos + k.k AS p2 FROM v, (VALUES (0), (1)) k(k)),
r AS (SELECT assay, off, avg((substr(s, p2, 1) = wt)::INT) AS agreement FROM o WHERE p2 BETWEEN 1 AND length(s) GROUP BY assay, off),
f AS (SELECT assay, min(off) AS "offset", arg_min(agreement, off) AS agreement FROM r WHERE agreement > 0.98 GROUP BY assay)"""


def assay_tables(spark, sf):
    p = table(spark, sf, "part")
    targets = p.groupBy(F.col("p_brand").alias("assay")).agg(F.min(F.upper("p_name")).alias("s"))
    pos = (F.col("p_partkey") % 12).cast("int")
    rows = p.withColumnRenamed("p_brand", "assay").join(targets, "assay").select(
        "assay", pos.alias("pos"),
        F.substring("s", pos + (F.col("assay") > "Brand#2").cast("int"), F.lit(1)).alias("wt"),
        F.lit("W").alias("mut"), F.col("p_retailprice").alias("score"),
    )
    return rows, targets


@query("variant_offset", f"""WITH {ASSAY_SQL} SELECT assay, "offset"::INTEGER AS "offset", round(agreement, 6) AS agreement FROM f""")
def variant_offset(spark, sf):
    rows, targets = assay_tables(spark, sf)
    return va.detect_offset(rows, targets, "assay", "s").withColumn("agreement", F.round("agreement", 6))


@query("variant_replicates", f"""
WITH {ASSAY_SQL} SELECT v.assay, (v.pos + f."offset")::INTEGER AS pos, wt, mut, round(avg(score), 4) AS score FROM v JOIN f ON f.assay = v.assay
WHERE v.pos + f."offset" BETWEEN 1 AND length(s) AND substr(s, v.pos + f."offset", 1) = wt GROUP BY ALL""")
def variant_replicates(spark, sf):
    rows, targets = assay_tables(spark, sf)
    out = va.align_assay(rows, targets, va.detect_offset(rows, targets, "assay", "s"), "assay", "s")
    return out.select("assay", "pos", "wt", "mut", F.round("score", 4).alias("score"))


# -- trajectories ---------------------------------------------------------------------

CHAIN_SQL = f"""
{S_SQL}, c AS (SELECT id, s, p_size, substr(s, 1, 1) || '1W' AS m1, 'W1' || CASE WHEN p_size % 4 = 0 THEN substr(s, 1, 1) ELSE 'Y' END AS m2,
  CASE WHEN p_size % 5 = 0 THEN 'C3A' ELSE substr(s, 3, 1) || '3V' END AS m3 FROM s JOIN part ON p_partkey = id),
y AS (SELECT *, 'W' || substr(s, 2) AS s1, m2[-1] || substr(s, 2) AS s2 FROM c),
z AS (SELECT *, CASE WHEN strpos('{AA}', s[1]) = 0 THEN 'wild-type symbol' WHEN s[1] = 'W' THEN 'identity' WHEN strpos('{AA}', m2[-1]) = 0 THEN 'mutant symbol'
  WHEN strpos('{AA}', m3[1]) = 0 THEN 'wild-type symbol' WHEN s2[3] <> m3[1] THEN 'wild-type:' || s2[3] WHEN m3[1] = m3[-1] THEN 'identity' END AS reason FROM y)"""


def chain_rows(spark, sf):
    rows = names(spark, sf, "p_size")
    s = lambda i: F.substring("sequence", F.lit(i), F.lit(1))
    return rows.withColumn("mutations", F.array(
        F.concat(s(1), F.lit("1W")), F.concat(F.lit("W1"), F.when(F.col("p_size") % 4 == 0, s(1)).otherwise("Y")),
        F.when(F.col("p_size") % 5 == 0, "C3A").otherwise(F.concat(s(3), F.lit("3V"))),
    ))


@query("traj_chains", f"""
WITH {CHAIN_SQL} SELECT id, reason, CASE WHEN reason IS NULL THEN s || '>' || s1 || '>' || s2 || '>' || substr(s2, 1, 2) || m3[-1] || substr(s2, 4) END AS steps FROM z""")
def traj_chains(spark, sf):
    built = va.build_chains(chain_rows(spark, sf), "id", "sequence", "mutations")
    return built.select("id", "reason", F.when(F.col("reason").isNull(), F.concat_ws(">", "sequences")).alias("steps"))


EV_SQL = """
v AS (SELECT user_id, event_id, ts, [value, (event_id % 7)::DOUBLE + 1] AS z FROM events),
w AS (SELECT *, lag(z) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, first_value(z) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM v),
d AS (SELECT user_id, step, event_id, list_distance(z, p) AS sd, list_distance(z, f) AS fd, list_cosine_similarity(f, z) AS c FROM w WHERE step > 0)"""


def event_points(spark, sf):
    return table(spark, sf, "events").select(
        "user_id", "event_id", "ts", F.array("value", (F.col("event_id") % 7).cast("double") + 1).alias("z")
    )


@query("traj_steps", f"""
WITH {EV_SQL} SELECT user_id, event_id, step::INTEGER AS step, round(sd, 6) AS step_displacement, round(fd, 6) AS displacement_from_start, round(c, 6) AS cosine_to_start FROM d""")
def traj_steps(spark, sf):
    steps = va.trajectory_steps(event_points(spark, sf), "user_id", ["ts", "event_id"], "z")
    return steps.select("user_id", "event_id", "step", *[F.round(c, 6).alias(c) for c in ("step_displacement", "displacement_from_start", "cosine_to_start")])


@query("traj_path", f"""
WITH {EV_SQL} SELECT user_id, count(*) AS n_steps, round(sum(sd), 6) AS path_length, round(arg_max(fd, step), 6) AS net_displacement,
  round(arg_max(fd, step) / greatest(sum(sd), 1e-12), 6) AS directness FROM d GROUP BY user_id""")
def traj_path(spark, sf):
    steps = va.trajectory_steps(event_points(spark, sf), "user_id", ["ts", "event_id"], "z")
    out = va.path_summary(steps, "user_id")
    return out.select("user_id", "n_steps", *[F.round(c, 6).alias(c) for c in ("path_length", "net_displacement", "directness")])


# three steps on compositions: every step moves one letter
@query("traj_mutations", f"""
WITH {CHAIN_SQL}, f AS (SELECT id, s FROM z WHERE s[1] <> 'W' AND s2[3] = m3[1] AND m3[1] <> m3[-1])
SELECT id, 3::BIGINT AS n_steps, round(3 * sqrt(2.0) / length(s), 6) AS path_length FROM f""")
def traj_mutations(spark, sf):
    _, summary, _ = trajectories(chain_rows(spark, sf), em.OneHotEncoder(LETTERS), lengths=(1, 2048), alphabet=LETTERS)
    return summary.select("id", "n_steps", F.round("path_length", 6).alias("path_length"))


# Random pairs as ``random_pairs`` draws them: the first 400 distinct ones of doubled draws.
@query("pair_identity", f"""
WITH RECURSIVE {S_SQL}, n AS (SELECT id, s, row_number() OVER (ORDER BY md5('42|' || id), id) AS r, count(*) OVER () AS n FROM s),
d AS (SELECT range AS d, ('0x' || substr(md5('42|' || range || '|a'), 1, 15))::BIGINT % (SELECT count(*) FROM s) + 1 AS i,
  ('0x' || substr(md5('42|' || range || '|b'), 1, 15))::BIGINT % (SELECT count(*) FROM s) + 1 AS j FROM range(800)),
p AS (SELECT least(i, j) AS i, greatest(i, j) AS j, min(d) AS d FROM d WHERE i <> j GROUP BY ALL ORDER BY min(d) LIMIT 400),
q AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, CASE WHEN x.id < y.id THEN x.s ELSE y.s END AS sa, CASE WHEN x.id < y.id THEN y.s ELSE x.s END AS sb
  FROM p JOIN n x ON x.r = p.i JOIN n y ON y.r = p.j), {alignment_sql('q')}
SELECT a, b, round(identity, 4) AS identity FROM ai""")
def alignments(spark, sf):
    rows = names(spark, sf)
    pairs = random_pairs(rows, "id", 400)
    a = rows.select(F.col("id").alias("a"), F.col("sequence").alias("seq_a"))
    b = rows.select(F.col("id").alias("b"), F.col("sequence").alias("seq_b"))
    return pair_identity(pairs.join(a, "a").join(b, "b")).select("a", "b", F.round("identity", 4).alias("identity"))
