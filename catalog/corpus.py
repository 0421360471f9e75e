"""Corpus jobs over ``documents``, ``labels`` and ``part``: fields, checks, summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalog.base import query, table
from strandkit import constants as C
from strandkit.functions import columns as fc
from strandkit.operators import aggregates as ag
from strandkit.operators import kmers as km
from strandkit.operators import sampling as sa
from strandkit.plans.corpus import corpus_manifest
from strandkit.sources import entries as en
from strandkit.sources import tables as tb

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BOUNDS = (50, 20000)

# -- validation -------------------------------------------------------------------

# the capital of a sharp s is two letters in Spark
CLEAN = "regexp_replace(replace(upper(regexp_replace(text, '\\s+', '', 'g')), 'ẞ', 'SS'), '\\*+$', '')"
CHECKED_SQL = f"""
c AS (SELECT doc_id, {CLEAN} AS s FROM documents),
f AS (SELECT doc_id, s, list_sort(list_distinct(string_split(regexp_replace(s, '[A-Z]', '', 'g'), ''))) AS x FROM c),
r AS (SELECT doc_id, s, CASE WHEN length(s) = 0 THEN 'empty' WHEN length(s) < {BOUNDS[0]} THEN 'short:' || length(s)
  WHEN length(s) > {BOUNDS[1]} THEN 'long:' || length(s)
  WHEN regexp_replace(s, '[A-Z]', '', 'g') <> '' THEN 'symbols:' || array_to_string(x, ',') END AS reason FROM f)"""


def checked(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", fc.clean_sequence(F.col("text")).alias("s"))
    return d.withColumn("reason", fc.validation_reason(F.col("s"), *BOUNDS, LETTERS))


@query("corpus_validate", f"WITH {CHECKED_SQL} SELECT doc_id, length(s)::INTEGER AS length, reason FROM r")
def corpus_validate(spark, sf):
    return checked(spark, sf).select("doc_id", F.length("s").alias("length"), "reason")


@query("corpus_reject_counts", f"""
WITH {CHECKED_SQL} SELECT coalesce(split_part(reason, ':', 1), 'valid') AS kind, count(*) AS n FROM r GROUP BY kind""")
def corpus_reject_counts(spark, sf):
    return sa.reject_counts(checked(spark, sf))


@query("corpus_exact_dedup", """
SELECT doc_id, lang, source, md5(text) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def corpus_exact_dedup(spark, sf):
    d = sa.dedup_exact(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), "text", "doc_id")
    return d.select("doc_id", "lang", "source", F.md5("text").alias("digest"))


# -- entries derived from part: every raw column of an annotated record ------------

PLACES = [
    "SUBCELLULAR LOCATION: Secreted. Nucleus", "Nucleolus", "Mitochondrion inner membrane", "Plastid, chloroplast",
    "Endoplasmic reticulum lumen", "Golgi apparatus", "Lysosome", "Peroxisome matrix", "Cell membrane; lipid anchor",
    "Membrane", "Periplasm", "Secreted, cell wall", "Cytosol", "Unknown place",
]
PLACES_SQL = "['" + "', '".join(PLACES) + "']"

ENTRIES_SQL = f"""
raw AS (SELECT p_partkey, 'Q' || lpad(p_partkey::VARCHAR, 6, '0') AS accession,
  CASE WHEN p_brand = 'Brand#7' THEN 'Uncharacterized ' || p_name WHEN p_brand = 'Brand#8' THEN 'putative  uncharacterized part'
       ELSE p_name || ' (EC 1.2.3.4) (' || p_type || ')' END AS protein_name,
  split_part(p_name, ' ', 2) AS gene, 'Genus' || p_brand || ' ' || p_type || ' (strain ' || p_size || ')' AS organism,
  p_size::VARCHAR AS length, upper(p_name) || p_partkey AS sequence,
  CASE WHEN p_size > 40 THEN NULL ELSE p_type || ';' || p_brand || ';' END AS pfam,
  CASE WHEN p_size < 10 THEN NULL WHEN p_size < 12 THEN ' ' ELSE (p_size // 5)::VARCHAR || '.1.-.-; 2.7.1.1' END AS ec,
  p_type || '; ' || p_brand || ';;  ' || p_name || ' ;' AS keywords,
  CASE WHEN p_size = 50 THEN NULL ELSE ({PLACES_SQL})[(p_size - 1) // 4 + 1] END AS subcellular_location,
  CASE WHEN p_size = 1 THEN ' ; x' WHEN p_size = 2 THEN NULL ELSE ' ' || p_type || ' family, ' || p_brand || ' subfamily; other' END AS protein_families
  FROM part)"""


def entries(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size")
    places = F.array(*[F.lit(x) for x in PLACES])
    return p.select(
        "p_partkey", F.concat(F.lit("Q"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("accession"),
        F.when(F.col("p_brand") == "Brand#7", F.concat(F.lit("Uncharacterized "), "p_name"))
        .when(F.col("p_brand") == "Brand#8", "putative  uncharacterized part")
        .otherwise(F.concat("p_name", F.lit(" (EC 1.2.3.4) ("), "p_type", F.lit(")"))).alias("protein_name"),
        F.element_at(F.split("p_name", " "), 2).alias("gene"),
        F.concat(F.lit("Genus"), "p_brand", F.lit(" "), "p_type", F.lit(" (strain "), size.cast("string"), F.lit(")")).alias("organism"),
        size.cast("string").alias("length"),
        F.concat(F.upper("p_name"), F.col("p_partkey").cast("string")).alias("sequence"),
        F.when(size > 40, None).otherwise(F.concat("p_type", F.lit(";"), "p_brand", F.lit(";"))).alias("pfam"),
        F.when(size < 10, None).when(size < 12, " ")
        .otherwise(F.concat(F.floor(size / 5).cast("string"), F.lit(".1.-.-; 2.7.1.1"))).alias("ec"),
        F.concat("p_type", F.lit("; "), "p_brand", F.lit(";;  "), "p_name", F.lit(" ;")).alias("keywords"),
        F.when(size == 50, None).otherwise(F.element_at(places, (F.floor((size - 1) / 4) + 1).cast("int"))).alias("subcellular_location"),
        F.when(size == 1, " ; x").when(size == 2, None)
        .otherwise(F.concat(F.lit(" "), "p_type", F.lit(" family, "), "p_brand", F.lit(" subfamily; other"))).alias("protein_families"),
    )


LOCATION_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(subcellular_location), '{pattern}') THEN '{label}'" for label, pattern in C.LOCATION_PATTERNS
) + " END"
EC_SQL = "CASE trim(split_part(split_part(trim(ec), ';', 1), '.', 1)) " + " ".join(
    f"WHEN '{d}' THEN '{n}'" for d, n in C.EC_CLASSES.items()
) + " END"
DERIVED_SQL = f"""{ENTRIES_SQL},
d AS (SELECT p_partkey, accession, protein_name AS protein_name_full, trim(split_part(protein_name, ' (', 1)) AS protein_name, gene, organism,
  length::INTEGER AS length, sequence, nullif(trim(split_part(split_part(protein_families, ';', 1), ',', 1)), '') AS family,
  list_filter(string_split(coalesce(pfam, ''), ';'), lambda x: x <> '') AS pfam_all, ec, {EC_SQL} AS ec_class,
  coalesce(trim(ec) <> '', false) AS is_enzyme, keywords, {LOCATION_SQL} AS localization,
  left(organism, 1) || '. ' || string_split(trim(regexp_replace(organism, '\\(.*', '')), ' ')[2] AS organism_short FROM raw)"""


@query("corpus_derive", f"""
WITH {DERIVED_SQL} SELECT accession, protein_name, protein_name_full, organism_short, length, family,
  array_to_string(pfam_all, '|') AS pfam_all, pfam_all[1] AS pfam_primary, ec_class, is_enzyme, localization FROM d""")
def corpus_derive(spark, sf):
    d = en.derive_fields(entries(spark, sf))
    return d.select(
        "accession", "protein_name", "protein_name_full", "organism_short", "length", "family",
        F.concat_ws("|", "pfam_all").alias("pfam_all"), "pfam_primary", "ec_class", "is_enzyme", "localization",
    )


@query("corpus_drop_uncharacterized", f"""
WITH {ENTRIES_SQL} SELECT accession, protein_name FROM raw WHERE NOT regexp_matches(protein_name, '^(putative\\s+)?uncharacterized', 'i')""")
def corpus_drop_uncharacterized(spark, sf):
    return sa.drop_uncharacterized(entries(spark, sf), "protein_name").select("accession", "protein_name")


@query("corpus_keywords", f"""
WITH {ENTRIES_SQL} SELECT accession, array_to_string(list_filter(list_transform(string_split(keywords, ';'), lambda x: trim(x)), lambda x: x <> '')[1:20], '|') AS keywords,
  regexp_matches(accession, '^[A-Z][A-Z0-9]{{5,9}}$') AS accession_ok FROM raw""")
def corpus_keywords(spark, sf):
    return entries(spark, sf).select(
        "accession", F.concat_ws("|", fc.keyword_list(F.col("keywords"))).alias("keywords"),
        fc.accession_ok(F.lower("accession")).alias("accession_ok"),
    )


@query("corpus_manifest", f"""
WITH {DERIVED_SQL}, o AS (SELECT 'organism' AS section, organism AS label, count(*) AS n FROM d GROUP BY organism),
l AS (SELECT 'localization' AS section, localization AS label, count(*) AS n FROM d WHERE localization IS NOT NULL GROUP BY localization),
f AS (SELECT 'top_family' AS section, family AS label, count(*) AS n FROM d WHERE family IS NOT NULL GROUP BY family ORDER BY n DESC, label LIMIT 25)
SELECT * FROM o UNION ALL SELECT * FROM l UNION ALL SELECT * FROM f
UNION ALL SELECT 'total', 'n_final', count(*) FROM d UNION ALL SELECT 'total', 'n_families', count(DISTINCT family) FROM d
UNION ALL SELECT 'total', 'n_with_pfam', count(pfam_all[1]) FROM d UNION ALL SELECT 'total', 'n_enzymes', count(*) FILTER (is_enzyme) FROM d""")
def manifest(spark, sf):
    return corpus_manifest(en.derive_fields(entries(spark, sf)))


@query("corpus_task_labels", f"""
WITH {DERIVED_SQL} SELECT accession, CASE WHEN is_enzyme THEN 'enzyme' ELSE 'non-enzyme' END AS enzyme_vs_nonenzyme,
  CASE WHEN is_enzyme THEN ec_class END AS ec_class, localization AS subcellular_location FROM d""")
def corpus_task_labels(spark, sf):
    d = en.derive_fields(entries(spark, sf)).select("accession", *fc.task_labels())
    return d.withColumnRenamed("subcellular_localization", "subcellular_location")


@query("corpus_summary_rows", f"""
WITH {DERIVED_SQL} SELECT accession || '/' || protein_name || '/' || gene || '/' || organism_short || '/' || length || '/' || coalesce(family, '-')
  || '/' || coalesce(pfam_all[1], '-') || '/' || coalesce(ec_class, '-') || '/' || coalesce(localization, '-') AS summary FROM d""")
def corpus_summary_rows(spark, sf):
    s = en.derive_fields(entries(spark, sf)).select(fc.summary_struct().alias("s"))
    names = ["accession", "name", "gene", "organism", "length", "family", "pfam", "ec_class", "localization"]
    return s.select(F.concat_ws("/", *[F.coalesce(F.col(f"s.{n}").cast("string"), F.lit("-")) for n in names]).alias("summary"))


@query("corpus_cluster_summary", f"""
WITH {DERIVED_SQL}, c AS (SELECT d.*, p.p_type AS cluster FROM d JOIN part p USING (p_partkey)),
f AS (SELECT cluster, family AS v, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, family) AS r FROM c WHERE family IS NOT NULL GROUP BY cluster, family),
o AS (SELECT cluster, organism_short AS v, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, organism_short) AS r FROM c GROUP BY cluster, organism_short),
b AS (SELECT cluster, count(*) AS size, round(avg(length), 6) AS mean_length, round(avg(is_enzyme::INT), 6) AS enzyme_fraction FROM c GROUP BY cluster),
tf AS (SELECT cluster, string_agg(v || ':' || n, '|' ORDER BY r) AS top_families FROM f WHERE r <= 3 GROUP BY cluster),
tor AS (SELECT cluster, string_agg(v || ':' || n, '|' ORDER BY r) AS top_organisms FROM o WHERE r <= 3 GROUP BY cluster)
SELECT * FROM b JOIN tf USING (cluster) JOIN tor USING (cluster)""")
def corpus_cluster_summary(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("cluster"))
    d = en.derive_fields(entries(spark, sf)).join(p, "p_partkey")
    out = ag.cluster_summaries(d, "cluster", "length", "family", "organism_short", "is_enzyme")
    flat = lambda c: F.concat_ws("|", F.transform(c, lambda e: F.concat(e["value"], F.lit(":"), e["n"].cast("string")))).alias(c)
    return out.select(
        "cluster", "size", F.round("mean_length", 6).alias("mean_length"), F.round("enzyme_fraction", 6).alias("enzyme_fraction"),
        flat("top_families"), flat("top_organisms"),
    )


# -- counts, folds, scales --------------------------------------------------------

@query("corpus_value_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 15")
def corpus_value_counts(spark, sf):
    return ag.value_counts(table(spark, sf, "documents"), "source", 15)


@query("corpus_fold_other", """
WITH c AS (SELECT CASE WHEN p_size > 45 THEN NULL ELSE p_brand END AS v FROM part), n AS (SELECT v, count(*) AS n FROM c GROUP BY v),
t AS (SELECT v FROM n WHERE v IS NOT NULL ORDER BY n DESC, v LIMIT 7)
SELECT CASE WHEN v IS NULL THEN 'n/a' WHEN v IN (SELECT v FROM t) THEN v ELSE 'Other' END AS label, sum(n)::BIGINT AS n FROM n GROUP BY label""")
def corpus_fold_other(spark, sf):
    p = table(spark, sf, "part").select(F.when(F.col("p_size") > 45, None).otherwise(F.col("p_brand")).alias("v"))
    return ag.fold_other(p, "v")


@query("corpus_scaled_length", """
SELECT doc_id, round((n_chars - (SELECT min(n_chars) FROM documents)) / (SELECT max(n_chars) - min(n_chars) FROM documents), 6) AS scaled FROM documents""")
def corpus_scaled_length(spark, sf):
    return ag.scaled(table(spark, sf, "documents"), "n_chars").select("doc_id", F.round("scaled", 6).alias("scaled"))


@query("corpus_coverage", """
WITH f AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT count(*) AS n_records, count(DISTINCT f.o_custkey) AS n_ids, count(*) AS n_items, (SELECT count(DISTINCT c_custkey) FROM customer) AS n_corpus,
  round(count(DISTINCT f.o_custkey) / (SELECT count(DISTINCT c_custkey) FROM customer), 4) AS coverage
FROM f JOIN customer ON c_custkey = f.o_custkey""")
def corpus_coverage(spark, sf):
    f = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return ag.coverage(f, table(spark, sf, "customer"), "c_custkey")


@query("corpus_statistics", """
SELECT (SELECT count(*) FROM customer) AS corpus_size, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS n_families,
  (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) AS n_with_domains,
  (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) AS n_appended""")
def corpus_statistics(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return ag.corpus_statistics(
        table(spark, sf, "customer"), "c_custkey", "c_mktsegment", orders, orders.filter("o_orderpriority = '1-URGENT'")
    )


@query("corpus_cluster_positions", """
SELECT label AS cluster, round(median(embedding[1]::DOUBLE), 6) AS x, round(median(embedding[2]::DOUBLE), 6) AS y, count(*) AS n FROM embeddings GROUP BY label""")
def corpus_cluster_positions(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.col("label").alias("cluster"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")
    )
    out = ag.cluster_positions(e, "cluster", "x", "y")
    return out.select("cluster", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


@query("corpus_noise_fraction", "SELECT round(avg((CASE WHEN p_size < 15 THEN -1 ELSE p_size END = -1)::INT), 6) AS noise_fraction FROM part")
def corpus_noise_fraction(spark, sf):
    p = table(spark, sf, "part").select(F.when(F.col("p_size") < 15, -1).otherwise(F.col("p_size")).alias("c"))
    return ag.noise_fraction(p, "c").select(F.round("noise_fraction", 6).alias("noise_fraction"))


# -- symbols and k-mers -------------------------------------------------------------

CLASS_SQL = ", ".join(
    f"length(regexp_replace(s, '[^{symbols}]', '', 'g')) AS n_{name}" for name, symbols in C.SYMBOL_CLASSES.items()
)


@query("corpus_class_composition", f"WITH c AS (SELECT doc_id, {CLEAN} AS s FROM documents) SELECT doc_id, {CLASS_SQL} FROM c")
def corpus_class_composition(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", fc.clean_sequence(F.col("text")).alias("s"))
    return d.select("doc_id", *fc.class_counts(F.col("s")))


@query("kmer_composition", f"""
WITH c AS (SELECT doc_id, {CLEAN} AS s FROM documents)
SELECT doc_id, {', '.join(f"round(length(regexp_replace(s, '[^{a}]', '', 'g')) / greatest(length(s), 1), 6) AS f_{a.lower()}" for a in C.AMINO_ACIDS)} FROM c""")
def kmer_composition(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", fc.clean_sequence(F.col("text")).alias("s"))
    v = km.composition(d, "doc_id", "s")
    return v.select("doc_id", *[F.round(F.col("vector")[i], 6).alias(f"f_{a.lower()}") for i, a in enumerate(C.AMINO_ACIDS)])


@query("kmer_frequencies", f"""
WITH c AS (SELECT doc_id, {CLEAN} AS s FROM documents),
w AS (SELECT doc_id, substring(s, i::BIGINT, 3) AS kmer FROM (SELECT doc_id, s, unnest(range(1, length(s) - 1)) AS i FROM c)),
k AS (SELECT * FROM w WHERE regexp_full_match(kmer, '[ACDEFGHIKLMNPQRSTVWY]{{3}}')), t AS (SELECT doc_id, count(*) AS t FROM k GROUP BY doc_id)
SELECT doc_id, kmer, count(*) AS n, round(count(*) / any_value(t), 6) AS freq FROM k JOIN t USING (doc_id) GROUP BY doc_id, kmer""")
def kmer_frequencies(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", fc.clean_sequence(F.col("text")).alias("s"))
    return km.kmer_frequencies(d, "doc_id", "s", 3).withColumn("freq", F.round("freq", 6))


@query("kmer_jaccard", """
WITH t AS (SELECT min(doc_id) AS id, text FROM documents GROUP BY text),
k AS (SELECT DISTINCT id, substring(text, i, 8) AS w FROM (SELECT id, text, unnest(range(1, length(text) - 6)) AS i FROM t)),
n AS (SELECT id, count(*) AS n FROM k GROUP BY id),
s AS (SELECT a.id AS a, b.id AS b, count(*) AS s FROM k a JOIN k b ON a.w = b.w AND a.id < b.id GROUP BY a.id, b.id)
SELECT a, b, round(s / (x.n + y.n - s), 6) AS jaccard FROM s JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE s / (x.n + y.n - s) >= 0.5""")
def kmer_jaccard(spark, sf):
    return km.jaccard_pairs(table(spark, sf, "documents"), "doc_id", "text", 8).withColumn("jaccard", F.round("jaccard", 6))


@query("kmer_best_match", """
WITH b AS (SELECT 'b' AS side, item_id AS id, text FROM benchmark), d AS (SELECT 'd' AS side, min(doc_id) AS id, text FROM documents GROUP BY text),
u AS (SELECT * FROM b UNION ALL SELECT * FROM d),
k AS (SELECT DISTINCT side, id, substring(text, i, 5) AS w FROM (SELECT side, id, text, unnest(range(1, length(text) - 3)) AS i FROM u)),
n AS (SELECT side, id, count(*) AS n FROM k GROUP BY ALL),
s AS (SELECT a.id AS a, b.id AS b, count(*) AS s FROM k a JOIN k b ON a.w = b.w AND a.side = 'b' AND b.side = 'd' GROUP BY a.id, b.id),
j AS (SELECT a, b, s / (x.n + y.n - s) AS j FROM s JOIN n x ON x.id = a AND x.side = 'b' JOIN n y ON y.id = b AND y.side = 'd')
SELECT a, b, round(j, 6) AS jaccard FROM j WHERE j >= 0.1 QUALIFY row_number() OVER (PARTITION BY a ORDER BY j DESC, b) = 1""")
def kmer_best_match(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return km.best_match(b, d, "id", "text", 5, 0.1).withColumn("jaccard", F.round("jaccard", 6))


# -- keys, records, formats ---------------------------------------------------------

@query("corpus_embedding_keys", """
SELECT doc_id, sha256('base|mean|v1|-|' || text) AS mean_key, sha256('base|attention|v1|w7|' || text) AS attention_key FROM documents""")
def corpus_embedding_keys(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", fc.embedding_key(F.col("text"), "base", "mean").alias("mean_key"),
        fc.embedding_key(F.col("text"), "base", "attention", "w7").alias("attention_key"),
    )


@query("corpus_spaced_form", """
SELECT p_partkey, '<AA2fold> ' || array_to_string(string_split(regexp_replace(upper(p_name), '[UZOB]', 'X', 'g'), ''), ' ') AS spaced FROM part""")
def corpus_spaced_form(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fc.spaced_form(F.col("p_name")).alias("spaced"))


@query("corpus_fasta_records", """
SELECT doc_id, md5('>' || doc_id || ' ' || source || chr(10) || trim(regexp_replace(replace(text, chr(10), ' '), '(.{60})', '\\1' || chr(10), 'g'), chr(10))) AS record FROM documents""")
def corpus_fasta_records(spark, sf):
    d = table(spark, sf, "documents").withColumn("s", F.replace("text", F.lit("\n"), F.lit(" ")))
    record = fc.fasta_record(F.col("doc_id").cast("string"), F.col("source"), F.col("s"), 60)
    return d.select("doc_id", F.md5(record).alias("record"))


@query("corpus_fingerprint", """
WITH r AS (SELECT concat_ws('|', coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(length(text) || ':' || text, '-'), coalesce(length(lang) || ':' || lang, '-'),
  coalesce(length(source) || ':' || source, '-'), coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-')) AS r FROM documents),
t AS (SELECT count(*) AS n, sum(('0x' || substr(md5(r), 1, 15))::BIGINT::HUGEINT) AS t FROM r)
SELECT n AS n_rows, substr(sha256(n || '|' || t), 1, 16) AS fingerprint FROM t""")
def corpus_fingerprint(spark, sf):
    return tb.table_fingerprint(table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


@query("corpus_domain_features", """
WITH r AS (SELECT o_orderkey, 'DOMAIN ' || (o_custkey + 1) || '..' || (o_custkey + 40) || '; /note="' || o_orderpriority || '"; /evidence="x"; DOMAIN 7..90; /evidence="y"' AS ft FROM orders)
SELECT o_orderkey, CASE WHEN coalesce(n, '') = '' THEN 'domain' ELSE trim(n) END AS name, s::INTEGER AS start, e::INTEGER AS "end" FROM (
  SELECT o_orderkey, unnest(regexp_extract_all(ft, 'DOMAIN\\s+(\\d+)\\.\\.(\\d+);(?:\\s*/note="([^"]*)")?', 1)) AS s,
    unnest(regexp_extract_all(ft, 'DOMAIN\\s+(\\d+)\\.\\.(\\d+);(?:\\s*/note="([^"]*)")?', 2)) AS e,
    unnest(regexp_extract_all(ft, 'DOMAIN\\s+(\\d+)\\.\\.(\\d+);(?:\\s*/note="([^"]*)")?', 3)) AS n FROM r)""")
def corpus_domain_features(spark, sf):
    key = F.col("o_custkey")
    text = F.concat(
        F.lit("DOMAIN "), (key + 1).cast("string"), F.lit(".."), (key + 40).cast("string"), F.lit('; /note="'), "o_orderpriority",
        F.lit('"; /evidence="x"; DOMAIN 7..90; /evidence="y"'),
    )
    orders = table(spark, sf, "orders")
    return en.domain_table(orders.select("o_orderkey", text.alias("ft")), orders, "o_orderkey", "ft")


@query("corpus_structure_xrefs", """
SELECT c_custkey, array_to_string(list_filter([trim(c_mktsegment), trim(c_name)], lambda x: x <> ''), ',') AS pdb_ids, 2 AS n FROM customer WHERE c_nationkey < 20""")
def corpus_structure_xrefs(spark, sf):
    c = table(spark, sf, "customer")
    text = F.when(F.col("c_nationkey") < 20, F.concat("c_mktsegment", F.lit("; ;"), "c_name", F.lit(";")))
    out = en.structure_table(c.select("c_custkey", text.alias("pdb")), c, "c_custkey", "pdb")
    return out.select("c_custkey", F.concat_ws(",", "pdb_ids").alias("pdb_ids"), F.size("pdb_ids").alias("n"))
