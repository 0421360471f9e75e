"""Mixing sources to target weights by systematic sampling.

The sources, ordered by code point with null last, weigh 1, 2, 3, 1, 2, 3 and so on,
and share all words.  A target stops at ``MAX_REPEATS`` times the words of its source
and the excess is shared again by weight: with the limits in order of limit over
weight, the stopped sources are the first ones, and the level follows from sums.

Every document of a source expects target / source words copies.  The expected
copies are summed along the source, one random offset is added, and a document is
emitted once for each whole number that its stretch crosses.  Along a source the
documents stand by size, so neighbours stand in for each other and the taken words
stay near the target.

Positions come from a range-partitioned sort of narrow rows: no source, however
large, is sorted in one task.  A null text has no words; documents without words
take no words; a null source is a source; repeated rows are sampled on their own;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandkit.llm.common import WORD_PATTERN
from strandkit.operators.ranking import global_row_number
from strandkit.session import reliable_checkpoint

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 42


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, first, target) from one row per source (source, source_size, n).

    ``first`` counts the rows of earlier sources.  The windows span the sources, of
    which there is one row each."""
    one = F.lit(0)
    rows = W.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    weighed = sizes.select(
        "*", weight[((F.row_number().over(rows) - 1) % len(WEIGHTS)).cast("int")].alias("weight"),
        (F.sum("n").over(rows.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("first"),
        F.sum("source_size").over(W.partitionBy(one)).alias("total"),
        (F.col("source_size") * MAX_REPEATS).alias("most"),
    )
    by_ratio = W.partitionBy(one).orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    # the level if exactly the sources before this one are stopped
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after)
    levelled = weighed.withColumn("level", level)
    # stopped sources come first; the first one that is not stopped sets the level
    free = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct((F.col("most") / F.col("weight")).alias("r"), F.col("level").alias("level")))
    return levelled.withColumn("final", F.min(free).over(W.partitionBy(one))["level"]).select(
        "source", "source_size", "first",
        F.coalesce(F.least(F.col("most").cast("double"), F.col("final") * F.col("weight")), F.lit(0.0)).alias("target"),
    )


def offset(source: Column, seed: int = SEED) -> Column:
    """One number in [0, 1) for each source, with 30 bits so that sums stay exact."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(source, F.lit("\x00")))), 1, 15), 16, 10).cast("long").bitwiseAND((1 << 30) - 1) / F.lit(float(1 << 30))


def sample(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds source_size, target and copies to rows of (doc_id, source, size, ...).

    ``rows`` should be a written table: it is read for the sums and for the order."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = targets(sizes)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")))
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("__key"), F.col("doc_id")]
    placed = global_row_number(rows.withColumn("__key", key), order, "__place").drop("__key")
    # one row per source
    named = plan.select(F.col("source").alias("__s"), "source_size", "first", "target")
    joined = placed.join(named, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = (F.col("__place") - F.col("first")).cast("double")
    end = F.floor(offset(F.col("source"), seed) + rate * place)
    start = F.floor(offset(F.col("source"), seed) + rate * (place - 1))
    return joined.withColumn("copies", F.least(end - start, F.lit(MAX_REPEATS))).drop("__place", "first")


def mix(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    rows = reliable_checkpoint(docs.select(F.col(ident).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    return sample(rows, seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def emit(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mixed rows with all their columns, repeated as often as the mix takes them."""
    rows = reliable_checkpoint(docs.select(
        F.struct("*").alias("row"), F.col(ident).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.monotonically_increasing_id().alias("no"),
    ))
    taken = sample(rows.select("doc_id", "source", "size", "no"), seed).filter("copies > 0").select("no", "copies")
    return rows.join(taken, "no").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
f(k, stopped) AS (SELECT 0, []::VARCHAR[] UNION ALL SELECT k + 1, (SELECT coalesce(list(s.source), []) FROM s WHERE list_contains(f.stopped, s.source)
   OR s.weight * ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(3 * source_size) FROM s WHERE list_contains(f.stopped, s.source)), 0)) / (SELECT sum(weight) FROM s WHERE NOT list_contains(f.stopped, s.source)) > 3 * source_size)
   FROM f WHERE k < 25),
z AS (SELECT stopped FROM f ORDER BY k DESC LIMIT 1),
t AS (SELECT s.*, CASE WHEN list_contains(z.stopped, s.source) THEN (3 * source_size)::DOUBLE ELSE
   (((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(3 * source_size) FROM s, z WHERE list_contains(z.stopped, s.source)), 0)) / (SELECT sum(weight) FROM s, z WHERE NOT list_contains(z.stopped, s.source))) * weight END AS target FROM s, z),
p AS (SELECT d.*, row_number() OVER (PARTITION BY d.source ORDER BY size, md5('42|' || doc_id), doc_id) AS i FROM d),
o AS (SELECT source, (('0x' || substr(md5('42|' || source), 1, 15))::BIGINT & 1073741823) / 1073741824.0::DOUBLE AS u FROM s),
q AS (SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e, i FROM p JOIN t USING (source) JOIN o USING (source))
SELECT doc_id, size, source_size, target, (least(floor(u + e * i) - floor(u + e * (i - 1)), 3) * size)::BIGINT AS taken FROM q"""
