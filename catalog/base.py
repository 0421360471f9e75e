"""Registry of queries over the shared tables, each with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_digest(vec):
    """One whole number that every component and its place change: the sum of i * round(10^6 x)."""
    from pyspark.sql import functions as F

    parts = F.transform(vec, lambda x, i: (i + 1).cast("long") * F.round(x.cast("double") * 1000000).cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)


def vector_digest_sql(vec: str) -> str:
    return f"list_sum(list_transform({vec}, lambda x, i: i * round(x::DOUBLE * 1000000)::BIGINT))::BIGINT"


def alignment_sql(pairs: str) -> str:
    """CTE ``ai`` (a, b, identity) over a CTE with (a, b, sa, sb), by anti-diagonals of the cells.

    A cell's number is score * 10^8 + matches * 10^4 - length; scores of BLOSUM62, gaps -11 and -1,
    other symbols 4 or -4.  Sequences must be shorter than 5,000 symbols."""
    from strandkit.operators.align import score_matrix

    scores = ", ".join(f"('{x}', '{y}', {s})" for (x, y), s in score_matrix().items())
    o, e = -11 * 10**8 - 1, -(10**8) - 1
    return f"""
am(x, y, s) AS (VALUES {scores}),
ap AS (SELECT DISTINCT sa, sb, length(sa) AS n, length(sb) AS m FROM {pairs} WHERE length(sa) > 0 AND length(sb) > 0),
al(sa, sb, n, m, i, j, old, g, x, y) AS (
  SELECT sa, sb, n, m, 0, 0, false, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM ap
  UNION ALL
  (SELECT sa, sb, n, m, i, j, false, max(g)::BIGINT, max(x)::BIGINT, max(y)::BIGINT FROM (
      SELECT al.sa, al.sb, n, m, i + 1 AS i, j + 1 AS j, greatest(g, al.x, al.y)
          + coalesce(am.s, CASE WHEN al.sa[i + 1] = al.sb[j + 1] THEN 4 ELSE -4 END) * 100000000 - 1 + CASE WHEN al.sa[i + 1] = al.sb[j + 1] THEN 10000 ELSE 0 END AS g, NULL AS x, NULL AS y
        FROM al LEFT JOIN am ON am.x = al.sa[i + 1] AND am.y = al.sb[j + 1] WHERE old AND i < n AND j < m
      UNION ALL SELECT sa, sb, n, m, i + 1, j, NULL, greatest(greatest(g, y) + {o}, x + {e}), NULL FROM al WHERE NOT old AND i < n
      UNION ALL SELECT sa, sb, n, m, i, j + 1, NULL, NULL, greatest(greatest(g, x) + {o}, y + {e}) FROM al WHERE NOT old AND j < m
    ) GROUP BY sa, sb, n, m, i, j
   UNION ALL SELECT sa, sb, n, m, i, j, true, g, x, y FROM al WHERE NOT old)),
ae AS (SELECT sa, sb, greatest(g, x, y) AS v FROM al WHERE i = n AND j = m AND NOT old),
ad AS (SELECT sa, sb, ((v + (-v % 10000 + 10000) % 10000) // 10000) AS r, (-v % 10000 + 10000) % 10000 AS len FROM ae),
ai AS (SELECT p.a, p.b, CASE WHEN length(p.sa) = 0 OR length(p.sb) = 0 THEN 0.0 ELSE ((r % 10000 + 10000) % 10000) / len END AS identity
  FROM {pairs} p LEFT JOIN ad ON ad.sa = p.sa AND ad.sb = p.sb)"""
