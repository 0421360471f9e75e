import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows_of

SF = "/root/testdata/sf0.001"
CHECKED = [
    "vec_precision_at_k", "vec_neighbors_grid", "metric_nmi", "metric_auroc", "metric_spearman", "corpus_derive", "corpus_manifest",
    "sample_cap_group", "sample_batches", "kmer_jaccard", "group_tokens", "pool_attention", "variant_effects", "traj_path",
    "text_lookup", "pair_compare", "report_headline",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_flagship(spark):
    row = entry.entry(spark).first()
    assert row["n_evaluated"] == 500


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 120 and len(oracles) > 100


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())
