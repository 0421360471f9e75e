"""Shares of symbols."""

from strandkit.operators import kmers as km


def test_shares_need_no_pattern_per_symbol(spark):
    df = spark.createDataFrame([(1, "AACX"), (2, ""), (3, None), (4, "C" * 7 + "^é]A")], "id long, seq string")
    out = km.composition(df, "id", "seq", "AC")
    assert "regexp_replace" not in out._jdf.queryExecution().analyzed().toString()
    assert {r["id"]: list(r["vector"]) for r in out.collect()} == {1: [0.5, 0.25], 2: [0.0, 0.0], 3: [None, None], 4: [1 / 11, 7 / 11]}
