import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandkit import constants as C
from strandkit.functions import columns as fc


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text, want", [
    (" mk t\nA** ", "MKTA"), ("", ""), ("acd*e", "ACD*E"),
])
def test_clean_sequence(spark, text, want):
    assert one(spark, text, fc.clean_sequence) == want


@pytest.mark.parametrize("seq, want", [
    ("", "empty"), (None, "empty"), ("ACD", "short:3"), ("A" * 30, "long:30"), ("ACDEFGHIKU", "symbols:U"),
    ("ACDEFZBHIK", "symbols:B,Z"), ("ACDEFGHIKL", None),
])
def test_validation_reason(spark, seq, want):
    assert one(spark, seq, lambda c: fc.validation_reason(c, 10, 20)) == want


def test_family_and_tokens(spark):
    assert one(spark, "Globin family, alpha subfamily; other", fc.family) == "Globin family"
    assert one(spark, " ;x", fc.family) is None
    assert one(spark, None, fc.family) is None
    assert one(spark, "PF1;PF2;", fc.token_list) == ["PF1", "PF2"]
    assert one(spark, None, fc.token_list) == []


@pytest.mark.parametrize("ec, cls, enzyme", [
    ("1.1.1.1; 2.7.1.1", "Oxidoreductase", True), ("9.1.1.1", None, True), ("  ", None, False), (None, None, False),
])
def test_ec(spark, ec, cls, enzyme):
    assert one(spark, ec, fc.ec_class) == cls
    assert one(spark, ec, fc.is_enzyme) is enzyme


@pytest.mark.parametrize("text, want", [
    ("SUBCELLULAR LOCATION: Cell membrane; Membrane", "Cell membrane"), ("Nucleolus", "Nucleus"),
    ("Secreted. Nucleus", "Secreted"), ("unknown", None), (None, None), ("Subplastid", "Chloroplast"),
    ("preendoplasmic reticulum", None),
])
def test_localization(spark, text, want):
    assert one(spark, text, fc.localization) == want


def test_names(spark):
    assert one(spark, "Insulin (Fragment) (X)", fc.name_head) == "Insulin"
    assert one(spark, None, fc.name_head) == ""
    assert one(spark, "Homo sapiens (Human)", fc.organism_short) == "H. sapiens"
    assert one(spark, "Virus", fc.organism_short) == "Virus"
    assert one(spark, "a; b ;;c", fc.keyword_list) == ["a", "b", "c"]
    assert one(spark, ";".join(map(str, range(30))), fc.keyword_list) == [str(i) for i in range(20)]


@pytest.mark.parametrize("text", ["63Y", "H63", "HY", "H0.5Y", "H63Z_extra", ""])
def test_bad_labels(spark, text):
    assert one(spark, text, fc.substitution)["reason"] == "unparsed"


def test_labels(spark):
    got = one(spark, " h63y ", fc.substitution)
    assert (got["wt"], got["pos"], got["mut"], got["reason"]) == ("H", 63, "Y", None)
    assert one(spark, "B63Y", fc.substitution)["reason"] == "wild-type symbol"
    assert one(spark, "H63B", fc.substitution)["reason"] == "mutant symbol"


@pytest.mark.parametrize("text, want", [
    ("p.Gly34Arg", ("G", 34, "R")), ("p.Gly34Gly", None), ("p.Gly34Ter", None), ("p.Gly34=", None), (" p.Met1Val ", ("M", 1, "V")),
])
def test_hgvs(spark, text, want):
    got = one(spark, text, fc.hgvs_substitution)
    assert (got and (got["wt"], got["pos"], got["mut"])) == want


@pytest.mark.parametrize("start, end, want", [
    (0, 10, "outside"), (95, 101, "outside"), (-3, 5, "outside"), (20, 10, "inverted"), (5, 8, "short"), (5, 9, None), (1, 100, None),
])
def test_regions(spark, start, end, want):
    row = spark.range(1).select(fc.region_reason(F.lit(start), F.lit(end), F.lit(100)).alias("r")).first()
    assert row["r"] == want


def test_keys_and_forms(spark):
    want = hashlib.sha256(b"m|mean|v1|-|ACD").hexdigest()
    assert one(spark, "ACD", lambda c: fc.embedding_key(c, "m", "mean")) == want
    assert one(spark, "ACD", lambda c: fc.embedding_key(c, "m", "attention", "f")) != want
    assert one(spark, "acuz", fc.spaced_form) == "<AA2fold> A C X X"
    record = spark.range(1).select(fc.fasta_record(F.lit("P1"), F.lit("n"), F.lit("A" * 120), 60).alias("r")).first()["r"]
    assert record == ">P1 n\n" + "A" * 60 + "\n" + "A" * 60


def test_accessions(spark):
    assert one(spark, " p69905 ", fc.accession_ok) is True
    assert one(spark, "6P", fc.accession_ok) is False


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=C.AMINO_ACIDS, min_size=3, max_size=30), st.integers(1, 30), st.sampled_from(C.AMINO_ACIDS)), min_size=1, max_size=20))
def test_substitution_round_trip(spark, rows):
    df = spark.createDataFrame([(s, p, m) for s, p, m in rows], "s string, p int, m string")
    found = F.substring("s", F.col("p"), F.lit(1))
    got = df.select(
        "s", "p", "m", fc.substitution_reason(F.col("s"), found, F.col("p"), F.col("m")).alias("reason"),
        fc.apply_substitution(F.col("s"), F.col("p"), F.col("m")).alias("t"),
    ).collect()
    for r in got:
        if r["p"] > len(r["s"]):
            assert r["reason"] == "position"
        elif r["s"][r["p"] - 1] == r["m"]:
            assert r["reason"] == "identity"
        else:
            assert r["reason"] is None
            assert r["t"] == r["s"][: r["p"] - 1] + r["m"] + r["s"][r["p"]:]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_clean_matches_python(spark, texts):
    plain = [re.sub(r"[^\x20-\x7e\n\t]", "", t) for t in texts]
    df = spark.createDataFrame([(t,) for t in plain], "x string").select("x", fc.clean_sequence(F.col("x")).alias("y"))
    for r in df.collect():
        assert r["y"] == "".join(r["x"].split()).upper().rstrip("*")
