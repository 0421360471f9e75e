import gzip
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from strandkit import constants as C
from strandkit.operators import embed as em
from strandkit.operators import lookup as lo
from strandkit.operators.cluster import map_coordinates
from strandkit.plans import corpus as pc
from strandkit.sources import entries as en
from strandkit.sources import tables as tb
from strandkit.sources.files import file_digests
from strandkit.sources.keyed import KeyedStore
from strandkit.streaming import appends as ap

AA = C.AMINO_ACIDS
HEADER = list(C.ENTRY_COLUMNS)


def entry(acc, seq, name="Insulin (X)", family="Globin family, a; b", organism="Homo sapiens (Human)"):
    return [acc, acc + "_X", name, "GEN", organism, "9606", str(len(seq)), seq, "PF1;PF2;", "1.1.1.1", "a;b", "Secreted.", family]


def rotated(i, n=60):
    text = AA * 5
    return text[i: i + n]


@pytest.fixture(scope="module")
def raw_path(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    parts = {
        "entries_a.tsv.gz": [entry("P00002", rotated(0)), entry("P00001", " " + rotated(0).lower()), entry("P00003", rotated(1), "Putative uncharacterized x")],
        "entries_b.tsv.gz": [entry("P00004", rotated(2) + "*"), entry("P00005", "ACD"), entry("P00006", rotated(3)[:-1] + "U"), entry("P00007", rotated(4), family="")],
    }
    for name, rows in parts.items():
        with gzip.open(folder / name, "wt") as fh:
            fh.write("\n".join("\t".join(r) for r in [HEADER, *rows]) + "\n")
    return str(folder / "*.tsv.gz")


def test_read_entries(spark, raw_path, tmp_path):
    df = en.read_entries(spark, raw_path, 3)
    assert df.count() == 7 and set(C.ENTRY_COLUMNS.values()) <= set(df.columns)
    assert {r["source_file"] for r in df.collect()} == {"entries_a.tsv.gz", "entries_b.tsv.gz"}
    manifest = {r["file"]: r for r in en.file_manifest(spark, raw_path, df).collect()}
    assert manifest["entries_a.tsv.gz"]["rows"] == 3 and len(manifest["entries_b.tsv.gz"]["sha256"]) == 64
    bad = tmp_path / "bad.tsv"
    bad.write_text("Entry\tLength\nP1\t3\n")
    with pytest.raises(en.MissingColumnsError):
        en.read_entries(spark, str(bad))


def test_build_corpus(spark, raw_path):
    df = en.read_entries(spark, raw_path)
    got = {r["accession"]: r for r in pc.build_corpus(df).collect()}
    # the smallest accession of a copy wins; dropped: short, foreign symbol, uncharacterized
    assert set(got) == {"P00001", "P00004", "P00007"}
    assert got["P00001"]["sequence"] == rotated(0) and got["P00004"]["sequence"] == rotated(2)
    assert got["P00001"]["family"] == "Globin family" and got["P00007"]["family"] is None
    assert got["P00001"]["protein_name"] == "Insulin" and got["P00001"]["organism_short"] == "H. sapiens"
    counts = pc.drop_counts(df).first()
    assert (counts["n_raw"], counts["n_invalid"], counts["n_duplicates"], counts["n_uncharacterized"]) == (7, 2, 1, 1)
    small = pc.build_corpus(df, pc.BuildOptions(family_cap=1, target=2, showcase=("P00004",)))
    assert "P00004" in {r["accession"] for r in small.collect()}


def test_append(spark, raw_path):
    df = en.read_entries(spark, raw_path)
    corpus = pc.build_corpus(df).filter("accession = 'P00001'")
    wanted = spark.createDataFrame([("P00001",), ("P00004",), ("P00005",), ("P99999",)], "accession string")
    rows, vectors, states = pc.append_entries(wanted, df, corpus, em.HashingEncoder(8), ["mean", "max"])
    assert {r["accession"]: r["state"] for r in states.collect()} == {
        "P00001": "present", "P00004": "found", "P00005": "invalid", "P99999": "not_found"
    }
    assert [r["accession"] for r in rows.collect()] == ["P00004"] and vectors.count() == 2
    with pytest.raises(pc.PartialAppendError):
        pc.append_entries(wanted, df, corpus, em.HashingEncoder(8), ["mean", "attention"])


def test_corpus_in_order(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "ordered")
    tb.write_corpus(spark.range(1000, numPartitions=4).orderBy(F.desc("id")), path, order="id")
    assert [i for f in sorted(glob.glob(f"{path}/*.parquet")) for i in pq.read_table(f)["id"].to_pylist()] == list(range(1000))
    assert tb.read_corpus(spark, path).count() == 1000


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    vectors = spark.createDataFrame(
        [("a", "mean", [1.0, 2.0]), ("b", "mean", [3.0, 4.0]), ("a", "max", [5.0, 6.0])], "id string, pooling string, vector array<double>"
    )
    tb.write_store(vectors, path, "base", "h1", 1.5)
    meta = tb.store_meta(spark, path)
    assert meta["dim"] == 2 and meta["poolings"] == ["max", "mean"] and meta["n_rows"] == 2
    assert tb.read_store(spark, path, "mean").count() == 2
    assert tb.stored_vector(spark, path, "a", "max").first()["vector"] == [5.0, 6.0]
    with pytest.raises(KeyError):
        tb.read_store(spark, path, "bos")
    with pytest.raises(KeyError):
        tb.stored_vector(spark, path, "zz", "mean")
    plan = tb.read_store(spark, path, "mean")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(pooling" in plan


def test_small_sinks(spark, tmp_path):
    df = spark.createDataFrame([("P1", "n", AA * 4)], "accession string, name string, seq string")
    tb.write_fasta(df, str(tmp_path / "fasta"), "accession", "name", "seq", 60)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "fasta")).collect()]
    assert lines[0] == ">P1 n" and [len(x) for x in lines[1:]] == [60, 20]
    points = spark.createDataFrame([("a", 0.5, 0.1)], "id string, x double, y double")
    tb.write_map(points, str(tmp_path / "map"), "mean")
    tb.write_map(points, str(tmp_path / "map"), "mean", "local")
    assert tb.read_map(spark, str(tmp_path / "map"), "mean", "local").count() == 1
    assert tb.read_map(spark, str(tmp_path / "map"), "mean").count() == 1
    with pytest.raises(KeyError):
        tb.write_map(points, str(tmp_path / "map"), "mean", "odd")
    splits = spark.createDataFrame([("a", "g", "train")], "id string, group_id string, split string")
    tb.write_splits(splits, str(tmp_path / "splits"), {"seed": 42})
    back, summary = tb.read_splits(spark, str(tmp_path / "splits"))
    assert back.count() == 1 and summary == {"seed": 42}
    tb.write_report(points, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).columns == ["id", "x", "y"]
    tb.write_profiles(df, str(tmp_path / "profiles"))
    assert json.loads(spark.read.text(str(tmp_path / "profiles")).first()["value"])["accession"] == "P1"
    tb.write_clusters(points, str(tmp_path / "clusters"))
    tb.write_encoder_vectors(splits.select("id", F.lit("mean").alias("pooling"), F.array(F.lit(1.0)).alias("vector")), str(tmp_path / "enc"), tb.encoder_slug("Rostlab/ProstT5"))
    assert os.path.isdir(tmp_path / "enc" / "encoder=prostt5" / "pooling=mean")
    with pytest.raises(KeyError):
        tb.encoder_slug("unknown")
    assert tb.encoder_registry(spark).count() == 5


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    first = tb.log_run(spark, path, "bench", {"seed": 1}, {"f1": 0.5})
    tb.log_run(spark, path, "other", {"seed": 2}, {})
    runs = tb.read_runs(spark, path, "bench").collect()
    assert [r["run_id"] for r in runs] == [first] and json.loads(runs[0]["metrics"]) == {"f1": 0.5}
    assert tb.read_runs(spark, path).count() == 2


def test_fingerprints(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") % 3)
    a = tb.table_fingerprint(df).first()
    assert a == tb.table_fingerprint(df.repartition(7).orderBy(F.desc("id"))).first()
    assert a["fingerprint"] != tb.table_fingerprint(df.withColumn("v", F.lit(0))).first()["fingerprint"]
    (tmp_path / "f.txt").write_bytes(b"abc")
    assert file_digests(spark, str(tmp_path / "f.txt")).first()["sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_versioned_projection(spark, tmp_path):
    path = str(tmp_path / "projections")
    df = spark.range(30).select("id", F.array(*[F.rand(i) for i in range(4)]).alias("vector")).persist()
    compute = lambda p: map_coordinates(p, "id", "vector")[0]
    one, hit1 = tb.load_or_project(df, path, {"seed": 1}, compute)
    two, hit2 = tb.load_or_project(df, path, {"seed": 1}, compute)
    _, hit3 = tb.load_or_project(df, path, {"seed": 2}, compute)
    _, hit4 = tb.load_or_project(df.filter("id < 20"), path, {"seed": 1}, compute)
    assert (hit1, hit2, hit3, hit4) == (False, True, False, False)
    assert sorted(one.collect()) == sorted(two.collect())
    df.unpersist()


def test_parsers(spark):
    rows = spark.createDataFrame(
        [("a", 'DOMAIN 5..25; /note="SH3 "; /evidence="x"; DOMAIN 30..55;'), ("b", None), ("z", "DOMAIN 1..2;")], "accession string, ft string"
    )
    corpus = spark.createDataFrame([("a",), ("b",)], "accession string")
    got = {(r["name"], r["start"], r["end"]) for r in en.domain_table(rows, corpus, "accession", "ft").collect()}
    assert got == {("SH3", 5, 25), ("domain", 30, 55)}
    xrefs = spark.createDataFrame([("a", "1ABC; 2DEF;"), ("b", ";")], "accession string, pdb string")
    assert [r["pdb_ids"] for r in en.structure_table(xrefs, corpus, "accession", "pdb").collect()] == [["1ABC", "2DEF"]]
    scores = spark.createDataFrame([("p.Gly34Arg", "0.5"), ("p.Gly34=", "1"), ("p.Ala2Val", None), ("p.Ala2Val", "NaN"), ("p.Ala2Val", "x")], "hgvs_pro string, score string")
    assert [(r["wt"], r["pos"], r["mut"], r["score"]) for r in en.parse_assay_scores(scores).collect()] == [("G", 34, "R", 0.5)]


def test_lookup_rules(spark):
    rows = spark.createDataFrame(
        [("P1", "insulin", "INS", None), ("P2", "insulin receptor", "INSR", "Insulin family"), ("P3", "other", "ins", None), ("INS", "x", None, None)],
        "accession string, name string, gene string, family string",
    )
    ask = lambda q: [(r["accession"], r["score"]) for r in lo.text_lookup(rows, q, F.col("name"), F.col("gene"), F.col("accession"), F.col("family"), "accession").collect()]
    assert ask(" INS ") == [("P1", 245), ("P2", 155), ("INS", 128), ("P3", 125)]
    assert ask("   ") == [] and ask("nothing") == []
    with pytest.raises(lo.IncompleteStoreError):
        lo.aligned(rows.select("accession"), rows.select("accession").filter("accession <> 'P1'"), "accession")


def test_streams(spark, tmp_path):
    inbox, corpus, store = tmp_path / "in", str(tmp_path / "corpus"), str(tmp_path / "store")
    inbox.mkdir()
    columns = list(C.ENTRY_COLUMNS.values())

    def drop(name, rows):
        (inbox / name).write_text("\n".join(json.dumps(dict(zip(columns, r))) for r in rows))

    schema = ", ".join(f"{c} string" for c in columns)
    encoder = em.HashingEncoder(8)

    def run():
        stream = spark.readStream.schema(schema).json(str(inbox))
        q = ap.append_stream(stream, corpus, store, encoder, str(tmp_path / "cp"), ("mean", "max")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    drop("1.json", [entry("P00001", rotated(0)), entry("P00002", rotated(0)), entry("P00003", "ACD")])
    run()
    drop("2.json", [entry("P00001", rotated(0)), entry("P00004", rotated(2))])
    run()
    assert sorted(r["accession"] for r in spark.read.parquet(corpus).collect()) == ["P00001", "P00004"]
    vectors = spark.read.parquet(f"{store}/vectors")
    assert vectors.count() == 4 and vectors.select("id").distinct().count() == 2

    asks = tmp_path / "asks"
    asks.mkdir()
    (asks / "a.json").write_text(json.dumps({"id": "q", "sequence": rotated(2)}))
    base = spark.read.parquet(f"{store}/vectors").filter("pooling = 'mean'").select("id", "vector")
    stream = spark.readStream.schema("id string, sequence string").json(str(asks))
    q = ap.search_stream(stream, base, encoder, str(tmp_path / "hits"), str(tmp_path / "cp2"), 1).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert spark.read.parquet(str(tmp_path / "hits")).first()["id"] == "P00004"

    q = ap.cache_stream(stream, str(tmp_path / "cache"), encoder, str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert em.latest_vectors(KeyedStore(spark, str(tmp_path / "cache")).read()).count() == 1
