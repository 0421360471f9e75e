import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkit.llm import collisions, phrases, queries, spelling
from tests.llm.fixtures import SCHEMA, awkward, nothing

SF = "/root/testdata/sf0.001"
VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    # names that the operator uses inside
    T.StructField("id", T.StringType()), T.StructField("dim", T.StringType()), T.StructField("block", T.StringType()),
])


# -- nearest vectors

def plain_nearest(rows, every=50, k=5):
    """{query: [(id, cosine)]} of usable rows, by all pairs."""
    fine = [
        (i, np.array(v, dtype=np.float64)) for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = {}
    for q, a in fine:
        if q % every:
            continue
        best = dict(out.get(q, []))
        for i, b in fine:
            if i != q and len(a) == len(b):
                s = float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
                best[i] = max(best.get(i, -2.0), s)
        out[q] = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return {q: v for q, v in out.items() if v}


def hits_of(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_neighbours_reach_the_recall(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want = plain_nearest([(r["vec_id"], r["embedding"]) for r in rows.collect()])
    got = hits_of(queries.op11_collisions(spark, f"/root/testdata/{sf}"))
    assert got.keys() == want.keys() and all(len(got[q]) == 5 for q in got)
    pairs = lambda x: {(q, i) for q, hits in x.items() for i, _ in hits}
    assert len(pairs(got) & pairs(want)) >= 0.97 * len(pairs(want))
    exact = {(q, i): s for q, hits in want.items() for i, s in hits}
    assert all(abs(s - exact[q, i]) < 1e-12 for q, hits in got.items() for i, s in hits if (q, i) in exact)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    plain = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    odd = [
        (None, [1.0] * 8), (100, None), (150, []), (200, [0.0] * 8), (250, [1.0, None] * 4), (300, [math.nan] * 8), (350, [math.inf] + [1.0] * 7),
        (400, [1e30] * 8), (450, [1e-30] * 8), (500, [1.0, 2.0]), (501, [2.0, 1.0]),  # 500 meets vectors of two numbers only
        (600, [3.0] * 8), (600, [3.0] * 8), (0, rng.normal(size=8).tolist()),  # a repeated row, and an id with two vectors
    ]
    same = [(1000 + i, [2.0, 1.0] * 4) for i in range(40)]  # a group of copies: ties go to the smaller ids
    rows = plain + odd + same
    df = spark.createDataFrame([(i, v, 1, "x", "y", "z") for i, v in rows], VECTORS).repartition(3)
    got, want = hits_of(collisions.nearest(df)), plain_nearest([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert got.keys() == want.keys()
    assert [i for i, _ in got[500]] == [501]
    assert [i for i, _ in got[1000]] == [1001, 1002, 1003, 1004, 1005]
    found = [(q, i) for q in want for i, _ in want[q] if i in dict(got[q])]
    assert len(found) >= 0.97 * sum(map(len, want.values()))
    assert hits_of(collisions.nearest(df.filter("vec_id < 0"))) == {}


def test_a_vector_within_the_radius_collides():
    p = math.erf(collisions.REACH / math.sqrt(2))
    m, least = collisions.PROJECTIONS, collisions.threshold()
    tail = sum(math.comb(m, h) * p ** h * (1 - p) ** (m - h) for h in range(least, m + 1))
    assert 1 - collisions.MISS <= tail < 1
    steps = collisions.radii()
    assert steps == sorted(steps) and steps[-2] < 2 * collisions.GROWTH and math.isinf(steps[-1])


def test_index_is_searched_without_building(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").withColumnRenamed("vec_id", "id").withColumnRenamed("embedding", "vector")
    index = collisions.build(rows, 10, block_rows=100)
    assert index.count() >= 4 and sum(len(r["ids"]) for r in index.collect()) == rows.count()
    hits = collisions.search(index, rows.filter("id % 7 = 0"), 10)
    assert hits.groupBy("query_id").count().filter("count <> 10").count() == 0 and hits.filter("query_id = id").count() == 0


# -- phrases

def plain_phrases(rows, limit=2000, least=30):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i:i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), p, f[p[:k]], f[p[k:]]))
        longer = defaultdict(int)
        for _, a, _, p, _, _ in found:
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longer[p[i:i + n]] = max(longer[p[i:i + n]], a)
        kept = [x for x in found if not 100 * longer[x[3]] >= 80 * x[1]]
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, r + 1, x[2], x[1], x[4], x[5], totals[lang], x[0]) for r, x in enumerate(kept[:limit])]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in phrases.mine(df, **options).collect())


def test_phrases_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(tuple(r) for r in queries.op12_phrases(spark, SF).collect()) == sorted(con.execute(phrases.SQL).fetchall())


@pytest.mark.parametrize("limit", [5, 60])
def test_small_limits_settle_after_some_rounds(spark, limit):
    """With a small limit the first frontier is narrow, and what it leaves out must not matter."""
    rng = np.random.default_rng(limit)
    words = [f"w{i}" for i in range(12)]
    texts = []
    for t in range(150):
        run = [words[i] for i in (rng.zipf(1.5, size=60) - 1) % 12]
        texts.append((" ".join(run) + (", Ab cd ef gh ij. ab CD ef gh" if t % 2 else " x y z"), ["en", "de", None][t % 3]))
    df = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(texts)], "doc_id long, text string, lang string")
    assert mined(df, limit=limit, least=8) == plain_phrases(texts, limit, 8)


def test_awkward_phrases(spark):
    docs = awkward(spark)
    rows = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()]
    assert mined(docs) == plain_phrases(rows)
    assert mined(nothing(spark)) == []


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000_000_000
    rows = spark.createDataFrame([(big, big + 7, big - 3)], "a long, l long, r long")
    got = rows.select(phrases._share("a", "(cast(l as decimal(20,0)) + r)").alias("s")).first()["s"]
    assert got == 2_000_000 * big // (2 * big + 4)


# -- spelling

def plain_groups(rows):
    counts = Counter()
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near, holes = {w: set() for w in words}, defaultdict(set)
    for w in words:
        for p in range(len(w)):
            less = w[:p] + w[p + 1:]
            if less in words:
                near[w].add(less)
                near[less].add(w)
            holes[p, less].add(w)
    for group in holes.values():
        for a, b in itertools.permutations(group, 2):
            near[a].add(b)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def grouped(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert grouped(queries.op13_spelling(spark, SF)) == plain_groups([(r["doc_id"], r["text"]) for r in docs])


def test_awkward_words(spark):
    docs = awkward(spark)
    assert grouped(spelling.group(docs)) == plain_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert grouped(spelling.group(nothing(spark))) == set()


def dense_words():
    """Words of few letters, many of them near to many, with runs of equal letters."""
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), size=rng.integers(7, 10))) for _ in range(900)} | {"a" * n for n in range(7, 30)}
    return sorted(words)


@pytest.mark.parametrize("chunk", [40, 100_000])
def test_cut_partitions_find_the_same_pairs(spark, chunk):
    words = dense_words()
    n = {w: 2 + (7 * i) % 50 for i, w in enumerate(words)}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    got = {r["word"]: (r["n_near"], r["form"], r["form_n"]) for r in spelling.near_words(df, chunk_words=chunk).collect()}
    distance_one = lambda a, b: a != b and (
        len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
        or abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1:] == min(a, b, key=len) for i in range(max(len(a), len(b))))
    )
    for w in words:
        near = [x for x in words if distance_one(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        assert got[w] == (len(near), best, n[best] if best else None)


def test_acceptor_is_minimal_and_numbers_its_words():
    words = ["tapping", "tipping", "topping", "typping", "zapping"]
    letters = np.array(words).view(np.uint32).reshape(5, 7).astype(np.int64)
    acc = spelling.Acceptor(letters, np.full(5, 7), np.zeros(5, dtype=np.int64))
    # t and z lead to different states; a, i, o, y behind t, and a behind z, to the same one
    assert acc.n_states == 1 + 5 + 1 + 1 + 1
    state, number = acc.roots[0], 0
    for c in "topping":
        _, arc = acc.same_letter(np.array([state]), np.array([ord(c)]))
        number, state = number + acc.skip[arc[0]], acc.target[arc[0]]
    assert number == words.index("topping")


def test_chains_of_forms(spark):
    steps = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(18)]
    got = dict(tuple(r) for r in spelling.roots(spark.createDataFrame(steps, "word string, form string")).collect())
    assert got == {w: "w18" for w, _ in steps}
