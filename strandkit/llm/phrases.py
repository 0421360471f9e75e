"""Phrases of 2 to 4 words that hold together, found by best-first growth.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?]`` and line ends, and into words at
spaces and tabs.  All counts are per language; a null language is ``und``, a null text empty.

A phrase grows word by word.  A prefix p seen f(p) times bounds the score of each phrase that
begins with it: such a phrase occurs f(p) times at most, and cut behind its first word w scores
no more than 2000000 f(p) / (f(w) + f(p)).  The same holds from the right, for what ends with p
and its last word.  The frontier of a language are the phrases whose bound, from either side,
reaches a score; those are expanded by one word to both sides, which takes one pass over the
texts for three words and one for four.  If ``LIMIT`` phrases at or above that score survive
(ties with the last included), the language is settled: all that is not expanded scores
less.  Otherwise the score is lowered and the frontier of the languages left grows.  The rights
and lefts of all cuts, and all phrases one word longer that can remove a phrase, lie inside the
frontier, so counts, scores and removals are exact.

Sets of phrases reach the tasks as bitmaps of a fixed size by hash.  A false hit only counts
a phrase that was not needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandkit.llm.common import arrow_rows, column_of, prepare
from strandkit.session import reliable_checkpoint

# Fixed values of the contract.
LEAST, LIMIT, SCALE, COVERED = 30, 2000, 2_000_000, (100, 80)
LONGEST = 4
# First frontier: about so many times LIMIT phrases of two words; each further one is wider by WIDER.
START, WIDER, ROUNDS = 2, 4, 3
# Bits of a bitmap, and bytes of text counted at once.
BITS, CHUNK_BYTES = 1 << 26, 4 << 20
SLICES = 32

_KIND = np.zeros(256, dtype=np.uint8)  # 0 word, 1 space, 2 end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


# -- words of a batch ----------------------------------------------------------------

class Words:
    """Words of some texts: codes into a dictionary, the piece and the language of each."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        texts, langs = texts.fill_null(""), langs.fill_null("und").dictionary_encode()
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = (np.frombuffer(raw, dtype=np.uint8) if raw else np.zeros(0, np.uint8))[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        kind = _KIND[data]
        inside = kind == 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        first[heads] = inside[heads]  # a text begins a word
        starts = np.flatnonzero(first)
        at = np.cumsum(inside, dtype=np.int32)[starts] - 1 if len(starts) else np.zeros(0, dtype=np.int32)
        letters = _LOWER[data[inside]]
        ends = np.append(at, len(letters)).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
        self.words, self.codes = words.dictionary, words.indices.to_numpy()
        text = np.searchsorted(offsets, starts, side="right") - 1
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts] + text if len(starts) else np.zeros(0, dtype=np.int64)
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy()[text]

    def windows(self, n: int) -> np.ndarray:
        """First words of the phrases of n words."""
        last = len(self.codes) - n + 1
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1:]) if last > 0 else np.zeros(0, dtype=np.int64)

    def count(self, at: np.ndarray, n: int) -> pa.RecordBatch:
        """(lang, phrase, f) of the phrases of n words that begin at these places."""
        key, size = self.lang[at].astype(np.int64), len(self.langs) or 1
        for i in range(n):
            _, code = np.unique(self.codes[at + i], return_inverse=True)
            width = int(code.max(initial=0)) + 1
            if size * width >= 1 << 62:
                _, key = np.unique(key, return_inverse=True)
                size = int(key.max(initial=0)) + 1
            key, size = key * width + code, size * width
        _, one, f = np.unique(key, return_index=True, return_counts=True)
        at = at[one]
        parts = [self.words.take(pa.array(self.codes[at + i])) for i in range(n)]
        phrase = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
        return arrow_rows({"lang": self.langs.take(pa.array(self.lang[at])), "phrase": phrase, "f": f}, COUNT_SCHEMA)


COUNT_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def _hash_all(strings: pa.Array, seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(s, seed) for s in strings.cast(pa.binary()).to_pylist()), np.uint64, len(strings))


def _fold(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """A place in the bitmap for each (language, words)."""
    out = lang.copy()
    for w in words:
        out = (out ^ w) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out & np.uint64(BITS - 1)


# -- bitmaps of phrases --------------------------------------------------------------

def _places(n: int):
    def run(batches):
        for batch in batches:
            words = pc.split_pattern(column_of(batch, "phrase"), " ").flatten().dictionary_encode()
            hashed = _hash_all(words.dictionary)[words.indices.to_numpy()].reshape(-1, n) if batch.num_rows else np.zeros((0, n), np.uint64)
            places = _fold(_hash_all(column_of(batch, "lang"), 1), [hashed[:, i] for i in range(n)])
            yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64))], ["place"])

    return run


def bitmap(phrases: DataFrame, n: int) -> np.ndarray:
    """A bitmap of BITS bits; the driver gets at most BITS / 64 rows."""
    places = phrases.select("lang", "phrase").mapInArrow(_places(n), "place bigint")
    words = places.groupBy(F.shiftright("place", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")
    ).toArrow()
    out = np.zeros(BITS // 64, dtype=np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _in(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1) == 1


# -- passes over the texts -----------------------------------------------------------

def _cut(text: bytes, size: int) -> Iterator[bytes]:
    """A long text in parts of ``size`` bytes and more, cut where a piece ends."""
    while len(text) > size:
        ends = np.flatnonzero(_KIND[np.frombuffer(text, dtype=np.uint8, offset=size)] == 2)
        if not len(ends):
            break
        yield text[:size + int(ends[0])]
        text = text[size + int(ends[0]) + 1:]
    yield text


def _chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[Words]:
    """Texts of about ``size`` bytes at a time, so that a task's memory does not follow its batches."""
    for batch in batches:
        text, lang = column_of(batch, "text"), column_of(batch, "lang")
        place = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
        edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True]) if len(place) else np.zeros(1, dtype=int)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            some = text.slice(a, b - a)
            if some.nbytes > 2 * size:  # one of them is long by itself
                for i in range(b - a):
                    for part in _cut((some[i].as_py() or "").encode(), size):
                        yield Words(pa.array([part], pa.binary()).cast(pa.string()), lang.slice(a + i, 1))
            else:
                yield Words(some, lang.slice(a, b - a))


def count_phrases(docs: DataFrame, n: int, sound: np.ndarray | None = None, frontier: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, f) of phrases of n words.

    ``sound``: bitmap of phrases of min(n - 1, 2) words; all such parts must be in it.
    ``frontier``: bitmap of phrases of n - 1 words; the first or the last part must be in it."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((sound, frontier))  # two bitmaps of a fixed size at most

    def run(batches):
        sound, frontier = shared.value
        for words in _chunks(batches):
            at = words.windows(n)
            if n > 1:
                hashed, lang = _hash_all(words.words), _hash_all(words.langs, 1)
                part = lambda i, m: _fold(lang[words.lang[at]], [hashed[words.codes[at + i + j]] for j in range(m)])
                m = min(n - 1, 2)
                for i in range(n - m + 1):
                    at = at[_in(sound, part(i, m))]
                if frontier is not None:
                    at = at[_in(frontier, part(0, n - 1)) | _in(frontier, part(1, n - 1))]
            if len(at):
                yield words.count(at, n)

    text = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = text.mapInArrow(run, "lang string, phrase string, f bigint")
    return counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


# -- scores --------------------------------------------------------------------------

def _share(a: str, whole: str) -> Column:
    """floor(SCALE * a / whole), exact: products are decimals of up to 38 digits."""
    return F.expr(f"cast((cast({a} as decimal(19,0)) * {SCALE}) div cast({whole} as decimal(20,0)) as bigint)")


def _words(phrase: str = "phrase") -> Column:
    return F.split(F.col(phrase), " ")


def _joined(words: Column, first, length) -> Column:
    return F.array_join(F.slice(words, first, length), " ")


def score(phrases: DataFrame, n: int, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, bound): the lowest cut, ties to the first.

    ``counts`` holds phrases of fewer words.  Phrases with a part that was not counted lie
    outside the frontier and go.  ``bound`` is that of phrases grown from this one."""
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n - 1))))
    w = _words()
    sides = cuts.select(
        "lang", "phrase", "f", "k", F.explode(F.array(
            F.struct(F.lit(True).alias("left"), _joined(w, F.lit(1), F.col("k")).alias("part")),
            F.struct(F.lit(False).alias("left"), _joined(w, F.col("k") + 1, F.lit(n) - F.col("k")).alias("part")),
        )).alias("s"),
    ).select("lang", "phrase", "f", "k", "s.left", "s.part")
    known = sides.join(counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("p")), ["lang", "part"])
    # left and right of a cut, then the cuts of a phrase; its rows are few
    cut = known.groupBy("lang", "phrase", "f", "k").agg(
        F.max(F.when(F.col("left"), F.col("p"))).alias("l"), F.max(F.when(~F.col("left"), F.col("p"))).alias("r")
    ).filter("l is not null and r is not null").withColumn("score", _share("f", "(l + r)"))
    edge = F.least(F.min(F.when(F.col("k") == 1, F.col("l"))), F.min(F.when(F.col("k") == n - 1, F.col("r"))))
    best = cut.groupBy("lang", "phrase", F.col("f").alias("a")).agg(
        F.min(F.struct("score", "k", "l", "r")).alias("b"), F.count(F.lit(1)).alias("cuts"), edge.alias("edge")
    ).filter(F.col("cuts") == n - 1)
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score", _share("a", "(edge + a)").alias("bound"))


def survivors(phrases: DataFrame, longer: DataFrame) -> DataFrame:
    """Without those that a phrase of one more word covers.  A phrase of two more words
    that covers one contains a phrase of one more word that does."""
    w, n = _words(), F.size(_words())
    parts = longer.select("lang", "f", F.explode(F.array(_joined(w, F.lit(1), n - 1), _joined(w, F.lit(2), n - 1))).alias("phrase"))
    most = parts.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    whole, share = COVERED
    covered = f"cast(most as decimal(19,0)) * {whole} >= cast(a as decimal(19,0)) * {share}"
    return phrases.join(most, ["lang", "phrase"], "left").filter(f"most is null or not ({covered})").drop("most")


# -- the search ----------------------------------------------------------------------

def _first(df: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of each language: slices first, so no task sorts a whole one."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    sliced = df.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    some = sliced.withColumn("rank", F.row_number().over(W.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= limit)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= limit).drop("slice")


def _thresholds(pairs: DataFrame, wanted: int | None) -> DataFrame:
    """(lang, least): the score of about the ``wanted``-th pair; 0 for all, or if there are fewer."""
    if wanted is None:
        return pairs.select("lang").distinct().withColumn("least", F.lit(0).cast("long"))
    slices = 2000
    grouped = pairs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("score", [i / slices for i in range(slices + 1)], 10000).alias("steps")
    )
    step = F.floor((1 - F.lit(wanted) / F.col("n")) * slices).cast("int")
    return grouped.select("lang", F.when(F.col("n") <= wanted, 0).otherwise(F.get("steps", step)).cast("long").alias("least"))


def mine(docs: DataFrame, limit: int = LIMIT, least: int = LEAST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``limit`` phrases of each language by
    score and frequency, ties by the bytes of the phrase.  Only text and lang are read."""
    spark = prepare(docs.sparkSession)
    docs = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    often = lambda df: df.filter(F.col("f") >= least)
    all_words = reliable_checkpoint(count_phrases(docs, 1))
    totals = all_words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = reliable_checkpoint(often(all_words))
    pair_counts = reliable_checkpoint(often(count_phrases(docs, 2, bitmap(words, 1))))
    pairs = reliable_checkpoint(score(pair_counts, 2, words))
    sound = bitmap(pair_counts, 2)

    done, left, wanted = None, docs, START * limit
    for turn in range(ROUNDS + 1):
        bounds = reliable_checkpoint(_thresholds(pairs, wanted if turn < ROUNDS else None))
        reach = lambda df, by: df.join(bounds, "lang").filter(F.col(by) >= F.col("least")).drop("least")
        threes_f = reliable_checkpoint(often(count_phrases(left, 3, sound, bitmap(reach(pairs, "bound"), 2))))
        shorter = words.unionByName(pair_counts)
        threes = reliable_checkpoint(score(threes_f, 3, shorter))
        fours_f = reliable_checkpoint(often(count_phrases(left, 4, sound, bitmap(reach(threes, "bound"), 3))))
        fours = score(fours_f, 4, shorter.unionByName(threes_f))
        found = pairs.unionByName(threes).unionByName(fours)
        kept = reliable_checkpoint(survivors(reach(found, "score"), threes_f.unionByName(fours_f)))
        sizes = bounds.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang", "left")
        settled = reliable_checkpoint(sizes.select("lang", (F.col("least").eqNullSafe(0) | (F.coalesce("kept", F.lit(0)) >= limit)).alias("settled")))
        ready = _first(kept.join(settled.filter("settled"), "lang", "left_semi"), limit)
        done = ready if done is None else done.unionByName(ready)
        rest = settled.filter("not settled")
        if not rest.head(1):
            break
        left, pairs = left.join(rest, "lang", "left_semi"), reliable_checkpoint(pairs.join(rest, "lang", "left_semi"))
        wanted *= WIDER
    return done.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT doc, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS at FROM (SELECT doc, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS p FROM d)),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, len AS len, unnest(list_transform(range(1, len(w) - len + 2), lambda i: array_to_string(w[i:i + len - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3), (4)) AS l(len) WHERE len(w) >= len),
f AS (SELECT lang, len, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len = 1 GROUP BY lang),
c AS (SELECT lang, len, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE len >= 2 AND f >= 30),
k AS (SELECT lang, len, phrase, a, k, array_to_string(w[:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM c, (VALUES (1), (2), (3)) AS v(k) WHERE k < len),
s AS (SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = lp JOIN f y ON y.lang = k.lang AND y.phrase = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
m AS (SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[:len - 1], ' '), array_to_string(w[2:], ' ')]) AS part FROM c WHERE len >= 3) GROUP BY ALL),
v AS (SELECT b.* FROM b LEFT JOIN m ON m.lang = b.lang AND m.part = b.phrase WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM v)
SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""
