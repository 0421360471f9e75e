"""k-mer features and the exact Jaccard similarity join."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandkit import constants as C
from strandkit.operators.overlap import candidates, count_rarity, mix
from strandkit.session import reliable_checkpoint

# Of the elements that a pair must share, the part that may be left out of the search for it: the others are
# counted, so with 1 any shared element would make a candidate.
LEFT_OUT = 0.75
# Sets that a task keeps while it compares pairs.
RECENT_SETS = 128
# Symbols of a left table that goes whole to every task.
FEW_SYMBOLS = 1 << 20
# Rows of window counts that leave a task at once.
COUNT_ROWS = 1 << 16


def kmer_frequencies(df: DataFrame, ident: str, seq: str, k: int = 3, alphabet: str | None = C.AMINO_ACIDS) -> DataFrame:
    """Sparse (id, kmer, n, freq); freq divides by the number of kept windows.

    The texts are shuffled once and sorted by id; a task counts the windows of one id at a time,
    so it never holds those of its other ids.
    """
    rows = df.select(F.col(ident).alias("id"), F.col(seq).alias("seq")).filter(F.length("seq") >= k)
    kind = rows.schema["id"].dataType
    names, types = [ident, "kmer", "n", "freq"], [to_arrow_type(kind), pa.string(), pa.int64(), pa.float64()]

    def count(batches):
        held, size = [[], [], [], []], 0

        def put(key, found):
            total = sum(found.values())
            for column, values in zip(held, ([key] * len(found), found.keys(), found.values(), [n / total for n in found.values()])):
                column.extend(values)
            return len(found)

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held, types)], names)

        last, counted = None, {}
        for batch in batches:
            for key, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "seq"))):
                found = window_counts(text, k, alphabet)
                if key == last:
                    for x, n in found.items():
                        counted[x] = counted.get(x, 0) + n
                    continue
                size += put(last, counted)
                last, counted = key, found
                if size >= COUNT_ROWS:
                    yield packed()
                    held, size = [[], [], [], []], 0
        put(last, counted)
        yield packed()

    sorted_rows = rows.repartition("id").sortWithinPartitions("id")
    schema = T.StructType([T.StructField(ident, kind)] + [T.StructField(n, t) for n, t in zip(names[1:], (T.StringType(), T.LongType(), T.DoubleType()))])
    return sorted_rows.mapInArrow(count, schema)


def window_counts(text: str, k: int, alphabet: str | None = None) -> dict[str, int]:
    """How often each window of ``k`` symbols occurs; with an alphabet only those made of its symbols."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if len(points) < k:
        return {}
    symbols, place = np.unique(points, return_inverse=True)
    base = bound = len(symbols)
    code = place.astype(np.int64)
    for i in range(1, k):
        if bound * base >= 1 << 62:  # numbers are dealt anew, one to one
            held, code = np.unique(code, return_inverse=True)
            bound = len(held)
        code, bound = code[:-1] * base + place[i:], bound * base
    at = np.arange(len(code))
    if alphabet is not None:
        other = np.cumsum(np.r_[0, ~np.isin(points, [ord(x) for x in alphabet])])
        at = np.flatnonzero(other[k:] == other[:-k])
    _, first, n = np.unique(code[at], return_index=True, return_counts=True)
    return {text[i:i + k]: m for i, m in zip(at[first].tolist(), n.tolist())}


def composition(df: DataFrame, ident: str, seq: str, alphabet: str = C.AMINO_ACIDS) -> DataFrame:
    """Share of each symbol over the full length, as one array in alphabet order."""
    size = F.greatest(F.length(seq), F.lit(1))
    shares = [(F.length(seq) - F.length(F.replace(F.col(seq), F.lit(s), F.lit("")))) / size for s in alphabet]
    return df.select(ident, F.array(*shares).alias("vector"))


def sparse_cosine(pairs: DataFrame, features: DataFrame, ident: str) -> DataFrame:
    """Adds ``cosine`` of two sparse feature rows to a pair table (a, b, ...).

    Products come from equi-joins on (row, k-mer), one row per shared k-mer.
    """
    keys = pairs.columns
    named = pairs.select(F.col("a").alias(ident)).unionByName(pairs.select(F.col("b").alias(ident))).distinct()
    rows = features.join(named, ident, "left_semi").select(ident, "kmer", "freq")
    left = rows.select(F.col(ident).alias("a"), "kmer", F.col("freq").alias("fa"))
    right = rows.select(F.col(ident).alias("b"), "kmer", F.col("freq").alias("fb"))
    products = pairs.join(left, "a").join(right, ["b", "kmer"]).groupBy(*keys).agg(
        F.sum(F.col("fa") * F.col("fb")).alias("__dot")
    )
    norms = rows.groupBy(ident).agg(F.sqrt(F.sum(F.col("freq") * F.col("freq"))).alias("__norm"))
    out = (
        pairs.join(norms.select(F.col(ident).alias("a"), F.col("__norm").alias("__na")), "a", "left")
        .join(norms.select(F.col(ident).alias("b"), F.col("__norm").alias("__nb")), "b", "left")
        .join(products, keys, "left")
    )
    cosine = F.col("__dot") / F.greatest(F.col("__na") * F.col("__nb"), F.lit(C.EPSILON))
    return out.select(*keys, F.coalesce(cosine, F.lit(0.0)).alias("cosine"))


@lru_cache
def _digits(k: int) -> np.ndarray:
    return np.random.default_rng(k).integers(1, 1 << 63, size=k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_places(text: str, k: int) -> np.ndarray:
    """Each window of ``k`` symbols as a number of 64 bits, in order of the text."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    points += np.uint64(1)
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    digits = _digits(k)
    number = points[:n] * digits[0]
    for i in range(1, k):
        number += points[i:i + n] * digits[i]
    return mix(number)


def distinct(numbers: np.ndarray) -> np.ndarray:
    """Sorted, each once: sorting takes a fraction of the time of ``np.unique`` on numbers."""
    numbers = np.sort(numbers)
    return numbers[np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])] if len(numbers) else numbers


def window_numbers(text: str, k: int) -> np.ndarray:
    """The distinct windows of ``k`` symbols as numbers of 64 bits, sorted."""
    return distinct(window_places(text, k))


def similar_sequences(
    left: DataFrame, right: DataFrame | None, k: int, threshold: float
) -> tuple[DataFrame, DataFrame]:
    """Exact k-mer Jaccard join of (id, seq) tables, on distinct sequences.

    Returns ``near`` (ka, kb, jaccard) over keys of distinct sequences and
    ``members`` (side, id, key).  Without ``right`` the pairs are those of ``left``
    with itself, ka < kb.  Copies share a key, so they never multiply candidates.

    Two sets that reach the threshold share an element of their prefixes when
    elements are ordered by rarity (prefix filtering), so frequent k-mers never
    enter the join.  Prefixes travel packed (``overlap``); the pairs found there are
    compared whole.
    """
    tag = lambda df, side: df.select(F.lit(side).alias("side"), "id", F.sha2("seq", 256).alias("sig"), "seq")
    rows = tag(left, 0) if right is None else tag(left, 0).unionByName(tag(right, 1))
    texts = rows.groupBy("sig").agg(
        F.first("seq").alias("seq"), F.min("side").alias("low"), F.max("side").alias("high"),
    )

    def measure(batches):
        for batch in batches:
            sizes = [len(window_numbers(t, k)) for t in batch.column("seq").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32())], [*batch.schema.names, "size"])

    # The checkpoint keeps the short keys fixed.
    sets = reliable_checkpoint(
        texts.filter(F.length("seq") >= k).mapInArrow(measure, "sig string, seq string, low int, high int, size int")
        .withColumn("key", F.monotonically_increasing_id())
    )
    members = rows.select("side", "id", "sig").join(sets.select("sig", "key"), "sig").select("side", "id", "key")
    on_left, on_right = F.col("low") == 0, (F.col("low") == 0) if right is None else (F.col("high") == 1)
    known = sets.agg(*[
        f(F.when(side, F.col("size"))).alias(name)
        for side, at in ((on_left, "left"), (on_right, "right")) for f, name in ((F.sum, f"{at}_sum"), (F.min, f"{at}_min"), (F.max, f"{at}_max"))
    ]).first().asDict()
    known = {name: value or 0 for name, value in known.items()}
    # a set with no partner of a size that fits stays out
    fit = lambda at: (F.col("size") >= known[f"{at}_min"] * threshold - 1e-9) & (F.col("size") * threshold - 1e-9 <= known[f"{at}_max"])
    part = sets.filter((on_left & fit("right")) | (on_right & fit("left"))).select("key", "seq", "size", on_left.alias("l"), on_right.alias("r"))
    numbers = lambda batch: (window_numbers(t, k) for t in batch.column(batch.schema.get_field_index("seq")).to_pylist())
    sides = [count_rarity(part.filter("l"), numbers, known["left_sum"])]
    if right is not None:
        sides.append(count_rarity(part.filter("r"), numbers, known["right_sum"]))
    shared = sets.sparkSession.sparkContext.broadcast(sides)  # 16 MB at most
    # an element of one set only, or of one side only, matches nothing
    alone = right is None
    least = 2 if alone else 1

    def describe(batch):
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        for key, size, l, r, found in zip(*(column(c).to_pylist() for c in ("key", "size", "l", "r")), numbers(batch)):
            levels = [side.of(found) for side in shared.value]
            matched = np.ones(len(found), dtype=bool)
            for side, level in zip(shared.value, levels):
                if side.whole:
                    matched &= level >= least
            # a set of which too few elements occur elsewhere has no partner
            if matched.sum() < size * threshold - 1e-9:
                continue
            # A set that looks for partners no smaller than itself shares 2 t / (1 + t) of its elements with each,
            # any set t of them: nearly as many, the most frequent ones, are left out of what is looked for and up.
            looked_up = max(0, math.ceil(size * threshold * LEFT_OUT - 1e-9) - 1)
            rest = max(0, math.ceil(size * 2 * threshold / (1 + threshold) * LEFT_OUT - 1e-9) - 1) if alone else looked_up
            rarity = sum(level.astype(np.int16) for level in levels)
            # found is sorted, so equal ranks stay in order of their numbers
            order = np.argsort(np.where(matched, rarity, np.int16(-1)), kind="stable")[:size - looked_up]
            sent = found[order[matched[order]]]
            if len(sent):
                yield (key, size, rest, looked_up, len(sent), int(matched[order[:size - rest]].sum()), l, r), sent

    window = lambda sizes: (
        np.searchsorted(sizes, sizes * threshold - 1e-9), np.searchsorted(sizes, sizes / threshold + 1e-6, side="right"),
    )
    need = lambda a, b: (a["size"].astype(float) + b["size"]) * (threshold / (1 + threshold)) - np.maximum(a["rest"], b["other"])
    sized = part.withColumn("mass", F.col("size") * (1 - threshold * LEFT_OUT))
    met = reliable_checkpoint(candidates(sized, describe, 1 / threshold, window, need, right is None))
    if right is None:
        met = met.select(F.least("a", "b").alias("ka"), F.greatest("a", "b").alias("kb"))
    else:
        met = met.select(F.col("a").alias("ka"), F.col("b").alias("kb"))

    def compare(batches):
        recent = {}

        def of(key, text):
            if key not in recent:
                if len(recent) >= RECENT_SETS:
                    recent.clear()
                recent[key] = window_numbers(text, k)
            return recent[key]

        for batch in batches:
            values = []
            for ka, kb, x, y in zip(*(batch.column(c) for c in ("ka", "kb", "sa", "sb"))):
                a, b = of(ka.as_py(), x.as_py()), of(kb.as_py(), y.as_py())
                both = np.sort(np.concatenate([a, b]))
                n = int(np.count_nonzero(both[1:] == both[:-1]))
                values.append(n / (len(a) + len(b) - n))
            yield pa.RecordBatch.from_arrays([batch.column("ka"), batch.column("kb"), pa.array(values, pa.float64())], ["ka", "kb", "jaccard"])

    a = sets.select(F.col("key").alias("ka"), F.col("seq").alias("sa"))
    b = sets.select(F.col("key").alias("kb"), F.col("seq").alias("sb"))
    both = met.join(a, "ka").join(b, "kb").select("ka", "kb", "sa", "sb")
    near = reliable_checkpoint(both.mapInArrow(compare, "ka long, kb long, jaccard double").filter(F.col("jaccard") >= threshold - 1e-12))
    if right is not None:
        equal = sets.filter("low = 0 and high = 1").select(
            F.col("key").alias("ka"), F.col("key").alias("kb"), F.lit(1.0).alias("jaccard")
        )
        near = near.unionByName(equal)
    return near, members


def _representatives(members: DataFrame, side: int, key: str, ident: str) -> DataFrame:
    return members.filter(F.col("side") == side).groupBy(F.col("key").alias(key)).agg(F.min("id").alias(ident))


def _slim(df: DataFrame, ident: str, seq: str) -> DataFrame:
    return df.select(F.col(ident).alias("id"), F.col(seq).alias("seq")).filter(F.col("seq").isNotNull())


def jaccard_pairs(
    df: DataFrame, ident: str, seq: str, k: int = C.LINK_K, threshold: float = C.LINK_THRESHOLD
) -> DataFrame:
    """(a, b, jaccard) over distinct sequences, each named by its smallest id."""
    near, members = similar_sequences(_slim(df, ident, seq), None, k, threshold)
    x, y = _representatives(members, 0, "ka", "x"), _representatives(members, 0, "kb", "y")
    return near.join(x, "ka").join(y, "kb").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard"
    )


def best_match(
    left: DataFrame, right: DataFrame, ident: str, seq: str,
    k: int = C.LINK_K, threshold: float = C.LINK_THRESHOLD,
) -> DataFrame:
    """(a, b, jaccard): the most similar right row of each left row, ties by id.

    A left table of few symbols goes to every task, which reads its part of the right table once."""
    left, right = _slim(left, ident, seq), _slim(right, ident, seq)
    some = left.filter(F.length("seq") >= k)
    # every row counted has k symbols at least
    symbols = some.select(F.length("seq").alias("n")).limit(FEW_SYMBOLS // k + 1).agg(F.sum("n")).first()[0] or 0
    if symbols <= FEW_SYMBOLS:
        return _best_of_few(some, right, k, threshold)
    near, members = similar_sequences(left, right, k, threshold)
    best = near.join(_representatives(members, 1, "kb", "b"), "kb").groupBy("ka").agg(
        F.min_by(F.struct("b", "jaccard"), F.struct((-F.col("jaccard")).alias("j"), "b")).alias("best")
    )
    rows = members.filter("side = 0").select(F.col("id").alias("a"), F.col("key").alias("ka"))
    return rows.join(best, "ka").select("a", "best.b", "best.jaccard")


def _best_of_few(left: DataFrame, right: DataFrame, k: int, threshold: float) -> DataFrame:
    """``best_match`` for a left table (id, seq) of few symbols.

    Tasks hold the windows of the distinct left texts and, for each text, the best right row so far:
    no pair and no right text is shuffled."""
    texts = [r["seq"] for r in left.select("seq").distinct().collect()]  # ``FEW_SYMBOLS`` at most
    sets = [window_numbers(t, k) for t in texts]
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    elements = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    order = np.argsort(elements, kind="stable")
    known, starts = np.unique(elements[order], return_index=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[order]
    sigs = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    shared = left.sparkSession.sparkContext.broadcast((sigs, sizes, known, np.r_[starts, len(order)], holders))
    id_type = right.schema["id"].dataType

    def search(batches):
        sigs, sizes, known, starts, holders = shared.value
        best = {}
        for batch in batches if len(known) else ():
            ids, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "seq"))
            for ident, text in zip(ids, texts):
                found = window_numbers(text, k)
                at = np.searchsorted(known, found)
                at[at == len(known)] = 0
                at = at[known[at] == found]
                n = starts[at + 1] - starts[at]
                rows = holders[np.arange(n.sum()) + np.repeat(starts[at] - (np.cumsum(n) - n), n)]
                row, common = np.unique(rows, return_counts=True)
                share = common / (sizes[row] + len(found) - common)
                for i in np.flatnonzero(share >= threshold - 1e-12).tolist():
                    mine = (-float(share[i]), ident is None, ident)
                    key = int(row[i])
                    if key not in best or mine < best[key]:
                        best[key] = mine
        schema = pa.schema([("sig", pa.string()), ("b", to_arrow_type(id_type)), ("jaccard", pa.float64())])
        rows = [{"sig": sigs[key], "b": ident, "jaccard": -j} for key, (j, _, ident) in best.items()]
        yield pa.RecordBatch.from_pylist(rows, schema)

    met = right.filter(F.length("seq") >= k).mapInArrow(search, f"sig string, b {id_type.simpleString()}, jaccard double")
    best = met.groupBy("sig").agg(F.min_by(F.struct("b", "jaccard"), F.struct((-F.col("jaccard")).alias("j"), "b")).alias("best"))
    rows = left.select(F.col("id").alias("a"), F.sha2("seq", 256).alias("sig"))
    return rows.join(best, "sig").select("a", "best.b", "best.jaccard")
