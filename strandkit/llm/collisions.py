"""Nearest vectors by collision counting over sorted projections.

The index cuts the vectors into blocks of about ``BLOCK_ROWS`` different vectors.  Each
block holds ``PROJECTIONS`` arrays: the values of one random projection of all its unit
vectors, in order, with the places they belong to.  A query looks at the windows of
half-width ``REACH * R`` around its own values: a vector at distance R or less falls into
a window with a chance of at least ``_window_chance()``, so it is in ``threshold()`` or more
of them but for one time in ``1 / MISS``.  Vectors with that many collisions are verified
with their cosines.  R grows by ``GROWTH`` (virtual rehashing: the windows of a larger R
contain those of a smaller one, and only what is added is counted) until the k-th verified
vector lies within R; the last radius takes all vectors.  Nothing caps the number of candidates.

Blocks of queries meet all blocks of the index.  A query first meets the vectors beside it in
each projection; one that has seen k vectors opens its windows at the distance of the k-th at once.

Equal vectors are one vector with the k + 1 smallest of their ids, as no search can return
more of them.  Vectors that are null, empty, zero, or hold null or non-finite components,
and rows without an id take no part; only vectors of the same length are compared.  An id
that has several vectors counts with the best of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandkit.llm.common import column_of, prepare
from strandkit.session import reliable_checkpoint, shuffle_width

PROJECTIONS = 64
# Half-width of a window in units of the radius, and how often a vector within it may be missed.
REACH, MISS = 1.0, 0.01
FIRST_RADIUS, GROWTH = 0.05, 1.25
BLOCK_ROWS, QUERY_ROWS = 4096, 2048
# Windows that hold more than this share of a block are counted by all ranks at once, and candidates of more than
# this share are scored by one product first; SLACK is beyond the error of that product.
DENSE, SLACK = 1 / 32, 1e-9
# Vectors on each side of a query, in every projection, that give it a first bound.
BESIDE = 2
SEED = 11

INDEX_SCHEMA = "dim int, block int, vecs binary, ids array<bigint>, ends array<int>, sorted binary, places binary"
PACK_SCHEMA = "dim int, part int, q_ids array<bigint>, q_vecs binary"


def _window_chance() -> float:
    """Chance that the projection of a vector at distance R is within REACH * R of the query's."""
    return math.erf(REACH / math.sqrt(2))


def threshold(m: int = PROJECTIONS, miss: float = MISS) -> int:
    """The largest number of collisions that a vector within R reaches but for ``miss`` of the cases."""
    p, below = _window_chance(), 0.0
    for hits in range(m + 1):
        below += math.comb(m, hits) * p ** hits * (1 - p) ** (m - hits)
        if below > miss:
            return hits
    return m


def radii() -> list[float]:
    """Up to the diameter of the sphere, then everything."""
    steps = math.ceil(math.log(2 / FIRST_RADIUS, GROWTH))
    return [FIRST_RADIUS * GROWTH ** j for j in range(steps)] + [math.inf]


def planes(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(dim, PROJECTIONS))


def _norms(vecs: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vecs, vecs))


def _scaled(vecs: np.ndarray) -> np.ndarray:
    """Vectors whose squares would leave the range of doubles are scaled; cosines stay."""
    top = np.abs(vecs).max(axis=1, initial=0.0)
    odd = (top > 1e150) | (top < 1e-150)
    return np.where(odd[:, None], vecs / np.where(odd, top, 1.0)[:, None], vecs)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, dim) of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    number = lambda x: F.abs(F.coalesce(x, F.lit(math.inf))) < F.lit(math.inf)  # null and NaN fail
    return rows.filter(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", number) & F.exists("vec", lambda x: x != 0)
    ).withColumn("dim", F.size("vec"))


# -- index ------------------------------------------------------------------------

def _build_block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    dim, block = key[0].as_py(), key[1].as_py()
    vecs = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    vecs = _scaled(vecs)
    values = ((vecs / _norms(vecs)[:, None]) @ planes(dim)).T
    places = np.argsort(values, axis=1, kind="stable")
    lists = table["ids"].combine_chunks()
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int32()), "vecs": [vecs.tobytes()],
        "ids": pa.array([lists.flatten().to_numpy(zero_copy_only=False)], pa.list_(pa.int64())),
        "ends": pa.array([np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))], pa.list_(pa.int32())),
        "sorted": [np.take_along_axis(values, places, axis=1).tobytes()], "places": [places.astype(np.int32).tobytes()],
    })


def build(vectors: DataFrame, k: int, id_col: str = "id", vec_col: str = "vector", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index as a table in the checkpoint folder; it answers searches for up to ``k`` neighbours."""
    prepare(vectors.sparkSession)
    rows = usable(vectors, id_col, vec_col).withColumn("h", F.xxhash64("vec"))
    # Spark cuts each vector to its k + 1 smallest ids before it shuffles.
    same = W.partitionBy("h", "vec").orderBy("id")
    few = rows.withColumn("place", F.dense_rank().over(same)).filter(F.col("place") <= k + 1)
    distinct = few.groupBy("h", "vec").agg(F.first("dim").alias("dim"), F.array_sort(F.collect_set("id")).alias("ids"))
    sizes = rows.groupBy("dim").agg(F.ceil(F.approx_count_distinct("h") / block_rows).cast("int").alias("n_blocks"))
    dealt = distinct.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("h", F.lit(SEED)), F.col("n_blocks")).cast("int"))
    return reliable_checkpoint(dealt.select("dim", "block", "vec", "ids").groupBy("dim", "block").applyInArrow(_build_block, INDEX_SCHEMA))


# -- search -----------------------------------------------------------------------

class _Block:
    """One block of the index, ready for queries."""

    def __init__(self, batch: pa.RecordBatch, row: int, dim: int):
        read = lambda name, kind: np.frombuffer(column_of(batch, name)[row].as_buffer(), dtype=kind)
        self.vecs = read("vecs", np.float64).reshape(-1, dim)
        self.norms = _norms(self.vecs)
        self.values = read("sorted", np.float64).reshape(PROJECTIONS, -1)
        self.places = read("places", np.int32).reshape(PROJECTIONS, -1)
        self.ids = column_of(batch, "ids")[row].values.to_numpy(zero_copy_only=False)
        ends = column_of(batch, "ends")[row].values.to_numpy(zero_copy_only=False)
        self.starts, self.lengths = np.r_[0, ends[:-1]], np.diff(np.r_[0, ends])
        # the rank of each place in each projection
        n = len(self.norms)
        self.ranks = np.empty(self.places.shape, dtype=np.uint16 if n < 1 << 16 else np.uint32)
        np.put_along_axis(self.ranks, self.places, np.arange(n, dtype=self.ranks.dtype)[None, :], axis=1)
        self.units = self.vecs / self.norms[:, None]

    def windows(self, values: np.ndarray, radius) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of each query's windows, [queries, projections]."""
        half = REACH * np.broadcast_to(radius, len(values))
        low, high = (np.empty(values.shape, dtype=np.int64) for _ in range(2))
        for i, column in enumerate(self.values):
            low[:, i] = np.searchsorted(column, values[:, i] - half, "left")
            high[:, i] = np.searchsorted(column, values[:, i] + half, "right")
        return low, high

    def count(self, counts: np.ndarray, spans: list[tuple[int, int, int]]) -> None:
        """Adds the collisions of (projection, from, to)."""
        inside = [self.places[i, a:b] for i, a, b in spans if b > a]
        if inside:
            counts += np.bincount(np.concatenate(inside), minlength=len(counts))

    def beside(self, at: np.ndarray) -> np.ndarray:
        """The places around a rank of each projection."""
        ranks = np.clip(at[:, None] + np.arange(-BESIDE, BESIDE), 0, len(self.norms) - 1)
        return np.unique(np.take_along_axis(self.places, ranks, axis=1))

    def within(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The collisions of each place in whole windows, [projections] each."""
        if (high - low).sum() < DENSE * self.places.size:
            counts = np.zeros(len(self.norms), dtype=np.int64)
            self.count(counts, [(i, a, b) for i, (a, b) in enumerate(zip(low, high))])
            return counts
        # a rank below the window wraps to a large number
        kind = self.ranks.dtype
        inside = (self.ranks - low.astype(kind)[:, None]) < (high - low).astype(kind)[:, None]
        return np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)  # PROJECTIONS at most

    def verify(self, held, query_id: int, query: np.ndarray, norm: float, places: np.ndarray, k: int):
        """The k best of what is held, and of these places: (scores, ids)."""
        if len(places) > max(4 * k, DENSE * len(self.norms)):
            # those that are surely not among the k + 1 best of the block, or below the k-th held, are not scored
            rough = (self.units @ (query / norm))[places]
            least = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
            if len(held[0]) >= k:
                least = max(least, held[0][k - 1])
            places = places[rough >= least - SLACK]
            if not len(places):
                return held
        scores = np.einsum("ij,j->i", self.vecs[places], query) / (self.norms[places] * norm)
        if len(scores) > k + 1:  # one of them may be the query itself
            least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            places, scores = places[scores >= least], scores[scores >= least]
        lengths = self.lengths[places]
        at = np.repeat(self.starts[places] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        ids, scores = np.r_[held[1], self.ids[at]], np.r_[held[0], np.repeat(scores, lengths)]
        order = np.lexsort((ids, -scores))
        order = order[ids[order] != query_id]
        _, first = np.unique(ids[order], return_index=True)  # an id counts once
        order = order[np.sort(first)][:k]
        return scores[order], ids[order]


def _distance(scores: np.ndarray, k: int) -> float:
    """Of the k-th vector held."""
    return math.sqrt(max(0.0, 2 - 2 * scores[k - 1])) if len(scores) >= k else math.inf


class _Queries:
    """A pack of queries and the best vectors each has met so far."""

    def __init__(self, batch: pa.RecordBatch, row: int, dim: int, k: int):
        self.ids = column_of(batch, "q_ids")[row].values.to_numpy(zero_copy_only=False)
        self.vecs = np.frombuffer(column_of(batch, "q_vecs")[row].as_buffer(), dtype=np.float64).reshape(-1, dim)
        self.norms = _norms(self.vecs)
        self.values = (self.vecs / self.norms[:, None]) @ planes(dim)
        self.held = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(self.ids)
        self.k, self.least = k, threshold()

    def visit(self, block: _Block) -> None:
        # vectors beside a query in the sorted projections give it a first bound
        first = np.array([q for q, h in enumerate(self.held) if len(h[0]) < self.k], dtype=np.int64)
        beside, _ = block.windows(self.values[first], 0.0)
        for row, q in enumerate(first):
            self._verify(block, q, block.beside(beside[row]))
        reach = np.array([_distance(h[0], self.k) for h in self.held])
        # a bound is known: one window at the distance of the k-th vector held
        known = np.flatnonzero(np.isfinite(reach))
        low, high = block.windows(self.values[known], reach[known])
        for row, q in enumerate(known):
            self._verify(block, q, np.flatnonzero(block.within(low[row], high[row]) >= self.least))
        # no bound yet: widen the windows until k vectors lie within the radius
        open_ = np.flatnonzero(~np.isfinite(reach))
        n = len(block.norms)
        state = {q: (np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), None) for q in open_}
        for radius in radii():
            if not len(open_):
                break
            low, high = block.windows(self.values[open_], radius)
            for row, q in enumerate(open_):
                counts, seen, old = state[q]
                if old is None or (high[row] - low[row]).sum() >= DENSE * block.places.size:
                    counts = block.within(low[row], high[row]).astype(np.int64)
                else:
                    block.count(counts, [x for i in range(PROJECTIONS) for x in ((i, low[row, i], old[0][i]), (i, old[1][i], high[row, i]))])
                found = np.flatnonzero(((counts >= self.least) | math.isinf(radius)) & ~seen)
                seen[found] = True
                state[q] = (counts, seen, (low[row], high[row]))
                self._verify(block, q, found)
            open_ = np.array([q for q in open_ if _distance(self.held[q][0], self.k) > radius], dtype=np.int64)

    def _verify(self, block: _Block, q: int, places: np.ndarray) -> None:
        if len(places):
            self.held[q] = block.verify(self.held[q], self.ids[q], self.vecs[q], self.norms[q], places, self.k)

    def hits(self) -> pa.RecordBatch:
        lengths = [len(h[0]) for h in self.held]
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(self.ids, lengths)), pa.array(np.concatenate([h[1] for h in self.held])),
            pa.array(np.concatenate([h[0] for h in self.held])),
        ], ["query_id", "id", "score"])


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    dim = key[0].as_py()
    vecs = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()),
        "q_ids": pa.array([table["id"].to_numpy()], pa.list_(pa.int64())), "q_vecs": [_scaled(vecs).tobytes()],
    })


def search(index: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """The ``k`` nearest vectors of each query: (query_id, rank, id, score), ties to the smaller id."""
    spark = prepare(index.sparkSession)
    rows = usable(queries, id_col, vec_col)
    parts = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("n_parts"))
    packs = rows.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.col("n_parts")).cast("int")).select(
        "dim", "part", "id", "vec"
    ).groupBy("dim", "part").applyInArrow(_pack, PACK_SCHEMA)
    # A task has one pack of queries and every width-th block of the index.
    width = shuffle_width(spark)
    left = index.join(parts, "dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))).withColumn(
        "lane", F.pmod("block", F.lit(width))
    ).drop("n_parts")
    right = packs.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    joined = left.join(right, ["dim", "part", "lane"])

    def run(batches):
        now, pack = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                key = tuple(column_of(batch, name)[row].as_py() for name in ("dim", "part", "lane"))
                if key != now:
                    if pack is not None:
                        yield pack.hits()
                    now, pack = key, _Queries(batch, row, key[0], k)
                pack.visit(_Block(batch, row, key[0]))
        if pack is not None:
            yield pack.hits()

    hits = joined.mapInArrow(run, "query_id bigint, id bigint, score double")
    best = hits.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows whose id ``every`` divides, searched among all other rows:
    (query_id, rank, vec_id, score)."""
    index = build(vectors, k, id_col, vec_col)
    queries = vectors.filter(F.pmod(F.col(id_col).cast("long"), F.lit(every)) == 0)
    hits = search(index, queries, k, id_col, vec_col)
    return hits.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
