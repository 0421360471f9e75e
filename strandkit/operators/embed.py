"""The embedding job: validate, encode, pool all strategies in one pass."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkit import constants as C
from strandkit.functions import columns as fc
from strandkit.operators.pooling import AttentionWeights, PoolingUnavailableError
from strandkit.sources.keyed import KeyedStore


class Encoder(Protocol):
    """Anything that turns a batch of sequences into residue matrices.

    ``encode`` returns one (leading vector [D], residues [L, D]) pair per sequence.
    Instances travel to the executors, so heavy models load on first use.
    """

    name: str

    def encode(self, sequences: list[str]) -> list[tuple[np.ndarray, np.ndarray]]: ...


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _means(parts: list[np.ndarray]) -> np.ndarray:
    """The mean row of each matrix of a batch."""
    sizes = np.array([len(p) for p in parts])
    if len(parts) < 2 or not sizes.all():
        return np.array([p.mean(axis=0) for p in parts])
    return np.add.reduceat(np.concatenate(parts), np.r_[0, np.cumsum(sizes)[:-1]], axis=0) / sizes[:, None]


class OneHotEncoder:
    """One dimension per alphabet symbol; its mean pooling is the composition."""

    def __init__(self, alphabet: str = C.AMINO_ACIDS) -> None:
        self.name = "one_hot"
        self.alphabet = alphabet

    def encode(self, sequences):
        rows = (_points("".join(sequences))[:, None] == _points(self.alphabet)[None, :]).astype(np.float64)
        ends = np.cumsum([len(s) for s in sequences])
        parts = np.split(rows, ends[:-1]) if len(sequences) else []
        return list(zip(_means(parts), parts))


class HashingEncoder:
    """A fixed random vector per (offset, symbol), summed over a context window."""

    def __init__(self, dim: int = 32, window: int = 2, seed: int = 42) -> None:
        self.name = f"hashing{dim}w{window}s{seed}"
        self.dim, self.window, self.seed = dim, window, seed
        self._table = None

    def encode(self, sequences):
        if self._table is None:
            rng = np.random.default_rng(self.seed)
            self._table = rng.normal(size=(2 * self.window + 1, 256, self.dim)) / np.sqrt(self.dim)
        out = []
        for seq in sequences:
            codes = (_points(seq) % 256).astype(np.int64)
            padded = np.pad(codes, self.window)
            rows = self._table[0][padded[:len(codes)]]
            for o in range(1, 2 * self.window + 1):
                rows += self._table[o][padded[o:o + len(codes)]]
            np.tanh(rows, out=rows)
            out.append((np.tanh(rows.sum(axis=0) / np.sqrt(len(codes))), rows))
        return out


def _pool(lead: np.ndarray, rows: np.ndarray, name: str, weights: AttentionWeights | None) -> np.ndarray:
    if name == "mean":
        return rows.mean(axis=0)
    if name == "max":
        return rows.max(axis=0)
    if name == "bos":
        return lead
    scores = weights.scores(rows)
    e = np.exp(scores - scores.max())
    return (e / e.sum()) @ rows


def _pools(encoded: list[tuple[np.ndarray, np.ndarray]], name: str, weights: AttentionWeights | None) -> list[np.ndarray]:
    """The pooled vectors of a batch."""
    if name == "mean":
        return list(_means([rows for _, rows in encoded]))
    return [_pool(*e, name, weights) for e in encoded]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0)))


def valid_sequences(
    df: DataFrame, ident: str, seq: str, lengths: tuple[int, int] = C.ADHOC_LENGTHS, alphabet: str = C.AMINO_ACIDS
) -> DataFrame:
    """(id, sequence, reason): cleaned sequences and why they are refused."""
    cleaned = df.select(F.col(ident).alias("id"), fc.clean_sequence(F.col(seq)).alias("sequence"))
    return cleaned.withColumn("reason", fc.validation_reason(F.col("sequence"), *lengths, alphabet))


def _token_batches(batches, budget: int):
    """Slices of each Arrow batch whose padded size stays under the token budget.

    The padded size of a slice is its longest row times its rows, which grows with
    the slice, so its end is found by a search."""
    for batch in batches:
        lengths = pc.utf8_length(batch.column("sequence")).to_numpy(zero_copy_only=False).astype(np.int64)
        low = 0
        while low < len(lengths):
            padded = np.maximum.accumulate(lengths[low:]) * np.arange(1, len(lengths) - low + 1)
            rows = max(1, int(np.searchsorted(padded, budget, side="right")))
            part = batch.slice(low, rows)
            yield part.column("id").to_pylist(), part.column("sequence").to_pylist()
            low += rows


def _prepared(df: DataFrame, ident: str, seq: str, lengths, alphabet) -> DataFrame:
    valid = valid_sequences(df, ident, seq, lengths, alphabet).filter("reason is null").select("id", "sequence")
    # Hash partitions carry equal work; sorting by length keeps batches even.
    return valid.repartition(F.xxhash64("id")).sortWithinPartitions(F.length("sequence"))


def embed(
    df: DataFrame, encoder: Encoder, ident: str = "id", seq: str = "sequence",
    poolings: tuple[str, ...] = ("mean",), weights: AttentionWeights | None = None,
    token_budget: int = 16384, lengths: tuple[int, int] = C.ADHOC_LENGTHS, alphabet: str = C.AMINO_ACIDS,
) -> DataFrame:
    """(id, pooling, vector) for every valid sequence, each encoded once."""
    unknown = set(poolings) - set(C.POOLINGS)
    if unknown:
        raise ValueError(f"unknown pooling {sorted(unknown)}; use {C.POOLINGS}")
    if "attention" in poolings and weights is None:
        raise PoolingUnavailableError("attention pooling needs weights")
    rows = _prepared(df, ident, seq, lengths, alphabet)
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for ids, seqs in _token_batches(batches, token_budget):
            encoded = encoder.encode(seqs)
            for p in poolings:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.string() if id_type == "string" else pa.int64()),
                        pa.array([p] * len(ids), pa.string()), _lists(_pools(encoded, p, weights)),
                    ],
                    ["id", "pooling", "vector"],
                )

    kind = "string" if id_type == "string" else "bigint"
    return rows.mapInArrow(run, f"id {kind}, pooling string, vector array<double>")


def encode_residues(
    df: DataFrame, encoder: Encoder, ident: str = "id", seq: str = "sequence", token_budget: int = 16384,
    lengths: tuple[int, int] = C.ADHOC_LENGTHS, alphabet: str = C.AMINO_ACIDS,
) -> DataFrame:
    """(id, pos, vector) rows; position 0 holds the leading vector."""
    rows = _prepared(df, ident, seq, lengths, alphabet)
    id_type = rows.schema["id"].dataType.simpleString()
    arrow = pa.string() if id_type == "string" else pa.int64()

    def run(batches):
        for ids, seqs in _token_batches(batches, token_budget):
            for ident_value, (lead, residues) in zip(ids, encoder.encode(seqs)):
                stacked = np.vstack([lead[None, :], residues])
                ends = np.arange(len(stacked) + 1, dtype=np.int32) * stacked.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ident_value] * len(stacked), arrow),
                        pa.array(np.arange(len(stacked), dtype=np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(stacked.ravel())),
                    ],
                    ["id", "pos", "vector"],
                )

    kind = "string" if id_type == "string" else "bigint"
    return rows.mapInArrow(run, f"id {kind}, pos int, vector array<double>")


def encode_changes(
    df: DataFrame, encoder: Encoder, wild: str, mutant: str, pooling: str = "mean",
    weights: AttentionWeights | None = None, token_budget: int = 16384,
) -> DataFrame:
    """Adds ``z`` and ``m`` (pooled wild type and mutant) and ``deltas``, the change
    of every position, for rows that carry both aligned sequences.

    Residue matrices stay inside the task.  Rows of one wild type sit next to each
    other, and a wild type is encoded once per batch; a wild type with very many
    variants is spread over tasks by the mutant.
    """
    rows = df.repartition(F.xxhash64(wild, F.pmod(F.xxhash64(mutant), F.lit(64)))).sortWithinPartitions(wild)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        for batch in batches:
            left, right = batch.column(wild).to_pylist(), batch.column(mutant).to_pylist()
            start = 0
            while start < len(left):
                stop, longest = start, 0
                while stop < len(left) and (stop == start or max(longest, len(left[stop])) * 2 * (stop + 1 - start) <= token_budget):
                    longest = max(longest, len(left[stop]))
                    stop += 1
                names = list(dict.fromkeys(left[start:stop]))
                encoded = encoder.encode(names + right[start:stop])
                pooled = _pools(encoded, pooling, weights)
                at = {w: i for i, w in enumerate(names)}
                place = [at[w] for w in left[start:stop]]
                sizes = [len(rows) for _, rows in encoded[len(names):]]
                moved = np.concatenate([rows for _, rows in encoded[len(names):]]) - np.concatenate([encoded[i][1] for i in place])
                ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns, _lists([pooled[i] for i in place]), _lists(pooled[len(names):]),
                        pa.ListArray.from_arrays(ends, pa.array(np.linalg.norm(moved, axis=1))),
                    ],
                    [*batch.schema.names, "z", "m", "deltas"],
                )
                start = stop

    return rows.mapInArrow(run, fields + ", z array<double>, m array<double>, deltas array<double>")


# -- cache --------------------------------------------------------------------

def with_keys(df: DataFrame, seq: str, model: str, pooling: str, fingerprint: str | None = None) -> DataFrame:
    """Adds the cache key; only attention depends on the pooler fingerprint."""
    mark = fingerprint if pooling == "attention" else None
    return df.withColumn("key", fc.embedding_key(F.col(seq), model, pooling, mark))


def latest_vectors(cache: DataFrame) -> DataFrame:
    """The last written vector of each key from (key, vector, written)."""
    return cache.groupBy("key").agg(F.max_by("vector", "written").alias("vector"))


def embed_with_cache(
    df: DataFrame, cache: DataFrame | KeyedStore, encoder: Encoder, ident: str = "id", seq: str = "sequence",
    pooling: str = "mean", weights: AttentionWeights | None = None, fingerprint: str | None = None,
    lengths: tuple[int, int] = C.ADHOC_LENGTHS, alphabet: str = C.AMINO_ACIDS,
) -> tuple[DataFrame, DataFrame]:
    """(result, fresh): vectors with ``cache_hit`` and the rows to append.

    Equal sequences share a key, so a missing one is encoded once.  Of a keyed store only the
    buckets that the keys may be in are read.
    """
    valid = valid_sequences(df, ident, seq, lengths, alphabet).filter("reason is null").drop("reason")
    keyed = with_keys(valid, "sequence", encoder.name, pooling, fingerprint)
    if isinstance(cache, KeyedStore):
        stored = cache.matching(keyed)
        cache = df.sparkSession.createDataFrame([], "key string, vector array<double>, written long") if stored is None else stored
    known = latest_vectors(cache)
    misses = keyed.join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.first("sequence").alias("sequence"))
    fresh = embed(misses, encoder, "key", "sequence", (pooling,), weights, lengths=lengths, alphabet=alphabet).select(
        F.col("id").alias("key"), "vector"
    )
    found = known.withColumn("cache_hit", F.lit(True)).unionByName(fresh.withColumn("cache_hit", F.lit(False)))
    return keyed.join(found, "key").select("id", "key", "vector", "cache_hit"), fresh
