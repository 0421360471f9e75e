"""Pooling of residue tables (id, pos, vector) into one vector per id.

Position 0 holds the vector of the leading token; positions start at 1.  Means,
maxima and weighted means are vector aggregates with map-side partial results, so
a very long or very frequent id does not gather in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandkit import constants as C
from strandkit.functions import vectors as fv
from strandkit.operators.ranking import top_per_group


@dataclass(frozen=True)
class AttentionWeights:
    """Additive attention: score(h) = w2 . tanh(w1 h + b1)."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return np.tanh(rows @ self.w1.T + self.b1) @ self.w2

    def bound(self) -> float:
        return float(np.abs(self.w2).sum())


class PoolingUnavailableError(ValueError):
    """A pooling needs weights that were not given."""


def _vector(col: str) -> Column:
    return array_to_vector(F.col(col).cast("array<double>"))


def mean_pool(residues: DataFrame, by: list[str], vec: str = "vector") -> DataFrame:
    pooled = residues.groupBy(*by).agg(Summarizer.mean(_vector(vec)).alias("v"))
    return pooled.select(*by, vector_to_array("v").alias("vector"))


def max_pool(residues: DataFrame, by: list[str], vec: str = "vector") -> DataFrame:
    pooled = residues.groupBy(*by).agg(Summarizer.max(_vector(vec)).alias("v"))
    return pooled.select(*by, vector_to_array("v").alias("vector"))


def region_pool(residues: DataFrame, regions: DataFrame, ident: str = "id") -> DataFrame:
    """Mean of positions start..end (1-based, inclusive) per (id, start, end)."""
    inside = residues.join(regions.select(ident, "start", "end"), ident).filter(
        F.col("pos").between(F.col("start"), F.col("end"))
    )
    return mean_pool(inside, [ident, "start", "end"])


def attention_scores(residues: DataFrame, weights: AttentionWeights, vec: str = "vector") -> DataFrame:
    """Adds ``score`` to every residue row, one matrix product per Arrow batch."""
    shared = residues.sparkSession.sparkContext.broadcast(weights)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in residues.schema.fields)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(vec).flatten().to_numpy(zero_copy_only=False)
            score = shared.value.scores(np.asarray(flat, dtype=np.float64).reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return residues.mapInArrow(run, fields + ", score double")


def _exponentials(residues: DataFrame, by: list[str], weights: AttentionWeights, vec: str, mask: str | None) -> DataFrame:
    scored = attention_scores(residues, weights, vec)
    if mask is not None:
        scored = scored.filter(F.col(mask))
    if weights.bound() <= 300:
        # tanh bounds every score, so one constant keeps exp in range
        return scored.withColumn("e", F.exp(F.col("score") - weights.bound()))
    top = scored.groupBy(*by).agg(F.max("score").alias("__top"))
    return scored.join(top, by).withColumn("e", F.exp(F.col("score") - F.col("__top"))).drop("__top")


def attention_pool(
    residues: DataFrame, by: list[str], weights: AttentionWeights | None, vec: str = "vector", mask: str | None = None
) -> DataFrame:
    """Softmax-weighted mean; masked positions (mask false) weigh nothing."""
    if weights is None:
        raise PoolingUnavailableError("attention pooling needs weights")
    rows = _exponentials(residues, by, weights, vec, mask)
    pooled = rows.groupBy(*by).agg(Summarizer.mean(_vector(vec), F.col("e")).alias("v"))
    return pooled.select(*by, vector_to_array("v").alias("vector"))


def attention_profile(
    residues: DataFrame, by: list[str], weights: AttentionWeights | None, vec: str = "vector"
) -> DataFrame:
    """(by, pos, weight): softmax weights over the positions of each id."""
    if weights is None:
        raise PoolingUnavailableError("attention pooling needs weights")
    rows = _exponentials(residues, by, weights, vec, None).select(*by, "pos", "e")
    total = rows.groupBy(*by).agg(F.sum("e").alias("__z"))
    return rows.join(total, by).select(*by, "pos", (F.col("e") / F.col("__z")).alias("weight"))


def top_positions(profile: DataFrame, by: list[str], n: int = 10) -> DataFrame:
    return top_per_group(profile, by, [F.desc("weight"), F.col("pos")], n)


def pool_all(
    residues: DataFrame, poolings: tuple[str, ...] = C.POOLINGS, weights: AttentionWeights | None = None, ident: str = "id"
) -> DataFrame:
    """(id, pooling, vector) for the named poolings."""
    body = residues.filter("pos > 0")
    makers = {
        "mean": lambda: mean_pool(body, [ident]),
        "max": lambda: max_pool(body, [ident]),
        "bos": lambda: residues.filter("pos = 0").select(ident, fv.doubles(F.col("vector")).alias("vector")),
        "attention": lambda: attention_pool(body, [ident], weights),
    }
    out = None
    for name in poolings:
        if name not in makers:
            raise ValueError(f"unknown pooling {name!r}; use one of {C.POOLINGS}")
        part = makers[name]().select(ident, F.lit(name).alias("pooling"), "vector")
        out = part if out is None else out.unionByName(part)
    return out


def residue_norms(residues: DataFrame, ident: str = "id") -> DataFrame:
    return residues.select(ident, "pos", F.round(fv.norm(F.col("vector")), 4).alias("norm"))
