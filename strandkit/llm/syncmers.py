"""Document fingerprints from closed syncmers.

A k-byte piece of the text is an anchor if the smallest hash among its inner s-byte
pieces lies at one of its two ends.  Whether a piece is an anchor depends on the piece
alone, so an edit moves no anchor outside its reach, and any 2k - s bytes hold one.
A text without an anchor has one: the whole text.  The fingerprint lists the 32-bit
hashes of the anchors in text order; likeness is their overlap as multisets, shared
anchors over all anchors.

``edited_fingerprints`` also fingerprints an edited text: the end of each document is
replaced by the start of the next one in descending order of id.  Documents are dealt
out by ranges of ids, each range sorted and read as a stream; the first document of a
range is also sent to the range before it.  Nothing is collected, and each text moves
once.

A null text counts as empty: its one anchor is the empty text, so empty texts are alike.
Rows with equal ids follow each other by hash and text; rows without an id come last;
a single row is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkit.llm.common import column_of, prepare, texts

K = 32
S = 8
# Ranges of ids per shuffle partition.
RANGES_PER_PARTITION = 2
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MULTIPLIERS[1]
    return h ^ (h >> np.uint64(27))


def _piece_hashes(raw: bytes, size: int) -> np.ndarray:
    """64-bit hash of every piece of ``size`` bytes, a multiple of 8."""
    n = len(raw) - size + 1
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    h = np.zeros(n, np.uint64)
    for shift in range(0, size, 8):
        h = _spread((h ^ words[shift : shift + n]) * _MULTIPLIERS[0])
    return h


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every window, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions and 32-bit hashes of the anchors of a text, in order."""
    raw = text.encode()
    if len(raw) >= k:
        inner = _piece_hashes(raw, s)
        width = k - s + 1
        low = _window_minimum(inner, width)
        n = len(low)
        at = np.flatnonzero((inner[:n] == low) | (inner[width - 1 :] == low))
        if len(at):
            words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
            h = np.zeros(len(at), np.uint64)
            for shift in range(0, k, 8):
                h = _spread((h ^ words[at + shift]) * _MULTIPLIERS[2])
            return at, (h >> np.uint64(32)).astype(np.uint32)
    whole = int.from_bytes(hashlib.sha256(raw).digest()[:4], "big")
    return np.zeros(1, np.int64), np.array([whole], np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared anchors over all anchors, counted as multisets."""
    values, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    if len(values) == len(a) + len(b):
        return 0.0
    in_a = np.bincount(np.searchsorted(values, a), minlength=len(values))
    return float(np.minimum(in_a, counts - in_a).sum() / np.maximum(in_a, counts - in_a).sum())


def matches(a: str, b: str) -> list[tuple[int, int, int]]:
    """Stretches of equal anchors of two texts: (shift, first byte in a, end byte in a).

    Anchors that occur once in each text are paired; pairs with one shift form a stretch."""
    (pa_, ha), (pb, hb) = anchors(a), anchors(b)
    once_a = {h: p for h, p in zip(ha.tolist(), pa_.tolist()) if (ha == h).sum() == 1}
    once_b = {h: p for h, p in zip(hb.tolist(), pb.tolist()) if (hb == h).sum() == 1}
    stretches: dict[int, list[int]] = {}
    for h in once_a.keys() & once_b.keys():
        stretches.setdefault(once_b[h] - once_a[h], []).append(once_a[h])
    return sorted((shift, min(p), max(p) + K) for shift, p in stretches.items())


def written(hashes: np.ndarray) -> str:
    """A fingerprint as text: eight hex digits for each anchor."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, positions, anchors): anchors of every text with their byte positions."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), pa.array([p for p, _ in found], pa.list_(pa.int64())), pa.array([h.astype(np.int64) for _, h in found], pa.list_(pa.int64()))],
                names=["doc_id", "positions", "anchors"],
            )

    longs = T.ArrayType(T.LongType())
    return slim.mapInArrow(rows, T.StructType([slim.schema["doc_id"], T.StructField("positions", longs), T.StructField("anchors", longs)]))


def with_next(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (part, borrowed, doc_id, text) in which every document is followed by the
    next one in descending order of id."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    slim = docs.select(F.col(ident).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    n_ranges = width * RANGES_PER_PARTITION
    place = F.col("doc_id").cast("double")  # never falls when the id grows
    row = slim.agg(F.percentile_approx(place, [i / n_ranges for i in range(1, n_ranges)], 20 * n_ranges).alias("cuts")).first()
    splits = [float("-inf"), *sorted(set(row["cuts"] or [])), float("inf")]
    top = len(splits) - 2
    dealt = slim.withColumn("__place", place)
    if top:
        dealt = Bucketizer(splits=splits, inputCol="__place", outputCol="__range", handleInvalid="keep").transform(dealt)
    else:
        dealt = dealt.withColumn("__range", F.lit(0))
    placed = dealt.select(
        F.when(F.col("doc_id").isNull(), F.lit(top)).otherwise(F.lit(top) - F.col("__range")).cast("int").alias("part"), "doc_id", "text"
    )
    # one row per range: its first id, and the range that it also ends; the first document follows the last
    over = W.partitionBy(F.lit(0)).orderBy("part")
    firsts = placed.groupBy("part").agg(F.max("doc_id").alias("first")).select(
        "first", F.coalesce(F.lag("part").over(over), F.max("part").over(W.partitionBy(F.lit(0)))).alias("before")
    )
    own = F.struct("part", F.lit(False).alias("borrowed"))
    lent = F.struct(F.col("before").alias("part"), F.lit(True).alias("borrowed"))
    rows = placed.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first")), "left").select(
        "doc_id", "text", F.explode(F.when(F.col("before").isNotNull(), F.array(own, lent)).otherwise(F.array(own))).alias("p")
    )
    return rows.select("p.part", "p.borrowed", "doc_id", "text").repartition(width, "part").sortWithinPartitions(
        "part", "borrowed", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text"
    )


def edited_fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses."""
    prepare(docs.sparkSession)
    ordered = with_next(docs, ident, text)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (part, id, text, anchors) of the row before

        def result(own, following: str, next_anchors: np.ndarray) -> tuple:
            _, doc_id, body, hashes = own
            half = len(body) // 2
            edited = body[: len(body) - half] + following[:half]
            changed = anchors(edited)[1]
            return (doc_id, len(body), hashlib.sha256(edited.encode()).hexdigest(), written(hashes), written(changed),
                    likeness(hashes, changed), likeness(hashes, next_anchors))

        lent_seen = False
        for batch in batches:
            out = []
            for part, borrowed, doc_id, body in zip(*(c.to_pylist() for c in batch.columns)):
                if borrowed and lent_seen:
                    continue  # only the first of rows with one id follows the range
                hashes = anchors(body)[1]
                if last is not None and last[0] == part:
                    out.append(result(last, body, hashes))
                lent_seen = borrowed
                last = None if borrowed else (part, doc_id, body, hashes)
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])],
                names=names,
            )

    strings = [T.StructField(n, T.StringType()) for n in names[2:5]]
    schema = T.StructType([T.StructField("doc_id", ordered.schema["doc_id"].dataType), T.StructField("n_chars", T.LongType()), *strings,
                           *[T.StructField(n, T.DoubleType()) for n in names[5:]]])
    return ordered.mapInArrow(rows, schema)
