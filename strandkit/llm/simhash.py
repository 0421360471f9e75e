"""SimHash fingerprints and near duplicates by covering hashes.

The fingerprint has one bit for each of 64 places: set if set in over half of the
64-bit hashes of the text's four-word shingles.  Two fingerprints are linked if
they differ in at most ``RADIUS`` places.

Links come from ``2^(r+1) - 1`` bit masks.  Every place gets a random vector of
r+1 bits, and mask v keeps the places whose vector has an odd inner product with v.
At most r places span less than the whole space, so some v is orthogonal to all of
them and its mask hides every difference: each pair inside the radius
shares the masked value in some table, with certainty.

Copies collapse to one fingerprint before any search.  A bucket is never expanded
into its pairs: a sweep takes a fingerprint, links all unreached ones within the
radius, and goes on from these, so a dense bucket costs little more than its size
and yields fewer links than members.  A bucket of more than ``BUCKET_ROWS``
fingerprints is cut into blocks, and every pair of blocks is swept as one group.

Null and empty texts have fingerprint zero and are linked like any other; equal
rows share a component; rows without an id belong to a component but never name
it (its name is null if no member has an id); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkit.llm.common import hex64, prepare, texts
from strandkit.operators.groups import connected_components
from strandkit.session import reliable_checkpoint

SHINGLE_WORDS = 4
HASH_SEED = 42
RADIUS = 4
MASK_SEED = 20240
BUCKET_ROWS = 1 << 14
_SLICE = 1 << 16


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint as an unsigned number."""
    parts = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), HASH_SEED)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(parts) - words + 1
    votes = np.zeros(64, np.int64)
    for low in range(0, n, _SLICE):
        high = min(n, low + _SLICE)
        spans = zip(starts[low:high].tolist(), ends[low + words - 1 : high + words - 1].tolist())
        hashes = np.fromiter((digest(line[a:b], HASH_SEED) for a, b in spans), "<u8", high - low)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """All columns and the fingerprint as a signed long."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in texts(batch, text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], names=[*batch.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def covering_masks(radius: int = RADIUS, seed: int = MASK_SEED) -> list[int]:
    """One 64-bit mask for each non-zero vector of radius + 1 bits."""
    rng = np.random.default_rng(seed)
    vectors = rng.integers(1, 1 << (radius + 1), 64)
    return [sum(1 << place for place in range(64) if bin(int(vectors[place]) & v).count("1") % 2) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sweep(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join whatever is connected within the radius, fewer than members."""
    if len(prints) == 2:
        near = np.bitwise_count(prints[:1] ^ prints[1:]) <= radius
        return prints[:1][near], prints[1:][near]
    left, right = [], []
    rest, queue = prints[1:], [prints[0]]
    while len(rest):
        pivot = queue.pop() if queue else None
        if pivot is None:
            queue, rest = [rest[0]], rest[1:]
            continue
        near = np.bitwise_count(rest ^ pivot) <= radius
        if near.any():
            found, rest = rest[near], rest[~near]
            left.append(np.full(len(found), pivot, np.uint64))
            right.append(found)
            queue.extend(found)
    none = np.empty(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _runs(batches: Iterator[pa.RecordBatch], radius: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Sweeps runs of equal (mask, masked) in sorted rows; larger runs come out as blocks."""
    names = ["mask", "masked", "block", "a", "b"]

    def out(mask, masked, block, a, b):
        return pa.RecordBatch.from_arrays(
            [pa.array(mask, pa.int32()), pa.array(masked, pa.int64()), pa.array(block, pa.int32()),
             pa.array(np.asarray(a, np.uint64).view(np.int64)), pa.array(b, pa.int64())], names=names)

    def links(a, b):
        return out([None] * len(a), [None] * len(a), [None] * len(a), a, np.asarray(b, np.uint64).view(np.int64))

    def hot(key, block, rows):
        n = len(rows)
        return out([key[0]] * n, [key[1]] * n, [block] * n, rows, [None] * n)

    key, kept, blocks = None, np.empty(0, np.uint64), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        mask, masked, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        prints = prints.view(np.uint64)
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (masked[1:] != masked[:-1])) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [batch.num_rows]])
        first = (int(mask[0]), int(masked[0]))
        if first == key:
            kept = np.concatenate([kept, prints[: ends[0]]])
            starts, ends = starts[1:], ends[1:]
            while len(kept) > limit:
                yield hot(key, blocks, kept[:limit])
                kept, blocks = kept[limit:], blocks + 1
        if not len(starts):
            continue
        if blocks:
            yield hot(key, blocks, kept)
        elif len(kept) > 1:
            yield links(*sweep(kept, radius))
        # the last run may go on in the next batch
        inner_s, inner_e = starts[:-1], ends[:-1]
        twos = inner_s[inner_e - inner_s == 2]
        if len(twos):
            a, b = prints[twos], prints[twos + 1]
            near = np.bitwise_count(a ^ b) <= radius
            if near.any():
                yield links(a[near], b[near])
        for s, e in zip(inner_s[inner_e - inner_s > 2], inner_e[inner_e - inner_s > 2]):
            if e - s > limit:
                for block, low in enumerate(range(s, e, limit)):
                    yield hot((int(mask[s]), int(masked[s])), block, prints[low : min(e, low + limit)])
            else:
                yield links(*sweep(prints[s:e], radius))
        last = starts[-1]
        key, kept, blocks = (int(mask[last]), int(masked[last])), prints[last:].copy(), 0
        while len(kept) > limit:
            yield hot(key, blocks, kept[:limit])
            kept, blocks = kept[limit:], blocks + 1
    if blocks:
        yield hot(key, blocks, kept)
    elif len(kept) > 1:
        yield links(*sweep(kept, radius))


def near_links(prints: DataFrame, radius: int = RADIUS, limit: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect exactly
    what is connected within the radius; not every pair is listed."""
    tables = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("masked")) for i, m in enumerate(covering_masks(radius))]
    placed = (
        prints.select("fp", F.explode(F.array(*tables)).alias("t")).select("t.mask", "t.masked", "fp")
        .repartition("mask", "masked").sortWithinPartitions("mask", "masked")
    )
    found = reliable_checkpoint(placed.mapInArrow(lambda it: _runs(it, radius, limit), "mask int, masked long, block int, a long, b long"))
    direct = found.filter("b is not null").select("a", "b")
    hot = found.filter("b is null").select("mask", "masked", "block", F.col("a").alias("fp"))
    counts = hot.groupBy("mask", "masked").agg((F.max("block") + 1).alias("blocks"))
    pairs = hot.join(counts, ["mask", "masked"]).select(
        "mask", "masked", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("mask", "masked", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")

    def block_pair(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = sweep(np.unique(pdf["fp"].to_numpy().astype(np.int64).view(np.uint64)), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    split = pairs.groupBy("mask", "masked", "i", "j").applyInPandas(block_pair, "a long, b long")
    return direct.unionByName(split).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(rows: DataFrame, ident: str, radius: int = RADIUS, limit: int = BUCKET_ROWS) -> DataFrame:
    """(fp, part, name): the component of each distinct fingerprint, and the smallest
    id of its rows.  ``rows`` holds the id and fp and should be a written table."""
    distinct = rows.groupBy("fp").agg(F.min(ident).alias("low"))
    parts = connected_components(near_links(distinct.select("fp"), radius, limit))
    placed = distinct.join(parts, distinct["fp"] == parts["node"], "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("part")
    )
    names = placed.groupBy("part").agg(F.min("low").alias("name"))
    return placed.join(names, "part").select("fp", "part", "name")


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", radius: int = RADIUS, limit: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    rows = reliable_checkpoint(with_fingerprint(slim).select("doc_id", "fp"))
    found = components(rows, "doc_id", radius, limit).select("fp", "name")
    return rows.join(found, "fp").select("doc_id", hex64("fp").alias("fingerprint"), F.col("name").alias("component_id"))


def keep_first(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id, with all its columns.

    Rows are numbered when the fingerprints are written, so that one row stays also
    among rows with equal or missing ids."""
    prepare(docs.sparkSession)
    numbered = docs.select(F.struct("*").alias("__row"), F.col(ident).alias("__id"), F.col(text).alias("__text"))
    rows = reliable_checkpoint(
        with_fingerprint(numbered, "__text").select("__row", "__id", "fp", F.monotonically_increasing_id().alias("__no"))
    )
    parts = components(rows.select("__id", "fp"), "__id").select("fp", "part")
    narrow = rows.select("__id", "fp", "__no").join(parts, "fp")
    first = narrow.groupBy("part").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__no")).alias("m")).select(F.col("m.__no").alias("__no"))
    return rows.join(first, "__no", "left_semi").select("__row.*")
