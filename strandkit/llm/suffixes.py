"""Removal of repeated byte strings by fingerprints, with a difference cover before them.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts elsewhere in
the corpus.  This is a search for equal strings of fixed length by their hashes.  It stands
in for a difference-cover, blockwise suffix sort: no suffix is put in order, no sample
gets a rank, and no bytes are compared.

1. Positions in a difference cover modulo ``PERIOD`` are the sample.  Two positions of a
   repeat, however they are aligned, meet a pair of sample positions within PERIOD - 1
   bytes, whose next LENGTH - PERIOD + 1 bytes are equal as well.  Samples whose hashes of
   these bytes are equal are tied.  No repeat lies outside the reach of a tied sample.
2. The strings of LENGTH bytes that start within reach before a tied sample are hashed;
   those whose hash is not alone are the repeats, and their bytes go.

Each search runs bucket by bucket.  Strings go to buckets by hash, as one packed array for
each pair of chunk and bucket, in which equal hashes appear once: one passage that
fills a third of the corpus adds one key per chunk to its bucket.  A bucket holds a
bounded share of the corpus, since the number of buckets grows with it.  The answer is one
bit per key, sent back to the chunk.  In step 1 keys are 32 bits of the hash beside the
bucket, since a false tie only adds a candidate.  In step 2 they are 64 bits, and the bucket
follows from them, so it adds none.  No repeat is missed, but two different strings with one
hash are both removed: among n different candidates at most 6 n^2 / 2^65 such pairs are
expected if each of the up to 6 folding steps spreads evenly, which a fixed hash cannot
promise for texts made against it.

Documents are packed once into chunks of about ``CHUNK_BYTES`` in a table of the
checkpoint folder.  Every step recomputes its keys from the chunk, so a lost executor
costs the tasks it held.  Documents without a tied sample leave after step 1.

A null or empty text has no bytes; texts under LENGTH bytes stay whole; equal rows
lose everything if they are long enough; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkit.llm.common import column_of, prepare, release, texts
from strandkit.session import reliable_checkpoint

LENGTH = 200
# A difference cover from a perfect difference set: 12 numbers whose differences give every residue once.
PERIOD = 133
COVER = (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
CHUNK_BYTES = 8 << 20
# Corpus bytes for each bucket of a sort.
BUCKET_BYTES = 12 << 20
# Step 2 sorts its buckets in so many passes; the shuffle files of a pass go before the next.
PASSES = 2
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93)]


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    """Whether the differences of the cover give every residue."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


@dataclass
class Chunk:
    """Several documents in one byte array, with 8 spare bytes at the end."""

    raw: bytes
    lengths: np.ndarray

    def __post_init__(self):
        self.size = int(self.lengths.sum())
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.words = np.ndarray((self.size + 1,), "<u8", self.raw + bytes(8), strides=(1,))
        self.bytes = np.frombuffer(self.raw, np.uint8)

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """64-bit hash of the ``length`` bytes from each position."""
        h = np.full(len(at), np.uint64(length), np.uint64)
        shifts = [*range(0, length - 7, 8)]
        if length % 8:
            shifts.append(length - 8)
        for shift in shifts:
            h = (h ^ self.words[at + shift]) * _MIX[0]
            h ^= h >> np.uint64(29)
        h *= _MIX[1]
        return h ^ (h >> np.uint64(32))

    def all_hashes(self, block: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(first position, hashes) of the LENGTH bytes from every position, block by block.

        Hashes of 64 and 128 bytes come from those of their halves."""
        last = self.size - LENGTH + 1
        for low in range(0, max(last, 0), block):
            n = min(block, last - low)
            part = self.words[low : low + n + LENGTH - 8]
            h, width, kept = part, 8, {}
            while width < 128:
                h = (h[:-width] * _MIX[0]) ^ (h[width:] + _MIX[1])
                h *= _MIX[2]
                h ^= h >> np.uint64(29)
                width *= 2
                if width == 64:
                    kept[64] = h
            whole = (h[64 : 64 + n] * _MIX[0]) ^ (kept[64][:n] + _MIX[1])
            whole *= _MIX[2]
            whole ^= whole >> np.uint64(31)
            whole = (whole ^ part[192 : 192 + n]) * _MIX[0]
            yield low, whole ^ (whole >> np.uint64(32))

    def samples(self, length: int) -> np.ndarray:
        """Cover positions, counted from the start of each document, with enough bytes after them."""
        member = np.zeros(PERIOD, bool)
        member[list(COVER)] = True
        # some documents at a time, about a megabyte, to keep the arrays small
        block = self.starts >> 20
        cuts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1]))[: len(block)], len(block))
        found = [np.empty(0, np.int64)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            lengths, base = self.lengths[i:j], self.starts[i]
            place = np.arange(int(lengths.sum())) - np.repeat(self.starts[i:j] - base, lengths)
            found.append(base + np.flatnonzero(member[place % PERIOD] & (place + length <= np.repeat(lengths, lengths))))
        return np.concatenate(found)


def _union(first: np.ndarray, behind: np.ndarray, size: int) -> np.ndarray:
    """Marks all places of the stretches [first, behind)."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, behind, -1)
    return np.cumsum(steps[:-1]) > 0


def pack(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Table (chunk, ids, lengths, packed) of the documents (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        part, count = TaskContext.get().partitionId(), 0
        ids, parts, size = [], [], 0

        def full() -> pa.RecordBatch:
            name = part << 32 | count
            return pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                 pa.array([packer.compress(b"".join(parts))], pa.binary())], names=["chunk", "ids", "lengths", "packed"])

        for batch in batches:
            for doc_id, text in zip(column_of(batch, "doc_id").to_pylist(), texts(batch)):
                raw = text.encode()
                if parts and size + len(raw) > chunk_bytes:
                    yield full()
                    ids, parts, size, count = [], [], 0, count + 1
                ids.append(doc_id)
                parts.append(raw)
                size += len(raw)
        if parts:
            yield full()

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(kind)),
                           T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("packed", T.BinaryType())])
    return docs.mapInArrow(rows, schema)


def _open(row: dict) -> Chunk:
    return Chunk(zstandard.ZstdDecompressor().decompress(row["packed"]), np.array(row["lengths"], np.int64))


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


@dataclass
class Keys:
    """Keys of a chunk dealt to buckets: distinct keys by bucket, and where each row's key is."""

    keys: np.ndarray
    repeated: np.ndarray
    back: np.ndarray
    cuts: np.ndarray


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(33))) * _MIX[2]
    return (((mixed >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def _deal(hashes: np.ndarray, buckets: int, dtype: str) -> Keys:
    """Sorts by (bucket, key); the bucket comes from other bits than a short key."""
    bucket = _bucket(hashes, buckets)
    short = hashes.astype(dtype)
    order = np.lexsort((short, bucket))
    b, k = bucket[order], short[order]
    new = np.append(True, (b[1:] != b[:-1]) | (k[1:] != k[:-1]))[: len(k)]
    index = np.cumsum(new) - 1
    back = np.empty(len(k), np.int64)
    back[order] = index
    counts = np.bincount(index)
    cuts = np.searchsorted(b[new], np.arange(buckets + 1))
    return Keys(k[new], counts > 1, back, cuts)


def _ask(rows: DataFrame, keys_of: Callable[[dict], np.ndarray], buckets: int, dtype: str, turn: int = 0, turns: int = 1) -> DataFrame:
    """Table (chunk, answers) with one bit for each distinct key of a chunk: whether the
    string occurs more than once in the corpus.  ``keys_of`` gives the hashes of a row.
    With several turns, this one sorts every ``turns``-th bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            hashes = keys_of(row)
            if turns > 1:
                hashes = hashes[_bucket(hashes, buckets) % turns == turn]
            dealt = _deal(hashes, buckets, dtype)
            spans = [(j, a, b) for j, (a, b) in enumerate(zip(dealt.cuts[:-1], dealt.cuts[1:])) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([j for j, _, _ in spans], pa.int32()), pa.array([row["chunk"]] * len(spans), pa.int64()),
                 pa.array([dealt.keys[a:b].tobytes() for _, a, b in spans], pa.binary()),
                 pa.array([np.packbits(dealt.repeated[a:b]).tobytes() for _, a, b in spans], pa.binary())],
                names=["bucket", "chunk", "keys", "repeated"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def sort() -> pa.RecordBatch:
            parts = [np.frombuffer(r["keys"], dtype) for r in held]
            own = [np.unpackbits(np.frombuffer(r["repeated"], np.uint8), count=len(p)).astype(bool) for r, p in zip(held, parts)]
            keys = np.concatenate(parts)
            order = np.argsort(keys, kind="stable")
            ranked = keys[order]
            same = np.zeros(len(keys), bool)
            equal = ranked[1:] == ranked[:-1]
            same[:-1] |= equal
            same[1:] |= equal
            tied = np.empty(len(keys), bool)
            tied[order] = same
            ends = np.cumsum([len(p) for p in parts])
            bits = [np.packbits(tied[e - len(p) : e] | o).tobytes() for p, o, e in zip(parts, own, ends)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r["chunk"] for r in held], pa.int64()), pa.array([r["bucket"] for r in held], pa.int32()), pa.array(bits, pa.binary())],
                names=["chunk", "bucket", "bits"])

        for row in _one_by_one(batches):
            if held and held[0]["bucket"] != row["bucket"]:
                yield sort()
                held = []
            held.append(row)
        if held:
            yield sort()

    asked = rows.mapInArrow(send, "bucket int, chunk long, keys binary, repeated binary").repartition("bucket").sortWithinPartitions("bucket")
    bits = asked.mapInArrow(answer, "chunk long, bucket int, bits binary")
    return bits.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("answers"))


def _told(hashes: np.ndarray, answers: list[dict] | None, buckets: int, dtype: str) -> np.ndarray:
    """The answer for each hash, in the order of the hashes."""
    dealt = _deal(hashes, buckets, dtype)
    flags = np.zeros(len(dealt.keys), bool)
    for a in answers or []:
        low, high = dealt.cuts[a["bucket"]], dealt.cuts[a["bucket"] + 1]
        flags[low:high] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=high - low).astype(bool)
    return flags[dealt.back]


_RESULT = ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"]


def _result(raw: bytes, gone: np.ndarray) -> tuple[int, int, int, str]:
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
    return len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def repeated_bytes(docs: DataFrame, ident: str = "doc_id", text: str = "text", keep_text: bool = False, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document; with
    ``keep_text`` also the bytes that stay."""
    spark = prepare(docs.sparkSession)
    slim = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType
    corpus = reliable_checkpoint(pack(slim, chunk_bytes))
    total = corpus.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    buckets = max(4, -(-total // bucket_bytes))
    prefix = LENGTH - PERIOD + 1

    def sample_keys(row: dict) -> np.ndarray:
        chunk = _open(row)
        return chunk.hashes(chunk.samples(prefix), prefix)

    first = _ask(corpus, sample_keys, buckets, "<u4")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without a tied sample are done; the others go on with their ties."""
        packer = zstandard.ZstdCompressor(level=1)
        for row in _one_by_one(batches):
            chunk = _open(row)
            at = chunk.samples(prefix)
            at = at[_told(chunk.hashes(at, prefix), row["answers"], buckets, "<u4")]
            owner = np.searchsorted(chunk.ends, at, side="right")
            live = np.zeros(len(chunk.lengths), bool)
            live[owner] = True
            done = [
                (doc_id, *_result(raw, np.zeros(len(raw), bool)), raw if keep_text else None)
                for doc_id, go, s, e in zip(row["ids"], live, chunk.starts, chunk.ends) if not go for raw in [chunk.raw[s:e]]
            ]
            # positions in the bytes of the documents that go on
            shift = chunk.starts - (np.cumsum(np.where(live, chunk.lengths, 0)) - np.where(live, chunk.lengths, 0))
            ties = at - shift[owner]
            body = b"".join(chunk.raw[s:e] for s, e, go in zip(chunk.starts, chunk.ends, live) if go)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["chunk"]], pa.int64()), pa.array([[i for i, go in zip(row["ids"], live) if go]], id_list), pa.array([chunk.lengths[live]], pa.list_(pa.int64())),
                 pa.array([packer.compress(body)], pa.binary()), pa.array([np.diff(ties, prepend=0).astype("<u4").tobytes()], pa.binary()),
                 pa.array([[dict(zip(("id", "n_bytes", "n_removed", "n_spans", "sha", "kept"), d)) for d in done]], done_type)],
                names=["chunk", "ids", "lengths", "packed", "ties", "done"])

    from pyspark.sql.pandas.types import to_arrow_type

    done_spark = T.ArrayType(T.StructType([
        T.StructField("id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("kept", T.BinaryType()),
    ]))
    id_list, done_type = pa.list_(to_arrow_type(kind)), to_arrow_type(done_spark)
    schema = T.StructType([*corpus.schema.fields, T.StructField("ties", T.BinaryType()), T.StructField("done", done_spark)])
    suspects = reliable_checkpoint(corpus.join(first, "chunk", "left").mapInArrow(split, schema))
    del first
    _drop_table(corpus)
    release(spark)
    tied = suspects.drop("done")

    def candidates(row: dict) -> tuple[Chunk, np.ndarray, np.ndarray]:
        """The suffixes of step 2 and their hashes."""
        chunk = _open(row)
        at = np.cumsum(np.frombuffer(row["ties"], "<u4").astype(np.int64))
        start = chunk.starts[np.searchsorted(chunk.ends, at, side="right")] if len(at) else at
        near = _union(np.maximum(at - PERIOD + 1, start), at + 1, chunk.size)
        places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for low, block in chunk.all_hashes():
            place = np.flatnonzero(near[low : low + len(block)])
            inside = place + low + LENGTH <= chunk.ends[np.searchsorted(chunk.ends, place + low, side="right")]
            places.append(place[inside] + low)
            hashes.append(block[place[inside]])
        return chunk, np.concatenate(places), np.concatenate(hashes)

    parts = []
    for turn in range(PASSES):
        parts.append(reliable_checkpoint(_ask(tied, lambda row: candidates(row)[2], buckets, "<u8", turn, PASSES)))
        release(spark)
    second = reduce(DataFrame.unionByName, parts).groupBy("chunk").agg(F.flatten(F.collect_list("answers")).alias("answers"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            chunk, place, hashes = candidates(row)
            found = place[_told(hashes, row["answers"], buckets, "<u8")]
            gone = _union(found, found + LENGTH, chunk.size)
            out = [_result(chunk.raw[s:e], gone[s:e]) for s, e in zip(chunk.starts, chunk.ends)]
            columns = [pa.array(row["ids"], id_list.value_type), *[pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array([chunk.bytes[s:e][~gone[s:e]].tobytes() for s, e in zip(chunk.starts, chunk.ends)], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    final = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string(", ".join(_RESULT)).fields, *([T.StructField("kept", T.BinaryType())] if keep_text else [])])
    cut = tied.join(second, "chunk", "left").mapInArrow(finish, final)
    whole = suspects.select(F.explode("done").alias("d")).select(
        F.col("d.id").alias("doc_id"), "d.n_bytes", "d.n_removed", "d.n_spans", F.col("d.sha").alias("kept_sha256"), *(["d.kept"] if keep_text else [])
    )
    return cut.unionByName(whole)


def _drop_table(written: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    spark = written.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
