"""Quality rules as a short-circuit cascade.

Each rule rejects a document from its whole text.  On a sample the cascade
measures what a rule costs and which documents it rejects, and orders the rules
by rejections per second among the documents that the earlier rules leave.  The
main pass then stops at the first rule that rejects.  The order changes the cost
and never the verdict: a document is kept if no rule rejects it.

The sample is the first ``SAMPLE_ROWS`` documents of each of ``SAMPLE_PARTITIONS``
partitions spread over the table; the other partitions are not read.  It decides the
order alone.
A null text counts as empty, and an empty text is rejected for its length.  An
empty table gives an empty result; repeated rows get equal verdicts; columns
other than the text and the id are passed through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkit.llm.common import SPACES, column_of, prepare, texts

SAMPLE_PARTITIONS = 16
SAMPLE_ROWS = 125
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINE_SHARE = 0.5
MIN_MEAN_CHARS, MAX_MEAN_CHARS = 3, 10
MIN_LETTER_WORD_SHARE = 0.7
MAX_CAPITAL_SHARE = 0.5
SYMBOLS = "#*$%&|<>"

_LETTER_CLASS = bytes(
    0x20 if c in SPACES.encode() else 0x61 if c >= 0x80 or chr(c).isalpha() else 0x2E for c in range(256)
)
_CAPITALS = bytes(range(65, 91))
_SMALLS = bytes(range(97, 123))


class Measures:
    """Measures of one text, each taken when a rule first asks for it."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(c) for c in SPACES)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.raw.count(c) for c in SYMBOLS.encode())

    @cached_property
    def wordy_lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.wordy_lines) - len(set(self.wordy_lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside three-word windows that occur at least twice."""
        n = self.n_words
        if n < 4:
            return 0
        codes: dict[bytes, int] = {}
        ids = np.fromiter((codes.setdefault(w, len(codes)) for w in self.words), np.int64, n)
        width = len(codes)
        if width == n:
            return 0
        pairs = ids[:-2] * width + ids[1:-1]
        if width > 1 << 20:  # a third factor would not fit into 64 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, inverse, counts = np.unique(pairs * width + ids[2:], return_inverse=True, return_counts=True)
        repeated = counts[inverse] > 1
        inside = np.zeros(n, bool)
        for shift in range(3):
            inside[shift : n - 2 + shift] |= repeated
        return int(inside.sum())

    @cached_property
    def n_letter_words(self) -> int:
        return sum(b"a" in w for w in self.raw.translate(_LETTER_CLASS).split())

    @cached_property
    def n_capitals(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _CAPITALS))

    @cached_property
    def n_smalls(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SMALLS))


def too_short(m: Measures) -> bool:
    return m.n_words < MIN_WORDS


def repeats_itself(m: Measures) -> bool:
    return 100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words


def many_symbols(m: Measures) -> bool:
    return m.n_symbols > MAX_SYMBOLS_PER_WORD * m.n_words


def many_dup_lines(m: Measures) -> bool:
    return m.n_dup_lines > MAX_DUP_LINE_SHARE * len(m.wordy_lines)


def odd_word_length(m: Measures) -> bool:
    return not MIN_MEAN_CHARS * m.n_words <= m.word_chars <= MAX_MEAN_CHARS * m.n_words


def few_letter_words(m: Measures) -> bool:
    return m.n_letter_words < MIN_LETTER_WORD_SHARE * m.n_words


def mostly_capitals(m: Measures) -> bool:
    return m.n_capitals > MAX_CAPITAL_SHARE * (m.n_capitals + m.n_smalls)


RULES: dict[str, Callable[[Measures], bool]] = {
    rule.__name__: rule
    for rule in (too_short, repeats_itself, many_symbols, many_dup_lines, odd_word_length, few_letter_words, mostly_capitals)
}


def estimate(docs: DataFrame, text: str = "text", rules: dict[str, Callable[[Measures], bool]] | None = None) -> DataFrame:
    """(fired, n, seconds): sampled documents by the set of rules that reject them.

    Bit i of ``fired`` stands for rule i, ``seconds`` holds the time of each rule.
    At most two to the number of rules rows, whatever the table."""
    rules = RULES if rules is None else rules
    tests = list(rules.values())
    slim = docs.select(F.col(text).alias("text"))
    stride = max(1, slim.rdd.getNumPartitions() // SAMPLE_PARTITIONS)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = 0 if TaskContext.get().partitionId() % stride else SAMPLE_ROWS
        while left > 0 and (batch := next(batches, None)) is not None:
            fired, spent = [], []
            batch = batch.slice(0, left)
            left -= batch.num_rows
            for value in texts(batch):
                bits, times = 0, []
                for i, test in enumerate(tests):
                    start = time.perf_counter()
                    bits |= bool(test(Measures(value))) << i  # each rule pays for its own measures
                    times.append(time.perf_counter() - start)
                fired.append(bits)
                spent.append(times)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fired, pa.int64()), pa.array(spent, pa.list_(pa.float64()))], names=["fired", "spent"]
            )

    probed = slim.mapInArrow(probe, "fired long, spent array<double>")
    times = [F.sum(F.col("spent")[i]).alias(name) for i, name in enumerate(rules)]
    return probed.groupBy("fired").agg(F.count(F.lit(1)).alias("n"), F.array(*times).alias("seconds"))


def order_rules(seen: list[tuple[int, int, list[float]]], names: list[str]) -> list[str]:
    """Rules by rejections per second among the documents left by earlier rules."""
    cost = [sum(row[2][i] for row in seen) + 1e-9 for i in range(len(names))]
    left, order = [(row[0], row[1]) for row in seen], []
    while len(order) < len(names):
        def gain(i: int) -> float:
            return sum(n for fired, n in left if fired >> i & 1) / cost[i]

        best = max((i for i in range(len(names)) if names[i] not in order), key=lambda i: (gain(i), -cost[i], -i))
        order.append(names[best])
        left = [(fired, n) for fired, n in left if not fired >> best & 1]
    return order


def plan_cascade(docs: DataFrame, text: str = "text") -> list[str]:
    rows = estimate(docs, text).collect()
    return order_rules([(r["fired"], r["n"], r["seconds"]) for r in rows], list(RULES))


def rejected_by(m: Measures, order: list[str]) -> str | None:
    """The first rule that rejects, in the order of the cascade."""
    for name in order:
        if RULES[name](m):
            return name
    return None


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass the cascade, with all their columns.  No shuffle."""
    prepare(docs.sparkSession)
    order = plan_cascade(docs, text)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([rejected_by(Measures(t), order) is None for t in texts(batch, text)], pa.bool_()))

    return docs.mapInArrow(passing, docs.schema)


def judge(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures and verdict of every document."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    order = plan_cascade(docs)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(len(longs) + 2)]
            for value in texts(batch):
                m = Measures(value)
                kept = rejected_by(m, order) is None
                for column, got in zip(out, [*[getattr(m, c) for c in longs], too_short(m) or repeats_itself(m), kept]):
                    column.append(got)
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), *[pa.array(c, pa.int64()) for c in out[:-2]], *[pa.array(c, pa.bool_()) for c in out[-2:]]],
                names=["doc_id", *longs, "base_failed", "kept"],
            )

    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in longs],
                           T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    return docs.mapInArrow(rows, schema)


# The same rules in SQL, for the comparison of results.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM p),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM c, (VALUES (0), (1), (2)) AS s(j) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
  len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS lw, len(regexp_extract_all(t, '[A-Z]')) AS cap, len(regexp_extract_all(t, '[a-z]')) AS low
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > 0.1::DOUBLE * n_words OR n_dup_lines > 0.5::DOUBLE * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words
  OR lw < 0.7::DOUBLE * n_words OR cap > 0.5::DOUBLE * (cap + low)) AS kept FROM m"""
