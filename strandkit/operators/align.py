"""Global alignment identity over a table of sequence pairs.

Of all alignments with the best score the one with the most matches counts, and of those the
shortest.  Score, matches and length of a cell are one number, ordered in this way, and
every step of an alignment adds to it.  The recurrence over these numbers therefore ends
with the answer: it keeps one row of cells, and no path has to be found again.  Pairs of
similar length are filled together, one row of all of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandkit.constants import BLOSUM62

LOW = -(1 << 62)
# Cells of a row that are filled together.
ROW_CELLS = 1 << 16


def score_matrix(text: str = BLOSUM62) -> dict[tuple[str, str], int]:
    """Symmetric scores from a lower-triangle listing."""
    rows = [line.split() for line in text.strip().splitlines()]
    order = [r[0] for r in rows]
    scores = {}
    for r in rows:
        for other, value in zip(order, r[1:]):
            scores[r[0], other] = scores[other, r[0]] = int(value)
    return scores


class Aligner:
    """Affine-gap global alignment of many pairs at once."""

    def __init__(self, scores: dict[tuple[str, str], int] | None = None, gap_open: int = -11, gap_extend: int = -1,
                 match: int = 4, mismatch: int = -4) -> None:
        self.scores = scores if scores is not None else score_matrix()
        self.gap_open, self.gap_extend = gap_open, gap_extend
        self.match, self.mismatch = match, mismatch

    def _table(self, symbols: list[str]) -> np.ndarray:
        return np.array([
            [self.scores.get((x, y), self.match if x == y else self.mismatch) for y in symbols] for x in symbols
        ], dtype=np.int64).reshape(len(symbols), len(symbols))

    def _base(self, symbols: np.ndarray, longest: int) -> int:
        """Digits of a cell's number: length and matches stay below it."""
        base = longest + 2
        most = max(int(np.abs(symbols).max(initial=1)), abs(self.gap_open), abs(self.gap_extend), 1)
        if most * base * base * base >= 1 << 61:
            raise ValueError(f"sequences of together {longest} symbols are too long to align")
        return base

    def align(self, pairs: list[tuple[str, str]]) -> list[tuple[int, int, int]]:
        """(score, matches, length) of each pair, filled together."""
        symbols = sorted({c for a, b in pairs for c in a + b})
        place = {c: i for i, c in enumerate(symbols)}
        table = self._table(symbols)
        rows, width = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
        base = self._base(table, max(len(a) + len(b) for a, b in pairs))
        step = lambda score: score * base * base - 1  # one column of the alignment
        o, e = step(self.gap_open), step(self.gap_extend)
        paired = table * (base * base) - 1 + base * np.eye(len(symbols), dtype=np.int64)
        left = np.zeros((len(pairs), rows), dtype=np.int64)
        right = np.zeros((len(pairs), width), dtype=np.int64)
        for i, (a, b) in enumerate(pairs):
            left[i, :len(a)] = [place[c] for c in a]
            right[i, :len(b)] = [place[c] for c in b]
        n, m = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
        slope = e * np.arange(width + 1)
        # states: M ends with a pair of symbols, X with a gap in b, Y with a gap in a
        M, X, Y = (np.full((len(pairs), width + 1), LOW) for _ in range(3))
        M[:, 0] = 0
        Y[:, 1:] = o + slope[:-1]
        out = np.full(len(pairs), LOW)

        def end(i: int) -> None:
            done = np.flatnonzero(n == i)
            out[done] = np.maximum(np.maximum(M[done, m[done]], X[done, m[done]]), Y[done, m[done]])

        end(0)
        for i in range(1, rows + 1):
            best = np.maximum(np.maximum(M, X), Y)
            X = np.maximum(np.maximum(M, Y) + o, X + e)
            M[:, 1:] = best[:, :-1] + paired[left[:, i - 1, None], right]
            M[:, 0] = LOW
            np.maximum(M, LOW, out=M)
            np.maximum(X, LOW, out=X)
            # a run of gaps along the row is a running maximum after removing its slope
            start = np.maximum(M, X) + o - e - slope
            Y[:, 1:] = np.maximum.accumulate(start, axis=1)[:, :-1] + slope[1:]
            Y[:, 0] = LOW
            end(i)
        # the number is score * base^2 + matches * base - length
        length = -out % base
        rest = (out + length) // base
        return [(int((r - r % base) // base), int(r % base), int(x)) for r, x in zip(rest, length)]

    def score(self, a: str, b: str) -> int:
        return self.align([(a, b)])[0][0]

    def identity(self, a: str, b: str) -> float:
        """Matches over alignment length; 0 if one of the sequences is empty."""
        return self.identities([(a, b)])[0]

    def identities(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = [0.0] * len(pairs)
        for some in self._batches(pairs):
            for i, (_, matches, length) in zip(some, self.align([pairs[i] for i in some])):
                out[i] = matches / length
        return out

    def _batches(self, pairs: list[tuple[str, str]]) -> Iterator[list[int]]:
        """Pairs of similar lengths, ``ROW_CELLS`` cells of a row together; equal lengths stay whole."""
        order = sorted((i for i, (a, b) in enumerate(pairs) if a and b), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
        batch: list[int] = []
        widest = 0
        for i in order:
            widest = max(widest, len(pairs[i][1])) if batch else len(pairs[i][1])
            rows = len(pairs[i][0])
            if batch and ((len(batch) + 1) * (widest + 1) > ROW_CELLS or rows > 1.25 * len(pairs[batch[0]][0]) + 8):
                yield batch
                batch, widest = [], len(pairs[i][1])
            batch.append(i)
        if batch:
            yield batch


def pair_identity(pairs: DataFrame, a: str = "seq_a", b: str = "seq_b", aligner: Aligner | None = None) -> DataFrame:
    """Adds ``identity``.  Work is quadratic per pair: distinct pairs are dealt over
    tasks at random, and only sampled or requested pair tables come here."""
    tool = aligner or Aligner()
    spread = pairs.repartition(F.xxhash64(a, b))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema.fields)

    def run(batches):
        for batch in batches:
            left, right = batch.column(a).to_pylist(), batch.column(b).to_pylist()
            found = iter(tool.identities([(x, y) for x, y in zip(left, right) if x is not None and y is not None]))
            values = [next(found) if x is not None and y is not None else None for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, "identity"])

    return spread.mapInArrow(run, fields + ", identity double")
