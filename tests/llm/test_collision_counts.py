"""Collisions of wide windows are counted by rank, without a list of the places inside."""

import numpy as np
import pyarrow as pa
import pytest

from strandkit.llm import collisions as co


@pytest.mark.parametrize("n, dim", [(1, 3), (300, 8), (4096, 64)])
def test_counts_by_rank_are_those_by_place(n, dim):
    rng = np.random.default_rng(n)
    vecs = rng.normal(size=(n, dim))
    table = pa.table({"vec": pa.array(vecs.tolist(), pa.list_(pa.float64())), "ids": pa.array([[i] for i in range(n)], pa.list_(pa.int64()))})
    built = co._build_block((pa.scalar(dim), pa.scalar(0)), table).to_batches()[0]
    block = co._Block(built, 0, dim)
    queries = np.random.default_rng(1).normal(size=(5, dim))
    norms = co._norms(queries)
    own = (queries / norms[:, None]) @ co.planes(dim)
    for radius in (0.0, 0.02, 0.7, 3.0, np.inf):
        low, high = block.windows(own, radius)
        for row in range(5):
            counts = np.zeros(n, dtype=np.int64)
            block.count(counts, [(i, a, b) for i, (a, b) in enumerate(zip(low[row], high[row]))])
            assert (block.within(low[row], high[row]) == counts).all()
    for q in range(5):
        scores, ids = block.verify((np.zeros(0), np.zeros(0, dtype=np.int64)), -1, queries[q], norms[q], np.arange(n), 4)
        exact = np.einsum("ij,j->i", vecs, queries[q]) / (co._norms(vecs) * norms[q])
        best = np.lexsort((np.arange(n), -exact))[:4]
        assert ids.tolist() == best.tolist() and (scores == exact[best]).all()
        again = block.verify((scores, ids), -1, queries[q], norms[q], np.arange(n), 4)
        assert again[1].tolist() == ids.tolist()
