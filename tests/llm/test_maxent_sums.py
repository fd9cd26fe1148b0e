"""Sums of gradients by runs of rows."""

import numpy as np

from loomwork.llm import maxent


def test_runs_are_summed_in_order():
    rng = np.random.default_rng(5)
    for sizes in ([1], [2, 1, 24, 25, 3, 400, 1], rng.integers(1, 60, 300), [7] * 50):
        p = rng.normal(size=(int(np.sum(sizes)), 16)).astype(np.float32)
        first = np.cumsum(sizes) - np.array(sizes)
        assert np.array_equal(maxent._run_sums(p, first), np.add.reduceat(p, first, axis=0))
