"""The parity sketch never counts more differing bits than two shingle sets have differing shingles."""

import numpy as np

from parlance.llm import minhash


def test_sketch_is_a_lower_bound_on_the_difference():
    rng = np.random.default_rng(5)
    for size, extra in ((1, 0), (1, 1), (40, 3), (300, 90), (5000, 1), (5000, 4000)):
        base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        other = np.unique(np.concatenate([base[extra // 2 :], rng.integers(0, 2**63, extra, dtype=np.uint64)]))
        words = minhash.sketch(base) ^ minhash.sketch(other)
        assert words.dtype == np.int64 and len(words) == minhash.SKETCH // 64
        bits = sum(int(w).bit_count() for w in words.view(np.uint64))
        differ = len(np.setxor1d(base, other))
        assert bits <= differ and (bits - differ) % 2 == 0
