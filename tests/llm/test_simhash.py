import numpy as np
import pytest

from feedsift.llm import simhash


@pytest.mark.parametrize("n,m", [(1, 1), (3, 70), (300, 130), (64, 64), (700, 700)])
@pytest.mark.parametrize("radius", [0, 3, 4, 7])
def test_bit_sliced_comparison_finds_all_close_pairs(n, m, radius):
    rng = np.random.default_rng(n + m)
    seeds = rng.integers(0, 1 << 63, 5, dtype=np.uint64) * np.uint64(2)

    def some(k):
        out = seeds[rng.integers(0, 5, k)]
        for _ in range(6):
            out = out ^ (np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64))
        return out

    left, right = some(n), some(m)
    i, j = simhash.close(left, right, radius)
    want = np.argwhere(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [tuple(x) for x in want.tolist()]
