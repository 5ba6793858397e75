"""Windows with half a hash in common are no match."""

import numpy as np
import pyarrow as pa

from docloom.llm import rlz_dedup


def test_all_bits_of_a_window_count(monkeypatch):
    real = rlz_dedup.windows_of

    def near(*a):
        start, full, least, place = real(*a)
        return start, full & np.uint64(0xFFFFFFFF) | np.uint64(7 << 32), np.zeros_like(least), place

    monkeypatch.setattr(rlz_dedup, "windows_of", near)
    rng = np.random.default_rng(0)
    own, other = (rng.integers(0, 2**63, 20).astype(np.uint64) for _ in range(2))
    found = lambda *docs: rlz_dedup._match(pa.Table.from_batches([rlz_dedup._rows([i], [False], [0], [h], 20, 6, 1) for i, h in enumerate(docs)])).num_rows
    assert found(own, other) == 0 and found(own, own) == 1
