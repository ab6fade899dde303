"""Batches in bounded pieces."""

import pyarrow as pa

from tallyward.llm.common import slices


def test_slices_are_bounded_and_whole():
    texts = ["a" * n for n in (3, 0, 50, 7, 7, 7, 200, 1)] + [None, "", "b" * 9]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    for rows in (1, 3, 100):
        parts = list(slices(iter([batch, batch.slice(0, 0), batch.slice(2, 5)]), rows, 1, 20))
        assert [r for p in parts for r in p.column(0).to_pylist()] == [*range(len(texts)), *range(2, 7)]
        assert all(0 < p.num_rows <= rows for p in parts)
        assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 20 for p in parts)
    assert [p.num_rows for p in slices(iter([batch]), 4)] == [4, 4, 3]
