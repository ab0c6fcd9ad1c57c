"""The wrapper that hands freed memory back changes nothing of what passes through it."""

import pyarrow as pa

from tessera.llm._io import tidy


def test_tidy_passes_all_batches():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (3, 0, 5)]

    def doubled(given):
        for b in given:
            yield b
            yield b

    assert list(tidy(doubled)(iter(batches))) == [b for b in batches for _ in range(2)]
    assert list(tidy(doubled)(iter([]))) == []


def test_tidy_with_state_over_batches():
    def total(given):
        yield pa.RecordBatch.from_pydict({"n": [sum(b.num_rows for b in given)]})

    batches = [pa.RecordBatch.from_pydict({"x": [1, 2]})] * 4
    assert next(tidy(total)(iter(batches)))["n"].to_pylist() == [8]
    assert next(tidy(total)(iter([])))["n"].to_pylist() == [0]
