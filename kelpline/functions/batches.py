"""Arrow batches within a task, cut so that Python holds few texts at a time, however many rows Spark sends together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of texts that are looked at at a time; a longer text by itself.
CUT = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CUT) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, at most ``most`` bytes of a column of texts or files together."""
    for batch in batches:
        start, held = 0, 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
