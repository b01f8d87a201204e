"""Arrow record batches in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Text handled at once in a worker.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of a text column each.

    A single row may be longer; it then is a part by itself.
    """
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and held + size > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def replaced(batch: pa.RecordBatch, schema: pa.Schema, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with some columns replaced or added, in the order of ``schema``."""
    have = dict(zip(batch.schema.names, batch.columns, strict=True)) | columns
    return pa.RecordBatch.from_arrays(
        [have[f.name] if have[f.name].type == f.type else have[f.name].cast(f.type) for f in schema],
        schema=schema,
    )
