"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

import pyarrow as pa

from scorekit.shipping import BATCH_BYTES, bounded_batches  # noqa: F401


def give_back(*remembered: dict) -> None:
    """At the end of a task: forget what is cheap to learn again and return unused memory. Workers serve many stages."""
    for cache in remembered:
        cache.clear()
    pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """Texts of a batch; NULL is empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """Texts of a batch as UTF-8; NULL is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(binary).to_pylist()]


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with ``columns`` at its end; those of the same name go."""
    kept = [i for i, name in enumerate(batch.schema.names) if name not in columns]
    names = [batch.schema.names[i] for i in kept] + list(columns)
    return pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + list(columns.values()), names=names)
