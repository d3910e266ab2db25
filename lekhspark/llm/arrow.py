"""Small helpers shared by the Arrow operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa

# The code points with the Unicode property White_Space, as a regex class body.
WS_CLASS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: The same class for Spark's Java regular expressions.
JAVA_WS = "[\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


@lru_cache(maxsize=8)
def _built(factory: Callable, key: bytes):
    return factory(key)


class Shared:
    """A model sent to the executors as bytes and built once per Python worker.

    ``factory`` must be a module-level function of the bytes.
    """

    def __init__(self, spark, factory: Callable, payload: bytes):
        self._bc = spark.sparkContext.broadcast(payload)
        self._factory = factory

    def get(self):
        return _built(self._factory, self._bc.value)


def sliced(batches: Iterable[pa.RecordBatch], text_col: str, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``max_bytes`` of text at most (one row at least)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        col = b.column(b.schema.get_field_index(text_col))
        if col.nbytes <= max_bytes:
            yield b
            continue
        at, step = 0, max(1, b.num_rows * max_bytes // max(1, col.nbytes))
        while at < b.num_rows:
            yield b.slice(at, step)
            at += step
