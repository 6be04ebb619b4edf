"""Session and Arrow helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from tessera.store import materialize, new_path, shared_dir  # noqa: F401  (used by the operators)

#: Texts are worked on in slices of about so many bytes, so that numpy's temporaries stay small.
SLICE_BYTES = 1 << 20


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts_of(col: pa.Array) -> list[str]:
    """Python strings; a null is an empty text."""
    return [x or "" for x in col.to_pylist()]


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copies of single texts; a null is an empty text."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of about `most` bytes; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def free(name: str, columns: Iterable[str]) -> str:
    """A name for a column of an operator's own beside `columns`, whose case Spark doesn't tell apart."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the operators take a path, the queries pass this one."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)
    return public_tokenizers.path(name)


_KEPT: dict[str, tuple[object, object]] = {}


def kept(kind: str, key: object, make):
    """The model and table of the operator that a Python worker runs, shared by its tasks; a next operator's replaces it."""
    if kind not in _KEPT or _KEPT[kind][0] != key:
        release()
        _KEPT[kind] = (key, make())
    return _KEPT[kind][1]


def release() -> None:
    """Give a worker's kept model and table back."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
