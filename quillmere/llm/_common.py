"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import bounded, discard, new_folder, shared_dir, written  # noqa: F401


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A filesystem and a path in it, for ``file:``, ``hdfs:``, ``s3:`` or ``gs:`` addresses and bare paths."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def publish(uri: str, write) -> None:
    """Call ``write(stream)`` on a private file, then move it to ``uri``: a retried or doubled task leaves one whole file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary, compression=None) as out:
        write(out)
    fs.move(temporary, path)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``id`` and ``text``; other columns can't clash with what an operator adds."""
    return bounded(df).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def no_null(texts: pa.Array) -> pa.Array:
    """Plain ``string`` in one piece, with null as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.cast(pa.string()).fill_null("")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``limit`` bytes of text, one row at least, which bounds what a worker holds."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def split_chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Cut every text before each space or line feed, losing nothing.

    Gives the code of every piece, the bounds of each text among them (one more than the texts), and the distinct
    pieces. The pieces share the texts' buffer, so nothing is copied but the distinct ones.
    """
    texts = no_null(texts)
    n = len(texts)
    _, offsets, data = texts.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64), pa.array([], pa.string())
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    cuts = np.zeros(len(raw) + 1, bool)
    cuts[:-1] = (raw == 32) | (raw == 10)
    cuts[at[:-1] - at[0]] = True
    cuts[-1] = False
    starts = np.flatnonzero(cuts) + at[0]
    bounds = np.searchsorted(starts, at)
    pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, at[-1]).astype(np.int32)), data)
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), bounds, coded.dictionary


def gather(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[offsets[c]:offsets[c + 1]]`` for each code, end to end, and where each begins."""
    lengths = np.diff(offsets)[codes]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    index = np.arange(ends[-1]) + np.repeat(offsets[:-1][codes] - ends[:-1], lengths)
    return flat[index], ends


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well spread values from any integers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
