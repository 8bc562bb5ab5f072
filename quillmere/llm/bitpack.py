"""Token ids in fixed-width binary files with random access.

Every id takes ``bits`` bits, the fewest that hold the vocabulary, least significant bit first. A shard file is a run
of blocks of ``block_tokens`` ids (the last may be shorter, padded to a multiple of 8 ids), then one little-endian
uint64 offset for each block and one for their end, then a 40-byte trailer: magic, bits, block_tokens, ids, blocks.
A block starts at a whole byte, so any range of ids is read by seeking to its blocks alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import bytebpe
from ._common import filesystem, id_text, new_folder, publish

MAGIC = b"QMBITS01"
_TRAILER = struct.Struct("<8sIIQQQ")
SCHEMA = "doc_id long, shard int, first_token long, n_tokens long, first_block long, bits int, file string"


def min_bits(vocab: int) -> int:
    """The fewest bits for the ids 0 to ``vocab - 1``, one at least."""
    return max(1, (vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, padded with zeros to a multiple of 8 ids. Ids that don't fit raise ValueError."""
    if not 1 <= bits <= 32:
        raise ValueError("bits must be from 1 to 32")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    wide = np.zeros(-(-len(ids) // 8) * 8, np.uint64)
    wide[: len(ids)] = ids
    wide = wide.reshape(-1, 8)
    out = np.zeros((len(wide), bits), np.uint8)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        x = wide[:, k] << np.uint64(shift)
        for j in range((shift + bits + 7) // 8):
            out[:, byte + j] |= ((x >> np.uint64(8 * j)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed ``data``."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, bits)
    out = np.empty((len(rows), 8), np.uint32)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        x = np.zeros(len(rows), np.uint64)
        for j in range((shift + bits + 7) // 8):
            x |= rows[:, byte + j].astype(np.uint64) << np.uint64(8 * j)
        out[:, k] = ((x >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.uint32)
    return out.reshape(-1)[:n]


class ShardWriter:
    """Appends ids to an open stream, a block at a time; ``close`` writes offsets and trailer."""

    def __init__(self, out, bits: int, block_tokens: int):
        if block_tokens % 8 or block_tokens <= 0:
            raise ValueError("block_tokens must be a positive multiple of 8")
        self.out, self.bits, self.block = out, bits, block_tokens
        self.offsets, self.total, self.held, self.n_held = [0], 0, [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= self.block:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.block * self.block
            size = self.block * self.bits // 8
            self.out.write(pack(flat[:whole], self.bits))
            for _ in range(whole // self.block):
                self.offsets.append(self.offsets[-1] + size)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        if self.n_held:
            data = pack(np.concatenate(self.held), self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(_TRAILER.pack(MAGIC, self.bits, self.block, self.total, len(self.offsets) - 1, 0))


class Shard:
    """Random access to a shard file."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.f = fs.open_input_file(path)
        size = self.f.size()
        magic, self.bits, self.block, self.total, blocks, _ = _TRAILER.unpack(self.f.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        at = size - _TRAILER.size - 8 * (blocks + 1)
        self.offsets = np.frombuffer(self.f.read_at(8 * (blocks + 1), at), "<u8").astype(np.int64)

    def read(self, first: int, n: int) -> np.ndarray:
        """Ids ``first`` to ``first + n - 1``, reading only their blocks."""
        if first < 0 or n < 0 or first + n > self.total:
            raise IndexError("outside the shard")
        if n == 0:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (first + n - 1) // self.block
        data = self.f.read_at(int(self.offsets[b + 1] - self.offsets[a]), int(self.offsets[a]))
        ids = unpack(data, self.bits, len(data) * 8 // self.bits)
        return ids[first - a * self.block : first - a * self.block + n]


def write_tokens(
    spark: SparkSession, docs: DataFrame, vocabulary: str, block_tokens: int = 65_536, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """Encode every text and write its ids to bit-packed shard files, one a partition, in ``folder`` (or a new one of the shared folder).

    Gives one row a document: shard, place of its first id, number of ids, block of the first id, bits and file. The
    files are written when the rows are computed, and again, equal, if a task is run again. A null or empty text has a
    row with no ids. Rows with a null or repeated id each have their own row. An empty table gives no row; its shards
    hold no ids. There is no shuffle.
    """
    folder = folder or new_folder(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bytebpe.load(vocabulary)
        bits, shard = min_bits(encoder.vocab), TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:06d}.qmbits"
        ready: list[pa.RecordBatch] = []

        def write(out) -> None:
            writer = ShardWriter(out, bits, block_tokens)
            for batch in batches:
                before = writer.total
                ids, bounds = encoder.encode(batch.column("text"))
                writer.add(ids)
                n = batch.num_rows
                first = before + bounds[:-1]
                ready.append(
                    pa.RecordBatch.from_arrays(
                        [batch.column("id"), pa.array(np.full(n, shard, np.int32)), pa.array(first), pa.array(np.diff(bounds)), pa.array(first // block_tokens), pa.array(np.full(n, bits, np.int32)), pa.array([uri]).take(pa.array(np.zeros(n, np.int64)))],
                        names=[c.split()[0] for c in SCHEMA.split(", ")],
                    )
                )
            writer.close()

        publish(uri, write)
        yield from ready

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
