"""How many bytes stored vectors, codes and graph nodes take: one law for every writer and reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH = 32  # vectors whose codes are interleaved


def _blocks(n: Column) -> Column:
    return F.ceil(n / BATCH)


def batch_data_len(padded: Column) -> Column:
    """Sign codes of a batch and three 4-byte factors a vector."""
    return (padded * BATCH / 8 + 3 * 4 * BATCH).cast("long")


def ex_entry_len(padded: Column, ex_bits: Column) -> Column:
    """Magnitude bits of a vector and their two 4-byte factors; nothing without such bits."""
    return F.when(ex_bits == 0, F.lit(0)).otherwise(F.floor(padded * ex_bits / 8) + 8).cast("long")


def code_bytes_length(n: Column, padded: Column, ex_bits: Column) -> Column:
    """Codes of a cluster of ``n`` vectors: whole batches of sign codes, then the magnitude entries."""
    return (_blocks(n) * batch_data_len(padded) + n * ex_entry_len(padded, ex_bits)).cast("long")


def node_record_size(dims: Column, degree: Column) -> Column:
    """Row id, vector, number of edges, four spare bytes, and room for ``degree`` edges."""
    return (16 + 4 * dims + 4 * degree).cast("long")


def packed_code_len(n: Column, width: Column) -> Column:
    """Codes of ``width`` bytes in whole batches."""
    return (_blocks(n) * BATCH * width).cast("long")
