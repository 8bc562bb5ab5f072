"""The 64-bit XXH3 hash, for checksums of stored bytes and ids of fields. Spark's own ``xxhash64`` is another function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def xxh3(data: bytes) -> int:
    """Unsigned."""
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


def field_id(name: str) -> int:
    """The id of a field by its name: never 0, which stands for no field."""
    if not name:
        raise ValueError("a field needs a name")
    return xxh3(name.encode()) or 1


@F.pandas_udf(LongType())
def checksum(data: pd.Series) -> pd.Series:
    """Of a binary column, as a signed 64-bit number; null for null."""
    signed = [None if d is None else (h := xxh3(bytes(d))) - (h >> 63 << 64) for d in data]
    return pd.Series(signed, dtype="Int64")
