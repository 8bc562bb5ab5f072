"""The Common Index File Format as a data source.

A file is a header, then posting lists, then document records, each a protocol-buffer message behind its length.
``spark.read.format("ciff").load(path)`` gives the postings as written, with gaps between documents; ``read_index``
turns them into row ids and checks the whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

POSTINGS = "path string, term string, df long, cf long, i int, gap long, tf int"
DOCS = "path string, docid long, collection_docid string, dl long"


class CiffError(ValueError):
    """The file breaks the format or can't be imported whole."""


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if i >= len(data) or shift > 63:
            raise CiffError("a number is cut short or too long")
        byte = data[i]
        i += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, i


def _signed(value: int, bits: int = 64) -> int:
    value &= (1 << 64) - 1
    value = value - (1 << 64) if value >> 63 else value
    return value if bits == 64 else (value & (1 << bits) - 1) - (1 << bits if value >> (bits - 1) & 1 else 0)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(data, i)
            yield key >> 3, _signed(value)
            continue
        if kind == 2:
            n, i = _varint(data, i)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if n is None:
                raise CiffError("unknown kind of field")
        if i + n > len(data):
            raise CiffError("a field is cut short")
        value, i = data[i : i + n], i + n
        yield key >> 3, struct.unpack("<d", value)[0] if kind == 1 else value


def _messages(f, path: str) -> Iterator[bytes]:
    while True:
        size = shift = 0
        while True:
            byte = f.read(1)
            if not byte:
                if shift:
                    raise CiffError(f"{path}: a length is cut short")
                return
            size |= (byte[0] & 127) << shift
            shift += 7
            if byte[0] < 128:
                break
        data = f.read(size)
        if len(data) < size:
            raise CiffError(f"{path}: a message is cut short")
        yield data


def parse(path: str) -> tuple[dict, Iterator[tuple], Iterator[tuple]]:
    """The header and, to be read one after the other, posting lists and documents."""
    f = open(path, "rb")
    messages = _messages(f, path)
    first = next(messages, None)
    if first is None:
        raise CiffError(f"{path}: no header")
    names = ("version", "num_postings_lists", "num_docs", "total_postings_lists", "total_docs", "total_terms", "average_doclength", "description")
    found = dict(_fields(first))
    header = {n: found.get(k, b"" if n == "description" else 0) for k, n in enumerate(names, 1)}
    header["description"] = header["description"].decode()
    for n in ("num_docs", "num_postings_lists"):
        if header[n] < 0:
            raise CiffError(f"{path}: {n} is negative")
    if header["num_docs"] != header["total_docs"]:
        raise CiffError(f"{path}: only part of the documents was exported")

    def some(n: int, what: str) -> Iterator[bytes]:
        for _ in range(n):
            data = next(messages, None)
            if data is None:
                raise CiffError(f"{path}: fewer {what} than the header says")
            yield data

    def lists() -> Iterator[tuple]:
        for data in some(header["num_postings_lists"], "posting lists"):
            term, df, cf, posts = "", 0, 0, []
            for k, v in _fields(data):
                if k == 1:
                    term = v.decode()
                elif k == 2:
                    df = v
                elif k == 3:
                    cf = v
                elif k == 4:
                    p = dict(_fields(v))
                    posts.append((p.get(1, 0), p.get(2, 0)))
            if len(posts) != df:
                raise CiffError(f"{path}: {term!r} has {len(posts)} postings, not {df}")
            yield term, df, cf, posts

    def docs() -> Iterator[tuple]:
        for data in some(header["num_docs"], "documents"):
            d = dict(_fields(data))
            yield d.get(1, 0), d.get(2, b"").decode(), d.get(3, 0)
        if next(messages, None) is not None:
            raise CiffError(f"{path}: more than the header says")
        f.close()

    return header, lists(), docs()


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.docs = options.get("part", "postings") == "documents"

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        path = partition.value
        header, lists, docs = parse(path)
        for term, df, cf, posts in lists:
            if not self.docs:
                yield from ((path, term, df, cf, i, gap, tf) for i, (gap, tf) in enumerate(posts))
        if self.docs:
            yield from ((path, *d) for d in docs)


class CiffSource(DataSource):
    """Options: ``path`` (files, separated by commas, a task each) and ``part``, postings (default) or documents."""

    @classmethod
    def name(cls) -> str:
        return "ciff"

    def schema(self) -> str:
        return DOCS if self.options.get("part", "postings") == "documents" else POSTINGS

    def reader(self, schema):
        return _Reader(self.options)


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings (``term``, ``row_id``, ``tf``) and lengths (``row_id``, ``dl``) of one file.

    Gaps become ids by a running sum. Refused: repeated terms, ids that don't rise or aren't 0 to n - 1, counts
    under 1, documents unlike the postings' ids, lengths that don't add up to the header's total and, if all terms were
    exported, counts that don't.
    """
    header, _, _ = parse(path)
    spark.dataSource.register(CiffSource)
    raw = spark.read.format("ciff").option("path", path).load()
    docs = spark.read.format("ciff").option("path", path).option("part", "documents").load()
    post = raw.select("term", "i", "gap", F.sum("gap").over(W.partitionBy("term").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("row_id"), "tf")
    bad = post.where(((F.col("i") > 0) & (F.col("gap") <= 0)) | (F.col("tf") < 1) | (F.col("row_id") < 0) | (F.col("row_id") >= header["num_docs"]))
    wrong = bad.select("term").first()
    if wrong:
        raise CiffError(f"{path}: the postings of {wrong.term!r} aren't rising ids of its documents with counts")
    if raw.where("i = 0").groupBy("term").count().where("count > 1").first():
        raise CiffError(f"{path}: a term has two lists")
    got = docs.agg(F.count("*").alias("n"), F.count_distinct("docid").alias("ids"), F.min("docid").alias("low"), F.max("docid").alias("high"), F.min("dl").alias("least"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
    if got.n and (got.ids != got.n or got.low != 0 or got.high != got.n - 1 or got.least < 0):
        raise CiffError(f"{path}: the documents aren't numbered 0 to {got.n - 1} with lengths")
    if got.total != header["total_terms"]:
        raise CiffError(f"{path}: lengths add up to {got.total}, not {header['total_terms']}")
    if header["num_postings_lists"] == header["total_postings_lists"]:
        total = post.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("t")).first().t
        if total != header["total_terms"]:
            raise CiffError(f"{path}: counts add up to {total}, not {header['total_terms']}")
    return post.select("term", "row_id", "tf"), docs.select(F.col("docid").alias("row_id"), "dl")
