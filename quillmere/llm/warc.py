"""Web archives: one gzip stream a file in, one gzip member a record out, with a sidecar index of offsets."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import filesystem, new_folder, publish, written

SCHEMA = "source string, target string, record_no long, record_id string, record_type string, target_uri string, offset long, length long, block_bytes long, block_crc long, status string"
_STEP = 1 << 20
_NOT_A_HEAD = 1 << 20


class Inflater:
    """Bytes of a gzip file of one or more members, a part at a time."""

    def __init__(self, stream):
        self.stream, self.held, self.z, self.broken, self.ended = stream, b"", zlib.decompressobj(31), False, False

    def _more(self) -> bool:
        data = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        data = data or self.stream.read(_STEP)
        if self.z.eof:
            if not data.strip(b"\0"):
                return False
            self.z = zlib.decompressobj(31)
        elif not data:
            self.broken = self.broken or self.ended
            return False
        self.ended = True
        try:
            self.held += self.z.decompress(data, _STEP)
        except zlib.error:
            self.broken = True
            return False
        self.ended = not self.z.eof
        return True

    def line_block(self) -> bytes | None:
        """All up to and with the next empty line, however far; None at the end, or where a megabyte is no record's head."""
        looked = 0
        while (at := self.held.find(b"\r\n\r\n", looked)) < 0:
            if len(self.held) >= _NOT_A_HEAD and not self.held.lstrip(b"\r\n").startswith(b"WARC/"):
                break
            looked = max(0, len(self.held) - 3)
            if not self._more():
                break
        if at < 0:
            return None
        out, self.held = self.held[: at + 4], self.held[at + 4 :]
        return out

    def parts(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in parts; fewer if the file ends."""
        while n:
            if not self.held and not self._more():
                return
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            if out:
                yield out


def headers(block: bytes) -> dict[str, str] | None:
    """Names in lower case; None if it is no record's head."""
    lines = block.decode("utf-8", "replace").strip("\r\n").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    found, last = {}, None
    for line in lines[1:]:
        if line[:1] in " \t" and last:
            found[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip().lower()
            found[last] = value.strip()
    return found


def record(kind: str, record_id: str, uri: str | None, body: bytes) -> bytes:
    """A record as bytes."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    head += ["WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def normalise_file(source: str, target: str, level: int = 6) -> list[dict]:
    """Rewrite one file; the index rows. Records are streamed: of a record only its head is held, and parts of its block.

    At a record that is cut short or has no usable head the file ends. What there is of a block that is cut short is a
    member too, whose row has the status "truncated" and counts its bytes; a head that is cut short has a row without an
    offset, and one without a usable length a row of status "malformed".
    """
    fs, path = filesystem(source)
    rows: list[dict] = []

    def write(out) -> None:
        with fs.open_input_stream(path, compression=None) as raw:
            stream, at = Inflater(raw), 0
            while True:
                block = stream.line_block()
                row = {"source": source, "target": target, "record_no": len(rows), "status": "ok"}
                if block is None:
                    if stream.held.strip(b"\r\n") or stream.broken:
                        rows.append(row | {"status": "truncated"})
                    return
                while block.startswith(b"\r\n"):
                    block = block[2:]
                if not block:
                    continue
                found = headers(block)
                if found is None or not found.get("content-length", "").isdecimal():
                    rows.append(row | {"status": "malformed"})
                    return
                z, n, crc, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0, 0
                size = int(found["content-length"])
                row |= {"record_id": found.get("warc-record-id", "").strip("<>") or None, "record_type": found.get("warc-type"), "target_uri": found.get("warc-target-uri")}
                length += out.write(z.compress(block))
                for part in stream.parts(size):
                    n += len(part)
                    crc = zlib.crc32(part, crc)
                    length += out.write(z.compress(part))
                length += out.write(z.compress(b"\r\n\r\n") + z.flush())
                rows.append(row | {"offset": at, "length": length, "block_bytes": n, "block_crc": crc, "status": "ok" if n == size else "truncated"})
                if n < size:
                    return
                at += length

    publish(target, write)
    lines = "".join(json.dumps({k: r.get(k) for k in ("record_no", "record_id", "target_uri", "offset", "length", "status")}, ensure_ascii=False) + "\n" for r in rows)
    publish(target + ".idx", lambda out: out.write(lines.encode()))
    return rows


def read_record(target: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record of one member."""
    fs, path = filesystem(target)
    with fs.open_input_file(path) as f:
        head, _, rest = zlib.decompress(f.read_at(length, offset), 31).partition(b"\r\n\r\n")
    found = headers(head)
    return found, rest[:-4][: int(found["content-length"])]


def write_monolithic(spark: SparkSession, pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 1) -> DataFrame:
    """One ``.warc.gz`` a partition, each a single gzip stream; gives ``source`` of every file. A null body is empty, a null address has no header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"

        def write(out) -> None:
            z, row = zlib.compressobj(level, zlib.DEFLATED, 31), 0
            for b in batches:
                for i, url, html in zip(*(b.column(c).to_pylist() for c in ("id", "url", "html"))):
                    name = f"urn:page:{i}" if i is not None else f"urn:row:{row}"
                    out.write(z.compress(record("response" if url is not None else "resource", name, url, (html or "").encode())))
                    row += 1
            out.write(z.flush())

        publish(uri, write)
        yield pa.RecordBatch.from_arrays([pa.array([uri])], names=["source"])

    columns = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return written(spark, columns.mapInArrow(run, "source string"), "archives")


def normalise(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Rewrite every file of ``files.source`` into ``folder``, a file a task; the index of all records.

    Names come from the source's name and a hash of its address, so a task that is run again replaces its own files.
    Files with a null address are left out, repeated addresses are done once, an empty file has no records.
    """
    todo = files.select(F.col("source").cast("string").alias("source")).where("source is not null").distinct()
    todo = todo.withColumn("target", F.concat(F.lit(folder + "/"), F.lower(F.hex(F.xxhash64("source"))), F.lit("-"), F.element_at(F.split("source", "/"), -1)))
    todo = todo.repartitionByRange(max(1, min(100_000, files.count())), "source")  # by the addresses' order, so that files don't fall on one task
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, target in zip(b.column("source").to_pylist(), b.column("target").to_pylist()):
                rows = normalise_file(source, target)
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=kinds)

    return todo.mapInArrow(run, SCHEMA)


def normalise_pages(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive all pages as monolithic files and normalise these: one row a page.

    Null bodies are empty records, null addresses have no target, addresses may be of any length, rows with a null id are named by their place; repeated
    rows are records of their own, and an empty table gives no row.
    """
    files = write_monolithic(spark, pages, new_folder(spark, "warc-in"), id_col, url_col, html_col)
    return normalise(spark, files, new_folder(spark, "warc-out"))
