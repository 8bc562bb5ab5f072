"""A versioned table: immutable segments, snapshots, deletions, safe concurrent commits.

Snapshot n is the file ``snapshots/v{n}.json``, and creating it where nothing is yet is the commit. A segment is a
Parquet folder whose rows have dense local ordinals; its snapshot entry holds the first row id, so a writer that loses
a race only takes a new range and writes no data again.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from . import lifecycle


class Conflict(Exception):
    """The object is there already, or isn't what it was."""


def tag(data: bytes | None) -> str | None:
    """What ``put_if_match`` knows an object's contents by; None for none."""
    return None if data is None else hashlib.sha256(data).hexdigest()


class Store:
    """Objects below a root. ``_create`` puts a whole object where nothing is, or raises ``Conflict``; ``_replace`` puts one where one is."""

    def put_if_absent(self, key: str, data: bytes) -> None:
        self._create(key, data)

    def put_if_match(self, key: str, data: bytes, expected: str | None) -> None:
        """Replace an object whose ``tag`` is ``expected`` (None: that isn't there), else ``Conflict``.

        Writers of one key take turns by a lock object; one who dies holding it leaves it to be removed by hand.
        """
        if expected is None:
            return self._create(key, data)
        lock = f"{key}.lock"
        self._create(lock, b"")
        try:
            if tag(self.get(key)) != expected:
                raise Conflict(key)
            self._replace(key, data)
        finally:
            self.delete(lock)


class LocalStore(Store):
    """Objects as files of a local or mounted folder; exclusive creation by the operating system."""

    def __init__(self, root: str):
        self.root = root

    def _path(self, key: str) -> str:
        return os.path.join(self.root, key)

    def get(self, key: str) -> bytes | None:
        try:
            with open(self._path(key), "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def _staged(self, key: str, data: bytes) -> tuple[str, str]:
        path = self._path(key)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(temporary, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        return temporary, path

    def _replace(self, key: str, data: bytes) -> None:
        os.replace(*self._staged(key, data))

    def _create(self, key: str, data: bytes) -> None:
        temporary, path = self._staged(key, data)
        try:
            os.link(temporary, path)  # whole or not at all, and only where nothing is
        except FileExistsError:
            raise Conflict(key) from None
        finally:
            os.unlink(temporary)

    def list(self, prefix: str) -> list[tuple[str, int]]:
        """Keys and times of change in milliseconds, in byte order; only the prefix's folder is walked."""
        found = []
        for folder, _, files in os.walk(os.path.join(self.root, prefix.rpartition("/")[0])):
            for f in files:
                path = os.path.join(folder, f)
                key = os.path.relpath(path, self.root)
                if key.startswith(prefix) and not f.endswith(".tmp"):
                    found.append((key, int(os.stat(path).st_mtime * 1000)))
        return sorted(found)

    def delete(self, key: str) -> None:
        try:
            os.unlink(self._path(key))
        except FileNotFoundError:
            pass


class HadoopStore(Store):
    """The same over a Hadoop file system whose rename is atomic, such as HDFS: an object is written aside and moved whole to where nothing may be.

    What the JVM raises comes as ``OSError``, so that a commit of unknown outcome is looked up.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.jvm.org.apache.hadoop.fs.Path(root).getFileSystem(conf)
        self.files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self.array = spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)

    def _path(self, key: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")

    def get(self, key: str) -> bytes | None:
        from py4j.protocol import Py4JJavaError

        try:
            stream = self.fs.open(self._path(key))
        except Py4JJavaError as e:
            if "FileNotFound" in e.java_exception.getClass().getName():
                return None
            raise OSError(str(e.java_exception)) from e
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _put(self, key: str, data: bytes, how) -> None:
        from py4j.protocol import Py4JJavaError

        aside = f"{key}.{uuid.uuid4().hex}.tmp"
        self.array[0] = how
        try:
            out = self.fs.create(self._path(aside), False)
            out.write(bytearray(data))
            out.close()
            self.files.rename(self._path(aside), self._path(key), self.array)
        except Py4JJavaError as e:
            self.fs.delete(self._path(aside), False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(key) from None
            raise OSError(str(e.java_exception)) from e

    def _create(self, key: str, data: bytes) -> None:
        self._put(key, data, self.jvm.org.apache.hadoop.fs.Options.Rename.NONE)

    def _replace(self, key: str, data: bytes) -> None:
        self._put(key, data, self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE)

    def list(self, prefix: str) -> list[tuple[str, int]]:
        base = self._path(prefix.rpartition("/")[0] or ".")
        if not self.fs.exists(base):
            return []
        files, found = self.fs.listFiles(base, True), []
        start = self.fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(self.root)).toString() + "/"
        while files.hasNext():
            f = files.next()
            key = f.getPath().toString().removeprefix(start)
            if key.startswith(prefix) and not key.endswith(".tmp"):
                found.append((key, f.getModificationTime()))
        return sorted(found)

    def delete(self, key: str) -> None:
        self.fs.delete(self._path(key), False)


@dataclass
class Segment:
    """``deletes`` is a folder of local ordinals; ``deleted`` and ``checksum`` are their number and an order-free hash of them."""

    path: str
    row_id_base: int
    row_id_count: int
    deletes: str | None = None
    deleted: int = 0
    checksum: int = 0


@dataclass
class Snapshot:
    version: int = 0
    next_row_id: int = 0
    committed_at_millis: int = 0
    segments: list[Segment] = field(default_factory=list)
    nonce: str = ""
    batches: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def parse(data: bytes) -> Snapshot:
        x = json.loads(data)
        return Snapshot(**x | {"segments": [Segment(**s) for s in x["segments"]]})


@dataclass
class Table:
    spark: SparkSession
    path: str
    store: LocalStore | HadoopStore
    clock: Callable[[], int] = lambda: int(time.time() * 1000)

    @staticmethod
    def local(spark: SparkSession, path: str) -> Table:
        return Table(spark, path, LocalStore(path))

    @staticmethod
    def open(spark: SparkSession, path: str) -> Table:
        """By the address: local files, or a Hadoop file system."""
        if path.startswith("file:") or "://" not in path:
            plain = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
            return Table.local(spark, plain)
        return Table(spark, path, HadoopStore(spark, path))

    def create(self, keep_last: int | None = None, max_age_millis: int | None = None) -> None:
        """Write the table's metadata, once; a policy needs a number or an age."""
        if keep_last is None and max_age_millis is None:
            raise ValueError("a retention policy needs a number or an age")
        self.store.put_if_absent("metadata.json", json.dumps({"keep_last": keep_last, "max_age_millis": max_age_millis}).encode())

    def metadata(self) -> dict:
        data = self.store.get("metadata.json")
        if data is None:
            raise FileNotFoundError("the table has no metadata")
        return json.loads(data)

    def _versions(self) -> list[int]:
        names = [k.rpartition("/")[2] for k, _ in self.store.list("snapshots/v")]
        return sorted(int(n[1:-5]) for n in names if n.endswith(".json") and n[1:-5].isdecimal())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The current or a given snapshot; version 0 is the empty table."""
        for _ in range(6):
            wanted = version if version is not None else max(self._versions(), default=0)
            if wanted == 0:
                return Snapshot()
            data = self.store.get(f"snapshots/v{wanted}.json")
            if data is not None:
                return Snapshot.parse(data)
            if version is not None:
                break
        raise FileNotFoundError(f"no snapshot {wanted}")

    def commit(self, change: Callable[[Snapshot], tuple[list[Segment], int]], attempts: int = 100, batch: tuple[str, int] | None = None) -> Snapshot:
        """Propose what ``change`` makes of the current snapshot (segments, next row id) until a proposal is first.

        ``batch`` names a source and its running number; the snapshot remembers it, and what it has is not added again.
        """
        for _ in range(attempts):
            now = self.snapshot()
            if batch and now.batches.get(batch[0], -1) >= batch[1]:
                return now
            segments, next_row_id = change(now)
            new = Snapshot(now.version + 1, next_row_id, self.clock(), segments, uuid.uuid4().hex, now.batches | ({batch[0]: batch[1]} if batch else {}))
            key = f"snapshots/v{new.version}.json"
            try:
                self.store.put_if_absent(key, json.dumps(asdict(new)).encode())
                return new
            except Conflict:
                continue
            except OSError:  # it may have been written all the same: look whose it is
                data = self.store.get(key)
                if data is not None and Snapshot.parse(data).nonce == new.nonce:
                    return new
                if data is None:
                    raise
        raise Conflict("too many lost races")

    def write_segment(self, rows: DataFrame) -> Segment:
        """Store rows once, under a new name. Dense ordinals are places inside a written partition plus the rows of those before, which ``starts`` beside the data holds."""
        name = f"segments/{uuid.uuid4().hex}"
        rows.withColumn("_place", F.monotonically_increasing_id()).write.parquet(f"{self.path}/{name}/data")
        kept = self.spark.read.parquet(f"{self.path}/{name}/data")
        sizes = {r.part: r.n for r in kept.groupBy(F.shiftright("_place", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
        before, total = [], 0
        for part in sorted(sizes):  # one row a written partition
            before.append((part, total))
            total += sizes[part]
        self.spark.createDataFrame(before, "_part long, _before long").coalesce(1).write.parquet(f"{self.path}/{name}/starts")
        return Segment(f"{name}/data", 0, total)

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> Snapshot:
        """Add rows as one segment."""
        segment = self.write_segment(rows)

        def change(now: Snapshot):
            placed = Segment(segment.path, now.next_row_id, segment.row_id_count)
            return [*now.segments, placed], now.next_row_id + segment.row_id_count

        return self.commit(change, batch=batch)

    def _deletes(self, segments: list[Segment]) -> DataFrame | None:
        """``segment`` (its place among them) and ``ordinal`` of all deleted rows, by one scan."""
        have = {s.deletes: k for k, s in enumerate(segments) if s.deletes}
        if not have:
            return None
        rows = self.spark.read.parquet(*[f"{self.path}/{p}" for p in have])
        places = self.spark.createDataFrame(list(have.items()), "at string, segment int")
        return rows.select("ordinal", F.regexp_extract(F.col("_metadata.file_path"), r"(deletes/[0-9a-f]+/segment=\d+)/[^/]*$", 1).alias("at")).join(places, "at").select("segment", "ordinal")

    def delete(self, row_ids: DataFrame) -> Snapshot:
        """Mark rows (``row_id``) as deleted: each segment's new list holds its old one too. An id of no segment is an error.

        One job for all segments, and one folder with a part for each that changes.
        """
        given = written(self.spark, row_ids.select(F.col("row_id").cast("long").alias("row_id")).where("row_id is not null"), "row-ids")

        def change(now: Snapshot):
            bases = np.array([s.row_id_base for s in now.segments] or [0], np.int64)
            ends = bases + np.array([s.row_id_count for s in now.segments] or [0], np.int64)
            order = np.argsort(bases, kind="stable")

            def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    ids = b.column("row_id").to_numpy()
                    k = order[np.maximum(np.searchsorted(bases[order], ids, side="right") - 1, 0)]
                    inside = (ids >= bases[k]) & (ids < ends[k])
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(inside, k, -1).astype(np.int32)), pc.subtract(b.column("row_id"), pa.array(bases[k]))], names=["segment", "ordinal"])

            new = given.mapInArrow(place, "segment int, ordinal long")
            touched = {r.segment for r in new.select("segment").distinct().collect()}  # at most a row a segment
            if -1 in touched:
                raise ValueError("a row id is in no segment of the table")
            old = self._deletes([s if k in touched else replace(s, deletes=None) for k, s in enumerate(now.segments)])
            name = f"deletes/{uuid.uuid4().hex}"
            rows = (new if old is None else new.unionByName(old)).distinct()
            rows.write.partitionBy("segment").parquet(f"{self.path}/{name}")
            sums = {}
            if touched:
                stored = self.spark.read.parquet(f"{self.path}/{name}")
                sums = {r.segment: (r.n, r.h) for r in stored.groupBy("segment").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("ordinal")).alias("h")).collect()}
            out = [Segment(s.path, s.row_id_base, s.row_id_count, f"{name}/segment={k}", *sums[k]) if k in touched else s for k, s in enumerate(now.segments)]
            return out, now.next_row_id

        return self.commit(change)

    def verify(self, version: int | None = None) -> None:
        """Raise if some segment's deleted rows aren't those that were committed: another number or another hash."""
        segments = self.snapshot(version).segments
        rows = self._deletes(segments)
        found = {} if rows is None else {r.segment: (r.n, r.h) for r in rows.groupBy("segment").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("ordinal")).alias("h")).collect()}
        for k, s in enumerate(segments):
            if s.deletes and found.get(k) != (s.deleted, s.checksum):
                raise ValueError(f"the deletions of {s.path} don't match their checksum")

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows that aren't deleted, with ``row_id`` and ``segment_path``; None for a table without segments.

        One scan of all segments and at most one of their deletions, however many commits made them.
        """
        segments = self.snapshot(version).segments
        if not segments:
            return None
        places = self.spark.createDataFrame([(k, s.path, s.row_id_base) for k, s in enumerate(segments)], "_segment int, segment_path string, _base long")
        rows = self.spark.read.parquet(*[f"{self.path}/{s.path}" for s in segments])
        columns = [c for c in rows.columns if c != "_place"]
        named = lambda df, kind: df.withColumn("segment_path", F.concat(F.regexp_extract(F.col("_metadata.file_path"), rf"(segments/[0-9a-f]+/){kind}/[^/]*$", 1), F.lit("data")))
        starts = named(self.spark.read.parquet(*[f"{self.path}/{s.path.removesuffix('data')}starts" for s in segments]), "starts").join(places, "segment_path")
        rows = named(rows, "data").withColumn("_part", F.shiftright("_place", 33)).join(starts, ["segment_path", "_part"])
        rows = rows.withColumn("_ordinal", F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1))
        gone = self._deletes(segments)
        if gone is not None:
            rows = rows.join(gone.select(F.col("segment").alias("_segment"), F.col("ordinal").alias("_ordinal")), ["_segment", "_ordinal"], "left_anti")
        return rows.withColumn("row_id", F.col("_ordinal") + F.col("_base")).select(*columns, "row_id", "segment_path")

    def compact(self) -> Snapshot:
        """Rewrite the rows that are left as one segment with new row ids. If another commit comes between, it is done again."""
        while True:
            now = self.snapshot()
            rows = self.read(now.version)
            if rows is None:
                return now
            segment = self.write_segment(rows.drop("row_id", "segment_path"))

            def change(current: Snapshot):
                if current.version != now.version:
                    raise Conflict("changed meanwhile")
                return [Segment(segment.path, current.next_row_id, segment.row_id_count)], current.next_row_id + segment.row_id_count

            try:
                return self.commit(change, attempts=1)
            except Conflict:
                continue

    def inspect(self, version: int | None = None) -> DataFrame:
        """One row a segment of the current snapshot, or a given one."""
        rows = [(s.path, s.row_id_base, s.row_id_count, s.deletes, s.deleted) for s in self.snapshot(version).segments]
        return self.spark.createDataFrame(rows, "path string, row_id_base long, row_id_count long, deletes string, deleted long")

    def fates(self, window_millis: int = lifecycle.THREE_DAYS) -> DataFrame:
        """``key``, ``fate`` of every object below the table: referenced by a retained snapshot, within the window, or orphan.

        Objects are listed by the engine's file source; no contents are read and no list is held by the driver.
        """
        policy, now = self.metadata(), self.clock()
        all_of = [self.snapshot(v) for v in self._versions()]
        if not all_of:
            return self.spark.createDataFrame([], "key string, fate string")
        heads = self.spark.createDataFrame([(s.version, s.committed_at_millis) for s in all_of], "version long, committed_at_millis long")
        kept = {r.version for r in lifecycle.retained(heads, now, policy["keep_last"], policy["max_age_millis"]).collect()}
        folders = {p for s in all_of if s.version in kept for seg in s.segments for p in (seg.path, f"{seg.path.removesuffix('data')}starts", seg.deletes) if p}
        names = {f"snapshots/v{v}.json" for v in kept} | {"metadata.json"}
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.path)
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        root = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
        objects = files.select(F.substring_index("path", f"{root}/", -1).alias("key"), F.unix_millis("modificationTime").alias("last_modified_millis")).where("key not like '%.tmp'")
        parts = self.spark.createDataFrame([(p,) for p in sorted(folders | names)], "at string")
        used = objects.withColumn("at", F.explode(F.array("key", F.regexp_extract("key", "^(.*)/[^/]*$", 1)))).join(parts, "at", "left_semi").select("key")
        return lifecycle.classified(objects, used, now, window_millis)

    def sweep(self, dry_run: bool = True, window_millis: int = lifecycle.THREE_DAYS) -> DataFrame:
        """``key``, ``fate`` as ``fates`` gives them; without ``dry_run`` orphans are deleted, one after the other as they come from the table."""
        fates = written(self.spark, self.fates(window_millis), "fates")
        if not dry_run:
            for r in fates.where("fate = 'orphan'").toLocalIterator():
                self.store.delete(r.key)
        return fates
