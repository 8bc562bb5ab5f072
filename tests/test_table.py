import os
import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.operators import filters
from quillmere.plans import lifecycle
from quillmere.plans.table import Conflict, HadoopStore, LocalStore, Segment, Table, tag
from quillmere.sources import ciff, puffin
from quillmere.streaming.ingest import ingest, windowed_counts


def test_append_delete_read_and_compact(spark, tmp_path):
    t = Table.local(spark, str(tmp_path))
    t.create(keep_last=1)
    with pytest.raises(Conflict):
        t.create(keep_last=1)
    assert t.read() is None
    t.append(spark.range(0, 100, numPartitions=3).withColumn("x", F.col("id") * 2))
    t.append(spark.range(100, 150).withColumn("x", F.col("id") * 2))
    assert sorted(r.row_id for r in t.read().collect()) == list(range(150))
    t.delete(spark.createDataFrame([(2,), (5,), (120,)], "row_id long"))
    t.delete(spark.createDataFrame([(5,), (6,)], "row_id long"))
    assert set(range(150)) - {r.row_id for r in t.read().collect()} == {2, 5, 6, 120}
    assert t.read(2).count() == 150
    new = t.compact()
    assert [(s.row_id_base, s.row_id_count) for s in new.segments] == [(150, 146)] and t.read().count() == 146
    orphans = lambda **k: [r.key for r in t.sweep(**k).where("fate = 'orphan'").collect()]
    old = orphans(window_millis=-1)
    assert any(k.startswith("deletes/") for k in old) and "metadata.json" not in old and f"snapshots/v{new.version}.json" not in old
    assert orphans() == [] and {r.fate for r in t.sweep().collect()} == {"referenced", "within_window"}
    t.sweep(dry_run=False, window_millis=-1)
    assert orphans(window_millis=-1) == []
    assert t.read().count() == 146 and t.inspect().count() == 1


def test_deletes_are_checked(spark, tmp_path):
    t = Table.local(spark, str(tmp_path))
    t.append(spark.range(10))
    t.append(spark.range(10, 30))
    t.delete(spark.createDataFrame([(3,), (15,), (15,), (None,)], "row_id long"))
    with pytest.raises(ValueError, match="no segment"):
        t.delete(spark.createDataFrame([(1,), (30,)], "row_id long"))
    with pytest.raises(ValueError, match="no segment"):
        t.delete(spark.createDataFrame([(-1,)], "row_id long"))
    t.delete(spark.createDataFrame([(16,)], "row_id long"))
    t.verify()
    assert [(r.row_id_base, r.deleted) for r in t.inspect().orderBy("row_id_base").collect()] == [(0, 1), (10, 2)]
    assert sorted(r.row_id for r in t.read().collect()) == [i for i in range(30) if i not in (3, 15, 16)]
    assert t.read()._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 3
    s = t.snapshot()
    t.commit(lambda now: ([Segment(x.path, x.row_id_base, x.row_id_count, x.deletes, x.deleted, x.checksum ^ 1) for x in s.segments], s.next_row_id))
    with pytest.raises(ValueError, match="checksum"):
        t.verify()


@pytest.mark.parametrize("kind", ["local", "hadoop"])
def test_put_if_match(spark, tmp_path, kind):
    store = LocalStore(str(tmp_path)) if kind == "local" else HadoopStore(spark, f"file://{tmp_path}")
    store.put_if_match("a/x", b"1", None)
    with pytest.raises(Conflict):
        store.put_if_match("a/x", b"2", None)
    store.put_if_match("a/x", b"2", tag(b"1"))
    with pytest.raises(Conflict):
        store.put_if_match("a/x", b"3", tag(b"1"))
    assert store.get("a/x") == b"2" and store.get("a/x.lock") is None


def test_racing_writers_get_disjoint_ranges(spark, tmp_path):
    t = Table.local(spark, str(tmp_path))

    def work(k):
        for _ in range(5):
            t.commit(lambda now: ([*now.segments, Segment(f"s{k}", now.next_row_id, 10)], now.next_row_id + 10))

    threads = [threading.Thread(target=work, args=(k,)) for k in range(8)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    s = t.snapshot()
    assert s.version == 40 and s.next_row_id == 400
    assert [x.row_id_base for x in s.segments] == list(range(0, 400, 10))


def test_a_write_whose_answer_was_lost_counts_once(spark, tmp_path):
    class Flaky(LocalStore):
        lost = 1

        def put_if_absent(self, key, data):
            super().put_if_absent(key, data)
            if self.lost:
                self.lost -= 1
                raise OSError("no answer")

    t = Table(spark, str(tmp_path), Flaky(str(tmp_path)))
    assert t.commit(lambda now: ([Segment("a", 0, 1)], 1)).version == 1 and t.snapshot().version == 1


def test_hadoop_store(spark, tmp_path):
    s = HadoopStore(spark, f"file://{tmp_path}")
    assert s.get("a/b") is None
    s.put_if_absent("a/b", b"1")
    with pytest.raises(Conflict):
        s.put_if_absent("a/b", b"2")
    assert s.get("a/b") == b"1" and [k for k, _ in s.list("a/") if not k.endswith(".crc")] == ["a/b"]
    s.delete("a/b")
    assert s.get("a/b") is None


def test_retention_bounds_are_inclusive(spark):
    rows = spark.createDataFrame([(v, v * 1000) for v in range(1, 6)], "version long, committed_at_millis long")
    keep = lambda **k: sorted(r.version for r in lifecycle.retained(rows, 6000, **k).collect())
    assert keep(keep_last=2) == [4, 5] and keep(max_age_millis=3000) == [3, 4, 5] and keep(max_age_millis=0) == [5] and keep(keep_last=9) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        lifecycle.retained(rows, 0)


def test_bitmaps(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["blue", "red", "red", "blue", "blue", "red"])] + [(40_000, "blue"), (32_768, "red")], "row_id long, color string")
    maps = filters.bitmaps(df, "color", "row_id")
    got = {}
    for r in filters.members(maps).collect():
        got.setdefault(r.value, set()).add(r.row_id)
    assert got == {"blue": {0, 3, 4, 40_000}, "red": {1, 2, 5, 32_768}}
    assert {r.value: r.n for r in filters.cardinality(maps).collect()} == {"blue": 4, "red": 4}


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _message(*fields):
    out = b""
    for k, v in fields:
        if isinstance(v, int):
            out += _varint(k << 3) + _varint(v)
        elif isinstance(v, float):
            out += _varint(k << 3 | 1) + struct.pack("<d", v)
        else:
            out += _varint(k << 3 | 2) + _varint(len(v)) + v
    return out


def _ciff(path, lists, lengths, **change):
    head = {1: 1, 2: len(lists), 3: len(lengths), 4: len(lists), 5: len(lengths), 6: sum(lengths), 7: 1.0, 8: b"toy"} | change.get("head", {})
    parts = [_message(*head.items())]
    for term, posts in lists.items():
        gaps = [(d - (posts[i - 1][0] if i else 0), tf) for i, (d, tf) in enumerate(posts)]
        parts.append(_message((1, term.encode()), (2, len(posts)), (3, sum(tf for _, tf in posts)), *[(4, _message((1, g), (2, tf))) for g, tf in gaps]))
    parts += [_message((1, i), (2, b"doc"), (3, n)) for i, n in enumerate(lengths)]
    path.write_bytes(b"".join(_varint(len(p)) + p for p in parts)[: change.get("cut")])
    return str(path)


LISTS = {"01": [(0, 1)], "03": [(0, 1)], "30": [(0, 1)], "content": [(0, 1)], "enough": [(2, 1)], "head": [(0, 1), (1, 1), (2, 1)], "simpl": [(1, 1), (2, 1)], "text": [(0, 1), (1, 1), (2, 3)], "veri": [(1, 1)]}


def test_ciff(spark, tmp_path):
    post, lengths = ciff.read_index(spark, _ciff(tmp_path / "a", LISTS, [6, 4, 6]))
    got = {}
    for r in post.orderBy("row_id").collect():
        got.setdefault(r.term, []).append((r.row_id, r.tf))
    assert got == LISTS and [tuple(r) for r in lengths.orderBy("row_id").collect()] == [(0, 6), (1, 4), (2, 6)]


@pytest.mark.parametrize("change", [{"head": {5: 4}}, {"head": {6: 17}}, {"cut": -3}, {"head": {2: 12, 4: 12}}, {"head": {3: 2, 5: 2}}])
def test_broken_ciff(spark, tmp_path, change):
    path = _ciff(tmp_path / "b", LISTS, [6, 4, 6], **change)
    with pytest.raises(Exception, match="(?i)ciff|documents|header|cut|add up|lists"):
        ciff.read_index(spark, path)[0].collect()


def test_puffin_round_trip():
    many = np.concatenate([np.arange(0, 20_000, 2), [70_000, 4_000_000_000]])
    for ordinals in ([2, 5, 100], [], many):
        footer, blobs = puffin.read(puffin.write(ordinals, "seg", [(b"xyz", {"kind": "postings"})]))
        assert puffin.unroaring(blobs[0][4 + 16 : -4]).tolist() == sorted(set(map(int, ordinals)))
        assert footer["blobs"][0]["properties"]["cardinality"] == str(len(ordinals)) and blobs[1] == b"xyz"
    data = bytearray(puffin.write([1], "s"))
    data[24] ^= 1
    with pytest.raises(ValueError):
        puffin.read(bytes(data))


def test_stream_batches_are_commits(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(10).write.json(str(source))
    t = Table.local(spark, str(tmp_path / "t"))
    for _ in range(2):
        ingest(spark.readStream.schema("id long").json(str(source)), t, str(tmp_path / "c")).awaitTermination()
    assert t.read().count() == 10 and t.snapshot().version == 1
    again = t.append(spark.range(5), ("stream", 0))
    assert again.version == 1 and t.read().count() == 10


def test_windowed_counts(spark):
    rows = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2024-01-01 00:10:00', 'a'), (timestamp_ntz'2024-01-01 00:50:00', 'a'), (timestamp_ntz'2024-01-01 01:10:00', 'a') AS t(ts, event_type)")
    assert sorted(r.n for r in windowed_counts(rows).collect()) == [1, 2]


def test_command_line(spark, tmp_path, capsys):
    from quillmere.__main__ import main
    from quillmere.operators.index import Index

    t = Table.local(spark, str(tmp_path / "t"))
    t.create(keep_last=1)
    s = t.append(spark.range(4))
    t.delete(spark.createDataFrame([(1,)], "row_id long"))
    assert main(["inspect", t.path]) == 0 and main(["sweep", t.path]) == 0
    assert main(["export-puffin", t.path, s.segments[0].path, str(tmp_path / "p")]) == 0
    assert main(["import-ciff", _ciff(tmp_path / "a", LISTS, [6, 4, 6]), str(tmp_path / "ix"), "body"]) == 0
    assert Index(spark, str(tmp_path / "ix")).postings("body").count() == sum(map(len, LISTS.values()))
    assert os.path.getsize(tmp_path / "p") > 0 and "segments/" in capsys.readouterr().out
