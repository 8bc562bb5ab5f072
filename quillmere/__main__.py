"""``python -m quillmere inspect TABLE | import-ciff FILE INDEX FIELD | export-puffin TABLE SEGMENT OUT | sweep TABLE [--delete]``"""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillmere", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("inspect", help="segments of the current snapshot").add_argument("table")
    p = commands.add_parser("import-ciff", help="store an interchange file as a field of an index")
    for n in ("file", "index", "field"):
        p.add_argument(n)
    p = commands.add_parser("export-puffin", help="write a segment's deletions as a Puffin file")
    for n in ("table", "segment", "out"):
        p.add_argument(n)
    p = commands.add_parser("sweep", help="list, or delete, objects that no retained snapshot needs")
    p.add_argument("table")
    p.add_argument("--delete", action="store_true")
    p.add_argument("--window-millis", type=int)
    a = parser.parse_args(args)

    from pyspark.sql import SparkSession

    from .operators.index import Index
    from .plans import lifecycle
    from .plans.table import Table
    from .sources import ciff, puffin

    spark = SparkSession.builder.getOrCreate()
    if a.command == "inspect":
        Table.open(spark, a.table).inspect().show(1000, truncate=False)
    elif a.command == "import-ciff":
        post, lengths = ciff.read_index(spark, a.file)
        Index(spark, a.index).add_postings(post, lengths, a.field)
    elif a.command == "export-puffin":
        t = Table.open(spark, a.table)
        segment = next((s for s in t.snapshot().segments if s.path == a.segment), None)
        if segment is None:
            parser.error(f"no segment {a.segment}")
        gone = [r.ordinal for r in spark.read.parquet(f"{t.path}/{segment.deletes}").toLocalIterator()] if segment.deletes else None
        with open(a.out, "wb") as f:
            f.write(puffin.write(gone, segment.path))
    else:
        fates = Table.open(spark, a.table).sweep(not a.delete, a.window_millis if a.window_millis is not None else lifecycle.THREE_DAYS)
        fates.groupBy("fate").count().show()
        for r in fates.where("fate = 'orphan'").orderBy("key").toLocalIterator():
            print(" ", r.key)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
