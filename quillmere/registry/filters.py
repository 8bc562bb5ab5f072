"""Filter fields, deletions and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters
from . import query, table


def docs(spark, d):
    return table(spark, d, "documents")


def deletes(spark, d):
    """Synthetic tombstones: every seventh row and the toxic ones."""
    seventh = docs(spark, d).where("doc_id % 7 = 0").select(F.col("doc_id").alias("row_id"))
    return seventh.union(table(spark, d, "labels").where("toxic = 1").select("doc_id")).distinct()


DELETES = "WITH deletes AS (SELECT doc_id AS row_id FROM documents WHERE doc_id % 7 = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1)"


@query("p8_value", "SELECT doc_id FROM documents WHERE source = 'src3'")
def _(spark, d):
    maps = filters.bitmaps(docs(spark, d), "source", "doc_id")
    return filters.members(maps.where("value = 'src3'")).select(F.col("row_id").alias("doc_id"))


@query("k7_filter_bitmaps", "SELECT source AS value, count(DISTINCT doc_id) AS n FROM documents GROUP BY source")
def _(spark, d):
    return filters.cardinality(filters.bitmaps(docs(spark, d), "source", "doc_id"))


@query("p9_and_or", """SELECT 'and' AS how, count(*) AS n FROM documents WHERE lang = 'fr' AND source = 'src3'
UNION ALL SELECT 'or', count(*) FROM documents WHERE lang = 'fr' OR source = 'src3'""")
def _(spark, d):
    both = docs(spark, d).select("doc_id", F.explode(F.array(F.concat(F.lit("l:"), "lang"), F.concat(F.lit("s:"), "source"))).alias("field"))
    maps = filters.bitmaps(both, "field", "doc_id")
    parts = [filters.combined(maps, ["l:fr", "s:src3"], how).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n")).select(F.lit(how).alias("how"), "n") for how in ("and", "or")]
    return parts[0].union(parts[1])


@query("p10_tombstone", DELETES + " SELECT doc_id, doc_id IN (SELECT row_id FROM deletes) AS deleted FROM documents")
def _(spark, d):
    gone = deletes(spark, d).select(F.col("row_id").alias("doc_id"), F.lit(True).alias("gone"))
    return docs(spark, d).select("doc_id").join(gone, "doc_id", "left").select("doc_id", F.coalesce("gone", F.lit(False)).alias("deleted"))


@query("p11_anti", DELETES + " SELECT doc_id AS row_id, source FROM documents WHERE doc_id NOT IN (SELECT row_id FROM deletes)")
def _(spark, d):
    return filters.without_deleted(docs(spark, d).select(F.col("doc_id").alias("row_id"), "source"), deletes(spark, d))


@query("k14_deletion_vector", DELETES + " SELECT row_id // 250 AS segment_id, count(*) AS n_deleted FROM deletes GROUP BY 1")
def _(spark, d):
    return deletes(spark, d).groupBy(F.expr("row_id div 250").alias("segment_id")).agg(F.count("*").alias("n_deleted"))


@query("u1_sets", """SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels WHERE quality = 1)""")
def _(spark, d):
    a = docs(spark, d).where("lang = 'en'").select("doc_id")
    b = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return a.intersect(b).agg(F.count("*").alias("n")).select(F.lit("both").alias("kind"), "n").union(a.union(b).distinct().agg(F.count("*").alias("n")).select(F.lit("either"), "n"))


@query("u2_tombstone_union", DELETES + " SELECT row_id FROM deletes")
def _(spark, d):
    return deletes(spark, d)


@query("u3_minus", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, d):
    return docs(spark, d).select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("u5_concat", "SELECT doc_id AS row_id, 0 AS part FROM documents UNION ALL SELECT conv_id * 1000 + turn + 1000000000, 1 FROM conversations")
def _(spark, d):
    a = docs(spark, d).select(F.col("doc_id").alias("row_id"), F.lit(0).alias("part"))
    b = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1_000_000_000).cast("long").alias("row_id"), F.lit(1).alias("part"))
    return a.unionByName(b)


@query("u6_survivors", DELETES + " SELECT doc_id AS row_id, row_number() OVER (ORDER BY doc_id) - 1 AS new_id FROM documents WHERE doc_id NOT IN (SELECT row_id FROM deletes)")
def _(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("row_id"), F.expr("doc_id div 250").alias("segment_id"))
    return filters.survivors(rows, deletes(spark, d)).select("row_id", "new_id")
