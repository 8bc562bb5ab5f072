"""Queries written in SQL with the library's functions, and table lifecycle end to end."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import sql
from ..operators import graph
from ..plans.table import Table
from ..sources import puffin
from ..storage import new_folder
from . import lexical, query, table
from .vectors import BASE, l2


@query("x2_sql_bm25", lexical._bm25_sql("p.term = 'is'") + " SELECT row_id, round(score, 6) AS score FROM scored")
def _(spark, d):
    sql.register(spark)
    lexical.post(spark, d).createOrReplaceTempView("qm_postings")
    lexical.lengths(spark, d).createOrReplaceTempView("qm_lengths")
    return spark.sql("""
        WITH st AS (SELECT count(*) AS total, avg(dl) AS avdl FROM qm_lengths),
             hits AS (SELECT row_id, tf, dl FROM qm_postings JOIN qm_lengths USING (row_id) WHERE term = 'is'),
             n AS (SELECT count(*) AS n FROM hits)
        SELECT row_id, round(bm25(tf, dl, n, total, avdl), 6) AS score FROM hits CROSS JOIN st CROSS JOIN n""")


@query("x3_sql_distance", BASE + f" SELECT row_id, round({l2('vec', 'qv')}, 6) AS dist FROM v, q ORDER BY {l2('vec', 'qv')}, row_id LIMIT 5")
def _(spark, d):
    sql.register(spark)
    table(spark, d, "embeddings").createOrReplaceTempView("qm_embeddings")
    return spark.sql("""
        WITH q AS (SELECT embedding AS qv FROM qm_embeddings WHERE vec_id = 0),
             d AS (SELECT vec_id AS row_id, l2sq(cast(embedding AS ARRAY<DOUBLE>), cast(qv AS ARRAY<DOUBLE>)) AS dist FROM qm_embeddings CROSS JOIN q)
        SELECT row_id, round(dist, 6) AS dist FROM d ORDER BY d.dist, row_id LIMIT 5""")


@query("s1_sql_view", lexical.POST + " SELECT row_id, tf AS term_freq FROM post WHERE term = 'park' OR term = 'ing' ORDER BY row_id")
def _(spark, d):
    lexical.post(spark, d).select("row_id", "term", F.col("tf").alias("term_freq")).createOrReplaceTempView("qm_body")
    return spark.sql("SELECT row_id, term_freq FROM qm_body WHERE term IN ('park', 'ing') ORDER BY row_id")


@query("p1_projection", "SELECT vec_id, label FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label")


def quarters(spark, d) -> Table:
    """A table of the documents' ids in four segments, in their order."""
    t = Table.open(spark, new_folder(spark, "table"))
    t.create(keep_last=1)
    docs = table(spark, d, "documents").select("doc_id")
    step = -(-docs.count() // 4)
    for k in range(4):
        t.append(docs.where(F.col("doc_id").between(k * step, k * step + step - 1)).repartitionByRange(2, "doc_id").sortWithinPartitions("doc_id"))
    return t


@query("s13_inspect", "WITH s AS (SELECT CAST(ceil(count(*) / 4.0) AS BIGINT) AS step FROM documents) SELECT min(doc_id) AS row_id_base, count(*) AS row_id_count, CAST(count(*) FILTER (doc_id % 7 = 0) AS BIGINT) AS deleted FROM documents, s GROUP BY doc_id // step")
def _(spark, d):
    """What a table's snapshot says of its segments after a deletion."""
    t = quarters(spark, d)
    t.delete(table(spark, d, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("row_id")))
    return t.inspect().select("row_id_base", "row_id_count", "deleted")


@query("m10_compact", """WITH n AS (SELECT count(*) AS n FROM documents), k AS (SELECT count(*) AS k, sum(doc_id) AS ids FROM documents WHERE doc_id % 7 <> 0)
SELECT k AS n_rows, CAST(ids AS BIGINT) AS ids, n AS lowest, n + k - 1 AS highest, k AS row_ids FROM n, k""")
def _(spark, d):
    """Segments with deletions rebuilt as one, under new row ids."""
    t = quarters(spark, d)
    t.delete(table(spark, d, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("row_id")))
    t.compact()
    return t.read().agg(F.count("*").alias("n_rows"), F.sum("doc_id").alias("ids"), F.min("row_id").alias("lowest"), F.max("row_id").alias("highest"), F.count_distinct("row_id").alias("row_ids"))


@query("s10_list_objects")
def _(spark, d):
    """Files below the folder, with their times: no contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(d)
    return files.select("path", (F.unix_millis("modificationTime")).alias("last_modified_millis"), "length")


@query("p12_graph_deleted")
def _(spark, d):
    """Walks go through deleted nodes; only the result leaves them out."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    shards = graph.shard_count(rows.count())
    nodes = graph.build_shards(rows.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards))))
    asked = rows.where("row_id % 50 = 0").withColumnRenamed("row_id", "query_id")
    gone = rows.where("row_id % 7 = 0").select("row_id")
    return graph.search_shards(nodes, asked, 10, 40, deletes=gone, shards=shards)


@query("x4_sql_rabitq")
def _(spark, d):
    """Codes and estimates by SQL functions: each vector against the first one, around the mean of both."""
    sql.register(spark)
    table(spark, d, "embeddings").createOrReplaceTempView("qm_embeddings")
    return spark.sql("""
        WITH q AS (SELECT cast(embedding AS ARRAY<DOUBLE>) AS qv FROM qm_embeddings WHERE vec_id = 0),
             v AS (SELECT vec_id, cast(embedding AS ARRAY<DOUBLE>) AS vec, qv, transform(qv, x -> 0D) AS centre FROM qm_embeddings CROSS JOIN q),
             c AS (SELECT vec_id, vec, qv, centre, rabitq_encode(vec, centre) AS code FROM v),
             e AS (SELECT vec_id, l2sq(vec, qv) AS dist, rabitq_estimate(code.code, code.f_add, code.f_rescale, code.f_error, qv, centre) AS e FROM c)
        SELECT vec_id, round(dist, 6) AS dist, e.estimate, e.lower_bound, e.upper_bound FROM e""")


@query("x5_sql_greedy")
def _(spark, d):
    """A walk as a table function, over the graph that joins each of the first hundred vectors to the next ten."""
    sql.register(spark)
    table(spark, d, "embeddings").where("vec_id < 100").createOrReplaceTempView("qm_hundred")
    return spark.sql("""
        SELECT found.* FROM (SELECT transform(array_sort(collect_list(struct(vec_id, embedding))), s -> cast(s.embedding AS ARRAY<DOUBLE>)) AS vectors FROM qm_hundred) g,
          LATERAL greedy_search(g.vectors, transform(sequence(0, 99), i -> transform(sequence(1, 10), k -> (i + k) % 100)), 0, g.vectors[42], 5, 30) found""")


@query("k15_puffin", "SELECT doc_id AS ordinal FROM documents WHERE doc_id % 7 = 0")
def _(spark, d):
    """A segment's deletions, exported as a Puffin file and read back."""
    gone = np.array([r.doc_id for r in table(spark, d, "documents").where("doc_id % 7 = 0").select("doc_id").toLocalIterator()])
    footer, blobs = puffin.read(puffin.write(gone, "segment"))
    return spark.createDataFrame(pd.DataFrame({"ordinal": puffin.unroaring(blobs[0][4 + 16 : -4])}))


@query("m3_time_travel", "SELECT 1 AS version, count(*) FILTER (doc_id < n // 2) AS n_rows FROM documents, (SELECT count(*) AS n FROM documents) GROUP BY 1 UNION ALL SELECT 2, count(*) FROM documents UNION ALL SELECT 3, count(*) FILTER (doc_id % 7 <> 0) FROM documents")
def _(spark, d):
    """Each version of a table as it was."""
    t = committed(spark, d)
    parts = [t.read(v).agg(F.lit(v).alias("version"), F.count("*").alias("n_rows")) for v in (1, 2, 3)]
    return parts[0].union(parts[1]).union(parts[2])


@query("m1_commits", "SELECT doc_id AS row_id FROM documents WHERE doc_id % 7 <> 0")
def _(spark, d):
    """Two appends, a deletion and a read of a table in the session's shared folder."""
    return committed(spark, d).read().select("row_id")


def committed(spark, d) -> Table:
    t = Table.open(spark, new_folder(spark, "table"))
    t.create(keep_last=1)
    docs = table(spark, d, "documents").select("doc_id")
    half = docs.count() // 2
    for part in (docs.where(F.col("doc_id") < half), docs.where(F.col("doc_id") >= half)):
        t.append(part.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id"))
    t.delete(docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("row_id")))
    return t
