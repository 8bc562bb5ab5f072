"""Retention, sweep and compatibility, over literal tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checksum, scoring, sizes
from ..plans import lifecycle
from . import query, table

SNAPSHOTS = "(VALUES (1, 1000), (2, 2000), (3, 3000), (4, 4000), (5, 5000)) AS t(version, committed_at_millis)"
OBJECTS = "(VALUES ('seg/a', 100), ('seg/b', 900), ('seg/c', 400), ('snap/1', 100), ('snap/2', 950), ('dv/a', 500)) AS t(key, last_modified_millis)"
USED = "(VALUES ('seg/a'), ('snap/1')) AS u(key)"


@query("m7_retention", f"SELECT version, committed_at_millis FROM {SNAPSHOTS} WHERE version = 5 OR version > 5 - 2 OR 6000 - committed_at_millis <= 4000")
def _(spark, d):
    return lifecycle.retained(spark.sql(f"SELECT * FROM {SNAPSHOTS}"), 6000, keep_last=2, max_age_millis=4000)


@query("w8_recent_versions", f"SELECT version FROM {SNAPSHOTS} ORDER BY version DESC LIMIT 3")
def _(spark, d):
    return lifecycle.retained(spark.sql(f"SELECT * FROM {SNAPSHOTS}"), 0, keep_last=3).select("version")


@query("u4_age_or_current", f"SELECT version FROM {SNAPSHOTS} WHERE version = 5 OR 6000 - committed_at_millis <= 2000")
def _(spark, d):
    return lifecycle.retained(spark.sql(f"SELECT * FROM {SNAPSHOTS}"), 6000, max_age_millis=2000).select("version")


@query("m8_sweep", f"SELECT key, CASE WHEN key IN (SELECT key FROM {USED}) THEN 'referenced' WHEN 1000 - last_modified_millis <= 500 THEN 'within_window' ELSE 'orphan' END AS fate FROM {OBJECTS}")
def _(spark, d):
    return lifecycle.classified(spark.sql(f"SELECT * FROM {OBJECTS}"), spark.sql(f"SELECT * FROM {USED}"), 1000, 500)


BOOKS = "(VALUES (1, 64, 'l2', 1, 'fht', 'x'), (2, 64, 'l2', 1, 'fht', 'x'), (3, 128, 'ip', 1, 'fht', 'x'), (4, 64, 'ip', 4, 'fht', 'x'), (5, 64, 'l2', 1, 'fht', 'y')) AS t(id, dims, metric, bit_width, rotator, payload_hash)"


@query("m9_codebook", f"""SELECT a.id AS a, b.id AS b, CASE WHEN a.dims <> b.dims THEN 'dims' WHEN a.metric <> b.metric THEN 'metric' WHEN a.bit_width <> b.bit_width THEN 'bit_width'
 WHEN a.rotator <> b.rotator THEN 'rotator' WHEN a.payload_hash <> b.payload_hash THEN 'payload_hash' END AS mismatch FROM (SELECT * FROM {BOOKS}) a, (SELECT * FROM {BOOKS}) b""")
def _(spark, d):
    one = spark.sql(f"SELECT id, struct(dims, metric, bit_width, rotator, payload_hash) AS book FROM {BOOKS}")
    pairs = one.selectExpr("id AS a", "book AS x").crossJoin(one.selectExpr("id AS b", "book AS y"))
    return pairs.select("a", "b", lifecycle.mismatch("x", "y").alias("mismatch"))


@query("f19_cluster_count", "SELECT CAST(n AS BIGINT) AS n, CAST(greatest(1, round(4 * sqrt(n))) AS BIGINT) AS clusters, CAST(ceil(n / 64.0) * 64 AS BIGINT) AS padded, round(1.0 / (60 + n), 6) AS rrf FROM range(1, 2001) t(n)")
def _(spark, d):
    from ..functions import vector

    n = F.col("id")
    return spark.range(1, 2001).select(n.alias("n"), vector.cluster_count(n).alias("clusters"), vector.padded_dims(n).alias("padded"), F.round(scoring.rrf(n), 6).alias("rrf"))


@query("f21_sizes", """SELECT label, n, CAST(ceil(n / 32.0) * (64 * 4 + 384) + n * 40 AS BIGINT) AS code_bytes, CAST(n * (16 + 4 * 64 + 4 * 32) AS BIGINT) AS graph_bytes, CAST(ceil(n / 32.0) * 32 * 8 AS BIGINT) AS packed_bytes,
 CAST(64 * 4 + 384 AS BIGINT) AS batch_bytes, CAST(40 AS BIGINT) AS ex_bytes FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)""")
def _(spark, d):
    """What the vectors of each label take as 5-bit codes, as graph nodes of 32 edges, and as packed signs."""
    n, padded, ex = F.col("n"), F.lit(64), F.lit(4)
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")).select(
        "label", "n", sizes.code_bytes_length(n, padded, ex).alias("code_bytes"), (n * sizes.node_record_size(padded, F.lit(32))).alias("graph_bytes"), sizes.packed_code_len(n, F.lit(8)).alias("packed_bytes"),
        sizes.batch_data_len(padded).alias("batch_bytes"), sizes.ex_entry_len(padded, ex).alias("ex_bytes"),
    )


@query("f23_checksum")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", checksum.checksum(F.col("text").cast("binary")).alias("checksum"))
