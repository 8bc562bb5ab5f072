"""The library's functions for SQL: temporary functions of a session, Arrow functions and a table function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType
from pyspark.sql.types import StructType

from . import rabitq, text

SCALARS = {
    "ascii_words(t STRING) RETURNS ARRAY<STRING>": "regexp_extract_all(lower(t), '[a-z0-9]+', 0)",
    "analyze(t STRING, profile STRING) RETURNS ARRAY<STRING>": "CASE profile WHEN 'ascii' THEN regexp_extract_all(lower(t), '[a-z0-9]+', 0) WHEN 'unicode' THEN regexp_extract_all(lower(t), '[\\\\p{L}\\\\p{N}]+', 0)"
    " WHEN 'boundary' THEN transform(filter(flatten(sentences(t)), w -> w RLIKE '[\\\\p{IsAlphabetic}\\\\p{N}]'), w -> lower(w)) ELSE raise_error('no such profile') END",
    "bm25_idf(n BIGINT, total BIGINT) RETURNS DOUBLE": "ln((total - n + 0.5D) / (n + 0.5D))",
    "bm25(tf DOUBLE, dl DOUBLE, n BIGINT, total BIGINT, avdl DOUBLE) RETURNS DOUBLE": "ln((total - n + 0.5D) / (n + 0.5D)) * tf / (tf + 1.2D * (0.25D + 0.75D * dl / avdl))",
    "byte4(dl BIGINT) RETURNS BIGINT": "CASE WHEN dl < 24 THEN dl ELSE 24 + shiftleft(shiftright(dl - 24, greatest(length(bin(dl - 24)) - 4, 0)), greatest(length(bin(dl - 24)) - 4, 0)) END",
    "bm25_quantized(tf DOUBLE, dl BIGINT, n BIGINT, total BIGINT, avdl DOUBLE) RETURNS DOUBLE": "ln(1 + (total - n + 0.5D) / (n + 0.5D)) * tf / (tf + 1.2D * (0.25D + 0.75D * byte4(dl) / avdl))",
    "l2sq(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (t, v) -> t + v)",
    "neg_ip(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "-aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (t, v) -> t + v)",
    "without_stopwords(words ARRAY<STRING>) RETURNS ARRAY<STRING>": f"filter(words, w -> w NOT IN ({', '.join(map(repr, text.STOPWORDS))}))",
    "rrf(place BIGINT, k BIGINT) RETURNS DOUBLE": "1D / (k + place)",
}


def register(spark: SparkSession) -> None:
    """Make all functions known to SQL in this session: those of ``SCALARS``, which are inlined into plans, and

    - ``stemmed(words)``: an array of words by their stems, so that the English chain is ``stemmed(without_stopwords(analyze(t, 'boundary')))``;
    - ``rrf_score(place, k)``: an aggregate, the fused score of a row from its places in several rankings;
    - ``rabitq_encode(vec, centroid)``: one-bit code and factors (squared L2) as a struct, in Arrow batches;
    - ``rabitq_estimate(code, f_add, f_rescale, f_error, query, centroid)``: estimate, lower and upper bound;
    - ``greedy_search(vectors, edges, start, query, k, width)``: a table function, one row a result.
    """
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    def stack(s: pd.Series) -> np.ndarray:
        return np.stack(s.to_numpy()).astype(float)

    def encode(vec: pd.Series, centroid: pd.Series) -> pd.DataFrame:
        q = rabitq.quantize_one_bit(stack(vec), stack(centroid))
        return pd.DataFrame({"code": [c.tobytes() for c in q["code"]], "f_add": q["f_add"], "f_rescale": q["f_rescale"], "f_error": q["f_error"]})

    def estimate(code: pd.Series, f_add: pd.Series, f_rescale: pd.Series, f_error: pd.Series, query: pd.Series, centroid: pd.Series) -> pd.DataFrame:
        if not len(code):
            return pd.DataFrame({c: pd.Series(dtype=float) for c in ("estimate", "lower_bound", "upper_bound")})
        q, m = stack(query), stack(centroid)
        bits = np.unpackbits(np.stack([np.frombuffer(c, np.uint8) for c in code]), axis=1)[:, : q.shape[1]]
        apart = ((q - m) ** 2).sum(axis=1)
        value = f_add.to_numpy() + apart + f_rescale.to_numpy() * ((bits * q).sum(axis=1) - 0.5 * q.sum(axis=1))
        bound = f_error.to_numpy() * np.sqrt(apart)
        return pd.DataFrame({"estimate": value, "lower_bound": value - bound, "upper_bound": value + bound})

    def fused(place: pd.Series, k: pd.Series) -> float:
        return float((1.0 / (k + place)).sum())

    kind = StructType.fromDDL
    spark.udf.register("rrf_score", F.pandas_udf(fused, "double", functionType=PandasUDFType.GROUPED_AGG))
    spark.udf.register("stemmed", text.stemmed_words)
    spark.udf.register("rabitq_encode", F.pandas_udf(encode, kind("code binary, f_add double, f_rescale double, f_error double")))
    spark.udf.register("rabitq_estimate", F.pandas_udf(estimate, kind("estimate double, lower_bound double, upper_bound double")))

    class GreedySearch:
        def eval(self, vectors, edges, start, query, k, width):
            from quillmere.operators import graph

            x = np.array(vectors, float)
            q = np.array(query, float)
            found, _, _ = graph.greedy_search(x, edges, start, q, k, width)
            for place, node in enumerate(found, 1):
                yield place, node, float(((x[node] - q) ** 2).sum())

    spark.udtf.register("greedy_search", F.udtf(GreedySearch, returnType="place int, node int, dist double"))
