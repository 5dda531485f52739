"""Vector queries (survey V1-V5, A14). Queries and seeds are the vectors whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as V
from ..registry import query, table

_Q = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def _queries(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query("v01_similarity", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 5) AS sim FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def v01(spark, d):
    e = table(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("w"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(V.dot(F.col("v"), F.col("w")), 5).alias("sim"))


@query(
    "v02_top_k",
    f"""WITH {_Q}, s AS (SELECT query_id, vec_id AS id, round(list_dot_product(q, v), 6) AS score FROM q, v WHERE vec_id <> query_id)
  SELECT query_id, place, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s) WHERE place <= 10""",
)
def v02(spark, d):
    top = V.rank_by_vector(table(spark, d, "embeddings"), _queries(spark, d), "embedding", "vec_id", 10, exclude_self=True)
    return top.select("query_id", "place", "score")


@query(
    "v03_fused_filtered",
    f"""WITH {_Q}, s AS (SELECT query_id, vec_id AS id, round(0.7 * list_dot_product(q, v) + 0.3 * list_dot_product(list_reverse(q), v), 6) AS score FROM q, v WHERE vec_id <> query_id AND label = 3)
  SELECT query_id, place, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s) WHERE place <= 5""",
)
def v03(spark, d):
    e = table(spark, d, "embeddings").filter("label = 3")
    score = lambda q, v: V.fused(V.inner(q, v), V.inner(q[:, ::-1], v))
    return V.rank_by_vector(e, _queries(spark, d), "embedding", "vec_id", 5, score, exclude_self=True).select("query_id", "place", "score")


@query("v04_marginal_relevance")
def v04(spark, d):
    return V.diverse_sets(table(spark, d, "embeddings"), _queries(spark, d), "embedding", "vec_id", 8)


@query("v05_diversified")
def v05(spark, d):
    import numpy as np
    import pandas as pd

    e = table(spark, d, "embeddings")
    top = V.rank_by_vector(e, _queries(spark, d), "embedding", "vec_id", 20, exclude_self=True).join(e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), "id")

    def choose(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("place")
        at = V.diversify(np.stack(p["v"].to_numpy()), 6, 0.5)
        return pd.DataFrame({"query_id": p["query_id"].iloc[0], "id": p["id"].iloc[at].to_numpy(), "place": range(1, len(at) + 1)})

    return top.groupBy("query_id").applyInPandas(choose, "query_id long, id long, place int")


@query(
    "a14_mean_pool",
    f"""WITH {_Q}, p AS (SELECT label, i, avg(v[i]) AS m FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2)
  SELECT label, (i - 1)::INT AS at, round(m / greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-8), 5) AS value FROM p""",
)
def a14(spark, d):
    return V.mean_pool(table(spark, d, "embeddings"), "label", "embedding").withColumn("value", F.round("value", 5))
