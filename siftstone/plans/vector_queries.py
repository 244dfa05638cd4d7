"""Vectors: top-k by three metrics, filters, nearest neighbours of every row, similar pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.functions import vectors as V
from siftstone.operators.knn import nearest, pairs
from siftstone.plans.base import query, table

#: The vector searched for: exact in binary, so that every engine has the same.
PROBE = [((i * 37) % 64 - 31.5) / 32 for i in range(64)]
DOUBLES = "embedding::DOUBLE[]"
SQL_METRICS = {
    "cosine": "list_cosine_similarity({a}, {b})",
    "dot": "list_dot_product({a}, {b})",
    "l2": "-sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))",
}


def top_k_sql(metric: str, where: str = "true", k: int = 10) -> str:
    score = SQL_METRICS[metric].format(a=DOUBLES, b=f"{PROBE}::DOUBLE[]")
    return f"SELECT vec_id, score FROM (SELECT vec_id, round({score}, 6) AS score FROM embeddings WHERE {where}) ORDER BY score DESC, vec_id LIMIT {k}"


def top_vectors(vectors: DataFrame, metric: str, k: int = 10) -> DataFrame:
    """One query: a scan with partial top-k in each task, no exchange of vectors."""
    score = V.METRICS[metric](V.checked(F.col("embedding"), len(PROBE)), F.lit(PROBE))
    return vectors.select("vec_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def sides(spark: SparkSession, sf_dir: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """embeddings as the searched vectors and as the queries, one for every row."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), *more), rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), *more)


def knn_sql(k: int, on: str = "true") -> str:
    return f"""SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::BIGINT AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.{DOUBLES}, b.{DOUBLES}), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND {on}
  )) WHERE rank <= {k}"""


def named(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), F.col("id").alias("vec_id"), "score")


@query(top_k_sql("cosine"))
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_vectors(table(spark, sf_dir, "embeddings"), "cosine")


@query(top_k_sql("dot"))
def vector_topk_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_vectors(table(spark, sf_dir, "embeddings"), "dot")


@query(top_k_sql("l2"))
def vector_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_vectors(table(spark, sf_dir, "embeddings"), "l2")


@query(top_k_sql("cosine", "label = 3"))
def vector_filtered_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_vectors(table(spark, sf_dir, "embeddings").where(T.matches([(F.col("label"), 3)])), "cosine")


@query(knn_sql(10))
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(nearest(*sides(spark, sf_dir), 10, others=True))


@query(knn_sql(8, "a.label = b.label"))
def knn_within_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge candidates: the eight nearest of the same document (here label)."""
    return named(nearest(*sides(spark, sf_dir, "label"), 8, others=True, within="label"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.{DOUBLES}, b.{DOUBLES}), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.{DOUBLES}, b.{DOUBLES}), 6) >= 0.5")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs(*sides(spark, sf_dir), None, least=0.5, once=True)
    return found.select(F.col("query_id").alias("a"), F.col("id").alias("b"), "score")


@query(f"SELECT vec_id, len(embedding)::BIGINT AS dimension, round(sqrt(list_dot_product({DOUBLES}, {DOUBLES})), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("bigint").alias("dimension"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query(f"SELECT label, i::BIGINT AS i, count(*)::BIGINT AS n, round(avg(v), 6) AS mean FROM (SELECT label, unnest(range(64)) AS i, unnest({DOUBLES}) AS v FROM embeddings) GROUP BY label, i")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return rows.groupBy("label", F.col("i").cast("bigint").alias("i")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))
