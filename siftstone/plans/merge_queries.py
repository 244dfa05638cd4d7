"""Deduplication and merging of facts: parts of one name as one entity, lots as relations, orders as evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.operators import merge
from siftstone.plans.base import query, table
from siftstone.plans.vector_queries import DOUBLES

GROUPS_SQL = """groups AS (
  SELECT CASE WHEN count(*) > 1 THEN 'entity_' || substr(sha256(trim(p_name) || chr(10) || string_agg(p_partkey::VARCHAR, chr(10) ORDER BY p_partkey::VARCHAR)), 1, 16) ELSE min(p_partkey)::VARCHAR END AS merged_id, trim(p_name) AS name, count(*)::BIGINT AS n
  FROM part GROUP BY trim(p_name)
), mapped AS (SELECT p_partkey::VARCHAR AS member, merged_id FROM part JOIN groups ON name = trim(p_name))"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.exact_groups(table(spark, sf_dir, "part"), [T.strip(F.col("p_name"))], "p_partkey", "p_name")


@query(f"WITH {GROUPS_SQL} SELECT merged_id, name, n FROM groups")
def entity_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).select("merged_id", "name", "n")


@query(f"WITH {GROUPS_SQL} SELECT member, merged_id FROM mapped")
def entity_id_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.mapping(groups(spark, sf_dir))


@query(f"WITH {GROUPS_SQL} SELECT 's' || l_suppkey AS source, merged_id AS target, sum(l_quantity) AS weight, count(*)::BIGINT AS n FROM lineitem JOIN mapped ON member = l_partkey::VARCHAR GROUP BY ALL")
def relation_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("source"), F.col("l_partkey").cast("string").alias("target"), F.col("l_quantity").alias("weight"))
    return merge.remap_relations(facts, merge.mapping(groups(spark, sf_dir))).groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


@query(f"WITH {GROUPS_SQL} SELECT DISTINCT merged_id AS fact_id, 'entity' AS fact_type, l_orderkey AS chunk_id FROM lineitem JOIN mapped ON member = l_partkey::VARCHAR")
def evidence_retarget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("fact_id"), F.lit("entity").alias("fact_type"), F.col("l_orderkey").alias("chunk_id"))
    return merge.retarget_evidence(rows, merge.mapping(groups(spark, sf_dir)), ["fact_id", "fact_type", "chunk_id"])


@query("SELECT c_custkey, coalesce(total, c_acctbal) AS value FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey UNION ALL SELECT o_custkey, max(o_totalprice) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("value"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("value"))
    return merge.upsert(old, new, ["c_custkey"])


@query("SELECT c.* FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def pending_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has no output yet, so that a run can be resumed."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query()
def semantic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.semantic_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.4, ["label"])


@query(f"""WITH RECURSIVE scored AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.{DOUBLES}, b.{DOUBLES}), 6) AS score FROM embeddings a JOIN embeddings b ON a.label >= 5 AND b.label < 5),
linked AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place FROM scored WHERE score >= 0.35) WHERE place <= 8),
near AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked), reach AS (SELECT a, a AS b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b)
SELECT a AS id, min(b) AS grp FROM reach GROUP BY a""")
def incremental_merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return merge.merge_groups(rows.where("label >= 5"), rows.where("label < 5"), 8, 0.35)
