"""Selections, counts and merges of facts, over graphs derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators import facts
from siftstone.plans.base import query, table

EDGES_SQL = "SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_quantity AS weight, l_orderkey AS ord FROM lineitem"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.col("l_quantity").alias("weight"), F.col("l_orderkey").alias("order"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit(False).alias("is_aggregate"))
    two = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit(True).alias("is_aggregate"))
    three = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(True).alias("is_aggregate"))
    return one.unionByName(two).unionByName(three)


@query("""WITH t AS (SELECT 'c' || c_custkey AS id, false AS agg FROM customer UNION ALL SELECT 'n' || n_nationkey, true FROM nation UNION ALL SELECT 'r' || r_regionkey, true FROM region)
SELECT 0::INT AS mode, id FROM t WHERE NOT agg UNION ALL SELECT 1, id FROM t WHERE agg UNION ALL SELECT 2, id FROM t""")
def tree_level_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    out = [facts.by_level(tree, mode).select(F.lit(mode).alias("mode"), "id") for mode in (0, 1, 2)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""WITH e AS ({EDGES_SQL}), chosen AS (SELECT 's' || s_suppkey AS id FROM supplier WHERE s_acctbal < 0), ends AS (SELECT source AS id FROM e UNION ALL SELECT target FROM e WHERE target <> source)
SELECT c.id, count(x.id)::BIGINT AS relations FROM chosen c LEFT JOIN ends x ON x.id = c.id GROUP BY c.id""")
def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over suppliers in debt."""
    chosen = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return facts.relation_counts(_edges(spark, sf_dir), chosen)


@query("""SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation
WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) OR n_name IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""")
def named_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    nodes = nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    ids = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("id"))
    names = nation.join(table(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"))
    return facts.named_nodes(nodes, ids, names)


@query(f"""WITH e AS (SELECT DISTINCT source, target FROM ({EDGES_SQL})), covered AS (SELECT 's' || s_suppkey AS source FROM supplier WHERE s_acctbal < 0)
SELECT source, target FROM e WHERE source NOT IN (SELECT source FROM covered)""")
def uncovered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that the report on suppliers in debt doesn't cover."""
    covered = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("source"))
    return facts.uncovered(_edges(spark, sf_dir).select("source", "target").distinct(), covered, ["source"])


@query(f"""WITH e AS ({EDGES_SQL}) SELECT least(source, target) AS source, greatest(source, target) AS target, sum(weight)::DOUBLE AS weight, min(ord)::BIGINT AS first_order FROM e GROUP BY 1, 2""")
def hier_edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = facts.merge_hier_edges(_edges(spark, sf_dir), _tree(spark, sf_dir).select("id"))
    return edges.select("source", "target", F.col("weight").cast("double").alias("weight"), F.col("order").cast("bigint").alias("first_order"))


@query(f"""WITH e AS ({EDGES_SQL}), ends AS (SELECT source AS id FROM e UNION SELECT target FROM e), have AS (SELECT 's' || s_suppkey AS id FROM supplier)
SELECT id, 'known' AS type FROM have UNION ALL SELECT id, 'unknown' FROM ends WHERE id NOT IN (SELECT id FROM have)""")
def hier_missing_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts have no node before the merge, suppliers have."""
    nodes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("known").alias("type"))
    return facts.merge_hier_edges(_edges(spark, sf_dir), nodes)[1]


HIER_SQL = "SELECT 'p' || l_partkey AS id, l_returnflag || l_linestatus AS kind, l_returnflag AS descr, 's' || l_suppkey AS src, l_linenumber AS layer, l_linestatus = 'F' AS summary, l_orderkey * 10 + l_linenumber AS seen, l_linestatus || l_linenumber AS cluster FROM lineitem"


@query(f"""WITH n AS ({HIER_SQL}), k AS (SELECT id, kind, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, kind) AS r FROM n GROUP BY id, kind)
SELECT n.id, any_value(k.kind) AS type, array_to_string(list_sort(list(DISTINCT descr)), ',') AS descriptions, array_to_string(list_sort(list(DISTINCT src)), ',') AS source_ids,
  min(layer)::BIGINT AS layer, bool_or(summary) AS is_summary, arg_min(cluster, seen) AS cluster FROM n JOIN k ON k.id = n.id AND k.r = 1 GROUP BY n.id""")
def hier_nodes_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    nodes = lines.select(
        F.concat(F.lit("p"), "l_partkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("type"), F.col("l_returnflag").alias("description"), F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.col("l_linenumber").alias("layer"),
        (F.col("l_linestatus") == "F").alias("is_summary"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("cluster"),
    )
    out = facts.merge_hier_nodes(nodes)
    return out.select("id", "type", F.array_join("descriptions", ",").alias("descriptions"), F.array_join("source_ids", ",").alias("source_ids"), F.col("layer").cast("bigint").alias("layer"), "is_summary", "cluster")


@query("""WITH e AS (SELECT role, conv_id, max(length(text)) AS tokens FROM conversations GROUP BY role, conv_id)
SELECT role, array_to_string(list_sort(list(conv_id)), ',') AS documents, sum(tokens)::BIGINT AS token_sum FROM e GROUP BY role""")
def document_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select("role", F.col("conv_id").alias("document_id"), F.concat(F.lit("conversation "), "conv_id").alias("document_name"), F.length("text").cast("bigint").alias("tokens"))
    return facts.document_rollup(talk, "role").select("role", F.array_join(F.transform("documents", lambda x: x.cast("string")), ",").alias("documents"), "token_sum")


FACTS_SQL = "SELECT p_partkey AS fact_id, n::INT AS nth, CASE n WHEN 0 THEN 's' || p_partkey ELSE 'c' || (p_partkey * 7) END AS chunk_id FROM part, (VALUES (0), (1)) t(n)"


@query(f"""WITH f AS ({FACTS_SQL}), c AS (SELECT 's' || s_suppkey AS chunk_id FROM supplier UNION ALL SELECT 'c' || c_custkey FROM customer)
SELECT f.fact_id, f.nth, f.chunk_id, CASE WHEN c.chunk_id IS NULL THEN 'no chunk ' || f.chunk_id END AS issue FROM f LEFT JOIN c USING (chunk_id)""")
def fact_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as facts that name a supplier and a customer, some of whom don't exist."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact_id"), F.array(F.concat(F.lit("s"), "p_partkey"), F.concat(F.lit("c"), F.col("p_partkey") * 7)).alias("source_chunk_ids"))
    chunks = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("chunk_id")).unionByName(table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("chunk_id")))
    found, issues = facts.fact_sources(part, chunks)
    return found.select("fact_id", "nth", "chunk_id", F.lit(None).cast("string").alias("issue")).unionByName(issues.select("fact_id", "nth", "chunk_id", "issue"))


@query("""SELECT conv_id, turn, '{"document_id":"' || conv_id || '","page_index":' || turn || CASE WHEN role = 'user' THEN ',"speaker":"user"' ELSE '' END || '}' AS origin FROM conversations""")
def result_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = facts.provenance(document_id=F.col("conv_id").cast("string"), page_index=F.col("turn"), speaker=F.when(F.col("role") == "user", F.col("role")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", origin.alias("origin"))
