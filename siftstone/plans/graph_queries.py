"""Graph operators over graphs in the star schema: suppliers and parts, places, returned goods, trading communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.operators import graph
from siftstone.operators.components import components
from siftstone.plans.base import query, table

RELATIONS_SQL = """relations AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_quantity AS weight, l_returnflag AS type, l_orderkey * 10 + l_linenumber AS position FROM lineitem)"""
EDGES_SQL = f"""{RELATIONS_SQL},
typed AS (SELECT source, target, type, sum(CASE WHEN weight = 0 THEN 1 ELSE weight END) AS weight, count(*) AS n, min(position) AS first FROM (SELECT least(source, target) AS source, greatest(source, target) AS target, weight, type, position FROM relations WHERE source <> target) GROUP BY ALL),
edges AS (SELECT source, target, sum(weight) AS weight, sum(n)::BIGINT AS n, arg_min(type, (-n, first)) AS type FROM typed GROUP BY source, target),
ends AS (SELECT source AS node, target AS other, weight, n, type FROM edges UNION ALL SELECT target, source, weight, n, type FROM edges WHERE source <> target)"""
#: Goods sent back in large lots: a sparse graph.
RETURNED = "l_returnflag = 'R' AND l_quantity >= 49"
RETURNED_SQL = f"""edges AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem WHERE {RETURNED}),
near AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey")).alias("target"), F.col("l_quantity").alias("weight"), F.col("l_returnflag").alias("type"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_edges(relations(spark, sf_dir))


def returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(RETURNED).select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey")).alias("target")).distinct()


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of edges(), without what is counted on them."""
    return graph.canonical(relations(spark, sf_dir).select("source", "target")).distinct()


def steps_to_next(spark: SparkSession, sf_dir: str, built: DataFrame) -> DataFrame:
    asked = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("source"), F.concat(F.lit("s"), F.col("s_suppkey") + 1).alias("target"))
    return graph.path_lengths(built, asked).select("source", "target", F.coalesce("steps", F.lit(1)).cast("bigint").alias("steps"))


@query("""
WITH typed AS (SELECT p_name, p_type, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL),
brands AS (SELECT p_name, p_brand, min(p_partkey) AS first FROM part GROUP BY ALL)
SELECT p_name AS name, (SELECT arg_min(p_type, (-n, first)) FROM typed t WHERE t.p_name = p.p_name) AS type, (SELECT string_agg(p_brand, '<SEP>' ORDER BY first) FROM brands b WHERE b.p_name = p.p_name) AS description,
  string_agg(p_partkey::VARCHAR, ' ' ORDER BY p_partkey) AS source_ids, count(*)::BIGINT AS n FROM part p GROUP BY p_name""")
def graph_nodes_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("description"), F.col("p_partkey").alias("source_id"), F.col("p_partkey").alias("position"))
    return graph.build_nodes(rows).withColumn("source_ids", F.array_join(F.transform("source_ids", lambda x: x.cast("string")), " "))


@query(f"WITH {EDGES_SQL} SELECT source, target, round(weight, 4) AS weight, type, n FROM edges")
def graph_edges_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).withColumn("weight", F.round("weight", 4))


@query(f"WITH {EDGES_SQL} SELECT node, count(*)::BIGINT AS degree, count(DISTINCT other)::BIGINT AS neighbours FROM ends GROUP BY node")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(edges(spark, sf_dir))


@query(f"WITH {EDGES_SQL}, d AS (SELECT node, count(*)::BIGINT AS degree FROM ends GROUP BY node) SELECT source, target, a.degree + b.degree AS rank FROM edges JOIN d a ON a.node = source JOIN d b ON b.node = target")
def edge_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_ranks(edges(spark, sf_dir)).select("source", "target", "rank")


@query(f"WITH {EDGES_SQL} SELECT node, other, weight, place FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other)::BIGINT AS place FROM ends) WHERE place <= 5")
def one_hop_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = edges(spark, sf_dir)
    nodes = graph.ends(built).select("node")
    return graph.incident(built, nodes, 5, [F.desc("weight"), F.asc("other")], "weight").withColumn("place", F.col("place").cast("bigint"))


@query(f"""WITH {EDGES_SQL},
hits AS (SELECT 's' || s_suppkey AS node, round(s_acctbal / 10000, 6) AS score FROM supplier),
hops AS (SELECT node, other FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY other) AS place FROM ends) WHERE place <= 20)
SELECT id, round(max(score), 6) AS score FROM (SELECT node AS id, score FROM hits UNION ALL SELECT other, score * 0.95 FROM hits JOIN hops USING (node)) GROUP BY id""")
def graph_expand_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits keep their score, their first twenty neighbours get 0.95 of it; the best counts."""
    hits = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"), F.round(F.col("s_acctbal") / 10000, 6).alias("score"))
    hops = graph.incident(edges(spark, sf_dir), hits, 20, [F.asc("other")]).join(hits, "node").select(F.col("other").alias("id"), (F.col("score") * 0.95).alias("score"))
    return hits.select(F.col("node").alias("id"), "score").unionByName(hops).groupBy("id").agg(F.round(F.max("score"), 6).alias("score"))


@query("SELECT l_partkey, l_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey)::BIGINT AS place FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)) WHERE place <= 3")
def evidence_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey")).cast("bigint")).where("place <= 3")


@query(f"WITH RECURSIVE {RETURNED_SQL}, reach AS (SELECT a, a AS b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b) SELECT a AS key, min(b) AS component FROM reach GROUP BY a")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(returned(spark, sf_dir).select(F.col("source").alias("a"), F.col("target").alias("b")))


@query()
def connected_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the edges of all line items, where connected_components has the returned goods of its SQL."""
    return components(linked(spark, sf_dir).select(F.col("source").alias("a"), F.col("target").alias("b")))


@query(f"""WITH RECURSIVE {RETURNED_SQL},
pairs AS (SELECT 's' || s_suppkey AS source, 's' || (s_suppkey + 1) AS target FROM supplier),
walk AS (SELECT source, source AS at, 0 AS steps FROM pairs UNION SELECT w.source, n.b, w.steps + 1 FROM walk w JOIN near n ON n.a = w.at WHERE w.steps < 24)
SELECT source, target, coalesce(min(steps), 1)::BIGINT AS steps FROM pairs LEFT JOIN walk ON walk.source = pairs.source AND walk.at = target GROUP BY ALL""".replace("SELECT source, target, coalesce", "SELECT pairs.source, target, coalesce"))
def shortest_path_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from each supplier to the next one by number; 1 where they aren't connected."""
    return steps_to_next(spark, sf_dir, returned(spark, sf_dir))


@query()
def shortest_path_steps_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the edges of all line items, where shortest_path_steps has the returned goods of its SQL."""
    return steps_to_next(spark, sf_dir, linked(spark, sf_dir))


PLACES_SQL = """parents AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    def edge(name: str, prefix: str, key: str, up: str, parent: str | None) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key)).alias("node"), (F.concat(F.lit(up), F.col(parent)) if parent else F.lit(up)).alias("parent"))

    return edge("customer", "c", "c_custkey", "n", "c_nationkey").unionByName(edge("nation", "n", "n_nationkey", "r", "n_regionkey")).unionByName(edge("region", "r", "r_regionkey", "root", None))


@query(f"WITH RECURSIVE {PLACES_SQL}, chain AS (SELECT node, 0 AS place, node AS ancestor FROM parents UNION ALL SELECT c.node, place + 1, p.parent FROM chain c JOIN parents p ON p.node = c.ancestor AND p.parent <> c.ancestor) SELECT node, string_agg(ancestor, '>' ORDER BY place) AS chain FROM chain GROUP BY node")
def ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = places(spark, sf_dir)
    chains = graph.ancestors(tree, tree.select("node"), 5)
    return chains.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "ancestor"))), lambda x: x["ancestor"]), ">").alias("chain"))


@query("""
SELECT 'n' || a.n_nationkey AS a, 'n' || b.n_nationkey AS b, CASE WHEN a.n_nationkey = b.n_nationkey THEN 'n' || a.n_nationkey WHEN a.n_regionkey = b.n_regionkey THEN 'r' || a.n_regionkey ELSE 'root' END AS ancestor,
  CASE WHEN a.n_nationkey = b.n_nationkey THEN 0 WHEN a.n_regionkey = b.n_regionkey THEN 1 ELSE 2 END AS up FROM nation a, nation b""")
def common_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = places(spark, sf_dir)
    nations = tree.where("node LIKE 'n%'").select("node")
    asked = nations.select(F.col("node").alias("a")).crossJoin(nations.select(F.col("node").alias("b")))
    return graph.common_ancestors(graph.ancestors(tree, nations, 5), asked).select("a", "b", "ancestor", "up")


@query("""WITH each AS (SELECT c_nationkey AS community, count(DISTINCT o_orderkey)::BIGINT AS chunks FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey)
SELECT community, chunks, round(chunks / greatest(1, (SELECT max(chunks) FROM each)), 6) AS occurrence FROM each""")
def community_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("community"), F.col("o_orderkey").alias("chunk_id"))
    return graph.occurrence(members).withColumn("occurrence", F.round("occurrence", 6))


@query("SELECT DISTINCT 'r' || n_regionkey AS community, 'n' || n_nationkey AS sub_community FROM nation JOIN customer ON c_nationkey = n_nationkey")
def sub_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    nations = rows.select(F.lit(1).alias("level"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("community"), F.col("c_custkey").alias("node"))
    return graph.sub_communities(nations.unionByName(rows.select(F.lit(0).alias("level"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("community"), F.col("c_custkey").alias("node"))))


@query("""WITH bought AS (SELECT DISTINCT l_suppkey AS query_id, o_custkey AS node FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT query_id, community, overlap, place FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, community)::BIGINT AS place FROM (SELECT query_id, c_nationkey AS community, count(*)::BIGINT AS overlap FROM bought JOIN customer ON c_custkey = node GROUP BY ALL)) WHERE place <= 3""")
def community_overlap_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_suppkey").alias("query_id"), F.col("o_custkey").alias("node"))
    met = graph.overlaps(bought, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("community"), F.col("c_custkey").alias("node")))
    return met.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "community")).cast("bigint")).where("place <= 3")


@query("SELECT event_id, event_type, rating FROM (SELECT event_id, event_type, value, coalesce((props->>'$.k')::DOUBLE, 0) AS rating FROM events) WHERE rating >= 50 ORDER BY rating DESC, value DESC, event_id LIMIT 512")
def global_communities_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by a number in their JSON; the 512 best."""
    rating = F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$.k", "double"), F.lit(0.0))
    return table(spark, sf_dir, "events").withColumn("rating", rating).where("rating >= 50").orderBy(F.desc("rating"), F.desc("value"), "event_id").limit(512).select("event_id", "event_type", "rating")


@query(f"WITH {EDGES_SQL}, big AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_size > 25) SELECT source, target, n FROM edges WHERE source IN (FROM big) AND target IN (FROM big)")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node")).unionByName(table(spark, sf_dir, "part").where("p_size > 25").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("node")))
    return graph.induced(edges(spark, sf_dir), big).select("source", "target", "n")


@query("""WITH trade AS (SELECT c_nationkey AS ga, s_nationkey AS gb, l_quantity AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey)
SELECT least(ga, gb) AS a, greatest(ga, gb) AS b, sum(weight) AS weight, count(*)::BIGINT AS n FROM trade GROUP BY ALL""")
def pair_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence between groups, of either orientation."""
    trade = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("c"), F.col("o_custkey")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("target"), F.col("l_quantity").alias("weight"))
    members = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.col("c_nationkey").alias("grp")).unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")), F.col("s_nationkey")).toDF("node", "grp"))
    return graph.between(trade, members).groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


@query("SELECT sum(s)::BIGINT AS n, count(*)::BIGINT AS clusters, round(1 - sum(s * (s - 1)) / (sum(s) * (sum(s) - 1)), 6) AS sparsity FROM (SELECT count(*) AS s FROM customer GROUP BY c_nationkey)")
def cluster_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sparsity(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("cluster"))).withColumn("sparsity", F.round("sparsity", 6))


@query("""SELECT query_id, chunk_id, votes, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN votes > 1 THEN -votes ELSE 0 END, first, chunk_id)::BIGINT AS place FROM (
  SELECT l_suppkey AS query_id, l_partkey AS chunk_id, count(*)::BIGINT AS votes, min(l_orderkey) AS first FROM lineitem GROUP BY ALL)) WHERE place <= 5""")
def text_unit_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("position"), F.col("l_partkey").alias("chunk_id"))
    return graph.chunk_votes(facts, 5).withColumn("place", F.col("place").cast("bigint"))


@query(f"""WITH {EDGES_SQL} SELECT node, string_agg(DISTINCT type, '<SEP>' ORDER BY type) AS types, sum(weight) AS weight, bool_or(n > 1) AS is_summary FROM ends GROUP BY node""")
def hier_node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct values, sums and any() of what is merged into a node."""
    return graph.ends(edges(spark, sf_dir), "weight", "type", "n").groupBy("node").agg(F.array_join(F.sort_array(F.collect_set("type")), graph.SEPARATOR).alias("types"), F.sum("weight").alias("weight"), F.bool_or(F.col("n") > 1).alias("is_summary"))
