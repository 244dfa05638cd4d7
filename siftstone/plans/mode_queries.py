"""Query modes over one knowledge base: vectors as entities, lots as relations, labels as communities and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators import modes
from siftstone.plans.base import query, table
from siftstone.plans.vector_queries import DOUBLES

K, PER_ENTITY, CHUNKS = 10, 5, 5

PRELUDE = f"""
q AS (SELECT label AS query_id, list(m ORDER BY i) AS v FROM (SELECT label, i, round(avg(x), 4) AS m FROM (SELECT label, unnest(range(64)) AS i, unnest({DOUBLES}) AS x FROM embeddings) GROUP BY label, i) GROUP BY label),
rel AS (SELECT l_suppkey * 1000000000 + l_partkey AS id, l_suppkey AS source, l_partkey AS target, sum(l_quantity) AS weight FROM lineitem SEMI JOIN embeddings a ON a.vec_id = l_suppkey SEMI JOIN embeddings b ON b.vec_id = l_partkey WHERE l_suppkey <> l_partkey GROUP BY ALL),
ends AS (SELECT id, weight, source AS node FROM rel UNION ALL SELECT id, weight, target FROM rel),
chunk_of AS (SELECT DISTINCT l_partkey AS id, l_orderkey AS chunk_id FROM lineitem),
ehit AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::BIGINT AS rank FROM (SELECT query_id, vec_id AS id, round(list_cosine_similarity(v, {DOUBLES}), 6) AS score FROM q, embeddings)),
rhit AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::BIGINT AS rank FROM (SELECT query_id, id, round(list_cosine_similarity(v, {DOUBLES}), 6) AS score FROM q, rel JOIN embeddings ON vec_id = target)),
report AS (SELECT label AS community, count(*) / max(count(*)) OVER () AS occurrence FROM embeddings GROUP BY label)"""


def best(hit: str, k: int) -> str:
    return f"(SELECT * FROM {hit} WHERE rank <= {k})"


def entity_sql(k: int, hit: str = "ehit") -> str:
    return f"SELECT query_id, 'entity' AS section, rank AS place, id, score FROM {best(hit, k)}"


def vote_sql(facts: str, k: int = CHUNKS) -> str:
    """facts (query_id, id, rank) -> chunk section."""
    return f"""SELECT query_id, 'chunk' AS section, place, id, score FROM (SELECT query_id, chunk_id AS id, votes::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN votes > 1 THEN -votes ELSE 0 END, first, chunk_id)::BIGINT AS place
  FROM (SELECT query_id, chunk_id, count(*) AS votes, min(rank) AS first FROM ({facts}) JOIN chunk_of USING (id) GROUP BY ALL)) WHERE place <= {k}"""


def community_sql(k: int) -> str:
    return f"""SELECT query_id, 'community' AS section, place, community AS id, overlap AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, community DESC, occurrence DESC)::BIGINT AS place
  FROM (SELECT query_id, label AS community, count(*)::DOUBLE AS overlap FROM {best('ehit', k)} JOIN embeddings ON vec_id = id GROUP BY ALL) JOIN report USING (community)) WHERE place <= 3"""


HOPS = f"SELECT query_id, id, score, rank, weight, row_number() OVER (PARTITION BY query_id, node ORDER BY weight DESC, id) AS nth FROM (SELECT query_id, e.id AS node, score, rank, ends.id, weight FROM {best('ehit', K)} e JOIN ends ON ends.node = e.id)"
HOPS_FIRST = f"SELECT query_id, id, max(score) AS score, max(weight) AS weight, min((rank, nth)) AS seen FROM ({HOPS}) WHERE nth <= {PER_ENTITY} GROUP BY query_id, id"
ENDPOINTS = f"SELECT query_id, node AS id, max(score) AS score, min((rank, side)) AS seen FROM (SELECT query_id, score, rank, unnest([source, target]) AS node, unnest([0, 1]) AS side FROM {best('rhit', K)} JOIN rel USING (id)) GROUP BY query_id, node"


def knowledge(spark: SparkSession, sf_dir: str) -> modes.Knowledge:
    rows = table(spark, sf_dir, "embeddings")
    vectors = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    lots = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_quantity").alias("weight"), "l_orderkey")
    ids = vectors.select("id")
    known = lots.where("source <> target").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    relations = known.groupBy("source", "target").agg(F.sum("weight").alias("weight")).join(vectors.withColumnRenamed("id", "target"), "target").withColumn("id", F.col("source") * 1_000_000_000 + F.col("target"))
    size = rows.groupBy(F.col("label").alias("community")).agg(F.count("*").alias("n"))
    reports = size.crossJoin(F.broadcast(size.agg(F.max("n").alias("most")))).select("community", F.lit(0).alias("level"), F.col("community").alias("rating"), (F.col("n") / F.col("most")).alias("occurrence"), F.repeat(F.lit("x"), F.col("n").cast("int")).alias("text"))
    leaves = rows.select(F.col("vec_id").cast("string").alias("node"), F.concat(F.lit("l"), F.col("label")).alias("parent"))
    return modes.Knowledge(
        entities=vectors, relations=relations, fact_chunks=lots.select(F.col("target").alias("id"), F.col("l_orderkey").alias("chunk_id")).distinct(), members=rows.select(F.col("label").alias("community"), F.col("vec_id").alias("node")),
        reports=reports, parents=leaves.unionByName(leaves.select(F.col("parent").alias("node")).distinct().withColumn("parent", F.lit("root"))), chunks=vectors,
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each label: the mean of its vectors at four decimals."""
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 4).alias("m"))
    return each.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("query_vector"))


def all_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each row: its own vector."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vector"))


def plain(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "section", "place", "id", F.round("score", 6).alias("score"))


def final(*parts: str) -> str:
    return f"WITH {PRELUDE} SELECT query_id, section, place, id::BIGINT AS id, round(score, 6)::DOUBLE AS score FROM (" + " UNION ALL ".join(f"({p})" for p in parts) + ")"


VECTOR_SQL = "SELECT query_id, 'chunk' AS section, rank AS place, id, score FROM {}"


def graph_sql(k: int) -> str:
    return f"""SELECT query_id, section, place, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section, id)::BIGINT AS place FROM (SELECT query_id, section, id, max(score) AS score FROM (
  SELECT query_id, 'entity' AS section, id, score FROM {best('ehit', k // 2)} UNION ALL
  SELECT query_id, 'relation', id, round(score * 0.95, 6) FROM (SELECT query_id, ends.id, score, row_number() OVER (PARTITION BY query_id, e.id ORDER BY ends.id) AS nth FROM {best('ehit', k // 2)} e JOIN ends ON ends.node = e.id) WHERE nth <= 20 UNION ALL
  SELECT query_id, 'relation', id, score FROM {best('rhit', k - k // 2)} UNION ALL
  SELECT query_id, 'entity', unnest([source, target]), round(score * 0.95, 6) FROM {best('rhit', k - k // 2)} JOIN rel USING (id)) GROUP BY ALL)) WHERE place <= {k}"""


@query(final(VECTOR_SQL.format(best("ehit", K))))
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(modes.vector_search(knowledge(spark, sf_dir), asked(spark, sf_dir), K))


@query(final(graph_sql(K)))
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(modes.graph_search(knowledge(spark, sf_dir), asked(spark, sf_dir), K))


@query(final(f"""SELECT query_id, section, place, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, section, id)::BIGINT AS place FROM (
  SELECT query_id, section, id, round(sum(1 / (60 + place)), 6) AS score, min((list_no, place)) AS seen FROM (
    SELECT 0 AS list_no, * FROM ({VECTOR_SQL.format(best('ehit', modes.depth(K)))}) UNION ALL SELECT 1, * FROM ({graph_sql(modes.depth(K))})) GROUP BY query_id, section, id)) WHERE place <= {K}"""))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(modes.hybrid_search(knowledge(spark, sf_dir), asked(spark, sf_dir), K))


LOCAL_RELATIONS = f"SELECT query_id, 'relation' AS section, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, id DESC)::BIGINT AS place, id, weight AS score FROM ({HOPS_FIRST})"


@query(final(entity_sql(K), LOCAL_RELATIONS, community_sql(K), vote_sql(f"SELECT query_id, id, rank FROM {best('ehit', K)}")))
def community_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(modes.community_local(knowledge(spark, sf_dir), asked(spark, sf_dir), K, PER_ENTITY))


@query("""WITH RECURSIVE placed AS (SELECT label AS community, n, row_number() OVER (ORDER BY n DESC, label DESC)::BIGINT AS place FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) WHERE label >= 2),
walk AS (SELECT place, community, n AS used, 1::BIGINT AS grp FROM placed WHERE place = 1 UNION ALL SELECT p.place, p.community, CASE WHEN w.used + p.n > 120 THEN p.n ELSE w.used + p.n END, w.grp + (w.used + p.n > 120)::INT FROM walk w JOIN placed p ON p.place = w.place + 1)
SELECT grp, place, community FROM walk""")
def community_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.community_global(knowledge(spark, sf_dir).reports, 0, 2.0, budget=120)


def turns(first: str, second: str, name: str) -> str:
    """Two lists (query_id, id, score, place) taking turns."""
    return f"""SELECT query_id, '{name}' AS section, row_number() OVER (PARTITION BY query_id ORDER BY place, list_no)::BIGINT AS place, id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY place, list_no) AS pick FROM (SELECT 1 AS list_no, query_id, id, score, place FROM ({first}) UNION ALL SELECT 2, query_id, id, score, place FROM ({second}))) WHERE pick = 1"""


LOW_E, HIGH_R = f"SELECT query_id, id, score, rank AS place FROM {best('ehit', K)}", f"SELECT query_id, id, score, rank AS place FROM {best('rhit', K)}"
LOW_R = f"SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY seen, id) AS place FROM ({HOPS_FIRST})"
HIGH_E = f"SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY seen) AS place FROM ({ENDPOINTS})"
NONE = "SELECT query_id, 0 AS id, 0.0 AS score, 0 AS place FROM q WHERE false"


def keyword_sql(low: bool, high: bool) -> list[str]:
    entities, relations = turns(LOW_E if low else NONE, HIGH_E if high else NONE, "entity"), turns(LOW_R if low else NONE, HIGH_R if high else NONE, "relation")
    return [entities, relations, vote_sql(f"SELECT query_id, id, place AS rank FROM ({entities})")]


def keyword(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    queries = asked(spark, sf_dir)
    return plain(modes.keyword_graph(knowledge(spark, sf_dir), queries, queries, mode, K, PER_ENTITY))


@query(final(*keyword_sql(True, False)))
def keyword_graph_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword(spark, sf_dir, "local")


@query(final(*keyword_sql(False, True)))
def keyword_graph_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword(spark, sf_dir, "global")


@query(final(*keyword_sql(True, True)))
def keyword_graph_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword(spark, sf_dir, "hybrid")


@query(final(*keyword_sql(True, True), f"SELECT query_id, 'near_chunk' AS section, rank AS place, id, score FROM {best('ehit', K)}"))
def keyword_graph_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword(spark, sf_dir, "mix")


HIER_RELATIONS = f"""SELECT query_id, section, place, id, score FROM (SELECT query_id, 'relation' AS section, row_number() OVER (PARTITION BY query_id ORDER BY a.n + b.n DESC, weight DESC, rel.id)::BIGINT AS place, rel.id, a.n + b.n AS score
  FROM (SELECT DISTINCT query_id, ends.id FROM {best('ehit', K)} e JOIN ends ON ends.node = e.id) t JOIN rel USING (id) JOIN (SELECT node, count(*) AS n FROM ends GROUP BY node) a ON a.node = source JOIN (SELECT node, count(*) AS n FROM ends GROUP BY node) b ON b.node = target) WHERE place <= 10"""
HIER_CHUNKS = vote_sql(f"SELECT query_id, id, rank FROM {best('ehit', K)}")


def hier(spark: SparkSession, sf_dir: str, branch: str, queries: DataFrame | None = None) -> DataFrame:
    return plain(modes.hierarchy(knowledge(spark, sf_dir), asked(spark, sf_dir) if queries is None else queries, branch, K))


@query(final(entity_sql(K), HIER_RELATIONS, HIER_CHUNKS))
def hier_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hier(spark, sf_dir, "local")


@query(final(entity_sql(K), community_sql(10 * K)))
def hier_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hier(spark, sf_dir, "global")


@query(final(entity_sql(K), HIER_RELATIONS, HIER_CHUNKS, community_sql(K)))
def hier_nobridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hier(spark, sf_dir, "nobridge")


@query()
def hier_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is a query."""
    return hier(spark, sf_dir, "bridge", all_asked(spark, sf_dir))


@query()
def hier_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is a query."""
    return hier(spark, sf_dir, "full", all_asked(spark, sf_dir))


TOP5 = best("ehit", 5)


@query(final(
    entity_sql(5),
    f"SELECT query_id, 'aggregate' AS section, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first, label::VARCHAR)::BIGINT AS place, label AS id, n AS score FROM (SELECT query_id, label, count(*) AS n, min(rank) AS first FROM {TOP5} JOIN embeddings ON vec_id = id GROUP BY ALL)",
    f"SELECT a.query_id, 'relation' AS section, row_number() OVER (PARTITION BY a.query_id ORDER BY weight DESC, rel.id)::BIGINT AS place, rel.id, weight AS score FROM {TOP5} a JOIN rel ON source = a.id JOIN {TOP5} b ON b.id = target AND a.query_id = b.query_id",
    vote_sql(f"SELECT query_id, id, rank FROM {TOP5}"),
))
def tree_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(modes.tree_query(knowledge(spark, sf_dir), asked(spark, sf_dir)))
