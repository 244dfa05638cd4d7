"""Wiki pages, numbering, aggregation trees, and the modes that work on wordings of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.checkpoint import materialize
from siftstone.functions import text as T
from siftstone.models import OverlapReranker, rerank
from siftstone.operators import fulltext, modes, search, wiki
from siftstone.operators.numbering import layers, number_rows
from siftstone.plans.base import query, table
from siftstone.plans.rank_queries import DEPTH, LISTS_SQL, lists


@query("SELECT doc_id, source, (row_number() OVER (ORDER BY source, doc_id) - 1)::BIGINT AS row_number FROM documents")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), [F.asc("source"), F.asc("doc_id")])


@query("""WITH RECURSIVE t AS (
  SELECT 0 AS layer, row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_custkey::VARCHAR AS node, count(*) OVER () AS n FROM customer
  UNION SELECT layer + 1, i // 20, 'l' || (layer + 1) || '_' || (i // 20), (n + 19) // 20 FROM t WHERE n > 1
) SELECT layer, node, CASE WHEN n > 1 THEN 'l' || (layer + 1) || '_' || (i // 20) ELSE 'root' END AS parent FROM t""")
def aggregation_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")), [F.asc("node")])


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return wiki.pages(docs.select(F.col("doc_id").alias("document_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("name"), "text"))


@query()
def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir)


@query()
def wiki_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.chunks(_pages(spark, sf_dir)).withColumn("heading_path", F.array_join("heading_path", " > "))


@query()
def wiki_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.index(_pages(spark, sf_dir))


@query(rf"""{LISTS_SQL}, fused AS (SELECT item_id, doc_id, sum(1 / (60 + rank)) AS rrf FROM lists GROUP BY ALL),
reranked AS (SELECT f.item_id, f.doc_id, f.rrf, len(list_intersect(list_distinct(regexp_split_to_array(trim(lower(b.text)), '\s+')), list_distinct(regexp_split_to_array(trim(lower(d.text)), '\s+')))) / len(list_distinct(regexp_split_to_array(trim(lower(b.text)), '\s+'))) AS score
  FROM fused f JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id))
SELECT item_id, doc_id, round(score, 6) AS score FROM reranked""")
def rerank_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused candidates of both lists, scored again by a reranker over their texts."""
    fused = search.top_k(search.fuse(lists(spark, sf_dir)), 2 * DEPTH, order=[F.desc("score"), F.asc("first_list"), F.asc("first_rank")])
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = fused.select("query_id", "id", F.col("rank").alias("place")).join(asked, "query_id")
    rows = search.with_rows(rows, texts, "id")
    return rerank(rows, OverlapReranker(), 2 * DEPTH).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def _find(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents")
    return lambda asked: fulltext.rankings(docs, asked, "doc_id", "text", "query_id", "text", 10)[0]


@query()
def rewrite_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two wordings of each passage: itself and its first half."""
    rows = table(spark, sf_dir, "benchmark")
    half = F.substring("text", F.lit(1), (F.length("text") / 2).cast("int"))
    variants = rows.select(F.col("item_id").alias("query_id"), F.lit(0).alias("variant"), "text").unionByName(rows.select(F.col("item_id").alias("query_id"), F.lit(1).alias("variant"), half.alias("text")))
    return modes.rewritten(_find(spark, sf_dir), variants, 10)


@query()
def multihop_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each next question is the whole text of the best document that none was made of yet, without the last question's words."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("said"))
    used: list[DataFrame] = []

    def follow(asked: DataFrame, found: DataFrame) -> DataFrame:
        for before in used:
            found = found.join(before, ["query_id", "id"], "left_anti")
        used.append(materialize(search.top_k(found, 1).select("query_id", "id")))
        known = asked.select("query_id", F.array_distinct(T.tokens(F.col("text"))).alias("known"))
        met = search.with_rows(used[-1], docs, "id").join(known, "query_id")
        fresh = F.filter("said", lambda w: ~F.array_contains("known", w))
        return met.select("query_id", F.array_join(fresh, " ").alias("text")).where("text <> ''")

    return modes.multihop(_find(spark, sf_dir), follow, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
