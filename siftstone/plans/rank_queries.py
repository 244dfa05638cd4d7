"""Fusion of ranked lists, budgets, retrieval and answer metrics, score roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.operators import fulltext, scoring, search
from siftstone.operators.knn import nearest
from siftstone.plans.base import query, table
from siftstone.plans.text_queries import ALL_TERMS_SQL, bm25_sql, best_passages, top_sql
from siftstone.plans.vector_queries import knn_sql, sides

DEPTH, TOP = 30, 10

LISTS_SQL = f"""
WITH {bm25_sql()}, {ALL_TERMS_SQL},
lists AS (SELECT 1 AS list_no, * FROM ({top_sql('scored', DEPTH)}) UNION ALL SELECT 2, * FROM ({top_sql('lexical', DEPTH)}))"""


def lists(spark: SparkSession, sf_dir: str, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(query_id, list_no, rank, id, score, weight): BM25 and all-terms rankings of every benchmark passage."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = fulltext.rankings(docs, asked, "doc_id", "text", "item_id", "text", DEPTH, ("bm25", "all_terms"))
    ranked = [x.withColumn("list_no", F.lit(i + 1)).withColumn("weight", F.lit(w)) for i, (x, w) in enumerate(zip(found, weights, strict=True))]
    return ranked[0].unionByName(ranked[1])


def fusion_sql(weights: tuple[float, float]) -> str:
    return f"""{LISTS_SQL}
SELECT item_id, rank, doc_id, score, lists FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, seen[1], seen[2], doc_id)::BIGINT AS rank FROM (
    SELECT item_id, doc_id, round(sum(CASE list_no WHEN 1 THEN {weights[0]}::DOUBLE ELSE {weights[1]}::DOUBLE END / (60 + rank)), 6) AS score, min([list_no, rank]) AS seen, string_agg(list_no::VARCHAR, ',' ORDER BY list_no) AS lists FROM lists GROUP BY ALL
  )) WHERE rank <= {TOP}"""


def fused(spark: SparkSession, sf_dir: str, weights: tuple[float, float]) -> DataFrame:
    merged = search.fuse(lists(spark, sf_dir, weights)).withColumn("score", F.round("score", 6))
    best = search.top_k(merged, TOP, order=[F.desc("score"), F.asc("first_list"), F.asc("first_rank"), F.asc("id")])
    return best.select(F.col("query_id").alias("item_id"), F.col("rank").cast("bigint").alias("rank"), F.col("id").alias("doc_id"), "score", "lists")


@query(fusion_sql((1.0, 1.0)))
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir, (1.0, 1.0))


@query(fusion_sql((0.7, 0.3)))
def weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir, (0.7, 0.3))


@query(f"""{LISTS_SQL}
SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY rank, list_no)::BIGINT AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY rank, list_no) AS pick FROM lists) WHERE pick = 1""")
def round_robin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.interleave(lists(spark, sf_dir)).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.col("position").cast("bigint").alias("position"))


@query(f"""{LISTS_SQL}
SELECT item_id, doc_id, list_no, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, rank, list_no) AS pick FROM lists) WHERE pick = 1""")
def best_result_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search.best_per_id(lists(spark, sf_dir), ["query_id", "id"])
    return best.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "list_no", "score")


@query("""
SELECT conv_id, turn, used::BIGINT AS used FROM (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations
) WHERE used <= 2000 OR position = 1""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return search.budget_prefix(rows, ["conv_id"], [F.asc("turn")], "n", 2000).select("conv_id", "turn", F.col("used").cast("bigint").alias("used"))


@query("""
WITH RECURSIVE rows AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, turn, length(text) AS n FROM conversations),
walk AS (
  SELECT conv_id, p, turn, n, 1::BIGINT AS grp, n AS used FROM rows WHERE p = 1
  UNION ALL
  SELECT r.conv_id, r.p, r.turn, r.n, w.grp + CASE WHEN w.used > 0 AND w.used + r.n > 1000 THEN 1 ELSE 0 END, CASE WHEN w.used > 0 AND w.used + r.n > 1000 THEN r.n ELSE w.used + r.n END
  FROM walk w JOIN rows r ON r.conv_id = w.conv_id AND r.p = w.p + 1
) SELECT conv_id, turn, grp FROM walk""")
def budget_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return search.budget_groups(rows, "conv_id", "turn", "n", 1000).select("conv_id", "turn", "grp")


METRICS_SQL = f"""
WITH ranked AS ({knn_sql(100)}), label_of AS (SELECT vec_id, label FROM embeddings),
hits AS (SELECT r.query_id, r.rank, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS nth FROM ranked r JOIN label_of q ON q.vec_id = r.query_id JOIN label_of d ON d.vec_id = r.vec_id WHERE q.label = d.label),
n AS (SELECT a.vec_id AS query_id, count(*) AS n FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id),
grid AS (SELECT unnest([1, 3, 5, 10, 100]) AS k),
ideal AS (SELECT query_id, k, n, (SELECT sum(1 / log2(i + 1)) FROM range(1, 101) t(i) WHERE i <= least(n, k)) AS best FROM n, grid),
got AS (SELECT query_id, k, sum(1 / log2(rank + 1)) AS dcg, sum(nth / rank) AS ap, count(*) AS found, min(rank) AS first FROM hits JOIN grid ON rank <= k GROUP BY query_id, k)
SELECT query_id, k, round(coalesce(dcg / best, 0), 6) AS ndcg, round(coalesce(ap / least(n, k), 0), 6) AS map, round(coalesce(found / n, 0), 6) AS recall, round(coalesce(found / k, 0), 6) AS precision, round(coalesce(1 / first, 0), 6) AS mrr
FROM ideal LEFT JOIN got USING (query_id, k)"""


@query(METRICS_SQL)
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five metrics at five depths for every vector as a query; vectors of the same label are relevant."""
    vectors, asked = sides(spark, sf_dir)
    classes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("class"))
    scored = search.metrics_within(nearest(vectors, asked, 100, others=True), classes)
    return scored.select("query_id", "k", *[F.round(m, 6).alias(m) for m in ("ndcg", "map", "recall", "precision", "mrr")])


@query(f"""WITH {bm25_sql()}, top AS ({top_sql('scored', TOP)})
SELECT b.item_id, (count(*) FILTER (contains(lower(d.text), lower(b.text))) > 0)::INT::DOUBLE AS evidence_recall, coalesce(bool_or(contains(lower(d.text), lower(b.text)) AND t.rank = 1), false) AS answer_contained
FROM benchmark b LEFT JOIN top t USING (item_id) LEFT JOIN documents d USING (doc_id) GROUP BY b.item_id""")
def evidence_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a top document holds the passage asked for: evidence by text, answers by containment."""
    top = search.with_rows(best_passages(spark, sf_dir, TOP), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    wanted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("evidence_id"), F.col("text").alias("expected"), F.lit(None).cast("string").alias("locator"))
    recall = scoring.evidence_recall(wanted, top.withColumn("found_locator", F.lit(None).cast("string")))
    answers = scoring.answer_contains(wanted.select("query_id", F.col("expected").alias("answer")), top.where("rank = 1").select("query_id", F.col("text").alias("given")))
    return recall.join(answers, "query_id", "left").select(F.col("query_id").alias("item_id"), "evidence_recall", F.coalesce("contains", F.lit(False)).alias("answer_contained"))


@query("""SELECT event_type, user_id, round(avg(value), 6) AS score, count(*)::BIGINT AS n, count(*) FILTER (value = 0)::BIGINT AS n_skipped FROM events GROUP BY GROUPING SETS ((event_type), (event_type, user_id), ())""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by mode and metric, by mode, and over all; skipped scores count as 0 and are counted beside."""
    return scoring.summary(table(spark, sf_dir, "events"), ["event_type", "user_id"], "value").select("event_type", "user_id", F.round("score", 6).alias("score"), "n", "n_skipped")


@query("""SELECT query_id, string_agg(vec_id::VARCHAR, ' ' ORDER BY first) AS ranking FROM (
  SELECT query_id, vec_id, min(rank) AS first FROM (""" + knn_sql(10) + """) GROUP BY ALL) GROUP BY query_id""")
def document_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's documents in order of their first hit."""
    hits = nearest(*sides(spark, sf_dir), 10, others=True)
    first = hits.withColumn("first", F.min("rank").over(Window.partitionBy("query_id", "id"))).select("query_id", "id", "first").distinct()
    ordered = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("first", "id"))).alias("x"))
    return ordered.select("query_id", F.array_join(F.transform("x", lambda p: p["id"].cast("string")), " ").alias("ranking"))
