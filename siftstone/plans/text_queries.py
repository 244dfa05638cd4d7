"""Full text: hashes, tokens, postings, BM25, substring search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.operators import fulltext, search
from siftstone.plans.base import query, table

TOKENS = r"regexp_extract_all(lower(text), '[\pL\pN_]+')"
SEARCHED, LANGUAGE = "the", "en"


def named(best: DataFrame) -> DataFrame:
    return best.select(F.col("query_id").alias("item_id"), F.col("rank").cast("bigint").alias("rank"), F.col("id").alias("doc_id"), "score")


def bm25_sql(where: str = "true") -> str:
    """CTE scored(item_id, doc_id, score): BM25 of every benchmark passage over the documents that fit."""
    return f"""
tok AS (SELECT doc_id, {TOKENS} AS w FROM documents WHERE {where}),
stats AS (SELECT count(*)::DOUBLE AS n, avg(coalesce(len(w), 0)) AS avg_len FROM tok),
post AS (SELECT doc_id, term, len::DOUBLE AS len, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term),
asked AS (SELECT item_id, term, count(*)::DOUBLE AS weight FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)))), 6) AS score
  FROM post JOIN asked USING (term) JOIN df USING (term), stats GROUP BY item_id, doc_id
)"""


def top_sql(source: str, k: int) -> str:
    return f"SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM {source} WHERE score > 0) WHERE rank <= {k}"


ALL_TERMS_SQL = f"""
ltok AS (SELECT doc_id, {TOKENS} AS w FROM documents),
lpost AS (SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM ltok) GROUP BY ALL),
lasked AS (SELECT item_id, term FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
need AS (SELECT item_id, count(*) AS need FROM lasked GROUP BY item_id),
lexical AS (
  SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT item_id, doc_id, count(*) AS have, sum(tf / (1 + ln(len))) AS score FROM lpost JOIN lasked USING (term) GROUP BY ALL) JOIN need USING (item_id) WHERE have = need
)"""


def best_passages(spark: SparkSession, sf_dir: str, k: int, where: str = "true", kind: str = "bm25") -> DataFrame:
    return fulltext.rankings(table(spark, sf_dir, "documents").where(where), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", k, (kind,))[0]


@query("SELECT doc_id, 'doc_' || substr(sha256(text), 1, 16) AS document_id FROM documents")
def doc_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.document_id(F.col("text").cast("binary")).alias("document_id"))


@query(rf"SELECT doc_id, len({TOKENS})::BIGINT AS n_tokens, len(regexp_extract_all(text, '\S+'))::BIGINT AS n_words FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("bigint").alias("n_tokens"), T.count_words(F.col("text")).cast("bigint").alias("n_words"))


@query(f"SELECT doc_id, term, count(*)::BIGINT AS tf, len::BIGINT AS len FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM (SELECT doc_id, {TOKENS} AS w FROM documents)) GROUP BY doc_id, term, len")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "term", "tf", F.col("len").cast("bigint").alias("len"))


@query(f"""
SELECT term, df, cf FROM (
  SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS cf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term
) ORDER BY df DESC, term LIMIT 100""")
def term_df_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).orderBy(F.desc("df"), "term").limit(100)


@query(f"WITH {bm25_sql()} {top_sql('scored', 10)}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(best_passages(spark, sf_dir, 10))


@query(f"WITH {bm25_sql(f"lang = '{LANGUAGE}'")} {top_sql('scored', 10)}")
def bm25_filtered_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics over the filtered records, as the metadata filter comes first."""
    return named(best_passages(spark, sf_dir, 10, f"lang = '{LANGUAGE}'"))


@query(f"SELECT doc_id, CASE WHEN lower(text) = '{SEARCHED}' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM documents WHERE lower(text) LIKE '%{SEARCHED}%'")
def sql_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.text_match(table(spark, sf_dir, "documents"), "doc_id", "text", SEARCHED).withColumnRenamed("id", "doc_id")


@query(f"WITH {ALL_TERMS_SQL} {top_sql('lexical', 10)}")
def all_terms_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(best_passages(spark, sf_dir, 10, kind="all_terms"))


@query("SELECT conv_id, turn, 'chunk_' || substr(sha256(concat_ws(chr(10), conv_id, turn, 0, text)), 1, 16) AS chunk_id FROM conversations")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.chunk_id(F.col("conv_id"), F.col("turn"), F.lit(0), F.col("text")).alias("chunk_id"))
