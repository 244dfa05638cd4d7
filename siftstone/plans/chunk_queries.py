"""Chunking: token windows, lineage by range overlap, rechunking of joined pieces, repeated chunks within a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.operators import chunking
from siftstone.plans.base import query, table

FINE = {"size": 512, "overlap": 50}


def split_sql(name: str, source: str, key: str, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> str:
    """CTEs that leave `name`(key, chunk_index, token_start, token_end, text): one step of the recursion per window."""
    marks = "".join(chunking.MARKS).replace("\n", r"\n")

    def step(columns: str, start: str) -> str:
        window = f"substr(text, {start} + 1, {size})"
        cut = rf"length(regexp_extract({window}, '(?s)^.+[{marks}]'))"
        return f"SELECT {columns}, text, {start} AS a, CASE WHEN {start} + {size} >= length(text) THEN length(text) WHEN {cut} > 1 THEN {start} + {cut} ELSE {start} + {size} END AS b"

    return f"""
{name}_w AS (
  {step(key, "0::BIGINT")} FROM {source} WHERE regexp_matches(text, '\\S')
  UNION ALL
  {step(key, f"(b - {overlap})")} FROM {name}_w WHERE b < length(text) AND b - {overlap} > a
), {name} AS (
  SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY a) - 1)::BIGINT AS chunk_index, a AS token_start, b AS token_end, piece AS text
  FROM (SELECT *, regexp_replace(regexp_replace(substr(text, a + 1, b - a), '^\\s+', ''), '\\s+$', '') AS piece FROM {name}_w) WHERE piece <> ''
)"""


def with_ids(name: str, key: str) -> str:
    return f"(SELECT *, 'chunk_' || substr(sha256(concat_ws(chr(10), {key}, 0, chunk_index, text)), 1, 16) AS chunk_id FROM {name})"


def cut(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return chunking.chunks(table(spark, sf_dir, "documents"), "doc_id", **options)


@query(f"WITH RECURSIVE {split_sql('c', 'documents', 'doc_id')} SELECT doc_id AS document_id, 0::BIGINT AS page_index, chunk_index, chunk_id, token_start, token_end, text FROM {with_ids('c', 'doc_id')}")
def split_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(spark, sf_dir)


@query(f"""WITH RECURSIVE {split_sql('c', 'documents', 'doc_id')}, {split_sql('f', 'documents', 'doc_id', 512)}
SELECT f.chunk_id, string_agg(c.chunk_id, ' ' ORDER BY c.chunk_index) AS parents FROM {with_ids('f', 'doc_id')} f JOIN {with_ids('c', 'doc_id')} c ON c.doc_id = f.doc_id AND c.token_end > f.token_start AND c.token_start < f.token_end
GROUP BY f.chunk_id""")
def chunk_lineage_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.lineage(cut(spark, sf_dir), cut(spark, sf_dir, **FINE)).select("chunk_id", F.array_join("parent_chunk_ids", " ").alias("parents"))


@query(f"""WITH RECURSIVE placed AS (
  SELECT conv_id, (row_number() OVER w - 1)::BIGINT AS place, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)
), whole AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY place) AS text FROM placed GROUP BY conv_id), {split_sql('c', 'whole', 'conv_id', 512)}
SELECT c.conv_id, c.chunk_index, c.chunk_id, c.token_start, c.token_end, c.text, string_agg(p.place::VARCHAR, ' ' ORDER BY p.place) AS parents
FROM {with_ids('c', 'conv_id')} c JOIN placed p ON p.conv_id = c.conv_id AND p.a + length(p.text) > c.token_start AND p.a < c.token_end GROUP BY ALL""")
def rechunk_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.rechunk(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "text"], **FINE)
    return out.select(F.col("document_id").alias("conv_id"), "chunk_index", "chunk_id", "token_start", "token_end", "text", F.array_join(F.transform("parents", lambda x: x.cast("string")), " ").alias("parents"))


@query(f"""WITH RECURSIVE {split_sql('c', 'documents', 'doc_id', 512)}
SELECT doc_id, min(chunk_index) AS chunk_index, count(*)::BIGINT AS copies, sha256(text) AS content FROM c GROUP BY doc_id, sha256(text)""")
def chunk_distinct_in_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal chunks of one document the first stays."""
    hashed = cut(spark, sf_dir, **FINE).select(F.col("document_id").alias("doc_id"), "chunk_index", F.sha2("text", 256).alias("content"))
    return hashed.groupBy("doc_id", "content").agg(F.min("chunk_index").alias("chunk_index"), F.count("*").alias("copies"))


@query("""SELECT conv_id, count(*)::BIGINT AS pages, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id""")
def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("pages"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return lines.select("conv_id", "pages", F.array_join(F.transform("x", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n\n").alias("text"))


@query("""
SELECT p_brand, block, '| p_partkey | p_name | p_size |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || p_partkey || ' | ' || p_name || ' | ' || p_size || ' |', chr(10) ORDER BY p_partkey) AS text
FROM (SELECT *, ((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 50)::BIGINT AS block FROM part) GROUP BY p_brand, block""")
def markdown_rows_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.blocks(table(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_size"], ["p_partkey"], by=["p_brand"])


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM conversations""")
def carry_forward_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block without a page index takes that of the last one that had it."""
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(so_far).alias("page"))
