"""Parsing: web pages, JSON fields, URLs, headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.plans.base import query, table
from siftstone.sources import html


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"), ["page_id", "url"], url_col="url")


@query(r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title's markup, in the JVM."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, 'article_' || substr(sha256(url), 1, 16) AS article_id FROM pages")
def page_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url(url, F.lit("HOST")).alias("host"), F.parse_url(url, F.lit("PATH")).alias("path"), T.short_id("article_", url).alias("article_id"))


@query("SELECT event_type, count(*)::BIGINT AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type")
def json_field_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query(r"SELECT page_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '^$', '') AS slug FROM pages")
def page_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("SELECT item_id, CASE WHEN length(text) <= 280 THEN text ELSE rtrim(substr(text, 1, 277)) || '...' END AS short FROM benchmark")
def shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.ellipsis(F.col("text")).alias("short"))
