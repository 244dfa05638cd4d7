"""Scores of answers and evidence, and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text import normal_name


def _within(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def evidence_recall(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, evidence_recall): share of each query's evidence that a result matches.

    wanted (query_id, evidence_id, expected, locator), found (query_id, text, found_locator). Where both locator and text
    are given both must match: a locator as an equal or as a path above, a text as contained either way, without regard
    to case and white space. Every query of wanted has a row.
    """
    result = found.select("query_id", normal_name(F.col("text")).alias("__text"), F.col("found_locator").alias("__at"))
    asked = wanted.withColumn("__want", normal_name(F.col("expected")))
    text_fits = F.col("__want").isNull() | ((F.col("__want") != "") & (F.col("__text") != "") & _within(F.col("__text"), F.col("__want")))
    place_fits = F.col("locator").isNull() | (F.col("__at") == F.col("locator")) | F.startswith(F.col("__at"), F.concat("locator", F.lit("/")))
    some = F.col("__want").isNotNull() | F.col("locator").isNotNull()
    hit = F.coalesce(text_fits & place_fits & some, F.lit(False))
    each = asked.join(result, "query_id", "left").groupBy("query_id", "evidence_id").agg(F.max(hit.cast("int")).alias("hit"))
    return each.groupBy("query_id").agg(F.avg("hit").alias("evidence_recall"))


def answer_contains(answers: DataFrame, given: DataFrame) -> DataFrame:
    """(query_id, contains, exact): whether the given answer holds, or is, one of the expected, after normalisation."""
    both = answers.withColumn("a", normal_name(F.col("answer"))).join(given.withColumn("g", normal_name(F.col("given"))), "query_id", "left")
    return both.groupBy("query_id").agg(F.coalesce(F.max(F.contains("g", "a")), F.lit(False)).alias("contains"), F.coalesce(F.max(F.col("g") == F.col("a")), F.lit(False)).alias("exact"))


def summary(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, score, n, n_skipped): means at every level from all keys up to none; rolled-up keys are null."""
    return scores.rollup(*keys).agg(F.avg(value).alias("score"), F.count("*").alias("n"), F.count_if(F.col(value) == 0).alias("n_skipped"))
