"""Facts and where they come from: selections, counts, merges of hierarchy rows, provenance, and model records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import text as T


def by_level(entities: DataFrame, mode: int, flag: str = "is_aggregate") -> DataFrame:
    """Entities of a level mode: 0 base ones, 1 aggregates, 2 all; a null flag counts as base."""
    if mode not in (0, 1, 2):
        raise ValueError(f"no level mode {mode}")
    aggregate = F.coalesce(F.col(flag), F.lit(False))
    return entities if mode == 2 else entities.where(aggregate == F.lit(mode == 1))


def relation_counts(relations: DataFrame, selected: DataFrame) -> DataFrame:
    """(id, relations) of each selected id: on how many relations (source, target) it stands, a self-loop once; 0 where on none."""
    ends = relations.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))
    counted = ends.join(selected.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("relations"))
    return selected.select("id").distinct().join(counted, "id", "left").select("id", F.coalesce("relations", F.lit(0)).cast("bigint").alias("relations"))


def named_nodes(nodes: DataFrame, ids: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes (id, name, ...) whose id is among ids or whose name is among names, each once."""
    asked = ids.select(F.col("id").cast("string").alias("k"), F.lit("id").alias("by")).unionByName(names.select(F.col("name").alias("k"), F.lit("name").alias("by"))).distinct()
    hit = nodes.select("id", F.explode(F.array(F.struct(F.col("id").cast("string").alias("k"), F.lit("id").alias("by")), F.struct(F.col("name").alias("k"), F.lit("name").alias("by")))).alias("x"))
    found = hit.select("id", "x.k", "x.by").join(asked, ["k", "by"], "left_semi").select("id").distinct()
    return nodes.join(found, "id", "left_semi")


def uncovered(rows: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a community whose keys no report on one of its parts covers already."""
    return rows.join(reports.select(*keys).distinct(), keys, "left_anti")


def merge_hier_nodes(nodes: DataFrame) -> DataFrame:
    """One node of each id: most common type (the least of equally common ones), sorted distinct descriptions and sources, least layer, whether any is a summary, cluster of the first row by `seen`."""
    kinds = nodes.groupBy("id", "type").agg(F.count("*").alias("n"))
    kind = kinds.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("type").isNull().alias("none"), "type")).alias("k")).select("id", F.col("k.type").alias("type"))
    rest = nodes.groupBy("id").agg(
        F.sort_array(F.collect_set("description")).alias("descriptions"), F.sort_array(F.collect_set("source_id")).alias("source_ids"), F.min("layer").alias("layer"),
        F.coalesce(F.bool_or("is_summary"), F.lit(False)).alias("is_summary"), F.min(F.struct("seen", "cluster")).getField("cluster").alias("cluster"),
    )
    return rest.join(kind, "id")


def merge_hier_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): one edge of each pair in either direction with its weights' sum and least order, and the nodes with those ends that lacked one (type unknown)."""
    pair = edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "weight", "order")
    merged = pair.groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.min("order").alias("order"))
    ends = merged.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    missing = ends.join(nodes, "id", "left_anti").withColumn("type", F.lit("unknown"))
    return merged, nodes.unionByName(missing, allowMissingColumns=True)


def document_rollup(facts: DataFrame, key: str) -> DataFrame:
    """(key, documents, names, tokens, token_sum) of facts (key, document_id, document_name, tokens): distinct documents in order, maps of their names and tokens, and the tokens' sum, each document once (its least name and most tokens)."""
    each = facts.where(F.col("document_id").isNotNull()).groupBy(key, "document_id").agg(F.min("document_name").alias("name"), F.max("tokens").alias("tokens"))
    entry = F.sort_array(F.collect_list(F.struct("document_id", "name", "tokens")))
    rolled = each.groupBy(key).agg(entry.alias("x"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("token_sum"))
    return rolled.select(key, F.col("x.document_id").alias("documents"), F.map_from_arrays("x.document_id", "x.name").alias("names"), F.map_from_arrays("x.document_id", "x.tokens").alias("tokens"), "token_sum")


def aligned(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks (chunk_id, document_id, ...) with their vector; an error where a chunk has none, more than one, or one of another document."""
    held = vectors.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("document_id").alias("d0"), F.max("document_id").alias("d1"))
    faults = chunks.join(held, "chunk_id", "left").agg(
        F.count(F.when(F.col("n").isNull(), 1)).alias("missing"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"),
        F.count(F.when((F.col("d0") != F.col("document_id")) | (F.col("d1") != F.col("document_id")), 1)).alias("mismatched"),
    ).first()
    if any(faults):
        raise ValueError(f"vectors don't match chunks: {faults['missing']} missing, {faults['repeated']} repeated, {faults['mismatched']} of another document")
    return chunks.join(vectors.select("chunk_id", "vector"), "chunk_id")


def fact_sources(facts: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, issues) of facts (fact_id, source_chunk_ids): the chunk rows each fact names, in its order (nth), and the names that no chunk has."""
    named = facts.select("fact_id", F.posexplode("source_chunk_ids").alias("nth", "chunk_id"))
    both = named.join(chunks.withColumn("__known", F.lit(True)), "chunk_id", "left")
    issues = both.where(F.col("__known").isNull()).select("fact_id", "nth", "chunk_id", F.concat(F.lit("no chunk "), F.coalesce("chunk_id", F.lit("(null)"))).alias("issue"))
    return both.where("__known").drop("__known"), issues


def provenance(**parts: Column) -> Column:
    """JSON object of a result's origin (document, chunk, page, offsets, object key ...), without the parts that are null."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in parts.items()]))


def _between(text: Column, left: str, right: str) -> Column:
    return F.regexp_extract(text, rf"(?s){re.escape(left)}(.*){re.escape(right)}", 1)


def delimiter_records(replies: DataFrame, keys: list[str], text_col: str = "reply", record: str = "##", done: str = "<|COMPLETE|>", part: str = "<|>") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, trace) of model replies made of records (kind<|>field<|>...) parted by ##.

    entity: name, type, description (4 parts at least); relationship: source, target, description, weight (5 at least,
    the last part if it is a number, else 1.0). Names are trimmed, without quotes, in capitals. Relations with a blank
    end or to themselves, and records of any other shape, are in the trace.
    """
    pieces = F.split(F.coalesce(F.col(text_col), F.lit("")), f"{re.escape(record)}|{re.escape(done)}")
    rows = replies.select(*keys, F.posexplode(pieces).alias("nth", "piece")).where(F.trim("piece") != "")
    fields = F.transform(F.split(_between(F.col("piece"), "(", ")"), re.escape(part)), lambda x: F.regexp_replace(T.strip(x), "^[\"']+|[\"']+$", ""))
    rows = rows.withColumn("f", fields).withColumn("kind", F.lower(F.element_at("f", 1)))
    size = F.size("f")
    name = lambda k: F.upper(F.get("f", k))
    entity = (F.col("kind") == "entity") & (size >= 4) & (F.get("f", 1) != "")
    relation = (F.col("kind") == "relationship") & (size >= 5) & (F.get("f", 1) != "") & (F.get("f", 2) != "") & (name(1) != name(2))
    weight = F.coalesce(F.try_to_number(F.when(F.element_at("f", -1).rlike(r"^\d{1,9}(\.\d{1,6})?$"), F.element_at("f", -1)), F.lit("999999999.999999")).cast("double"), F.lit(1.0))
    entities = rows.where(entity).select(*keys, "nth", name(1).alias("name"), name(2).alias("type"), F.get("f", 3).alias("description"))
    relations = rows.where(relation).select(*keys, "nth", name(1).alias("source"), name(2).alias("target"), F.get("f", 3).alias("description"), weight.alias("weight"))
    return entities, relations, rows.where(~F.coalesce(entity | relation, F.lit(False))).select(*keys, "nth", F.trim("piece").alias("record"))


def pairs(text: Column) -> Column:
    """(a, b) pairs of a model's list: lines "a || b", JSON pairs ["a", "b"], or "(a, b)"; sides trimmed, without quotes."""
    shapes = (r'(?m)^[\s\-*\d.]*([^|\n\[\(]+?)\s*\|\|\s*([^|\n]+?)\s*$', r'\[\s*"([^"]+)"\s*,\s*"([^"]+)"\s*\]', r"\(\s*([^(),\n]+?)\s*,\s*([^(),\n]+?)\s*\)")
    found = [F.arrays_zip(F.regexp_extract_all(text, F.lit(s), 1).alias("a"), F.regexp_extract_all(text, F.lit(s), 2).alias("b")) for s in shapes]
    clean = lambda c: F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")
    return F.array_distinct(F.transform(F.concat(*found), lambda x: F.struct(clean(x["a"]).alias("a"), clean(x["b"]).alias("b"))))
