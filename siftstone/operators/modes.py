"""Query modes: what each way of asking retrieves, for a whole table of queries at once.

Tables: entities (id, vector), relations (id, source, target, weight, vector), fact_chunks (id, chunk_id), members
(community, node), reports (community, level, rating, occurrence, text), parents (node, parent), chunks (id, vector).
Queries: (query_id, query_vector). Every mode gives rows (query_id, section, place, id, score), place from 1 within a
section; ids are integers. Nothing is collected: a model that writes answers gets the rendered rows afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.checkpoint import materialize
from siftstone.operators import graph, search
from siftstone.operators.knn import nearest

#: What a fact reached over an edge keeps of its score.
HOP = 0.95
RESULT = ("query_id", "section", "place", "id", "score")


@dataclass
class Knowledge:
    """The tables that the modes read; those that a mode doesn't need may be None."""

    entities: DataFrame | None = None
    relations: DataFrame | None = None
    fact_chunks: DataFrame | None = None
    members: DataFrame | None = None
    reports: DataFrame | None = None
    parents: DataFrame | None = None
    chunks: DataFrame | None = None


def section(rows: DataFrame, name: str, order: list[Column], limit: int | None = None, by: str = "query_id") -> DataFrame:
    """Result rows of one section in the given order, the first `limit` of each query."""
    out = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("bigint"))
    out = out if limit is None else out.where(F.col("place") <= limit)
    return out.select("query_id", F.lit(name).alias("section"), "place", F.col("id").cast("bigint").alias("id"), F.col("score").cast("double").alias("score"))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hits(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank); no rows for k = 0."""
    return nearest(vectors.select("id", "vector"), queries.select("query_id", "query_vector"), k)


def _edges(relations: DataFrame) -> DataFrame:
    return graph.ends(relations, "id", "weight")


def hop_relations(found: DataFrame, relations: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """(query_id, id, score, rank, nth): the first n relations of each entity hit."""
    near = found.select("query_id", F.col("id").alias("node"), "score", "rank").join(_edges(relations), "node")
    return near.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "node").orderBy(*order))).where(F.col("nth") <= n).select("query_id", "id", "score", "rank", "nth", "weight")


def endpoint_entities(found: DataFrame, relations: DataFrame) -> DataFrame:
    """(query_id, id, score, rank, side) of the entities at the ends of relation hits."""
    joined = found.join(relations.select("id", "source", "target"), "id")
    return joined.select("query_id", "score", "rank", F.posexplode(F.array("source", "target")).alias("side", "node")).select("query_id", F.col("node").alias("id"), "score", "rank", "side")


def _first_seen(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per query and id, at the least of `order`, with its best score."""
    seen = F.min(F.struct(*order)).alias("seen")
    return rows.groupBy("query_id", "id").agg(seen, F.max("score").alias("score")).select("query_id", "id", "score", "seen.*")


def chunk_section(facts: DataFrame, fact_chunks: DataFrame, k: int, name: str = "chunk") -> DataFrame:
    """Chunks of the facts (query_id, id, rank): those of several facts first, by count, then in first-seen order."""
    votes = graph.chunk_votes(facts.select("query_id", "id", F.col("rank").alias("position")).join(fact_chunks, "id").select("query_id", "position", "chunk_id"), k)
    return votes.select("query_id", F.lit(name).alias("section"), F.col("place").cast("bigint").alias("place"), F.col("chunk_id").cast("bigint").alias("id"), F.col("votes").cast("double").alias("score"))


def community_section(found: DataFrame, members: DataFrame, reports: DataFrame, k: int) -> DataFrame:
    """Communities of the entity hits by overlap, rating, occurrence, then level and id."""
    met = graph.overlaps(found.select("query_id", F.col("id").alias("node")), members).join(reports.drop("text"), "community")
    order = [F.desc("overlap"), F.desc("rating"), F.desc("occurrence"), F.desc("level"), F.asc("id")]
    return section(met.select("*", F.col("community").alias("id"), F.col("overlap").alias("score")), "community", order, k)


def vector_search(know: Knowledge, queries: DataFrame, k: int = 10) -> DataFrame:
    return section(hits(know.chunks, queries, k), "chunk", [F.asc("rank")])


def graph_search(know: Knowledge, queries: DataFrame, k: int = 10, expand: int = 20) -> DataFrame:
    """Half of k entity hits with their relations, the rest relation hits with their ends; the best score of a fact counts."""
    half = k // 2
    found = hits(know.entities, queries, half)
    related = hits(know.relations, queries, k - half)
    hops = hop_relations(found, know.relations, expand, [F.asc("id")])
    ends = endpoint_entities(related, know.relations)

    def fact(rows: DataFrame, kind: str, factor: float) -> DataFrame:
        return rows.select("query_id", F.lit(kind).alias("kind"), "id", F.round(F.col("score") * factor, 6).alias("score"))

    facts = union(fact(found, "entity", 1.0), fact(hops, "relation", HOP), fact(related, "relation", 1.0), fact(ends, "entity", HOP))
    best = facts.groupBy("query_id", "kind", "id").agg(F.max("score").alias("score"))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "kind", "id")).cast("bigint")).where(F.col("place") <= k)
    return placed.select("query_id", F.col("kind").alias("section"), "place", F.col("id").cast("bigint").alias("id"), "score")


def fuse_modes(results: list[DataFrame], k: int, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of modes' results; equal ids of different sections are different facts."""
    weights = weights or [1.0] * len(results)
    lists = union(*[r.select("query_id", F.lit(i).alias("list_no"), F.col("place").alias("rank"), F.struct("section", "id").alias("id"), F.lit(w).alias("weight")) for i, (r, w) in enumerate(zip(results, weights, strict=True))])
    fused = search.fuse(lists).withColumn("score", F.round("score", 6))
    best = search.top_k(fused, k, order=[F.desc("score"), F.asc("first_list"), F.asc("first_rank"), F.asc("id")])
    return best.select("query_id", "id.section", F.col("rank").cast("bigint").alias("place"), "id.id", "score")


def depth(k: int) -> int:
    """Candidates that each mode contributes to a fusion."""
    return min(max(3 * k, k), 50)


def hybrid_search(know: Knowledge, queries: DataFrame, k: int = 10, weights: list[float] | None = None) -> DataFrame:
    return fuse_modes([vector_search(know, queries, depth(k)), graph_search(know, queries, depth(k))], k, weights)


def community_local(know: Knowledge, queries: DataFrame, k: int = 10, per_entity: int = 5, communities: int = 3, chunks: int = 5) -> DataFrame:
    """Entity hits, their heaviest relations, the communities that hold them, the chunks they come from."""
    found = hits(know.entities, queries, k)
    hops = _first_seen(hop_relations(found, know.relations, per_entity, [F.desc("weight"), F.asc("id")]).select("query_id", "id", F.col("weight").alias("score"), "rank", "nth"), ["rank", "nth"])
    return union(
        section(found, "entity", [F.asc("rank")]), section(hops, "relation", [F.desc("score"), F.desc("id")]),
        community_section(found, know.members, know.reports, communities), chunk_section(found, know.fact_chunks, chunks),
    )


def community_global(reports: DataFrame, level: int, min_rating: float = 0.0, limit: int = 512, budget: int = 8000) -> DataFrame:
    """(grp, place, community): reports up to a level, the most frequent and best rated first, in groups for a model's map step.

    The limit is part of the mode; a longer report than the budget is a group of its own.
    """
    kept = reports.where((F.col("level") <= level) & (F.coalesce("rating", F.lit(0.0)) >= min_rating))
    placed = kept.orderBy(F.desc("occurrence"), F.desc("rating"), "community").limit(limit).withColumn("place", F.row_number().over(Window.orderBy(F.desc("occurrence"), F.desc("rating"), "community")))
    grouped = search.budget_groups(placed.select(F.lit(0).alias("all"), "place", F.length("text").alias("n")), "all", "place", "n", budget)
    return placed.join(grouped.select("place", "grp"), "place").select("grp", F.col("place").cast("bigint").alias("place"), "community")


def keyword_graph(know: Knowledge, low: DataFrame, high: DataFrame, mode: str = "hybrid", k: int = 10, per_entity: int = 5, chunks: int = 5) -> DataFrame:
    """low keywords find entities and their relations, high ones relations and their ends; both take turns in hybrid and mix.

    mode: local (low only), global (high only), hybrid, or mix, which adds chunks near the low query.
    """
    if mode not in ("local", "global", "hybrid", "mix"):
        raise ValueError(f"unknown mode: {mode}")
    entity_lists, relation_lists = [], []
    if mode != "global":
        found = hits(know.entities, low, k)
        entity_lists.append(found.select("query_id", F.lit(1).alias("list_no"), "rank", "id", "score"))
        hops = _first_seen(hop_relations(found, know.relations, per_entity, [F.desc("weight"), F.asc("id")]).select("query_id", "id", "score", "rank", "nth"), ["rank", "nth"])
        relation_lists.append(hops.select("query_id", F.lit(1).alias("list_no"), F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "nth", "id")).alias("rank"), "id", "score"))
    if mode != "local":
        related = hits(know.relations, high, k)
        relation_lists.append(related.select("query_id", F.lit(2).alias("list_no"), "rank", "id", "score"))
        ends = _first_seen(endpoint_entities(related, know.relations), ["rank", "side"])
        entity_lists.append(ends.select("query_id", F.lit(2).alias("list_no"), F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "side")).alias("rank"), "id", "score"))
    entities, relations = (search.interleave(union(*x)) for x in (entity_lists, relation_lists))
    out = [section(entities, "entity", [F.asc("position")]), section(relations, "relation", [F.asc("position")]), chunk_section(entities.select("query_id", "id", F.col("position").alias("rank")), know.fact_chunks, chunks)]
    if mode == "mix":
        out.append(section(hits(know.chunks, low, k), "near_chunk", [F.asc("rank")]))
    return union(*out)


def hierarchy(know: Knowledge, queries: DataFrame, branch: str = "full", k: int = 10, communities: int = 3, chunks: int = 5, relations: int = 10) -> DataFrame:
    """Hierarchical mode: entity hits with, by branch, their communities (global), relations and chunks (local), and the
    path that joins the key entities, with the edges among its nodes (bridge); nobridge has local and global, full all.
    """
    wide = 10 * k if branch in ("global", "full") else k
    found = materialize(hits(know.entities, queries, wide))
    held = materialize(know.relations.select("id", "source", "target", "weight"))
    top = found.where(F.col("rank") <= k)
    out = [section(top, "entity", [F.asc("rank")])]
    if branch in ("local", "nobridge", "full"):
        order = [F.desc("score"), F.desc("weight"), F.asc("id")]
        ranked = graph.edge_ranks(held).withColumnRenamed("rank", "score")
        first = materialize(search.top_k(graph.ends(ranked, "id", "weight", "score"), relations, "node", order).select("node", "id", "weight", "score"))
        near = top.select("query_id", F.col("id").alias("node")).join(first, "node").select("query_id", "id", "weight", "score").distinct()
        out.append(section(near, "relation", order, relations))
        out.append(chunk_section(top, know.fact_chunks, chunks))
    if branch in ("global", "nobridge", "full"):
        out.append(community_section(found, know.members, know.reports, communities))
    if branch in ("bridge", "full"):
        out += bridge(know.entities, held, found, min(k, 4))
    return union(*out)


def bridge(entities: DataFrame, relations: DataFrame, found: DataFrame, keys: int) -> list[DataFrame]:
    """The path through each query's first `keys` entities, and the relations between its nodes."""
    known = materialize(graph.induced(relations, entities.select(F.col("id").alias("node"))))
    chosen = found.where(F.col("rank") <= keys).select("query_id", "rank", "id")
    steps = materialize(chosen.select("query_id", "rank", F.col("id").alias("source")).join(chosen.select("query_id", (F.col("rank") - 1).alias("rank"), F.col("id").alias("target")), ["query_id", "rank"]))
    paths = steps.join(graph.shortest_paths(known, steps), ["source", "target"])
    walked = materialize(paths.select("query_id", "rank", F.posexplode("path").alias("at", "id")).groupBy("query_id", "id").agg(F.min(F.struct("rank", "at")).alias("seen")).select("query_id", "id", "seen.*", F.lit(1.0).alias("score")))
    return [section(walked, "path", [F.asc("rank"), F.asc("at")]), section(_among(known, walked.select("query_id", "id")), "path_relation", [F.desc("score"), F.asc("id")])]


def _among(known: DataFrame, on: DataFrame) -> DataFrame:
    """(query_id, id, score) of relations between nodes (query_id, id) of one query: by its pairs of nodes, or by its nodes' relations where those are fewer."""
    degree = known.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("degree"))
    size = on.join(degree, "id", "left").groupBy("query_id").agg((F.count("*") * F.count("*") <= F.coalesce(F.sum("degree"), F.lit(0))).alias("paired"))
    sized = materialize(on.join(size, "query_id"))
    targets = on.withColumnRenamed("id", "target")
    few, many = (sized.where(x).select("query_id", F.col("id").alias("source")) for x in ("paired", "not paired"))
    met = few.join(targets, "query_id").join(known, ["source", "target"]).unionByName(many.join(known, "source").join(targets, ["query_id", "target"]))
    return met.select("query_id", "id", F.col("weight").alias("score"))


def tree_query(know: Knowledge, queries: DataFrame, k: int = 5, depth_: int = 6, chunks: int = 5) -> DataFrame:
    """Entity hits, the aggregates above them (parents: node, parent; ids as text), relations between hits, and chunks by vote."""
    found = hits(know.entities, queries, k)
    chains = graph.ancestors(know.parents, found.select(F.col("id").cast("string").alias("node")).distinct(), depth_)
    above = found.withColumn("node", F.col("id").cast("string")).join(chains.where("place > 0 and ancestor <> 'root'"), "node")
    aggregates = above.groupBy("query_id", "ancestor").agg(F.count("*").alias("score"), F.min("rank").alias("first")).withColumn("id", F.regexp_extract("ancestor", r"(\d+)$", 1).cast("bigint"))
    among = found.select("query_id", F.col("id").alias("source")).join(know.relations.select("id", "source", "target", "weight"), "source").join(found.select("query_id", F.col("id").alias("target")), ["query_id", "target"])
    return union(
        section(found, "entity", [F.asc("rank")]), section(aggregates, "aggregate", [F.desc("score"), F.asc("first"), F.asc("ancestor")]),
        section(among.select("query_id", "id", F.col("weight").alias("score")), "relation", [F.desc("score"), F.asc("id")]), chunk_section(found, know.fact_chunks, chunks),
    )


def render(results: DataFrame, texts: DataFrame, budget: int) -> DataFrame:
    """(query_id, context): the results' texts (section, id, text) as lines in order, up to the budget of characters for each section."""
    lines = results.join(texts, ["section", "id"]).withColumn("n", F.length("text"))
    kept = search.budget_prefix(lines, ["query_id", "section"], [F.asc("place")], "n", budget)
    items = F.array_sort(F.collect_list(F.struct("section", "place", "text")))
    return kept.groupBy("query_id").agg(F.array_join(F.transform(items, lambda x: F.concat(F.lit("["), x["section"], F.lit("] "), x["text"])), "\n").alias("context"))


def rewritten(find, variants: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of what find(queries) gives for each wording: variants (query_id, variant, text).

    find takes (query_id, text) and gives (query_id, id, score, rank); all wordings are answered in one job.
    """
    asked = variants.select(F.concat_ws("\x1f", F.col("query_id").cast("string"), F.col("variant").cast("string")).alias("asked"), "query_id", F.col("variant").alias("list_no"), "text")
    found = find(asked.select(F.col("asked").alias("query_id"), "text")).withColumnRenamed("query_id", "asked")
    lists = found.join(asked.drop("text"), "asked").select("query_id", "list_no", "rank", "id", F.lit(1.0).alias("weight"))
    fused = search.fuse(lists).withColumn("score", F.round("score", 6))
    return search.top_k(fused, k, order=[F.desc("score"), F.asc("first_list"), F.asc("first_rank"), F.asc("id")]).select("query_id", "id", "score", "rank")


def multihop(find, follow, queries: DataFrame, rounds: int = 3, k: int = 10) -> DataFrame:
    """(query_id, id, score, hop): results of up to `rounds` questions in a row, each id at its best score.

    find as above; follow(queries, results) gives the next (query_id, text) of the queries that aren't answered yet.
    """
    asked, out = queries.select("query_id", "text"), None
    for hop in range(rounds):
        found = materialize(find(asked))
        tagged = found.select("query_id", "id", "score", F.lit(hop).alias("hop"))
        out = tagged if out is None else out.unionByName(tagged)
        if hop + 1 < rounds:
            asked = materialize(follow(asked, found))
            if asked.isEmpty():
                break
    best = out.groupBy("query_id", "id").agg(F.max(F.struct("score", -F.col("hop"))).alias("m"))
    return search.top_k(best.select("query_id", "id", "m.score", (-F.col("m.col2")).alias("hop")), k)
