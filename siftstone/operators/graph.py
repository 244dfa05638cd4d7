"""Property graphs as tables: building nodes and edges, degrees, neighbourhoods, paths, trees, communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.checkpoint import materialize
from siftstone.operators import paths

SEPARATOR = "<SEP>"


def ordered_distinct(rows: DataFrame, by: list[str], value: str, position: str, out: str) -> DataFrame:
    """(by, out array): distinct values in order of first appearance; repeats are folded before they are collected."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(position).alias("__first"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__first", value))), lambda x: x[value]).alias(out))


def most_common(rows: DataFrame, by: list[str], value: str, position: str, out: str) -> DataFrame:
    """(by, out): each group's most frequent value, the first seen on ties."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"), F.min(position).alias("__first"))
    return counted.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("__n"), F.col("__first"))).alias(out))


def build_nodes(entities: DataFrame) -> DataFrame:
    """(name, type, description, source_ids, n) from (name, type, description, source_id, position): facts of one name are one node."""
    by = ["name"]
    out = entities.groupBy("name").agg(F.count("*").alias("n"))
    for part in (most_common(entities, by, "type", "position", "type"), ordered_distinct(entities, by, "description", "position", "descriptions"), ordered_distinct(entities, by, "source_id", "position", "source_ids")):
        out = out.join(part, "name", "left")
    return out.select("name", "type", F.array_join("descriptions", SEPARATOR).alias("description"), "source_ids", "n")


def canonical(edges: DataFrame, drop_self: bool = True) -> DataFrame:
    """edges with source and target in order; self-loops and null or blank ends leave with drop_self."""
    out = edges.withColumns({"source": F.least("source", "target"), "target": F.greatest("source", "target")})
    return out.where((F.col("source") != F.col("target")) & (F.col("source") != "") & (F.col("target") != "")) if drop_self else out


def build_edges(relations: DataFrame, drop_self: bool = True) -> DataFrame:
    """(source, target, weight, type, n) from (source, target, weight, type, position): one undirected edge per pair.

    A weight that is null or 0 counts as 1.
    """
    pairs = canonical(relations, drop_self)
    weight = F.when(F.coalesce(F.col("weight"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("weight"))
    each = pairs.groupBy("source", "target", "type").agg(F.sum(weight).alias("weight"), F.count("*").alias("n"), F.min("position").alias("first"))
    return each.groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.min_by("type", F.struct(-F.col("n"), F.col("first"))).alias("type"), F.sum("n").alias("n"))


def ends(edges: DataFrame, *more: str | Column) -> DataFrame:
    """(node, other, more): each edge from both of its ends; a self-loop once."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), *more)
    return out.unionByName(edges.where("source <> target").select(F.col("target").alias("node"), F.col("source").alias("other"), *more))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, neighbours): edges that touch a node, and its distinct neighbours."""
    return ends(edges).groupBy("node").agg(F.count("*").alias("degree"), F.count_distinct("other").alias("neighbours"))


def edge_ranks(edges: DataFrame) -> DataFrame:
    """edges with rank, the sum of their ends' degrees."""
    d = degrees(edges).select("node", "degree")
    out = edges.join(d.select(F.col("node").alias("source"), F.col("degree").alias("a")), "source").join(d.select(F.col("node").alias("target"), F.col("degree").alias("b")), "target")
    return out.withColumn("rank", F.col("a") + F.col("b")).drop("a", "b")


def incident(edges: DataFrame, nodes: DataFrame, n: int, order: list[Column], *more: str) -> DataFrame:
    """(node, other, more, place): the first n edges of each of `nodes`. Two equi-joins, never a join with OR."""
    touched = ends(edges, *more).join(nodes.select("node").distinct(), "node", "left_semi")
    return touched.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(*order))).where(F.col("place") <= n)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges whose ends are both in nodes (node)."""
    known = nodes.select("node").distinct()
    return edges.join(known.withColumnRenamed("node", "source"), "source", "left_semi").join(known.withColumnRenamed("node", "target"), "target", "left_semi").select(*edges.columns)


def between(edges: DataFrame, members: DataFrame) -> DataFrame:
    """edges between different groups of members (node, grp), either orientation: (a, b, edge columns), a < b."""
    left, right = members.select(F.col("node").alias("source"), F.col("grp").alias("ga")), members.select(F.col("node").alias("target"), F.col("grp").alias("gb"))
    met = edges.join(left, "source").join(right, "target").where("ga <> gb")
    return met.select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b"), *edges.columns)


def neighbours(edges: DataFrame) -> DataFrame:
    """(at, to): each edge both ways, once, without self-loops; written."""
    return materialize(ends(edges.where("source <> target")).select(F.col("node").alias("at"), F.col("other").alias("to")).distinct())


def path_lengths(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, target, steps) for each distinct pair of wanted; steps is null where there is no path."""
    near, pairs = neighbours(edges), materialize(wanted.select("source", "target").distinct())
    found = paths.held(near, pairs, False)
    found = paths.grown(near, pairs) if found is None else found
    return pairs.join(found, ["source", "target"], "left").select("source", "target", F.when(F.col("source") == F.col("target"), F.lit(0).cast("bigint")).otherwise(F.col("steps")).alias("steps"))


def shortest_paths(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, target, path) for each distinct pair of wanted; of equally short paths the least; [source, target] where there is none."""
    near, pairs = neighbours(edges), materialize(wanted.select("source", "target").distinct())
    found = paths.held(near, pairs, True)
    found = breadth_first(near, pairs) if found is None else found.drop("steps")
    itself = F.when(F.col("source") == F.col("target"), F.array("source"))
    return pairs.join(found, ["source", "target"], "left").withColumn("path", F.coalesce("path", itself, F.array("source", "target")))


def breadth_first(near: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, path) of what the sources reach, for graphs that no task can hold.

    All sources at once: each round is one join of the frontier, and reached nodes leave the search.
    It ends when every pair is found or the frontier is empty, however long the paths are.
    """
    frontier = materialize(pairs.select("source").distinct().select("source", F.col("source").alias("at"), F.array("source").alias("path")))
    seen = frontier
    while True:
        step = frontier.join(near, "at").select("source", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
        frontier = materialize(step.join(seen, ["source", "at"], "left_anti").groupBy("source", "at").agg(F.min("path").alias("path")))
        if frontier.isEmpty():
            break
        seen = materialize(seen.unionByName(frontier))
        if pairs.join(seen, (pairs.source == seen.source) & (pairs.target == seen["at"]), "left_anti").isEmpty():
            break
    return seen.select("source", F.col("at").alias("target"), "path")


def ancestors(parents: DataFrame, nodes: DataFrame, depth: int, root: str = "root") -> DataFrame:
    """(node, place, ancestor): each node at place 0, then its parents up to the root, itself, a missing one, or depth.

    parents (node, parent). The depth is bounded, so the chain is that many joins in one plan; a cycle ends at the bound.
    """
    up = parents.select(F.col("node").alias("ancestor"), "parent")
    level = nodes.select("node", F.lit(0).alias("place"), F.col("node").alias("ancestor"))
    out = level
    for place in range(1, depth + 1):
        going = level.where((F.col("ancestor") != root)).join(up, "ancestor").where("parent <> ancestor")
        level = going.select("node", F.lit(place).alias("place"), F.col("parent").alias("ancestor"))
        out = out.unionByName(level)
    return out


def common_ancestors(chains: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ancestor, up, down): the first ancestor of a that is also one of b, and the steps from each."""
    left = chains.select(F.col("node").alias("a"), "ancestor", F.col("place").alias("up"))
    right = chains.select(F.col("node").alias("b"), "ancestor", F.col("place").alias("down"))
    met = pairs.select("a", "b").distinct().join(left, "a").join(right, ["b", "ancestor"])
    return met.groupBy("a", "b").agg(F.min(F.struct("up", "down", "ancestor")).alias("m")).select("a", "b", "m.ancestor", "m.up", "m.down")


def occurrence(members: DataFrame) -> DataFrame:
    """(community, chunks, occurrence) of (community, chunk_id): distinct chunks, and their share of the largest community's."""
    each = members.groupBy("community").agg(F.count_distinct("chunk_id").alias("chunks"))
    most = each.agg(F.greatest(F.max("chunks"), F.lit(1)).alias("most"))
    return each.crossJoin(F.broadcast(most)).select("community", "chunks", (F.col("chunks") / F.col("most")).alias("occurrence"))


def sub_communities(members: DataFrame) -> DataFrame:
    """(community, sub_community) of (level, community, node): communities one level below whose nodes all lie in it.

    Containment by counting: an equi-join on node and level, then common nodes against the child's size.
    """
    size = members.groupBy("level", "community").agg(F.count_distinct("node").alias("size"))
    child = members.join(size, ["level", "community"]).select((F.col("level") - 1).alias("level"), F.col("community").alias("sub_community"), "node", "size").distinct()
    met = members.select("level", "community", "node").distinct().join(child, ["level", "node"])
    return met.groupBy("community", "sub_community", "size").agg(F.count("*").alias("common")).where("common = size").select("community", "sub_community")


def overlaps(queries: DataFrame, members: DataFrame, min_common: int = 1) -> DataFrame:
    """(query_id, community, overlap) of (query_id, node) and (community, node): common nodes."""
    met = queries.select("query_id", "node").distinct().join(members.select("community", "node").distinct(), "node")
    return met.groupBy("query_id", "community").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= min_common)


def sparsity(members: DataFrame) -> DataFrame:
    """(n, clusters, sparsity) of (node, cluster): 1 - sum s(s-1) / (n(n-1)); 1 for fewer than two nodes."""
    size = members.groupBy("cluster").agg(F.count("*").alias("s"))
    total = size.agg(F.sum("s").alias("n"), F.count("*").alias("clusters"), F.sum(F.col("s") * (F.col("s") - 1)).alias("inside"))
    return total.select("n", "clusters", F.when(F.col("n") < 2, F.lit(1.0)).otherwise(1 - F.col("inside") / (F.col("n") * (F.col("n") - 1))).alias("sparsity"))


def chunk_votes(facts: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, votes, place) of (query_id, position, chunk_id): chunks of several facts first, by count, then in first-seen order."""
    each = facts.groupBy("query_id", "chunk_id").agg(F.count("*").alias("votes"), F.min("position").alias("first"))
    order = [F.when(F.col("votes") > 1, -F.col("votes")).otherwise(F.lit(0)).asc(), F.asc("first"), F.asc("chunk_id")]
    return each.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= k).drop("first")
