"""Deduplicating and merging facts: exact and semantic groups, id mappings, upserts, incremental merges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.checkpoint import materialize
from siftstone.functions import text as T
from siftstone.functions import vectors as V
from siftstone.operators.components import components
from siftstone.operators.knn import pairs
from siftstone.operators.search import top_k


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those of equal keys; of new's rows of one key any must be as good as another."""
    latest = new.dropDuplicates(keys)
    return old.join(latest.select(*keys), keys, "left_anti").unionByName(latest, allowMissingColumns=True)


def exact_groups(facts: DataFrame, key: list[Column], member: str, name: str, prefix: str = "entity_") -> DataFrame:
    """(merged_id, name, members array, n): facts of equal key are one; a single fact keeps its own id as merged_id.

    The merged id is the hash of the trimmed name and the sorted member ids.
    """
    named = facts.select(*[k.alias(f"__k{i}") for i, k in enumerate(key)], F.col(member).cast("string").alias("__m"), T.strip(F.col(name)).alias("__name"))
    grouped = named.groupBy(*[f"__k{i}" for i in range(len(key))]).agg(F.min("__name").alias("name"), F.sort_array(F.collect_set("__m")).alias("members"))
    many = F.size("members") > 1
    return grouped.select(F.when(many, T.merged_id(prefix, F.col("name"), F.col("members"))).otherwise(F.col("members")[0]).alias("merged_id"), "name", "members", F.size("members").cast("bigint").alias("n"))


def mapping(groups: DataFrame) -> DataFrame:
    """(member, merged_id) of each member of the groups."""
    return groups.select(F.explode("members").alias("member"), "merged_id")


def remap(facts: DataFrame, mapped: DataFrame, columns: list[str]) -> DataFrame:
    """facts with the ids in columns replaced by their merged id, where there is one."""
    out = facts
    for c in columns:
        ids = mapped.select(F.col("member").alias(c), F.col("merged_id").alias("__to"))
        out = out.join(ids, c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
    return out.select(*facts.columns)


def remap_relations(relations: DataFrame, mapped: DataFrame) -> DataFrame:
    """relations (source, target, ...) over merged ids, without those that became self-loops by the merge."""
    was_self = relations.withColumn("__self", F.col("source") == F.col("target"))
    return remap(was_self, mapped, ["source", "target"]).where("source <> target or __self").drop("__self")


def retarget_evidence(evidence: DataFrame, mapped: DataFrame, keys: list[str], fact: str = "fact_id", order: list[str] | None = None) -> DataFrame:
    """evidence over merged ids; of rows that now have equal keys the first by `order` stays (by the other columns where none is given)."""
    rest = [c for c in evidence.columns if c not in keys]
    if not rest:
        return remap(evidence, mapped, [fact]).dropDuplicates(keys)
    first = F.min(F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order or [])], *rest)).alias("__first")
    return remap(evidence, mapped, [fact]).groupBy(*keys).agg(first).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest]).select(*evidence.columns)


def average_linkage(vectors: np.ndarray, distance: float) -> np.ndarray:
    """Cluster numbers by agglomeration: the two clusters of least mean distance merge while it is at most `distance`.

    Euclidean distance of unit vectors (zero stays zero); means are kept up to date by the sizes; ties go to the first.
    """
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(length == 0, 1, length)
    n = len(unit)
    d = np.empty((n, n))
    for i in range(n):
        d[i] = np.sqrt(np.maximum(((unit - unit[i]) ** 2).sum(axis=1), 0))
    np.fill_diagonal(d, np.inf)
    owner, size = np.arange(n), np.ones(n)
    nearest = d.argmin(axis=1) if n else np.zeros(0, int)
    least = d[np.arange(n), nearest]
    for _ in range(n - 1):
        a = int(least.argmin())
        b = int(d[a].argmin())
        if not d[a, b] <= distance:
            break
        a, b = min(a, b), max(a, b)
        row = (d[a] * size[a] + d[b] * size[b]) / (size[a] + size[b])
        d[a], d[:, a] = row, row
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        again = np.flatnonzero((nearest == a) | (nearest == b) | (np.arange(n) == a) | (np.arange(n) == b))
        nearest[again] = d[again].argmin(axis=1)
        least[again] = d[again, nearest[again]]
        nearer = d[:, a] < least
        nearest[nearer], least[nearer] = a, d[nearer, a]
        owner[owner == b] = a
        size[a] += size[b]
    return owner


def semantic_clusters(facts: DataFrame, id_col: str, vector_col: str, threshold: float = 0.9, block: list[str] | None = None) -> DataFrame:
    """(id, cluster): average-linkage clusters within each value of block; cluster is the least id of its members.

    Two clusters that merge have a pair of members within the distance, so facts that no chain of such pairs joins can't
    meet: each such part of a block is clustered on its own. A part is gathered on one task and takes memory by its square.
    """
    block, distance = block or [], 1 - threshold
    kind = dict(facts.dtypes)[id_col]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"id": ids, "cluster": ids[average_linkage(np.stack(pdf["vector"].to_numpy()).astype(np.float64), distance)]})

    rows = facts.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.struct(F.lit(0).alias("__all"), *block).alias("block"))
    asked = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"), "block")
    close = pairs(rows, asked, None, least=1 - distance**2 / 2 - 2e-6, within="block", once=True).select(F.col("query_id").alias("a"), F.col("id").alias("b"))
    # A zero vector is at no distance from others and at 1 from the rest, which the cosine doesn't tell.
    zero = F.min(F.when(V.norm(F.col("vector")) == 0, F.col("id"))).over(Window.partitionBy("block"))
    zeros = (rows if distance >= 1 else rows.where(V.norm(F.col("vector")) == 0)).select(F.col("id").alias("a"), zero.alias("b")).where("b is not null")
    parts = materialize(rows.join(components(close.unionByName(zeros)).select(F.col("key").alias("id"), F.col("component").alias("part")), "id", "left"))
    alone = parts.where("part is null").select("id", F.col("id").alias("cluster"))
    return alone.unionByName(parts.where("part is not null").groupBy("block", "part").applyInPandas(run, f"id {kind}, cluster {kind}"))


def merge_groups(new: DataFrame, stored: DataFrame, k: int = 8, threshold: float = 0.85) -> DataFrame:
    """(id, grp): new and stored facts (id, vector) that are to be one, from each new fact's k nearest stored ones.

    Groups that share a fact are one group; grp is the least id in it. Facts without a partner have no row.
    """
    near = pairs(stored, new.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), k, least=threshold)
    linked = top_k(near, k).select(F.col("query_id").alias("a"), F.col("id").alias("b"))
    return components(linked).select(F.col("key").alias("id"), F.col("component").alias("grp"))


def apply_merge(old: DataFrame, new: DataFrame, groups: DataFrame, text: str = "description", separator: str = "\n") -> DataFrame:
    """(id, name, description, members): stored and new facts (id, name, description) after the merge.

    A group becomes one fact under its least id, with its least-id member's name and the distinct texts in order of id;
    a writing model may replace the joined text. The others stay as they are. New ids must not be stored already.
    """
    facts = old.unionByName(new).join(groups, "id", "left").withColumn("grp", F.coalesce("grp", "id"))
    first = facts.groupBy("grp").agg(F.min_by("name", "id").alias("name"), F.array_sort(F.collect_list(F.struct("id", text))).alias("x"))
    return first.select(F.col("grp").alias("id"), "name", F.array_join(F.array_distinct(F.transform("x", lambda m: m[text])), separator).alias(text), F.transform("x", lambda m: m["id"]).alias("members"))
