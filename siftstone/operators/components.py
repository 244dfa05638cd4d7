"""Connected components of an edge table, by contraction towards chosen neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.checkpoint import materialize


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(key, component) for every key on an edge (a, b) of two keys; component is the least key reached.

    In each round every key goes, twice, to the one of itself and its neighbours that a hash puts first, and edges join
    what the keys became; a part of the keys is left, the smaller the more neighbours they have. The hash is another one
    each round, so that no numbering makes long chains. Self-loops, repeats and either orientation are allowed; no edges
    give no rows.
    """
    now, went = _joined(edges), []
    while not now.isEmpty():
        if len(went) == max_rounds:
            raise RuntimeError("components did not settle")

        def order(c: str) -> Column:
            return F.struct(F.xxhash64(F.lit(len(went)), c).alias("h"), F.col(c).alias("key"))

        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        once = materialize(both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("key"), F.least(order("a"), "m")["key"].alias("to")))
        twice = materialize(once.withColumnRenamed("to", "via").join(once.select(F.col("key").alias("via"), "to"), "via").select("key", "to"))
        went.append(twice)
        ends = [twice.select(F.col("key").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab"]
        now = _joined(now.join(ends[0], "a").join(ends[1], "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")))
    if not went:
        return now.select(F.col("a").alias("key"), F.col("b").alias("component"))
    last = went.pop()
    while went:
        on = last.select(F.col("key").alias("to"), F.col("to").alias("end"))
        last = materialize(went.pop().join(on, "to", "left").select("key", F.coalesce("end", "to").alias("to")))
    return last.join(last.groupBy("to").agg(F.min("key").alias("component")), "to").select("key", "component")


def _joined(edges: DataFrame) -> DataFrame:
    return materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
