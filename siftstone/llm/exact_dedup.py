"""Exact deduplication against a minimal perfect hash over the digests of earlier documents.

History's distinct SHA-256 digests are sharded; each shard gets a minimal perfect hash (hash and displace), whose slots
hold the full digest and the winner's locator. A digest that is looked up always lands on a slot; comparing all 32 bytes
there tells members from strangers. Members are repeats of history and go. Strangers are grouped by digest on their own,
and of each group the least doc_id stays.

Without a given history the table's older half by doc_id, whatever its type, is the history and the newer half the
arriving batch; the halves are told apart by the middle one of a bounded sample of doc_ids. The result is that of keeping
the least doc_id of every distinct text, whichever doc_id parts them.

Defined cases: null texts have no digest and stay; empty texts are equal to each other; texts of any length are read
whole; null doc_ids sort last, ties by row; of wholly equal rows one stays; an empty table gives an empty table; other
columns, whatever their names, are passed through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm import textkernel as K
from siftstone.llm.common import drop_rows, materialize, row_id

#: Distinct digests in a shard of the index, about.
SHARD = 1 << 15
#: doc_ids of which the middle one parts older from newer rows.
SAMPLE = 1001
_TRIES = 64


class PerfectHash:
    """Minimal perfect hash over distinct digests, (n, 32) bytes; slot() maps member i to a place of its own in 0..n-1."""

    def __init__(self, n: int, seeds: np.ndarray) -> None:
        self.n, self.seeds = n, seeds

    @staticmethod
    def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.ascontiguousarray(digests).view("<u8").reshape(len(digests), 4)
        return words[:, 1].astype(K.U), words[:, 2].astype(K.U)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        n = len(digests)
        a, b = cls._halves(digests)
        m = max(1, -(-n // 4))
        bucket = (a % K.U(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(m + 1))
        size = np.diff(starts)
        seeds = np.zeros(m, np.int64)
        taken = np.zeros(n, bool)
        for k in np.argsort(-size, kind="stable"):
            if size[k] <= 1:
                break
            keys = b[order[starts[k] : starts[k + 1]]]
            base = 1
            while True:
                tries = np.arange(base, base + _TRIES, dtype=K.U)
                slots = (K.mix(keys[None, :] + tries[:, None] * K.U(K._Q)) % K.U(n)).astype(np.int64)
                sorted_slots = np.sort(slots, axis=1)
                good = ~taken[slots].any(axis=1) & (sorted_slots[:, 1:] != sorted_slots[:, :-1]).all(axis=1)
                hit = np.flatnonzero(good)
                if len(hit):
                    seeds[k] = base + hit[0]
                    taken[slots[hit[0]]] = True
                    break
                base += _TRIES
        single = np.flatnonzero(size == 1)
        seeds[single] = -1 - np.flatnonzero(~taken)[: len(single)]
        return cls(n, seeds)

    def slot(self, digests: np.ndarray) -> np.ndarray:
        a, b = self._halves(digests)
        seed = self.seeds[(a % K.U(len(self.seeds))).astype(np.int64)]
        spread = (K.mix(b + np.maximum(seed, 0).astype(K.U) * K.U(K._Q)) % K.U(self.n)).astype(np.int64)
        return np.where(seed < 0, -1 - seed, spread)


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in column), np.uint8).reshape(-1, 32)


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """(shard, digest, a, b) of distinct digests -> one index row with seeds, slot digests and slot locators."""
    digests = _bytes(pdf["digest"])
    hashed = PerfectHash.build(digests)
    slot = hashed.slot(digests)
    at = np.empty(len(slot), np.int64)
    at[slot] = np.arange(len(slot))
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "seeds": [hashed.seeds.tobytes()], "digests": [digests[at].tobytes()], "locators": [pdf[["a", "b"]].to_numpy(np.int64)[at].tobytes()]})


def probe_shard(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Distinct new digests of a shard -> the member's locator, null for strangers."""
    none = pd.array([None] * len(new), "Int64")
    out = new[["digest", "a", "b"]].assign(x=none, y=none.copy())
    if len(index) and len(new):
        row = index.iloc[0]
        stored = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        digests = _bytes(new["digest"])
        slot = PerfectHash(len(stored), np.frombuffer(row["seeds"], np.int64)).slot(digests)
        member = (stored[slot] == digests).all(axis=1)
        locators = np.frombuffer(row["locators"], np.int64).reshape(-1, 2)[slot]
        for k, name in enumerate(("x", "y")):
            found = pd.array(locators[:, k], "Int64")
            found[~member] = pd.NA
            out[name] = found
    return out


def _shard(shards: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint"), F.lit(shards)).alias("shard")


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, id, a, b) of the rows that have a text; a and b are the row's identity."""
    each = docs.select(F.unhex(F.sha2(F.col(text_col).cast("string"), 256)).alias("digest"), F.col(id_col).alias("id"), row_id(docs).alias("key"))
    return each.where("digest is not null").select("digest", "id", "key.a", "key.b")


def winners(slim: DataFrame) -> DataFrame:
    """(digest, a, b) of the least row of each digest; partial aggregation keeps hot digests small."""
    return slim.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "a", "b")).alias("w")).select("digest", "w.a", "w.b")


def build_index(history: DataFrame) -> DataFrame:
    """The index table (shard, shards, seeds, digests, locators) over history's winners (digest, a, b), materialized."""
    shards = max(1, -(-history.count() // SHARD))
    rows = history.select(_shard(shards), "digest", "a", "b").groupBy("shard").applyInPandas(build_shard, "shard bigint, seeds binary, digests binary, locators binary")
    return materialize(rows.withColumn("shards", F.lit(shards)))


def probe(new: DataFrame, index: DataFrame) -> DataFrame:
    """(digest, a, b, x, y) of distinct new digests (digest, a, b): x and y identify the winner in the index, null for strangers."""
    head = index.select("shards").first()
    if head is None:
        return new.select("digest", "a", "b", F.lit(None).cast("bigint").alias("x"), F.lit(None).cast("bigint").alias("y"))
    asked = new.select(_shard(head[0]), "digest", "a", "b").groupBy("shard")
    return asked.cogroup(index.drop("shards").groupBy("shard")).applyInPandas(probe_shard, "digest binary, a bigint, b bigint, x bigint, y bigint")


def middle(slim: DataFrame):
    """The middle one of a sample of SAMPLE distinct ids, chosen by hash; None without any."""
    ids = slim.where("id is not null").select("id", F.xxhash64("id").alias("h")).distinct().orderBy("h", "id").limit(SAMPLE)
    found = sorted(r["id"] for r in ids.collect())
    return found[(len(found) - 1) // 2] if found else None


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """The rows of docs that stay. history: earlier documents; index: their index, built before (build_index)."""
    slim = materialize(digests(docs, id_col, text_col))
    old, new = None, slim
    if index is None and history is None:
        pivot = F.lit(middle(slim)).cast(dict(docs.dtypes)[id_col])
        new = slim.where((F.col("id") > pivot) | F.col("id").isNull() | pivot.isNull())
        old = materialize(winners(slim.where(F.col("id") <= pivot)))
        index = build_index(old)
    elif index is None:
        index = build_index(materialize(winners(digests(history, id_col, text_col))))
    probed = materialize(probe(winners(new), index))
    best = probed.select("digest", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    if old is not None:
        best = best.unionByName(old.select("digest", F.col("a").alias("x"), F.col("b").alias("y"))).distinct()
    decided = slim.join(best, "digest").select(F.struct("a", "b").alias("key"), ((F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).alias("keep"))
    return drop_rows(docs, materialize(decided))
