"""Reproducible shuffle of a table into shards: a Feistel permutation of global row numbers.

Rows are numbered by doc_id (null doc_ids first, ties by row identity; wholly equal rows take consecutive numbers). A
balanced Feistel network over the least power of four that holds all numbers, walked until it falls into range, permutes
them; position p goes to shard p % shards, slot p // shards. Anyone who knows the row count, the seed and a row's number
can compute its place, and the inverse gives the row of any place.

Only ids and hashes are sorted globally. Rows that occur once meet their number by a sorted join, at any size;
of wholly equal rows, however
many, one copy travels, and is given all their numbers. A shard is written in slot order, in as many partitions as its
bytes need, so that no task grows with the table.

Defined cases: null doc_ids are ids like others; texts aren't read, so that null, empty and very long ones are moved like
others; an empty table gives an empty table; documents' columns named like the added ones get the suffix _input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import fresh, materialize, pieces, plan_bytes, row_id, sized_join, yield_clashes

SHARDS, SEED, ROUNDS = 64, 20240607, 6
#: Bytes of a partition of a shard, about; numbers of wholly equal rows that are given out at once.
PART, CHUNK = 32 << 20, 1 << 12
_M31, _A, _B = (1 << 31) - 1, 1_103_515_245, 1_566_083_941


def round_keys(seed: int = SEED, rounds: int = ROUNDS) -> list[int]:
    keys, x = [], seed % _M31
    for _ in range(rounds):
        x = (x * 48_271 + 11) % _M31
        keys.append(x)
    return keys


def half_bits(n: int) -> int:
    """Bits of each half: the domain 4**half_bits holds n numbers."""
    return max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)


def _mixed(x: np.ndarray, key: int, mask: int) -> np.ndarray:
    x = ((x & _M31) * _A + (x >> 31) + key) % _M31
    x = ((x ^ (x >> 15)) * _B) % _M31
    return (x ^ (x >> 13)) & mask


def permute(numbers: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """Positions of row numbers 0..n-1, or the row numbers of positions."""
    bits = half_bits(n)
    mask = (1 << bits) - 1
    keys = round_keys(seed)
    out = np.array(numbers, np.int64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> bits, out[walking] & mask
        for key in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ _mixed(left, key, mask), left
            else:
                left, right = right, left ^ _mixed(right, key, mask)
        out[walking] = (left << bits) | right
        walking = walking[out[walking] >= n]
    return out


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, n) of a partition -> with each row's start within the partition, and the partition's number."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(2).to_numpy(zero_copy_only=False)
        if not len(n):
            continue
        start = total + np.r_[0, np.cumsum(n)[:-1]]
        total += int(n.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start.astype(np.int64)), pa.array(np.full(len(n), part, np.int32))], ["a", "b", "n", "start", "part"])


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """docs with row_number, position, shard and slot. A partition holds a range of one shard's slots, in order; partition p is a part of shard p // parts."""
    size = plan_bytes(docs)
    docs = yield_clashes(docs, "row_number", "position", "shard", "slot")
    key, start_name, part_name = fresh(docs, "__id", "__start", "__part")
    keyed = docs.withColumn(key, row_id(docs))
    distinct = keyed.groupBy(F.col(id_col).alias("id"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    order = [F.col("id").asc_nulls_first(), F.col("key")]
    ordered = distinct.repartitionByRange(max(8, -(-size // (64 << 20))), *order).sortWithinPartitions(*order).select("key.a", "key.b", "n")
    numbered = materialize(ordered.mapInArrow(_number, "a bigint, b bigint, n bigint, start bigint, part int"))
    counts = sorted((r["part"], r["rows"], r["most"]) for r in numbered.groupBy("part").agg(F.sum("n").alias("rows"), F.max("n").alias("most")).collect())
    total, repeated = sum(c[1] for c in counts), any(c[2] > 1 for c in counts)
    offsets = dict(zip((c[0] for c in counts), np.r_[0, np.cumsum([c[1] for c in counts])].tolist(), strict=False))
    parts = max(1, -(-size // (shards * PART)))

    @F.pandas_udf("bigint")
    def first_row(start: pd.Series, part: pd.Series) -> pd.Series:
        return start + np.array([offsets[p] for p in part], np.int64)

    @F.pandas_udf("bigint")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), total, seed))

    table = materialize(numbered.select(F.struct("a", "b").alias(key), first_row("start", "part").alias(start_name), "n"))
    single = keyed.join(table.where("n = 1").drop("n").hint("merge"), key)
    if repeated:
        again = table.where("n > 1")
        chunks = again.select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(CHUNK).cast("bigint"))).alias("from"), start_name, "n")
        chunks = chunks.select(key, F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK, F.col("n")) - 1)).alias("nth"), start_name)
        once = sized_join(keyed, again.select(key), key, "left_semi", 32).dropDuplicates([key])
        many = once.join(chunks.select(key, (F.col(start_name) + F.col("nth")).alias(start_name)), key)
        single = single.select(*keyed.columns, start_name).unionByName(many.select(*keyed.columns, start_name))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = single.select(*columns, F.col(start_name).alias("row_number"), place(start_name).alias("position"))
    out = out.withColumn("shard", F.col("position") % shards).withColumn("slot", F.expr(f"position div {shards}"))
    slots = max(1, -(-total // shards))
    part = F.col("shard") * parts + F.least(F.expr(f"slot * {parts} div {slots}"), F.lit(parts - 1))
    out = out.withColumn(part_name, part.cast("int")).repartitionById(shards * parts, part_name)
    return out.sortWithinPartitions("shard", "slot").drop(part_name)


def oracle(shards: int = SHARDS, seed: int = SEED) -> str:
    """The same over documents, in DuckDB SQL: one Feistel pass per step of a recursion, until a number falls into range."""
    state = "SELECT row_number, n, bits, (cur >> bits) AS l0, (cur & ((1::BIGINT << bits) - 1)) AS r0 FROM {src}"
    sql = state
    for i, key in enumerate(round_keys(seed)):
        x1 = f"((((r{i} & {_M31}) * {_A}) + (r{i} >> 31) + {key}) % {_M31})"
        sql = f"SELECT row_number, n, bits, r{i} AS l{i + 1}, xor(l{i}, xor(y, y >> 13) & ((1::BIGINT << bits) - 1)) AS r{i + 1} FROM (SELECT *, (xor(x, x >> 15) * {_B}) % {_M31} AS y FROM (SELECT *, {x1} AS x FROM ({sql})))"
    last = len(round_keys(seed))
    step = f"SELECT row_number, n, bits, ((l{last} << bits) | r{last}) AS cur FROM ({sql})"
    return f"""
WITH RECURSIVE numbered AS (
  SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS row_number, count(*) OVER ()::BIGINT AS n FROM documents
), sized AS (
  SELECT row_number, n, greatest(1, (length(bin(greatest(n - 1, 1))) + 1) // 2)::BIGINT AS bits, row_number AS cur FROM numbered
), walk AS (
  {step.format(src="sized")}
  UNION ALL
  {step.format(src="(SELECT * FROM walk WHERE cur >= n)")}
)
SELECT d.*, w.row_number, w.cur AS position, w.cur % {shards} AS shard, w.cur // {shards} AS slot
FROM walk w JOIN numbered k USING (row_number) JOIN documents d ON d.doc_id = k.doc_id WHERE w.cur < w.n
"""
