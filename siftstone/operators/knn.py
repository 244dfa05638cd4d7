"""Exact nearest neighbours by blocked matrix products.

Queries and vectors are dealt to large blocks; a task holds one block of queries while a block of vectors streams past in
tiles, and keeps each query's best k so far. So a vector travels once for each block of queries, of which there are few,
and a task's memory doesn't grow with the tables. No index, no candidates lost: single precision only finds what may be
among the best, by a bound of its error; what counts is in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.operators.search import top_k
from siftstone.session import small_batches

#: Rows of a block at most; hits that a block of queries keeps.
BLOCK, KEPT = 1 << 16, 1 << 21
#: Blocks of queries at least (a task each), unless they would be smaller than SMALL.
SPREAD, SMALL = 16, 256
#: Queries and vectors of a tile; hits that are looked at in double precision at once.
ROWS, COLUMNS, EXACT = 512, 8192, 1 << 16
#: Scores are rounded to so many decimals before they are ranked, so that equal vectors tie and ids decide.
DECIMALS = 6


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length == 0, 1, length)


def similarities(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """One row per query. cosine is 0 where either vector is zero; l2 is the negated distance."""
    if metric == "l2":
        squared = (queries**2).sum(axis=1)[:, None] + (vectors**2).sum(axis=1)[None, :] - 2 * queries @ vectors.T
        return -np.sqrt(np.maximum(squared, 0))
    if metric == "cosine":
        queries, vectors = _unit(queries), _unit(vectors)
    elif metric != "dot":
        raise ValueError(f"unknown metric: {metric}")
    return queries @ vectors.T


def _matrix(vectors: pa.Array) -> np.ndarray:
    size = np.unique(np.diff(vectors.offsets.to_numpy()))
    if len(size) > 1:
        raise ValueError(f"dimension mismatch: {size[0]} and {size[1]}")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), int(size[0])).astype(np.float64)


class _Tile:
    """Some queries of a block and their best hits so far."""

    def __init__(self, first: int, queries: np.ndarray, k: int | None, least: float | None):
        self.first, self.queries, self.k = first, queries, k
        self.floor = np.full(len(queries), -np.inf if least is None else least)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.kept.append((row, score, ids))
        self.rows += len(row)
        if self.k is not None and self.rows > 1.5 * self.k * len(self.queries):
            self.prune()

    def prune(self) -> None:
        row, score, ids = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.floor[row[last]] = np.maximum(self.floor[row[last]], score[last])
        on = place < self.k
        self.kept, self.rows = [(row[on], score[on], ids[on])], int(on.sum())


class _Block:
    """A block of queries that vectors stream past."""

    def __init__(self, k: int | None, metric: str, least: float | None, others: bool, once: bool):
        self.k, self.metric, self.least, self.others, self.once = k, metric, least, others, once
        self.asked: list[tuple[pa.Array, np.ndarray]] = []
        self.tiles: list[_Tile] | None = None

    def ask(self, ids: pa.Array, vectors: pa.Array) -> None:
        self.asked.append((ids, _matrix(vectors)))

    def _start(self) -> None:
        self.query_ids = pa.concat_arrays([x for x, _ in self.asked])
        self.keys = self.query_ids.to_numpy(zero_copy_only=False)
        if len({m.shape[1] for _, m in self.asked}) > 1:
            raise ValueError(f"dimension mismatch: {sorted({m.shape[1] for _, m in self.asked})}")
        q = np.concatenate([m for _, m in self.asked])
        q = _unit(q) if self.metric == "cosine" else q
        self.tiles = [_Tile(at, q[at : at + ROWS], self.k, self.least) for at in range(0, len(q), ROWS)]
        self.asked = []

    def meet(self, ids: pa.Array, vectors: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.tiles is None:
            if not self.asked:
                return
            self._start()
        self.kind, v, keys = ids.type, _matrix(vectors), ids.to_numpy(zero_copy_only=False)
        if v.shape[1] != self.tiles[0].queries.shape[1]:
            raise ValueError(f"dimension mismatch: {self.tiles[0].queries.shape[1]} and {v.shape[1]}")
        v = _unit(v) if self.metric == "cosine" else v
        for at in range(0, len(v), COLUMNS):
            for tile in self.tiles:
                yield from self._meet(tile, keys[at : at + COLUMNS], v[at : at + COLUMNS])

    def _meet(self, tile: _Tile, ids: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.metric == "cosine":
            scores, off = tile.queries.astype(np.float32) @ v.astype(np.float32).T, 6e-8 * (v.shape[1] + 16)
        else:
            scores, off = similarities(tile.queries, v, self.metric), 0.0
        margin = off + 10.0**-DECIMALS
        floor = tile.floor - margin
        among = None if self.k is None else self.k + self.others
        found = np.flatnonzero(scores >= floor.astype(scores.dtype)[:, None])
        if among is not None and among < scores.shape[1] and len(found) > 2 * among * len(scores):
            floor = np.maximum(floor, np.partition(scores, scores.shape[1] - among, axis=1)[:, scores.shape[1] - among] - off - margin)
            found = np.flatnonzero(scores >= floor.astype(scores.dtype)[:, None])
        for start in range(0, len(found), EXACT):
            row, column = np.divmod(found[start : start + EXACT], scores.shape[1])
            exact = np.einsum("ij,ij->i", tile.queries[row], v[column]) if self.metric == "cosine" else scores[row, column]
            exact = np.round(exact, DECIMALS)
            on = exact >= tile.floor[row]
            asked, held = self.keys[tile.first + row], ids[column]
            if self.others:
                on &= asked != held
            if self.once:
                on &= asked < held
            if not on.any():
                continue
            if self.k is None:
                yield self._batch(tile.first + row[on], held[on], exact[on])
            else:
                tile.add(row[on], exact[on], held[on])

    def _batch(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.query_ids.take(pa.array(row)), pa.array(ids, self.kind), pa.array(score)], ["query_id", "id", "score"])

    def finish(self) -> Iterator[pa.RecordBatch]:
        for tile in self.tiles or []:
            if tile.rows:
                tile.prune()
                row, score, ids = tile.kept[0]
                yield self._batch(tile.first + row, ids, score)


def _stream(k: int | None, metric: str, least: float | None, others: bool, once: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block columns, side, query_id, id, vector) sorted by block and side: the queries of a block come before its vectors."""
    block, now = None, None
    for batch in batches:
        marks, at = zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns - 3)), strict=True), 0
        for mark, run in groupby(marks):
            piece = batch.slice(at, n := len(list(run)))
            at += n
            asked, held, vectors = piece.columns[-3:]
            if mark[:-1] != now:
                if block is not None:
                    yield from block.finish()
                block, now = _Block(k, metric, least, others, once), mark[:-1]
            if mark[-1] == 0:
                block.ask(asked, vectors)
            else:
                yield from block.meet(held, vectors)
    if block is not None:
        yield from block.finish()


def pairs(vectors: DataFrame, queries: DataFrame, k: int | None, metric: str = "cosine", least: float | None = None, others: bool = False, within: str | None = None, block: int = BLOCK, once: bool = False) -> DataFrame:
    """(query_id, id, score): for each query the k best of each block (all with None), of scores from `least` on.

    vectors (id, vector), queries (query_id, query_vector). others leaves a query's own id out, once all ids that aren't
    greater; within names a column of both: only rows that agree in it are compared. Null vectors match nothing; ids aren't null.
    """
    keys = [within] if within else []
    held, asked = vectors.where("vector is not null"), queries.where("query_vector is not null")
    n_held, n_asked = held.count(), asked.count()
    segments, blocks = max(1, -(-n_held // block)), max(1, -(-n_asked // min(block, max(SMALL, KEPT // (k or 1)))), min(SPREAD, -(-n_asked // SMALL)))
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["id"]
    number = "array<float>" if dict(queries.dtypes)["query_vector"] == dict(vectors.dtypes)["vector"] == "array<float>" else "array<double>"

    def every(n: int):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    left = asked.select(*keys, F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("qb"), every(segments).alias("vb"), F.lit(0).alias("side"), "query_id", F.lit(None).cast(kinds[1]).alias("id"), F.col("query_vector").cast(number).alias("vector"))
    right = held.select(*keys, every(blocks).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(segments)).alias("vb"), F.lit(1).alias("side"), F.lit(None).cast(kinds[0]).alias("query_id"), "id", F.col("vector").cast(number).alias("vector"))
    small_batches(vectors)
    by = [*keys, "qb", "vb"]
    met = left.unionByName(right).repartition(*by).sortWithinPartitions(*by, "side")
    return met.mapInArrow(lambda batches: _stream(k, metric, least, others, once, batches), f"query_id {kinds[0]}, id {kinds[1]}, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of each query, ties by id; options as in pairs()."""
    return top_k(pairs(vectors, queries, k, **options), k)
