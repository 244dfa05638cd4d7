"""Full text rankings scored where the records lie.

The terms asked for travel to every task; each task turns its records' tokens into numbers of those terms, multiplies
counts with weights and keeps its own best k of each query. Records and postings aren't shuffled: a task sends k rows a
query. Ids that stand on several rows, and more query terms than TERMS, take the joins of operators.search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.operators import search
from siftstone.session import small_batches

#: Rows (query, term) that travel to every task at most.
TERMS = 2_000_000
#: Scores that a task holds at once.
CELLS = 1 << 20
#: A product of dense matrices takes so many of a term's cells in the time of one that is added on its own.
DENSE = 100
#: Scores are rounded to so many decimals before they are ranked.
DECIMALS = 6
#: Rows of the counts that stand for the number of records and of their tokens.
_RECORDS, _TOKENS = -1, -2


class Asked:
    """Query terms (query_id, term, weight) as numbers: by term the queries that ask for it, with their weights."""

    def __init__(self, wanted: pa.Table):
        ids = wanted["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        self.queries = ids.dictionary
        terms = wanted["term"].combine_chunks().dictionary_encode()
        self.terms = terms.dictionary
        term, query = terms.indices.to_numpy(), ids.indices.to_numpy()
        order = np.argsort(term, kind="stable")
        self.query, self.weight = query[order].astype(np.int64), wanted["weight"].to_numpy()[order].astype(np.float64)
        self.size = np.bincount(term, minlength=len(self.terms))
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.need = np.bincount(query, minlength=len(self.queries))

    def postings(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, tf, len): the terms asked for of each row of token lists, and each row's number of tokens."""
        size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = pc.fill_null(pc.index_in(words.flatten(), value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        key, tf = np.unique((row * len(self.terms) + at)[at >= 0], return_counts=True)
        return key // max(1, len(self.terms)), key % max(1, len(self.terms)), tf.astype(np.float64), size

    def product(self, n: int, row: np.ndarray, term: np.ndarray, part: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(n rows, queries): sums of part times weight over the postings. Frequent terms by a matrix product, the others one by one."""
        width = len(self.queries)
        met = np.bincount(term, minlength=len(self.terms)) * self.size
        dense = np.flatnonzero(met * DENSE > n * width)
        dense = dense[np.argsort(-met[dense], kind="stable")][: max(1, 8 * CELLS // width)]
        column = np.full(len(self.terms), -1)
        column[dense] = np.arange(len(dense))
        rare = column[term] < 0
        many = self.size[term[rare]]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        slot = np.repeat(self.start[term[rare]], many) + within
        out = np.bincount(np.repeat(row[rare], many) * width + self.query[slot], np.repeat(part[rare], many) * weight[slot], minlength=n * width).astype(np.float64).reshape(n, width)
        if len(dense):
            left, right = np.zeros((n, len(dense))), np.zeros((len(dense), width))
            left[row[~rare], column[term[~rare]]] = part[~rare]
            held = np.repeat(np.arange(len(self.terms)), self.size)
            on = column[held] >= 0
            right[column[held[on]], self.query[on]] = weight[on]
            out += left @ right
        return out


class _Best:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, width: int, k: int):
        self.k, self.least = k, np.zeros(width)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        row, query = np.nonzero((scores >= self.least) & (scores > 0))
        self.kept.append((query, scores[row, query], ids[row]))
        self.rows += len(row)
        if self.rows > 4 * self.k * len(self.least):
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if not self.kept:
            return None
        query, score, ids = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.least[query[place == self.k - 1]] = score[place == self.k - 1]
        on = place < self.k
        self.kept, self.rows = [(query[on], score[on], ids[on])], int(on.sum())
        return self.kept[0]


def _counted(asked, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): records that hold each term, and under two negative numbers the records and their tokens."""
    a: Asked = asked.value
    n, tokens, df = 0, 0, np.zeros(len(a.terms), np.int64)
    for batch in batches:
        _, term, _, size = a.postings(batch.column(0))
        n, tokens = n + len(size), tokens + int(size.sum())
        df += np.bincount(term, minlength=len(df))
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[_RECORDS, _TOKENS], held]).astype(np.int64)), pa.array(np.concatenate([[n, tokens], df[held]]).astype(np.int64))], ["term", "n"])


def _scored(asked, idf: np.ndarray | None, mean: float, k: int, kinds: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a: Asked = asked.value
    best = {kind: _Best(len(a.queries), k) for kind in kinds}
    step, ids = max(1, CELLS // max(1, len(a.queries))), None
    weight = a.weight * np.repeat(idf, a.size) if idf is not None else None
    ones = np.ones(len(a.query))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            ids, (row, term, tf, size) = piece.column(0), a.postings(piece.column(1))
            key = ids.to_numpy(zero_copy_only=False)
            for kind, top in best.items():
                if kind == "bm25":
                    part = tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * size[row] / mean))
                    scores = a.product(len(key), row, term, part, weight)
                else:
                    have = a.product(len(key), row, term, np.ones(len(row)), ones)
                    hit = np.flatnonzero((np.round(have) == a.need).any(axis=1))
                    of = np.full(len(key), -1)
                    of[hit] = np.arange(len(hit))
                    on = of[row] >= 0
                    scores = np.zeros(have.shape)
                    if len(hit):
                        part = tf[on] / (1 + np.log(size[row[on]]))
                        scores[hit] = np.where(np.round(have[hit]) == a.need, a.product(len(hit), of[row[on]], term[on], part, ones), 0)
                top.add(np.round(scores, DECIMALS), key)
    for kind, top in best.items():
        if (found := top.prune()) is not None and len(found[0]):
            query, score, key = found
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(query), pa.string()), a.queries.take(pa.array(query)), pa.array(key, ids.type), pa.array(score)], ["kind", "query_id", "id", "score"])


def _joined(docs: DataFrame, queries: DataFrame, columns: tuple[str, str, str, str], kind: str, k: int) -> DataFrame:
    scored = (search.bm25 if kind == "bm25" else search.all_terms_rank)(docs, queries, *columns)
    return search.top_k(scored.withColumn("score", F.round("score", DECIMALS)).where("score > 0"), k)


def rankings(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, k: int, kinds: tuple[str, ...] = ("bm25",)) -> list[DataFrame]:
    """(query_id, id, score, rank) for each of kinds: the k best records of each query by search.bm25 ("bm25") or search.all_terms_rank ("all_terms").

    Scores are rounded to DECIMALS before they are ranked; those over 0 count; ties go to the smaller id.
    """
    wanted = search.query_terms(queries, query_id, query_text)
    single = docs.agg((F.count_distinct(id_col) == F.count("*")).alias("x")).first()["x"]
    if not single or not 0 < wanted.count() <= TERMS:
        return [_joined(docs, queries, (id_col, text_col, query_id, query_text), kind, k) for kind in kinds]
    spark = docs.sparkSession
    small_batches(docs)
    a = Asked(wanted.toArrow())
    asked = spark.sparkContext.broadcast(a)
    rows = docs.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("said"))
    idf, mean = None, 1.0
    if "bm25" in kinds:
        counts = rows.select("said").mapInArrow(lambda b: _counted(asked, b), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        counted = pd.Series(counts["n"].to_numpy(), counts["term"].to_numpy())
        n, df = float(counted.get(_RECORDS, 0)), counted.reindex(range(len(a.terms)), fill_value=0).to_numpy(float)
        idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), max(float(counted.get(_TOKENS, 0)) / max(n, 1), 1e-300)
    shape = f"kind string, query_id {dict(wanted.dtypes)['query_id']}, id {dict(rows.dtypes)['id']}, score double"
    best = search.top_k(rows.mapInArrow(lambda b: _scored(asked, idf, mean, k, kinds, b), shape), k, ["kind", "query_id"])
    return [best.where(F.col("kind") == kind).drop("kind") for kind in kinds]
