"""Language identification by the nearest of several centroids per language.

A text is the vector of its hashed byte pairs and triples (ASCII capitals folded), logarithmic frequencies times inverse
document frequencies, at unit length. Document frequencies are counted over all documents. For each language of a
bounded sample of labelled rows a spherical k-means gives several centroids; the centroid with the largest cosine names
the language, unless it is further away than nearly all of its own sample was: then the answer is "und".

Defined cases: null and empty texts, and texts of fewer than two bytes, are "und" with similarity 0; equal similarities
go to the first language by name; rows with a null language teach nothing; without any language all are "und"; repeated
rows get equal answers; an empty table gives an empty table; texts are read whole; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm import textkernel as K
from siftstone.llm.common import materialize, sized_join, slices, small_batches

#: Hashed dimensions, centroids per language, and the bound of the sample that these are fitted on (shared by the languages; at least one row each, 2 * SAMPLE rows in all).
DIMENSIONS, CENTROIDS, SAMPLE = 4096, 3, 3000
#: A text is rejected below this share of the similarity that all but 0.5 % of its language's sample reach: short texts are less similar than the sample's.
REJECT = 0.6
_ROWS = 256
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


def counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts of _ROWS rows at most) of hashed byte pairs and triples that lie within one text."""
    raw, offsets = K.raw_bytes(texts)
    for first in range(0, len(texts), _ROWS):
        last = min(first + _ROWS, len(texts))
        x = _FOLD[raw[offsets[first] : offsets[last]]]
        at = offsets[first : last + 1] - offsets[first]
        doc = np.repeat(np.arange(last - first, dtype=np.int64) * DIMENSIONS, np.diff(at))
        total = np.zeros((last - first) * DIMENSIONS)
        if len(x) > 1:
            pair = (x[:-1] << 8) | x[1:]
            inside = doc[:-1] == doc[1:]
            total += np.bincount((doc[:-1] + ((pair * np.uint32(2654435761)) >> np.uint32(20)))[inside], minlength=len(total))
        if len(x) > 2:
            triple = (pair[:-1] << 8) | x[2:]
            inside = doc[:-2] == doc[2:]
            total += np.bincount((doc[:-2] + ((triple * np.uint32(2246822519)) >> np.uint32(20)))[inside], minlength=len(total))
        yield first, total.reshape(-1, DIMENSIONS).astype(np.float32)


def vectors(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(x) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    names: list[str]
    least: np.ndarray

    def classify(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Names and similarities for rows of counts."""
        if not len(self.names):
            return ["und"] * len(x), np.zeros(len(x))
        similarity = vectors(x, self.idf) @ self.centroids.T
        best = similarity.argmax(axis=1)
        value = similarity[np.arange(len(x)), best].astype(np.float64)
        known = (value >= self.least[best]) & (x.sum(axis=1) > 0)
        return [self.names[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(x.sum(axis=1) > 0, value, 0.0)


def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (i, n): the partition's document frequencies; i = DIMENSIONS has the number of documents."""
    total = np.zeros(DIMENSIONS + 1, np.int64)
    for part in slices(batches, "text", K.SLICE):
        for _, x in counts(part.column(0)):
            total[:-1] += (x > 0).sum(axis=0)
            total[-1] += len(x)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1, dtype=np.int32)), pa.array(total)], ["i", "n"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centroids; starts from the mean's furthest rows, deterministic."""
    center = x.mean(axis=0)
    centers = [center / max(np.linalg.norm(center), 1e-12)]
    while len(centers) < min(k, len(x)):
        centers.append(x[(x @ np.stack(centers).T).max(axis=1).argmin()])
    centers = np.stack(centers)
    for _ in range(rounds):
        owner = (x @ centers.T).argmax(axis=1)
        sums = np.stack([x[owner == j].sum(axis=0) for j in range(len(centers))])
        norms = np.linalg.norm(sums, axis=1)
        centers = sums[norms > 1e-12] / norms[norms > 1e-12][:, None]
    return centers


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, centroids: int = CENTROIDS) -> LanguageModel:
    slim = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = slim.select("text").mapInArrow(document_frequencies, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DIMENSIONS + 1)
    df[rows["i"].to_numpy(int)] = rows["n"].to_numpy(float)
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1).astype(np.float32)
    known = slim.where("lang is not null").withColumn("h", F.xxhash64("id", "text"))
    by_lang = materialize(known.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")))
    languages = by_lang.count()
    each = max(1, sample // max(1, languages))
    # chosen by id and text and once per distinct pair, so that repeated rows can't exceed the bound; every language has its row of least hash
    share = F.lit(float(each << 30)) / F.col("n")
    drawn = sized_join(known, by_lang, "lang", "inner", 48).where((F.pmod("h", F.lit(1 << 30)) < share) | (F.col("h") == F.col("least")))

    def count_bytes(batches):
        for part in slices(batches, "text", K.SLICE):
            for first, x in counts(part.column(2)):
                row, place = np.nonzero(x)
                size = np.bincount(row, minlength=len(x))
                cut = np.cumsum(size)[:-1]
                lists = [np.split(v, cut) for v in (place.astype(np.int16), x[row, place].astype(np.int32))]
                packed = [[v.tobytes() for v in column] for column in lists]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(first, len(x)), part.column(1).slice(first, len(x)), *(pa.array(v, pa.binary()) for v in packed)], ["h", "lang", "place", "count"])

    taught = drawn.select("h", "lang", "text").mapInArrow(count_bytes, "h bigint, lang string, place binary, count binary").dropDuplicates(["h", "lang"]).limit(2 * max(sample, languages)).toPandas().sort_values(["lang", "place", "count"])
    all_centers, names, least = [], [], []
    for name, group in taught.groupby("lang"):
        x = np.zeros((len(group), DIMENSIONS), np.float32)
        for i, (place, count) in enumerate(zip(group["place"], group["count"], strict=True)):
            x[i, np.frombuffer(place, np.int16)] = np.frombuffer(count, np.int32)
        x = vectors(x, idf)
        centers = spherical_kmeans(x, centroids)
        nearest = (x @ centers.T).max(axis=1)
        all_centers.append(centers)
        names += [name] * len(centers)
        least += [REJECT * float(np.quantile(nearest, 0.005))] * len(centers)
    return LanguageModel(idf, np.concatenate(all_centers) if all_centers else np.zeros((0, DIMENSIONS), np.float32), names, np.array(least))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, similarity) of every row."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        for part in slices(batches, "text", K.SLICE):
            names, values = [], []
            for _, x in counts(part.column(1)):
                name, value = shared.value.classify(x)
                names += name
                values.append(value)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(np.round(np.concatenate(values), 6))], ["id", "language", "similarity"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(label, f"id {kind}, language string, similarity double").withColumnRenamed("id", id_col)
