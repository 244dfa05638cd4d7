"""Document quality by hierarchical empirical Bayes.

A logistic regression over surface features of the whole text, fitted on a bounded sample of labelled rows, gives each
document's own evidence. Hosts and paths pool the evidence of all their documents by grouped aggregation: a host's rate
is shrunk toward the global rate, a path's toward its host's, with prior strengths estimated from the spread of the group
means (method of moments), so that sparse sites stay near their prior. A document's quality is its own log-odds, moved
by its path's log-odds above the global ones.

Defined cases: null and empty texts have the features of no words; null hosts and paths are groups of their own;
repeated rows count each; labels of one doc_id are averaged, null and unmatched ones ignored; without labels of both
kinds every document's evidence is the global rate 0.5; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm import textkernel as K
from siftstone.llm.common import fresh, materialize, sized_join, slices, small_batches
from siftstone.llm.toxicity import Classifier, bounded, fit_classifier

#: Bound of the labelled sample that the document classifier is fitted on (about; twice as many rows at most).
LABELLED, THRESHOLD = 20000, 0.5
_SETS = [np.isin(np.arange(256), list(chars)) for chars in (range(65, 91), range(48, 58), b" ", b"\n", b"!?", b"#$%&*", b"|<>{}[]=/\\", b".,;:", range(128, 256))]


def surface(texts: pa.Array) -> np.ndarray:
    """One row of features per text."""
    w = K.words(texts)
    n = len(texts)
    size = np.maximum(np.diff(w.offsets), 1)
    words = np.diff(w.first)
    many = np.maximum(words, 1)
    out = [np.log1p(words), np.log1p(size), np.bincount(w.doc, w.end - w.start, n) / many]
    for members in _SETS:
        count = np.r_[0, np.cumsum(members[w.raw])]
        out.append((count[w.offsets[1:]] - count[w.offsets[:-1]]) / size)
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, np.int64)
    run = np.diff(np.r_[first, len(h)])
    most = np.zeros(n)
    np.maximum.at(most, d[first], run)
    out += [np.bincount(d[first], minlength=n) / many, most / many, np.bincount(d[first], run.astype(float) ** 2, n) / many**2]
    same = np.zeros(len(w.hash))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    out.append(np.bincount(w.doc, same, n) / many)
    for k in (2, 5):
        shingles, doc = K.shingle_sets(w, k)
        out.append(np.bincount(doc, minlength=n) / np.maximum(words - k + 1, 1))
    x = np.stack(out, axis=1)
    return np.concatenate([x, x[:, 3:] ** 2, np.sqrt(np.abs(x[:, 3:]))], axis=1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> Classifier | None:
    known = labels.where("quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.avg("quality").alias("y")).where("id is not null")
    sample = F.broadcast(bounded(known, "id", labelled, known.count()))
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(sample, "id").select("y", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", K.SLICE):
            x = surface(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], ["y", "x"])

    rows = slim.mapInArrow(measure, "y double, x array<double>").limit(2 * labelled).toPandas()
    if not len(rows) or rows["y"].min() >= 0.5 or rows["y"].max() < 0.5:
        return None
    x, y = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy()
    order = np.lexsort((*x.T, y))
    return fit_classifier(x[order], y[order], 1e-4)


def evidence(docs: DataFrame, model: Classifier | None, host: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, host, path, p_doc): the documents' own probabilities."""
    small_batches(docs)
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", K.SLICE):
            p = np.clip(shared.value.score(surface(part.column(3))), 1e-4, 1 - 1e-4) if shared.value is not None else np.full(part.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.round(p, 9))], ["id", "host", "path", "p_doc"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(measure, f"id {kind}, host string, path string, p_doc double")


def strength(groups: DataFrame, mean: str, n: str, prior: str) -> float:
    """Prior strength k of a beta prior by moments: the groups' squared distance from their prior, less sampling noise."""
    row = groups.agg(
        F.sum(F.col(n) * (F.col(mean) - F.col(prior)) ** 2).alias("spread"), F.sum(F.col(prior) * (1 - F.col(prior))).alias("noise"), F.sum(n).alias("n"),
        F.sum(F.col(n) * F.col(prior) * (1 - F.col(prior))).alias("top"),
    ).first()
    if not row["n"]:
        return 1.0
    between = max(row["spread"] - row["noise"], 0.0) / row["n"]
    return float(np.clip(row["top"] / row["n"] / max(between, 1e-9) - 1, 1.0, 1e4))


def site(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL column: the host without `www.` and port in small letters, and the path's folders without its last part; null for null and unreadable URLs."""
    text = F.trim(url.cast("string"))
    host = F.lower(F.regexp_extract(text, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?(?:[wW]{3}\.)?([^/:?#]+)", 1))
    path = F.regexp_extract(text, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/(?:[^?#/]*/)*)", 1)
    known = F.length(host) > 0
    return F.when(known, host), F.when(known, F.when(F.length(path) > 0, path).otherwise("/"))


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, url: str | None = None) -> DataFrame:
    """(doc_id, p_doc, host_rate, path_rate, quality, keep) of every row.

    url names a column that host and path are read from; without one, host names the host's column and path one that
    parts a host's documents.
    """
    if url is not None:
        host, path = fresh(docs, "__host", "__path")
        docs = docs.withColumns(dict(zip((host, path), site(F.col(url)), strict=True)))
    own = materialize(evidence(docs, fit(docs, labels, id_col, text_col), host, path, id_col, text_col))
    paths = materialize(own.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = hosts.agg(F.sum("host_s") / F.sum("host_n")).first()[0]
    rate = float(np.clip(0.5 if total is None else total, 1e-4, 1 - 1e-4))
    hosts = hosts.withColumn("prior", F.lit(rate)).withColumn("mean", F.col("host_s") / F.col("host_n"))
    k_host = strength(hosts, "mean", "host_n", "prior")
    hosts = hosts.withColumn("host_rate", (F.lit(k_host * rate) + F.col("host_s")) / (F.lit(k_host) + F.col("host_n")))
    joined = paths.join(hosts.select(F.col("host").alias("h"), "host_rate"), F.col("host").eqNullSafe(F.col("h"))).drop("h").withColumn("mean", F.col("s") / F.col("n"))
    k_path = strength(joined, "mean", "n", "host_rate")
    rates = materialize(joined.select(F.xxhash64(F.coalesce("host", F.lit("\0")), F.coalesce("path", F.lit("\0"))).alias("site"), F.col("host").alias("h"), F.col("path").alias("p"), "host_rate", ((F.lit(k_path) * F.col("host_rate") + F.col("s")) / (F.lit(k_path) + F.col("n"))).alias("path_rate")))
    sited = own.withColumn("site", F.xxhash64(F.coalesce("host", F.lit("\0")), F.coalesce("path", F.lit("\0"))))
    both = sized_join(sited, rates, "site", "inner", 96).where(F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))

    def logit(c: str):
        bounded_ = F.least(F.greatest(F.col(c), F.lit(1e-4)), F.lit(1 - 1e-4))
        return F.log(bounded_ / (1 - bounded_))

    odds = logit("p_doc") + logit("path_rate") - F.lit(float(np.log(rate / (1 - rate))))
    value = F.round(1 / (1 + F.exp(-odds)), 9)
    return both.select(F.col("id").alias(id_col), "p_doc", F.round("host_rate", 9).alias("host_rate"), F.round("path_rate", 9).alias("path_rate"), value.alias("quality"), (value >= threshold).alias("keep"))
