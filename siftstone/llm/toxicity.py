"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Voters vote toxic (+1), clean (-1) or abstain. Some look words up in lexicons: a fixed list of insults for each of four
languages, and words and word beginnings that go with toxic labels, dealt to disjoint lists; others are patterns
(insulting address in four languages, masked letters, shouting, exclamation) or look at density over the whole text.
Words are counted over all labelled rows by grouped aggregation; near copies of a toxic text, which share their least
shingle, support a word once.

The label model knows no labels but the class balance. Over all documents it takes the votes' means and second moments,
fits a rank-one structure to the covariances (two votes that are independent given the class covary by the product of
their accuracies), takes the pairs that stray from it for correlated, refits without them, and discounts correlated
voters. Its posterior probabilities label a bounded sample of all documents, on which a logistic regression is fitted
over the voters' strengths; that classifier decides every document over its whole text.

Defined cases: null, empty and wordless texts are not toxic; repeated rows get equal scores; null doc_ids are scored
like others; labels that miss, repeat or contradict are averaged by doc_id; without labels the fixed lists and the
patterns vote alone; an empty table gives an empty table; other columns are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm import textkernel as K
from siftstone.llm.common import fresh, materialize, sized_join, slices, small_batches

#: Bounds of the sample of documents that the classifier is fitted on, and of the words that may enter the lexicons (the best supported ones).
FITTED, WORDS = 20000, 1 << 20
LISTS, PREFIXES = 6, (4, 5, 6, 7, 8, 9)
LIFT, SUPPORT, BALANCE = 8.0, 5, 0.1
INSULTS = {
    "en": """idiot idiots moron morons stupid dumb dumbass loser losers scum trash worthless pathetic disgusting clown clowns imbecile
fool retard bastard jerk creep freak coward vermin degenerate filth garbage shitty shit fuck fucking bitch asshole crap""",
    "de": "idiotisch dumm dummkopf trottel arschloch scheisse scheiße abschaum versager wertlos ekelhaft blödmann drecksack",
    "fr": "idiote imbécile connard connasse salaud merde ordure débile pourriture minable crétin abruti dégoûtant",
    "es": "idiota imbécil estúpido estúpida basura mierda cabrón pendejo gilipollas escoria asqueroso patético inútil payaso",
}
#: What stands before a word of a fixed list in an insulting address; letters masked by signs within a word.
ADDRESS = re.compile(
    rb"(?:^|[^a-z])(?:you(?:'re|(?: are)?)|this|these|such|du|ihr|sie sind|bist|seid|tu es|t'es|vous \xc3\xaates|esp\xc3\xa8ce d[e']|eres|sois|son|usted es)(?: an?| all| so| ein(?:e|en)?| une?| des| una?s?| unos)? ?$", re.I
)
MASKED = re.compile(rb"(?<=[A-Za-z])(?:\*{1,4}|[@$#%]{2,4})(?=[A-Za-z])")
#: Columns of strengths(): mined lists, fixed lists, then these.
_FIXED, _ANY = LISTS, LISTS + len(INSULTS)
_WORDS, _CAPITALS, _SHOUTS, _ADDRESS, _MASKED, _ALL = (_ANY + k for k in range(1, 7))


def word_hash(words: list[str]) -> np.ndarray:
    w = K.words(pa.array(words))
    return np.unique(w.hash)


@dataclass
class Lexicon:
    """Hashes of the fixed lists and of what was mined; mined hits are dealt to disjoint lists by the hash of the whole word."""

    fixed: list[np.ndarray]
    mined: np.ndarray

    def __post_init__(self) -> None:
        self.all = np.unique(np.concatenate([*self.fixed, self.mined]))
        self.owner = np.full(len(self.all), -1)
        for k in range(len(self.fixed))[::-1]:
            self.owner[np.isin(self.all, self.fixed[k])] = k
        self.quick = np.zeros(1 << 18, bool)
        self.quick[self.all & K.U((1 << 18) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places that are in the lexicon, and the number of their fixed list, -1 for mined ones."""
        maybe = np.flatnonzero(self.quick[hashes & K.U((1 << 18) - 1)])
        at = np.minimum(np.searchsorted(self.all, hashes[maybe]), len(self.all) - 1)
        sure = self.all[at] == hashes[maybe]
        return maybe[sure], self.owner[at[sure]]


def beginnings(w: K.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, hashes): the whole words, then their first bytes where they are longer."""
    yield np.arange(len(w.start)), w.hash
    length = w.end - w.start
    for n in PREFIXES:
        at = np.flatnonzero(length > n)
        yield at, w.prefix_hash(w.start[at], w.start[at] + n)


def strengths(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row per text: hits of each list, hits of any, words, capitals' share, exclamations, insulting addresses, masked words."""
    w = K.words(texts)
    n = len(texts)
    out = np.zeros((n, _ALL), np.float32)
    list_of = np.full(len(w.start), -1)
    for k, (places, hashes) in enumerate(beginnings(w)):
        at, owner = lexicon.find(hashes)
        hit = places[at]
        fixed = (owner >= 0) & (k == 0)
        dealt = np.where(list_of[hit] >= _FIXED, list_of[hit], (w.hash[hit] % K.U(LISTS)).astype(np.int64))
        list_of[hit] = np.where(fixed, _FIXED + owner, dealt)
    hits = list_of >= 0
    for k in range(_ANY):
        out[:, k] = np.bincount(w.doc[list_of == k], minlength=n)
    out[:, _ANY] = np.bincount(w.doc[hits], minlength=n)
    out[:, _WORDS] = np.diff(w.first)
    size = np.diff(w.offsets)
    for column, mask in ((_CAPITALS, (w.raw >= 65) & (w.raw <= 90)), (_SHOUTS, w.raw == 33)):
        count = np.r_[0, np.cumsum(mask)]
        out[:, column] = (count[w.offsets[1:]] - count[w.offsets[:-1]]) / np.maximum(size, 1)
    data = w.raw.tobytes()
    for k in np.flatnonzero(list_of >= _FIXED):
        begin = max(w.offsets[w.doc[k]], w.start[k] - 24)
        out[w.doc[k], _ADDRESS] += ADDRESS.search(data[begin : w.start[k]]) is not None
    for match in MASKED.finditer(data):
        out[np.searchsorted(w.offsets, match.start(), side="right") - 1, _MASKED] += 1
    return out


def features(x: np.ndarray) -> np.ndarray:
    """The classifier's inputs: logarithms of counts and densities."""
    words = np.maximum(x[:, _WORDS : _WORDS + 1], 1)
    counts = x[:, : _ANY + 1]
    return np.concatenate([np.log1p(counts), np.log1p(1000 * counts / words), x[:, [_CAPITALS, _SHOUTS]], np.log1p(x[:, [_ADDRESS, _MASKED]])], axis=1).astype(np.float64)


def votes(x: np.ndarray) -> np.ndarray:
    """The voters' votes, -1, 0 or 1."""
    words = np.maximum(x[:, _WORDS], 1)
    density = x[:, : _ANY + 1] / words[:, None]
    lists = (x[:, :_FIXED] >= 1).sum(axis=1)
    out = [np.where((x[:, k] >= 2) & (density[:, k] >= 0.0015), 1, 0) for k in range(LISTS)]
    out += [np.where(x[:, k] >= 2, 1, 0) for k in range(_FIXED, _ANY)]
    out.append(np.where(density[:, _ANY] >= 0.012, 1, np.where(density[:, _ANY] < 0.005, -1, 0)))
    out.append(np.where(x[:, _ANY] == 0, -1, np.where(x[:, _ANY] >= 3, 1, 0)))
    out.append(np.where(lists >= 3, 1, np.where(lists <= 1, -1, 0)))
    out.append(np.where(x[:, _CAPITALS] > 0.5, 1, 0))
    out.append(np.where(x[:, _SHOUTS] > 0.02, 1, 0))
    out.append(np.where(x[:, _ADDRESS] > 0, 1, 0))
    out.append(np.where(x[:, _MASKED] > 0, 1, 0))
    return np.stack(out, axis=1).astype(np.int8)


def signs(v: np.ndarray) -> np.ndarray:
    """Two indicators per voter: toxic vote, clean vote."""
    return np.concatenate([v > 0, v < 0], axis=1).astype(np.float64)


def moments(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """(text) -> one row of the partition's count, sums and products of the indicators."""
    total = None
    for part in slices(batches, "text", K.SLICE):
        z = signs(votes(strengths(part.column(0), lexicon)))
        z = np.concatenate([np.ones((len(z), 1)), z], axis=1)
        total = z.T @ z if total is None else total + z.T @ z
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["i", "v"])


@dataclass
class LabelModel:
    """P(vote | class) of each indicator, a discount for correlated ones, and the class balance."""

    toxic: np.ndarray
    clean: np.ndarray
    discount: np.ndarray
    balance: float

    def posterior(self, v: np.ndarray) -> np.ndarray:
        z = signs(v)
        logit = np.log(self.balance / (1 - self.balance)) + (z * self.discount) @ np.log(self.toxic / self.clean)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_label_model(moment: np.ndarray, balance: float) -> LabelModel:
    """Accuracies from the off-diagonal covariances, without the correlated pairs; voters' own two indicators are such a pair."""
    n = max(moment[0, 0], 1)
    mean = moment[0, 1:] / n
    cov = moment[1:, 1:] / n - np.outer(mean, mean)
    m = len(mean) // 2
    used = ~np.eye(2 * m, dtype=bool)
    used[np.arange(m), np.arange(m) + m] = used[np.arange(m) + m, np.arange(m)] = False
    sigma = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    corr = cov / np.outer(sigma, sigma)
    direction = np.r_[np.ones(m), -np.ones(m)]
    for _ in range(6):
        a = direction * 0.3
        for _ in range(300):
            for i in range(2 * m):
                w = a * used[i]
                denominator = (w**2).sum()
                a[i] = (corr[i] * w).sum() / denominator if denominator > 1e-9 else 0.0
            a = np.clip(a, -0.98, 0.98)
        if (a * direction).sum() < 0:
            a = -a
        rest = np.abs(corr - np.outer(a, a)) * used
        strong = rest > max(0.12, 4 * np.median(rest[used]))
        if not strong.any() or (used & ~strong).sum(axis=1).min() < 4:
            break
        used &= ~strong
    rest = np.clip(corr - np.outer(a, a), 0, 1)
    np.fill_diagonal(rest, 0)
    rest[np.arange(m), np.arange(m) + m] = rest[np.arange(m) + m, np.arange(m)] = 0
    strength = a * sigma / np.sqrt(balance * (1 - balance))
    toxic = np.clip(mean + (1 - balance) * strength, 1e-4, 1 - 1e-4)
    clean = np.clip(mean - balance * strength, 1e-4, 1 - 1e-4)
    return LabelModel(toxic, clean, 1 / (1 + rest.sum(axis=1)), balance)


@dataclass
class Classifier:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((f - self.center) / self.scale @ self.weights + self.bias, -30, 30)))


def fit_classifier(f: np.ndarray, p: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> Classifier:
    """Logistic regression on soft labels, by Newton steps."""
    center, scale = f.mean(axis=0), np.maximum(f.std(axis=0), 1e-6)
    x = np.concatenate([(f - center) / scale, np.ones((len(f), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.full(x.shape[1] - 1, l2 * len(f)), 1e-9]
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (q - p) + ridge * w
        step = np.linalg.solve((x * np.maximum(q * (1 - q), 1e-6)[:, None]).T @ x + np.diag(ridge), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(center, scale, w[:-1], float(w[-1]))


def _items(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct words and beginnings of each text, ordered by hash."""
    w = K.words(texts)
    parts = [(w.doc[places], hashes) for places, hashes in beginnings(w)]
    doc, hashes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((doc, hashes))
    doc, hashes = doc[order], hashes[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return doc[first], hashes[first]


def supported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) of toxic rows -> distinct (item, copy): words and beginnings, and the least shingle of the text."""
    for part in slices(batches, "text", K.SLICE):
        hashes, doc = K.shingle_sets(K.words(part.column(0)), 3)
        copy = np.zeros(part.num_rows, K.U)
        if len(doc):
            at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            copy[doc[at]] = hashes[at]
        doc, items = _items(part.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(items.view(np.int64)), pa.array(copy[doc].view(np.int64))], ["item", "copy"])


def counted(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(text) of clean rows -> (i, n): in how many of the partition's texts each known item stands; i = len(known): the texts."""
    total = np.zeros(len(known) + 1, np.int64)
    for part in slices(batches, "text", K.SLICE):
        total[-1] += part.num_rows
        _, items = _items(part.column(0))
        at = np.minimum(np.searchsorted(known, items), len(known) - 1)
        total += np.bincount(at[known[at] == items], minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["i", "n"])


def mine(rows: DataFrame, words: int = WORDS) -> np.ndarray:
    """Hashes of words and beginnings that go with toxic labels, counted over all rows (text, y)."""
    toxic, clean = rows.where("y >= 0.5").select("text"), rows.where("y < 0.5").select("text")
    found = toxic.mapInArrow(supported, "item bigint, copy bigint")
    items = found.distinct().groupBy("item").agg(F.count("*").alias("n"))
    some = items.where(F.col("n") >= SUPPORT).orderBy(F.desc("n"), "item").limit(words).toPandas().sort_values("item", key=lambda x: x.to_numpy(np.int64).view(K.U))
    if not len(some):
        return np.zeros(0, K.U)
    known, with_toxic = some["item"].to_numpy(np.int64).view(K.U), some["n"].to_numpy(np.int64)
    n1 = found.select("copy").distinct().count()
    shared = rows.sparkSession.sparkContext.broadcast(known)
    rest = clean.mapInArrow(lambda it: counted(it, shared.value), "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    with_clean = np.zeros(len(known) + 1)
    with_clean[rest["i"].to_numpy(int)] = rest["n"].to_numpy(float)
    lift = ((with_toxic + 0.5) / (n1 + 1)) / ((with_clean[:-1] + 0.5) / (with_clean[-1] + 1))
    return known[lift >= LIFT]


def bounded(df: DataFrame, column: str, bound: int, total: int) -> DataFrame:
    """About `bound` rows of df at most, chosen by a hash of column; all of them where there are no more. Values of column must be distinct."""
    if total <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(column), F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * bound / total)).limit(2 * bound)


@dataclass
class Model:
    lexicon: Lexicon
    labels: LabelModel
    classifier: Classifier


def train(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", fitted: int = FITTED) -> Model:
    small_batches(docs)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    mined, balance = np.zeros(0, K.U), BALANCE
    if labels is not None:
        known = materialize(labels.where("toxic is not null").groupBy(F.col("doc_id").alias("id")).agg(F.avg("toxic").alias("y")).where("id is not null"))
        rows = sized_join(slim, known, "id", "inner", 24).select("text", "y")
        mined = mine(rows)
        share = rows.agg(F.avg(F.when(F.col("y") >= 0.5, 1.0).otherwise(0.0))).first()[0]
        balance = BALANCE if share is None else float(np.clip(share, 0.02, 0.5))
    lexicon = Lexicon([word_hash(words.split()) for words in INSULTS.values()], mined)
    shared = slim.sparkSession.sparkContext.broadcast(lexicon)
    rows = slim.select("text").mapInArrow(lambda it: moments(it, shared.value), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    size = 2 * votes(np.zeros((1, _ALL))).shape[1] + 1
    moment = np.zeros(size * size)
    moment[rows["i"].to_numpy(int)] = rows["v"].to_numpy(float)
    model = fit_label_model(moment.reshape(size, size), balance)

    def sampled(batches):
        for part in slices(batches, "text", K.SLICE):
            x = strengths(part.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], ["h", "x"])

    # chosen by text and once per distinct text, so that a text with any number of copies can't exceed the bound
    part = F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, fitted / max(1.0, moment[0])))
    some = slim.select(F.xxhash64("text", F.lit(5)).alias("h"), "text").where(part).mapInArrow(sampled, "h bigint, x array<float>").dropDuplicates(["h"]).limit(2 * fitted).toPandas()
    x = np.stack(some["x"].to_numpy()) if len(some) else np.zeros((1, _ALL), np.float32)
    x = x[np.lexsort(x.T)]
    return Model(lexicon, model, fit_classifier(features(x), model.posterior(votes(x))))


def score(docs: DataFrame, model: Model, column: str = "toxicity", text_col: str = "text") -> DataFrame:
    """docs with the probability that each is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        array = pa.array(texts, pa.string(), from_pandas=True).fill_null("")
        out, start = [], 0
        batch = pa.RecordBatch.from_arrays([array], ["text"])
        for part in slices(iter([batch]), "text", K.SLICE):
            x = strengths(part.column(0), shared.value.lexicon)
            out.append(np.where(x[:, _WORDS] > 0, shared.value.classifier.score(features(x)), 0.0))
            start += part.num_rows
        return pd.Series(np.concatenate(out)) if out else pd.Series([], dtype="float64")

    return docs.withColumn(column, probability(F.col(text_col).cast("string")))


def drop_toxic(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose probability is below threshold."""
    (column,) = fresh(docs, "__toxicity")
    return score(docs, train(docs, labels, id_col, text_col), column, text_col).where(F.col(column) < threshold).drop(column)
