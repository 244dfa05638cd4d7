"""Models as plug-ins: what the engine asks of them, how tables are sent through them, and deterministic stand-ins."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LanguageModel(Protocol):
    def invoke(self, prompts: Sequence[str]) -> list[str]: ...


class EmbeddingModel(Protocol):
    dimension: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def rank(self, query: str, texts: Sequence[str]) -> list[tuple[int, float]]: ...


@dataclass
class HashEmbedder:
    """Buckets of character codes at unit sum; for tests."""

    dimension: int = 8

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            codes = np.array([ord(c) % 31 for c in text], float) / 31
            sums = np.bincount(np.arange(len(codes)) % self.dimension, codes, self.dimension)
            out.append((sums / (sums.sum() or 1.0)).tolist())
        return out


@dataclass
class KeywordEmbedder:
    """An axis for each keyword that a text holds, and a constant one; for tests."""

    keywords: tuple[str, ...]

    @property
    def dimension(self) -> int:
        return len(self.keywords) + 1

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [[*(float(k.lower() in t.lower()) for k in self.keywords), 0.1] for t in texts]


@dataclass
class RuleModel:
    """Answers by a function of the prompt; for tests, and for models behind a client made once in each worker."""

    answer: Callable[[str], str]

    def invoke(self, prompts: Sequence[str]) -> list[str]:
        return [self.answer(p) for p in prompts]


@dataclass
class OverlapReranker:
    """Scores texts by the share of the query's words that they hold; for tests."""

    def rank(self, query: str, texts: Sequence[str]) -> list[tuple[int, float]]:
        words = set(query.lower().split())
        scores = [len(words & set(t.lower().split())) / max(len(words), 1) for t in texts]
        return sorted(enumerate(scores), key=lambda x: (-x[1], x[0]))


def _batches(texts: list[str], size: int) -> Iterator[list[str]]:
    for at in range(0, len(texts), size):
        yield texts[at : at + size]


def embed(rows: DataFrame, text_col: str, model: EmbeddingModel, out: str = "vector", batch: int = 128) -> DataFrame:
    """rows with the model's vector of each text; null texts have none. Materialize the result before it is used twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = rb.column(rb.num_columns - 1).to_pylist()
            known = [t for t in texts if t is not None]
            vectors: list[list[float]] = []
            for part in _batches(known, batch):
                got = model.embed(part)
                if len(got) != len(part) or any(len(v) != model.dimension for v in got):
                    raise ValueError("the model returned other vectors than asked for")
                vectors += got
            given = iter(vectors)
            column = pa.array([None if t is None else next(given) for t in texts], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*rb.columns[:-1], column], [*rb.schema.names[:-1], out])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{out}` array<float>"
    return rows.withColumn("__text", F.col(text_col).cast("string")).mapInArrow(run, schema)


def ask(rows: DataFrame, prompt_col: str, model: LanguageModel, out: str = "reply", batch: int = 16) -> DataFrame:
    """rows with the model's reply to each prompt, null where it failed; null prompts aren't sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            prompts = rb.column(rb.num_columns - 1).to_pylist()
            replies: list[str | None] = [None] * len(prompts)
            for at in _batches([i for i, p in enumerate(prompts) if p is not None], batch):
                try:
                    for i, reply in zip(at, model.invoke([prompts[i] for i in at]), strict=True):
                        replies[i] = reply
                except Exception:  # noqa: BLE001 - one by one, so that a failing prompt costs only itself
                    for i in at:
                        try:
                            replies[i] = model.invoke([prompts[i]])[0]
                        except Exception:  # noqa: BLE001
                            replies[i] = None
            yield pa.RecordBatch.from_arrays([*rb.columns[:-1], pa.array(replies, pa.string())], [*rb.schema.names[:-1], out])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{out}` string"
    return rows.withColumn("__prompt", F.col(prompt_col).cast("string")).mapInArrow(run, schema)


def rerank(results: DataFrame, reranker: Reranker, k: int) -> DataFrame:
    """results (query_id, query, place, id, text) in the reranker's order, k of each query; indexes out of range are errors."""

    def run(pdf):
        pdf = pdf.sort_values("place").reset_index(drop=True)
        order = reranker.rank(pdf["query"].iloc[0], pdf["text"].tolist())
        if any(not 0 <= i < len(pdf) for i, _ in order):
            raise ValueError("the reranker named a text that it wasn't given")
        kept = pdf.iloc[[i for i, _ in order[:k]]].copy()
        kept["place"], kept["score"] = range(1, len(kept) + 1), [s for _, s in order[:k]]
        return kept[["query_id", "place", "id", "score"]]

    kinds = dict(results.dtypes)
    return results.select("query_id", "query", "place", "id", "text").groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, place bigint, id {kinds['id']}, score double")


def first_json(reply: str | None) -> dict | None:
    """The first complete JSON object in a reply, past thinking blocks and fences; null if there is none."""
    import re

    text = re.sub(r"(?is)<think>.*?</think>", "", reply or "")
    decoder = json.JSONDecoder()
    for match in re.finditer(r"\{", text):
        try:
            found, _ = decoder.raw_decode(text, match.start())
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None
