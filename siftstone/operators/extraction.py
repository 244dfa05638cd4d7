"""Facts from texts by a language model: extraction, ontology, merging of duplicates, chunk merging, reports.

Prompts are short and ours; replies are JSON and are checked row by row. What can't be read is kept as an issue, never
as a fact. All replies are materialized before they are used, so that no model is asked twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from siftstone.checkpoint import materialize
from siftstone.functions import text as T
from siftstone.models import LanguageModel, ask, first_json
from siftstone.operators import graph

ENTITY = StructType([StructField(n, StringType()) for n in ("name", "type", "subtype", "description")])
RELATION = StructType([StructField(n, StringType()) for n in ("source", "target", "type", "name", "description")])
FACTS = StructType([StructField("entities", ArrayType(ENTITY)), StructField("relations", ArrayType(RELATION)), StructField("error", StringType())])
EXTRACT = 'List the things named in the text and how they are related. Reply with JSON {"entities": [{"name", "type", "subtype", "description"}], "relations": [{"source", "target", "type", "name", "description"}]}.\nText:\n'
REPORT = 'Describe this group of related things. Reply with JSON {"title", "summary", "rating", "findings": [{"summary", "explanation"}]}.\n'


def _rows(items: object, required: tuple[str, ...], names: tuple[str, ...]) -> tuple[list[dict], int]:
    good, bad = [], 0
    for item in items if isinstance(items, list) else []:
        row = {n: (str(item.get(n)).strip() if item.get(n) is not None else None) for n in names} if isinstance(item, dict) else {}
        if all(row.get(n) for n in required):
            good.append(row)
        else:
            bad += 1
    return good, bad


def read_facts(reply: str | None) -> dict:
    """Checked entities and relations of a reply; rows without their required fields go and are counted in error."""
    found = first_json(reply)
    if found is None:
        return {"entities": [], "relations": [], "error": "no JSON object in the reply"}
    entities, bad = _rows(found.get("entities"), ("name", "type"), ENTITY.fieldNames())
    relations, worse = _rows(found.get("relations"), ("source", "target", "type"), RELATION.fieldNames())
    return {"entities": entities, "relations": relations, "error": f"{bad + worse} rows without required fields" if bad + worse else None}


def extract(chunks: DataFrame, model: LanguageModel, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, issues) of chunks (document_id, chunk_id, text); chunks in existing (chunk_id) are left out.

    Relations keep only ends that are entities of their chunk, by lower-case name.
    """
    new = chunks if existing is None else chunks.join(existing.select("chunk_id").distinct(), "chunk_id", "left_anti")
    read = F.pandas_udf(lambda replies: pd.DataFrame([read_facts(r) for r in replies], columns=FACTS.fieldNames()), FACTS)
    asked = ask(new.select("document_id", "chunk_id", F.concat(F.lit(EXTRACT), "text").alias("prompt")), "prompt", model).drop("prompt")
    found = materialize(asked.select("document_id", "chunk_id", read("reply").alias("facts")))
    e = found.select("document_id", "chunk_id", F.explode("facts.entities").alias("x")).select("document_id", "chunk_id", "x.*")
    entities = e.withColumn("entity_id", T.entity_id(F.col("document_id"), F.col("chunk_id"), F.col("name"), F.col("type"), F.col("subtype"), F.coalesce("description", F.lit(""))))
    named = entities.groupBy("chunk_id", T.normal_name(F.col("name")).alias("key")).agg(F.min("entity_id").alias("id"))
    r = found.select("document_id", "chunk_id", F.explode("facts.relations").alias("x")).select("document_id", "chunk_id", "x.*")
    for side in ("source", "target"):
        r = r.withColumn("key", T.normal_name(F.col(side))).join(named.withColumnRenamed("id", f"{side}_id"), ["chunk_id", "key"]).drop("key")
    relations = r.withColumn("relation_id", T.relation_id(F.col("document_id"), F.col("chunk_id"), F.col("source_id"), F.col("target_id"), F.col("type"), F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))))
    return entities, relations, found.where("facts.error is not null").select("chunk_id", F.col("facts.error").alias("issue"))


def constrain(entities: DataFrame, relations: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities of the ontology's types (type), and the relations that keep both of their ends."""
    kept = entities.join(kinds.select(T.normal_name(F.col("type")).alias("__k")).distinct(), T.normal_name(F.col("type")) == F.col("__k"), "left_semi")
    ids = kept.select("entity_id").distinct()
    for side in ("source_id", "target_id"):
        relations = relations.join(ids.withColumnRenamed("entity_id", side), side, "left_semi")
    return kept, relations


def describe_groups(groups: DataFrame, model: LanguageModel | None, text: str = "texts", words: int = 200) -> DataFrame:
    """groups with description: the distinct texts joined, rewritten by the model only where they are longer than `words`."""
    joined = groups.withColumn("description", F.array_join(F.array_distinct(text), graph.SEPARATOR))
    if model is None:
        return joined
    prompt = F.when(T.count_words(F.col("description")) > words, F.concat(F.lit("Summarise these notes on one subject:\n"), "description"))
    return ask(joined.withColumn("__prompt_in", prompt), "__prompt_in", model).withColumn("description", F.coalesce("reply", "description")).drop("reply", "__prompt_in")


def merge_chunk_group(chunks: list[dict], near, decide, rounds: int = 10) -> list[dict]:
    """Chunks of one document merged round by round: near(chunks) gives index pairs (i, j, similarity) to consider, best first;
    decide(texts) gives the merged text or None. A chunk takes part in one merge of a round; stops when a round merges
    nothing or less than one in twenty of the first count.
    """
    first = len(chunks)
    for _ in range(rounds):
        used: set[int] = set()
        merged: list[dict] = []
        candidates: dict[int, list[int]] = {}
        for i, j, _ in near(chunks):
            candidates.setdefault(i, []).append(j)
        for i, chunk in enumerate(chunks):
            if i in used:
                continue
            others = [j for j in candidates.get(i, [])[:5] if j not in used and j != i]
            text = decide([chunk["text"], *(chunks[j]["text"] for j in others)]) if others else None
            if text is None:
                merged.append(chunk)
                continue
            used |= {i, *others}
            parts = [chunk, *(chunks[j] for j in others)]
            merged.append({"text": text, "start": min(p["start"] for p in parts), "end": max(p["end"] for p in parts), "parents": list(dict.fromkeys(x for p in parts for x in p["parents"]))})
        merged = [m for k, m in enumerate(merged) if m is not None]
        kept = [c for c in merged if not any(c is chunks[j] for j in used)]
        removed = len(chunks) - len(kept)
        chunks = kept
        if removed == 0 or removed / max(first, 1) < 0.05:
            break
    return chunks


def merge_chunks(chunks: DataFrame, model: LanguageModel, threshold: float = 0.85, top: int = 8) -> DataFrame:
    """(document_id, text, token_start, token_end, parent_chunk_ids) of chunks (document_id, chunk_id, chunk_index, text, token_start, token_end, vector).

    A document is one task, as each merge depends on the one before; the model decides from the texts (reply JSON {"text"}).
    Merged chunks keep their first member's vector for later rounds.
    """
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_index")
        rows = [{"text": r.text, "start": int(r.token_start), "end": int(r.token_end), "parents": [r.chunk_id]} for r in pdf.itertuples()]
        vector = dict(zip(pdf["chunk_id"], pdf["vector"], strict=True))

        def near(items: list[dict]) -> Iterator[tuple[int, int, float]]:
            v = np.stack([np.asarray(vector[i["parents"][0]], float) for i in items])
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            s = v @ v.T
            np.fill_diagonal(s, -1)
            for i in range(len(items)):
                for j in np.argsort(-s[i], kind="stable")[:top]:
                    if s[i, j] >= threshold:
                        yield i, int(j), float(s[i, j])

        def decide(texts: list[str]) -> str | None:
            reply = first_json(model.invoke(["Merge these passages if they say the same. Reply with JSON {\"text\"}, null if they differ.\n" + json.dumps(texts, ensure_ascii=False)])[0])
            text = (reply or {}).get("text")
            return text if isinstance(text, str) and text.strip() else None

        out = merge_chunk_group(rows, near, decide)
        return pd.DataFrame({"document_id": pdf["document_id"].iloc[0], "text": [r["text"] for r in out], "token_start": [r["start"] for r in out], "token_end": [r["end"] for r in out], "parent_chunk_ids": [r["parents"] for r in out]})

    kind = dict(chunks.dtypes)["document_id"]
    return chunks.groupBy("document_id").applyInPandas(run, f"document_id {kind}, text string, token_start bigint, token_end bigint, parent_chunk_ids array<string>")


def report_contexts(members: DataFrame, edges: DataFrame, texts: DataFrame, budget: int = 2000) -> DataFrame:
    """(community, context): members (community, node) by degree, then edges among them by rank, each half of the budget of words."""
    from siftstone.operators.search import budget_prefix

    inside = graph.edge_ranks(edges).join(members.select("community", F.col("node").alias("source")), "source").join(members.select("community", F.col("node").alias("target")), ["community", "target"])
    nodes = members.join(graph.degrees(edges), "node", "left").join(texts, "node").select("community", F.lit(0).alias("kind"), F.coalesce("degree", F.lit(0)).alias("weight"), F.concat_ws(": ", "node", "text").alias("line"))
    lines = nodes.unionByName(inside.select("community", F.lit(1).alias("kind"), F.col("rank").alias("weight"), F.concat_ws(" - ", "source", "target").alias("line"))).withColumn("n", T.count_words(F.col("line")))
    kept = budget_prefix(lines, ["community", "kind"], [F.desc("weight"), F.asc("line")], "n", budget // 2, keep_first=False)
    return kept.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "position", "line"))), lambda x: x["line"]), "\n").alias("context"))


def reports(contexts: DataFrame, model: LanguageModel) -> DataFrame:
    """(community, title, report, rating): read from the model's reply, with defaults for what it lacks."""
    shape = "title string, summary string, rating double"
    asked = ask(contexts.withColumn("prompt", F.concat(F.lit(REPORT), "context")), "prompt", model).drop("prompt")
    parsed = asked.withColumn("x", F.from_json(T.first_object(F.col("reply")), shape))
    return materialize(parsed.select("community", F.coalesce("x.title", F.lit("Community report")).alias("title"), F.coalesce("x.summary", "reply", F.lit("")).alias("report"), F.coalesce("x.rating", F.lit(-1.0)).alias("rating")))
