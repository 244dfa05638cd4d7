"""Knowledge bases: a recipe of steps builds tables, queries read them.

A step names the tables it needs and those it gives. A recipe is checked before anything runs. Each step's outcome is
recorded, so that a build goes on where it stopped; deletion lists what it would remove first, and never raw inputs.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.catalog import Catalog
from siftstone.models import EmbeddingModel, LanguageModel, embed
from siftstone.operators import chunking, extraction, graph, merge, modes, search
from siftstone.sources.files import Parsers, raw_objects

RUN = "_run.json"


@dataclass
class Parts:
    """What steps may use besides tables."""

    objects: str
    embedder: EmbeddingModel | None = None
    model: LanguageModel | None = None
    parsers: Parsers = field(default_factory=Parsers.default)


@dataclass(frozen=True)
class Step:
    name: str
    needs: tuple[str, ...]
    gives: tuple[str, ...]
    run: Callable[[SparkSession, Parts, Mapping[str, DataFrame]], dict[str, DataFrame]]
    parts: tuple[str, ...] = ()
    unlocks: tuple[str, ...] = ()


def parse_step() -> Step:
    def run(spark: SparkSession, parts: Parts, have: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        pages, skipped = parts.parsers.parse(raw_objects(spark, parts.objects))
        return {"pages": pages, "skipped": skipped}

    return Step("parse", (), ("pages", "skipped"), run)


def split_step(size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> Step:
    def run(spark: SparkSession, parts: Parts, have: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        return {"chunks": chunking.chunks(have["pages"], "document_id", "page_index", size=size, overlap=overlap)}

    return Step("split", ("pages",), ("chunks",), run)


def embed_step() -> Step:
    def run(spark: SparkSession, parts: Parts, have: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        return {"chunk_vectors": embed(have["chunks"].select("chunk_id", "document_id", "text"), "text", parts.embedder).drop("text")}

    return Step("embed", ("chunks",), ("chunk_vectors",), run, ("embedder",), ("vector_search",))


def full_text_step() -> Step:
    def run(spark: SparkSession, parts: Parts, have: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        return {"postings": search.postings(have["chunks"], "chunk_id", "text")}

    return Step("index_full_text", ("chunks",), ("postings",), run, (), ("full_text_search", "sql_text_search"))


def extract_step() -> Step:
    def run(spark: SparkSession, parts: Parts, have: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        entities, relations, issues = extraction.extract(have["chunks"].select("document_id", "chunk_id", "text"), parts.model)
        return {"entities": entities, "relations": relations, "issues": issues}

    return Step("extract", ("chunks",), ("entities", "relations", "issues"), run, ("model",))


def graph_step() -> Step:
    """Exact merging of facts by name, ends remapped, evidence by chunk, and the undirected graph."""

    def run(spark: SparkSession, parts: Parts, have: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        groups = merge.exact_groups(have["entities"], [F.lower(F.trim("name")), F.lower(F.trim("type"))], "entity_id", "name")
        mapped = merge.mapping(groups)
        facts = have["relations"].select("relation_id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type", "chunk_id")
        edges = graph.build_edges(merge.remap_relations(facts, mapped).select("source", "target", F.lit(1.0).alias("weight"), "type", F.col("relation_id").alias("position")))
        evidence = merge.retarget_evidence(have["entities"].select(F.col("entity_id").alias("fact_id"), "chunk_id"), mapped, ["fact_id", "chunk_id"])
        return {"nodes": groups, "edges": edges, "evidence": evidence}

    return Step("build_graph", ("entities", "relations"), ("nodes", "edges", "evidence"), run)


@dataclass
class Recipe:
    steps: list[Step]

    def problems(self, parts: Parts) -> list[str]:
        """What is missing or doubled: parts, tables that no earlier step gives, outputs given twice."""
        given: set[str] = set()
        out = []
        for step in self.steps:
            out += [f"{step.name} needs {p}" for p in step.parts if getattr(parts, p) is None]
            out += [f"{step.name} needs the table {t}, which no step before it gives" for t in step.needs if t not in given]
            out += [f"{step.name} gives the table {t} a second time" for t in step.gives if t in given]
            given |= set(step.gives)
        return out

    def unlocks(self) -> list[str]:
        return [m for s in self.steps for m in s.unlocks]


def basic_recipe(size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> Recipe:
    return Recipe([parse_step(), split_step(size, overlap), embed_step(), full_text_step()])


def graph_recipe(size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> Recipe:
    return Recipe([*basic_recipe(size, overlap).steps, extract_step(), graph_step()])


class KnowledgeBase:
    def __init__(self, spark: SparkSession, root: str, recipe: Recipe, parts: Parts) -> None:
        self.spark, self.recipe, self.parts, self.catalog = spark, recipe, parts, Catalog(spark, root)

    def build(self) -> dict:
        """Run the steps that have no recorded outcome yet; a failing one is recorded and raised, and build() goes on from it."""
        problems = self.recipe.problems(self.parts)
        if problems:
            raise ValueError("; ".join(problems))
        record = self.catalog.read_json(RUN)
        for step in self.recipe.steps:
            if record.get(step.name, {}).get("state") == "done":
                continue
            began = time.time()
            try:
                for name, rows in step.run(self.spark, self.parts, {t: self.catalog.read(t) for t in step.needs}).items():
                    self.catalog.write(name, rows)
            except Exception as error:
                record[step.name] = {"state": "failed", "error": str(error)[:500]}
                self.catalog.write_json(RUN, record)
                raise
            record[step.name] = {"state": "done", "seconds": round(time.time() - began, 3)}
            self.catalog.write_json(RUN, record)
        return record

    def manifest(self) -> dict:
        return {"steps": self.catalog.read_json(RUN), "tables": sorted(self.catalog.tables()), "modes": self.recipe.unlocks()}

    def query(self, queries: DataFrame, mode: str = "full_text_search", k: int = 10) -> DataFrame:
        """(query_id, mode, rank, id, score, text, document_id, page_index) of queries (query_id, text), by the engine registered for mode."""
        engine = ENGINES.get(mode)
        if engine is None:
            raise ValueError(f"no mode {mode}")
        if not set(engine.needs) <= set(self.recipe.unlocks()):
            raise ValueError(f"mode {mode} needs steps that this recipe lacks")
        ranked = engine.run(self, queries, k)
        named = ranked.join(self.searched().select(F.col("chunk_id").alias("id"), "text", "document_id", "page_index"), "id")
        return named.select("query_id", F.lit(mode).alias("mode"), F.col("rank").cast("bigint").alias("rank"), "id", "score", "text", "document_id", "page_index")

    def searched(self) -> DataFrame:
        """The chunks that modes search: those that aren't blank."""
        return self.catalog.read("chunks").where(F.trim("text") != "")

    def delete_plan(self) -> list[str]:
        return [f"table {t}" for t in sorted(self.catalog.tables())] + [f"record {RUN}"]

    def delete(self) -> list[str]:
        """Remove all tables and the record; what could not be removed is returned."""
        failed = []
        for name in self.catalog.tables():
            try:
                self.catalog.drop(name)
            except Exception as error:  # noqa: BLE001 - the rest is still removed
                failed.append(f"{name}: {error}")
        self.catalog.write_json(RUN, {})
        return failed


@dataclass(frozen=True)
class Engine:
    """Answers a mode: run(kb, queries (query_id, text), k) -> (query_id, id, score, rank); needs: the modes that its steps unlock."""

    needs: tuple[str, ...]
    run: Callable[[KnowledgeBase, DataFrame, int], DataFrame]


def vector_engine(kb: KnowledgeBase, queries: DataFrame, k: int) -> DataFrame:
    vectors = kb.catalog.read("chunk_vectors").select(F.col("chunk_id").alias("id"), "vector")
    return modes.hits(vectors, embed(queries.select("query_id", "text"), "text", kb.parts.embedder, "query_vector"), k)


def full_text_engine(kb: KnowledgeBase, queries: DataFrame, k: int) -> DataFrame:
    """BM25 over the stored postings; no text is read but to count the chunks."""
    index = kb.catalog.read("postings")
    stats = kb.searched().agg(F.count("*").alias("n")).crossJoin(F.broadcast(index.agg(F.sum("tf").alias("all")))).select("n", (F.coalesce("all", F.lit(0)) / F.greatest("n", F.lit(1))).alias("avg_len"))
    return search.top_k(search.bm25_index(index, stats, search.query_terms(queries, "query_id", "text")), k)


def substring_engine(kb: KnowledgeBase, queries: DataFrame, k: int) -> DataFrame:
    asked = queries.select("query_id", F.lower("text").alias("asked"))
    met = kb.searched().select(F.col("chunk_id").alias("id"), F.lower("text").alias("t")).join(asked, F.col("t").contains(F.col("asked")))
    return search.top_k(met.select("query_id", "id", F.when(F.col("t") == F.col("asked"), 1.0).otherwise(0.5).alias("score")), k)


def hybrid_engine(kb: KnowledgeBase, queries: DataFrame, k: int) -> DataFrame:
    parts = [run(kb, queries, modes.depth(k)).select("query_id", "id", "rank", F.lit(i).alias("list_no"), F.lit(1.0).alias("weight")) for i, run in enumerate((vector_engine, full_text_engine))]
    return search.fused_top(parts[0].unionByName(parts[1]), k)


#: Engines by mode; register_engine adds to them.
ENGINES: dict[str, Engine] = {
    "vector_search": Engine(("vector_search",), vector_engine),
    "full_text_search": Engine(("full_text_search",), full_text_engine),
    "sql_text_search": Engine(("sql_text_search",), substring_engine),
    "hybrid_search": Engine(("vector_search", "full_text_search"), hybrid_engine),
}


def register_engine(mode: str, engine: Engine) -> None:
    """Make KnowledgeBase.query answer a mode of one's own."""
    if mode in ENGINES:
        raise ValueError(f"mode {mode} has an engine")
    ENGINES[mode] = engine
