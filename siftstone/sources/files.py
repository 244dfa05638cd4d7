"""Raw objects, and readers of the file formats that knowledge bases and benchmarks come in."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftstone.functions import text as T
from siftstone.functions.text import document_id
from siftstone.operators.chunking import blocks
from siftstone.sources import html

ENCODINGS = ("utf-8-sig", "gb18030", "latin-1")
Parser = Callable[[DataFrame], DataFrame]


def checked_key(key: str) -> str:
    """An object key that stays below the root: relative, without empty parts, `.` or `..`."""
    parts = key.strip().replace("\\", "/").split("/")
    if not key.strip() or key.startswith(("/", "\\")) or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not an object key: {key!r}")
    return "/".join(parts)


def under(column: Column, prefix: str) -> Column:
    """Keys equal to the prefix or below it; whole path parts count, an empty prefix holds all."""
    clean = prefix.strip("/")
    return F.lit(True) if not clean else (column == clean) | F.startswith(column, F.lit(clean + "/"))


def raw_objects(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """(key, name, file_type, content, content_sha256, document_id) of the files under root, found recursively."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":")[-1].replace("//", "/")
    key = F.regexp_replace(F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*", "/"), "^/*" + base.lstrip("/") + "/", "")
    named = files.select(key.alias("key"), "content").where(under(F.col("key"), prefix))
    return named.select("key", F.element_at(F.split("key", "/"), -1).alias("name"), F.lower(F.regexp_extract("key", r"\.([^./]+)$", 1)).alias("file_type"), "content", F.sha2("content", 256).alias("content_sha256"), document_id(F.col("content")).alias("document_id"))


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of bytes in the first encoding that fits."""

    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        for encoding in ENCODINGS:
            try:
                return bytes(data).decode(encoding)
            except UnicodeDecodeError:
                continue
        return None

    return content.map(one)


def parse_text(objects: DataFrame) -> DataFrame:
    return objects.select("document_id", "key", F.lit(0).cast("bigint").alias("page_index"), decoded("content").alias("text"))


def parse_html(objects: DataFrame) -> DataFrame:
    pages = html.extract_pages(objects.select("document_id", "key", decoded("content").alias("html")), ["document_id", "key"])
    return pages.select("document_id", "key", F.lit(0).cast("bigint").alias("page_index"), "text")


def sheet_pages(data: str | None, name: str, every: int = 50) -> list[str]:
    """Markdown pages of CSV text: the first row is the header, blank rows go, blank heads are numbered, short rows are padded."""
    rows = [r for r in csv.reader(io.StringIO(data or "")) if any(c.strip() for c in r)]
    if not rows:
        return []
    width = max(map(len, rows))

    def line(cells: list[str]) -> str:
        safe = [c.strip().replace("\\", "\\\\").replace("|", "\\|").replace("\r\n", " ").replace("\n", " ") for c in cells]
        return "| " + " | ".join(safe + [""] * (width - len(safe))) + " |"

    head = [c.strip() or f"column_{i + 1}" for i, c in enumerate(rows[0] + [""] * (width - len(rows[0])))]
    out = []
    for at in range(1, max(len(rows), 2), every):
        title = f"Table: {name} / csv_sheet" + " (continued)" * (at > 1)
        out.append("\n".join([title, "", line(head), "|" + " --- |" * width, *map(line, rows[at : at + every])]))
    return out


def parse_sheet(objects: DataFrame) -> DataFrame:
    pages = F.pandas_udf(lambda text, name: pd.Series([sheet_pages(t, n) for t, n in zip(text, name, strict=True)]), "array<string>")
    return objects.select("document_id", "key", F.posexplode(pages(decoded("content"), "name")).alias("page_index", "text")).withColumn("page_index", F.col("page_index").cast("bigint"))


class Parsers:
    """File types and who parses them; a type can't be taken twice unless replaced. External extractors register here."""

    def __init__(self) -> None:
        self.by_type: dict[str, Parser] = {}

    def register(self, types: list[str], parser: Parser, replace: bool = False) -> None:
        for kind in types:
            kind = kind.lower().lstrip(".")
            if kind in self.by_type and not replace:
                raise ValueError(f"file type {kind} has a parser already")
            self.by_type[kind] = parser

    @classmethod
    def default(cls) -> Parsers:
        out = cls()
        out.register(["txt", "md", "markdown"], parse_text)
        out.register(["html", "htm"], parse_html)
        out.register(["csv"], parse_sheet)
        return out

    def parse(self, objects: DataFrame, existing: DataFrame | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
        """(pages, skipped objects): each type through its parser; documents that exist already aren't parsed again."""
        new = objects if existing is None else objects.join(existing.select("document_id").distinct(), "document_id", "left_anti")
        skipped = objects.where(~F.col("file_type").isin(*self.by_type)).select("key", "file_type")
        if strict and not skipped.isEmpty():
            raise ValueError("there are files of unsupported types")
        by_parser: dict[Parser, list[str]] = {}
        for kind, parser in self.by_type.items():
            by_parser.setdefault(parser, []).append(kind)
        parts = [parser(new.where(F.col("file_type").isin(*kinds))) for parser, kinds in by_parser.items()]
        pages = parts[0]
        for part in parts[1:]:
            pages = pages.unionByName(part)
        return pages.withColumn("token_count", T.count_words(F.col("text"))), skipped


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line, blank lines skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, id, relevance) of tab-separated lines, with or without a header; the last line of a pair counts."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    parts = F.split(F.trim("value"), "\t")
    rows = lines.where(F.size(parts) >= 3).select(parts[0].alias("query_id"), parts[1].alias("id"), parts[F.size(parts) - 1].try_cast("double").cast("int").alias("relevance"), "line").where("relevance is not null")
    return rows.groupBy("query_id", "id").agg(F.max_by("relevance", "line").alias("relevance"))


def bar_separated(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Trimmed columns of a |-separated file with a header; it must have the required ones."""
    rows = spark.read.csv(path, sep="|", header=True)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.select(*[T.strip(F.col(f"`{c}`")).alias(c) for c in rows.columns])


def page_texts(block_rows: DataFrame) -> DataFrame:
    """(document_id, page_index, text) of extractor blocks (document_id, position, page_index, kind, text): blocks without a page go with the last one."""
    so_far = Window.partitionBy("document_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = block_rows.withColumn("page_index", F.coalesce(F.last("page_index", True).over(so_far), F.lit(0)))
    return placed.groupBy("document_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


__all__ = ["Parsers", "bar_separated", "blocks", "checked_key", "decoded", "json_array", "json_lines", "page_texts", "qrels", "raw_objects", "sheet_pages", "under"]
