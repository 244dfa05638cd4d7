"""Wiki pages from documents, their index, and chunks that carry where they stand."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.operators.chunking import sections, split_text
from siftstone.operators.numbering import number_rows
from siftstone.session import small_batches

SUMMARY = 280


def title_of(text: str | None, name: str) -> str:
    """The first level-1 heading outside code fences, else the name without its ending."""
    for path, _ in sections((text or "") + "\n\n.") or []:
        if path:
            return path[0]
    return re.sub(r"\.[^.]+$", "", name.rsplit("/", 1)[-1]) or name


def relevel(text: str | None) -> str:
    """Headings two levels deeper, from 3 to 6, outside code fences; the page's own headings are above them."""
    out, fence = [], ""
    for line in (text or "").split("\n"):
        mark = re.match(r"\s*(```+|~~~+)", line)
        if mark and (not fence or mark[1].startswith(fence)):
            fence = "" if fence else mark[1]
        heading = None if fence else re.match(r"(#{1,6})(\s+\S.*)$", line)
        out.append("#" * min(max(len(heading[1]) + 2, 3), 6) + heading[2] if heading else line)
    return "\n".join(out)


def slug_of(title: str) -> str:
    plain = re.sub(r"[^a-z0-9一-鿿]+", "-", unicodedata.normalize("NFKC", title).lower())
    return plain.strip("-")[:80] or "page"


def pages(documents: DataFrame, id_col: str = "document_id", name_col: str = "name", text_col: str = "text") -> DataFrame:
    """(page_id, key, document_id, title, summary, text) of each document, numbered in order of its id; the summary is its beginning."""
    shape = "title string, slug string, body string"
    small_batches(documents)

    def build(texts: pd.Series, names: pd.Series) -> pd.DataFrame:
        titles = [title_of(t, n) for t, n in zip(texts, names, strict=True)]
        return pd.DataFrame({"title": titles, "slug": [slug_of(t) for t in titles], "body": [relevel(t) for t in texts]})

    made = documents.select(F.col(id_col).alias("document_id"), F.pandas_udf(build, shape)(F.col(text_col), F.col(name_col)).alias("x")).select("document_id", "x.*")
    numbered = number_rows(made, [F.asc("document_id")], "n").withColumn("n", F.col("n") + 1)
    summary = T.ellipsis(T.collapse(F.col("body")), SUMMARY)
    text = F.concat(F.lit("# "), "title", F.lit("\n\n## Summary\n\n"), summary, F.lit("\n\n## Content\n\n"), "body")
    return numbered.select(F.concat(F.lit("wiki_page_"), "n").alias("page_id"), F.concat("n", F.lit("-"), "slug", F.lit(".md")).alias("key"), "document_id", "title", summary.alias("summary"), text.alias("text"))


def index(made: DataFrame, every: int = 1000) -> DataFrame:
    """(part, text): lines of the index in order of the pages, `every` of them in a part."""
    number = F.regexp_extract("page_id", r"(\d+)$", 1).cast("bigint")
    lines = made.select(number.alias("n"), F.concat(F.lit("- ["), "title", F.lit("]("), "key", F.lit("): "), "summary").alias("line"))
    return lines.groupBy(F.floor((F.col("n") - 1) / every).cast("bigint").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))


def chunks(made: DataFrame, size: int = 1024, overlap: int = 50) -> DataFrame:
    """(page_id, document_id, chunk_index, heading_path, text): sections of pages under lines that name page and section.

    The lines count against the window; equal chunks of a page stay once.
    """
    shape = "array<struct<heading_path:array<string>,text:string>>"
    small_batches(made)

    def cut(titles: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for title, text in zip(titles, texts, strict=True):
            rows, seen = [], set()
            for path, body in sections(text):
                head = f"Page: {title}\nSection: {' > '.join(path)}\n"
                for _, _, piece in split_text(body, max(size - len(head), overlap + 1), overlap):
                    if piece not in seen:
                        seen.add(piece)
                        rows.append({"heading_path": path, "text": head + piece})
            out.append(rows)
        return pd.Series(out)

    found = made.select("page_id", "document_id", F.posexplode(F.pandas_udf(cut, shape)("title", "text")).alias("chunk_index", "x"))
    return found.select("page_id", "document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "x.heading_path", "x.text")
