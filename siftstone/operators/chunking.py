"""Token windows, chunks with lineage, heading sections, record blocks.

A window holds `size` tokens (code points, for which no tokenizer is needed); unless it is the last, it ends after the
last split mark in it. The next one starts `overlap` before its end. If that would not advance, faithful mode stops and
drops the tail; with strict_tail it goes on from the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions import text as T

SIZE, OVERLAP = 1024, 50
MARKS = ("。", ".", ",", "，", "!", "?", "！", "？", "\n")


def split_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP, marks: tuple[str, ...] = MARKS, strict_tail: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, stripped text) of each window; blank and null texts have none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must lie within 0 and size")
    if text is None or not text.strip():
        return []
    out, start, total = [], 0, len(text)
    while start < total:
        end = min(start + size, total)
        if end < total:
            at = max(text.rfind(mark, start, end) for mark in marks)
            if at > start:
                end = at + 1
        piece = text[start:end].strip()
        if piece:
            out.append((start, end, piece))
        if end >= total:
            break
        if end - overlap > start:
            start = end - overlap
        elif strict_tail:
            start = end
        else:
            break
    return out


def sections(markdown: str | None) -> list[tuple[list[str], str]]:
    """(heading path, text) of Markdown: headings of level 1 to 6 part it, those within code fences don't."""
    stack: list[tuple[int, str]] = []
    out: list[tuple[list[str], list[str]]] = [([], [])]
    fence = ""
    for line in (markdown or "").split("\n"):
        mark = re.match(r"\s*(```+|~~~+)", line)
        if mark and (not fence or mark[1].startswith(fence)):
            fence = "" if fence else mark[1]
        heading = None if fence else re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if heading:
            level = len(heading[1])
            stack = [x for x in stack if x[0] < level] + [(level, heading[2])]
            out.append(([t for _, t in stack], []))
        else:
            out[-1][1].append(line)
    joined = [(path, "\n".join(lines).strip()) for path, lines in out]
    return [(path, text) for path, text in joined if text]


def windows(pages: DataFrame, keys: list[str], text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP, marks: tuple[str, ...] = MARKS, strict_tail: bool = False) -> DataFrame:
    """(keys, token_start, token_end, text): the windows of each row. Rows stay on their task; nothing is shuffled."""
    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", token_start bigint, token_end bigint, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = split_text(batch.column(len(keys))[row].as_py(), size, overlap, marks, strict_tail)
                if found:
                    take = pa.array([row] * len(found))
                    start, end, text = zip(*found, strict=True)
                    columns = [*(batch.column(i).take(take) for i in range(len(keys))), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(text, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, [*keys, "token_start", "token_end", "text"])

    return pages.select(*keys, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def chunks(pages: DataFrame, document: str, page: str | None = None, **options) -> DataFrame:
    """(document_id, page_index, chunk_index, chunk_id, token_start, token_end, text); chunk_index runs through a document's pages."""
    named = pages.select(F.col(document).alias("document_id"), (F.col(page) if page else F.lit(0)).cast("bigint").alias("page_index"), F.col(options.pop("text_col", "text")).alias("text"))
    cut = windows(named, ["document_id", "page_index"], **options)
    order = Window.partitionBy("document_id").orderBy("page_index", "token_start")
    numbered = cut.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("bigint"))
    return numbered.select("document_id", "page_index", "chunk_index", T.chunk_id(F.col("document_id"), F.col("page_index"), F.col("chunk_index"), F.col("text")).alias("chunk_id"), "token_start", "token_end", "text")


def lineage(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(chunk_id, parent_chunk_ids): parents of the same document and page whose token range overlaps, in order.

    The equality on document and page makes it a hash join; the range is a condition on its pairs.
    """
    up = parents.select("document_id", "page_index", F.col("chunk_id").alias("parent_id"), F.col("token_start").alias("a"), F.col("token_end").alias("b"), F.col("chunk_index").alias("place"))
    met = children.join(up, ["document_id", "page_index"]).where("b > token_start and a < token_end")
    return met.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "parent_id"))), lambda x: x["parent_id"]).alias("parent_chunk_ids"))


def rechunk(pieces: DataFrame, document: str, order: list[str], separator: str = "\n\n", **options) -> DataFrame:
    """Chunks of each document's pieces, joined in order and split again, with the pieces (by place) that each overlaps.

    (document_id, chunk_index, chunk_id, token_start, token_end, text, parents array<bigint>)
    """
    window = Window.partitionBy("document_id").orderBy(*order)
    placed = pieces.withColumnRenamed(document, "document_id").withColumn("place", (F.row_number().over(window) - 1).cast("bigint"))
    before = F.coalesce(F.sum(F.length("text") + len(separator)).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("a", before).withColumn("b", F.col("a") + F.length("text"))
    whole = placed.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), separator).alias("text"))
    cut = chunks(whole, "document_id", **options)
    met = cut.select("document_id", "chunk_id", "token_start", "token_end").join(placed.select("document_id", "place", "a", "b"), "document_id").where("b > token_start and a < token_end")
    parents = met.groupBy("chunk_id").agg(F.array_sort(F.collect_list("place")).alias("parents"))
    return cut.drop("page_index").join(parents, "chunk_id", "left")


def blocks(rows: DataFrame, columns: list[str], order: list[str], every: int = 50, by: list[str] | None = None) -> DataFrame:
    """(by, block, text): rows in blocks of `every`, each a Markdown table with the header; null cells are empty.

    Numbering sorts each group of `by` on one task: give the sheet, file or other key that bounds a table.
    """
    by = by or []
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(T.markdown_cell(F.col(c).cast("string")), F.lit("")) for c in columns]), F.lit(" |"))
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)) - 1)
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    grouped = numbered.groupBy(*by, F.floor(F.col("place") / every).cast("bigint").alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", cells.alias("line")))).alias("lines"))
    return grouped.select(*by, "block", F.concat(F.lit(head + "\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"))
