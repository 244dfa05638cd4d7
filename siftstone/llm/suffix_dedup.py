"""Repeated passages, found by a logarithmic family of sparse suffix arrays.

A passage is repeated if a window of `MIN_WORDS` consecutive words also stands in an earlier document (by doc_id).
Suffixes are ordered by the fingerprint of their `LEAD` leading words, so that suffixes with an equal beginning are
neighbours, and the arrays are sparse: the windows of a text whose least suffix is the same form a cell, and only that
suffix is in the array. Its entry has the fingerprint (the mark), the first and last document that it was met in, and the
least and greatest fingerprint of all words of its cells (the spans). Equal windows have equal marks.

The family: levels of such arrays, each sorted by mark. A new batch gets its array, which is merge-scanned (by sorted
joins on the mark) with the levels for beginnings that another document has; then it enters at rank 0, and while two
levels have the same rank they merge into one of the next. Levels can be saved and loaded, so that a later run only makes
the array of its own batch. cut_repeats takes the older half of its table for the batch before and the newer half for the
one that arrives.

Cells whose mark was met in another document are then decided from the texts: a cell whose whole span stands in an earlier
document is repeated from end to end; where spans differ, the first document of each span has its cell's windows compared
one by one at full length. Only those windows travel, not those of whole copies. Marks, spans and windows that any number
of documents share are aggregated before they are shuffled, and joined with what was found about them.

Defined cases: words as in textkernel (case and punctuation are ignored); rows of one doc_id are one document and do not
repeat each other; null doc_ids and null or short texts never repeat; texts of any length are read whole; an empty table
gives an empty result; other columns, whatever their names, are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from siftstone.llm import textkernel as K
from siftstone.llm.common import bit_table, fresh, in_table, materialize, row_key, sized_join, slices, small_batches

MIN_WORDS, LEAD = 50, 25
#: A place in a document: number of the first window's first word, and the number of windows.
_BITS = 32


def cells(batches: Iterator[pa.RecordBatch], min_words: int = MIN_WORDS, lead: int = LEAD, table: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(doc, text) -> (doc, place, mark, span): a row for each run of windows with the same least suffix; with a bit table of marks, only for those."""
    for part in slices(batches, "text", K.SLICE):
        w = K.words(part.column(1))
        at = K.whole(w, min_words)
        if not len(at):
            continue
        least = K.sliding(K.windows(w.hash, lead), min_words - lead + 1, np.minimum, np.iinfo(K.U).max)[at]
        doc = w.doc[at]
        edge = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
        count = np.diff(np.r_[edge, len(at)])
        if table is not None:
            known = in_table(table, least[edge])
            edge, count = edge[known], count[known]
        first, doc = at[edge], doc[edge]
        span = K.range_hashes(w.hash, first, first + count + min_words - 1)
        place = ((first - w.first[doc]) << _BITS) | count
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(place), pa.array(least[edge].view(np.int64)), pa.array(span.view(np.int64))], ["doc", "place", "mark", "span"])


_CELLS = "doc bigint, place bigint, mark bigint, span bigint"
_ENTRY = ("mark", "first", "last", "low", "high")


def merge(*arrays: DataFrame) -> DataFrame:
    """One array (mark, first, last, low, high) of several, one entry for each mark."""
    rows = arrays[0]
    for other in arrays[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("mark").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("low").alias("low"), F.max("high").alias("high"))


def suffix_array(texts: DataFrame) -> DataFrame:
    """Entries (mark, first, last, low, high) of the texts' (doc, text) cells, one for each cell; merge() makes them an array."""
    return texts.mapInArrow(cells, _CELLS).select("mark", F.col("doc").alias("first"), F.col("doc").alias("last"), F.col("span").alias("low"), F.col("span").alias("high"))


class Family:
    """Levels (rank, array), ranks falling; of the batches added, 2 ** rank are in a level."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, entries: DataFrame) -> DataFrame:
        """Enter a batch's entries as an array; returns (mark, differ): its marks that another document has, there or in a level, and whether their spans differ.

        Levels of equal rank merge at once, and the merged array, which the scan needs anyway, is written once.
        """
        rank, joined = 0, [entries]
        while self.levels and self.levels[-1][0] == rank:
            joined.append(self.levels.pop()[1])
            rank += 1
        array = materialize(merge(*joined).sortWithinPartitions("mark"))
        self.levels.append((rank, array))
        older = Family()
        older.levels = self.levels[:-1]
        return older.scan(array)

    def scan(self, entries: DataFrame) -> DataFrame:
        """What add() returns, without entering the batch."""
        all_ = merge(entries, *(level for _, level in self.levels))
        return all_.where(F.col("first") != F.col("last")).select("mark", (F.col("low") != F.col("high")).alias("differ"))

    def save(self, path: str) -> None:
        """Write the levels as Parquet, parted by rank and sorted by mark."""
        for k, (rank, level) in enumerate(self.levels):
            level.select(F.lit(rank).alias("rank"), *_ENTRY).sortWithinPartitions("mark").write.mode("append" if k else "overwrite").partitionBy("rank").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Family:
        family, rows = cls(), spark.read.parquet(path)
        for (rank,) in sorted(rows.select("rank").distinct().collect(), reverse=True):
            family.levels.append((rank, rows.where(F.col("rank") == rank).select(*_ENTRY)))
        return family


def decide(texts: DataFrame, met: DataFrame) -> DataFrame:
    """(doc, place, span, whole), materialized: cells of met marks (mark, differ) that are repeated from end to end, or (not whole) to be compared window by window."""
    met = materialize(met)
    table = texts.sparkSession.sparkContext.broadcast(bit_table(met, "mark"))
    found = materialize(sized_join(texts.mapInArrow(lambda it: cells(it, table=table.value), _CELLS), met, "mark", "inner", 16))
    firsts = found.groupBy("mark", "span").agg(F.min("doc").alias("first"))
    known = found.join(firsts, ["mark", "span"]).withColumn("whole", F.col("doc") > F.col("first"))
    return materialize(known.where("whole or differ").select("doc", "place", "span", "whole"))


def _found(w: K.Words, places: pa.Array, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, number of windows) of the places (place, span) that stand in their row's text.

    Rows of one doc_id share their places; a place whose words aren't those of its span is another row's.
    """
    row = np.repeat(np.arange(len(places)), np.asarray(places.value_lengths().fill_null(0)))
    flat = places.flatten()
    place, span = np.asarray(flat.field(0)), np.asarray(flat.field(1)).view(K.U)
    begin, count = w.first[row] + (place >> _BITS), place & ((1 << _BITS) - 1)
    end = begin + count + min_words - 1
    fits = np.flatnonzero(end <= w.first[row + 1])
    fits = fits[K.range_hashes(w.hash, begin[fits], end[fits]) == span[fits]]
    return row[fits], begin[fits], count[fits]


def window_rows(batches: Iterator[pa.RecordBatch], min_words: int = MIN_WORDS) -> Iterator[pa.RecordBatch]:
    """(doc, places, text) -> (doc, place, span, lead): a place for each window of the named cells; span and lead are the fingerprints of all its words and of the first half."""
    for part in slices(batches, "text", K.SLICE):
        w = K.words(part.column(2))
        row, begin, count = _found(w, part.column(1), min_words)
        if not len(row):
            continue
        at = np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        owner = np.repeat(row, count)
        span, lead = K.windows(w.hash, min_words)[at], K.windows(w.hash, min_words // 2)[at]
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(((at - w.first[owner]) << _BITS) | 1), pa.array(span.view(np.int64)), pa.array(lead.view(np.int64))], ["doc", "place", "span", "lead"])


def char_ranges(texts: pa.Array, places: pa.Array, min_words: int = MIN_WORDS) -> pa.Array:
    """Character ranges of the words that the places' windows cover; touching windows are one range. start from 0, stop exclusive."""
    w = K.words(texts)
    row, begin, count = _found(w, places, min_words)
    order = np.lexsort((begin, row))
    row, begin, count = row[order], begin[order], count[order]
    end = begin + count + min_words - 1
    reach = np.maximum.accumulate(end)
    at = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (begin[1:] > reach[:-1])]) if len(end) else np.zeros(0, np.int64)
    last = reach[np.r_[at[1:], len(end)] - 1] if len(at) else at
    chars = K.chars_before(w.raw)
    base = chars[w.offsets[row[at]]]
    ranges = pa.StructArray.from_arrays([pa.array((chars[w.start[begin[at]]] - base).astype(np.int32)), pa.array((chars[w.end[last - 1]] - base).astype(np.int32))], ["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row[at], minlength=len(texts)))].astype(np.int32)), ranges)


@F.arrow_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())])))
def _ranges(texts: pa.Array, places: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([texts.fill_null(""), places], ["text", "places"])
    out = [char_ranges(part.column(0), part.column(1)) for part in slices(iter([batch]), "text", K.SLICE)]
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))


def _moved(docs: DataFrame, id_col: str, name: str) -> DataFrame:
    """docs with an id, dealt by it. Used twice in one plan with all its columns, so that the texts are shuffled once."""
    return docs.where(F.col(id_col).isNotNull()).withColumn(name, F.col(id_col).cast("bigint")).repartition(F.col(name))


def repeated_places(docs: DataFrame, moved: DataFrame, name: str, id_col: str, text_col: str) -> DataFrame:
    """(__doc, __places): the repeated windows of each document that has any."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")
    low, high = slim.agg(F.min("doc"), F.max("doc")).first()
    middle = ((low or 0) + (high or 0)) // 2
    family = Family()
    family.add(suffix_array(slim.where(F.col("doc") <= middle)))
    decided = decide(slim, family.scan(suffix_array(slim.where(F.col("doc") > middle))))
    compared = decided.where("not whole").groupBy(F.col("doc").alias(name)).agg(F.collect_list(F.struct("place", "span")).alias("places"))
    texts = moved.join(compared.hint("shuffle_hash"), name).select(F.col(name).alias("doc"), "places", F.col(text_col).cast("string").alias("text"), row_key(moved).alias("all"))
    windows = texts.where(F.col("all").isNotNull()).mapInArrow(window_rows, "doc bigint, place bigint, span bigint, lead bigint")
    origins = windows.groupBy("span", "lead").agg(F.min("doc").alias("origin"), F.max("doc").alias("last")).where("origin < last")
    later = windows.join(origins, ["span", "lead"]).where("origin < doc").select("doc", "place", "span")
    places = decided.where("whole").drop("whole").unionByName(later)
    return places.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("place", "span")).alias("__places"))


def _with_ranges(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs that have an id, with an array of character ranges, null where nothing repeats; and that column's name."""
    small_batches(docs)
    name, ranges, places, doc = fresh(docs, "__id", "__ranges", "__places", "__doc")
    moved = _moved(docs, id_col, name)
    found = repeated_places(docs, moved, name, id_col, text_col).toDF(doc, places)
    both = moved.join(found.hint("shuffle_hash"), F.col(name) == F.col(doc), "left")
    repeated = F.col(places).isNotNull() & F.col(text_col).isNotNull()
    text = F.when(repeated, F.col(text_col).cast("string"))
    return both.withColumn(ranges, F.when(repeated, _ranges(text, F.col(places)))).select(*[F.col(f"`{c}`") for c in docs.columns], ranges), ranges


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, stop): maximal character ranges whose windows all stand in an earlier document.

    start counts from 0, stop is exclusive. id_col must be of an integer type.
    """
    out, ranges = _with_ranges(docs, id_col, text_col)
    return out.select(id_col, F.explode(ranges).alias("x")).select(id_col, "x.start", "x.stop")


def _cut(text: Column, cuts: Column) -> Column:
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda x: x["stop"]))
    stops = F.concat(F.transform(cuts, lambda x: x["start"]), F.array(F.length(text)))
    return F.array_join(F.zip_with(starts, stops, lambda a, b: F.substring(text, a + 1, b - a)), "")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs without their repeated passages (the first document keeps each); texts of which nothing but separators stays go.

    length_col, where docs has it, becomes the new length. Documents without repeats are unchanged.
    """
    keyed, ranges = _with_ranges(docs, id_col, text_col)
    (left_name,) = fresh(keyed, "__left")
    whole = F.col(ranges).isNull() | (F.size(ranges) == 0)
    out = keyed.withColumn(left_name, F.when(whole, F.col(text_col)).otherwise(_cut(F.col(text_col), F.col(ranges)))).where(whole | F.col(left_name).rlike(r"[\p{L}\p{N}]"))
    changed = {text_col: F.col(left_name)}
    if length_col in docs.columns:
        changed[length_col] = F.when(whole, F.col(length_col)).otherwise(F.length(left_name).cast(dict(docs.dtypes)[length_col]))
    out = out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
    return out.unionByName(docs.where(F.col(id_col).isNull()))
