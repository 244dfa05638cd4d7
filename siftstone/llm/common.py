"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.checkpoint import ensure_checkpoint_dir, materialize

__all__ = [
    "bit_table", "drop_rows", "ensure_checkpoint_dir", "fresh", "give_back", "in_table", "materialize", "pieces", "plan_bytes", "row_id", "row_key", "sized_join", "slices", "small_batches", "string_offsets", "yield_clashes",
]

#: A side of a join is broadcast up to this many bytes (rows counted after they were written), beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> None:
    """Bound the bytes of an Arrow batch in this session, unless it has a bound of its own: long texts come in few rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    df.sparkSession.conf.set(key, df.sparkSession.conf.get(key, str(BATCH_BYTES)))


def plan_bytes(df: DataFrame) -> int:
    """The planner's size estimate (for files, their size on disk); where it has none, as after a checkpoint, the rows' bytes are counted."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size <= 1 << 60:
        return size
    texts = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)).cast("bigint") for c, t in df.dtypes if t in ("string", "binary")]
    return int(df.agg(F.coalesce(F.sum(sum(texts, F.lit(8 * len(df.columns)))), F.lit(0))).first()[0])


def pieces(df: DataFrame, each: int, least: int = 1) -> int:
    """So many pieces of about `each` bytes; grows with the input."""
    return max(least, -(-plan_bytes(df) // each))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, made from names."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def yield_clashes(df: DataFrame, *names: str) -> DataFrame:
    """df with any column called like one of the operator's output columns renamed to <name>_input."""
    for name in names:
        for c in df.columns:
            if c.lower() == name.lower():
                df = df.withColumnRenamed(c, fresh(df, f"{c}_input")[0])
    return df


def _values(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`").cast("string") if t.startswith(("map", "array", "struct", "variant", "interval")) else F.col(f"`{c}`") for c, t in df.dtypes]


def row_key(df: DataFrame) -> Column:
    """64-bit hash of all of a row's values, for spreading and ordering rows; not an identity."""
    return F.xxhash64(*_values(df))


def row_id(df: DataFrame) -> Column:
    """A row's identity: two 64-bit hashes of all its values and of which are null, with unrelated seeds. Rows are taken for equal if both agree."""
    told = [x for c, v in zip(df.columns, _values(df), strict=True) for x in (v, F.col(f"`{c}`").isNull())]
    return F.struct(F.xxhash64(*told).alias("a"), F.xxhash64(F.lit("other seed"), *told).alias("b"))


def sized_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str, row_bytes: int = 32) -> DataFrame:
    """Join with a materialized right side: broadcast if its counted rows fit BROADCAST_BYTES (64 bytes a row at least, as measured), else an ordinary shuffled join."""
    if right.count() * max(64, row_bytes) <= BROADCAST_BYTES:
        right = F.broadcast(right)
    return left.join(right, on, how)


def drop_rows(docs: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """docs without the rows decided against.

    keys is materialized: one row per row of docs with the row's identity (row_id) and `keep`. Of wholly equal rows, which
    share it, one stays if any is to be kept; they are brought together by a partial aggregation, however many there are.
    """
    (name,) = fresh(docs, "__key")
    each = keys.groupBy(key).agg(F.count("*").alias("n"), F.max("keep").alias("keep"))
    each = materialize(each.where("n > 1 or not keep").withColumnRenamed(key, name))
    keyed = docs.withColumn(name, row_id(docs))
    rest = sized_join(keyed, each.where("not keep").select(name), name, "left_anti", 32)
    again = each.where("keep").select(name)
    if not again.isEmpty():
        once = sized_join(rest, again, name, "left_semi", 32).dropDuplicates([name])
        rest = sized_join(rest, again, name, "left_anti", 32).unionByName(once)
    return rest.drop(name)


#: Bits of a bit table, as a power of two, at least and at most: 8 to 64 MB.
BITS, MOST_BITS = 26, 29


_CHUNK, _SHIFTS = 14, (29, 17)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, bits) -> (chunk, words): the partition's words of the table, 1 << _CHUNK of them in a row."""
    import numpy as np

    chunks: dict[int, np.ndarray] = {}
    for batch in batches:
        w, bits = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for c in np.unique(w >> _CHUNK):
            here = w >> _CHUNK == c
            chunks.setdefault(int(c), np.zeros(1 << _CHUNK, np.int64))[w[here] & ((1 << _CHUNK) - 1)] = bits[here]
    if chunks:
        yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array([x.tobytes() for x in chunks.values()], pa.binary())], ["chunk", "words"])


def bit_table(keys: DataFrame, column: str, n: int = 0):
    """A table of BITS to MOST_BITS bits, 8 for each of about n values if possible, with two set for each value of a bigint column; the driver gets its 8 to 64 MB, whatever the number of values.

    in_table() is true for every value that was entered, and for few others while there are fewer values than bits; with
    more it thins out less, but never loses one.
    """
    import numpy as np

    width = min(max(BITS, (8 * n).bit_length()), MOST_BITS)
    at = [F.shiftrightunsigned(F.col(column).bitwiseXOR(F.shiftleft(column, shift)), 64 - width) for shift in _SHIFTS]
    places = keys.select(F.explode(F.array(*at)).alias("p"))
    words = places.select(F.shiftright("p", 6).cast("int").alias("w"), "p").groupBy("w").agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))
    packed = words.repartition(16, F.shiftright("w", _CHUNK)).mapInArrow(_chunks, "chunk int, words binary").toArrow()
    table = np.zeros(1 << (width - 6), np.int64)
    for batch in packed.to_batches():
        for c, x in zip(*batch.columns, strict=True):
            table[c.as_py() << _CHUNK : (c.as_py() + 1) << _CHUNK] = np.frombuffer(x.as_buffer(), np.int64)
    del packed
    give_back()
    return table.view(np.uint8)


def in_table(table, values):
    """Places of the 64-bit values that the table may hold."""
    import numpy as np

    at, width = None, (8 * len(table)).bit_length() - 1
    for shift in _SHIFTS:
        some = values if at is None else values[at]
        bit = ((some ^ (some << np.uint64(shift))) >> np.uint64(64 - width)).astype(np.int64)
        hit = np.flatnonzero((table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
        at = hit if at is None else at[hit]
    return at


#: glibc's: gives the heap's free pages back when a task ends, as workers outlive their tasks; None elsewhere.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return free memory of Arrow's pool and of the heap to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the named string column has about limit bytes in each (a longer text stays whole)."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        offsets = string_offsets(text)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def string_offsets(array: pa.Array):
    """Byte offsets of an Arrow string array's values, as int64."""
    import numpy as np

    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
