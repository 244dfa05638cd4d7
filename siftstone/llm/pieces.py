"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Texts are cut into units (a run of spaces and the run of other characters after it); no piece of the vocabulary spans
two units, so each distinct unit is encoded once. All units of a batch lie in flat symbol arrays: every round finds each
unit's least pair rank by a segmented minimum, merges the leftmost such pair of every unit at once, re-ranks the two
pairs beside it, and compacts; units without a pair drop out, until none remains. In a long unit every pair that is the
least within the reach of a piece on both sides merges in the same round: no merge that comes before it can touch it, as
a symbol that reaches into that distance from outside would be longer than any piece. Rounds then don't grow with a unit's
length.

A unit met before takes its ids from a table by hash; every text is decoded and compared byte by byte, and one that
differs is encoded again without the table.

Characters outside the vocabulary become UTF-8 byte pieces. As in the library, a space is put before a text, spaces are
kept, and the character U+2581 counts as a space.

Defined cases: null texts have null ids; the empty text has no ids; repeated rows get equal ids; texts are encoded whole;
an empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm import textkernel as K
from siftstone.llm.common import slices, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NONE, _FAR = np.iinfo(np.int32).max, np.iinfo(np.int64).max
_SLICE, _CACHE = 8 << 20, 1 << 20


@dataclass
class Vocabulary:
    """Symbol of each code point, ranked pairs, and each piece's bytes."""

    size: int
    symbol: np.ndarray
    pair: np.ndarray
    rank: np.ndarray
    merged: np.ndarray
    data: np.ndarray
    begin: np.ndarray
    byte_id: np.ndarray
    reach: int

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        text, raw, byte_id = {}, [], np.zeros(256, np.int32)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_id[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b"")
            else:
                text[piece] = i
                raw.append(piece.replace("▁", " ").encode())
        if any("▁" in p.lstrip("▁") for p in text):
            raise ValueError("a piece of this vocabulary spans two words")
        symbol = np.arange(0x110000, dtype=np.int64) + n
        symbol[:128] = byte_id[:128]
        for piece, i in text.items():
            if len(piece) == 1:
                symbol[ord(piece)] = i
        symbol[32] = symbol[0x2581]
        one = {chr(c): int(symbol[c]) for c in {ord(ch) for p in text for ch in p}}
        known = text | {c: i for c, i in one.items() if c not in text}
        pairs = {}
        for piece, i in text.items():
            for cut in range(1, len(piece)):
                a, b = known.get(piece[:cut]), known.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * (1 << 21) + b] = (-model.get_score(i), i)
        keys = np.array(sorted(pairs), np.int64)
        scores = np.array([pairs[k][0] for k in keys])
        rank = np.unique(scores, return_inverse=True)[1].astype(np.int32)
        begin = np.r_[0, np.cumsum([len(x) for x in raw])]
        return cls(n, symbol, keys, rank, np.array([pairs[k][1] for k in keys], np.int64), np.frombuffer(b"".join(raw), np.uint8), begin, byte_id, max(map(len, text), default=1))

    def __post_init__(self) -> None:
        bits = 20
        table = np.full(1 << bits, -1, np.int32)
        at = self._place(self.pair)
        step = np.zeros(len(self.pair), np.int64)
        left = np.arange(len(self.pair))
        self.longest = 0
        while len(left):
            slot = (at[left] + step[left]) & (len(table) - 1)
            free = table[slot] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            won = free & first
            table[slot[won]] = left[won]
            self.longest = max(self.longest, int(step[left[won]].max(initial=0)))
            step[left[~won]] += ~free[~won] | (free & ~first)[~won]
            left = left[~won]
        self.table = table

    @staticmethod
    def _place(pair: np.ndarray) -> np.ndarray:
        return (K.mix(pair.astype(K.U)) >> K.U(44)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of each pair, -1 for pairs that don't merge."""
        key = a * (1 << 21) + b
        out = np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        at = self._place(key[left])
        for step in range(self.longest + 1):
            hit = self.table[(at + step) & (len(self.table) - 1)]
            same = (hit >= 0) & (self.pair[np.maximum(hit, 0)] == key[left])
            out[left[same]] = hit[same]
            go = (hit >= 0) & ~same
            left, at = left[go], at[go]
            if not len(left):
                break
        return out

    def ranks(self, number: np.ndarray) -> np.ndarray:
        return np.where(number >= 0, self.rank[np.maximum(number, 0)], NONE).astype(np.int32)


def nearby_least(rank: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """Those of the places `at` whose rank is the least of all within reach on both sides, the leftmost on ties."""
    key = (rank[at].astype(np.int64) << 32) | np.arange(len(at))
    edge = np.full(reach, _FAR)
    low = K.sliding(np.concatenate([edge, key, edge]), 2 * reach + 1, np.minimum, _FAR)
    return at[(key == low) & (rank[at] < NONE)]


def merge_rounds(symbols: np.ndarray, starts: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols of all units, and each unit's number of symbols."""
    units = len(starts)
    lengths = np.diff(np.r_[starts, len(symbols)])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    unit = np.repeat(np.arange(units), lengths)
    sym = symbols.astype(np.int64)
    number = np.full(len(sym), -1, np.int32)
    inner = np.flatnonzero(unit[1:] == unit[:-1])
    number[inner] = vocabulary.find(sym[inner], sym[inner + 1])
    rank = vocabulary.ranks(number)
    while len(sym):
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        least = np.minimum.reduceat(rank, first)
        count = np.diff(np.r_[first, len(sym)])
        going = least < NONE
        if not going.all():
            keep = np.repeat(going, count)
            out.append((unit[~keep], sym[~keep]))
            sym, unit, number, rank = sym[keep], unit[keep], number[keep], rank[keep]
            if not len(sym):
                break
            least, count = least[going], count[going]
        at = np.flatnonzero(rank == np.repeat(least, count))
        at = at[np.r_[True, unit[at[1:]] != unit[at[:-1]]]]
        far = count > 2 * vocabulary.reach + 1
        if far.any():
            inside = np.repeat(far, count)
            at = np.union1d(at[~inside[at]], nearby_least(rank, np.flatnonzero(inside), vocabulary.reach))
        sym[at] = vocabulary.merged[number[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        place = at - np.arange(len(at))
        sym, unit, number, rank = sym[keep], unit[keep], number[keep], rank[keep]
        touched = np.unique(np.concatenate([place, place[place > 0] - 1]))
        inside = touched[touched + 1 < len(sym)]
        ok = unit[inside] == unit[inside + 1]
        number[touched] = -1
        number[inside[ok]] = vocabulary.find(sym[inside[ok]], sym[inside[ok] + 1])
        rank[touched] = vocabulary.ranks(number[touched])
    owner = np.concatenate([o for o, _ in out]) if out else np.zeros(0, np.int64)
    flat = np.concatenate([s for _, s in out]) if out else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return flat[order], np.bincount(owner, minlength=units)


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated begin[i] .. begin[i]+length[i]."""
    return np.repeat(begin - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum()) if len(length) else np.zeros(0, np.int64)


class Encoder:
    """Encodes and decodes Arrow arrays; keeps the ids of units that it has met, up to _CACHE of them."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known, self.begin, self.length, self.flat = np.zeros(0, K.U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _units(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, given their bytes one after another with their lengths in self._lengths."""
        head = (raw & 0xC0) != 0x80
        at = np.flatnonzero(head)
        width = np.diff(np.r_[at, len(raw)])
        b0 = raw[at].astype(np.int64)
        point = np.where(width == 1, b0, np.where(width == 2, b0 & 0x1F, np.where(width == 3, b0 & 0x0F, b0 & 0x07)))
        for k in (1, 2, 3):
            more = np.flatnonzero(width > k)
            point[more] = (point[more] << 6) | (raw[at[more] + k] & 0x3F)
        symbols = self.v.symbol[point]
        starts = np.searchsorted(at, np.r_[0, np.cumsum(self._lengths)[:-1]])
        flat, count = merge_rounds(symbols, starts, self.v)
        strange = np.flatnonzero(flat >= self.v.size)
        if len(strange):
            codes = [chr(int(c)).encode() for c in flat[strange] - self.v.size]
            size = np.ones(len(flat), np.int64)
            size[strange] = [len(c) for c in codes]
            begin = np.r_[0, np.cumsum(size)]
            wide = np.repeat(flat, size)
            wide[ranges(begin[strange], size[strange])] = self.v.byte_id[np.frombuffer(b"".join(codes), np.uint8)]
            count = np.add.reduceat(size, np.r_[0, np.cumsum(count)[:-1]])
            flat = wide
        return flat.astype(np.int32), count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the number of ids of each text (nulls as empty)."""
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        if pc.any(pc.match_substring(texts, "▁")).as_py():
            texts = pc.replace_substring(texts, "▁", " ")
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" "), texts, ""))
        raw, offsets = K.raw_bytes(texts)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        space = raw == 32
        opens = np.zeros(len(raw) + 1, bool)
        opens[offsets] = True
        begins = opens[:-1].copy()
        begins[1:] |= space[1:] & ~space[:-1]
        start = np.flatnonzero(begins)
        end = np.r_[start[1:], len(raw)]
        mark = K.byte_hashes(raw, start, end)
        distinct, first, back = np.unique(mark, return_index=True, return_inverse=True)
        if len(self.known) > _CACHE:
            self.forget()
        at = np.searchsorted(self.known, distinct)
        met = (at < len(self.known)) & (self.known[np.minimum(at, max(len(self.known) - 1, 0))] == distinct) if len(self.known) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~met)
        if len(new):
            self._lengths = end[first[new]] - start[first[new]]
            flat, count = self._units(raw[ranges(start[first[new]], self._lengths)])
            begin = len(self.flat) + np.r_[0, np.cumsum(count)[:-1]]
            known = np.concatenate([self.known, distinct[new]])
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            self.begin, self.length = np.concatenate([self.begin, begin])[order], np.concatenate([self.length, count])[order]
            self.flat = np.concatenate([self.flat, flat])
            at = np.searchsorted(self.known, distinct)
        begin, length = self.begin[at][back], self.length[at][back]
        ids = self.flat[ranges(begin, length)]
        total = np.r_[0, np.cumsum(length)]
        edge = np.searchsorted(start, offsets)
        return ids, total[edge[1:]] - total[edge[:-1]]

    def repair(self, texts: pa.Array, spaced: pa.Array, ids: np.ndarray, count: np.ndarray, intact: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The ids with those texts that don't decode to themselves encoded alone, without the units met before."""
        parts = np.split(ids, np.cumsum(count)[:-1])
        for i in np.flatnonzero(np.asarray(pc.fill_null(pc.invert(intact), False))):
            parts[i], count[i : i + 1] = Encoder(self.v).encode(texts.slice(i, 1))
        ids = np.concatenate(parts)
        return ids, count, pc.equal(self.decode(ids, count), spaced)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> pa.Array:
        """Texts of the ids: pieces' bytes in order, without the space that encoding put before."""
        begin, length = self.v.begin[ids], np.diff(self.v.begin)[ids]
        data = self.v.data[ranges(begin, length)]
        total = np.r_[0, np.cumsum(length)]
        edge = np.r_[0, np.cumsum(count)]
        low, high = total[edge[:-1]], total[edge[1:]]
        low = low + ((high > low) & (data[np.minimum(low, max(len(data) - 1, 0))] == 32) if len(data) else 0)
        size = high - low
        out = data[ranges(low, size)]
        offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
        array = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])
        try:
            return array.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.as_py().decode("utf-8", "replace") for x in array], pa.string())


_encoders: list[tuple[Vocabulary, Encoder]] = []


def _encoder(shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary; its units stay known from task to task."""
    vocabulary = shared.value
    if not _encoders or _encoders[0][0] is not vocabulary:
        _encoders[:] = [(vocabulary, Encoder(vocabulary))]
    return _encoders[0][1]


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, intact): every text's ids; intact tells whether decoding them gives the text again (U+2581 as a space)."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for part in slices(batches, "text", _SLICE):
            texts = part.column(1)
            ids, count = encoder.encode(texts)
            spaced = pc.replace_substring(texts, "▁", " ")
            intact = pc.equal(encoder.decode(ids, count), spaced)
            if pc.any(pc.invert(intact)).as_py():
                ids, count, intact = encoder.repair(texts, spaced, ids, count, intact)
            offsets = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids), mask=pc.is_null(texts))
            n = pc.if_else(pc.is_null(texts), pa.scalar(None, pa.int64()), pa.array(count))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, n, intact], ["id", "ids", "n_tokens", "intact"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens bigint, intact boolean").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give null texts."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            lists = batch.column(1)
            count = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            texts = encoder.decode(np.asarray(lists.flatten()), count)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(pc.is_null(lists), pa.scalar(None, pa.string()), texts)], ["id", "text"])

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
