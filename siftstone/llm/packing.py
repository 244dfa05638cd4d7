"""Best-fit packing of documents into bins of a fixed number of tokens, improved by swaps.

Longer documents than a bin are cut into full bins and a rest. Documents are spread over groups by row hash; a group packs
on its own: best fit in order of decreasing length gives a first packing; then a local search takes the least filled bin
and lets it give tokens to fuller ones, by moving a document, by exchanging one for one, or two for one in either
direction. Every step raises the sum of squared fills; a bin that empties goes. Passes over the bins go on until one
changes nothing. Bins that stay less than `FILLED` full are no group's own: those of `JOIN` groups are packed together by the
same search, and so on level by level until one group is left, so that the table ends with the underfilled bins of one search.

Tokens are runs of characters other than white space; in scripts written without spaces each character is one. Defined
cases: null, empty and blank texts have no tokens and get one row with a null bin; each of repeated rows is packed; null
doc_ids are packed like others; very long texts are cut, not shortened: a document that fills several bins has one row
per piece; an empty table gives an empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm import textkernel as K
from siftstone.llm.common import materialize, row_key

#: Tokens of a bin; documents of a group; groups whose underfilled bins are packed together on the next level; the fill from which a bin isn't.
CAPACITY, GROUP, JOIN, FILLED = 2048, 1 << 13, 64, 15 / 16
#: A token: a character of a script without spaces, or a run of others (Java).
TOKEN = rf"[{K.SOLO_CLASS}]|[^\s{K.SOLO_CLASS}]+"


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of item numbers) by best fit over items of decreasing length; items are 1..capacity long."""
    bins: list[list[int]] = []
    rooms: list[int] = []
    by_room: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            k = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(int(i))
        left = room - n
        if left:
            here = by_room.setdefault(left, [])
            if not here:
                insort(rooms, left)
            here.append(k)
    return bins


def _pairs(items: list[int]) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.triu_indices(len(items), 1)
    at = np.array(items)
    return at[a], at[b]


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search over the bins with room; ends when no bin can give anything more to a fuller one."""
    fills = [int(lengths[b].sum()) for b in bins]
    full = [b for b, n in zip(bins, fills, strict=True) if n == capacity]
    order = sorted((n, list(b)) for b, n in zip(bins, fills, strict=True) if n < capacity)
    now = [b for _, b in order]
    fill = np.array([n for n, _ in order], np.int64)
    tried = np.zeros(len(now), bool)
    changed = False
    while len(now) > 1:
        if tried.all():
            if not changed:
                break
            tried[:], changed = False, False
        at = int(np.where(tried, capacity + 1, fill).argmin())
        pick = _best(now, fill, at, lengths, capacity)
        if pick is None:
            tried[at] = True
            continue
        gain, k, out, back = pick
        now[at] = [i for i in now[at] if i not in out] + list(back)
        now[k] = [i for i in now[k] if i not in back] + list(out)
        fill[at] -= gain
        fill[k] += gain
        changed = True
        gone = [x for x in (at, k) if fill[x] == 0 or fill[x] == capacity]
        full += [now[x] for x in gone if fill[x]]
        if gone:
            keep = np.setdiff1d(np.arange(len(now)), gone)
            now, fill, tried = [now[x] for x in keep], fill[keep], tried[keep]
    return full + now


def _best(now, fill, at, lengths, capacity):
    """(gain, target, documents given, documents taken back) of the donor's best step, None without any: a move if there is one, else an exchange."""
    others = np.flatnonzero(np.arange(len(now)) != at)
    targets = [now[k] for k in others]
    room = capacity - fill[others]
    least = room - (capacity - fill[at])
    donor = now[at]
    best = _move(donor, lengths[donor], room, least)
    if best[1] is None:
        best = max((kind(donor, targets, room, least, lengths) for kind in (_one_for_one, _two_for_one)), key=lambda x: x[0])
    if best[1] is None:
        return None
    k, out, back = best[1]
    return best[0], int(others[k]), out, back


def _move(donor, sizes, room, least):
    """least: tokens that a target must gain more than, so that the squares' sum rises (negative where it is fuller)."""
    gain = np.where((sizes[:, None] <= room[None, :]) & (sizes[:, None] > least[None, :]), sizes[:, None], 0)
    if not gain.size or not gain.max():
        return 0, None
    gain = np.where(gain == gain.max(), capacity_rank(room)[None, :], -1)
    x, k = np.unravel_index(gain.argmax(), gain.shape)
    return int(sizes[x]), (int(k), (donor[x],), ())


def capacity_rank(room: np.ndarray) -> np.ndarray:
    """Larger for less room, so that equal gains go to the fullest bin."""
    return room.max() - room


def _one_for_one(donor, targets, room, least, lengths):
    items = np.array([i for b in targets for i in b])
    owner = np.repeat(np.arange(len(targets)), [len(b) for b in targets])
    gain = lengths[donor][:, None] - lengths[items][None, :]
    gain = np.where((gain > np.maximum(least[owner], 0)[None, :]) & (gain <= room[owner][None, :]), gain, 0)
    if not gain.max():
        return 0, None
    x, y = np.unravel_index(gain.argmax(), gain.shape)
    return int(gain[x, y]), (int(owner[y]), (donor[x],), (int(items[y]),))


def _two_for_one(donor, targets, room, least, lengths):
    best = (0, None)
    if len(donor) > 1:
        a, b = _pairs(donor)
        items = np.array([i for t in targets for i in t])
        owner = np.repeat(np.arange(len(targets)), [len(t) for t in targets])
        gain = (lengths[a] + lengths[b])[:, None] - lengths[items][None, :]
        gain = np.where((gain > np.maximum(least[owner], 0)[None, :]) & (gain <= room[owner][None, :]), gain, 0)
        if gain.max():
            x, y = np.unravel_index(gain.argmax(), gain.shape)
            best = int(gain[x, y]), (int(owner[y]), (int(a[x]), int(b[x])), (int(items[y]),))
    sizes = np.array([len(t) for t in targets])
    flat = np.array([i for t in targets for i in t])
    begin = np.cumsum(sizes) - sizes
    for n in np.unique(sizes[sizes > 1]):
        of = np.flatnonzero(sizes == n)
        x, y = np.triu_indices(n, 1)
        a, b = flat[begin[of][:, None] + x], flat[begin[of][:, None] + y]
        gain = lengths[donor][:, None, None] - (lengths[a] + lengths[b])[None]
        gain = np.where((gain > np.maximum(least[of], 0)[None, :, None]) & (gain <= room[of][None, :, None]), gain, 0)
        if gain.max(initial=0) > best[0]:
            d, k, p = np.unravel_index(gain.argmax(), gain.shape)
            best = int(gain[d, k, p]), (int(of[k]), (donor[d],), (int(a[k, p]), int(b[k, p])))
    return best


def pack_items(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    return improve(best_fit(lengths, capacity), lengths, capacity)


def pack_group(pdf: pd.DataFrame, capacity: int, level: int) -> pd.DataFrame:
    """(grp, id, none, key, piece, start, tokens) of a group -> with bin, place and fill; pieces of at most a bin each."""
    pdf = pdf.sort_values(["none", "id", "key", "piece"], kind="stable").reset_index(drop=True)
    length = pdf["tokens"].to_numpy(np.int64)
    bin_, place, fill = (np.zeros(len(pdf), np.int64) for _ in range(3))
    base = (int(pdf["grp"].iloc[0]) << 28) | (level << 24)
    for number, members in enumerate(pack_items(length, capacity)):
        at = np.array(sorted(members))
        bin_[at] = (base << 4) + number
        place[at] = np.r_[0, np.cumsum(length[at])[:-1]]
        fill[at] = length[at].sum()
    return pdf.assign(bin=bin_, place=place, fill=fill)[["grp", "id", "none", "key", "piece", "start", "tokens", "bin", "place", "fill"]]


def _packer(capacity: int, level: int):
    return lambda pdf: pack_group(pdf, capacity, level)


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, tokens, bin, place): tokens start..start+tokens of a document stand in bin from place on.

    id_col must be of an integer type. Groups hold about `group` documents.
    """
    groups = max(1, -(-docs.count() // group))
    slim = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("id"), F.col(id_col).isNull().alias("none"), row_key(docs).alias("key"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(TOKEN)), F.lit(0)).cast("bigint").alias("all"))
    cut = slim.select(F.pmod("key", F.lit(groups)).alias("grp"), "id", "none", "key", "all", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("all") / capacity) - 1, F.lit(0)).cast("int"))).alias("piece"))
    cut = cut.withColumn("start", F.col("piece").cast("bigint") * capacity).withColumn("tokens", F.least(F.col("all") - F.col("start"), F.lit(capacity))).drop("all")
    schema = "grp bigint, id bigint, none boolean, key bigint, piece int, start bigint, tokens bigint, bin bigint, place bigint, fill bigint"
    items = materialize(cut)
    done = items.where("tokens = 0").select(*items.columns, *(F.lit(None).cast("bigint").alias(c) for c in ("bin", "place", "fill")))
    left, level = items.where("tokens > 0"), 0
    while True:
        packed = left.repartition(groups, "grp").groupBy("grp").applyInPandas(_packer(capacity, level), schema)
        if groups == 1:
            break
        packed = materialize(packed)
        done = done.unionByName(packed.where(F.col("fill") >= FILLED * capacity))
        groups, level = -(-groups // JOIN), level + 1
        left = packed.where(F.col("fill") < FILLED * capacity).select(*items.columns).withColumn("grp", F.expr(f"grp div {JOIN}"))
    return done.unionByName(packed).select(F.when(~F.col("none"), F.col("id")).alias(id_col), "piece", "start", "tokens", "bin", "place")
