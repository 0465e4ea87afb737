"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Sequence lengths are at most the capacity, so an instance is a histogram of at most
``capacity`` counts, whatever the number of documents.  Only that histogram comes to the
driver, which plans bins as patterns with multiplicities:

* reduction: for the longest open item, if a set of at most three items with it
  dominates every other set that could share its bin, that bin is fixed for good; all equal items go at once;
* the rest is packed by best fit, longest first, again for all equal items and bins at once.

The plan holds one row per (length, run of equal bins), so its size follows from the number of lengths, not of items.
Items of one length are numbered across tasks - a very frequent length in as many groups as its count asks for -
and each number falls into one of the runs.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, materialize, slices, text_rows
from .token_counts import VOCABULARY, chunk_cache

CAPACITY = 2048
#: Items of a length that are numbered in one group; a more frequent length is dealt to several groups.
GROUP = 100_000
#: Rows of the group table that may be broadcast; it has at most capacity + pieces / GROUP.
BROADCAST_GROUPS = 1_000_000


class _Open:
    """Open items by length: counts, with the present lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {w: c for w, c in counts.items() if c}
        self.sizes = sorted(self.n)

    def take(self, w: int, c: int) -> None:
        self.n[w] -= c
        if not self.n[w]:
            del self.n[w]
            self.sizes.pop(bisect_left(self.sizes, w))

    def largest(self, room: int, without: tuple[int, ...] = ()) -> int | None:
        """Largest open length within room once one item of each length in without is set aside."""
        i = bisect_right(self.sizes, room) - 1
        while i >= 0:
            w = self.sizes[i]
            if self.n[w] > without.count(w):
                return w
            i -= 1
        return None

    def smallest(self, k: int, without: tuple[int, ...]) -> list[int]:
        out: list[int] = []
        for w in self.sizes:
            out += [w] * min(self.n[w] - without.count(w), k - len(out))
            if len(out) == k:
                break
        return out


def _best_pair(items: _Open, room: int, first: int) -> tuple[int, int] | None:
    """Two open items besides first with the largest total within room, larger one first; on ties the more equal pair."""
    best = None
    for w in items.sizes:
        if items.n[w] <= (w == first) or w * 2 > room:
            continue
        v = items.largest(room - w, (first, w))
        if v is not None and v >= w and (best is None or v + w >= sum(best)):
            best = (v, w)
    return best


def _dominant(items: _Open, w: int, capacity: int) -> tuple[int, ...] | None:
    """A set with w that dominates all others which hold w, if one of at most three items provably does."""
    room = capacity - w
    mate = items.largest(room, (w,))
    if mate is None:
        return (w,)
    if mate == room:
        return (w, mate)
    small = items.smallest(3, (w,))
    if len(small) < 2 or small[0] + small[1] > room:
        return (w, mate)  # no two others fit beside w
    if len(small) < 3 or sum(small) > room:  # at most two others fit
        pair = _best_pair(items, room, w)
        if pair is None or mate >= sum(pair):
            return (w, mate)
        if mate == pair[0] and not any(pair[1] < v < mate and v * 2 <= room for v in items.sizes):
            return (w, *pair)  # every other feasible pair is dominated item by item
    return None


def reduce_instance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Bins fixed by dominance, as (number of bins, lengths), and the counts left."""
    items, fixed = _Open(counts), []
    changed = True
    while changed:
        changed = False
        for w in sorted(items.n, reverse=True):
            while w in items.n:
                chosen = _dominant(items, w, capacity)
                if chosen is None:
                    break
                # Taking these items away only makes the smallest others larger and alternatives fewer, so the set
                # dominates until one of its lengths runs out.
                times = min(items.n[v] // chosen.count(v) for v in set(chosen))
                for v in chosen:
                    items.take(v, times)
                fixed.append((times, chosen))
                changed = True
    return fixed, dict(items.n)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, longest first, for all equal items and equal bins at once: (number of bins, lengths)."""
    rooms: list[int] = []  # free rooms in order
    bins: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(room: int, group: tuple[int, tuple[int, ...]]) -> None:
        if room not in bins:
            bins[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        bins[room].append(group)

    def pull(room: int) -> tuple[int, tuple[int, ...]]:
        group = bins[room].pop()
        if not bins[room]:
            del bins[room]
            rooms.pop(bisect_left(rooms, room))
        return group

    for w in sorted(counts, reverse=True):
        left = counts[w]
        while left:
            i = bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                times, lengths = pull(room)
            else:
                room, times, lengths = capacity, -(-left // (capacity // w)), ()
            each = min(room // w, left)  # best fit stays with a bin while it can
            filled = min(times, left // each)
            if times > filled:
                rest = left - filled * each
                part = 0 if room == capacity and not lengths else times - filled
                if room == capacity and not lengths and rest:
                    put(room - rest * w, (1, lengths + (w,) * rest))
                    left -= rest
                elif part:
                    put(room, (part, lengths))
            put(room - each * w, (filled, lengths + (w,) * each))
            left -= filled * each
    return [g for groups in bins.values() for g in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first item number, first bin, items a bin, and offset of the first item in a bin, of every run of equal bins."""
    fixed, rest = reduce_instance(counts, capacity)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    bin_id = 0
    for times, lengths in [*fixed, *best_fit(rest, capacity)]:
        ordered = sorted(lengths, reverse=True)
        starts = [0, *accumulate(ordered)]
        for w in dict.fromkeys(ordered):
            each = ordered.count(w)
            runs.setdefault(w, []).append((given.get(w, 0), bin_id, each, starts[ordered.index(w)]))
            given[w] = given.get(w, 0) + times * each
        bin_id += times
    return {w: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for w, r in runs.items()}


def _piece_pass(capacity: int, separator: int, name: str):
    mark = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = chunk_cache(name)
        for batch in slices(batches):
            doc, piece, start, length, crc = [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = b"".join(cache.of(text)) + mark
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    doc.append(d), piece.append(k // (4 * capacity)), start.append(k // 4)
                    length.append(len(part) // 4), crc.append(zlib.crc32(part))
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _place_pass(runs: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length, number = (batch.column(names.index(c)).to_numpy() for c in ("length", "number"))
            where, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for w in np.unique(length):
                at = np.flatnonzero(length == w)
                first, bins, each, start = runs[int(w)]
                r = np.searchsorted(first, number[at], "right") - 1
                inside = number[at] - first[r]
                where[at] = bins[r] + inside // each[r]
                offset[at] = start[r] + inside % each[r] * w
            keep = [c for c in names if c != "number"]
            columns = [batch.column(names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(where), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, *, capacity: int = CAPACITY, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Pack token sequences into bins of ``capacity`` tokens.

    A row's sequence is its tokens and then the separator; only longer ones are cut, into
    pieces of the capacity.  Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id
    and offset.  Null and empty texts are a lone separator.  Rows with repeated or null ids
    are packed like any other; rows that agree in id and text take their places in any order.  A very long text's ids are held by one task
    while it is cut.  An empty table gives no row.  Other columns, whatever their names, are not read.
    """
    texts = text_rows(docs, id_col, text_col)
    pieces = materialize(texts.mapInArrow(_piece_pass(capacity, separator, vocabulary), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = plan(histogram, capacity)
    parts = docs.sparkSession.createDataFrame([(w, n // GROUP + 1) for w, n in histogram.items()], "length long, parts long")
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "parts"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    groups = sum(n // GROUP + 1 for n in histogram.values())
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    side = F.broadcast(base) if groups <= BROADCAST_GROUPS else base
    numbered = dealt.withColumn("k", inside).join(side, ["length", "salt"]).withColumn("number", F.col("base") + F.col("k") - 1)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return numbered.select(*columns, "number").mapInArrow(
        _place_pass(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents packed into sequences of 2048 tokens."""
    return pack(documents(spark, sf_dir))
