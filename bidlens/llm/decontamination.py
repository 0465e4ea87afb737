"""Benchmark passages in documents, found under edit distance.

CGK embedding: a random walk copies a string character by character and moves on by a
random bit that depends on the step and the character, so strings at small edit distance
become strings at small Hamming distance.  Hash tables over sampled steps then find
windows whose embeddings agree there.  The windows of an item start at each of its words and
the walk over them is as long as the item's class allows: one walk over a whole item loses step at
its first edits, several shorter ones along it need only one that agrees.  Enough tables are kept for a recall of
0.9 and more at MOST_EDITS in every class.  Candidates are verified by exact semi-global edit distance
against the whole item, after an exact bound on its shared trigrams.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_ids, documents, materialize, slices, text_rows

#: Edits allowed, as a share of the item's length.
MOST_EDITS = 0.15
#: Classes of items: least plain bytes, steps of the walk, steps sampled by a table, tables.
CLASSES = ((120, 48, 14, 8), (80, 36, 15, 10), (48, 24, 12, 10), (24, 16, 9, 12))
SEED = 20_240_607
#: Items searched in one pass; more are searched in several passes over the documents, one after the other.
ITEMS_PER_PASS = 20_000
_STEPS = max(c[1] for c in CLASSES)
_BLOCK = 32_768
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_KEEP = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
#: Between documents of a batch; plain text has no such byte.
_GAP = b"\0"


def plain(text: str | None) -> bytes:
    """Lower-cased words of letters, digits and non-ASCII characters, joined by one space."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP).split())


def edit_distance_within(item: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """Least edit distance of item to any part of text, and that part's end, if at most ``most``.

    Bit-parallel dynamic programming, one column per byte of text.
    """
    m = len(item)
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = most + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1
        pv = full & ((mh << 1) | ~(xv | ph))
        mv = ph & xv & full
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= most else None


def window_starts(text: np.ndarray) -> np.ndarray:
    """Starts of words, and every code point of scripts that set no blanks between words (from U+0800 on)."""
    mask = text >= 0xE0
    mask[1:] |= (text[:-1] == 32) | (text[:-1] == 0)
    mask[:1] = True
    return np.flatnonzero(mask)


class Walk:
    """The random functions of the embedding and the sampled steps, the same everywhere."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bits = rng.integers(0, 2, (_STEPS, 256), dtype=np.uint8)
        self.steps = [[rng.choice(steps, samples, replace=False).tolist() for _ in range(tables)] for _, steps, samples, tables in CLASSES]

    def keys(self, text: np.ndarray, starts: np.ndarray, classes: list[int]) -> dict[int, list[np.ndarray]]:
        """Per class and table, the hash of the sampled characters for every start.  text needs _STEPS spare bytes."""
        at = starts.astype(np.int64)
        out = {c: [np.zeros(len(at), np.uint64) for _ in self.steps[c]] for c in classes}
        uses: dict[int, list[np.ndarray]] = defaultdict(list)
        for c in classes:
            for h, steps in zip(out[c], self.steps[c], strict=True):
                for s in steps:
                    uses[s].append(h)
        for step in range(max(CLASSES[c][1] for c in classes)):
            char = text.take(at)
            for h in uses.get(step, ()):
                h *= _PRIME
                h += char
            at += self.bits[step].take(char)
        return out


def _trigrams(text: bytes) -> list[bytes]:
    return [text[i : i + 3] for i in range(len(text) - 2)]


class ItemIndex:
    """Hash tables over the items' windows, a bit map in front of each, and an automaton for the shortest items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.walk, self.items = Walk(), items
        self.grams: dict[int, list[bytes]] = {}
        by_class: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short = ahocorasick.Automaton()
        same: dict[str, list[int]] = defaultdict(list)
        for k, (_, p) in enumerate(items):
            c = next((c for c, (least, *_) in enumerate(CLASSES) if len(p) >= least), None)
            if c is None:
                same[p.decode("latin-1")].append(k)
            else:
                by_class[c] += [(k, o) for o in window_starts(np.frombuffer(p, np.uint8)).tolist() if o == 0 or o + CLASSES[c][1] // 2 <= len(p)]
        for word, ks in same.items():
            self.short.add_word(word, (len(word), ks))
        if same:
            self.short.make_automaton()
        self.classes = sorted(by_class)
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
        spare = b" " + bytes(_STEPS)
        for c, places in by_class.items():
            base, parts, at = {}, [], 0
            for k in dict.fromkeys(k for k, _ in places):
                base[k] = at
                parts.append(items[k][1] + spare)
                at += len(parts[-1])
            text = np.frombuffer(b"".join(parts), np.uint8)
            item, offset = (np.array(x, np.int32) for x in zip(*places, strict=True))
            starts = np.array([base[k] + o for k, o in places])
            tables = []
            for h in self.walk.keys(text, starts, [c])[c]:
                order = np.argsort(h, kind="stable")
                bitmap = np.zeros(1 << 20, bool)
                bitmap[h >> np.uint64(44)] = True
                tables.append((bitmap, h[order], item[order], offset[order]))
            self.tables[c] = tables

    def candidates(self, text: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(item number, place in text where the item would begin)."""
        found: set[tuple[int, int]] = set()
        if not self.classes:
            return found
        for c, hashes in self.walk.keys(text, starts, self.classes).items():
            for h, (bitmap, keys, item, offset) in zip(hashes, self.tables[c], strict=True):
                hit = np.flatnonzero(bitmap[h >> np.uint64(44)])
                lo, hi = np.searchsorted(keys, h[hit], "left"), np.searchsorted(keys, h[hit], "right")
                for i in np.flatnonzero(hi > lo):
                    p, places = int(starts[hit[i]]), slice(lo[i], hi[i])
                    found.update(zip(item[places].tolist(), (p - offset[places]).tolist(), strict=True))
        return found

    def exact(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(item number, end) of the items below the least class, where they stand as whole words."""
        if not len(self.short):
            return
        for last, (n, ks) in self.short.iter(text.decode("latin-1")):
            lo, hi = last + 1 - n, last + 1
            before, after = text[lo - 1] if lo else 32, text[hi] if hi < len(text) else 32
            if (text[lo] < 128 and 32 < before < 128) or (text[last] < 128 and 32 < after < 128):
                continue
            yield from ((k, hi) for k in ks)

    def verify(self, text: bytes, k: int, places: list[int]) -> tuple[int, int] | None:
        """Least edit distance of item k within the limit around the places, and the end of the passage."""
        item = self.items[k][1]
        most = int(MOST_EDITS * len(item))
        spans: list[list[int]] = []
        for place in sorted(places):
            lo, hi = max(0, place - most), min(len(text), place + len(item) + most)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(hi, spans[-1][1])
            else:
                spans.append([lo, hi])
        grams = self.grams.get(k)
        if grams is None:
            grams = self.grams[k] = _trigrams(item)
        best = None
        for lo, hi in spans:
            region = text[lo:hi]
            at = region.find(item)
            if at >= 0:
                hit = (0, at + len(item))
            else:
                # an edit changes at most three trigrams of the item
                there = set(_trigrams(region))
                hit = edit_distance_within(item, region, most) if sum(g in there for g in grams) >= len(grams) - 3 * most else None
            if hit and (best is None or (hit[0], lo + hit[1]) < best):
                best = (hit[0], lo + hit[1])
        return best


#: The index that this worker last built, by the name of its pass.
_built: dict[str, ItemIndex] = {}


def _search_pass(name: str, items: list[tuple[int, bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = ItemIndex(items)
        index = _built[name]
        for batch in slices(batches, 256):
            ids = batch.column(0).to_pylist()
            texts = [plain(t) for t in batch.column(1).to_pylist()]
            if not texts:
                continue
            ends = np.cumsum([len(t) + 1 for t in texts])
            begins = [0, *ends[:-1].tolist()]
            whole = _GAP.join([*texts, bytes(_STEPS)])
            text = np.frombuffer(whole, np.uint8)
            starts = window_starts(text[: ends[-1]])
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for b in range(0, len(starts), _BLOCK):  # what one block finds is verified before the next is searched
                places: dict[tuple[int, int], list[int]] = defaultdict(list)
                for k, p in index.candidates(text, starts[b : b + _BLOCK]):
                    # the document that holds the middle of the place
                    d = min(int(np.searchsorted(ends, max(0, p + len(items[k][1]) // 2), "right")), len(texts) - 1)
                    places[d, k].append(p - begins[d])
                for (d, k), where in places.items():
                    hit = index.verify(texts[d], k, where)
                    if hit and ((d, k) not in best or hit < best[d, k]):
                        best[d, k] = hit
            for k, end in index.exact(whole[: ends[-1]]):
                d = int(np.searchsorted(ends, end - 1, "right"))
                best.setdefault((d, k), (0, end - begins[d]))
            rows: dict[tuple[int, int], tuple[int, int]] = {}
            for (d, k), hit in best.items():  # items that repeat an id: the nearest of them
                key = (d, items[k][0])
                rows[key] = min(hit, rows.get(key, hit))
            out = [(ids[d], i, e, x) for (d, i), (e, x) in rows.items()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([],) * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "edits", "end"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, end) for every benchmark item that a document holds within MOST_EDITS.

    Both sides are compared as :func:`plain` text; end is the passage's end there.  Items under 24 plain bytes are
    found where they stand unedited, as whole words; others with the recall that CLASSES gives.  Of the places of an item in a document that with the fewest
    edits counts, on ties the first.  Null ids, and items without letters or digits, are not searched; null and empty texts hold nothing;
    very long texts are read whole.  Rows that repeat an id give rows of their own; items that repeat an id are one item with several wordings.
    An empty table on either side gives no rows.  Other columns, whatever their names, are not read.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    passes = max(1, -(-items.count() // ITEMS_PER_PASS))
    texts = text_rows(docs, id_col, text_col).where("doc_id is not null")
    schema = "doc_id long, item_id long, edits int, end long"
    found = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k) if passes > 1 else items
        wanted = [(r["item"], p) for r in part.collect() if (p := plain(r["text"]))]
        new = texts.mapInArrow(_search_pass(uuid.uuid4().hex, wanted), schema)
        if passes > 1:
            new = materialize(new, "leaks")
        found = new if found is None else found.unionByName(new)
    return found


def drop_leaky(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows whose id :func:`find_leaks` returns; rows with a null id stay.

    Rows that repeat an id go together where one of their texts holds an item.  Null and empty texts stay, and so does every row
    where either table is empty.  Columns of any name pass unchanged.
    """
    leaky = materialize(find_leaks(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias(id_col)).distinct(), "leaky")
    return by_ids(docs, leaky, id_col, "left_anti")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every benchmark passage in documents, as (doc_id, item_id, edits, end)."""
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
