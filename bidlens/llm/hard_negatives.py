"""Hard negatives by rotated one-bit codes with deterministic bounds of the inner product.

A vector v is rotated by a fixed orthonormal matrix and coded by the signs c of what comes out, scaled to length 1.  Beside the code
its alignment <v, c> is stored, and the length of v, so the residual v - <v, c> c has a known length and stands at right angles to c.
For an anchor q, kept as small integers in bit planes, <q, c> is a sum of popcounts of code and planes, up to a known rounding error.  Hence

    <q, v> = <v, c> <q, c> + <q, residual>,    |<q, residual>| <= sqrt(|q|^2 - <q, c>^2) |residual|

by Cauchy and Schwarz, an interval that always holds.  Pairs whose interval cannot matter are dropped; the others are scored with
integers.  Anchors, a stated set of queries, meet all rows in blocks of bounded size: a block is broadcast and every task goes once over the
codes of its rows, keeping the best few of each anchor.  No pair of rows is made beyond anchors, and no vector is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, release, slices

#: Anchors of a block, and anchors and rows of a tile of bounds (8 bytes a pair, a few times).
ANCHORS, TILE_ANCHORS, TILE_ROWS = 20_000, 256, 2_048
#: Bits of an anchor's rotated components.
PLANES = 6
#: Pairs that are scored at a time.
SCORED = 50_000
SEED = 20_240_521
CODED = "id long, label int, v array<long>, code array<long>, align double, norm double"


def rotation(d: int) -> np.ndarray:
    """The orthonormal matrix for d dimensions, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    bytes_ = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(bytes_, ((0, 0), (0, -bytes_.shape[1] % 8))).view(np.uint64)


def encode(v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, alignments and lengths of integer vectors."""
    rotated = v.astype(np.float64) @ turn
    return _packed(rotated > 0), np.abs(rotated).sum(axis=1) / np.sqrt(v.shape[1]), np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))


@dataclass
class Anchors:
    """A block's anchors of one dimension: integer vectors, and what bounds need of the rotated ones."""

    no: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray

    def __post_init__(self):
        turn = rotation(self.v.shape[1])
        rotated = self.v.astype(np.float64) @ turn
        top = (1 << (PLANES - 1)) - 1
        self.step = np.maximum(np.abs(rotated).max(axis=1), 1e-300) / top
        u = np.rint(rotated / self.step[:, None]).astype(np.int64)
        self.error = np.sqrt(((rotated - u * self.step[:, None]) ** 2).sum(axis=1))
        self.total = u.sum(axis=1)
        self.planes = np.stack([_packed(((u + top + 1) >> b) & 1) for b in range(PLANES)])
        self.shift = top + 1
        self.norm = np.sqrt((self.v.astype(np.float64) ** 2).sum(axis=1))


def bounds(a: Anchors, part: slice, code: np.ndarray, align: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of some anchors with coded rows; the true one always lies between."""
    said = np.zeros((part.stop - part.start, len(code)), np.int64)
    for b in range(PLANES):
        for w in range(code.shape[1]):
            said += np.bitwise_count(a.planes[b, part, w, None] & code[None, :, w]).astype(np.int64) << b
    said -= a.shift * np.bitwise_count(code).sum(axis=1, dtype=np.int64)[None, :]
    met = (2 * said - a.total[part, None]) * (a.step[part, None] / np.sqrt(a.v.shape[1]))
    error = a.error[part, None]
    least = np.maximum(np.abs(met) - error, 0)
    across = np.sqrt(np.maximum(a.norm[part, None] ** 2 - least**2, 0)) * np.sqrt(np.maximum(norm**2 - align**2, 0))[None, :]
    middle, half = met * align[None, :], error * align[None, :] + across
    half += 1e-9 * a.norm[part, None] * norm[None, :] + 1e-6  # what floating point may have lost
    return middle - half, middle + half


class Best:
    """The first few (score, id) of each of many groups, higher scores first, then smaller ids."""

    def __init__(self, groups: int, most: int):
        self.most = most
        self.group = self.id = self.score = np.empty(0, np.int64)
        #: The score that a group's last kept pair has, once it has as many as it may.
        self.enough = np.full(groups, np.iinfo(np.int64).min)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        place = np.arange(len(group)) - np.repeat(starts, np.diff(starts, append=len(group)))
        kept = place < self.most
        self.group, self.score, self.id = group[kept], score[kept], ids[kept]
        last = place[kept] == self.most - 1
        self.enough[self.group[last]] = self.score[last]


def _coded_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turns: dict[int, np.ndarray] = {}
    for batch in slices(batches, TILE_ROWS):
        ids, labels = batch.column(0), batch.column(1)
        for d, rows, v in _matrices(batch.column(2)):
            if d not in turns:
                turns[d] = rotation(d)
            code, align, norm = encode(v, turns[d])
            columns = [ids.take(rows), labels.take(rows), batch.column(2).take(rows), pa.array(list(code.view(np.int64)), pa.list_(pa.int64())), pa.array(align), pa.array(norm)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "v", "code", "align", "norm"])


def _matrices(lists: pa.ListArray) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Rows of a list column by their length: the length, the rows, and their values as a matrix."""
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, pa.array(rows), values[offsets[rows][:, None] + np.arange(d)[None, :]]


def _scores(a: Anchors, at: np.ndarray, v: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs, a bounded number at a time."""
    parts = [np.einsum("ij,ij->i", a.v[at[i : i + SCORED]], v[rows[i : i + SCORED]]) for i in range(0, len(at), SCORED)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _over_rows(batches: Iterator[pa.RecordBatch], block: dict[int, Anchors], visit: Callable) -> None:
    """visit(anchors, first of the tile, least, greatest, same label, same id, scores of chosen pairs, ids) for each tile of anchors and rows."""
    for batch in slices(batches, TILE_ROWS):
        t = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
        for d, rows, v in _matrices(t["v"]):
            if d not in block:
                continue
            a = block[d]
            (_, _, code), *_ = _matrices(t["code"].take(rows))
            ids, labels, align, norm = (t[k].take(rows).to_numpy() for k in ("id", "label", "align", "norm"))
            for i in range(0, len(a.no), TILE_ANCHORS):
                part = slice(i, min(i + TILE_ANCHORS, len(a.no)))
                low, high = bounds(a, part, np.ascontiguousarray(code).view(np.uint64), align, norm)
                same = a.labels[part, None] == labels[None, :]
                own = a.ids[part, None] == ids[None, :]
                visit(d, a, i, low, high, same, own, v, ids)


FOUND = "no long, place int, id long, score long"


def _emitted(best: dict[int, Best], numbers: Callable) -> Iterator[pa.RecordBatch]:
    for d, b in best.items():
        no, place = numbers(d, b.group)
        yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(place, pa.int32()), pa.array(b.id, pa.int64()), pa.array(b.score, pa.int64())], ["no", "place", "id", "score"])


def _positive_pass(sent: Broadcast, most: int):
    """The first rows with an anchor's label; place is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        best = {d: Best(len(a.no), most) for d, a in block.items()}

        def visit(d, a, first, low, high, same, own, v, ids):
            at, rows = np.nonzero(same & ~own & (high >= best[d].enough[first : first + len(same), None]))
            at += first
            best[d].add(at, _scores(a, at, v, rows), ids[rows])

        _over_rows(batches, block, visit)
        yield from _emitted(best, lambda d, group: (block[d].no[group], np.zeros(len(group), np.int32)))

    return run


def _negative_pass(sent: Broadcast, most: int, low_share: int):
    """For each positive of an anchor the first rows of another label in the window below its score; place is the positive's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, positives = sent.value
        windows = {d: positives[a.no] for d, a in block.items()}  # (anchors, places) of scores; below zero no window
        best = {d: Best(w.size, most) for d, w in windows.items()}
        floors = {d: np.where(w >= 0, -(-low_share * w // 100), np.iinfo(np.int64).max) for d, w in windows.items()}

        def visit(d, a, first, low, high, same, own, v, ids):
            part = slice(first, first + len(same))
            w, floor = windows[d][part], floors[d][part]
            # where no window is open the floor is out of reach
            wanted = np.maximum(floor, best[d].enough.reshape(windows[d].shape)[part]).min(axis=1)
            at, rows = np.nonzero(~same & ~own & (high >= wanted[:, None]) & (low <= w.max(axis=1)[:, None]))
            score = _scores(a, at + first, v, rows)
            for place in range(w.shape[1]):
                met = np.flatnonzero((score >= floor[at, place]) & (score <= w[at, place]))
                best[d].add((at[met] + first) * w.shape[1] + place, score[met], ids[rows[met]])

        _over_rows(batches, block, visit)
        yield from _emitted(best, lambda d, group: (block[d].no[group // windows[d].shape[1]], (group % windows[d].shape[1]).astype(np.int32)))

    return run


def _block(rows: pa.Table) -> dict[int, Anchors]:
    columns = {k: rows[k].combine_chunks() for k in ("id", "label", "v")}
    out = {}
    for d, at, v in _matrices(columns["v"]):
        out[d] = Anchors(at.to_numpy(), columns["id"].take(at).to_numpy(), columns["label"].take(at).to_numpy(), v)
    return out


def _first(found: DataFrame, most: int) -> DataFrame:
    """The first of each anchor and place over all tasks."""
    order = Window.partitionBy("no", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 5, low_share: int = 80
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives of anchors.

    Components are floor(scale * x), a score is the integer inner product and has to fit 64 bits.  An anchor's positives are the first rows of its label by score and then
    smaller id; for each, the negatives are the first rows of another label whose score is between low_share percent of the positive's and the
    positive's.  Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; vectors are compared with those of
    their length.  Rows with the anchor's own id are not compared with it.  Anchors that repeat an id are anchors each, equal rows among them one.  Ties go to smaller
    ids.  An empty table gives an empty result.  Other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"), vector.alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    whole = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & whole)
    rows = rows.select("id", "label", F.transform("x", lambda x: F.floor(scale * x)).alias("v"), "anchor")
    coded = materialize(rows.select("id", "label", "v").mapInArrow(_coded_pass, CODED), "codes")
    asked = materialize(rows.where("anchor").select("id", "label", "v").dropDuplicates(), "anchors")
    blocks = -(-asked.count() // ANCHORS)
    out = None
    for i in range(max(1, blocks)):
        # a block is dealt by hash, so it has about ANCHORS rows and the driver never holds more of the anchors
        table = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(max(1, blocks))) == i).toArrow()
        block = _block(table)
        sent = spark.sparkContext.broadcast(block)
        best = materialize(_first(coded.mapInArrow(_positive_pass(sent, positives), FOUND), positives), "positives")
        found = best.select("no", "rank", "score").toArrow()
        scores = np.full((table.num_rows, positives), -1, np.int64)
        scores[found["no"].to_numpy(), found["rank"].to_numpy() - 1] = found["score"].to_numpy()
        both = spark.sparkContext.broadcast((block, scores))
        mined = _first(coded.mapInArrow(_negative_pass(both, negatives, low_share), FOUND), negatives)
        names = spark.createDataFrame(pa.table({"no": pa.array(range(table.num_rows), pa.int64()), "anchor_id": table["id"]}))
        pairs = best.select("no", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, "no")
        rows_of = mined.select("no", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["no", "place"])
        rows_of = materialize(rows_of.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "mined")
        out = rows_of if out is None else out.unionByName(rows_of)
        release(best)
        sent.unpersist(), both.unpersist()
    release(coded, asked)
    return out


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Query: hard negatives of every hundredth vector, labels of every seventh moved on by one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(generate_series(1, len(a.v)), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
