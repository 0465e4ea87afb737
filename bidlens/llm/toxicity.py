"""Toxic passages as maximum-scoring segments.

Tokens get log-odds between the toxic and the clean training rows with an informative
Dirichlet prior (the words' joint counts).  A word is looked up whole, then by its first
six and four letters, so that inflected forms share evidence; every other word has one
common, negative score.  A linear-time scan finds all maximal scoring segments of a
text.  The best scores of clean texts follow an extreme-value law; its two parameters are
fitted by maximum likelihood on clean labelled rows, and turn a segment's score into an expected count of
chance segments.  A document's statistic adds up the significant segments' excess and a
one-variable logistic fit over its histogram makes that a probability.  Both fits see every labelled row through the log-odds
of the folds that it is not in.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, BROADCAST_IDS, documents, materialize, release, slices, text_rows

WORD = re.compile(r"\w+")
#: Labelled rows outside the held-out third that the model is fitted on: about so many, by a hash of the id, or all if there are fewer.
#: They bound the model's features, all of which are kept.
TRAIN_ROWS = 500_000
#: Folds of these rows.
FOLDS = 4
#: Least z-score and toxic texts of a feature, and the weight of the prior as a share of all counts.
LEAST_Z, LEAST_COUNT, PRIOR_SHARE = 2.5, 4, 0.1
#: A segment counts if fewer than so many as good are expected by chance in the text.
SIGNIFICANT = 0.05
THRESHOLD = 0.7
_CACHE = 200_000


@dataclass
class ToxicityModel:
    weights: dict = field(default_factory=dict)
    base: float = -0.01
    lam: float = 1.0
    k: float = 1.0
    intercept: float = -20.0
    slope: float = 0.0

    def of(self, word: str) -> float:
        """A word's score; that of its longest known form."""
        w = self.weights
        for form in (f"={word}", f"6{word[:6]}", f"4{word[:4]}"):
            if form in w:
                return w[form]
        return 0.0


def segments(hits: list[tuple[int, float]], base: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time.

    hits: (position, score > 0) in order; every other position scores base < 0.
    Each candidate keeps the running sum before and after it; a new one is merged
    with the nearest earlier candidate that starts lower, if that one ends lower too.
    """
    found: list[tuple[int, int, float, float]] = []
    below: list[int] = []  # index + 1 of the nearest earlier candidate with a smaller left sum
    total, at = 0.0, 0
    for pos, score in hits:
        total += base * (pos - at)
        start, left = pos, total
        total += score
        at, end = pos + 1, pos + 1
        j = len(found)
        while j:
            if found[j - 1][2] < left:
                if found[j - 1][3] >= total:
                    break
                start, left = found[j - 1][0], found[j - 1][2]
                del found[j - 1 :], below[j - 1 :]
                j = len(found)
                continue
            j = below[j - 1]
        found.append((start, end, left, total))
        below.append(j)
    return [(a, b, r - lft) for a, b, lft, r in found]


class _Scanner:
    def __init__(self, model: ToxicityModel):
        self.model, self.known = model, {}

    def __call__(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = WORD.findall((text or "").lower())
        known, of = self.known, self.model.of
        if len(known) > _CACHE:
            known.clear()
        hits = []
        for i, w in enumerate(words):
            s = known.get(w)
            if s is None:
                s = known[w] = of(w)
            if s:
                hits.append((i, s))
        return len(words), segments(hits, self.model.base)

    def excess(self, n: int, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """Significant segments with their score above the extreme-value location, in natural units."""
        m = self.model
        least = math.log(max(m.k * n, 1e-9))
        kept = [(a, b, m.lam * s - least) for a, b, s in found]
        return [x for x in kept if x[2] >= -math.log(SIGNIFICANT)]


def _count_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either class and each fold in which a feature occurs: a word said twice in one text is no second witness."""
    for batch in slices(batches, BATCH_ROWS):
        by: dict[tuple[int, int], Counter] = {}
        for text, toxic, fold in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = set(WORD.findall(text.lower()))
            to = by.setdefault((fold, int(bool(toxic))), Counter())
            to.update({f"={w}" for w in words} | {f"6{w[:6]}" for w in words if len(w) >= 6} | {f"4{w[:4]}" for w in words if len(w) >= 4})
            to[""] += len(words)
        for (fold, toxic), out in by.items():
            counts, none = pa.array(list(out.values()), pa.int64()), pa.array(np.zeros(len(out), np.int64))
            folds = pa.array(np.full(len(out), fold), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), folds, counts if toxic else none, none if toxic else counts], ["feature", "fold", "t", "c"])


def _best_pass(models: list[ToxicityModel]):
    """Per text with words: its best segment's score under the model without its fold, 0 without one, to a tenth; and its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans = [_Scanner(m) for m in models]
        for batch in slices(batches):
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            found = [(words, max((s for _, _, s in parts), default=0.0)) for words, parts in (scans[fold](text) for text, fold in rows) if words]
            yield pa.RecordBatch.from_arrays([pa.array([round(min(s, 60.0), 1) for _, s in found], pa.float64()), pa.array([n for n, _ in found], pa.int64())], ["best", "words"])

    return run


def extreme_value_fit(best: np.ndarray, texts: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """Scale and location factor (lam, k) of P(best < s) = exp(-k * words * exp(-lam * s)), by maximum likelihood.

    best: scores in order, with the texts and words at each; texts without a segment (score 0) are known to
    lie below the least positive score.
    """
    some = best > 0
    if texts[some].sum() < 10 or some.sum() < 2:
        return 1.0, max(1.0, float(texts.sum())) / max(1.0, float(words.sum()))
    at = np.where(some, best, best[some].min())
    n, mean = texts[some].sum(), (texts * best)[some].sum()

    def slope(lam: float) -> float:
        tail = words * np.exp(-lam * at)
        return n / lam - mean + n * (tail * at).sum() / tail.sum()

    low, high = 0.05, 5.0
    for _ in range(60):
        lam = (low + high) / 2
        low, high = (lam, high) if slope(lam) > 0 else (low, lam)
    return lam, float(n / (words * np.exp(-lam * at)).sum())


def _statistic_pass(models: list[ToxicityModel]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans = [_Scanner(m) for m in models]
        for batch in slices(batches):
            rows = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
            x = [sum(s for _, _, s in scans[fold].excess(*scans[fold](text))) for text, fold in rows]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], ["x", "toxic"])

    return run


def _logistic(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps on counts, with smoothed targets as in Platt's method."""
    n1, n0 = pos.sum(), neg.sum()
    hi, lo = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)
    a, b = math.log((n1 + 1) / (n0 + 1)), 0.0
    w = pos + neg
    target = (pos * hi + neg * lo) / np.maximum(w, 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))
        g = np.array([(w * (p - target)).sum(), (w * (p - target) * x).sum() + 1e-3 * b])
        v = w * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[v.sum() + 1e-6, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        size = min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(max(b, 0.0))


def _weighted(counts: DataFrame) -> ToxicityModel:
    """The model that the counts (feature, t, c) give, without its fits."""
    model = ToxicityModel()
    whole = counts.where("feature = ''").first()
    if whole is None or not whole["t"] or not whole["c"]:
        return model
    nt, nc = float(whole["t"]), float(whole["c"])
    prior, most = (F.col("t") + F.col("c")) * PRIOR_SHARE, (nt + nc) * PRIOR_SHARE
    at, ac = F.col("t") + prior, F.col("c") + prior
    odds = F.log(at / (nt + most - at)) - F.log(ac / (nc + most - ac))
    scored = counts.where(f"feature <> '' and t >= {LEAST_COUNT}").select("feature", odds.alias("odds"), (odds / F.sqrt(1 / at + 1 / ac)).alias("z"), (F.col("t") / nt).alias("pt"))
    best = scored.where(f"z >= {LEAST_Z} and odds >= 1.5").collect()  # bounded by the rows of the fit
    model.weights = {r["feature"]: min(r["odds"], 12.0) for r in best}
    # What the listed features leave to all other words: a little less likely in toxic text.
    share = min(0.5, sum(r["pt"] for r in best if r["feature"][0] == "4") + sum(r["pt"] for r in best if r["feature"][0] == "=" and len(r["feature"]) < 5))
    model.base = min(-0.02, math.log(1 - share))
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on the rows of docs that labels marks and whose crc32(id as text) mod 3 is not 1.

    Null labels, null ids and null texts count for nothing; of repeated labels the largest counts, and rows that repeat an id all have its label.  Without rows of both
    classes, an empty table among them, the model is empty and scores every text alike, near 0.  The features and the histograms come to the driver; TRAIN_ROWS
    bounds the rows behind them.  Other columns, whatever their names, are not read.
    """
    key = F.col(f"`{id_col}`").cast("long")
    marked = (
        labels.where(F.col(label_col).isNotNull() & key.isNotNull() & (F.crc32(key.cast("string").cast("binary")) % 3 != 1))
        .groupBy(key.alias("doc_id"))
        .agg(F.max(label_col).cast("int").alias("toxic"))
    )
    marked = materialize(marked, "marked")
    every = marked.count()
    if every > TRAIN_ROWS:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_007)) < int(1_000_000_007 * (TRAIN_ROWS / every)))
    side = F.broadcast(marked) if every <= BROADCAST_IDS else marked
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(FOLDS)).cast("int")
    train = materialize(text_rows(docs, id_col, text_col).join(side, "doc_id").where("text is not null").select("text", "toxic", fold.alias("fold")), "train")
    counts = train.mapInArrow(_count_pass, "feature string, fold int, t long, c long").groupBy("feature").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c"), *[F.sum(F.when(F.col("fold") == k, F.col(x)).otherwise(0)).alias(f"{x}{k}") for k in range(FOLDS) for x in "tc"]
    )
    counts = materialize(counts.where(f"feature = '' or t >= {LEAST_COUNT}"), "features")
    model = _weighted(counts)
    if not model.weights:
        return model
    others = [_weighted(counts.select("feature", (F.col("t") - F.col(f"t{k}")).alias("t"), (F.col("c") - F.col(f"c{k}")).alias("c"))) for k in range(FOLDS)]
    clean = train.where("toxic = 0").select("text", "fold").mapInArrow(_best_pass(others), "best double, words long")
    seen = sorted(map(tuple, clean.groupBy("best").agg(F.count("*"), F.sum("words")).collect()))
    if seen:
        model.lam, model.k = extreme_value_fit(*(np.array(c, float) for c in zip(*seen, strict=True)))
    for other in others:
        other.lam, other.k = model.lam, model.k
    bins = train.mapInArrow(_statistic_pass(others), "x double, toxic int").groupBy(F.least(F.round("x", 1), F.lit(60.0)).alias("x"), "toxic").count().collect()
    release(train, counts)
    if not bins:
        return model
    xs = sorted({r["x"] for r in bins})
    at_x = {x: i for i, x in enumerate(xs)}
    pos, neg = np.zeros(len(xs)), np.zeros(len(xs))
    for r in bins:
        (pos if r["toxic"] else neg)[at_x[r["x"]]] += r["count"]
    model.intercept, model.slope = _logistic(np.array(xs), pos, neg)
    return model


def _score_pass(model: ToxicityModel):
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("excess", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scanner(model)
        for batch in slices(batches):
            score, spans = [], []
            for text in batch.column(1).to_pylist():
                kept = scan.excess(*scan(text))
                x = min(60.0, sum(s for _, _, s in kept))
                score.append(1 / (1 + math.exp(-max(-40.0, min(40.0, model.intercept + model.slope * x)))))
                spans.append([{"first_word": a, "end_word": b, "excess": s} for a, b, s in kept])
            names = [batch.schema.names[0], "score", "passages"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(spans, kind)], names)

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """One row per input row: doc_id, score, and passages (word ranges with their excess).

    Words are counted from 0 over the whole lower-cased text, however long.  Null and empty texts have no passage
    and get the score of a text without any.  Repeated rows and null ids give rows of their own; an empty table gives none.  Other columns, whatever their names, are not read.  ``keep`` names a column (a struct of all a caller needs,
    say) that is handed through instead of doc_id.
    """
    rows = docs.select(keep, F.col(text_col).alias("text")) if keep else text_rows(docs, id_col, text_col)
    passage = T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("excess", T.DoubleType())])
    schema = T.StructType([rows.schema.fields[0], T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(passage))])
    return rows.mapInArrow(_score_pass(model), schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's toxicity, learned from the labels outside the held-out third."""
    docs = documents(spark, sf_dir)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
