"""Phrase collocations from count streams that are kept in prefix and in suffix order.

Phrases of one word, two words and so on are counted in turns.  A phrase can only reach the least count where both phrases that are one
word shorter do, so a turn emits those places alone; which phrases do is a bitmap of bounded size, whose false hits cost rows but no
exactness.  Inside a task phrases are told apart by the places of their words in sorted order, so no two phrases are ever mixed up.

The counts that are left make one stream a phrase length.  Every cut of a phrase needs the count of its first part and that of its
rest: the phrases sorted by first part run in step with the counts in prefix order, and sorted by rest in step with the counts in suffix
order.  The longer phrases, sorted once by all but their last word and once by all but their first, run in step with the phrases
that they extend.  All of these are merge joins of sorted streams; none builds a hash table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH_ROWS, documents, materialize, release

LEAST, LONGEST, TOP = 100, 5, 2000
#: Characters that end a piece; phrases stand within pieces.
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Bits of a bitmap a phrase, and the most bits of a bitmap (16 MB); beyond it more places are emitted than need be.
BITS_EACH, BITS_MOST = 16, 1 << 27
#: Parts in which the first of a language are found before they are put together.
PARTS = 64
#: Languages that may be broadcast with their word counts.
BROADCAST_LANGS = 100_000
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
#: No UTF-8 text has this byte.
_END = b"\xff"
_TABLE = bytes(0xFF if i in BREAKS else 0x20 if i == 9 else i for i in range(256))


def _words(texts: list[bytes]) -> list[bytes]:
    """All words of texts, A-Z lowered, with an end mark between pieces."""
    return _END.join(texts).lower().translate(_TABLE).replace(_END, b" \xff ").split()


def _mixed(words: list[np.ndarray], lang: str) -> np.ndarray:
    """A 64-bit hash of phrases, given as the hashes of their first, second, ... words."""
    x = np.full(len(words[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for w in words:
        x = (x ^ w) * _MIX
        x ^= x >> _SHIFT
    return x


def _cells(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of a bitmap for each hash."""
    place = hashes >> np.uint64(64 - bits)
    return place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63))


COUNTED = "lang string, phrase string, f long"


def _count_pass(k: int, bitmap: Broadcast | None):
    """Counts of the phrases of k words, a batch; for one word also the words of the batch, as phrase null."""

    def phrases(lang: str, texts: list[bytes]) -> tuple[list[bytes | None], np.ndarray]:
        words = _words(texts)
        names = list(dict.fromkeys(words))
        number = {w: i for i, w in enumerate(names)}
        seq = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        end = number.get(_END, -1)
        if k == 1:
            counts = np.bincount(seq[seq != end], minlength=len(names))
            kept = np.flatnonzero(counts)
            return [*(names[i] for i in kept), None], np.append(counts[kept], counts.sum())
        if len(seq) < k:
            return [], np.empty(0, np.int64)
        filled = bitmap.value
        bits = len(filled).bit_length() + 5
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)[seq]
        m = len(seq) - k + 2  # places of the phrases one word shorter
        cell, bit = _cells(_mixed([hashes[i : i + m] for i in range(k - 1)], lang), bits)
        known = (filled[cell] & bit) != 0
        for i in range(k - 1):
            known &= seq[i : i + m] != end
        at = np.flatnonzero(known[:-1] & known[1:])
        if not len(at):
            return [], np.empty(0, np.int64)
        key = seq[at]
        for i in range(1, k):
            _, first, key, counts = np.unique(key * len(names) + seq[at + i], return_index=True, return_inverse=True, return_counts=True)
        return [b" ".join(words[p : p + k]) for p in at[first].tolist()], counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append((text or "").encode("utf-8", "surrogatepass"))
            for lang, texts in by_lang.items():
                said, counts = phrases(lang, texts)
                columns = [pa.array([lang] * len(said), pa.string()), pa.array(said, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])

    return run


def _bitmap_pass(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[list[bytes]]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(phrase.encode("utf-8", "surrogatepass").split(b" "))
            filled = np.zeros(1 << (bits - 6), np.uint64)
            for lang, phrases in by_lang.items():
                columns = [np.array([xxhash.xxh64_intdigest(w) for w in column], np.uint64) for column in zip(*phrases, strict=True)]
                np.bitwise_or.at(filled, *_cells(_mixed(columns, lang), bits))
            cell = np.flatnonzero(filled)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(filled[cell].view(np.int64))], ["cell", "bits"])

    return run


def _bitmap(counts: DataFrame) -> Broadcast | None:
    """The phrases of one length as a bitmap; its size has a bound, so the driver holds no more than that."""
    n = counts.count()
    if not n:
        return None
    bits = (min(max(n * BITS_EACH, 1 << 12), BITS_MOST) - 1).bit_length()
    parts = counts.select("lang", "phrase").mapInArrow(_bitmap_pass(bits), "cell long, bits long")
    cells = parts.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled = np.zeros(1 << (bits - 6), np.uint64)
    filled[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return counts.sparkSession.sparkContext.broadcast(filled)


def _counted(docs: DataFrame, lang_col: str, text_col: str, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of all phrases with f >= least, and (lang, n); tables."""
    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    words = materialize(texts.mapInArrow(_count_pass(1, None), COUNTED).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("phrase").isNull() | (F.col("f") >= least)), "words")
    totals = words.where("phrase is null").select("lang", F.col("f").alias("n"))
    streams = [words.where("phrase is not null")]
    for k in range(2, longest + 1):
        bitmap = _bitmap(streams[-1])
        if bitmap is None:
            break
        found = texts.mapInArrow(_count_pass(k, bitmap), COUNTED).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        streams.append(materialize(found, f"phrases{k}"))
        bitmap.unpersist()
    each = [s.select("lang", F.lit(i + 1).alias("k"), "phrase", "f") for i, s in enumerate(streams)]
    out = each[0]
    for s in each[1:]:
        out = out.unionByName(s)
    return out, totals


def _joined(words: Column, start: Column | int, count: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(start) if isinstance(start, int) else start, count), " ")


def collocations(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of 2 to longest words that occur at least least times in a language and are part of no longer one with as many.

    a: the phrase's count; l and r: counts of the first part and the rest at the cut with the lowest score, the first of these; n: the language's words; score: floor(1000 * a * n / (l * r)).
    A null language is ``und``; null and empty texts hold nothing.  Repeated rows count each.  Very long texts are read whole, and a phrase may
    run over all of a piece.  An empty table gives an empty result.  Other columns, whatever their names, are not read.
    """
    counts, totals = _counted(docs, lang_col, text_col, least, longest)
    words = F.split("phrase", " ")
    phrases = counts.where("k >= 2")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k")
    cuts = cuts.select("lang", "phrase", "a", "cut", _joined(F.col("w"), 1, F.col("cut")).alias("first"), _joined(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    prefixes = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    suffixes = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    parted = cuts.join(prefixes.hint("merge"), ["lang", "first"]).join(suffixes.hint("merge"), ["lang", "rest"])
    totals = F.broadcast(totals) if totals.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS else totals
    # decimals of 38 digits and an integer division: exact where a product passes 64 bits
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    scored = parted.join(totals, "lang").withColumns({f"{c}_": v for c, v in exact.items()}).withColumn("score", F.expr("(1000BD * a_ * n_) div (l_ * r_)"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    longer = counts.where("k >= 3")
    shorter = [longer.select("lang", _joined(words, start, F.col("k") - 1).alias("phrase"), "f") for start in (1, 2)]
    extended = shorter[0].unionByName(shorter[1]).groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    # a phrase has at least the count of any longer one around it, so one word more tells of all
    kept = best.join(extended.hint("merge"), ["lang", "phrase"], "left").where("longest is null or longest < a")
    return kept.select("lang", "phrase", "a", "l", "r", "n", "score")


def top_collocations(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first of each language by score, count and phrase, with their rank from 1; parts of a language first, so that no task sorts all of one."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """Query: each language's first 2000 collocations."""
    return top_collocations(collocations(documents(spark, sf_dir)))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP12_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents),
w AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM p)),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM w, (SELECT unnest(generate_series(1, {LONGEST})) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
t AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM g WHERE f >= {LEAST}),
x AS (SELECT lang, k, phrase, f, array_to_string(w[:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest, cut FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c WHERE k >= 2)),
s AS (SELECT x.lang, x.phrase, x.f AS a, l.f AS l, r.f AS r, n, cut, (1000::HUGEINT * x.f * n) // (l.f::HUGEINT * r.f) AS score
      FROM x JOIN c l ON x.lang = l.lang AND x.first = l.phrase JOIN c r ON x.lang = r.lang AND x.rest = r.phrase JOIN t ON x.lang = t.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
e AS (SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, f FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM c WHERE k >= 3))),
z AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.lang = b.lang AND e.phrase = b.phrase AND 100 * e.f >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM z QUALIFY rank <= {TOP}
"""
