"""Document fingerprints by content-defined chunking.

A 32-bit gear hash over the UTF-8 bytes - its window is the last 32 bytes - sets the
boundaries, with a stricter mask before the normal chunk size and a laxer one after it.
Boundaries depend on nearby bytes only, so an insertion shifts but does not change the
chunks after it.  A fingerprint is the set of chunk digests weighted by length; likeness is
the share of the lighter fingerprint's weight that the other one has too.

To compare every document with the next one in id order, ids are cut into ranges, one
task each, and the first document of a range also goes to the range before it.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, text_rows

LEAST, NORMAL, MOST = 24, 64, 256
#: Leading zero bits that end a chunk before and after the normal size: 1 byte in 256, then 1 in 16.
STRICT, LAX = np.uint32(24), np.uint32(28)
#: Rows of an id range beyond which there are more ranges, and the most ranges whose bounds the driver keeps.
RANGE_ROWS, MOST_RANGES = 50_000, 20_000
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=2654435761) for b in range(256)], np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte: h[i] = 2 h[i - 1] + GEAR[data[i]] mod 2**32, by doubling the window five times."""
    h = GEAR[data]
    span = 1
    while span < 32:
        h[span:] += h[:-span] << np.uint32(span) if len(h) > span else h[:0]
        span *= 2
    return h


def boundaries(data: bytes) -> list[int]:
    """End of every chunk."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear_hash(np.frombuffer(data, np.uint8))
    lax = np.flatnonzero((h >> LAX) == 0) + 1
    strict = lax[(h[lax - 1] >> STRICT) == 0].tolist()
    lax = lax.tolist()
    out, start = [], 0
    while n - start > LEAST:
        i = bisect_left(strict, start + LEAST)
        end = strict[i] if i < len(strict) else n
        if end > start + NORMAL:
            i = bisect_left(lax, start + NORMAL)
            end = min(lax[i] if i < len(lax) else n, start + MOST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunks(text: str) -> dict[bytes, int]:
    """Digest to weight: the bytes in all chunks with this digest."""
    data = text.encode("utf-8")
    out: Counter = Counter()
    start = 0
    for end in boundaries(data):
        out[xxhash.xxh64_digest(data[start:end])[:6]] += end - start
        start = end
    return out


def packed(weights: dict[bytes, int]) -> str:
    """A fingerprint as text: sorted 6-byte digests with 4-byte weights, in base 64."""
    return base64.b64encode(b"".join(d + min(w, 2**32 - 1).to_bytes(4, "little") for d, w in sorted(weights.items()))).decode()


def unpacked(fingerprint: str) -> dict[bytes, int]:
    raw = base64.b64decode(fingerprint)
    return {raw[i : i + 6]: int.from_bytes(raw[i + 6 : i + 10], "little") for i in range(0, len(raw), 10)}


def likeness(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Containment of the lighter fingerprint in the other; 1 for two empty ones, 0 for one."""
    if not a or not b:
        return float(not a and not b)
    if len(a) > len(b):
        a, b = b, a
    both = sum(min(w, b[d]) for d, w in a.items() if d in b)
    return both / min(sum(a.values()), sum(b.values()))


def edited(text: str, other: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many of other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _row(doc_id, text: str, own: dict, other: str, theirs: dict) -> tuple:
    new = edited(text, other)
    news = chunks(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8")).hexdigest(), packed(own), packed(news), likeness(own, news), likeness(own, theirs)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _pair_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range and id, the next range's first document last and marked."""
    held = None  # range, id, text, chunks of the document that waits for its next
    for batch in slices(batches):
        out = []
        for part, borrowed, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if part < 0:
                own = chunks(text)
                out.append(_row(doc_id, text, own, text, own))
                continue
            if held and held[0] != part:
                held = None
            if borrowed and not held:
                continue
            own = chunks(text)
            if held:
                out.append(_row(held[1], held[2], held[3], text, own))
            held = None if borrowed else (part, doc_id, text, own)
        columns = zip(*out, strict=True) if out else [[] for _ in _NAMES]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Per input row its fingerprint, that of its edited text, and likeness to that and to the next document.

    The next document follows in id order, rows with one id in order of their text; after the last
    comes the first.  A row with a null id has no place there: its own text serves as the next.
    Null and empty texts have an empty fingerprint, and equal texts equal ones, so ties tell nothing apart.  ``parts`` id ranges have one task each: by default as many as shuffle partitions,
    and more, up to MOST_RANGES, where a range would exceed RANGE_ROWS; rows that repeat one id share a range.  A very long text is held by one task, with its next one.
    An empty table gives no rows.  Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    rows = text_rows(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, docs.count() // RANGE_ROWS))
    cuts = rows.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    at = np.unique(np.array(cuts, np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), -1, np.searchsorted(at, ids.fillna(0).to_numpy(np.int64), "right")).astype(np.int32))

    # one row a range: its first id
    heads = sorted((r["part"], r["first"]) for r in rows.where("doc_id is not null").groupBy(range_of("doc_id").alias("part")).agg(F.min("doc_id").alias("first")).collect())
    before = {first: heads[i - 1][0] for i, (_, first) in enumerate(heads)}
    firsts = np.array(sorted(before), np.int64)
    to = np.array([before[f] for f in sorted(before)], np.int32)

    @F.pandas_udf("array<int>")
    def ranges_of(ids: pd.Series) -> pd.Series:
        v = ids.fillna(0).to_numpy(np.int64)
        own = np.where(ids.isna(), -1, np.searchsorted(at, v, "right"))
        i = np.minimum(np.searchsorted(firsts, v), max(len(firsts) - 1, 0))
        also = (firsts[i] == v) & ~ids.isna().to_numpy() if len(firsts) else np.zeros(len(v), bool)
        return pd.Series([[int(o), int(to[j])] if a else [int(o)] for o, j, a in zip(own, i, also, strict=True)])

    dealt = rows.select("doc_id", "text", F.posexplode(ranges_of("doc_id")).alias("borrowed", "part"))
    dealt = dealt.repartitionById(n, F.pmod("part", F.lit(n))).sortWithinPartitions("part", "borrowed", "doc_id", "text").select("part", (F.col("borrowed") > 0).alias("borrowed"), "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_pair_pass, schema)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: fingerprints of all documents and their likeness to an edited text and the next document."""
    return fingerprints(documents(spark, sf_dir))
