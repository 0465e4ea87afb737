"""Secrets in texts by a trigram inverted index.

Each rule is a regular expression.  From its parse tree a Boolean query over trigrams is derived: what every match has to
hold, as an OR of ANDs.  Rows are indexed in blocks: a block has, for each trigram of its texts (A-Z lowered), the
ascending list of the rows that hold it.  A rule's postings are intersected and united block by block, and the rule is run over the
rows that come out, the candidates, alone; a rule from which no mandatory trigram follows is run over all rows.

A block is one row of a DataFrame and holds its texts beside the postings, as a segment of a search engine does.  So the index may be
written to Parquet once and searched again whenever rules change, or be searched as it is made.  Neither step shuffles, and a lost
executor costs the blocks of its partitions only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, text_rows


def _either(word: str) -> str:
    """A word's letters in either case, as classes that every regex library reads alike."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and how long a group of a match has to be; a shorter match is dropped after it was found."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules, and how keys of well-known services are written.
BASE = (
    Rule("assign", "(" + "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]{16,}"),
)
SERVICES = (
    Rule("github", "gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("payment", "[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\x20\\x0A\\x0D]*-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("login", r"://([^/\x20\x09\x0A\x0D:@]+):([^/\x20\x09\x0A\x0D:@]+)@", 2, 6),
)
RULES = BASE + SERVICES
#: Strings that a part of a pattern may stand for before it counts as unknown, and ANDs of a query before it is cut.
STRINGS, ANDS = 64, 64
#: A block ends with the first row that brings it to so many rows or characters.
BLOCK_ROWS, BLOCK_CHARS = 512, 2_000_000

#: An OR of ANDs of trigrams; None: no condition.
Query = frozenset[frozenset[bytes]] | None


def _or(parts: list[Query]) -> Query:
    if any(p is None for p in parts):
        return None
    ands = set().union(*parts)
    return frozenset(a for a in ands if not any(b < a for b in ands))


def _and(a: Query, b: Query) -> Query:
    """Both conditions; where that is too many ANDs, the one with fewer alone, which lets more rows through."""
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > ANDS:
        return min(a, b, key=len)
    return _or([frozenset(x | y for x in a for y in b)])


def _holds(words: set[bytes]) -> Query:
    """A text that holds one of the words holds all trigrams of one; a word under three bytes tells nothing."""
    return _or([frozenset([frozenset(w[i : i + 3] for i in range(len(w) - 2))]) if len(w) > 2 else None for w in words])


def _letters(code: int) -> set[bytes]:
    return {chr(code).encode().lower()}


def _class(items) -> set[bytes] | None:
    found: set[bytes] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found |= _letters(value)
        elif kind is op.RANGE and value[1] - value[0] < STRINGS:
            found |= set().union(*(_letters(c) for c in range(value[0], value[1] + 1)))
        else:
            return None
    return found if len(found) <= STRINGS // 4 else None


def _condition(items) -> tuple[set[bytes] | None, Query]:
    """For a sequence of a parse tree: all strings it may stand for, if they are few, and what a text with a match has to hold."""
    words, query = {b""}, None
    whole = True
    for kind, value in items:
        own: set[bytes] | None = None
        more: Query = None
        if kind is op.LITERAL:
            own = _letters(value)
        elif kind is op.IN:
            own = _class(value)
        elif kind is op.AT:
            own = {b""}
        elif kind is op.SUBPATTERN:
            own, more = _condition(value[3])
        elif kind is op.BRANCH:
            each = [_condition(x) for x in value[1]]
            own = None if any(w is None for w, _ in each) else set().union(*(w for w, _ in each))
            more = _or([q for _, q in each])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            one, more = _condition(inner)
            more = more if least else None
            if one is not None and most == 1:
                own = one | {b""} if least == 0 else one
            elif one is not None and len(one) == 1 and least == most:
                own = {next(iter(one)) * least}
        if own is not None and len(own) <= STRINGS and len(words) * len(own) <= STRINGS:
            words = {a + b for a in words for b in own}
        else:
            query, whole = _and(query, _holds(words)), False
            words = own if own is not None and len(own) <= STRINGS else {b""}
        query = _and(query, more)
    return (words if whole else None), _and(query, _holds(words))


def trigram_query(pattern: str) -> Query:
    """The trigrams, A-Z lowered, that every text with a match holds: an OR of ANDs, or None where none is mandatory."""
    return _condition(_parser.parse(pattern))[1]


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's index: ascending trigrams, where the postings of each end, and all postings."""
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    b = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
    if len(b) < 3:
        none = np.empty(0, np.int32)
        return none, none, none
    row = np.repeat(np.arange(len(data), dtype=np.int64), sizes)
    inside = row[:-2] == row[2:]
    key = np.unique((((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) << 20 | row[:-2])[inside])
    gram, slot = (key >> 20).astype(np.int32), (key & 0xFFFFF).astype(np.int32)
    last = np.flatnonzero(np.diff(gram, append=-1))
    return gram[last], (last + 1).astype(np.int32), slot


SEGMENT = "ids array<long>, texts array<string>, trigrams array<int>, ends array<int>, postings array<int>"


def _index_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["ids", "texts", "trigrams", "ends", "postings"]

    def block(ids, texts):
        gram, end, slot = _trigrams(texts)
        columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string())), *[pa.array([x], pa.list_(pa.int32())) for x in (gram, end, slot)]]
        return pa.RecordBatch.from_arrays(columns, names)

    ids, texts, chars = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(text or "")
            chars += len(texts[-1])
            if len(ids) >= BLOCK_ROWS or chars >= BLOCK_CHARS:
                yield block(ids, texts)
                ids, texts, chars = [], [], 0
    if ids:
        yield block(ids, texts)


def index_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The trigram index of docs, a row a block: its ids and texts, and the postings of every trigram.

    A null text is indexed as an empty one.  Null and repeated ids are rows of their own.  A very long text is a block of its own or ends one.
    An empty table has no block.  Other columns, whatever their names, are not read.
    """
    return text_rows(docs, id_col, text_col).mapInArrow(_index_pass, SEGMENT)


def candidates(query: Query, n: int, trigrams: np.ndarray, ends: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """The rows of a block of n rows that meet a query, in order; all of them where there is none."""
    if query is None:
        return np.arange(n)
    met = np.zeros(n, bool)
    for grams in query:
        codes = np.sort([int.from_bytes(g, "big") for g in grams])
        at = np.searchsorted(trigrams, codes)
        if len(trigrams) == 0 or (at == len(trigrams)).any() or (trigrams[at] != codes).any():
            continue
        lists = sorted((postings[ends[i - 1] if i else 0 : ends[i]] for i in at), key=len)
        both = lists[0]
        for more in lists[1:]:
            both = both[np.isin(both, more, assume_unique=True)]
        met[both] = True
    return np.flatnonzero(met)


def spans(rule: Rule, pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the rule's matches, leftmost first, none inside another; short ones are dropped after they were found."""
    for m in pattern.finditer(text):
        a, b = m.span(rule.group)
        if b - a >= rule.least:
            yield m.span()


FOUND = "doc_id long, spans array<struct<kind:string,start:int,end:int,secret:string>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("secret", pa.string())]))


def _search_pass(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [re.compile(r.pattern) for r in rules]
        for batch in batches:
            for k in range(batch.num_rows):
                ids, texts = batch.column(0)[k].as_py(), batch.column(1)[k].values
                index = [batch.column(i)[k].values.to_numpy() for i in (2, 3, 4)]
                found: list[list] = [[] for _ in ids]
                kept: dict[int, str] = {}
                for rank, (rule, query, pattern) in enumerate(zip(rules, queries, patterns, strict=True)):
                    for row in candidates(query, len(ids), *index).tolist():
                        if row not in kept:
                            kept[row] = texts[row].as_py()
                        found[row] += [(a, rank, b) for a, b in spans(rule, pattern, kept[row])]
                said = [[{"kind": rules[rank].kind, "start": a, "end": b, "secret": kept[row][a:b]} for a, rank, b in sorted(x)] for row, x in enumerate(found)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(said, _SPAN)], ["doc_id", "spans"])

    return run


def search_index(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) for every row of an index, spans by start and then in the order of the rules; of a rule, spans do not overlap.

    Places are code points, the end exclusive.  A row without secrets has no spans, an empty index no row.
    """
    return index.mapInArrow(_search_pass(rules), FOUND)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """:func:`search_index` over :func:`index_texts`: a row for each row of docs, those with null or empty texts without spans."""
    return search_index(index_texts(docs, id_col=id_col, text_col=text_col), rules)


def op11_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Query: counts of the base kinds, the digest of the base spans, and all spans."""
    base = [r.kind for r in BASE]
    said = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    joined = lambda spans: F.array_join(F.transform(spans, said), ",")
    of = lambda kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    found = scan_secrets(documents(spark, sf_dir))
    return found.select("doc_id", *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in base], F.sha2(joined(of(base)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql_kind(rank: int, r: Rule) -> str:
    """Spans of a rule: pieces between matches and the matches themselves give the places."""
    p = r.pattern.replace("'", "''")
    return f"""SELECT doc_id, rank, '{r.kind}' AS kind, list_sum(list_transform(between[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(said[:i - 1], lambda x: length(x))), 0) AS start, length(said[i]) AS len
    FROM (SELECT doc_id, {rank} AS rank, between, said, part, unnest(generate_series(1, len(said))) AS i FROM (SELECT doc_id, string_split_regex(t, '{p}') AS between, regexp_extract_all(t, '{p}') AS said, regexp_extract_all(t, '{p}', {r.group}) AS part FROM d WHERE regexp_matches(t, '{p}')))
    WHERE length(part[i]) >= {r.least}"""


_BASE_SQL = "(" + ", ".join(f"'{r.kind}'" for r in BASE) + ")"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS doc_id, doc_id AS own_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_sql_kind(i, r) for i, r in enumerate(RULES))}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
      string_agg(kind || ':' || start::BIGINT || ':' || (start + len)::BIGINT, ',' ORDER BY start, rank) FILTER (WHERE kind IN {_BASE_SQL}) AS base,
      string_agg(kind || ':' || start::BIGINT || ':' || (start + len)::BIGINT, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT own_id AS doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
