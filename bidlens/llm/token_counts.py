"""Exact token counts at every prefix by dynamic programming.

The vocabulary is a byte-level BPE with word ends that drops white space.  Texts fall apart
at ASCII white space into chunks whose tokens do not depend on each other, so counts add
up over chunks and a chunk's counts are kept for its next occurrence.

Inside a word, the last token of every prefix is unique: it is the one token t that
ends there and stands after the last token p of the prefix before it, where p and t are
kept apart when their own text is encoded.  That gives the count at a prefix from the
count at a shorter one, without encoding any prefix.  A prefix inside a word ends with
that vocabulary's word-end form of its last token.  Words that begin alike share the states of their common beginning.

Two tokens stay apart unless some merge joins a part that ends the left one with a part that begins the right one
while both are still there: the parts are read off the tokens' own merges, each with the rank at which it is absorbed.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import sub

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import documents, slices, text_rows

VOCABULARY = "word_bpe_49k.json"
#: What separates chunks.  Other white space stays inside a chunk, where the library handles it.
SPACES = re.compile(r"[ \t\n\r\f\v]+")
#: ASCII separators that str.split() takes for white space and the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
_CACHE = 200_000
#: Words and chunks whose steps a worker keeps, about 200 bytes each.
_KNOWN = 600_000
END = "</w>"


def load(name: str = VOCABULARY) -> Tokenizer:
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_padding()
    t.no_truncation()
    return t


def _chunks(text: str) -> list[str]:
    """The text between ASCII white space; split() takes more for white space, so it serves where that is absent."""
    if text.isascii() and not _ODD.search(text):
        return text.split()
    return [c for c in SPACES.split(text) if c]


#: Chunks of these characters are normalised letter by letter; others go through the whole library.
_SIMPLE = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]+").fullmatch
#: The vocabulary's own split into words, for lower-cased simple chunks (a fixed pattern).
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+").findall


class ChunkCache:
    """Token ids of chunks, by the library, as little-endian 32-bit bytes, kept while they fit."""

    def __init__(self, name: str = VOCABULARY):
        self.tokenizer, self.ids, self.words = load(name), {}, {}
        letters = _byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x180)}
        self.split = name == VOCABULARY

    def _encode(self, chunk: str) -> bytes:
        if not self.split or not _SIMPLE(chunk) or "<|" in chunk:
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        low, words, out = chunk.lower(), self.words, []
        for w in (low,) if low.isascii() and low.isalpha() else _WORDS(low):
            v = words.get(w)
            if v is None:
                if len(words) > _CACHE:
                    words.clear()
                model_text = w if w.isascii() else w.translate(self.letters)
                v = words[w] = array("I", [t.id for t in self.tokenizer.model.tokenize(model_text)]).tobytes()
            out.append(v)
        return b"".join(out)

    def of(self, text: str | None) -> list[bytes]:
        """Per chunk of the text, the token ids."""
        chunks = _chunks(text or "")
        ids = self.ids
        found = list(map(ids.get, chunks))
        if None in found:
            if len(ids) > _CACHE:
                ids.clear()
            for i, v in enumerate(found):
                if v is None:
                    c = chunks[i]
                    v = ids.get(c)
                    if v is None:
                        v = ids[c] = self._encode(c)
                    found[i] = v
        return found


@lru_cache(maxsize=2)
def chunk_cache(name: str) -> ChunkCache:
    """One cache for all tasks that a Python worker runs."""
    return ChunkCache(name)


class PrefixTable:
    """Counts at every prefix of a word, by dynamic programming over the last token."""

    def __init__(self, name: str = VOCABULARY):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.parts = {left + right: (left, right, i) for i, (left, right) in enumerate(pairs)}
        self.apart = lru_cache(maxsize=_CACHE)(self._apart)
        self.edges = lru_cache(maxsize=100_000)(self._edges)
        self.whole = lru_cache(maxsize=100_000)(self._whole)
        tokens = [t for t in model["vocab"] if self.whole(t)]
        self.inside = frozenset(t for t in tokens if not t.endswith(END))
        self.final = frozenset(t[: -len(END)] for t in tokens if t.endswith(END))
        self.longest = max(map(len, self.inside | self.final))
        #: 1 for tokens inside a word, 2 for those that end one, 3 for both
        self.forms = {t: (t in self.inside) + 2 * (t in self.final) for t in self.inside | self.final}
        # of the word before: its letters and, by prefix, the last token, the count of tokens and the count as a word
        self.word, self.last, self.count, self.ended = "", [""], [0], [0]

    def _edges(self, token: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
        """The parts that begin and those that end the token at some time, with the rank of the merge that absorbs each."""
        out: tuple[list, list] = ([], [])
        for side in (0, 1):
            part, absorbed = token, float("inf")
            while True:
                out[side].append((part, absorbed))
                if part not in self.parts:
                    break
                *halves, absorbed = self.parts[part]
                part = halves[side]
        return out

    def _apart(self, left: str, right: str) -> bool:
        """Whether encoding the joint text of two tokens gives these two again.

        Equal merges go from left to right, so one across the border is before an equal one on its right.
        """
        rank = self.rank
        for x, until in self.edges(left)[1]:
            for y, before in self.edges(right)[0]:
                k = rank.get((x, y))
                if k is not None and k < until and k <= before:
                    return False
        return True

    def _whole(self, token: str) -> bool:
        """Whether the token's own text is encoded as that token."""
        if token not in self.parts:
            return True
        left, right, _ = self.parts[token]
        if not (self.whole(left) and self.whole(right)):
            return False
        # its halves have to survive until they meet: no other merge takes a part of both before
        rank, last = self.rank, self.parts[token][2]
        for x, until in self.edges(left)[1]:
            for y, before in self.edges(right)[0]:
                k = rank.get((x, y))
                if k is not None and k < until and k <= before and k < last:
                    return False
        return True

    def counts(self, word: str) -> list[int]:
        """word in the vocabulary's byte letters; entry j: tokens of its first j letters taken as a word."""
        k = 0
        for x, y in zip(word, self.word, strict=False):
            if x != y:
                break
            k += 1
        last, count, ended, form_of, apart = self.last, self.count, self.ended, self.forms.get, self.apart
        del last[k + 1 :], count[k + 1 :], ended[k + 1 :]
        self.word = word
        for j in range(k + 1, len(word) + 1):
            n_inside = n_final = 0
            # one start holds for each form, in whatever order they are tried: first that of the token before, made longer
            low, likely = max(0, j - self.longest), max(0, j - 1 - len(last[j - 1]))
            i, then = likely, j - 1
            while True:
                token = word[i:j]
                form = form_of(token)
                if form:
                    if form & 2 and not n_final and (i == 0 or apart(last[i], token + END)):
                        n_final = count[i] + 1
                    if form & 1 and not n_inside and (i == 0 or apart(last[i], token)):
                        n_inside, ended_by = count[i] + 1, token
                    if n_inside and n_final:
                        break
                if then == likely:
                    then -= 1
                if then < low:
                    break
                i, then = then, then - 1
            last.append(ended_by)
            count.append(n_inside)
            ended.append(n_final)
        return list(ended)


def _byte_letters() -> dict[int, str]:
    """The printable letter for each byte in byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


#: The vocabulary's special strings, each one token, and its contractions, which are words of their own.
SPECIAL = re.compile("(<\\|startoftext\\|>|<\\|endoftext\\|>)")
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
_BLANK = np.zeros(1, "<i4").tobytes()


def _joins(c: str) -> bool:
    """Whether c may change when it is normalised together with what stands before it: marks, and vowel and final Hangul letters."""
    return ord(c) > 0x2FF and (unicodedata.category(c)[0] == "M" or 0x1161 <= ord(c) <= 0x11C2)


def _blanked(text: str | None) -> str:
    """text with blanks for all ASCII white space."""
    text = text or ""
    for c in "\t\n\r\f\v":
        text = text.replace(c, " ")
    return text


class PrefixCounter:
    """Counts of tokens at every code point of a text, exact, from the words' tables.

    Steps are the differences of neighbouring counts, one a code point, as little-endian 32-bit bytes; those of a chunk are
    its words' one after another, and a zero for the blank after it.
    """

    def __init__(self, name: str = VOCABULARY):
        self.tokenizer, self.table = load(name), PrefixTable(name)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": _BLANK}

    def _split(self, text: str) -> list[str]:
        """The words of a normalised text."""
        if _SIMPLE(text):
            return _WORDS(text)
        return [bytes(_LETTER_BYTES[c] for c in w).decode("utf-8") for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _normal(self, text: str) -> str:
        return text.lower() if text.isascii() or _SIMPLE(text) else self.tokenizer.normalizer.normalize_str(text)

    def _word(self, word: str) -> bytes:
        """Steps of a word."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) > _KNOWN:
                self.words.clear()
            if word.isascii() and word.isprintable():
                counts = self.table.counts(word)
                if word in CONTRACTIONS:  # cut short it is an apostrophe and a word
                    counts = [0, *(self._total(word[:i]) for i in range(1, len(word))), counts[-1]]
            else:
                letters, ends = _letters_of(word)
                at_letter = self.table.counts(letters)
                counts = [0, *(at_letter[i] for i in ends)]
            found = self.words[word] = array("i", map(sub, counts[1:], counts)).tobytes()
        return found

    def _total(self, text: str) -> int:
        """Tokens of a normalised text without special strings."""
        return sum(int(np.frombuffer(self._word(w), "<i4").sum()) for w in self._split(text))

    def _plain(self, text: str) -> np.ndarray:
        """Entry i: tokens of the first i code points of a normalised text."""
        parts, at = [], 0
        for word in self._split(text):
            while text[at] == " ":
                parts.append(_BLANK)
                at += 1
            parts.append(self._word(word))
            at += len(word)
        parts += [_BLANK] * (len(text) - at)
        return np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(parts), "<i4"))])

    def _starts(self, text: str) -> list[int]:
        """Where the words of a normalised text begin."""
        out, at = [0], 0
        for word in self._split(text):
            while text[at] == " ":
                at += 1
            out.append(at)
            at += len(word)
        return out

    def _ordinary(self, text: str) -> list[int]:
        """Entry i: tokens of the first i code points of a text without ASCII white space or special strings."""
        clusters: list[str] = []
        for c in text:
            if clusters and _joins(c):
                clusters[-1] += c
            else:
                clusters.append(c)
        forms = [self._normal(c) for c in clusters]
        normal = "".join(forms)
        whole, starts = self._plain(normal).tolist(), self._starts(normal) if len(clusters) < len(text) else []
        out, at = [0], 0
        for cluster, form in zip(clusters, forms, strict=True):
            for i in range(1, len(cluster)):  # inside a cluster its beginning is normalised by itself; the word before it stays
                tail = starts[bisect_right(starts, at - 1) - 1] if at else 0
                out.append(whole[tail] + self._total(normal[tail:at] + self._normal(cluster[:i])))
            at += len(form)
            out.append(whole[at])
        return out

    def _chunk(self, chunk: str) -> list[int]:
        """Entry i: tokens of the chunk's first i code points."""
        if "<|" not in chunk:
            return self._ordinary(chunk)
        out, before = [0], 0
        parts = SPECIAL.split(chunk)  # ordinary and special strings take turns
        for i in range(0, len(parts), 2):
            special = parts[i + 1] if i + 1 < len(parts) else ""
            counts = self._ordinary(parts[i] + special)  # a special string that is not complete is ordinary text
            out += [before + c for c in counts[1:]]
            if special:
                out[-1] = before + counts[0] + (self._ordinary(parts[i])[-1] if parts[i] else 0) + 1
            before = out[-1]
        return out

    def steps(self, texts: list[str | None]) -> list[bytes]:
        """Steps of texts.  New words go in order, in which neighbours share the most of their states."""
        if len(self.chunks) > _KNOWN:
            self.chunks = {"": _BLANK}
        chunks, words, parted = self.chunks, self.words, [_blanked(t).split(" ") for t in texts]
        seen: set[str] = set()
        for part in parted:
            seen.update(part)
        fresh = [c for c in seen if c not in chunks]
        split = {c: _WORDS(c.lower()) for c in fresh if _SIMPLE(c) and "<|" not in c}
        for word in sorted({w for ws in split.values() for w in ws if w not in words}):
            self._word(word)
        for chunk in fresh:
            ws = split.get(chunk)
            if ws is None:
                counts = self._chunk(chunk)
                chunks[chunk] = array("i", map(sub, counts[1:], counts)).tobytes() + _BLANK
            elif len(ws) == 1:
                chunks[chunk] = self._word(ws[0]) + _BLANK
            else:
                chunks[chunk] = b"".join([*map(self._word, ws), _BLANK])
        return [b"".join(map(chunks.__getitem__, part))[:-4] for part in parted]

    def __call__(self, text: str | None) -> np.ndarray:
        """Entry i: exact token count of the text's first i code points; the last entry is the whole text's."""
        return np.concatenate([[0], np.cumsum(np.frombuffer(self.steps([text])[0], "<i4"))])


_LETTER_BYTES = {c: b for b, c in _byte_letters().items()}
_BYTE_LETTERS = _byte_letters()


def _letters_of(word: str) -> tuple[str, list[int]]:
    """A word in byte letters, and how many there are up to and with each code point."""
    parts = ["".join(_BYTE_LETTERS[b] for b in c.encode("utf-8", "surrogatepass")) for c in word]
    return "".join(parts), list(accumulate(map(len, parts)))


@lru_cache(maxsize=2)
def prefix_counter(name: str) -> PrefixCounter:
    """One counter for all tasks that a Python worker runs."""
    return PrefixCounter(name)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix such that neither it nor a shorter one has more than budget tokens; counts start with the empty prefix."""
    over = int(np.argmax(counts > budget))
    return over - 1 if counts[over] > budget else len(counts) - 1


def packed_steps(steps: np.ndarray) -> bytes:
    """Steps as bytes: the width of a step, 1 or, where one is beyond a byte, 4; then the steps as little-endian signed numbers."""
    small = steps.astype("<i1")
    return b"\x01" + small.tobytes() if np.array_equal(small, steps) else b"\x04" + steps.astype("<i4").tobytes()


def unpacked_counts(packed: bytes) -> np.ndarray:
    """Counts at every prefix, the empty one first, from packed steps."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(packed, f"<i{packed[0]}", offset=1), dtype=np.int64)])


def _count_pass(limit: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(name)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            n_tokens, fits, packed = [], [], []
            for part in counter.steps(texts):
                packed.append(packed_steps(np.frombuffer(part, "<i4")))
                counts = unpacked_counts(packed[-1])
                n_tokens.append(int(counts[-1]))
                fits.append(longest_within(counts, limit))
            columns = [
                batch.column(0),
                pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                pa.array(n_tokens, pa.int64()),
                pa.array(fits, pa.int64()),
                pa.array(packed, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "fits", "prefix_steps"])

    return run


def count_tokens(docs: DataFrame, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per input row: doc_id, n_bytes, n_tokens, over_limit, fits and prefix_steps.

    prefix_steps holds (see :func:`packed_steps`), for every code point of the text, the token count of the prefix that ends with it less that of the
    prefix before it; :func:`tokens_at` and :func:`cut_at` answer budget questions from it alone.  n_tokens is the count at the last
    prefix; fits is the length of the longest prefix of at most ``limit`` tokens that no shorter one exceeds.  Null texts are empty: 0 bytes, 0 tokens and no steps.
    Very long texts are read whole, as one array each.  Repeated rows and ids and null ids give rows of their own; an empty
    table gives no rows.  Other columns, whatever their names, are not read.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, fits long, prefix_steps binary"
    counted = text_rows(docs, id_col, text_col).mapInArrow(_count_pass(limit, vocabulary), schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _of_steps(answer, steps: str) -> Column:
    @F.pandas_udf("long")
    def run(packed: pd.Series) -> pd.Series:
        return packed.map(lambda p: answer(unpacked_counts(p)), na_action="ignore")

    return run(F.col(steps))


def tokens_at(chars: int, steps: str = "prefix_steps") -> Column:
    """Tokens of the prefix of so many code points (all of them where the text is shorter)."""
    return _of_steps(lambda counts: int(counts[min(chars, len(counts) - 1)]), steps)


def cut_at(budget: int, steps: str = "prefix_steps") -> Column:
    """Code points to keep for at most budget tokens, such that no shorter prefix has more."""
    return _of_steps(lambda counts: longest_within(counts, budget), steps)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: exact token counts of all documents, whole and at every prefix."""
    return count_tokens(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fits", "prefix_steps")
