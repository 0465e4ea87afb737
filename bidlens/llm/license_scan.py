"""License notices by an exact set-similarity join of text blocks with templates.

A block is a line, or a window of 10/9 of the template's length over all words of the text, so
that a notice may run over lines.  A template is found where at least 9/10 of its distinct words are in
the block.  Template words are ordered by their frequency over all lines, rarest first: a
block that reaches the threshold must hold one of the first n - t + 1, which, with the
blocks' length and the place of the first shared word in both, decides the candidates; they are
then verified exactly.  The filters take a whole text for its windows.  Beside that, the base phrases are counted where their words
stand consecutively.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Notices of widely used public licences, with the labels that this operator adds.
TEMPLATES = [
    ("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl-notice", "under the terms of the gnu lesser general public license"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-notice", "licensed under cc by 4 0"),
    ("cc-by-nc-notice", "licensed under cc by nc 4 0"),
    ("cc-by-sa-notice", "licensed under cc by sa 4 0"),
]
NUM, DEN = 9, 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spaced(text: Column, gap: str) -> Column:
    return F.trim(F.regexp_replace(text, SEPARATORS, gap))


def _count_words(spaced: Column) -> Column:
    """Words of a trimmed text with two blanks between words."""
    return F.when(spaced == "", 0).otherwise((F.length(spaced) - F.length(F.replace(spaced, F.lit("  "), F.lit("")))) / 2 + 1).cast("long")


def _literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _words(text: Column) -> Column:
    return F.split(_spaced(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), " "), " ")


def _met(blocks: DataFrame, index: DataFrame, vocabulary: list[str], first: list[str]) -> DataFrame:
    """Blocks (doc, words) with each template of which they hold t words."""
    known = blocks.withColumn("known", F.array_intersect(_literals(vocabulary), "words"))  # rarest first
    probes = known.withColumn("first", F.array_intersect("known", _literals(first))).where(F.size("first") > 0)
    return (
        probes.select("doc", "words", "known", F.explode("first").alias("word"))
        .join(F.broadcast(index), "word")
        # length filter; positional filter: what block and template still have from this word on, if it is the first they share
        .where((F.size("known") >= F.col("t")) & (F.least(F.size("known") - F.array_position("known", F.col("word")) + 1, F.col("n") - F.col("pos")) >= F.col("t")))
        .withColumn("shared", F.array_intersect("template", "known"))
        .where((F.get("shared", F.lit(0)) == F.col("word")) & (F.size("shared") >= F.col("t")))
    )


def scan_blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc, label, containment) for each template label that a block of the document reaches; best containment."""
    sets = [(label, list(dict.fromkeys(text.split())), len(text.split()) * DEN // NUM) for label, text in templates]
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    lines = texts.select("doc", F.explode(F.split("text", "\n")).alias("line")).select("doc", F.array_distinct(_words(F.col("line"))).alias("words"))
    used = sorted({w for _, ws, _ in sets for w in ws})
    counted = lines.select(F.explode(F.array_intersect("words", _literals(used))).alias("word")).groupBy("word").count()
    freq = {r["word"]: r["count"] for r in counted.collect()}  # at most the templates' vocabulary

    def rank(w: str) -> tuple[int, str]:
        return freq.get(w, 0), w

    rows = []
    for label, words, span in sets:
        ordered = sorted(words, key=rank)
        t = -(-NUM * len(ordered) // DEN)
        rows += [(label, w, i, len(ordered), t, span, ordered) for i, w in enumerate(ordered[: len(ordered) - t + 1]) if freq.get(w)]
    schema = "label string, word string, pos int, n int, t int, span int, template array<string>"
    index = docs.sparkSession.createDataFrame(rows, schema)
    vocabulary, first = sorted(used, key=rank), sorted({r[1] for r in rows})
    in_lines = _met(lines, index, vocabulary, first).select("doc", "label", "n", F.size("shared").alias("both"))
    starts = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.array_contains("template", F.get("words", i - 1)))
    best = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("words", i, F.col("span")), F.col("template")))))
    whole = texts.where(F.contains("text", F.lit("\n"))).select("doc", _words(F.col("text")).alias("words"))  # one line is a block already
    in_windows = _met(whole, index, vocabulary, first).select("doc", "label", "n", "t", best.alias("both")).where("both >= t").drop("t")
    return in_lines.unionByName(in_windows).groupBy("doc", "label").agg(F.max(F.col("both") / F.col("n")).alias("containment"))


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters and non-ASCII characters with A-Z lowered.  score is 1
    with a base phrase, else the best template containment, 0 without.  Null and empty
    texts have no words and no labels.  Rows that repeat an id share the labels found for it.  A very long text is
    one array of words; of equal scores any stands for the row, as the score alone is returned, and labels are distinct and sorted.  An
    empty table gives no rows.  Other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spaced = _spaced(F.translate("text", UPPER, LOWER), "  ")
    rows = rows.select("doc_id", spaced.alias("s")).select("doc_id", F.concat(F.lit(" "), "s", F.lit(" ")).alias("p"), _count_words(F.col("s")).alias("n_words"))
    found = []
    for phrase, label in PHRASES.items():
        k, mark = len(phrase.split()), f" {phrase.replace(' ', '  ')} "
        has = F.contains(F.col("p"), F.lit(mark))
        times = F.when(has, (F.length("p") - F.length(F.replace(F.col("p"), F.lit(mark), F.lit("")))) / len(mark)).otherwise(0).cast("long")
        before = _count_words(F.trim(F.substring_index("p", mark, 1)))
        after = _count_words(F.trim(F.substring_index("p", mark, -1)))
        found.append((times, F.when(has, before), F.when(has, F.col("n_words") - after - k), F.when(has, F.lit(label))))
    base = rows.select(
        "doc_id",
        "n_words",
        sum((f[0] for f in found[1:]), found[0][0]).alias("n_base"),
        F.least(*[f[1] for f in found]).alias("first_word"),
        F.greatest(*[f[2] for f in found]).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*[f[3] for f in found]))).alias("base"),
    )
    hits = scan_blocks(docs, id_col=id_col, text_col=text_col, templates=templates).where("doc is not null")
    by_doc = hits.groupBy(F.col("doc").cast("long").alias("doc_id")).agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))
    return base.join(by_doc, "doc_id", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: license mentions and notices in all documents."""
    return license_scan(documents(spark, sf_dir))


def _sql() -> str:
    def lit(words):
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places = []
    for phrase, label in PHRASES.items():
        ws = phrase.split()
        same = " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(ws, 1))
        places.append(f"list_transform(list_filter(range(len(w) - {len(ws) - 1}), lambda i: {same}), lambda i: {{'at': i, 'label': '{label}'}})")
    sets = [(label, list(dict.fromkeys(text.split()))) for label, text in TEMPLATES]
    cases = ", ".join(f"{{'label': '{label}', 'both': len(list_intersect(bw, {lit(ws)})), 'n': {len(ws)}}}" for label, ws in sets)
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
x AS (SELECT doc_id, w, list_concat({", ".join(places[:2])}) AS p1, list_concat({", ".join(places[2:])}) AS p2
      FROM (SELECT doc_id, regexp_extract_all(t, '{word}') AS w FROM d)),
y AS (SELECT doc_id, len(w)::BIGINT AS n_words, list_concat(p1, p2) AS p FROM x),
b AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{word}')) AS bw FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
c AS (SELECT doc_id, unnest([{cases}]) AS c FROM b),
h AS (SELECT doc_id, list(DISTINCT c.label) AS own, max(c.both / c.n) AS best FROM c WHERE {DEN} * c.both >= {NUM} * c.n GROUP BY doc_id)
SELECT y.doc_id, n_words, len(p)::BIGINT AS n_base,
       list_min(list_transform(p, lambda q: q.at))::BIGINT AS first_word, list_max(list_transform(p, lambda q: q.at))::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(p, lambda q: q.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda q: q.label), coalesce(own, [])))), ',') AS labels,
       CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM y LEFT JOIN h ON y.doc_id = h.doc_id
"""


OP6_SQL = _sql()
