"""Rows that every operator has to bear."""

#: Ordinary words, and then the long runs that patterns may stumble over: labels of a host, quote marks, digits, a JSON text.
RUNS = ["a@b" + ".c" * 200_000, ">" * 200_000, "> " * 100_000, "7" * 100_000, '{"k":"' + "v" * 200_000 + '\\"' * 50_000 + '"}']
LONG = " ".join(f"word{i} and more" for i in range(20_000)) + "\n" + "\n".join(RUNS)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, salt string, lo long, score double"
#: More names that operators might use for themselves.
CLASHING = ["_host", "_left", "_bad", "_found", "_late", "_rank", "_id", "_digest", "c", "t", "k", "h", "class", "page", "host_key", "found", "after", "held", "row", "key", "root", "gram", "n_lines", "thread", "length"]


def odd_rows(spark, texts=()):
    """Nulls in any column, empty and long texts, repeated rows and ids, and extra columns whose names operators use."""
    plain = [
        (1, "one two three four five six seven", "en", "a", 33),
        (1, "one two three four five six seven", "en", "a", 33),
        (2, "one two three four five six seven", "en", None, 33),
        (3, "", None, "a", 0),
        (4, None, None, None, None),
        (None, "one two three four five six seven", "en", "a", None),
        (5, " \n\t ", "en", "b", 4),
        (6, LONG, "en", "b", len(LONG)),
        (7, "short", "en", "b", 5),
    ]
    rows = plain + [(100 + i, t, "en", "c", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "x", 5, 0.5) for r in rows], SCHEMA)
    return df.selectExpr("*", *[f"'mine' AS `{c}`" for c in CLASHING])


def empty_rows(spark):
    return spark.createDataFrame([], SCHEMA).selectExpr("*", *[f"'mine' AS `{c}`" for c in CLASHING])
