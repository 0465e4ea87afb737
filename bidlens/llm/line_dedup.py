"""Boilerplate lines by their frequency within a site.

A line is boilerplate on a host when the pages of the host that contain it, divided by all
pages of the host, exceed a ratio.  DataFrame functions only.  Line hashes are counted with map-side combine, and the
boilerplate lines of a host - at most (lines a page) / ratio of them - come back as one array a host: by broadcast where all
of them are few, else by broadcast for the hosts with most pages, of which there are at most HOT, and by a shuffle on the host for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_sized, materialize, unused

RATIO, LEAST_PAGES = 0.05, 5
#: Boilerplate lines, all hosts together, that may be broadcast (about 8 bytes each).
BROADCAST_LINES = 500_000
#: A host with one in so many of all pages is joined by broadcast, so that its pages are no single group.
HOT = 2_000
#: White space that is trimmed from lines.
SPACE = " \t\r\x0b\x0c"

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"
UNSEEN = r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->"
BREAKS = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|article|nav|footer|header|section|tr|table|title|head|body|html)\b[^>]*>"
TAG = r"<[^>]*>"
BLANKS = r"[ \t\r]+"


def page_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def page_text(html: Column) -> Column:
    """Visible text of a page, block elements on lines of their own."""
    text = F.regexp_replace(html, UNSEEN, " ")
    text = F.regexp_replace(text, BREAKS, "\n")
    return F.regexp_replace(F.regexp_replace(text, TAG, ""), BLANKS, " ")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def drop_boilerplate(
    pages: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, page_class: DataFrame | None = None, id_col: str = "doc_id"
) -> DataFrame:
    """pages with boilerplate lines cut from text_col, and n_lines, n_dropped: non-blank lines before, and cut.

    Lines are compared without the white space around them; blank lines stay.  A line is boilerplate on at least least_pages pages of
    its host: on a host with fewer pages no share tells a repeated line from a page's own.
    page_class, a table of id_col and class, makes the pages of a host in one class count as one page, so that an article
    with many copies or near copies is not taken for boilerplate; a page without a class counts alone, equal texts as one.  Rows with a null host form one host; a null text
    stays null with no lines, an empty one empty.  A very long text's line hashes are one array.  Repeated rows are pages of their own.  An empty table stays
    empty.  All other columns, whatever their names, pass unchanged, and n_lines and n_dropped replace columns of these names.
    """
    kept_columns = [c for c in pages.columns if c.lower() not in ("n_lines", "n_dropped")]
    pages = pages.select(*[f"`{c}`" for c in kept_columns])
    lines = F.split(F.col(f"`{text_col}`"), "\n")
    said = F.filter(lines, lambda x: _trimmed(x) != "")
    hashes = F.transform(said, lambda x: F.xxhash64(_trimmed(x)))
    host = F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit(""))
    if page_class is None:
        seen = pages.select(host.alias("host"), F.array_distinct(hashes).alias("lines"))
    else:
        ids = page_class.select(F.col(id_col).alias("id"), F.col("class").cast("string").alias("class")).where("id is not null").groupBy("id").agg(F.min("class").alias("class"))
        seen = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), F.array_distinct(hashes).alias("lines"), F.xxhash64(f"`{text_col}`").cast("string").alias("page"))
        seen = seen.join(ids, "id", "left").select("host", "lines", F.coalesce(F.concat(F.lit("c"), "class"), "page").alias("page"))
    totals = seen.groupBy("host").agg((F.count("*") if page_class is None else F.countDistinct("page")).alias("pages"))
    each = seen.select("host", F.explode("lines").alias("line"), *([] if page_class is None else ["page"]))
    counts = (each if page_class is None else each.distinct()).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    bad = counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    bad = materialize(bad.groupBy("host").agg(F.collect_list("line").alias("lines"), F.count("*").alias("k"), F.max("pages").alias("pages")), "boilerplate")
    size = bad.agg(F.sum("k").alias("k")).first()["k"] or 0
    keys = unused(pages, "host_key", "bad_hot", "bad_cold", "key_cold", "salt", "cut", "n_lines_", "after")
    key, hot_lines, cold_lines, cold_key, salt, cut, before, after = keys
    least = 0 if size <= BROADCAST_LINES else totals.agg(F.sum("pages")).first()[0] / HOT
    hot = bad.where(F.col("pages") >= least).select(F.col("host").alias(key), F.col("lines").alias(hot_lines))
    joined = pages.join(F.broadcast(hot), host == F.col(key), "left")
    if least:
        # pages that have their lines already keep away from the shuffle's keys
        cold = bad.where(F.col("pages") < least).select(F.col("host").alias(cold_key), F.lit(-1).cast("long").alias(salt), F.col("lines").alias(cold_lines))
        mine = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(f"`{text_col}`"), F.lit(1_000_003))).cast("long")
        joined = joined.join(cold, (host == F.col(cold_key)) & (mine == F.col(salt)), "left")
    else:
        joined = joined.withColumn(cold_lines, F.lit(None).cast("array<bigint>"))
    # what a page has of its host's lines is found by hashing; only these few are looked up line by line
    joined = joined.withColumn(cut, F.array_intersect(hashes, F.coalesce(hot_lines, cold_lines)))
    clean = F.filter(lines, lambda x: (_trimmed(x) == "") | ~F.array_contains(F.col(cut), F.xxhash64(_trimmed(x))))
    changed = F.size(F.coalesce(F.col(cut), F.array().cast("array<bigint>"))) > 0
    n_said = F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(F.size(said)).cast("long")
    joined = joined.withColumn(after, F.when(changed, F.array_join(clean, "\n")).otherwise(F.col(f"`{text_col}`"))).withColumn(before, n_said)
    gone = F.when(changed, F.col(before) - F.size(F.filter(F.split(F.col(after), "\n"), lambda x: _trimmed(x) != ""))).otherwise(0).cast("long")
    out = [F.col(after).alias(c) if c == text_col else F.col(f"`{c}`") for c in kept_columns]
    return joined.select(*out, F.col(before).alias("n_lines"), gone.alias("n_dropped"))


def near_pages(pages: DataFrame, *, host_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, class) of the pages most of whose text, by characters, stands in lines that other pages of their host have too; class is the rarest such line.

    Near copies of a text leave most lines alone and share their rarest one but for the copies that changed it, so a group of any size has a few classes; a page
    with a menu and a text of its own has none.  Rows with a null id, and null and empty texts, have no class; rows that repeat an id are one page.
    An empty table has none.
    """
    said = F.filter(F.transform(F.split(F.col(f"`{text_col}`"), "\n"), _trimmed), lambda x: x != "")
    each = F.array_distinct(F.transform(said, lambda x: F.struct(F.xxhash64(x).alias("line"), F.length(x).alias("size"))))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host"), each.alias("each")).where("id is not null")
    lines = rows.select("id", "host", F.explode("each").alias("x")).select("id", "host", "x.line", "x.size")
    counts = materialize(lines.groupBy("host", "line").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = join_sized(lines, counts, ["host", "line"], "n", total).groupBy("id").agg(F.sum("size").alias("shared"), F.min(F.struct("n", "line"))["line"].alias("class"))
    whole = rows.groupBy("id").agg(F.sum(F.aggregate("each", F.lit(0).cast("long"), lambda a, x: a + x["size"])).alias("size"))
    return shared.join(whole, "id").where("2 * shared >= size").select(F.col("id").alias(id_col), "class")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every page's text without its host's boilerplate."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", page_host(F.col("url")).alias("host"), page_text(F.col("html")).alias("text"))
    return drop_boilerplate(pages, host_col="host").select("page_id", "host", "text", "n_lines", "n_dropped")


_SPACE_SQL = " || ".join(f"chr({ord(c)})" for c in SPACE)
OP4_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '{HOST}', 1)), '') AS host, url IS NULL AS no_host,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{UNSEEN}', ' ', 'g'), '{BREAKS}', chr(10), 'g'), '{TAG}', '', 'g'), '{BLANKS}', ' ', 'g') AS text
  FROM pages),
l AS (SELECT page_id, host, string_split(text, chr(10)) AS lines FROM p),
e AS (SELECT page_id, host, unnest(list_distinct(list_transform(list_filter(lines, lambda x: trim(x, {_SPACE_SQL}) <> ''), lambda x: trim(x, {_SPACE_SQL})))) AS line FROM l),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (SELECT e.host, line FROM e JOIN t ON e.host = t.host GROUP BY e.host, line, pages
      HAVING count(*) >= {LEAST_PAGES} AND count(*) > {RATIO} * pages),
g AS (SELECT host, list(line) AS bad FROM b GROUP BY host)
SELECT p.page_id, CASE WHEN no_host THEN NULL ELSE p.host END AS host,
       CASE WHEN bad IS NULL THEN p.text ELSE array_to_string(list_filter(lines, lambda x: trim(x, {_SPACE_SQL}) = '' OR NOT list_contains(bad, trim(x, {_SPACE_SQL}))), chr(10)) END AS text,
       coalesce(len(list_filter(lines, lambda x: trim(x, {_SPACE_SQL}) <> '')), 0)::BIGINT AS n_lines,
       coalesce(len(list_filter(lines, lambda x: trim(x, {_SPACE_SQL}) <> '' AND coalesce(list_contains(bad, trim(x, {_SPACE_SQL})), false))), 0)::BIGINT AS n_dropped
FROM p JOIN l ON p.page_id = l.page_id LEFT JOIN g ON p.host = g.host
"""
