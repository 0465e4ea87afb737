"""Tables and records out of crawled pages, feeds and labelled text, as column expressions.

Flat tables and labelled texts only: a row is what stands between its tags, a field what
stands after its label.  Pages are exploded to rows right after the scan and no page text
enters a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

# Marks of a challenge page.
CHALLENGE_MARKS = ("g-recaptcha", "hcaptcha", "cf-chl-captcha", "captcha-container", "captcha__container", "recaptcha", "checkbot")
CHALLENGE_TITLES = ("captcha", "проверка", "робот", "check bot")
ROW, CELL, HEAD = r"(?is)<tr[^>]*>(.*?)</tr>", r"(?is)<td[^>]*>(.*?)</td>", r"(?is)<th[^>]*>(.*?)</th>"
LINK = r"(?is)<a\b[^>]*?\b(?:href|data-href|routerlink)=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
#: Cells that stand for nothing.
BLANK_CELLS = ("-", "—", "–", "нет данных", "не указано")


def strip_tags(c: Column) -> Column:
    return t.collapse(F.regexp_replace(c, r"(?s)<[^>]*>", " "))


def cells(row: Column, pattern: str = CELL) -> Column:
    return F.transform(F.regexp_extract_all(row, F.lit(pattern), 1), strip_tags)


def table_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, row_no, cells) for every table row that has data cells."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(ROW), 1)).alias("row_no", "row"))
    return rows.select(key, "row_no", cells(F.col("row")).alias("cells")).where(F.size("cells") > 0)


def header_rows(pages: DataFrame, names: dict[str, str], key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows of tables with a header: name to header text; a cell is read where its header contains the text.

    The first row with header cells is the header.  A column that is missing, and a cell that stands for nothing, is ''.
    """
    heads = F.transform(F.regexp_extract_all(html, F.lit(HEAD), 1), lambda x: F.lower(strip_tags(x)))
    rows = pages.select(key, heads.alias("heads"), F.posexplode(F.regexp_extract_all(html, F.lit(ROW), 1)).alias("row_no", "row"))
    rows = rows.select(key, "row_no", "heads", cells(F.col("row")).alias("cells")).where(F.size("cells") > 0)

    def value(header: str) -> Column:
        at = F.array_position(F.transform("heads", lambda h: F.contains(h, F.lit(header))), True)
        cell = F.when(at > 0, F.get("cells", (at - 1).cast("int")))
        return F.when(F.lower(cell).isin(*BLANK_CELLS), "").otherwise(F.coalesce(cell, F.lit("")))

    return rows.select(key, "row_no", *[value(h).alias(n) for n, h in names.items()])


def cards(pages: DataFrame, mark: str, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, card_no, card): page parts from each opening mark to the next."""
    parts = F.split(html, mark)
    return pages.select(key, *keep, F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("card_no", "card"))


def links(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, link_no, target, label) for links with a target, also those in data attributes."""
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(LINK), 1).alias("t"), F.regexp_extract_all(html, F.lit(LINK), 2).alias("l"))
    rows = pages.select(key, *keep, F.posexplode(both).alias("link_no", "a"))
    return rows.select(key, *keep, "link_no", t.unescape(F.col("a.t")).alias("target"), strip_tags(F.col("a.l")).alias("label")).where("target <> ''")


def root(url: Column) -> Column:
    """Scheme and host of a url."""
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)


def absolute(target: Column, url: Column) -> Column:
    """A link's target against the page's url."""
    return against(target, root(url))


def against(target: Column, root: Column) -> Column:
    """A link's target against the root of the page's url."""
    return F.when(F.rlike(target, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), target).when(F.startswith(target, F.lit("//")), F.concat(F.lit("https:"), target)).when(F.startswith(target, F.lit("/")), F.concat(root, target)).otherwise(F.concat(root, F.lit("/"), target))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))


def challenge(html: Column) -> Column:
    """Whether a page asks for proof of a human: a mark anywhere or a word in its title."""
    low = F.lower(F.coalesce(html, F.lit("")))
    title = F.regexp_extract(low, r"(?s)<title[^>]*>(.*?)</title>", 1)
    return F.rlike(low, F.lit("|".join(CHALLENGE_MARKS))) | F.rlike(title, F.lit("|".join(CHALLENGE_TITLES)))


def listing_total(text: Column) -> Column:
    """The published number of results, from the first form that occurs."""
    forms = (r"(?iU)всего\s*:?\s*([\d\s]+)", r"(?iU)найдено\s*:?\s*([\d\s]+)", r"(?iU)\bиз\s+([\d\s]+)", r"(?iU)результатов\s*:?\s*([\d\s]+)")
    return F.coalesce(*[F.regexp_replace(F.regexp_extract(text, f, 1), r"(?U)\s", "").try_cast("int") for f in forms])


def labelled(text: Column, label: str, stops: tuple[str, ...] = ()) -> Column:
    """What stands after a label up to a stop label, a line break or the end; '' if absent."""
    ends = "|".join([*stops, "\\n", "$"])
    return F.trim(F.regexp_extract(text, rf"(?isU){label}\s*:?\s*(.*?)\s*(?:{ends})", 1))


def money(text: Column) -> Column:
    """The first positive amount in a text."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)(\d[\d\s ]*(?:[.,]\d{1,2})?)"), 1), t.number)
    return F.get(F.filter(found, lambda x: x > 0), 0)


def walk_stats(listing: DataFrame, walk: str, page: str, item: str) -> DataFrame:
    """Per page of a walk: rows, ids not on an earlier page, and whether the walk may stop there."""
    first = listing.groupBy(walk, item).agg(F.min(page).alias(page)).groupBy(walk, page).agg(F.count("*").alias("new_ids"))
    rows = listing.groupBy(walk, page).agg(F.count("*").alias("n_rows"))
    return rows.join(first, [walk, page], "left").select(walk, page, "n_rows", F.coalesce("new_ids", F.lit(0)).alias("new_ids")).withColumn("stop", F.col("new_ids") == 0)


def redact(text: Column) -> Column:
    """URL parameters and JSON-like values of sensitive keys masked, fragments dropped."""
    masked = F.regexp_replace(text, r"(?i)([?&](?:token|key|session|auth|password|utm_source)=)[^&#\s\"']*", "$1***")
    masked = F.regexp_replace(masked, r"(?i)(\"(?:token|cookie|authorization|password)\"\s*:\s*\")[^\"]*", "$1***")
    return F.regexp_replace(masked, r"(https?://[^\s#\"']*)#[^\s\"']*", "$1")


FEED_SCHEMA = "title string, link string, guid string, description string, pubDate string"


def feed_record(c: Column) -> Column:
    """(external_id, title, link, published_at) of a parsed feed item; the id is the first long number of its texts."""
    number = F.coalesce(*[F.nullif(F.regexp_extract(c[f], r"(\d{6,})", 1), F.lit("")) for f in ("link", "title", "guid", "description")])
    dated = F.regexp_extract(c["pubDate"], r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4})", 1)
    return F.struct(number.alias("external_id"), c["title"].alias("title"), c["link"].alias("link"), F.try_to_timestamp(dated, F.lit("d MMM yyyy HH:mm:ss Z")).alias("published_at"))


def feed(spark, path: str) -> DataFrame:
    """Items of RSS files."""
    items = spark.read.schema(FEED_SCHEMA).option("rowTag", "item").format("xml").load(path)
    return items.select(feed_record(F.struct("*")).alias("r")).select("r.*")


def feed_items(df: DataFrame, column: str) -> DataFrame:
    """Items of RSS texts in a column: one row per item, other columns kept."""
    rows = df.withColumn("_item", F.explode(F.regexp_extract_all(column, F.lit(r"(?is)<item\b[^>]*>.*?</item>"), 0))).drop(column)
    return rows.withColumn("_r", feed_record(F.from_xml("_item", FEED_SCHEMA))).select(*[c for c in rows.columns if c != "_item"], "_r.*")


def walk_stop(visits: DataFrame, listing: DataFrame, walk: str, page: str, item: str, page_size: int) -> DataFrame:
    """Where each walk ends: (walk, stop_page, reason, pages, items), pages counted from 0.

    ``visits`` has the pages that were read, ``listing`` their items.  A walk runs over its unbroken pages from the first on and ends at the first one after page 0 that is
    empty, shorter than ``page_size`` or without an item that no earlier page had; an empty page 0 ends it at once.  Later pages do not count.
    """
    numbered = visits.select(walk, page).distinct().withColumn("_island", F.col(page) - F.row_number().over(Window.partitionBy(walk).orderBy(page)))
    unbroken = numbered.where("_island = -1").drop("_island")
    rows = listing.groupBy(walk, page).agg(F.count("*").alias("_rows"))
    fresh = listing.groupBy(walk, item).agg(F.min(page).alias(page)).groupBy(walk, page).agg(F.count("*").alias("_new"))
    each = unbroken.join(rows, [walk, page], "left").join(fresh, [walk, page], "left").na.fill(0, ["_rows", "_new"])
    why = F.when(F.col("_rows") == 0, "empty").when((F.col(page) > 0) & (F.col("_rows") < page_size), "short").when((F.col(page) > 0) & (F.col("_new") == 0), "nothing new")
    marked = each.withColumn("_why", why).withColumn("_at", F.min(F.when(F.col("_why").isNotNull(), F.col(page))).over(Window.partitionBy(walk)))
    read = marked.where(F.col("_at").isNull() | (F.col(page) <= F.col("_at")))
    return read.groupBy(walk).agg(F.max(page).alias("stop_page"), F.coalesce(F.max_by("_why", page), F.lit("end")).alias("reason"), F.count("*").alias("pages"), F.sum("_new").alias("items"))
