"""Queries on extraction: pages are written from the given tables, and the fields have to come back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..operators import containers as box
from ..operators import extract as x
from ..operators import messages as m
from ..operators import normalize as norm
from ..sources.tables import WITH, spread, table, tenders
from .registry import query

def _order_rows(spark, sf_dir):
    return spread(table(spark, sf_dir, "orders")).withColumn("day", F.date_format("o_orderdate", "dd.MM.yyyy")).withColumn("amount", F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string"))


def _pages(spark, sf_dir, row: str, head: str = "", tail: str = ""):
    """A page of an order, a row of a customer's listing."""
    rows = _order_rows(spark, sf_dir).selectExpr("o_custkey AS page_id", "'https://zakupki.example/epz/search' AS url", f"{row} AS row")
    return rows.select("page_id", "url", F.concat(F.lit(head), "row", F.lit(tail)).alias("html"))


_TABLE_ROW = """concat('<tr class="r"><td><a href="/market/?id=', CAST(o_orderkey AS STRING), '">№ ', CAST(o_orderkey AS STRING), '</a></td><td>&laquo;', o_orderpriority, '&raquo;</td><td> ', day, ' 10:15 </td><td>', amount, '&nbsp;руб.</td></tr>')"""
_HEAD = "<html><table><tr><th>Номер процедуры</th><th>Заказчик</th><th>Дата публикации</th><th>Начальная цена</th></tr>"


@query("extract_table_rows", "SELECT o_custkey AS page_id, CAST(o_orderkey AS VARCHAR) AS external_id, '«' || o_orderpriority || '»' AS customer, o_orderdate + INTERVAL 435 MINUTE AS published_at, round(o_totalprice, 2) AS price FROM orders")
def extract_table_rows(spark, sf_dir):
    rows = x.table_rows(_pages(spark, sf_dir, _TABLE_ROW, _HEAD, "</table></html>"))
    cell = lambda i: F.get("cells", i)
    return rows.select("page_id", F.regexp_extract(cell(0), r"(\d+)", 1).alias("external_id"), cell(1).alias("customer"), t.dotted_time(cell(2), "+03:00").alias("published_at"), x.money(cell(3)).alias("price"))


@query("extract_header_table", "SELECT o_custkey AS page_id, '№ ' || CAST(o_orderkey AS VARCHAR) AS number, '«' || o_orderpriority || '»' AS customer, '' AS region FROM orders")
def extract_header_table(spark, sf_dir):
    rows = x.header_rows(_pages(spark, sf_dir, _TABLE_ROW, _HEAD, "</table></html>"), {"number": "номер", "customer": "заказчик", "region": "регион"})
    return rows.select("page_id", "number", "customer", "region")


@query("extract_positional_table", "SELECT o_custkey AS page_id, CAST(o_orderkey AS VARCHAR) AS external_id, CAST(o_custkey AS VARCHAR) AS lot, o_orderpriority AS title FROM orders")
def extract_positional_table(spark, sf_dir):
    row = "concat('<tr><td>', CAST(o_orderkey AS STRING), ' (', CAST(o_custkey AS STRING), ')</td><td>Стадия: ', o_orderpriority, '</td></tr>')"
    rows = x.table_rows(_pages(spark, sf_dir, row))
    number = F.get("cells", 0)
    part = lambda i: F.regexp_extract(number, r"^(\d+)\s*\((\d+)\)", i)
    return rows.select("page_id", part(1).alias("external_id"), part(2).alias("lot"), F.regexp_replace(F.get("cells", 1), r"(?iU)^стадия\s*:\s*", "").alias("title"))


_SOON = "CAST(year(o_orderdate) + 20 AS STRING)"
_DAY20 = f"concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '.', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '.', {_SOON})"
_AT20 = "make_timestamp(year(o_orderdate) + 20, month(o_orderdate), day(o_orderdate), {}, {}, 0)"
_PROCEDURE = "CASE o_orderkey % 3 WHEN 0 THEN 'Электронный аукцион' WHEN 1 THEN 'Запрос предложений' ELSE '' END"
_CARD = f"""concat('<div class="registry-entry"><span>', CASE o_orderkey % 2 WHEN 0 THEN '44-ФЗ ' ELSE '223-ФЗ ' END, {_PROCEDURE}, '</span> <b>', CASE o_orderstatus WHEN 'F' THEN 'Контракт исполнен' ELSE 'Подача заявок' END, '</b>',
  CASE WHEN o_orderkey % 5 = 0 THEN concat('<i>№ ', lpad(CAST(o_orderkey AS STRING), 19, '3'), '</i>') ELSE concat('<a href="/help">Справка</a><a href="/epz/order/notice/view?x=1&amp;regNumber=', lpad(CAST(o_orderkey AS STRING), 11, '0'), '">№ x</a>') END,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('<div>Объект закупки</div><div>', o_orderpriority, ' &amp; Co</div>') END, '<div>Заказчик: ООО Вектор ', CAST(o_custkey AS STRING), '</div><div>Регион: Тверская область</div><div>Начальная цена ', amount, ' ₽</div><div>Размещено ', {_DAY20}, '</div><div>Окончание подачи заявок ', {_DAY20}, ' 09:30</div></div>')"""
_CARD_ID = "CASE WHEN o_orderkey % 5 = 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 19, '3') ELSE lpad(CAST(o_orderkey AS VARCHAR), 11, '0') END"


@query(
    "extract_cards",
    f"""SELECT o_custkey AS page_id, {_CARD_ID} AS external_id, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'https://zakupki.example/epz/order/notice/view?x=1&regNumber=' || {_CARD_ID} END AS url, CASE WHEN o_orderkey % 7 = 0 THEN 'Закупка ' || {_CARD_ID} ELSE o_orderpriority || ' & Co' END AS title, round(o_totalprice, 2) AS price,
    'ООО Вектор ' || o_custkey AS customer, {_AT20.format(12, 0)} AS published_at, {_AT20.format(9, 30)} AS deadline, 'Тверская область' AS region, CASE o_orderkey % 2 WHEN 0 THEN '44-ФЗ' ELSE '223-ФЗ' END AS law_type, {_PROCEDURE} AS procurement_method,
    CASE o_orderstatus WHEN 'F' THEN 'Контракт исполнен' ELSE 'Подача заявок' END AS status FROM orders""",
)
def extract_cards(spark, sf_dir):
    cards = x.cards(_pages(spark, sf_dir, _CARD), '<div class="registry-entry">', keep=("url",))
    return box.registry_cards(cards.drop("card_no"))


_LISTING = f"""concat('<html><body><div class="page"><h1>Результаты поиска</h1><div class="outer CARD"><h3>Поставка муфт ', o_orderpriority, '</h3>Опубликовано ', {_DAY20}, ' 10:15 <a class="t" href="/tender-', lpad(CAST(o_orderkey AS STRING), 7, '1'), '/">Тендер</a> Заказчик: ООО ', o_orderpriority, '; цена ', amount, ' руб.',
  '<ul><li>Размещено ', {_DAY20}, '<p>до ', {_DAY20}, ' 17:00</p><a href="/procedure-', lpad(CAST(o_custkey AS STRING), 8, '2'), '?a=1&amp;b=2">Насосы ', o_orderpriority, '</a></ul>',
  '<table><tr><td><b>x</b></td><td><a href="/tender-', lpad(CAST(o_orderkey AS STRING), 7, '1'), '/again">Повтор</a></td></tr></table></div><a href="https://other.example/tender-7777777/">чужой</a><a href="/news/8888888/">новость</a><script>var a = "<a href=/tender-9999999>x</a>";</script><!-- <a href="/tender-6666666">y</a> --></body></html>') AS html"""
_MOSCOW = "timezone('UTC', timezone('Europe/Moscow', {}))"


@query(
    "extract_container_links",
    f"""WITH o AS (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) AS amount FROM orders)
    SELECT o_orderkey AS page_id, lpad(o_orderkey::VARCHAR, 7, '1') AS external_id, 'https://www.b2b.example/tender-' || lpad(o_orderkey::VARCHAR, 7, '1') || '/' AS url, 'Поставка муфт ' || o_orderpriority AS title,
    'Поставка муфт ' || o_orderpriority || ' Опубликовано ' || {_DAY20} || ' 10:15 Тендер Заказчик: ООО ' || o_orderpriority || '; цена ' || amount || ' руб. Размещено ' || {_DAY20} || ' до ' || {_DAY20} || ' 17:00 Насосы ' || o_orderpriority || ' x Повтор' AS description,
    {_MOSCOW.format(_AT20.format(10, 15))} AS published_at, {_MOSCOW.format(_AT20.format(17, 0))} AS deadline, round(o_totalprice, 2) AS price, 'ООО ' || o_orderpriority AS customer FROM o
    UNION ALL SELECT o_orderkey, lpad(o_custkey::VARCHAR, 8, '2'), 'https://www.b2b.example/procedure-' || lpad(o_custkey::VARCHAR, 8, '2') || '?a=1&b=2', 'Насосы ' || o_orderpriority, 'Размещено ' || {_DAY20} || ' до ' || {_DAY20} || ' 17:00 Насосы ' || o_orderpriority,
    {_MOSCOW.format(_AT20.format(0, 0))}, {_MOSCOW.format(_AT20.format(17, 0))}, NULL, '' FROM o""",
)
def extract_container_links(spark, sf_dir):
    """Nested cards: each procedure with the text and the dates of its own container, the first link of an id."""
    pages = _order_rows(spark, sf_dir).selectExpr("o_orderkey AS page_id", "'https://www.b2b.example/market/' AS url", _LISTING)
    return box.listed_cards(pages)


_NAV = """concat('<ul><li><a href="/lot/purchase/', lpad(CAST(o_orderkey AS STRING), 7, '3'), '">', o_orderpriority, ' &amp; Co</a></li><li><span data-href="lots/', lpad(CAST(o_custkey AS STRING), 6, '5'), '/"><b>Лот</b> ', o_orderpriority, '</span></li>',
  '<li>Аукцион ', o_orderpriority, " <button onclick=\\"window.location.href = '/auction/", lpad(CAST(o_orderkey AS STRING), 8, '4'), "';\\">ok</button></li>", '<li><a href="#top">Наверх страницы</a><a href="javascript:go(1234567)">Дальше по списку</a><a href="/about">О площадке</a></li>',
  '<li><a href="https://else.example/purchase/1234567">Чужая закупка</a><a data-routerlink="/again/tender/', lpad(CAST(o_orderkey AS STRING), 7, '3'), '">Повтор закупки</a></li></ul>') AS html"""


@query(
    "extract_page_links",
    """SELECT o_orderkey AS page_id, lpad(o_orderkey::VARCHAR, 7, '3') AS external_id, 'https://rts.example/lot/purchase/' || lpad(o_orderkey::VARCHAR, 7, '3') AS url, o_orderpriority || ' & Co' AS title FROM orders
    UNION ALL SELECT o_orderkey, lpad(o_custkey::VARCHAR, 6, '5'), 'https://rts.example/lots/' || lpad(o_custkey::VARCHAR, 6, '5') || '/', 'Лот ' || o_orderpriority FROM orders
    UNION ALL SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 8, '4'), 'https://rts.example/auction/' || lpad(o_orderkey::VARCHAR, 8, '4'), 'Аукцион ' || o_orderpriority || ' ok' FROM orders""",
)
def extract_page_links(spark, sf_dir):
    """Procedures behind links, data attributes and click handlers of a page's own host."""
    pages = _order_rows(spark, sf_dir).selectExpr("o_orderkey AS page_id", "'https://rts.example/search' AS url", _NAV)
    return box.listed_links(pages)


_SQL_LINKS = r"""unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\b(?:href|data-href|routerlink)=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1))"""


@query("extract_links", f"SELECT page_id, count(*) AS n, count(DISTINCT target) AS targets FROM (SELECT page_id, {_SQL_LINKS} AS target FROM pages) WHERE target <> '' GROUP BY 1")
def extract_links(spark, sf_dir):
    rows = x.links(table(spark, sf_dir, "pages").select("page_id", "html"))
    each = rows.groupBy("page_id", "target").agg(F.count("*").alias("n"))
    return each.groupBy("page_id").agg(F.sum("n").alias("n"), F.count("*").alias("targets"))


@query(
    "extract_nav_links",
    f"SELECT page_id, 'x' AS kind, count(*) AS n FROM (SELECT page_id, {_SQL_LINKS} AS target FROM pages) WHERE target LIKE '/%' AND length(target) >= 6 GROUP BY 1",
)
def extract_nav_links(spark, sf_dir):
    rows = x.links(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=("url",))
    same = x.host(x.absolute(F.col("target"), F.col("url"))) == x.host(F.col("url"))
    return rows.where(same & F.startswith("target", F.lit("/")) & (F.length("target") >= 6)).groupBy("page_id").agg(F.first(F.lit("x")).alias("kind"), F.count("*").alias("n"))


@query("extract_details", "SELECT o_orderkey, 'ООО ' || o_orderpriority AS customer, 'Тверская область' AS region, round(o_totalprice, 2) AS price, o_orderdate + INTERVAL 6 HOUR AS deadline FROM orders")
def extract_details(spark, sf_dir):
    page = "concat('<div>Заказчик: ООО ', o_orderpriority, '</div><div>Регион поставки: Тверская область</div><div>НМЦК: ', amount, ' руб.</div><div>Окончание подачи заявок ', day, ' 09:00</div>')"
    rows = _order_rows(spark, sf_dir).selectExpr("o_orderkey", f"{page} AS html").withColumn("txt", x.strip_tags(F.col("html")))
    return rows.select(
        "o_orderkey",
        x.labelled(F.col("txt"), "Заказчик", ("Регион",)).alias("customer"),
        x.labelled(F.col("txt"), "Регион поставки", ("НМЦК",)).alias("region"),
        x.money(x.labelled(F.col("txt"), "НМЦК", ("руб",))).alias("price"),
        t.dotted_time(x.labelled(F.col("txt"), "Окончание подачи заявок"), "+03:00").alias("deadline"),
    )


@query("recover_details", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'есть' ELSE 'Тверская область' END AS region, CASE WHEN o_orderkey % 3 = 0 THEN '7701234567' ELSE '' END AS customer_inn FROM orders")
def recover_details(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN 'есть' ELSE ' ' END AS region", "CASE WHEN o_orderkey % 3 = 0 THEN 'Регион: Тверская область\nИНН: 77 01 23 45 67' ELSE 'Регион: Тверская область\nИНН нет' END AS txt")
    return rows.select("o_orderkey", F.coalesce(t.blank_to_null(F.col("region")), x.labelled(F.col("txt"), "Регион")).alias("region"), t.labelled_tax_id(F.col("txt")).alias("customer_inn"))


@query("detail_url_lookup", "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS part FROM lineitem GROUP BY 1")
def detail_url_lookup(spark, sf_dir):
    """The first address listed for an id."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("https://p.example/"), F.col("l_partkey").cast("string")).alias("url"), F.struct("l_linenumber", "l_partkey").alias("place"))
    best = rows.groupBy("l_orderkey").agg(F.min_by("url", "place").alias("url"))
    return best.select("l_orderkey", F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("part"))


@query("classify_challenge", "SELECT page_id, page_id % 7 = 0 OR page_id % 11 = 0 AS blocked FROM pages")
def classify_challenge(spark, sf_dir):
    made = F.expr("CASE WHEN page_id % 7 = 0 THEN concat(html, '<div class=\"G-reCAPTCHA\">') WHEN page_id % 11 = 0 THEN replace(html, '<title>', '<title>Проверка: ') ELSE html END")
    return table(spark, sf_dir, "pages").select("page_id", x.challenge(made).alias("blocked"))


@query("listing_totals", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (1000 + o_orderkey % 9000)::INT WHEN 1 THEN (o_orderkey % 100)::INT END AS total FROM orders")
def listing_totals(spark, sf_dir):
    txt = F.expr("CASE o_orderkey % 3 WHEN 0 THEN concat('ВСЕГО: ', replace(format_number(1000 + o_orderkey % 9000, 0), ',', ' '), ' процедур') WHEN 1 THEN concat('показано 1-20 из ', CAST(o_orderkey % 100 AS STRING)) ELSE 'пусто' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", x.listing_total(txt).alias("total"))


@query(
    "page_walk_stats",
    """WITH r AS (SELECT o_custkey % 100 AS walk, (o_orderkey % 8)::BIGINT AS page, (o_orderkey * 7) % 400 AS item FROM orders), f AS (SELECT walk, item, min(page) AS page FROM r GROUP BY 1, 2),
    n AS (SELECT walk, page, count(*) AS new_ids FROM f GROUP BY 1, 2) SELECT r.walk, r.page, count(*) AS n_rows, coalesce(max(new_ids), 0) AS new_ids, coalesce(max(new_ids), 0) = 0 AS stop
    FROM r LEFT JOIN n ON r.walk = n.walk AND r.page = n.page GROUP BY 1, 2""",
)
def page_walk_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey % 100 AS walk", "o_orderkey % 8 AS page", "(o_orderkey * 7) % 400 AS item")
    return x.walk_stats(rows, "walk", "page", "item")


@query("extract_index_listing", "SELECT o_orderkey, 'index' AS found_by FROM orders WHERE o_orderkey % 3 < 2")
def extract_index_listing(spark, sf_dir):
    txt = "CASE o_orderkey % 3 WHEN 0 THEN '44-ФЗ аукцион' WHEN 1 THEN 'по 223 ФЗ' ELSE 'коммерческая' END"
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{txt} AS txt")
    return rows.where(F.rlike("txt", F.lit(r"(?iU)\b(44|223)\s*-?\s*фз\b"))).select("o_orderkey", F.lit("index").alias("found_by"))


@query("redact_text", r"""SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '(?i)([?&](?:token|key|session|auth|password|utm_source)=)[^&#\s"'']*', '\1***', 'g') AS url FROM pages""")
def redact_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", x.redact(F.concat("url", F.lit("#top"))).alias("url"))


@query("page_titles", "SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title, lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS host FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("title"), x.host(F.col("url")).alias("host"))


@query("render_alerts", "SELECT o_orderkey, '<b>' || replace(o_orderpriority, '&', '&amp;') || '</b> ' || strftime(o_orderdate, '%d.%m.%Y') AS message FROM orders")
def render_alerts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("<b>"), t.escape_html(F.col("o_orderpriority")), F.lit("</b> "), F.date_format("o_orderdate", "dd.MM.yyyy")).alias("message"))


@query("render_results", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS k FROM orders")
def render_results(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", k.alias("k"))


@query(
    "build_prompts",
    "SELECT o_orderkey, concat_ws(chr(10), 'Название: ' || o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 'Данные неполные' END, 'Статус: ' || o_orderstatus) AS prompt FROM orders",
)
def build_prompts(spark, sf_dir):
    lines = [F.concat(F.lit("Название: "), "o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, "Данные неполные"), F.concat(F.lit("Статус: "), "o_orderstatus")]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("\n", *lines).alias("prompt"))


@query("parse_profiles", "SELECT c_custkey, [lower(c_mktsegment), 'два'] AS keywords, round(c_acctbal, 2) AS min_price FROM customer")
def parse_profiles(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lower("c_mktsegment"), F.lit(" , , два,")).alias("kw"), F.replace(F.format_number("c_acctbal", 2), F.lit(","), F.lit(" ")).alias("low"))
    kw = F.filter(F.transform(F.split("kw", ","), lambda v: F.trim(v)), lambda v: v != "")
    return rows.select("c_custkey", kw.alias("keywords"), t.number(F.replace("low", F.lit("."), F.lit(","))).alias("min_price"))


@query("clean_list", "SELECT c_custkey, [trim(c_mktsegment), 'VIP'] AS items FROM customer")
def clean_list(spark, sf_dir):
    items = F.array(F.concat(F.lit(" "), "c_mktsegment"), F.lit("VIP"), F.lower("c_mktsegment"), F.lit("vip "), F.lit(""))
    return table(spark, sf_dir, "customer").select("c_custkey", t.clean_list(items).alias("items"))


@query("restore_documents", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'нет' END AS name, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS n FROM customer")
def restore_documents(spark, sf_dir):
    packed = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('[{"name":" '), "c_name", F.lit(' ","url":""}]'))).otherwise("{broken")
    docs = F.coalesce(F.from_json(packed, "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    clean = F.transform(docs, lambda d: F.map_filter(F.transform_values(d, lambda _, v: F.trim(v)), lambda _, v: v != ""))
    rows = table(spark, sf_dir, "customer").select("c_custkey", clean.alias("d"))
    return rows.select("c_custkey", F.coalesce(F.get("d", 0)["name"], F.lit("нет")).alias("name"), F.size("d").alias("n"))


@query("scan_feed", "SELECT o_custkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '9') AS external_id, o_orderpriority AS title, o_orderdate - INTERVAL 3 HOUR AS published_at FROM orders")
def scan_feed(spark, sf_dir):
    item = "concat('<item><title>', o_orderpriority, '</title><link>https://x.example/notice?regNumber=', lpad(CAST(o_orderkey AS STRING), 8, '9'), '</link><pubDate>Fri, ', date_format(o_orderdate, 'd MMM yyyy'), ' 00:00:00 +0300</pubDate></item>')"
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey", f"concat('<rss><channel>', {item}, '</channel></rss>') AS xml")
    return x.feed_items(rows, "xml").select("o_custkey", "external_id", "title", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


#: Walks over listings: customers read pages 0 to 6, some of which are missing, empty or short, or bring what was there before.
_WALK = "o_custkey % 60 AS walk, CAST((o_orderkey * 31) % 7 AS INT) AS page, (o_orderkey * 7) % (20 + o_custkey % 60) AS item"
_VISITS = "SELECT DISTINCT o_custkey % 60 AS walk, p AS page FROM orders, (SELECT unnest(generate_series(0, 6))::INT AS p) WHERE (o_custkey % 60) % 9 <> p + 1"


@query(
    "page_walk_stop",
    f"""WITH v AS ({_VISITS}), r AS (SELECT {_WALK} FROM orders WHERE NOT ((o_custkey % 60) % 4 = 0 AND (o_orderkey * 31) % 7 = (o_custkey % 60) % 5)),
    u AS (SELECT walk, page FROM v a WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(generate_series(0, 6))::INT AS p) g WHERE g.p < a.page AND NOT EXISTS (SELECT 1 FROM v b WHERE b.walk = a.walk AND b.page = g.p))),
    x AS (SELECT u.walk, u.page, (SELECT count(*) FROM r WHERE r.walk = u.walk AND r.page = u.page) AS n, (SELECT count(DISTINCT item) FROM r WHERE r.walk = u.walk AND r.page = u.page AND NOT EXISTS (SELECT 1 FROM r q WHERE q.walk = u.walk AND q.page < u.page AND q.item = r.item)) AS fresh FROM u),
    w AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN page > 0 AND n < 3 THEN 'short' WHEN page > 0 AND fresh = 0 THEN 'nothing new' END AS why FROM x),
    s AS (SELECT walk, min(page) FILTER (WHERE why IS NOT NULL) AS ended FROM w GROUP BY 1)
    SELECT w.walk, max(page) AS stop_page, coalesce(arg_max(why, page) FILTER (WHERE page = ended), 'end') AS reason, count(*) AS pages, sum(fresh)::BIGINT AS items FROM w JOIN s ON w.walk = s.walk WHERE ended IS NULL OR page <= ended GROUP BY 1""",
)
def page_walk_stop(spark, sf_dir):
    """Where walks over listing pages end, and why."""
    orders = table(spark, sf_dir, "orders")
    listing = orders.where("not (o_custkey % 60 % 4 = 0 and (o_orderkey * 31) % 7 = o_custkey % 60 % 5)").selectExpr("o_custkey % 60 AS walk", "CAST((o_orderkey * 31) % 7 AS INT) AS page", "(o_orderkey * 7) % (20 + o_custkey % 60) AS item")
    visits = orders.selectExpr("o_custkey % 60 AS walk").distinct().selectExpr("walk", "explode(sequence(0, 6)) AS page").where("walk % 9 <> page + 1")
    return x.walk_stop(visits, listing, "walk", "page", "item", 3)


_ESC = "replace(replace({}, '&', '&amp;'), '\"', '&quot;')"
_SHOWN = "strftime({}, '%d.%m.%Y')"
_SPACED = "replace(format('{{:,}}', round_even({}, 0)::BIGINT), ',', ' ')"


@query(
    "render_result_messages",
    f"""{WITH}, k AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY price DESC NULLS LAST, tender_id) AS k FROM tenders)
    SELECT tender_id, k::INT AS k, '<b>' || k || '. ' || {_ESC.format("title")} || '</b>' || chr(10) || '📅 дата закупки: ' || {_SHOWN.format("coalesce(published_at, start_date)")} || chr(10) || '🏢 ' || coalesce(nullif(customer, ''), 'не указан') || chr(10) || '📍 регион: ' || region
    || chr(10) || '💰 ' || coalesce({_SPACED.format("price")} || ' ' || currency, 'не указана') || chr(10) || '⏰ до ' || coalesce({_SHOWN.format("deadline")}, 'не указан') || chr(10) || '🔗 <a href="' || url || '">Открыть тендер</a>' AS message FROM k""",
)
def render_result_messages(spark, sf_dir):
    """The numbered results of each customer as messages."""
    k = F.row_number().over(Window.partitionBy("customer").orderBy(F.desc_nulls_last("price"), "tender_id"))
    return tenders(spark, sf_dir).withColumn("k", k).select("tender_id", "k", m.result_message(F.col("k")).alias("message"))


_NUM = "regexp_replace(CAST(CAST({} AS DECIMAL(24, 6)) AS VARCHAR), '(\\.\\d+?)0+$', '\\1')"
_CONTEXT_OF = "CASE WHEN tender_id % 3 = 0 THEN concat('Интересуют: ', customer) WHEN tender_id % 3 = 1 THEN '' END"


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(
    "build_prompts_full",
    f"""{WITH}, x AS (SELECT *, concat_ws(chr(10), 'Площадка: ' || platform, 'Название: ' || title, 'Статус деталей: ' || detail_status, CASE WHEN tender_id % 5 = 0 THEN {_sql_text(m.DIAGNOSED)} END, CASE WHEN customer <> '' THEN 'Заказчик: ' || customer END,
    CASE WHEN customer_inn <> '' THEN 'ИНН заказчика: ' || customer_inn END, 'Регион: ' || region, 'Начальная цена: ' || {_NUM.format("price")} || ' ' || currency, 'Срок подачи: ' || strftime(deadline, '%Y-%m-%dT%H:%M:%S') || '+00:00', CASE WHEN law_type <> '' THEN 'Тип закупки: ' || law_type END,
    CASE WHEN advance_required THEN 'Аванс: да (' || coalesce({_NUM.format("advance_percent")}, '?') || '%)' END, 'Постоплата/отсрочка: ' || postpayment_days || ' дней', 'Обеспечение заявки: ' || {_NUM.format("application_security_percent")} || '%', 'Обеспечение контракта: ' || {_NUM.format("contract_security_percent")} || '%',
    CASE WHEN detail_status = 'partial' THEN {_sql_text(m.PARTIAL)} END, 'Описание/предмет закупки: ' || array_to_string(list_filter([title, trim(description), customer, region, customer_inn,
    CASE WHEN tender_id % 4 = 1 THEN 'Срок поставки 30 дней x1' END, CASE WHEN tender_id % 4 = 0 THEN 'Лот 1' END, CASE WHEN tender_id % 4 = 0 THEN 'Предоплата 30%. Отсрочка платежа 45 календарных дней.' END], lambda v: v IS NOT NULL AND v <> ''), ' ')) AS t, {_CONTEXT_OF} AS c FROM tenders)
    SELECT tender_id, {_sql_text(m.QUESTION)} || CASE WHEN c <> '' THEN {_sql_text(m.CONTEXT[0])} || c || {_sql_text(m.CONTEXT[1])} ELSE '' END || {_sql_text(m.DATA[0])} || t || {_sql_text(m.DATA[1])} AS prompt FROM x""",
)
def build_prompts_full(spark, sf_dir):
    """The whole question on each tender, with its full text and the user's requirements."""
    rows = tenders(spark, sf_dir, heavy=True).withColumn("detail_diagnostics", F.expr("CASE WHEN tender_id % 5 = 0 THEN 'x' END"))
    return rows.select("tender_id", m.user_prompt(m.tender_text(norm.full_text()), F.expr(_CONTEXT_OF)).alias("prompt"))
