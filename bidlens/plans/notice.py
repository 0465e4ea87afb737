"""Queries on the fields of notices: pages are written from orders, customers and nations, and the fields come back out of the texts on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import notice as n
from ..sources.tables import items, spread, table
from .registry import query

_DAY, _MONTH, _YEAR = "CAST(day(o_orderdate) AS STRING)", "CAST(month(o_orderdate) AS STRING)", "CAST(year(o_orderdate) + 20 AS STRING)"
_NAMED = "CASE month(o_orderdate) " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(n.MONTHS)) + " END"
_CLOCK = "concat(lpad(CAST(o_orderkey % 24 AS STRING), 2, '0'), ':', lpad(CAST(o_custkey % 60 AS STRING), 2, '0'))"
_DOTTED = f"concat({_DAY}, '.', {_MONTH}, '.', {_YEAR})"
_AMOUNT = "replace(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING), '.', ',')"
_METHOD = "CASE o_orderpriority WHEN '1-URGENT' THEN 'ЭЛЕКТРОННЫЙ аукцион' WHEN '2-HIGH' THEN 'Запрос предложений' WHEN '3-MEDIUM' THEN 'Открытый конкурс' WHEN '5-LOW' THEN 'Иной способ' ELSE 'Процедура' END"
_STATE = "CASE o_orderstatus WHEN 'F' THEN 'Контракт исполнен' WHEN 'P' THEN 'Работа комиссии' ELSE 'подача заявок' END"
_TOWN = "CASE n_nationkey % 5 WHEN 0 THEN 'Тверь' WHEN 1 THEN 'Псков' WHEN 2 THEN 'Санкт-Петербург' WHEN 3 THEN 'Омск' ELSE 'Пермь' END"
_PLACE = "CASE n_nationkey % 4 WHEN 0 THEN 'Тверская область' WHEN 1 THEN 'Республика Карелия' WHEN 2 THEN 'Пермский край' ELSE concat('г. ', n_name) END"
_TERMS = """CASE o_orderkey % 5
  WHEN 0 THEN concat('Авансовый платеж ', CAST(o_custkey % 90 AS STRING), ',5 % от цены. Оплата в течение ', CAST(o_orderkey % 60 AS STRING), ' рабочих дней.')
  WHEN 1 THEN concat('Предоплата не предусмотрена. Отсрочка платежа ', CAST(o_orderkey % 60 AS STRING), ' календарных дней')
  WHEN 2 THEN concat('Обеспечение заявки: ', CAST(o_custkey % 9 AS STRING), '%. Обеспечение исполнения контракта ', CAST(o_custkey % 30 AS STRING), '.25%')
  WHEN 3 THEN concat(CAST(o_orderkey % 60 AS STRING), ' дней после приемки. Предварительная оплата ', CAST(o_custkey % 90 AS STRING), '%')
  ELSE 'Скидка 5%' END"""
_LIST = f"""
  o_orderkey,
  concat({_METHOD}, CASE o_orderkey % 3 WHEN 0 THEN ' 44-ФЗ' WHEN 1 THEN ', по 223 ФЗ' ELSE '' END, '  ', {_STATE}, ' Размещено ', CASE WHEN o_orderkey % 2 = 0 THEN {_DOTTED} ELSE concat({_DAY}, ' ', {_NAMED}, ' ', {_YEAR}, ' ', {_CLOCK}) END,
    CASE WHEN o_orderkey % 7 = 0 THEN ' Организация, осуществляющая размещение ' ELSE ' Заказчик: ' END, 'ООО ', c_name, ' ИНН ', CASE WHEN o_orderkey % 5 = 0 THEN 'нет' ELSE lpad(CAST(o_custkey AS STRING), 10, '7') END,
    ' Место нахождения: ', n_name, ' г. ', {_TOWN}, ', ул. 1 Начальная цена ', {_AMOUNT}, ' руб. Окончание подачи заявок ', {_DOTTED}, ' ', {_CLOCK},
    CASE WHEN o_orderkey % 4 = 0 THEN concat(' Место поставки: ', {_PLACE}, '; Общая информация ') ELSE '. ' END, {_TERMS}) AS txt,
  concat('https://x.example/', CASE o_custkey % 3 WHEN 0 THEN '223/purchase/' WHEN 1 THEN 'ea44/view/' ELSE 'view/' END, CAST(o_orderkey AS STRING)) AS url,
  CASE o_orderkey % 3 WHEN 0 THEN concat(' ', {_DAY}, '  ', {_NAMED}, ' ', {_YEAR}) WHEN 1 THEN concat({_DAY}, '/', {_MONTH}, '/', {_YEAR}, ' ', {_CLOCK}) ELSE concat('до ', {_DOTTED}) END AS dated,
  CASE o_orderkey % 3 WHEN 0 THEN concat('прием до ', {_DOTTED}, ' ', {_CLOCK}) WHEN 1 THEN concat('с ', {_YEAR}, '-', {_MONTH}, '-', {_DAY}, 'T', {_CLOCK}, ':00') ELSE concat('без даты ', o_orderpriority) END AS period,
  CASE o_orderkey % 4 WHEN 3 THEN {_DOTTED} ELSE concat({_YEAR}, '-', lpad({_MONTH}, 2, '0'), '-', lpad({_DAY}, 2, '0'), CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('T', {_CLOCK}, ':00Z') ELSE concat(' ', {_CLOCK}, '+03:00') END) END AS iso,
  concat(CASE WHEN o_orderkey % 2 = 0 THEN concat('Тендер № ', CAST(o_custkey AS STRING), ': ') ELSE '' END, 'Поставка ', c_name, CASE o_orderkey % 3 WHEN 0 THEN concat(' — Аукцион № ', CAST(o_orderkey AS STRING)) WHEN 1 THEN ' | Фабрикант торги' ELSE ' СМП' END) AS title,
  concat('Наименование характеристики|', CASE WHEN o_orderkey % 3 = 0 THEN 'Цена' ELSE concat('АО  ', c_name) END, '|ООО ', n_name, ' и Ко') AS cells,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Объект|Заказчик' ELSE 'Организация торгов|Цена' END AS heads,
  CASE WHEN o_orderkey % 3 = 0 THEN c_name ELSE ' ' END AS known_customer, CASE WHEN o_orderkey % 4 = 0 THEN n_name END AS known_region
"""
_FROM = f"WITH w AS (SELECT {_LIST} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), x AS (SELECT *, trim(regexp_replace(txt, '\\s+', ' ', 'g')) AS t FROM w)"


def notices(spark, sf_dir):
    """A page's text and some of its parts for every order."""
    orders, customer, nation = spread(table(spark, sf_dir, "orders")), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return joined.selectExpr(*items(_LIST))


def _register(name: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str]):
    """A query of fields over all notices, and the SQL that reads each out of the same texts."""
    query(name, f"{_FROM} SELECT o_orderkey, {', '.join(f'{v} AS {k}' for k, v in sql.items())} FROM x")(
        lambda spark, sf_dir: notices(spark, sf_dir).select("o_orderkey", *[c.alias(k) for k, c in columns().items()])
    )


def _num(pattern: str, kind: str = "DOUBLE", text: str = "t") -> str:
    return f"try_cast(replace(nullif(regexp_extract({text}, '{pattern}', 1), ''), ',', '.') AS {kind})"


_MONTHS_SQL = "[" + ", ".join(f"'{m}'" for m in n.MONTHS) + "]"


def _when(text: str, order: str = "dmy", hour: int = 12, named: bool = False) -> str:
    """A day in SQL: its numbers in order, and the month's name where it has one."""
    nums = f"regexp_extract_all({text}, '\\d+')"
    month = f"list_position({_MONTHS_SQL}, regexp_extract({text}, '[а-я]{{3,}}'))" if named else f"{nums}[2]::INT"
    skip = 1 if named else 0
    year, day = (f"{nums}[{3 - skip}]", f"{nums}[1]") if order == "dmy" else (f"{nums}[1]", f"{nums}[3]")
    return f"make_timestamp({year}::INT, {month}, {day}::INT, coalesce({nums}[{4 - skip}]::INT, {hour}), coalesce({nums}[{5 - skip}]::INT, 0), 0)"


_TERMS_SQL = {
    "advance_required": "coalesce(regexp_matches(t, 'Авансовый|Предоплата|Предварительная'), false)",
    "advance_percent": _num("(?:Авансовый платеж|Предварительная оплата) (\\d+(?:,\\d+)?) ?%"),
    "postpayment_days": "coalesce(" + ", ".join(_num(p, "INTEGER") for p in ("Оплата в течение (\\d+)", "Отсрочка платежа (\\d+)", "(\\d+) дней после")) + ")",
    "application_security_percent": _num("Обеспечение заявки: (\\d+)%"),
    "contract_security_percent": _num("исполнения контракта (\\d+\\.\\d+)%"),
}
_PUBLISHED = "regexp_extract(t, 'Размещено (.*?) (?:Заказчик|Организация)', 1)"
_CUSTOMER_SQL = "regexp_extract(t, '(?:Заказчик:|размещение) (.*?) ИНН', 1)"
_TOWN_SQL = "regexp_extract(t, ' г\\. ([^ ,]+), ул', 1)"
_PLACE_SQL = "regexp_extract(t, 'Место поставки: ([^;]*);', 1)"
_REGION_SQL = f"CASE WHEN {_PLACE_SQL} <> '' THEN {_PLACE_SQL} ELSE {_TOWN_SQL} END"
_METHOD_SQL = "CASE WHEN regexp_matches(t, '^ЭЛЕКТРОННЫЙ') THEN 'Электронный аукцион' WHEN regexp_matches(t, '^Процедура') THEN '' ELSE regexp_extract(t, '^(Запрос предложений|Открытый конкурс|Иной способ)', 1) END"
_STATE_SQL = "CASE WHEN contains(t, 'Контракт исполнен') THEN 'Контракт исполнен' WHEN contains(t, 'Работа комиссии') THEN 'Работа комиссии' ELSE 'Подача заявок' END"
_LAW_SQL = "CASE WHEN regexp_matches(t, '44-ФЗ') THEN '44-ФЗ' WHEN regexp_matches(t, '223 ФЗ') THEN '223-ФЗ' WHEN contains(url, '/223/') THEN '223-ФЗ' WHEN contains(url, '/ea44/') THEN '44-ФЗ' ELSE '' END"
_INN_SQL = "regexp_extract(t, 'ИНН (\\d{10})', 1)"
_PUBLISHED_SQL = f"CASE WHEN regexp_matches({_PUBLISHED}, '[а-я]') THEN {_when(_PUBLISHED, named=True)} ELSE {_when(_PUBLISHED)} END"
_DEADLINE = "regexp_extract(t, 'подачи заявок ([0-9.]+ [0-9:]+)', 1)"
#: A named region in the text: the place of delivery, or the town where it is a city of federal rank.
_NAMED_SQL = f"CASE WHEN regexp_matches({_PLACE_SQL}, 'область|Республика|край') THEN {_PLACE_SQL} WHEN {_TOWN_SQL} = 'Санкт-Петербург' THEN 'г. Санкт-Петербург' ELSE '' END"

_register("notice_terms", lambda: {f: n.sentence_terms(F.col("txt"))[f] for f in n.TERMS}, _TERMS_SQL)
_register("human_dates", lambda: {"at": n.human_time(F.col("dated"))}, {"at": f"CASE WHEN regexp_matches(dated, '^до') THEN NULL WHEN regexp_matches(dated, '[а-я]') THEN {_when('dated', named=True)} ELSE {_when('dated')} END"})
_register("publication_dates", lambda: {"published_at": n.publication_time(F.col("txt"))}, {"published_at": _PUBLISHED_SQL})
_register("days_in_text", lambda: {"at": n.day_in_text(F.col("period"))}, {"at": f"CASE WHEN contains(period, 'T') THEN {_when('period', 'ymd', 0)} WHEN contains(period, 'прием') THEN {_when('period', hour=0)} END"})
_register("iso_times", lambda: {"at": n.iso_time(F.col("iso"))}, {"at": "CASE WHEN contains(iso, '.') THEN NULL WHEN contains(iso, '+') THEN left(iso, 16)::TIMESTAMP - INTERVAL 3 HOUR ELSE replace(replace(iso, 'T', ' '), 'Z', '')::TIMESTAMP END"})
_register("notice_customers", lambda: {"customer": n.customer_in_text(F.col("txt"))}, {"customer": _CUSTOMER_SQL})
_register("cell_customers", lambda: {"customer": n.customer_in_cells(F.split("cells", r"\|"))}, {"customer": "trim(regexp_replace(CASE WHEN regexp_matches(cells, '\\|Цена\\|') THEN string_split(cells, '|')[3] ELSE string_split(cells, '|')[2] END, ' +', ' ', 'g'))"})
_register("paired_customers", lambda: {"customer": n.customer_in_pairs(F.split("heads", r"\|"), F.slice(F.split("cells", r"\|"), 2, 2))}, {"customer": "trim(regexp_replace(string_split(cells, '|')[CASE WHEN contains(heads, 'Заказчик') THEN 3 ELSE 2 END], ' +', ' ', 'g'))"})
_register("notice_regions", lambda: {"region": n.region_in_text(F.col("txt"))}, {"region": _REGION_SQL})
_register("named_regions", lambda: {"region": n.named_region(F.col("txt"))}, {"region": _NAMED_SQL})
_register("methods_and_states", lambda: {"method": n.first_phrase(F.col("txt"), n.METHODS), "state": n.first_phrase(F.col("txt"), n.STATES)}, {"method": _METHOD_SQL, "state": _STATE_SQL})
_register("clean_titles", lambda: {"title": n.clean_title(F.col("title"), F.col("o_orderkey").cast("string"))}, {"title": "regexp_extract(title, '(Поставка Customer#\\d+)', 1)"})
_DETAILS_SQL = {
    "law_type": _LAW_SQL, "procurement_method": _METHOD_SQL, "status": _STATE_SQL, "customer": _CUSTOMER_SQL, "customer_inn": _INN_SQL, "region": _REGION_SQL, "price": _num("Начальная цена (\\d+,\\d+)"),
    "published_at": _PUBLISHED_SQL, "deadline": _when(_DEADLINE, hour=0), **_TERMS_SQL,
}


@query("notice_details", f"{_FROM} SELECT o_orderkey, {', '.join(f'{v} AS {k}' for k, v in _DETAILS_SQL.items())} FROM x")
def notice_details(spark, sf_dir):
    return notices(spark, sf_dir).select("o_orderkey", n.details(F.col("txt"), F.col("url")).alias("d")).select("o_orderkey", "d.*")


@query(
    "recover_notice",
    f"""{_FROM} SELECT o_orderkey, CASE WHEN trim(known_customer) <> '' THEN known_customer ELSE {_CUSTOMER_SQL} END AS customer, {_INN_SQL} AS customer_inn, {_LAW_SQL} AS law_type,
    coalesce(known_region, {_REGION_SQL}) AS region FROM x""",
)
def recover_notice(spark, sf_dir):
    known = {"customer": F.col("known_customer"), "customer_inn": F.lit(""), "law_type": F.lit(" "), "region": F.col("known_region")}
    return notices(spark, sf_dir).select("o_orderkey", n.recovered(F.col("txt"), F.col("url"), **known).alias("r")).select("o_orderkey", "r.*")
