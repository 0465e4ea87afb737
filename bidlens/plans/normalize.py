"""Queries on record normalisation, risk and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import answers as ans
from ..operators import normalize as n
from ..operators import risk
from ..sources.tables import NOW_SPARK, NOW_SQL, WITH, items, table, tenders
from .registry import query


@query("to_utc", f"{WITH} SELECT tender_id, " + ", ".join(f"{c} - INTERVAL 3 HOUR AS {c}" for c in n.TIMES) + " FROM tenders")
def to_utc(spark, sf_dir):
    return n.to_utc(tenders(spark, sf_dir)).select("tender_id", *n.TIMES)


@query("deadline_default", f"{WITH} SELECT tender_id, coalesce(deadline, end_date) AS deadline FROM tenders")
def deadline_default(spark, sf_dir):
    return tenders(spark, sf_dir).select("tender_id", F.coalesce("deadline", "end_date").alias("deadline"))


@query("unique_key", f"{WITH} SELECT platform || ':' || external_id AS unique_key FROM tenders")
def unique_key(spark, sf_dir):
    return tenders(spark, sf_dir).select(F.concat_ws(":", "platform", "external_id").alias("unique_key"))


_FLAT = """CASE tender_id % 4 WHEN 0 THEN 'Предоплата 30%. Отсрочка платежа 45 календарных дней.' WHEN 1 THEN 'Срок поставки 30 дней x1' ELSE '' END"""


@query(
    "full_text",
    f"""{WITH} SELECT tender_id, array_to_string(list_filter([title, trim(description), customer, region, customer_inn,
    CASE WHEN tender_id % 4 = 1 THEN {_FLAT} END, CASE WHEN tender_id % 4 = 0 THEN 'Лот 1' END, CASE WHEN tender_id % 4 = 0 THEN {_FLAT} END], lambda x: x IS NOT NULL AND x <> ''), ' ') AS full_text FROM tenders""",
)
def full_text(spark, sf_dir):
    return tenders(spark, sf_dir).select("tender_id", n.full_text().alias("full_text"))


@query("flatten_text", f"""{WITH} SELECT tender_id, CASE tender_id % 4 WHEN 0 THEN {_FLAT} || ' Лот 1' WHEN 1 THEN {_FLAT} || ' ООО Вектор, ИНН 7812345678' WHEN 2 THEN 'not json' ELSE '' END AS flat FROM tenders""")
def flatten_text(spark, sf_dir):
    return tenders(spark, sf_dir).select("tender_id", t.flatten_json(F.col("raw_data")).alias("flat"))


@query("decode_raw_json", f"""{WITH} SELECT tender_id, tender_id % 4 < 2 AS valid, CASE WHEN tender_id % 4 < 2 THEN json_extract_string(raw_data, '$.lot') END AS lot FROM tenders""")
def decode_raw_json(spark, sf_dir):
    decoded = F.coalesce(F.try_parse_json("raw_data"), F.parse_json(F.lit("{}")))
    return tenders(spark, sf_dir).select("tender_id", F.try_parse_json("raw_data").isNotNull().alias("valid"), F.try_variant_get(decoded, "$.lot", "string").alias("lot"))


@query(
    "decode_json_list",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN [c_name, lower(c_mktsegment)] WHEN 1 THEN [c_mktsegment] ELSE [] END AS items FROM customer""",
)
def decode_json_list(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE c_custkey % 4 WHEN 0 THEN to_json(array(concat(' ', c_name), '', lower(c_mktsegment))) WHEN 1 THEN to_json(array(c_mktsegment, ' ')) WHEN 2 THEN '{\"a\":1}' ELSE 'broken [' END AS packed")
    items = F.coalesce(F.from_json("packed", "array<string>"), F.array().cast("array<string>"))
    return c.select("c_custkey", F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "").alias("items"))


_T = "concat_ws(' ', description, CASE tender_id % 4 WHEN 0 THEN 'Предоплата 30%. Отсрочка платежа 45 календарных дней.' WHEN 1 THEN 'Срок поставки 30 дней x1' END)"


def _pct(labels):
    v = f"TRY_CAST(replace(nullif(regexp_extract(txt, '(?:{'|'.join(labels)})[^%0-9]{{0,100}}([0-9]{{1,3}}(?:[.,][0-9]+)?)[ ]*%', 1, 'i'), ''), ',', '.') AS DOUBLE)"
    return f"CASE WHEN {v} BETWEEN 0 AND 100 THEN {v} END"


def _days(labels):
    return f"TRY_CAST(nullif(regexp_extract(txt, '(?:{'|'.join(labels)})[^0-9]{{0,100}}([0-9]{{1,3}}) *(?:календарн[а-яё]*|рабоч[а-яё]*)? *(?:дн[а-яё]*|сут[а-яё]*)', 1, 'i'), '') AS INT)"


@query(
    "enrich_terms",
    f"""{WITH}, x AS (SELECT *, {_T} AS txt FROM tenders),
    y AS (SELECT *, coalesce(advance_percent, {_pct(t.ADVANCE)}) AS ap FROM x)
    SELECT tender_id, CASE WHEN ap IS NOT NULL AND trim(txt) <> '' THEN ap > 0 ELSE advance_required END AS advance_required, ap AS advance_percent,
    coalesce(postpayment_days, {_days(t.POSTPAYMENT)}) AS postpayment_days, coalesce(application_security_percent, {_pct(t.APPLICATION_SECURITY)}) AS application_security_percent,
    coalesce(contract_security_percent, {_pct(t.CONTRACT_SECURITY)}) AS contract_security_percent FROM y""",
)
def enrich_terms(spark, sf_dir):
    return n.enrich_terms(tenders(spark, sf_dir, heavy=True)).select("tender_id", "advance_required", "advance_percent", "postpayment_days", "application_security_percent", "contract_security_percent")


@query(
    "tax_ids",
    f"""{WITH} SELECT tender_id, CASE WHEN length(regexp_replace(customer_inn, '[^0-9]', '', 'g')) = 10 THEN customer_inn WHEN tender_id % 6 = 1 THEN '7701234567'
    WHEN tender_id % 6 = 5 THEN '7801234567' WHEN tender_id % 4 = 1 THEN '7812345678' ELSE '' END AS customer_inn FROM tenders""",
)
def tax_ids(spark, sf_dir):
    return tenders(spark, sf_dir).select("tender_id", n.customer_tax_id().alias("customer_inn"))


@query(
    "detail_contract",
    f"""{WITH}, x AS (SELECT *, list_filter([CASE WHEN trim(title) = '' THEN 'title' END, CASE WHEN trim(url) = '' THEN 'url' END, CASE WHEN trim(customer) = '' THEN 'customer' END,
    CASE WHEN price IS NULL THEN 'price' END, CASE WHEN deadline IS NULL THEN 'deadline' END], lambda v: v IS NOT NULL) AS gaps,
    CASE WHEN lower(detail_status) IN ('partial', 'failed') THEN lower(detail_status) ELSE 'success' END AS st FROM tenders)
    SELECT tender_id, CASE WHEN len(gaps) > 0 AND st = 'success' THEN 'partial' ELSE st END AS detail_status,
    CASE WHEN len(gaps) > 0 THEN 'Отсутствуют поля: ' || array_to_string(gaps, ', ') ELSE '' END AS detail_diagnostics FROM x""",
)
def detail_contract(spark, sf_dir):
    return n.detail_contract(tenders(spark, sf_dir)).select("tender_id", "detail_status", "detail_diagnostics")


_LISTED = "tender_id, title, CASE WHEN tender_id % 2 = 0 THEN NULL ELSE price END AS price, CASE WHEN tender_id % 3 = 0 THEN 'из списка' ELSE customer END AS customer, region"
_DETAILED = "tender_id, CASE WHEN tender_id % 5 = 0 THEN '' ELSE concat(title, '!') END AS title, CASE WHEN tender_id % 7 = 0 THEN 0.0 ELSE price END AS price, customer"


@query(
    "merge_detail",
    f"""{WITH}, l AS (SELECT {_LISTED} FROM tenders), d AS (SELECT {_DETAILED} FROM tenders WHERE tender_id % 4 <> 3)
    SELECT l.tender_id, coalesce(nullif(d.title, ''), l.title) AS title, coalesce(d.price, l.price) AS price, coalesce(nullif(d.customer, ''), l.customer) AS customer, l.region
    FROM l LEFT JOIN d ON l.tender_id = d.tender_id""",
)
def merge_detail(spark, sf_dir):
    rows = tenders(spark, sf_dir)
    listing = rows.select("tender_id", "title", F.expr("CASE WHEN tender_id % 2 = 0 THEN NULL ELSE price END AS price"), F.expr("CASE WHEN tender_id % 3 = 0 THEN 'из списка' ELSE customer END AS customer"), "region")
    detail = rows.where("tender_id % 4 <> 3").select("tender_id", F.expr("CASE WHEN tender_id % 5 = 0 THEN '' ELSE concat(title, '!') END AS title"), F.expr("CASE WHEN tender_id % 7 = 0 THEN 0.0 ELSE price END AS price"), "customer")
    return n.merge_detail(listing, detail, "tender_id", ["title", "price", "customer"])


#: What the detail page says of each merged field; some say nothing.
_SAID = {
    "title": "CASE WHEN tender_id % 5 = 0 THEN '' ELSE concat(title, '!') END", "description": "CASE WHEN tender_id % 2 = 0 THEN NULL ELSE concat('о: ', title) END", "price": "CASE WHEN tender_id % 7 = 0 THEN 0.0 WHEN tender_id % 7 = 1 THEN NULL ELSE price END",
    "currency": "CASE WHEN tender_id % 6 = 0 THEN 'EUR' ELSE '' END", "start_date": "CAST(NULL AS TIMESTAMP{ntz})", "end_date": "CASE WHEN tender_id % 2 = 0 THEN end_date END", "deadline": "CASE WHEN tender_id % 3 = 0 THEN deadline END", "published_at": "published_at",
    "region": "CASE WHEN tender_id % 4 = 0 THEN 'Тверь' ELSE '' END", "customer": "customer", "customer_inn": "''", "law_type": "'44-ФЗ'", "advance_percent": "CASE WHEN tender_id % 3 = 1 THEN CAST(tender_id % 2 AS DOUBLE) END",
    "postpayment_days": "CASE WHEN tender_id % 4 = 1 THEN 5 END", "application_security_percent": "CAST(NULL AS DOUBLE)", "contract_security_percent": "CAST(tender_id % 3 AS DOUBLE)", "url": "concat(url, '/d')",
}
_SAID_MORE = "CASE WHEN tender_id % 8 = 0 THEN true END AS advance_required, CASE tender_id % 5 WHEN 0 THEN 'PARTIAL' WHEN 1 THEN 'strange' WHEN 2 THEN '' ELSE 'failed' END AS detail_status, repeat('ж', CAST(tender_id % 5000 AS INT)) AS detail_diagnostics"
_DOCS = "CASE WHEN tender_id % 5 = 0 THEN {l}{m}'name', 'b.pdf'{n}, {m}'name', 'c.pdf'{n}{r} END AS documents, CASE WHEN tender_id % 2 = 0 THEN {m}'price', 'page', 'region', 'page'{n} END AS field_sources"
_LIST_DOCS = "CASE WHEN tender_id % 4 = 0 THEN {l}{m}'name', 'a.pdf'{n}{r} END AS documents, CASE WHEN tender_id % 3 = 0 THEN {m}'title', 'list', 'price', 'list'{n} END AS field_sources, 'old' AS detail_diagnostics"


def _duck(text: str) -> str:
    """Array and map literals as DuckDB writes them."""
    pairs = {"{m}'name', ": "MAP {'name': ", "{m}'price', 'page', 'region', 'page'": "MAP {'price': 'page', 'region': 'page'", "{m}'title', 'list', 'price', 'list'": "MAP {'title': 'list', 'price': 'list'"}
    for a, b in pairs.items():
        text = text.replace(a, b)
    return text.replace("{n}", "}").replace("{l}", "[").replace("{r}", "]")


def _spark(text: str) -> str:
    return text.replace("{m}", "map(").replace("{n}", ")").replace("{l}", "array(").replace("{r}", ")")


_STRINGS = ("title", "description", "currency", "region", "customer", "customer_inn", "law_type", "url")
_WON = {c: f"coalesce(nullif(d.{c}, ''), l.{c})" if c in _STRINGS else f"coalesce(d.{c}, l.{c})" for c in n.MERGED}
_WON["deadline"] = f"coalesce({_WON['deadline']}, {_WON['end_date']})"


@query(
    "merge_detail_full",
    f"""{WITH}, l AS (SELECT * EXCLUDE (documents, field_sources, detail_diagnostics), documents, field_sources, detail_diagnostics FROM (SELECT *, {_duck(_LIST_DOCS)} FROM tenders)),
    d AS (SELECT tender_id, {", ".join(f"{v.format(ntz='')} AS {k}" for k, v in _SAID.items())}, {_SAID_MORE}, {_duck(_DOCS)} FROM tenders WHERE tender_id % 4 <> 3)
    SELECT l.tender_id, {", ".join(f"{v} AS {k}" for k, v in _WON.items())}, CASE WHEN d.advance_percent IS NOT NULL THEN d.advance_percent > 0 WHEN d.advance_required THEN true ELSE l.advance_required END AS advance_required,
    coalesce(array_to_string(list_sort(list_transform(map_entries(map_concat(coalesce(l.field_sources, MAP {{}}), coalesce(d.field_sources, MAP {{}}))), lambda e: e.key || '=' || e.value)), ','), '') AS field_sources,
    coalesce(array_to_string(list_transform(CASE WHEN len(d.documents) > 0 THEN d.documents ELSE l.documents END, lambda m: m['name']), ','), '') AS documents,
    CASE WHEN d.tender_id IS NULL THEN l.detail_status WHEN lower(d.detail_status) IN ('success', 'partial', 'failed') THEN lower(d.detail_status) ELSE 'success' END AS detail_status,
    CASE WHEN d.tender_id IS NULL THEN l.detail_diagnostics ELSE left(d.detail_diagnostics, 4000) END AS detail_diagnostics FROM l LEFT JOIN d ON l.tender_id = d.tender_id""",
)
def merge_detail_full(spark, sf_dir):
    """All merged fields, maps and documents of listings and their detail pages."""
    rows = tenders(spark, sf_dir)
    listing = rows.selectExpr("*", *items(_spark(_LIST_DOCS)))
    said = [f"{v.format(ntz='_NTZ')} AS {k}" for k, v in _SAID.items()]
    detail = rows.where("tender_id % 4 <> 3").selectExpr("tender_id", *said, *items(_SAID_MORE), *items(_spark(_DOCS)))
    out = n.merge_detail_full(listing, detail, "tender_id")
    sources = F.array_join(F.array_sort(F.transform(F.map_entries("field_sources"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    names = F.coalesce(F.array_join(F.transform("documents", lambda m: m["name"]), ","), F.lit(""))
    return out.select("tender_id", *n.MERGED, "advance_required", sources.alias("field_sources"), names.alias("documents"), "detail_status", "detail_diagnostics")


@query("detail_fallback", f"""{WITH} SELECT tender_id, CASE WHEN detail_status = 'failed' THEN concat('Тендер № ', external_id) ELSE title END AS title, detail_status <> 'failed' AS details_loaded FROM tenders""")
def detail_fallback(spark, sf_dir):
    rows = tenders(spark, sf_dir)
    loaded = rows.where("detail_status <> 'failed'").select("tender_id", "title", F.lit(True).alias("details_loaded"))
    listing = rows.select("tender_id", "external_id")
    return listing.join(loaded, "tender_id", "left").select("tender_id", F.coalesce("title", F.concat(F.lit("Тендер № "), "external_id")).alias("title"), F.coalesce("details_loaded", F.lit(False)).alias("details_loaded"))


@query("evolve_schema", f"""{WITH} SELECT tender_id, coalesce(law_type, '') AS law_type, 'partial' AS detail_status, 0 AS search_number FROM tenders""")
def evolve_schema(spark, sf_dir):
    return n.evolve(tenders(spark, sf_dir).select("tender_id", "law_type"), {"law_type": ("string", ""), "detail_status": ("string", "partial"), "search_number": ("int", 0)})


@query("normalized_snapshot", f"""{WITH} SELECT tender_id, advance_required, advance_percent, postpayment_days, customer_inn FROM tenders""")
def normalized_snapshot(spark, sf_dir):
    fields = ["advance_required", "advance_percent", "postpayment_days", "customer_inn"]
    packed = tenders(spark, sf_dir).select("tender_id", F.struct(*fields).alias("snapshot"))
    return packed.select("tender_id", F.from_json(F.to_json("snapshot"), packed.schema["snapshot"].dataType).alias("s")).select("tender_id", "s.*")


_DAYS = f"(date_diff('second', {NOW_SQL}, deadline) / 86400.0)"
_MISS = "list_filter([CASE WHEN price IS NULL THEN 'price' END, CASE WHEN deadline IS NULL THEN 'deadline' END, CASE WHEN coalesce(customer, '') = '' THEN 'customer' END], lambda v: v IS NOT NULL)"
_FACTORS = f"""list_filter([
  CASE WHEN len({_MISS}) > 0 THEN {{'code': 'insufficient_data', 'severity': CASE WHEN len({_MISS}) >= 2 THEN 'high' ELSE 'medium' END}} END,
  CASE WHEN {_DAYS} < 0 THEN {{'code': 'deadline_passed', 'severity': 'high'}} END,
  CASE WHEN {_DAYS} BETWEEN 0 AND 7 THEN {{'code': 'short_deadline', 'severity': CASE WHEN {_DAYS} <= 3 THEN 'high' ELSE 'medium' END}} END,
  CASE WHEN application_security_percent > 5 THEN {{'code': 'high_application_security', 'severity': 'medium'}} END,
  CASE WHEN contract_security_percent > 30 THEN {{'code': 'high_contract_security', 'severity': 'medium'}} END,
  CASE WHEN advance_required AND advance_percent IS NULL THEN {{'code': 'unclear_advance', 'severity': 'low'}} END,
  CASE WHEN lower(trim(detail_status)) NOT IN ('', 'success', 'ok') THEN {{'code': 'incomplete_detail_data', 'severity': 'medium'}} END], lambda v: v IS NOT NULL)"""
_RISK = f"{WITH}, r AS (SELECT tender_id, {_MISS} AS miss, {_FACTORS} AS f FROM tenders)"
_LEVEL = """CASE WHEN len(miss) >= 3 THEN 'UNKNOWN' WHEN len(list_filter(f, lambda x: x.severity = 'high')) > 0 THEN 'HIGH'
  WHEN len(list_filter(f, lambda x: x.severity = 'medium')) > 0 THEN 'MEDIUM' ELSE 'LOW' END"""


@query("risk_assess", f"{_RISK} SELECT tender_id, {_LEVEL} AS level, array_to_string(list_transform(f, lambda x: x.code || ':' || x.severity), ',') AS factors FROM r")
def risk_assess(spark, sf_dir):
    told = F.array_join(F.transform("factors", lambda f: F.concat(f["code"], F.lit(":"), f["severity"])), ",")
    return risk.assess(tenders(spark, sf_dir), F.expr(NOW_SPARK)).select("tender_id", "level", told.alias("factors"))


@query("risk_level", f"{_RISK} SELECT {_LEVEL} AS level, count(*) AS n FROM r GROUP BY 1")
def risk_level(spark, sf_dir):
    return risk.assess(tenders(spark, sf_dir), F.expr(NOW_SPARK)).groupBy("level").agg(F.count("*").alias("n"))


@query("risk_factors", f"{_RISK} SELECT tender_id, unnest(f).code AS code, unnest(f).severity AS severity FROM r")
def risk_factors(spark, sf_dir):
    return tenders(spark, sf_dir).select("tender_id", F.explode(risk.factors(F.expr(NOW_SPARK))).alias("f")).select("tender_id", "f.code", "f.severity")


@query("risk_factor_counts", f"{_RISK}, e AS (SELECT unnest(f) AS x FROM r) SELECT x.code AS code, x.severity AS severity, count(*) AS n FROM e GROUP BY 1, 2")
def risk_factor_counts(spark, sf_dir):
    return risk_factors(spark, sf_dir).groupBy("code", "severity").agg(F.count("*").alias("n"))


_ANSWER = """CASE o_orderkey % 5
  WHEN 0 THEN concat('<think>{"relevance_score": 1}</think>{"relevance_score": ', CAST(o_orderkey % 130 AS STRING), ', "recommendation": "Participate", "risks": [" a ", "", "b", "c", "d"], "summary": " s "}')
  WHEN 1 THEN concat('Вот ответ: {"relevance_score": "', CAST(o_orderkey % 100 AS STRING), '.7", "recommendation": "maybe", "risks": "нет"} конец')
  WHEN 2 THEN 'не JSON' WHEN 3 THEN '{"relevance_score": "высокий"}' ELSE NULL END"""
_SCORE = "CASE o_orderkey % 5 WHEN 0 THEN least(100, o_orderkey % 130) WHEN 1 THEN o_orderkey % 100 END"


def _answers(spark, sf_dir):
    return ans.parse(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS tender_id", f"{_ANSWER} AS content"))


@query("parse_answers", "SELECT o_orderkey AS tender_id, o_orderkey % 5 IN (0, 1, 3) AS parsed FROM orders")
def parse_answers(spark, sf_dir):
    return _answers(spark, sf_dir).select("tender_id", F.col("body").isNotNull().alias("parsed"))


@query(
    "normalize_answers",
    f"""SELECT o_orderkey AS tender_id, ({_SCORE})::INT AS relevance_score, CASE o_orderkey % 5 WHEN 0 THEN 'participate' WHEN 1 THEN 'review' END AS recommendation,
    CASE o_orderkey % 5 WHEN 0 THEN ['a', 'b', 'c'] WHEN 1 THEN [] END AS risks, CASE o_orderkey % 5 WHEN 0 THEN 's' WHEN 1 THEN '' END AS summary,
    CASE o_orderkey % 5 WHEN 2 THEN 'not_json' WHEN 4 THEN 'not_json' WHEN 3 THEN 'bad_score' END AS error FROM orders""",
)
def normalize_answers(spark, sf_dir):
    return ans.normalize(_answers(spark, sf_dir)).select("tender_id", "relevance_score", "recommendation", "risks", "summary", "error")


@query(
    "stub_answers",
    f"""SELECT o_orderkey AS tender_id, coalesce({_SCORE}, 50)::INT AS relevance_score, CASE o_orderkey % 5 WHEN 0 THEN 'participate' ELSE 'review' END AS recommendation,
    o_orderkey % 5 > 1 AS is_stub FROM orders""",
)
def stub_answers(spark, sf_dir):
    return ans.normalize(_answers(spark, sf_dir), allow_stub=True).select("tender_id", "relevance_score", "recommendation", "is_stub")
