"""Queries over tenders and analyses: market roll-ups and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import funnel, messages
from ..operators import market as m
from ..sources.tables import NOW_SPARK, NOW_SQL, PROFILES_SQL, WITH, analyses, items, profiles, table, tenders
from .registry import query

_J = "tenders LEFT JOIN analyses USING (tender_id)"
_M = """count(*) AS n, coalesce(sum(price), 0.0) AS value, avg(price) AS avg_price, avg(relevance_score) AS avg_score,
  count(*) FILTER (WHERE coalesce(relevance_score, 0) >= 80) AS high"""


def joined(spark, sf_dir):
    return m.with_analyses(tenders(spark, sf_dir), analyses(spark, sf_dir))


@query("scan_tenders", f"{WITH} SELECT * FROM tenders")
def scan_tenders(spark, sf_dir):
    return tenders(spark, sf_dir)


@query("join_left_analyses", f"{WITH} SELECT tender_id, platform, price, relevance_score, recommendation FROM {_J}")
def join_left_analyses(spark, sf_dir):
    return joined(spark, sf_dir).select("tender_id", "platform", "price", "relevance_score", "recommendation")


@query("market_totals", f"{WITH} SELECT {_M} FROM {_J} WHERE first_seen_at >= TIMESTAMP '1996-01-01' AND coalesce(relevance_score, 0) >= 10")
def market_totals(spark, sf_dir):
    return m.totals(m.in_scope(joined(spark, sf_dir), since="1996-01-01 00:00:00", min_score=10))


def _dimension(name: str, column: str) -> None:
    sql = f"{WITH} SELECT coalesce(nullif(trim({column}), ''), '{m.NOT_GIVEN}') AS name, {_M} FROM {_J} GROUP BY 1 ORDER BY n DESC, value DESC, name LIMIT 20"

    @query(f"market_by_{name}", sql)
    def by(spark, sf_dir):
        return m.by_dimension(joined(spark, sf_dir), column)


for _name, _column in m.DIMENSIONS.items():
    _dimension(_name, _column)

_ALL = " UNION ALL ".join(
    f"SELECT *, row_number() OVER (ORDER BY n DESC, value DESC, name) AS rank FROM (SELECT '{d}' AS dimension, coalesce(nullif(trim({c}), ''), '{m.NOT_GIVEN}') AS name, {_M} FROM {_J} GROUP BY 2)"
    for d, c in m.DIMENSIONS.items()
)


@query("market_all_dims", f"{WITH} SELECT * FROM ({_ALL}) WHERE rank <= 20")
def market_all_dims(spark, sf_dir):
    return m.all_dimensions(joined(spark, sf_dir))


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE coalesce({column}, '') END"


@query(
    "report_rows",
    f"""{WITH} SELECT tender_id, {_case("platform", m.PLATFORM_NAMES)} AS platform, title, customer, price, region, law_type, published_at, deadline,
    greatest(0, datediff('day', CAST({NOW_SQL} AS DATE), CAST(deadline AS DATE)))::INT AS days_left, coalesce(relevance_score, 0)::INT AS score,
    {_case("recommendation", m.RECOMMENDATION_NAMES)} AS recommendation, url FROM {_J} WHERE tender_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""",
)
def report_rows(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("tender_id"))
    return m.report_rows(joined(spark, sf_dir), F.expr(NOW_SPARK), ids)


@query(
    "report_summary",
    f"""{WITH} SELECT count(*) AS total, count(relevance_score) AS analysed, count(*) FILTER (WHERE relevance_score >= 70) AS high,
    count(*) FILTER (WHERE recommendation = 'participate') AS participate, count(*) FILTER (WHERE recommendation = 'review') AS review,
    count(*) FILTER (WHERE recommendation = 'skip') AS skip FROM {_J}""",
)
def report_summary(spark, sf_dir):
    return m.report_summary(joined(spark, sf_dir))


@query("label_codes", f"{WITH} SELECT tender_id, {_case('platform', m.PLATFORM_NAMES)} AS platform_name, {_case('recommendation', m.RECOMMENDATION_NAMES)} AS recommendation_name FROM {_J}")
def label_codes(spark, sf_dir):
    return joined(spark, sf_dir).select("tender_id", m.label("platform", m.PLATFORM_NAMES).alias("platform_name"), m.label("recommendation", m.RECOMMENDATION_NAMES).alias("recommendation_name"))


@query("days_left", f"{WITH} SELECT tender_id, greatest(0, datediff('day', CAST({NOW_SQL} AS DATE), CAST(deadline AS DATE)))::INT AS days_left FROM tenders WHERE deadline IS NOT NULL")
def days_left(spark, sf_dir):
    left = F.greatest(F.lit(0), F.datediff(F.to_date("deadline"), F.to_date(F.expr(NOW_SPARK))))
    return tenders(spark, sf_dir).where("deadline is not null").select("tender_id", left.alias("days_left"))


@query("status_counts", f"{WITH} SELECT (SELECT count(*) FROM tenders) AS tenders, (SELECT count(*) FROM analyses) AS analyses")
def status_counts(spark, sf_dir):
    return tenders(spark, sf_dir).agg(F.count("*").alias("tenders")).crossJoin(analyses(spark, sf_dir).agg(F.count("*").alias("analyses")))


@query("score_threshold", f"{WITH} SELECT tender_id, relevance_score FROM analyses WHERE relevance_score >= 70")
def score_threshold(spark, sf_dir):
    return analyses(spark, sf_dir).where("relevance_score >= 70").select("tender_id", "relevance_score")


@query("relevant_flag", f"{WITH} SELECT tender_id, relevance_score >= 50 AS is_relevant FROM analyses")
def relevant_flag(spark, sf_dir):
    return analyses(spark, sf_dir).select("tender_id", (F.col("relevance_score") >= 50).alias("is_relevant"))


_BAND = "CASE WHEN relevance_score >= 80 THEN 'participate' WHEN relevance_score >= 70 THEN 'review' ELSE 'skip' END"


@query("score_bands", f"{WITH} SELECT {_BAND} AS band, count(*) AS n, count(*) FILTER (WHERE recommendation <> {_BAND}) AS mismatches FROM analyses GROUP BY 1")
def score_bands(spark, sf_dir):
    return analyses(spark, sf_dir).groupBy(F.expr(_BAND).alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("recommendation") != F.expr(_BAND)).alias("mismatches"))


_SUMMARY = "concat('Итог ', CAST(relevance_score AS STRING)) AS summary, CASE tender_id % 4 WHEN 0 THEN '[\"Срок\",\" Цена \",\"\"]' WHEN 1 THEN 'не список' WHEN 2 THEN '[]' END AS risks"
_METHOD = "CASE WHEN tender_id % 5 = 0 THEN '{\"procurement_method\":\"Аукцион\"}' ELSE raw_data END"


@query(
    "report_full",
    f"""{WITH}, a AS (SELECT *, {_SUMMARY} FROM analyses) SELECT CASE platform WHEN 'eis' THEN 'ЕИС' WHEN 'b2b_center' THEN 'B2B-Center' WHEN 'fabrikant' THEN 'Фабрикант' WHEN 'rts_tender' THEN 'РТС-тендер' WHEN 'tmk' THEN 'ТМК' ELSE 'Росатом' END AS platform,
    external_id, title, customer, region, price, currency, published_at, deadline, greatest(0, date_diff('day', DATE '1998-08-02', deadline::DATE))::INT AS days_left, law_type,
    CASE WHEN t.tender_id % 5 = 0 THEN 'Аукцион' ELSE '' END AS procurement_method, relevance_score AS score,
    CASE recommendation WHEN 'participate' THEN 'Участвовать' WHEN 'review' THEN 'Рассмотреть' WHEN 'skip' THEN 'Не участвовать' ELSE coalesce(recommendation, '') END AS recommendation, coalesce(summary, '') AS summary,
    CASE WHEN a.tender_id IS NULL THEN '' ELSE CASE t.tender_id % 4 WHEN 0 THEN 'Срок; Цена' WHEN 1 THEN 'не список' ELSE '' END END AS risks, url
    FROM tenders t LEFT JOIN a ON t.tender_id = a.tender_id""",
)
def report_full(spark, sf_dir):
    seen = analyses(spark, sf_dir).selectExpr("*", *items(_SUMMARY))
    rows = tenders(spark, sf_dir).withColumn("raw_data", F.expr(_METHOD)).join(seen, "tender_id", "left")
    return m.full_report(rows, F.expr(NOW_SPARK))


_STAGED = """tender_id % 7 AS search_number, tender_id % 10 = 3 AS recent_not, tender_id % 4 <> 1 AS soft_ok, tender_id % 3 <> 0 AS detail_loaded, detail_status, tender_id % 2 = 0 AS existed, tender_id % 5 <> 2 AS strict_ok,
  tender_id % 6 <> 1 AS region_ok, tender_id % 8 <> 3 AS criteria_ok, tender_id % 9 = 4 AS notified_before, tender_id % 11 = 5 AS ai_failed, CAST(tender_id % 101 AS INT) AS score, 50 AS min_score, tender_id % 12 <> 7 AS sent"""
_SOFT = "NOT duplicate AND NOT coalesce(recent_not, false) AND soft_ok"
_ASKED = f"{_SOFT} AND st <> 'failed'"
_STRICT = f"{_ASKED} AND strict_ok"
_FRESH = f"{_STRICT} AND region_ok AND criteria_ok AND NOT notified_before"


@query(
    "run_counters",
    f"""{WITH}, s AS (SELECT {_STAGED}, row_number() OVER (PARTITION BY tender_id // 3 ORDER BY tender_id) > 1 AS duplicate, lower(CASE WHEN detail_status = '' THEN 'partial' ELSE detail_status END) AS st FROM tenders)
    SELECT search_number, count(*) AS found, count(*) FILTER ({_SOFT}) AS soft_filtered, count(*) FILTER ({_STRICT}) AS filtered, count(*) FILTER ({_ASKED} AND NOT strict_ok) AS keyword_excluded,
    count(*) FILTER ({_SOFT} AND NOT existed) AS new, count(*) FILTER ({_FRESH} AND NOT ai_failed) AS analyzed, count(*) FILTER ({_FRESH} AND NOT ai_failed AND score >= min_score AND sent) AS notified,
    count(*) FILTER ({_STRICT} AND region_ok AND criteria_ok AND notified_before) AS skipped_duplicate, count(*) FILTER ({_STRICT} AND region_ok AND NOT criteria_ok) AS excluded_by_criteria,
    count(*) FILTER ({_STRICT} AND NOT region_ok) AS excluded_by_region, count(*) FILTER ({_SOFT} AND st = 'success' AND detail_loaded) AS details_loaded, count(*) FILTER ({_SOFT} AND st = 'partial') AS details_partial,
    count(*) FILTER ({_SOFT} AND st = 'failed') AS details_failed, count(*) FILTER ({_SOFT}) AS saved, count(*) FILTER ({_FRESH} AND ai_failed) AS ai_failed, search_number % 3 AS platform_errors FROM s GROUP BY search_number""",
)
def run_counters(spark, sf_dir):
    rows = tenders(spark, sf_dir).withColumn("lot", F.expr("tender_id div 3"))
    marked = funnel.mark_duplicates(rows, ["lot"], [F.col("tender_id")]).selectExpr("duplicate", *items(_STAGED))
    return funnel.counters(marked.withColumn("recent", F.when(F.col("recent_not"), False)), F.col("search_number") % 3)


@query(
    "profile_score_threshold",
    f"""{WITH}, p AS (SELECT q.*, n_name AS nation FROM ({PROFILES_SQL}) q JOIN nation ON profile_id // 10 = n_nationkey)
    SELECT t.tender_id, p.profile_id FROM tenders t JOIN analyses a ON t.tender_id = a.tender_id JOIN p ON t.region = p.nation WHERE p.enabled AND relevance_score >= min_ai_score""",
)
def profile_score_threshold(spark, sf_dir):
    """Tenders of a profile's nation whose score reaches the profile's own threshold."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("region"))
    own = profiles(spark, sf_dir).where("enabled").withColumn("key", F.expr("profile_id div 10")).join(nation, "key").select("profile_id", "region", "min_ai_score")
    scored = tenders(spark, sf_dir).select("tender_id", "region").join(analyses(spark, sf_dir).select("tender_id", "relevance_score"), "tender_id")
    return scored.join(own, "region").where(F.col("relevance_score") >= F.col("min_ai_score")).select("tender_id", "profile_id")


_SAID = """concat('Предмет <', CAST(relevance_score AS STRING), '> & "сроки"') AS summary, CASE tender_id % 3 WHEN 1 THEN {l}'Срок', 'a<b', 'Цена', 'четвёртый'{r} WHEN 2 THEN {l}'Один'{r} END AS risks, tender_id % 7 = 2 AS is_stub"""
_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(
    "alert_messages",
    f"""{WITH}, a AS (SELECT *, {_SAID.format(l="[", r="]")} FROM analyses)
    SELECT t.tender_id, CASE WHEN relevance_score >= 70 THEN '🔔' ELSE '📋' END || ' <b>Новый тендер (' || relevance_score || '/100)</b>' || chr(10) || chr(10) || '🏷️ <b>Площадка:</b> '
    || CASE platform WHEN 'eis' THEN 'ЕИС' WHEN 'b2b_center' THEN 'B2B-Center' WHEN 'fabrikant' THEN 'Фабрикант' WHEN 'rts_tender' THEN 'РТС-тендер' WHEN 'tmk' THEN 'ТМК' ELSE 'Росатом' END
    || chr(10) || '📋 ' || title || chr(10) || '💰 ' || CASE WHEN price IS NULL THEN 'не указан' ELSE replace(format('{{:,}}', CAST(format('{{:.0f}}', price) AS BIGINT)), ',', ' ') || ' RUB' END
    || ' | ⏰ до ' || coalesce(strftime(deadline, '%d.%m.%Y'), 'не указан') || chr(10) || '🏢 ' || CASE WHEN customer = '' THEN 'Заказчик не указан' ELSE customer END || chr(10) || chr(10)
    || '📝 ' || {_ESCAPED.format("summary")} || chr(10) || CASE t.tender_id % 3 WHEN 1 THEN chr(10) || '⚠️ <b>Риски:</b> Срок; a&lt;b; Цена' WHEN 2 THEN chr(10) || '⚠️ <b>Риски:</b> Один' ELSE '' END || chr(10)
    || '💡 <b>Рекомендация:</b> ' || CASE recommendation WHEN 'participate' THEN 'Участвовать' WHEN 'skip' THEN 'Пропустить' WHEN 'review' THEN 'На проверку' ELSE recommendation END
    || CASE WHEN is_stub THEN chr(10) || '<i>(ИИ-заглушка — используется вместо локального Ollama)</i>' ELSE '' END || chr(10) || chr(10) || '🔗 <a href="' || url || '">Открыть тендер</a>' AS message
    FROM tenders t JOIN a ON t.tender_id = a.tender_id""",
)
def alert_messages(spark, sf_dir):
    seen = analyses(spark, sf_dir).selectExpr("*", *items(_SAID.format(l="array(", r=")")))
    return tenders(spark, sf_dir).join(seen, "tender_id").select("tender_id", messages.alert_message().alias("message"))
