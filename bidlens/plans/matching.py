"""Queries on keywords, criteria, regions, profiles and the run funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import for_matching, tokens
from ..operators import criteria as c
from ..operators import keywords as k
from ..operators import profiles as pr
from ..operators import settings
from ..sources.tables import NOW_SPARK, NOW_SQL, PROFILES_SQL, RUNS_SQL, WITH, items, profile_runs, profiles, table, tenders
from .registry import query

INCLUDE, EXCLUDE = ["подшипник", "станок", "поставка оборудования", "техническое обслуживание"], ["кресло"]
LEAST = 25
_TEXT = "concat_ws(' ', title, description)"
_TOKENS = "regexp_extract_all(replace(lower({}), 'ё', 'е'), '[\\p{{L}}\\p{{N}}_-]+')"
_TOK = f"{WITH}, w AS (SELECT *, {_TEXT} AS txt, {_TOKENS.format(_TEXT)} AS tok FROM tenders)"


def _sql_contains(keyword: str) -> str:
    tests = []
    for w in keyword.split():
        found = [w, *(w[:-2] + s for s in k.SUFFIXES)] if len(w) >= k.STEM_FROM else [w]
        tests.append("list_has_any(tok, [" + ", ".join(f"'{f}'" for f in dict.fromkeys(found)) + "])")
    return "(" + " AND ".join(tests) + ")"


def _sql_any(keywords) -> str:
    return "(" + " OR ".join(_sql_contains(x) for x in keywords) + ")"


_SOFT = f"(NOT {_sql_any(EXCLUDE)} AND (length(txt) >= {LEAST} OR {_sql_any(INCLUDE)}))"
_GATE = "(platform <> 'b2b_center' OR (lower(detail_status) <> 'failed' AND trim(customer) <> '' AND price IS NOT NULL AND (deadline IS NOT NULL OR end_date IS NOT NULL)))"
_STRICT = f"({_SOFT} AND {_GATE} AND ({_sql_any([x for x in INCLUDE if x not in k.GENERIC])} OR ({_sql_any([x for x in INCLUDE if x in k.GENERIC])} AND {_sql_any(k.CONTEXT)})))"


def _texts(spark, sf_dir):
    return tenders(spark, sf_dir, heavy=True).withColumn("txt", F.concat_ws(" ", "title", "description"))


@query("kw_soft", f"{_TOK} SELECT tender_id, {_SOFT} AS ok FROM w")
def kw_soft(spark, sf_dir):
    df = _texts(spark, sf_dir)
    return df.select("tender_id", k.soft(df, "txt", INCLUDE, EXCLUDE, LEAST).alias("ok"))


@query("kw_strict", f"{_TOK} SELECT tender_id, {_STRICT} AS ok FROM w")
def kw_strict(spark, sf_dir):
    df = _texts(spark, sf_dir)
    return df.select("tender_id", k.strict(df, "txt", INCLUDE, EXCLUDE, LEAST).alias("ok"))


_WORDFORM = " UNION ALL ".join(f"SELECT tender_id, '{x}' AS keyword FROM w WHERE {_sql_contains(x)}" for x in [*INCLUDE, "ремонт станка"])


_LOUD = ["  Поставка   ОБОРУДОВАНИЯ", "Станок", "подшипники, оборудования", "Ёлка"]
_LOUD_STRICT = f"({_SOFT.replace(_sql_any(INCLUDE), _sql_any(['поставка оборудования', 'станок', 'подшипники оборудования', 'елка']))} AND {_GATE} AND ({_sql_any(['станок', 'подшипники оборудования', 'елка'])} OR ({_sql_any(['поставка оборудования'])} AND {_sql_any(k.CONTEXT)})))"


@query("kw_strict_spelling", f"{_TOK} SELECT tender_id, {_LOUD_STRICT} AS ok FROM w")
def kw_strict_spelling(spark, sf_dir):
    """Keywords with capitals, ё, blanks and punctuation mean the same as their plain forms."""
    df = _texts(spark, sf_dir)
    return df.select("tender_id", k.strict(df, "txt", _LOUD, EXCLUDE, LEAST).alias("ok"))


@query("kw_wordform", f"{_TOK} {_WORDFORM}")
def kw_wordform(spark, sf_dir):
    words = spark.createDataFrame([(x,) for x in [*INCLUDE, "ремонт станка"]], "keyword string")
    return k.keyword_matches(_texts(spark, sf_dir), words, id_col="tender_id", text_col="txt")


@query("kw_phrase_and", f"{_TOK} SELECT tender_id FROM w WHERE {_sql_contains('оборудования подшипник')}")
def kw_phrase_and(spark, sf_dir):
    return _texts(spark, sf_dir).where(k.with_tokens("txt", lambda w: k.contains(w, "оборудования подшипник"))).select("tender_id")


@query("kw_generic_context", f"{_TOK} SELECT tender_id, {_sql_any(k.CONTEXT)} AS in_context FROM w WHERE {_sql_any(k.GENERIC)}")
def kw_generic_context(spark, sf_dir):
    return _texts(spark, sf_dir).where(k.with_tokens("txt", lambda w: k.any_of(w, k.GENERIC))).select("tender_id", k.with_tokens("txt", lambda w: k.any_of(w, k.CONTEXT)).alias("in_context"))


@query("quality_gate", f"{WITH} SELECT tender_id, {_GATE} AS ok FROM tenders")
def quality_gate(spark, sf_dir):
    return tenders(spark, sf_dir).select("tender_id", k.quality_gate().alias("ok"))


_NORM = "trim(regexp_replace(lower(txt), '[^0-9a-zа-яё]+', ' ', 'g'))"
_GROUP = "[" + ", ".join(f"'{x}'" for x in k.QUERY_FORMS["станок"]) + "]"


@query("query_relevance", f"{_TOK} SELECT tender_id, contains({_NORM}, 'станки') OR list_has_any(string_split({_NORM}, ' '), {_GROUP}) AS ok FROM w")
def query_relevance(spark, sf_dir):
    return _texts(spark, sf_dir).select("tender_id", k.query_relevance(F.col("txt"), "станки").alias("ok"))


@query("query_relevance_substring", f"{_TOK} SELECT tender_id, len(list_filter({_GROUP}, lambda g: contains({_NORM}, g))) > 0 AS ok FROM w")
def query_relevance_substring(spark, sf_dir):
    return _texts(spark, sf_dir).select("tender_id", k.query_relevance_substring(F.col("txt"), "станков").alias("ok"))


@query(
    "doc_keywords",
    r"""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[\p{L}\p{N}_-]+'))) AS form FROM documents)
    SELECT form AS keyword, count(*) AS n FROM t WHERE form IN ('license', 'apache', 'general', 'version', 'the') GROUP BY 1""",
)
def doc_keywords(spark, sf_dir):
    words = spark.createDataFrame([("license",), ("apache",), ("general",), ("version",), ("the",)], "keyword string")
    exact = words.select("keyword", F.col("keyword").alias("form"))
    said = table(spark, sf_dir, "documents").select(F.explode(tokens(for_matching(F.col("text")))).alias("form"))
    return said.join(F.broadcast(exact), "form").groupBy("keyword").agg(F.count("*").alias("n"))


# --- criteria -------------------------------------------------------------------------------
_P = f"{WITH}, profiles AS ({PROFILES_SQL})"


def _sql_reason(now: str = NOW_SQL) -> str:
    def lim(value, limit, op, positive=False):
        return f"({limit} > 0 AND ({value} IS NULL OR {value} {op} {limit}))" if positive else f"({limit} IS NOT NULL AND ({value} IS NULL OR {value} {op} {limit}))"

    rules = [
        ("min_price", lim("price", "min_price", "<")),
        ("max_price", lim("price", "max_price", ">")),
        ("advance_required", "(want_advance AND NOT coalesce(advance_required, false))"),
        ("min_advance_percent", lim("advance_percent", "min_advance_percent", "<", True)),
        ("max_postpayment_days", lim("t.postpayment_days", "max_postpayment_days", ">")),
        ("min_application_security_percent", lim("application_security_percent", "min_application_security_percent", "<", True)),
        ("max_application_security_percent", lim("application_security_percent", "max_application_security_percent", ">")),
        ("min_contract_security_percent", lim("contract_security_percent", "min_contract_security_percent", "<", True)),
        ("max_contract_security_percent", lim("contract_security_percent", "max_contract_security_percent", ">")),
        ("min_submission_days", f"(min_submission_days > 0 AND deadline IS NOT NULL AND date_diff('second', {now}, deadline) < min_submission_days * 86400)"),
        ("deadline_missing", "(min_submission_days > 0 AND deadline IS NULL)"),
    ]
    return "CASE " + " ".join(f"WHEN {r} THEN '{n}'" for n, r in rules) + " END"


_LIMITS = """CASE WHEN tender_id % 2 = 0 THEN 20000.0 END AS min_price, CASE WHEN tender_id % 3 = 0 THEN 250000.0 END AS max_price, tender_id % 5 = 0 AS want_advance,
  CASE WHEN tender_id % 7 = 0 THEN 5.0 ELSE 0.0 END AS min_advance_percent, CASE WHEN tender_id % 11 = 1 THEN 60 END AS max_postpayment_days, 0.0 AS min_application_security_percent,
  CASE WHEN tender_id % 2 = 1 THEN 5.0 END AS max_application_security_percent, 0.0 AS min_contract_security_percent, CASE WHEN tender_id % 13 = 1 THEN 30.0 END AS max_contract_security_percent,
  CAST(tender_id % 8 AS INT) AS min_submission_days"""


@query("criteria_reason", f"{WITH} SELECT tender_id, {_sql_reason()} AS reason FROM (SELECT *, {_LIMITS} FROM tenders) t")
def criteria_reason(spark, sf_dir):
    return tenders(spark, sf_dir).selectExpr("*", *items(_LIMITS)).select("tender_id", c.reject_reason(F.expr(NOW_SPARK)).alias("reason"))


@query(
    "region_match",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN c_custkey % 3 = 0 WHEN 2 THEN false ELSE c_custkey % 5 = 0 END AS ok FROM customer""",
)
def region_match(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "CASE c_custkey % 4 WHEN 2 THEN ' ' WHEN 3 THEN 'Московская область; г. Тверь' ELSE CASE WHEN c_custkey % 3 = 0 THEN 'город Москва' ELSE 'Московская обл.' END END AS region",
        "CASE c_custkey % 4 WHEN 0 THEN array() WHEN 1 THEN array('Москва') WHEN 2 THEN array('Москва') ELSE CASE WHEN c_custkey % 5 = 0 THEN array(' ', 'ТВЕРЬ') ELSE array('Респ. Коми') END END AS wanted",
    )
    return rows.select("c_custkey", c.regions_match(F.col("region"), F.col("wanted")).alias("ok"))


_DAYS = "CASE platform WHEN 'eis' THEN 700 WHEN 'tmk' THEN 60 ELSE 365 END"


@query("lookback", f"{WITH} SELECT tender_id FROM tenders WHERE published_at IS NULL OR date_diff('second', published_at, {NOW_SQL}) <= ({_DAYS}) * 86400")
def lookback(spark, sf_dir):
    return tenders(spark, sf_dir).where(c.in_lookback(F.expr(NOW_SPARK), F.expr(_DAYS))).select("tender_id")


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'Определение поставщика ЗАВЕРШЕНО' WHEN 'P' THEN 'Контракт заключен' ELSE 'Подача заявок' END"


@query("drop_finished", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def drop_finished(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(~c.finished(F.expr(_STATUS))).select("o_orderkey")


@query(
    "validate_profiles",
    f"""{_P} SELECT profile_id, array_to_string(list_filter([CASE WHEN max_price < 0 THEN 'max_price_negative' END, CASE WHEN min_price > max_price THEN 'min_price_above_max' END,
    CASE WHEN min_application_security_percent > max_application_security_percent THEN 'min_application_security_percent_above_max' END,
    CASE WHEN min_contract_security_percent > max_contract_security_percent THEN 'min_contract_security_percent_above_max' END,
    CASE WHEN min_ai_score > 100 THEN 'min_ai_score_range' END], lambda v: v IS NOT NULL), ',') AS violations FROM profiles""",
)
def validate_profiles(spark, sf_dir):
    return profiles(spark, sf_dir).select("profile_id", F.array_join(c.violations(), ",").alias("violations"))


@query(
    "clamped_criteria",
    f"""{_P} SELECT profile_id, least(100, greatest(0, min_ai_score - 20))::INT AS min_ai_score, CASE WHEN len(list_filter(regions, lambda x: trim(x) <> '')) = 0 THEN '' ELSE trim(list_filter(regions, lambda x: trim(x) <> '')[1]) END AS regions FROM profiles""",
)
def clamped_criteria(spark, sf_dir):
    """Criteria bring a score into range where a profile with it is refused, and clean their lists."""
    rows = profiles(spark, sf_dir).withColumn("min_ai_score", F.col("min_ai_score") - 20).withColumn("regions", F.flatten(F.array("regions", F.transform("regions", F.lower))))
    kept = rows.withColumns(c.clamped(("regions",)))
    return kept.select("profile_id", "min_ai_score", F.array_join("regions", ",").alias("regions"))


@query("list_profiles", f"{_P} SELECT profile_id, user_id, name, enabled, min_price FROM profiles")
def list_profiles(spark, sf_dir):
    return profiles(spark, sf_dir).orderBy(F.desc("enabled"), F.lower("name"), "profile_id").select("profile_id", "user_id", "name", "enabled", "min_price")


@query("enabled_users", f"{_P} SELECT DISTINCT trim(user_id) AS user_id FROM profiles WHERE enabled")
def enabled_users(spark, sf_dir):
    return profiles(spark, sf_dir).where("enabled").select(F.trim("user_id").alias("user_id")).distinct().orderBy("user_id")


def _sql_words() -> str:
    ends = "[" + ", ".join(f"'{s}'" for s in k.SUFFIXES) + "]"
    return f"""kw AS (SELECT DISTINCT unnest(keywords) AS keyword FROM profiles),
    kf AS (SELECT keyword, unnest({_TOKENS.format("keyword")}) AS word FROM kw),
    ff AS (SELECT keyword, word, unnest(CASE WHEN length(word) >= {k.STEM_FROM} THEN list_concat([word], list_transform({ends}, lambda s: left(word, length(word) - 2) || s)) ELSE [word] END) AS form FROM kf),
    nw AS (SELECT keyword, count(DISTINCT word) AS n FROM kf GROUP BY 1),
    said AS (SELECT tender_id, unnest(list_distinct({_TOKENS.format(_TEXT)})) AS form FROM tenders),
    hit AS (SELECT tender_id, said.form, keyword, word FROM said JOIN ff ON said.form = ff.form),
    m AS (SELECT tender_id, hit.keyword FROM hit JOIN nw ON hit.keyword = nw.keyword GROUP BY tender_id, hit.keyword, nw.n HAVING count(DISTINCT word) = nw.n)"""


@query(
    "match_profiles",
    f"""{_P}, {_sql_words()}, pk AS (SELECT profile_id, unnest(keywords) AS keyword FROM profiles WHERE enabled),
    pair AS (SELECT DISTINCT profile_id, tender_id FROM pk JOIN m ON pk.keyword = m.keyword)
    SELECT p.profile_id, t.tender_id, {_sql_reason()} AS reason FROM pair JOIN profiles p ON pair.profile_id = p.profile_id JOIN tenders t ON pair.tender_id = t.tender_id
    WHERE list_contains(p.regions, t.region)""",
)
def match_profiles(spark, sf_dir):
    kept = pr.match_keywords(_texts(spark, sf_dir), profiles(spark, sf_dir).where("enabled"), text_col="txt")
    return kept.select("profile_id", "tender_id", c.reject_reason(F.expr(NOW_SPARK)).alias("reason"))


#: Profiles of which some have no keywords, some exclude words, some ask for a time before the deadline, and few have limits besides.
_OPEN = {
    "keywords": "CASE WHEN profile_id % 3 = 0 THEN CAST({l}{r} AS {t}) WHEN profile_id % 3 = 1 THEN CAST({l}' '{r} AS {t}) ELSE CAST(keywords AS {t}) END", "exclusions": "CASE WHEN profile_id % 2 = 0 THEN CAST({l}'кресло', 'Ремонт'{r} AS {t}) ELSE CAST({l}{r} AS {t}) END",
    "min_submission_days": "CAST(CASE WHEN profile_id % 4 = 0 THEN 2 ELSE 0 END AS INT)", "max_postpayment_days": "CASE WHEN profile_id % 5 = 0 THEN max_postpayment_days END", "want_advance": "profile_id % 7 = 0", "min_advance_percent": "0.0",
    "max_application_security_percent": "CAST(NULL AS DOUBLE)", "min_contract_security_percent": "0.0", "max_contract_security_percent": "CAST(NULL AS DOUBLE)",
}
_OPEN_SQL = f"o AS (SELECT * REPLACE ({', '.join(f'{v.format(l="[", r="]", t="VARCHAR[]")} AS {x}' for x, v in _OPEN.items() if x != 'exclusions')}), {_OPEN['exclusions'].format(l='[', r=']', t='VARCHAR[]')} AS exclusions FROM profiles WHERE enabled)"


@query(
    "match_profiles_open",
    f"""{_P}, {_OPEN_SQL}, {_sql_words().replace("FROM profiles", "FROM (SELECT keywords FROM o UNION ALL SELECT exclusions FROM o)")},
    says AS (SELECT tender_id, list(keyword) AS said FROM m GROUP BY 1), tt AS (SELECT tenders.*, coalesce(said, []) AS said, {_TEXT} AS txt FROM tenders LEFT JOIN says ON tenders.tender_id = says.tender_id),
    r AS (SELECT p.profile_id, t.tender_id, {_sql_reason()} AS reason FROM o p JOIN tt t ON (list_contains(p.regions, t.region))
      AND CASE WHEN len(list_filter(keywords, lambda x: trim(x) <> '')) > 0 THEN list_has_any(keywords, said) ELSE length(txt) >= 10 AND {_GATE} AND NOT list_has_any(exclusions, said) END)
    SELECT profile_id, tender_id FROM r WHERE reason IS NULL""",
)
def match_profiles_open(spark, sf_dir):
    """Pairs that pass, of profiles with keywords and of profiles without any."""
    asked = {x: F.expr(v.format(l="array(", r=")", t="array<string>")) for x, v in _OPEN.items()}
    ps = profiles(spark, sf_dir).where("enabled")
    return pr.match_all(_texts(spark, sf_dir), ps.select(*[x for x in ps.columns if x not in asked], *[v.alias(x) for x, v in asked.items()]), F.expr(NOW_SPARK), text_col="txt")


@query(
    "substring_matches",
    f"""{_P}, q AS (SELECT DISTINCT unnest(keywords) AS query FROM profiles UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 10 = 0 UNION SELECT * FROM (VALUES ('станками'), ('ав'), ('№ 5%'), ('  '))),
    f AS (SELECT query, trim(regexp_replace(lower(query), '[^0-9a-zа-яё]+', ' ', 'g')) AS plain FROM q),
    g AS (SELECT query, plain, CASE {" ".join("WHEN plain IN (" + ", ".join(repr(x) for x in forms) + ") THEN [" + ", ".join(repr(x) for x in forms) + "]" for forms in k.QUERY_FORMS.values())} ELSE [plain] END AS forms FROM f WHERE plain <> ''),
    s AS (SELECT tender_id, external_id, trim(regexp_replace(lower({_TEXT}), '[^0-9a-zа-яё]+', ' ', 'g')) AS said FROM tenders)
    SELECT tender_id, query FROM s JOIN g ON CASE WHEN regexp_full_match(plain, '[0-9]+') THEN external_id = plain ELSE len(list_filter(forms, lambda x: contains(said, x))) > 0 END""",
)
def substring_matches(spark, sf_dir):
    """All profiles' keywords, some ids and some odd queries at once."""
    ids = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").cast("string").alias("query"))
    asked = profiles(spark, sf_dir).select(F.explode("keywords").alias("query")).unionByName(ids).unionByName(spark.createDataFrame([("станками",), ("ав",), ("№ 5%",), ("  ",)], "query string"))
    return k.substring_matches(_texts(spark, sf_dir), asked, id_col="tender_id", text_col="txt", external_id_col="external_id")


@query(
    "run_funnel",
    f"""{_TOK}, s AS (SELECT *, {_LIMITS}, date_diff('second', published_at, {NOW_SQL}) <= ({_DAYS}) * 86400 AS recent, {_SOFT} AS soft_ok, detail_status <> 'failed' AS detail_ok, {_STRICT} AS strict_ok FROM w),
    f AS (SELECT *, {_sql_reason().replace("t.", "")} AS reason FROM s)
    SELECT count(*) AS found, count(*) FILTER (WHERE recent AND soft_ok) AS filtered, count(*) FILTER (WHERE recent AND soft_ok AND detail_ok) AS details_loaded,
    count(*) FILTER (WHERE recent AND soft_ok AND NOT detail_ok) AS details_failed, count(*) FILTER (WHERE recent AND soft_ok AND detail_ok AND NOT strict_ok) AS keyword_excluded,
    count(*) FILTER (WHERE recent AND soft_ok AND detail_ok AND strict_ok AND reason IS NOT NULL) AS excluded_by_criteria,
    count(*) FILTER (WHERE recent AND soft_ok AND detail_ok AND strict_ok AND reason IS NULL) AS passed FROM f""",
)
def run_funnel(spark, sf_dir):
    df = _texts(spark, sf_dir).selectExpr("*", *items(_LIMITS))
    now = F.expr(NOW_SPARK)
    stages = {"recent": c.in_lookback(now, F.expr(_DAYS)), "soft_ok": k.soft(df, "txt", INCLUDE, EXCLUDE, LEAST), "detail_ok": F.col("detail_status") != "failed", "strict_ok": k.strict(df, "txt", INCLUDE, EXCLUDE, LEAST), "reason": c.reject_reason(now)}
    kept = F.col("recent") & F.col("soft_ok")
    strict = kept & F.col("detail_ok") & F.col("strict_ok")
    return df.withColumns(stages).agg(
        F.count("*").alias("found"),
        F.count_if(kept).alias("filtered"),
        F.count_if(kept & F.col("detail_ok")).alias("details_loaded"),
        F.count_if(kept & ~F.col("detail_ok")).alias("details_failed"),
        F.count_if(kept & F.col("detail_ok") & ~F.col("strict_ok")).alias("keyword_excluded"),
        F.count_if(strict & F.col("reason").isNotNull()).alias("excluded_by_criteria"),
        F.count_if(strict & F.col("reason").isNull()).alias("passed"),
    )


_SUMS = "count(*) AS runs, sum(found)::BIGINT AS found, sum(filtered)::BIGINT AS filtered, sum(new_count)::BIGINT AS new_count, sum(notified)::BIGINT AS notified"


def _sums():
    return [F.count("*").alias("runs"), *[F.sum(x).alias(x) for x in ("found", "filtered", "new_count", "notified")]]


@query("profile_stats", f"WITH r AS ({RUNS_SQL}) SELECT profile_id, {_SUMS}, max(finished_at) AS last_run FROM r GROUP BY 1")
def profile_stats(spark, sf_dir):
    return profile_runs(spark, sf_dir).groupBy("profile_id").agg(*_sums(), F.max("finished_at").alias("last_run"))


@query(
    "user_run_stats",
    f"WITH r AS ({RUNS_SQL}) SELECT c_nationkey AS user_id, count(DISTINCT profile_id) AS profiles, {_SUMS}, max(search_number) AS search_number FROM r JOIN customer ON profile_id = c_custkey GROUP BY 1",
)
def user_run_stats(spark, sf_dir):
    rows = profile_runs(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_nationkey").alias("user_id")), "profile_id")
    # two steps, so that no distinct count is needed: profiles first, users after
    each = rows.groupBy("user_id", "profile_id").agg(*_sums(), F.max("search_number").alias("search_number"))
    return each.groupBy("user_id").agg(F.count("*").alias("profiles"), *[F.sum(x).alias(x) for x in ("runs", "found", "filtered", "new_count", "notified")], F.max("search_number").alias("search_number"))


@query("cap_per_source", f"{WITH} SELECT tender_id, platform FROM tenders QUALIFY row_number() OVER (PARTITION BY platform ORDER BY published_at DESC, tender_id) <= 50")
def cap_per_source(spark, sf_dir):
    return c.cap(tenders(spark, sf_dir), "platform", [F.desc("published_at"), F.col("tender_id")], 50).select("tender_id", "platform")


@query("enabled_sources", f"{WITH} SELECT tender_id, platform FROM tenders WHERE platform IN ('eis', 'tmk')")
def enabled_sources(spark, sf_dir):
    chosen = spark.createDataFrame([("eis", True), ("tmk", True), ("rosatom", False)], "platform string, enabled boolean").where("enabled")
    return tenders(spark, sf_dir).join(F.broadcast(chosen), "platform", "left_semi").select("tender_id", "platform")


@query("clean_platforms", f"{WITH} SELECT tender_id, CASE platform WHEN 'fabrikant' THEN 'fabrikant,eis' WHEN 'eis' THEN 'eis,fabrikant' ELSE concat(platform, ',fabrikant,eis') END AS platforms FROM tenders")
def clean_platforms(spark, sf_dir):
    listed = F.array("platform", F.lit("fabricant"), F.lit("eis"), F.lit("nowhere"), F.lit("fabrikant"))
    return tenders(spark, sf_dir).select("tender_id", F.array_join(settings.clean_platforms(listed), ",").alias("platforms"))


_ASKED = {
    "keywords": "CASE WHEN c_custkey % 3 = 0 THEN {l}'насос', CAST(c_custkey AS STRING){r} END", "platforms": "CASE WHEN c_custkey % 4 = 0 THEN {l}'tmk'{r} WHEN c_custkey % 4 = 1 THEN {l}{r} END",
    "exclusions": "CASE WHEN c_custkey % 5 = 0 THEN {l}'кресло'{r} END", "regions": "CASE WHEN c_custkey % 6 = 0 THEN {l}'Тверь'{r} END",
}
_OWN = {"keywords": "keywords", "platforms": "CASE WHEN profile_id % 2 = 0 THEN {l}'eis', 'rosatom'{r} ELSE {l}{r} END", "exclusions": "{l}{r}", "regions": "regions"}
_DEFAULTS = {"keywords": ["подшипник"], "platforms": ["eis"], "exclusions": ["мебель", "стол"]}
_FIRST = ", ".join(
    f"array_to_string(CASE WHEN len(a_{x}) > 0 THEN a_{x} WHEN len(o_{x}) > 0 THEN o_{x} ELSE CAST([{', '.join(repr(v) for v in _DEFAULTS.get(x, []))}] AS VARCHAR[]) END, ',') AS {x}" for x in settings.SETTINGS
)


@query(
    "resolve_all_settings",
    f"""{_P}, o AS (SELECT profile_id, {", ".join(f"CAST({v.format(l='[', r=']')} AS VARCHAR[]) AS o_{x}" for x, v in _OWN.items())} FROM profiles WHERE enabled),
    a AS (SELECT c_custkey, c_nationkey * 10 + ascii(c_mktsegment) % 10 AS profile_id, {", ".join(f"CAST({v.format(l='[', r=']')} AS VARCHAR[]) AS a_{x}" for x, v in _ASKED.items())} FROM customer)
    SELECT c_custkey, {_FIRST} FROM a LEFT JOIN o ON a.profile_id = o.profile_id""",
)
def resolve_all_settings(spark, sf_dir):
    asked = [f"CAST({v.format(l='array(', r=')')} AS array<string>) AS asked_{x}" for x, v in _ASKED.items()]
    searches = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CAST(c_nationkey * 10 + ascii(c_mktsegment) % 10 AS BIGINT) AS profile_id", *asked)
    own = profiles(spark, sf_dir).selectExpr("profile_id", "enabled", *[f"CAST({v.format(l='array(', r=')')} AS array<string>) AS {x}" for x, v in _OWN.items()])
    return settings.resolve(searches, own, _DEFAULTS).select("c_custkey", *[F.array_join(x, ",").alias(x) for x in settings.SETTINGS])


@query(
    "resolve_settings",
    f"""{_P} SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'аргумент' END, p.name, 'по умолчанию') AS keywords FROM customer
    LEFT JOIN (SELECT profile_id, name FROM profiles WHERE enabled) p ON p.profile_id = c_nationkey * 10 + ascii(c_mktsegment) % 10""",
)
def resolve_settings(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr("c_nationkey * 10 + ascii(c_mktsegment) % 10").cast("long").alias("profile_id"))
    own = profiles(spark, sf_dir).where("enabled").select("profile_id", "name")
    argument = F.when(F.col("c_custkey") % 3 == 0, "аргумент")
    return rows.join(own, "profile_id", "left").select("c_custkey", F.coalesce(argument, "name", F.lit("по умолчанию")).alias("keywords"))


@query(
    "default_profiles",
    f"{_P} SELECT DISTINCT concat('user', CAST(c_custkey % 12 AS STRING)) AS user_id, 'Основной' AS name FROM customer WHERE concat('user', CAST(c_custkey % 12 AS STRING)) NOT IN (SELECT user_id FROM profiles)",
)
def default_profiles(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.expr("concat('user', CAST(c_custkey % 12 AS STRING))").alias("user_id"))
    return settings.default_profiles(users, profiles(spark, sf_dir), users.distinct()).select("user_id", "name")


@query(
    "default_profile_criteria",
    f"{_P} SELECT user_id, 'Основной' AS name, min(c_acctbal) AS min_price, count(*) AS n FROM (SELECT concat('user', CAST(c_custkey % 12 AS STRING)) AS user_id, c_acctbal FROM customer) WHERE user_id NOT IN (SELECT user_id FROM profiles) GROUP BY 1",
)
def default_profile_criteria(spark, sf_dir):
    """The criteria that a user had before go into the profile."""
    users = table(spark, sf_dir, "customer").select(F.expr("concat('user', CAST(c_custkey % 12 AS STRING))").alias("user_id"), "c_acctbal")
    criteria = users.groupBy("user_id").agg(F.min("c_acctbal").alias("min_price"), F.count("*").alias("n"))
    return settings.default_profiles(users, profiles(spark, sf_dir), criteria).select("user_id", "name", "min_price", "n")
