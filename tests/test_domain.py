"""Domain rules on small fixtures: word forms, terms, risk, board, answers, extraction."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from bidlens.functions import text as t
from bidlens.operators import answers, board, criteria, extract, keywords, normalize, risk, state


@pytest.mark.parametrize(
    ("text", "word", "expected"),
    [
        ("Поставка станков для металлообработки", "станок", True),
        ("Поставка подшипников для оборудования", "подшипник", True),
        ("Поставка офисных кресел и столов", "станок", False),
        ("Строительство станции и монтаж оборудования", "станок", False),
        ("ёлка и муфта", "муфта", True),
        ("муфты", "муфта", False),
    ],
)
def test_word_forms(spark, text, word, expected):
    row = spark.createDataFrame([(text,)], "x string").select(keywords.contains(t.tokens(t.for_matching(F.col("x"))), word)).first()
    assert row[0] is expected


def test_json_is_flattened_at_any_depth(spark):
    cases = [
        ('{"a":{"b":{"c":{"d":["x",{"Срок поставки":"5 дней"},7,true,null]}}},"e":" "}', "x Срок поставки 5 дней 7 true"),
        ('["a \\"b\\" \\u0436", [["глубоко"]]]', 'a "b" ж глубоко'), ("не json {", "не json {"), ('{"a":', '{"a":'), (None, ""), ("  ", ""), ('{"k":"1:2"}', "1:2"),
    ]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "x string").select(t.flatten_json(F.col("x"))).collect()
    assert [r[0] for r in rows] == [want for _, want in cases]


def test_keywords_are_compared_as_texts_are(spark):
    df = spark.createDataFrame([("поставка оборудования для кухни",), ("Насос и муфта",)], "txt string").selectExpr("txt", "'eis' AS platform", "'ok' AS detail_status", "'c' AS customer", "1.0 AS price", "current_timestamp() AS deadline", "current_timestamp() AS end_date")
    for keyword in ("Поставка оборудования", "поставка  оборудования ", "ПОСТАВКА ОБОРУДОВАНИЯ"):
        assert [r[0] for r in df.select(keywords.strict(df, "txt", [keyword], [])).collect()] == [False, False]
    assert [r[0] for r in df.select(keywords.strict(df, "txt", ["насос, муфта"], [])).collect()] == [False, True]
    relevant = df.select(keywords.query_relevance(F.col("txt"), "НАСОС,"), keywords.query_relevance_substring(F.col("txt"), "12345", F.lit("12345")), keywords.query_relevance_substring(F.col("txt"), "12345", F.lit("9"))).collect()
    assert [tuple(r) for r in relevant] == [(False, True, False), (True, True, False)]


def test_regions_in_normal_form(spark):
    cases = [("г. Санкт-Петербург", "санкт петербург"), ("Город  Москва", "москва"), ("Московская обл.", "московская область"), ("«Респ. Коми», ", "республика коми"), ("Ёлкин — край", "елкин край"), ("Нижний город", "нижний город"), (None, None)]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "x string").select(criteria.normal_region(F.col("x"))).collect()
    assert [r[0] for r in rows] == [want for _, want in cases]


def test_token_join_equals_the_regex_rule(spark):
    rng = random.Random(5)
    stems = ["станок", "подшип", "муфт", "насос", "редуктор", "маз"]
    ends = ["", "а", "ов", "ник", "ция", "ами", "ок", "и", "-1"]
    rows = [(i, " ".join(rng.choice(stems)[: rng.randint(3, 8)] + rng.choice(ends) for _ in range(6))) for i in range(300)]
    words = ["станок", "подшипник", "насосы", "редуктор", "маз", "редуктор станок"]

    def rule(text, keyword):
        def one(w):
            if re.search(rf"(?<![\w-]){re.escape(w)}(?![\w-])", text):
                return True
            found = re.findall(rf"(?<![\w-]){re.escape(w[:-2])}([\w-]*)(?![\w-])", text) if len(w) >= 6 else []
            return any(x in keywords.SUFFIXES for x in found)

        return all(one(w) for w in keyword.split())

    texts = spark.createDataFrame(rows, "id long, x string")
    got = {tuple(r) for r in keywords.keyword_matches(texts, spark.createDataFrame([(w,) for w in words], "keyword string"), id_col="id", text_col="x").collect()}
    assert got == {(i, w) for i, x in rows for w in words if rule(x, w)}


def test_terms_from_text(spark):
    text = "Условия оплаты: аванс 30%. Отсрочка платежа 45 календарных дней. Обеспечение заявки 2%. ОБЕСПЕЧЕНИЕ исполнения контракта 10%."
    df = spark.createDataFrame([(text,)], "x string")
    got = df.select(
        t.percent_near(F.col("x"), t.ADVANCE), t.days_near(F.col("x"), t.POSTPAYMENT), t.percent_near(F.col("x"), t.APPLICATION_SECURITY), t.percent_near(F.col("x"), t.CONTRACT_SECURITY)
    ).first()
    assert tuple(got) == (30.0, 45, 2.0, 10.0)


def test_explicit_terms_win(spark):
    df = spark.createDataFrame([("аванс 30%", None, 20.0, None, None, None, False)], "description string, raw_data string, advance_percent double, postpayment_days int, application_security_percent double, contract_security_percent double, advance_required boolean")
    got = normalize.enrich_terms(df).first()
    assert got["advance_percent"] == 20.0 and got["advance_required"] is True


NOW = "2026-09-01 00:00:00"


def tender(spark, **changes):
    row = {"price": 1e6, "deadline": dt.datetime(2026, 10, 1), "customer": "Завод", "application_security_percent": 2.0, "contract_security_percent": 10.0, "advance_required": False, "advance_percent": None, "detail_status": "success"} | changes
    schema = "price double, deadline timestamp_ntz, customer string, application_security_percent double, contract_security_percent double, advance_required boolean, advance_percent double, detail_status string"
    return risk.assess(spark.createDataFrame([tuple(row.values())], schema), F.expr(f"TIMESTAMP_NTZ'{NOW}'")).first()


@pytest.mark.parametrize(
    ("changes", "level", "code"),
    [
        ({}, "LOW", None),
        ({"price": None, "deadline": None, "customer": ""}, "UNKNOWN", "insufficient_data"),
        ({"price": None}, "MEDIUM", "insufficient_data"),
        ({"deadline": dt.datetime(2026, 9, 3)}, "HIGH", "short_deadline"),
        ({"deadline": dt.datetime(2026, 9, 4)}, "HIGH", "short_deadline"),
        ({"deadline": dt.datetime(2026, 9, 6)}, "MEDIUM", "short_deadline"),
        ({"deadline": dt.datetime(2026, 8, 1)}, "HIGH", "deadline_passed"),
        ({"application_security_percent": 12.0}, "MEDIUM", "high_application_security"),
        ({"contract_security_percent": 45.0}, "MEDIUM", "high_contract_security"),
        ({"advance_required": True}, "LOW", "unclear_advance"),
        ({"detail_status": "partial"}, "MEDIUM", "incomplete_detail_data"),
    ],
)
def test_risk(spark, changes, level, code):
    got = tender(spark, **changes)
    assert got["level"] == level
    assert (code is None and not got["factors"]) or code in [f["code"] for f in got["factors"]]


def test_board_fold(spark):
    at = [dt.datetime(2026, 1, d) for d in range(1, 9)]
    moves = ["participating", "reviewing", "reviewing", "won", "participating", "skipped", "won", "lost"]
    force = [False] * 6 + [True, False]
    events = spark.createDataFrame([(7, i, at[i], moves[i], force[i]) for i in range(8)], "tender_id long, event_id long, ts timestamp_ntz, value string, force boolean")
    got = board.replay_status(events).first()
    assert got["status"] == "won" and got["updated_at"] == at[6]
    assert [h["new"] for h in board.status_history(events).orderBy("event_id").collect()] == ["reviewing", "participating", "skipped", "won"]
    assert board.replay_status(events, "year").first() == got and got["moves"] == 4


def test_regions(spark):
    rows = [("Москва", ["г. Москва"], True), ("Московская область", ["Москва"], False), ("Моск. обл.", [], True), ("", ["Москва"], False), ("Тула; Республика Коми", ["респ. коми"], True)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "r string, w array<string>")
    assert [r[0] for r in df.select(criteria.regions_match(F.col("r"), F.col("w"))).collect()] == [x for *_, x in rows]


def test_answers(spark):
    rows = ['{"relevance_score": 85, "recommendation": "participate"}', '<think>{"a":1}</think> {"relevance_score": "140"}', "no", '{"relevance_score": "x"}', None]
    got = answers.normalize(answers.parse(spark.createDataFrame([(r,) for r in rows], "content string")), allow_stub=True).collect()
    assert [r["relevance_score"] for r in got] == [85, 100, 50, 50, 50]
    assert [r["is_stub"] for r in got] == [False, False, True, True, True]


def test_cards_beyond_a_million(spark):
    pages = spark.range(1).select(F.col("id").alias("page_id"), F.repeat(F.lit("<c>x"), 1_000_003).alias("html"))
    assert extract.cards(pages, "<c>").count() == 1_000_003


def test_pages_of_a_customer_are_bounded(spark):
    """A page holds one order's row, so no customer's orders are gathered; pages of many rows are extracted as well."""
    from bidlens.plans import extract as plans

    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    rows = plans._pages(spark, sf, "'<tr>'").select(F.size(F.split("html", "<tr>")) - 1).toPandas().iloc[:, 0]
    assert rows.sum() == orders and rows.max() == 1
    many = "<table>" + "".join(f"<tr><td>{i}</td><td>b{i}</td></tr>" for i in range(300)) + "</table>"
    got = extract.table_rows(spark.createDataFrame([(1, many)], "page_id long, html string")).collect()
    assert sorted((r["row_no"], r["cells"][1]) for r in got) == [(i, f"b{i}") for i in range(300)]


def test_extraction_and_feed(spark, tmp_path):
    html = '<table class="search-results"><tr><th>a</th></tr><tr><td>4571794</td><td>Поставка &quot;подшипников&quot;</td><td>12 345,67 руб.</td><td>11.09.2026 10:15</td></tr></table>'
    row = extract.table_rows(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert row["cells"][1] == 'Поставка "подшипников"'
    df = spark.createDataFrame([tuple(row["cells"][2:])], "m string, d string")
    assert tuple(df.select(extract.money(F.col("m")), t.dotted_time(F.col("d"), "Europe/Moscow")).first()) == (12345.67, dt.datetime(2026, 9, 11, 7, 15))
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>T</title><link>http://x/notice?regNumber=0123456</link><pubDate>Fri, 11 Sep 2026 10:15:00 +0300</pubDate></item></channel></rss>")
    item = extract.feed(spark, str(tmp_path / "feed.xml")).first()
    assert item["external_id"] == "0123456" and item["published_at"].hour == 7


def test_upsert_keeps_first_seen(spark):
    one, two = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1)
    schema = "k long, price double, first_seen_at timestamp_ntz, updated_at timestamp_ntz"
    old = spark.createDataFrame([(1, 5.0, one, one), (2, 6.0, one, one)], schema)
    new = spark.createDataFrame([(1, 7.0, two, two), (3, 8.0, two, two)], schema)
    assert {tuple(r) for r in state.upsert(old, new, "k").collect()} == {(1, 7.0, one, two), (2, 6.0, one, one), (3, 8.0, two, two)}
    events = {r["k"]: r["event_type"] for r in state.change_events(old, new, "k", ["price"]).collect()}
    assert events == {1: "updated", 3: "created"}


def test_json_texts_of_any_length_and_depth(spark):
    """A million characters, as many escapes, and 200 levels: no pattern may recurse once a character."""
    deep = '{"a":' * 200 + '"внутри"' + "}" * 200
    rows = [("long", '{"text":"' + "я" * 1_000_000 + '"}'), ("escaped", '["' + '\\"' * 500_000 + '"]'), ("deep", deep), ("plain", "x" * 1_000_000), ("wide", "[" + ",".join('{"k":"v"}' for _ in range(50_000)) + "]")]
    got = {r["name"]: r for r in spark.createDataFrame(rows, "name string, j string").select("name", t.flatten_json(F.col("j")).alias("flat")).selectExpr("name", "length(flat) AS n", "left(flat, 20) AS head").collect()}
    assert {k: v["n"] for k, v in got.items()} == {"long": 1_000_000, "escaped": 500_000, "deep": 6, "plain": 1_000_000, "wide": 2 * 50_000 - 1}
    assert got["deep"]["head"] == "внутри" and got["escaped"]["head"] == '"' * 20


def test_upsert_takes_new_rows_whose_time_is_unknown(spark):
    schema = "k long, price double, first_seen_at timestamp, updated_at timestamp"
    at = dt.datetime(2026, 1, 1)
    old = spark.createDataFrame([(1, 5.0, at, at), (3, 9.0, at, at)], schema)
    new = spark.createDataFrame([(1, None, at, None), (2, 7.0, None, None)], schema)
    got = {r["k"]: (r["price"], r["first_seen_at"], r["updated_at"]) for r in state.upsert(old, new, "k").collect()}
    assert got == {1: (None, at, None), 2: (7.0, None, None), 3: (9.0, at, at)}


def test_a_text_in_json_is_parsed_once_and_a_line_made_once(spark):
    """Neither flattening nor a line of the prompt makes its value again for each test of it."""
    df = spark.range(1).select(F.col("id").cast("string").alias("c"), F.col("id").alias("d"))
    flat = df.select(t.flatten_json(F.get_json_object("c", "$.a")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert flat.count("get_json_object(") == 1
