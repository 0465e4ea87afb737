"""Profiles without keywords, substring search by grams, and links with their containers."""

import random

from pyspark.sql import functions as F

from bidlens.functions import text as t
from bidlens.operators import containers as box
from bidlens.operators import keywords as k
from bidlens.plans.all import QUERIES

SF = "/root/testdata/sf0.001"


def test_open_profiles_are_matched_without_a_cross_join(spark):
    plan = QUERIES["match_profiles_open"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_substrings_equal_a_scan(spark):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choices("абв гд1,", k=rng.randint(0, 30))), str(100 + i)) for i in range(200)] + [(900, None, None), (901, "станки и лебедкою", "7")]
    queries = ["а", "аб", "абв", "г д", "бв г", "№", "", "105", "станок", "ЛЕБЕДКА", "абвгдабвгдабвгд"]
    df = spark.createDataFrame(texts, "id long, txt string, own string")
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    got = {(r["id"], r["query"]) for r in k.substring_matches(df, asked, id_col="id", text_col="txt", external_id_col="own").collect()}
    want = set()
    said = {r["id"]: r["s"] for r in df.select("id", t.for_search(F.col("txt")).alias("s")).collect()}
    for q in queries:
        plain, group = k._query_group(q)
        for i, _, own in texts:
            if plain and (own == plain if plain.isdigit() else any(f in said[i] for f in group)):
                want.add((i, q))
    assert got == want and len(want) > 100


def test_substrings_of_long_texts(spark):
    df = spark.createDataFrame([(1, "слово " * 150_000 + "иголка")], "id long, txt string")
    asked = spark.createDataFrame([("иголка",), ("нет такого",)], "query string")
    assert [tuple(r) for r in k.substring_matches(df, asked, id_col="id", text_col="txt").collect()] == [(1, "иголка")]


def _pages(spark, html):
    return spark.createDataFrame([(1, "https://h.example/list", html)], "page_id long, url string, html string")


def test_the_nearest_container_counts(spark):
    html = """<div class="Card"><ul><li>A <a href='/tender-1111111/'>one</a><li>B <a href="/tender-2222222/">two</a></ul></p></div>
      <article><div><span>C <a href=/tender-3333333/>three</a></span></div><table><tr><td>D</td><td><a href="/tender-4444444/">four</a></td></table></article>"""
    got = {r["target"]: (r["container"], r["content"]) for r in box.container_links(_pages(spark, html)).collect()}
    # an item without an end tag goes on to the end of its list, as a parser without rules of items reads it
    assert got["/tender-2222222/"] == ("li", "B two") and got["/tender-1111111/"] == ("li", "A one B two")
    assert got["/tender-3333333/"] == ("article", "C three D four") and got["/tender-4444444/"] == ("tr", "D four")


def test_pages_that_are_broken_long_or_missing(spark):
    assert box.container_links(_pages(spark, None)).count() == 0 and box.listed_cards(_pages(spark, "")).count() == 0
    deep = "<div>" * 20_000 + '<a href="/tender-5555555/">five five</a>'
    assert [r["external_id"] for r in box.listed_cards(_pages(spark, deep)).collect()] == ["5555555"]
    many = "".join(f'<li class="item"><a href="/tender-{1_000_000 + i}/">Закупка {i}</a></li>' for i in range(5_000))
    assert box.listed_cards(_pages(spark, many)).count() == 5_000


def test_a_query_takes_a_text_to_search_form_once(spark):
    """However many forms a query has, the text is put in search form once: outside the look for the forms."""
    for test in (k.query_relevance, k.query_relevance_substring):
        plan = spark.range(1).select(F.col("id").cast("string").alias("c")).select(test(F.col("c"), "станков").alias("ok"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("regexp_replace(") == 1 and "contains(trim(" not in plan, plan


def test_few_and_many_forms_give_the_same(spark, monkeypatch):
    """A few forms are looked for without grams or a join of texts; the gram index gives the same pairs."""
    df = spark.createDataFrame([(1, "станки и муфты"), (2, "поставка муфт"), (3, ""), (4, None)], "id long, txt string")
    asked = spark.createDataFrame([("станок",), ("муфт",), ("нет",), (" ",)], "query string")
    found = k.substring_matches(df, asked, id_col="id", text_col="txt")
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()
    few = sorted(tuple(r) for r in found.collect())
    monkeypatch.setattr(k, "FEW_FORMS", 0)
    assert few == sorted(tuple(r) for r in k.substring_matches(df, asked, id_col="id", text_col="txt").collect()) == [(1, "муфт"), (1, "станок"), (2, "муфт")]


def test_links_are_written_in_parts_and_in_order(spark, monkeypatch):
    """One batch holds the links of many pages; where its texts grow long it is written in parts."""
    pages = spark.createDataFrame([(i, f"https://h.example/{i}", f'<li><a href="/tender-{1_000_000 + i}/">Закупка {i}</a></li>' if i % 3 else None) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    whole = box.container_links(pages).collect()
    assert box.container_links(pages).rdd.getNumPartitions() == 1 and len(whole) == 13
    monkeypatch.setattr(box, "MOST_HELD", 10)
    assert box.container_links(pages).collect() == whole and all(r["url"].endswith(f"/{r['page_id']}") for r in whole)


def test_pages_of_few_files_are_dealt_over_all_cores(spark):
    for name in ("extract_cards", "extract_table_rows", "build_prompts_full"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" in plan, name


def test_open_profiles_read_tenders_and_their_words_once(spark):
    """One pass for profiles with and without keywords: the orders are read once and no text is parted twice or shuffled by tender."""
    plan = QUERIES["match_profiles_open"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("o_orderkey#") and sum("Relation" in x and "o_orderkey" in x for x in plan.splitlines()) == 1, plan
    assert "collect_set" not in plan


def test_keywords_said_equal_keyword_matches(spark, monkeypatch):
    """By forms in the plan, by the join, and as keyword_matches gives them."""
    texts = [(1, "Ремонт  станков и\u00a0ПОЛУМУФТА"), (2, "поставка насосов; оборудования"), (3, ""), (4, None), (5, "станок-автомат, ёлка"), (6, "Ёлки, кресло")]
    df = spark.createDataFrame(texts, "id long, txt string")
    asked = spark.createDataFrame([("Ремонт станка",), ("ремонт",), ("поставка оборудования",), ("елка",), ("кресло",), (" ",), ("",), (None,), ("станок",), ("полумуфта",)], "keyword string")

    def said():
        rows = k.said_keywords(df, asked, id_col="id", text_col="txt").collect()
        assert len(rows) == len(texts)
        return sorted((r["id"], x) for r in rows for x in r["said"])

    want = sorted(tuple(r) for r in k.keyword_matches(df, asked, id_col="id", text_col="txt").collect())
    assert said() == want and len(want) >= 6
    monkeypatch.setattr(k, "LITERAL_FORMS", 0)
    assert said() == want
    assert [r["said"] for r in k.said_keywords(df, asked.limit(0), id_col="id", text_col="txt").collect()] == [[]] * len(texts)


def test_links_of_a_page_stay_where_the_page_is(spark):
    """The first link of an id is told inside its page: neither shuffle nor aggregate, and a title is made once."""
    pages = spark.createDataFrame([(1, "https://h.example/list", '<a href="/tender-1111111/">Закупка 1</a>')], "page_id long, url string, html string")
    for listed in (box.listed_cards, box.listed_links):
        df = listed(pages)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Aggregate" not in plan and df.count() == 1, plan
    plan = box.listed_cards(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Fabrikant") == 1, plan


def test_rows_of_one_key_are_pages_of_their_own(spark):
    """As the SQL has it: each row gives its links, also where another row has its key."""
    page = '<li>до 05.03.2024 <a href="/tender-1111111/">Закупка раз</a><a href="/tender-1111111/x">Закупка два</a></li>'
    pages = spark.createDataFrame([(1, "https://h.example/list", page), (1, "https://h.example/list", page)], "page_id long, url string, html string")
    assert [r["title"] for r in box.listed_cards(pages).collect()] == ["Закупка раз"] * 2
    assert [r["url"] for r in box.listed_links(pages).collect()] == ["https://h.example/tender-1111111/"] * 2


def test_a_folded_page_is_as_long_as_the_page(spark):
    """Links and headings that share a container hold places in the page's text, not copies of it."""
    many = "".join(f'<h2>Раздел {i}</h2><a href="/tender-{1_000_000 + i}/">Закупка {i}</a>' for i in range(500))
    row = box.folded(_pages(spark, f"<div>{many}</div>")).collect()[0]
    assert len(row["text"]) < len(many) and len(row["titles"]) == len(row["links"]) == 500
    rows = box.container_links(_pages(spark, f"<div>{many}</div>")).collect()
    assert len(rows) == 500 and all(r["content"] == row["text"] and len(r["heads"]) == 500 for r in rows) and rows[7]["label"] == "Закупка 7" and rows[7]["heads"][7] == "h2|Раздел 7"


def test_links_of_entities_hosts_and_headings(spark):
    html = """<div class=item><h4>Лот&nbsp;&nbsp;1</h4><h3>123456789</h3><h2>Тендер</h2><h2>Поставка &quot;муфт&quot;  и 😀</h2> до 😀 31.02.2024, до 05.03.2024 10:15 Цена: 1 200,50
      <a href="//H.example:80/tender-1111111/?a=1&amp;b=2">один</a><a href="http://h.example/tender-2222222/">два</a><a href="https://o.example/tender-3333333/">три</a><a href="tender-x">четыре 123456789</a></div>"""
    got = {r["external_id"]: r.asDict() for r in box.listed_cards(_pages(spark, html)).collect()}
    assert sorted(got) == ["1111111", "2222222"] and got["1111111"]["url"] == "https://H.example:80/tender-1111111/?a=1&b=2"
    assert {r["title"] for r in got.values()} == {"Тендер"} and {r["deadline"] for r in got.values()} == {None}
    assert {r["description"] for r in got.values()} == {'Лот 1 123456789 Тендер Поставка "муфт" и 😀 до 😀 31.02.2024, до 05.03.2024 10:15 Цена: 1 200,50 один два три четыре 123456789'}
    assert {r["price"] for r in got.values()} == {1200.5}
