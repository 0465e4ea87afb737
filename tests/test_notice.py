"""Fields of notices on written texts: each case is a text and what has to come out of it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bidlens.functions import notice as n

CASES = {}


def cases(name, rows, types, fields, inputs=1):
    """Rows of inputs and then expected values; fields maps the inputs' columns to named columns."""
    CASES[name] = (rows, types, fields, inputs)


TERMS = {"advance_required": "BOOLEAN", "advance_percent": "DOUBLE", "postpayment_days": "INTEGER", "application_security_percent": "DOUBLE", "contract_security_percent": "DOUBLE"}
cases(
    "notice_terms",
    [
        ("Авансовый платеж составляет 30 % от цены. Оплата в течение 7 рабочих дней.", True, 30.0, 7, None, None),
        ("Аванс не предусмотрен. Скидка 5%", True, None, None, None, None),
        ("Предоплата: 15,5%; отсрочка 45 календарных дней", True, 15.5, 45, None, None),
        ("Предварительная оплата в размере 100%. Размер обеспечения заявки: 2%", True, 100.0, None, 2.0, None),
        ("Обеспечение исполнения контракта 10 %. Обеспечение заявления не более 0,5 %", False, None, None, 0.5, 10.0),
        ("30 дней после приемки товара. Обеспечения исполнения договора в размере 12.5%", False, None, 30, None, 12.5),
        ("Оплата не позднее 60 дн. с даты поставки", False, None, 60, None, None),
        ("авансирование 40% без аванса", True, 40.0, None, None, None),
        ("Поставка кресел", False, None, None, None, None),
        ("", False, None, None, None, None),
        ("Предварительный расчет. Обеспечение заявки. Сумма 3%", False, None, None, None, None),
    ],
    TERMS,
    lambda c: {f: n.sentence_terms(c)[f] for f in TERMS},
)
cases(
    "human_dates",
    [
        ("5 марта 2026", "2026-03-05 12:00:00"), ("31  Декабря 2025 9:05", "2025-12-31 09:05:00"), ("30 февраля 2026", None), ("12 мартобря 2026", None), ("01.02.2026", "2026-02-01 12:00:00"),
        ("7/8/2026 23:59", "2026-08-07 23:59:00"), ("7-13-2026", None), ("2026-07-08", None), ("до 5 марта 2026", None), ("29 февраля 2028 00:00", "2028-02-29 00:00:00"), ("", None),
    ],
    {"at": "TIMESTAMP"},
    lambda c: {"at": n.human_time(c)},
)
cases(
    "publication_dates",
    [
        ("Дата публикации: 3 июня 2026 10:15. Начало 4 июня 2026", "2026-06-03 10:15:00"), ("Размещено 03.06.2026", "2026-06-03 12:00:00"), ("5 июля 2026 09:00 • начало приема заявок", "2026-07-05 09:00:00"),
        ("12.07.2026 - начало", "2026-07-12 12:00:00"), ("Опубликовано 31.02.2026; 1 мая 2026 начало", "2026-05-01 12:00:00"), ("окончание 12.07.2026", None), ("нет даты", None),
    ],
    {"published_at": "TIMESTAMP"},
    lambda c: {"published_at": n.publication_time(c)},
)
cases(
    "days_in_text",
    [
        ("прием до 5.6.2026", "2026-06-05 00:00:00"), ("с 05/06/2026 8:30 по", "2026-06-05 08:30:00"), ("2026-06-05T07:45:00", "2026-06-05 07:45:00"), ("на 2026.6.5", "2026-06-05 00:00:00"),
        ("32.01.2026 и 2026-01-01", None), ("завтра", None), ("1-2-2027 и 2026-05-05", "2027-02-01 00:00:00"),
    ],
    {"at": "TIMESTAMP"},
    lambda c: {"at": n.day_in_text(c)},
)
cases(
    "iso_times",
    [
        ("2026-06-05T07:45:00", "2026-06-05 07:45:00"), ("2026-06-05T07:45:00+03:00", "2026-06-05 04:45:00"), ("2026-06-05 07:45", "2026-06-05 07:45:00"), ("2026-06-05", "2026-06-05 00:00:00"),
        ("2026-06-05T07:45:00Z", "2026-06-05 07:45:00"), ("05.06.2026", None), ("", None), (None, None), ("2026-13-05", None), ("2026-06-05T23:30:00-02:30", "2026-06-06 02:00:00"),
    ],
    {"at": "TIMESTAMP"},
    lambda c: {"at": n.iso_time(c)},
)
cases(
    "notice_customers",
    [
        ("Заказчик: ООО «Вектор» Место нахождения г. Тверь", "ООО «Вектор»"), ("Итог Заказчик - МУП Водоканал ИНН 7701234567 Почтовый адрес x", "МУП Водоканал"),
        ("Организация, осуществляющая размещение ГКУ Дирекция Начальная цена 5", "ГКУ Дирекция"), ("Заказчик: А НМЦК 5", ""), ("заказчик ФГБУ Наука контактный телефон 5", "ФГБУ Наука"),
        ("Заказчик не указан", ""), ("Заказчик ООО Ромашка КПП 770101001 Регион Тверь", "ООО Ромашка"), ("", ""),
    ],
    {"customer": "VARCHAR"},
    lambda c: {"customer": n.customer_in_text(c)},
)
cases(
    "cell_customers",
    [
        ("Наименование|ООО Вектор и Ко|АО Другое имя", "ООО Вектор и Ко"), ("ООО Я|Бюджетное учреждение 5", "Бюджетное учреждение 5"), ("Государственное наименование характеристики|ИП Иванов И. И.", "ИП Иванов И. И."),
        ("Цена|5", ""), ("", ""), ("ооооо Вектор", ""), ("  ПАО   Большая   Сеть ", "ПАО Большая Сеть"),
    ],
    {"customer": "VARCHAR"},
    lambda c: {"customer": n.customer_in_cells(F.split(c, r"\|"))},
)
cases(
    "paired_customers",
    [
        ("Объект|Заказчик", "Насос| ООО  Вектор ", "ООО Вектор"), ("Заказчик|Организация", " |АО Сеть", "АО Сеть"), ("Объект|Цена", "a|b", ""), ("Заказчик", "", ""), ("Организация торгов|Заказчик", "Первая|Вторая", "Первая"),
    ],
    {"customer": "VARCHAR"},
    lambda a, b: {"customer": n.customer_in_pairs(F.split(a, r"\|"), F.split(b, r"\|"))},
    inputs=2,
)
cases(
    "notice_regions",
    [
        ("Регион: Тверская обл. Начальная цена 5", "Тверская обл."), ("Место поставки г. Псков, ул. Мира; Заказчик ООО", "г. Псков, ул. Мира"), ("Место выполнения работ - Республика Коми, Дата начала", "Республика Коми"),
        ("Место оказания услуг: Омск", "Омск"), ("Почтовый адрес 170000 г. Тверь, ул. 1", "Тверь"), ("Место нахождения: Россия г.Псков", "Псков"), ("ничего", ""), ("Регион: НМЦК 5 Место поставки: Пермь", "Пермь"), ("", ""),
    ],
    {"region": "VARCHAR"},
    lambda c: {"region": n.region_in_text(c)},
)
cases(
    "named_regions",
    [
        ("поставка, Республика Карелия", "Республика Карелия"), ("адрес: Тверская  область, г. Тверь", "Тверская область"), ("в г. Москва.", "г. Москва"), ("Пермский край", "Пермский край"), ("город Тверь", ""),
        ("Чувашская Респ, Канаш", "Чувашская Респ"), ("", ""),
    ],
    {"region": "VARCHAR"},
    lambda c: {"region": n.named_region(c)},
)
cases(
    "methods_and_states",
    [
        ("ЭЛЕКТРОННЫЙ АУКЦИОН, подача заявок", "Электронный аукцион", "Подача заявок"), ("Иной способ определения поставщика. Определение поставщика отменено", "Иной способ определения поставщика", "Определение поставщика отменено"),
        ("Открытый конкурс и запрос предложений; контракт исполнен; контракт заключен", "Открытый конкурс", "Контракт заключен"), ("иной способ; определение поставщика", "Иной способ", "Определение поставщика"), ("закупка", "", ""), ("", "", ""),
        ("Запрос котировок в электронной форме. Работа комиссии", "Запрос котировок в электронной форме", "Работа комиссии"),
    ],
    {"method": "VARCHAR", "state": "VARCHAR"},
    lambda c: {"method": n.first_phrase(c, n.METHODS), "state": n.first_phrase(c, n.STATES)},
)
cases(
    "clean_titles",
    [
        ("Тендер № 123456: Поставка насосов", "1", "Поставка насосов"), ("Поставка муфт — Запрос предложений № 77", "77", "Поставка муфт"), ("Поставка муфт — Запрос предложений № 78", "77", "Поставка муфт — Запрос предложений № 78"),
        ("Насос для скважины Насос для скважины", "1", "Насос для скважины"), ("насос насос", "1", "насос насос"), ("Ремонт | Фабрикант торги", "1", "Ремонт"), ("Ремонт крыши СМП СОНО", "1", "Ремонт крыши"),
        ("Мониторинг цен 55 -  Бумага &amp; ручки", "1", "Бумага & ручки"), ("", "1", ""), ("a b c a b d", "1", "a b c a b d"),
    ],
    {"title": "VARCHAR"},
    lambda c, i: {"title": n.clean_title(c, i)},
    inputs=2,
)
_PAGE = "Электронный аукцион 44-ФЗ Подача заявок Размещено 03.06.2026 Заказчик: ООО Вектор ИНН 7701234567 Место нахождения г. Тверь Начальная цена 1 250 000,50 руб. Окончание подачи заявок 12.06.2026 09:00 Место поставки: Тверская область Дата начала 1. Аванс 30%. Обеспечение заявки 1%."
_OTHER = "Запрос предложений. Заказчик АО Сеть Регион: Пермский край НМЦК: 99 Работа комиссии"
DETAILS = {"law_type": "VARCHAR", "procurement_method": "VARCHAR", "status": "VARCHAR", "customer": "VARCHAR", "customer_inn": "VARCHAR", "region": "VARCHAR", "price": "DOUBLE", "published_at": "TIMESTAMP", "deadline": "TIMESTAMP"} | TERMS
cases(
    "notice_details",
    [
        (_PAGE, "https://x.example/a", "44-ФЗ", "Электронный аукцион", "Подача заявок", "ООО Вектор", "7701234567", "Тверская область", 1250000.5, "2026-06-03 12:00:00", "2026-06-12 09:00:00", True, 30.0, None, 1.0, None),
        (_OTHER, "https://x.example/223/purchase/5", "223-ФЗ", "Запрос предложений", "Работа комиссии", "АО Сеть", "", "Пермский край НМЦК: 99 Работа комиссии".split(" НМЦК")[0], 99.0, None, None, False, None, None, None, None),
        ("", "", "", "", "", "", "", "", None, None, None, False, None, None, None, None),
    ],
    DETAILS,
    lambda c, u: {f: n.details(c, u)[f] for f in DETAILS},
    inputs=2,
)
cases(
    "recover_notice",
    [
        (_PAGE, "x", "", None, " ", "", "ООО Вектор", "7701234567", "44-ФЗ", "Тверская область"),
        (_PAGE, "x", "МУП Известный", "1234567890", "223-ФЗ", "Псков", "МУП Известный", "1234567890", "223-ФЗ", "Псков"),
        ("пусто", "https://x.example/ea20/view", None, None, None, None, "", "", "44-ФЗ", ""),
    ],
    dict.fromkeys(n.RECOVERED, "VARCHAR"),
    lambda c, u, *known: {f: n.recovered(c, u, **dict(zip(n.RECOVERED, known, strict=True)))[f] for f in n.RECOVERED},
    inputs=6,
)


def _value(v):
    return str(v) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(CASES))
def test_fields(spark, name):
    rows, types, fields, inputs = CASES[name]
    schema = "k int, " + ", ".join(f"in{i} string" for i in range(inputs))
    df = spark.createDataFrame([(k, *[r[i] for i in range(inputs)]) for k, r in enumerate(rows)], schema)
    out = fields(*[F.col(f"in{i}") for i in range(inputs)])
    got = {r["k"]: tuple(_value(r[f]) for f in types) for r in df.select("k", *[out[f].alias(f) for f in types]).collect()}
    assert got == {k: tuple(r[inputs:]) for k, r in enumerate(rows)}


def test_labels_are_found_in_one_scan(spark):
    text = "Регион поставки: Тверь ЗАКАЗЧИК - ООО Заказчика Регионы ИНН 5 НМЦК: 7"
    row = spark.createDataFrame([(text,)], "c string").select(n.segments(F.col("c")).alias("s")).first()
    assert [(x["kind"], x["value"]) for x in row["s"]] == [("region", ": Тверь "), ("customer", " - ООО Заказчика Регионы "), ("inn", " 5 "), ("price", ": 7")]


def test_long_texts(spark):
    df = spark.createDataFrame([("Заказчик: ООО Вектор ИНН 7701234567 Регион: Тверь " * 3_000 + "слово " * 200_000 + "Аванс 5%.",)], "c string")
    row = df.select(n.details(F.col("c"), F.lit("")).alias("d")).first()["d"]
    assert (row["customer"], row["region"], row["advance_percent"]) == ("ООО Вектор", "Тверь", 5.0)


def test_marks_in_a_text_and_unusual_letters(spark):
    """A text that holds the marks put around labels is parted like any other; rounded letters count as plain ones."""
    texts = ["Регион: Тве\x01рь ИНН 5", "Регион: Тве\x02рь ИНН 5", "ПРЕДᲂПЛАТА 5%", "АВАНС 7%. после ПОСТАВКИ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, c string").select("k", n.segments(F.col("c")).alias("s"), n.sentence_terms(F.col("c"))["advance_percent"].alias("a")).orderBy("k").collect()
    assert [x["value"] for x in rows[0]["s"]] == [": Тве\x01рь ", " 5"] and [x["value"] for x in rows[1]["s"]] == [": Тве\x02рь ", " 5"]
    assert [r["a"] for r in rows[2:]] == [5.0, 7.0]

