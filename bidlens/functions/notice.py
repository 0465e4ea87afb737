"""Fields of a procurement notice out of the text of its page, as column expressions.

One scan finds every label of a page at once: the text between a label and the next one is the label's value, so a page becomes
an array of (kind, value) in order, and each field reads its value from there.  Terms are read sentence by sentence: a label, then a
number, then its unit, each by a test of its own.  No field needs a shuffle.  A field that is not found is null for
numbers and times, and '' for texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t
from .text import once

# Labels of a page by what stands after them.
LABELS = {
    "customer": ("Заказчик",),
    "placed_by": ("Организация, осуществляющая размещение",),
    "region": ("Регион", "Регион поставки"),
    "place": ("Место поставки", "Место выполнения работ", "Место оказания услуг"),
    "address": ("Место нахождения", "Почтовый адрес"),
    "contact": ("Адрес электронной почты", "Контактный телефон", "Ответственное должностное лицо"),
    "price": ("Начальная цена", "Начальная (максимальная) цена", "НМЦК", "Стоимость"),
    "inn": ("ИНН",),
    "kpp": ("КПП",),
    "subject": ("Объект закупки",),
    "published": ("Дата публикации", "Дата размещения", "Опубликовано", "Размещено"),
    "deadline": ("Окончание подачи заявок", "Дата окончания"),
    "other": ("Дата начала", "Общая информация", "Информация о процедуре закупки", "Личный кабинет"),
}
#: Kinds of which one has to follow a customer.
CUSTOMER_ENDS = ("address", "contact", "price", "region")
#: Characters of a value that belong to its label.
_LEAD, _EDGE = " :-–—", " ;,-:–—"
# Words that name a term, with the stem that each begins with, the units of its number, and how far on in a sentence the number may stand.
ADVANCE = {"аванс": "аванс", r"предоплат[аы]": "предоплат", r"предварительн(?:ая|ой) оплат[аы]": "предварительн"}
ADVANCE_NAMED = ("аванс", r"предоплат[аы]", r"предварительн\w+ оплат\w*")
APPLICATION = {r"обеспечени[ея] (?:заявки|заявления)": "обеспечени"}
CONTRACT = {r"обеспечени[ея] (?:исполнения|исполнение) (?:контракта|договора)": "обеспечени"}
PAYMENT, TERMS_OF_PAYMENT, DEFERRAL, RECEIPT = r"оплат[аы]", ("через", "в течение", "не позднее"), r"отсрочк[аи]", ("поставки", "приемки", "подписания")
DAY_UNITS = ("календарн", "рабоч", "дн")
GAP_PERCENT, GAP_SECURITY, GAP_PAYMENT, GAP_DEFERRAL = 250, 300, 250, 150
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
# What begins an organisation's name, and what a table's head cell says instead.
ORGANISATIONS = (
    "ГОСУДАРСТВЕННОЕ ", "МУНИЦИПАЛЬНОЕ ", "ФЕДЕРАЛЬНОЕ ", "БЮДЖЕТНОЕ ", "АВТОНОМНОЕ ", "КАЗЕННОЕ ", "ОБЛАСТНОЕ ", "КРАЕВОЕ ", "РЕСПУБЛИКАНСКОЕ ",
    "ООО ", "АО ", "ПАО ", "ОАО ", "ЗАО ", "ИП ",
)
HEAD_CELLS = ("НАИМЕНОВАНИЕ ХАРАКТЕРИСТИКИ", "ЗНАЧЕНИЕ ХАРАКТЕРИСТИКИ", "ЕДИНИЦА ИЗМЕРЕНИЯ")
# Kinds of regions, cities that are regions, and how long a region's name may be.
REGION_KINDS, REGION_CITIES, REGION_MOST = ("область", "край", "автономная область", "автономный округ"), ("Москва", "Санкт-Петербург", "Севастополь"), 300
# Methods and states in the order in which they are looked for, words before a procedure's number, and names of a site and marks of a registry at a title's end.
METHODS = ("Запрос котировок в электронной форме", "Электронный аукцион", "Открытый конкурс", "Конкурс в электронной форме", "Запрос предложений", "Иной способ определения поставщика", "Иной способ")
STATES = (
    "Определение поставщика завершено", "Определение поставщика отменено", "Закупка отменена", "Процедура отменена", "Контракт заключен", "Контракт исполнен",
    "Контракт расторгнут", "Работа комиссии", "Подача заявок", "Определение поставщика",
)
PROCEDURES = ("Тендер", "Запрос предложений", "Аукцион", "Конкурс", "Запрос цен")
LONGER_PROCEDURES = (*PROCEDURES, "Мониторинг цен", "Процедура закупки", "Объявление о продаже")
SITES, MARKS = ("Фабрикант", "Fabrikant"), ("СМП СОНО", "СМП", "СОНО")

_ANY_CASE = "(?iU)"
#: Letters and what they are in lower case; the last are rounded and tall forms, which a search in any case takes for plain ones.
_UPPER, _LOWER = "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ\u1c80\u1c81\u1c82\u1c83\u1c84\u1c85\u1c86", "абвгдеёжзийклмнопрстуфхцчшщъыьэюявдосттъ"
#: Put around labels; a text that holds one itself is parted by the pattern.
_OPEN, _CLOSE = "\x01", "\x02"


def _first(found: Column) -> Column:
    """The first value that is neither null nor blank; null without one."""
    return F.get(F.filter(found, lambda v: v.isNotNull() & (v != "")), 0)


def _one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def unblank(c: Column) -> Column:
    """Null for '', where nullif would make the value twice inside a lambda."""
    return once(c, lambda v: F.when(v != "", v))


def fold(c: Column) -> Column:
    """Cyrillic letters in lower case, one for one, as a search in any case takes them."""
    return F.translate(c, _UPPER, _LOWER)


def _if_told(folded: Column, words: tuple[str, ...], value: Column) -> Column:
    """The value where the folded text holds one of the words, else null: a look for fixed words saves most texts the search by patterns."""
    return F.when(reduce(lambda a, b: a | b, [F.contains(folded, F.lit(w)) for w in words]), value)


def segments(c: Column, labels: dict[str, tuple[str, ...]] = LABELS) -> Column:
    """The labels of a text in order, each with its kind and the text up to the next label: array<struct<kind, label, value>>.

    Labels are looked for as whole words in any case, a longer one before a shorter one that begins it.
    """
    kind_of = {label.lower(): kind for kind, names in labels.items() for label in names}
    names = sorted(kind_of, key=lambda x: (-len(x), x))
    tails: dict[str, list[str]] = {}
    for name in names:  # by first letter, so that a word is held against few labels
        tails.setdefault(name[0], []).append(name[1:].replace("(", r"\(").replace(")", r"\)"))
    spelled = "|".join(f"{head}(?:{'|'.join(rest)})" for head, rest in tails.items())
    pattern = rf"{_ANY_CASE}(?<!\p{{L}})(?:{spelled})(?!\p{{L}})"
    kinds = F.create_map(*[F.lit(x) for item in kind_of.items() for x in item])
    said = F.regexp_extract_all(c, F.lit(pattern), 0)

    def of(label: Column, value: Column) -> Column:
        return once(F.lower(label), lambda name: F.struct(kinds[name].alias("kind"), name.alias("label"), value.alias("value")))

    # one scan writes marks around the labels, and parting at a mark needs no pattern
    parts = F.filter(F.split(F.regexp_replace(c, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN, -1), lambda p, i: i > 0)
    marked = F.transform(parts, lambda p: once(F.split(p, _CLOSE, 2), lambda x: of(F.get(x, 0), F.get(x, 1))))
    # bound, as an expression inside the lambda would be made anew for every label
    scanned = once(F.split(c, pattern, -1), lambda between: F.transform(said, lambda s, i: of(s, F.get(between, i + 1))))
    return F.when(F.contains(c, F.lit(_OPEN)) | F.contains(c, F.lit(_CLOSE)), scanned).otherwise(marked)


def _values(segs: Column, kind: str) -> Column:
    """The values of a kind without what belongs to the label."""
    return F.transform(F.filter(segs, lambda s: s["kind"] == kind), lambda s: F.ltrim(F.btrim(s["value"]), F.lit(_LEAD)))


def _after(sentence: Column, word: str, gap: int) -> Column:
    """What follows a word in a folded sentence, as far as a number may stand; '' without the word."""
    return F.left(F.regexp_extract(sentence, rf"(?U){word}(.*)$", 1), F.lit(gap + 12))


def _percent(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+(?:[.,]\d+)?)\s*%", 1)


def _days(c: Column) -> Column:
    return F.regexp_extract(c, rf"(?U)(\d+)\s*(?:{'|'.join(DAY_UNITS)})", 1)


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def _percent_after(text: Column, sentences: Column, words: dict[str, str], gap: int) -> Column:
    """The percentage of the first word, in their order, that has one in a sentence that names it."""

    def read(word: str) -> Callable[[Column], Column]:
        return lambda s: _percent(_after(s, word, gap))

    return once(F.coalesce(*[_if_told(text, (stem,), _in_sentences(sentences, stem, read(word))) for word, stem in words.items()]), _number)


def _in_sentences(sentences: Column, stem: str, read: Callable[[Column], Column]) -> Column:
    """What is read first out of the sentences that hold the stem."""
    return _first(F.transform(F.filter(sentences, lambda s: F.contains(s, F.lit(stem))), read))


def sentence_terms(c: Column) -> Column:
    """Commercial terms whose number stands in the sentence that names them; an advance may be named without one.

    A point between digits ends no sentence.
    """

    return once(fold(_one_line(c)), lambda text: once(F.split(text, r"\.(?!\d)", -1), lambda sentences: _terms(text, sentences)))


def _terms(text: Column, sentences: Column) -> Column:
    """The terms of a folded text and its sentences."""
    named = _if_told(text, tuple(ADVANCE.values()), F.rlike(text, F.lit(rf"(?U)(?<!\w)(?:{'|'.join(ADVANCE_NAMED)})(?!\w)")))
    # a term of payment, a deferral, or days before what they count from
    stated = rf"(?:{'|'.join(TERMS_OF_PAYMENT)})\s*(?=\d)"
    days = {
        "оплат": lambda s: _days(_after(_after(s, PAYMENT, GAP_PAYMENT), stated, 10)),
        "отсрочк": lambda s: _days(_after(s, DEFERRAL, GAP_DEFERRAL)),
        "после ": lambda s: _days(F.regexp_extract(s, rf"^(.*)после (?:{'|'.join(RECEIPT)})", 1)),
    }
    return once(
        _percent_after(text, sentences, ADVANCE, GAP_PERCENT),
        lambda advance: F.struct(
            F.coalesce(advance.isNotNull() | named, F.lit(False)).alias("advance_required"),
            advance.alias("advance_percent"),
            F.coalesce(*[_if_told(text, (stem,), _in_sentences(sentences, stem, read)) for stem, read in days.items()]).try_cast("int").alias("postpayment_days"),
            _percent_after(text, sentences, APPLICATION, GAP_SECURITY).alias("application_security_percent"),
            _percent_after(text, sentences, CONTRACT, GAP_SECURITY).alias("contract_security_percent"),
        ),
    )


def _unzero(c: Column) -> Column:
    return once(c, lambda v: F.when(v != 0, v.cast("int")))


_CLOCK = r"(?:[ T]+\d{1,2}:\d{2})?"
NAMED_DAY, DOTTED_DAY, ISO_DAY = rf"\d{{1,2}} [а-яё]+ 20\d{{2}}{_CLOCK}", rf"\d{{1,2}}[./-]\d{{1,2}}[./-]20\d{{2}}{_CLOCK}", rf"20\d{{2}}[./-]\d{{1,2}}[./-]\d{{1,2}}{_CLOCK}"


def _time(found: Column, hour: int, year_first: bool = False) -> Column:
    """A found day, perhaps with a clock time, as a time: its parts are what separators leave."""
    year, day = (0, 2) if year_first else (2, 0)

    def read(parts: Column) -> Column:
        month = F.coalesce(F.get(parts, 1).try_cast("int"), _unzero(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.get(parts, 1)))))
        clock = [F.get(parts, 3).try_cast("int"), F.get(parts, 4).try_cast("int")]
        return F.try_make_timestamp_ntz(F.get(parts, year).try_cast("int"), month, F.get(parts, day).try_cast("int"), F.coalesce(clock[0], F.lit(hour)), F.coalesce(clock[1], F.lit(0)), F.lit(0))

    # one-letter separators need no pattern made for each row; a run of them leaves '' between
    return once(F.array_remove(F.split(F.translate(found, "/: T-", "....."), r"\."), ""), read)


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match in any case, null without one."""
    return unblank(F.regexp_extract(c, f"{_ANY_CASE}{pattern}", group))


def human_time(c: Column) -> Column:
    """A text that is a day with its month's name or as d.M.yyyy, perhaps with a time; noon without one; null for anything else."""
    return _time(_found(_one_line(c), f"^(?:{NAMED_DAY}|{DOTTED_DAY})$"), 12)


def _publication(text: Column, segs: Column) -> Column:
    labelled = F.transform(F.filter(segs, lambda s: s["kind"] == "published"), lambda s: s["value"])
    month = "|".join(MONTHS)
    named, dotted = NAMED_DAY.replace("[а-яё]+", f"(?:{month})"), DOTTED_DAY
    after = [_first(_heads(labelled, p)) for p in (named, dotted)]
    begun = [F.when(F.contains(fold(text), F.lit("начало")), _found(text, rf"({p}) *[•|-]? *начало", 1)) for p in (named, dotted)]
    return F.coalesce(*[_time(x, 12) for x in (*after, *begun)])


def _heads(values: Column, pattern: str) -> Column:
    """The match with which each value begins after at most 80 characters that are no digits."""
    return F.transform(values, lambda v: _found(v, rf"^\D{{0,80}}({pattern})", 1))


def publication_time(c: Column) -> Column:
    """The labelled day of publication, else the day on which applications begin."""
    return once(_one_line(c), lambda text: _publication(text, segments(text)))


def day_in_text(c: Column) -> Column:
    """The first d.M.yyyy in a text, else the first yyyy-M-d, with separators . / -; midnight without a time; an impossible day is null."""
    return once(_found(c, DOTTED_DAY), lambda dotted: F.when(dotted.isNotNull(), _time(dotted, 0)).otherwise(_time(_found(c, ISO_DAY), 0, year_first=True)))


def day_after(c: Column, words: tuple[str, ...], gap: int) -> Column:
    """The first d.M.yyyy in a text that follows one of the words, in any case, after at most ``gap`` characters that are no digits; midnight without a time."""
    begins = "".join(sorted({w[0] for w in words}))
    return _time(_found(c, rf"(?=[{begins}])(?:{'|'.join(words)})[^0-9]{{0,{gap}}}({DOTTED_DAY})", 1), 0)


def iso_time(c: Column) -> Column:
    """ISO text to UTC: an offset counts, a text without one is UTC, anything else is null."""
    shape = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?)?$"
    offset = F.coalesce(F.nullif(F.regexp_extract(c, r":.*([+-]\d{2}:\d{2})$", 1), F.lit("")), F.lit("+00:00"))
    plain = F.regexp_replace(c, r"(?:Z|(?<=:\d{2}|\.\d{1,6})[+-]\d{2}:\d{2})$", "").try_cast("timestamp_ntz")
    return F.when(F.rlike(c, F.lit(shape)), F.convert_timezone(offset, F.lit("UTC"), plain))


def _customer(segs: Column) -> Column:
    """The customer, or who places the notice, where a later label shows that the value has ended."""

    def read(last: Column) -> Column:
        ended = F.slice(segs, F.lit(1), F.coalesce(last, F.lit(0)))  # what stands before the last label that may end a customer
        named = [F.filter(_values(ended, kind), lambda v: F.length(F.trim(v)) >= 3) for kind in ("customer", "placed_by")]
        return F.coalesce(*[F.btrim(_first(n)) for n in named], F.lit(""))

    return once(F.array_max(F.transform(segs, lambda s, i: F.when(s["kind"].isin(*CUSTOMER_ENDS), i))), read)


def customer_in_text(c: Column) -> Column:
    """The labelled customer up to the next label, else the organisation that places the notice."""
    return once(segments(_one_line(c)), _customer)


def customer_in_cells(cells: Column) -> Column:
    """The first cell that begins like an organisation's name."""
    named = F.filter(
        F.transform(cells, t.collapse),
        lambda v: F.length(v).between(10, 1000) & F.rlike(F.upper(v), F.lit(f"^(?:{'|'.join(ORGANISATIONS)})")) & ~F.rlike(F.upper(v), F.lit("|".join(HEAD_CELLS))),
    )
    return F.coalesce(F.get(named, 0), F.lit(""))


def customer_in_pairs(titles: Column, values: Column) -> Column:
    """The value whose title speaks of a customer or an organisation."""
    pairs = F.zip_with(titles, values, lambda a, b: F.when(F.rlike(a, F.lit("Заказчик|Организация")), t.collapse(b)))
    return F.coalesce(F.get(F.filter(pairs, lambda v: v != ""), 0), F.lit(""))


def _region(segs: Column) -> Column:
    labelled = [F.transform(_values(segs, kind), lambda v: F.btrim(F.left(v, F.lit(REGION_MOST)), F.lit(_EDGE))) for kind in ("region", "place")]
    # the town of an address: what stands after "г." before the first comma
    towns = F.transform(_values(segs, "address"), lambda v: F.regexp_extract(F.get(F.split(v, "[,;]"), 0), r"(?iU)(?<!\p{L})г\.? ?([а-яё][а-яё-]+)", 1))
    return F.coalesce(*[_first(x) for x in labelled], _first(towns), F.lit(""))


def region_in_text(c: Column) -> Column:
    """The labelled region or place up to the next label, else the town of an address."""
    return once(segments(_one_line(c)), _region)


_NAME, _MORE = "[а-яё][а-яё-]+", "(?: [а-яё-]+){0,2}"
#: A republic, a republic named after its name, another kind of region after its name, a city; in the order in which they are looked for.
#: Each with words of which a text that has one holds one.
_NAMED_REGIONS = {
    rf"(?<!\w)республика {_NAME}{_MORE}": ("республика ",),
    rf"(?<!\w){_NAME}{_MORE} респ(?:ублика)?(?!\w)": (" респ",),
    rf"(?<!\w){_NAME}{_MORE} (?:{'|'.join(REGION_KINDS)})(?!\w)": tuple(f" {k}" for k in REGION_KINDS),
    rf"(?<!\w)г\.? ?(?:{'|'.join(REGION_CITIES)})(?!\w)": tuple(x.lower() for x in REGION_CITIES),
}


def named_region(c: Column) -> Column:
    """A republic, an oblast or krai, or a city of federal rank, wherever it stands."""

    def read(text: Column) -> Column:
        return once(fold(text), lambda low: F.coalesce(*[_if_told(low, words, F.btrim(_found(text, p), F.lit(" ,.;:"))) for p, words in _NAMED_REGIONS.items()], F.lit("")))

    return once(_one_line(c), lambda text: F.left(read(text), F.lit(REGION_MOST)))


def first_phrase(c: Column, phrases: tuple[str, ...]) -> Column:
    """The first of the phrases, in their order, that the text holds in whatever case."""
    return once(F.lower(F.coalesce(c, F.lit(""))), lambda low: F.coalesce(*[F.when(F.contains(low, F.lit(p.lower())), p) for p in phrases], F.lit("")))


def _without_head(c: Column) -> Column:
    """A title without a procedure's kind and number before it."""

    def read(low: Column) -> Column:
        rests = [F.when(F.startswith(low, F.lit(p.lower())), F.regexp_extract(F.substr(c, F.lit(len(p) + 1)), r"^\s*№?\s*\d+\s*[:—-]?\s*(.*)$", 1)) for p in LONGER_PROCEDURES]
        numbered = [F.when(F.startswith(low, F.lit(p.lower())), F.rlike(F.substr(c, F.lit(len(p) + 1)), F.lit(r"^\s*№?\s*\d"))) for p in LONGER_PROCEDURES]
        return F.when(F.coalesce(*numbered, F.lit(False)), F.coalesce(*rests)).otherwise(c)

    return once(F.lower(c), read)


def _without_tail(c: Column, number: Column) -> Column:
    """A title without a procedure's kind and its own number after it."""
    at = F.length(c) - F.locate("№", F.reverse(c))
    head, told = F.rtrim(F.left(c, at)), F.trim(F.substr(c, at + 2))
    low = F.lower(head)
    cut = [F.when(F.endswith(low, F.lit(p.lower())), F.rtrim(F.left(head, F.length(head) - len(p)), F.lit(" —-"))) for p in PROCEDURES]
    return F.when(F.contains(c, F.lit("№")) & (told == number), F.coalesce(*cut, c)).otherwise(c)


def _without_marks(c: Column) -> Column:
    """A title without the site's name behind a dash or bar, and without registry marks at its end."""
    site = F.regexp_replace(c, rf"{_ANY_CASE} *[-|] *(?:{'|'.join(SITES)}).*$", "")
    # what no mark ends with in any case need not be searched for one
    ends = sorted({x for mark in MARKS for x in (mark[-1], *(u for u, low in zip(_UPPER, _LOWER, strict=True) if low == mark[-1].lower()), mark[-1].lower())})
    return once(site, lambda v: F.trim(F.when(F.right(F.rtrim(v), F.lit(1)).isin(*ends), F.regexp_replace(v, rf"{_ANY_CASE} *(?:{'|'.join(MARKS)}) *$", "")).otherwise(v)))


def clean_title(c: Column, external_id: Column) -> Column:
    """A title without the procedure's kind and number at its ends, site names and registry marks; a title said twice is said once."""
    return once(t.collapse(c), lambda title: bare_title(title, external_id))


def bare_title(title: Column, external_id: Column) -> Column:
    """clean_title of a title whose entities are decoded and blanks collapsed."""

    def halves(title: Column) -> Column:
        def read(words: Column) -> Column:
            half = (F.size(words) / 2).cast("int")
            first, second = F.slice(words, F.lit(1), half), F.slice(words, half + 1, half)
            return F.left(F.when((F.size(words) >= 6) & (F.size(words) % 2 == 0) & (first == second), F.array_join(first, " ")).otherwise(title), F.lit(1000))

        return once(F.split(title, " "), read)

    def marks(title: Column) -> Column:
        return once(_without_marks(title), halves)

    def tail(title: Column) -> Column:
        return once(F.trim(_without_tail(title, external_id)), marks)

    return once(F.trim(_without_head(title)), tail)


def law(c: Column, url: Column | None = None) -> Column:
    """The law that a text names, or that the path of its address shows."""
    said = F.when(F.rlike(c, F.lit(r"(?iU)\b44\s*-?\s*фз")), "44-ФЗ").when(F.rlike(c, F.lit(r"(?iU)\b223\s*-?\s*фз")), "223-ФЗ")
    shown = F.when(F.rlike(url, F.lit("/223/")), "223-ФЗ").when(F.rlike(url, F.lit("/(?:ea20|ea44|ok20|zk20)/")), "44-ФЗ") if url is not None else F.lit(None).cast("string")
    return F.coalesce(said, shown, F.lit(""))


def _price(segs: Column) -> Column:
    return _first(F.transform(_values(segs, "price"), lambda v: F.regexp_extract(v, r"^[^0-9]{0,40}([0-9][0-9\s]*(?:[.,][0-9]{1,2})?)", 1)))


def _deadline(text: Column, segs: Column) -> Column:
    labelled = _first(F.transform(F.filter(segs, lambda s: s["kind"] == "deadline"), lambda s: _found(s["value"], rf"^[^0-9]{{0,60}}({DOTTED_DAY})", 1)))
    return _time(F.coalesce(labelled, _found(text, rf"\bдо\b[^0-9]{{0,60}}({DOTTED_DAY})", 1)), 0)


TERMS = ("advance_required", "advance_percent", "postpayment_days", "application_security_percent", "contract_security_percent")


def _details(text: Column, segs: Column, terms: Column, url: Column) -> Column:
    inn = _first(F.transform(F.filter(segs, lambda s: s["kind"] == "inn"), lambda s: t.tax_id(F.regexp_extract(s["value"], r"^[\s:№]*(\d(?: ?\d){9}(?: ?\d ?\d)?)(?!\d)", 1))))
    region = F.coalesce(unblank(_region(segs)), named_region(text))
    return F.struct(
        law(text, url).alias("law_type"),
        first_phrase(text, METHODS).alias("procurement_method"),
        first_phrase(text, STATES).alias("status"),
        _customer(segs).alias("customer"),
        F.coalesce(inn, F.lit("")).alias("customer_inn"),
        region.alias("region"),
        t.number(_price(segs)).alias("price"),
        _publication(text, segs).alias("published_at"),
        _deadline(text, segs).alias("deadline"),
        *[terms[f].alias(f) for f in TERMS],
    )


def details(c: Column, url: Column) -> Column:
    """All fields of a detail page's text as one struct; the text is scanned for labels once."""
    return once(_one_line(c), lambda text: once(segments(text), lambda segs: once(sentence_terms(text), lambda terms: _details(text, segs, terms, url))))


RECOVERED = ("customer", "customer_inn", "law_type", "region")


def recovered(c: Column, url: Column, **known: Column) -> Column:
    """The fields of RECOVERED, each from its column where that is not blank and from the page's text else."""
    return once(details(c, url), lambda found: F.struct(*[F.coalesce(t.blank_to_null(known[f]), found[f]).alias(f) for f in RECOVERED]))
