"""Text column expressions.  Java regexes are ASCII by default, hence (?U) and (?iU) for Cyrillic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of commercial terms.
ADVANCE = ("аванс", "предоплата", "авансовый платеж", "авансовый платёж", "размер аванса")
POSTPAYMENT = ("отсрочка платежа", "срок оплаты", "постоплата", "отсрочка оплаты")
APPLICATION_SECURITY = ("обеспечение заявки", "обеспечение предложения")
CONTRACT_SECURITY = ("обеспечение исполнения", "обеспечение контракта", "обеспечение договора")
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&laquo;": "«", "&raquo;": "»", "&mdash;": "—", "&amp;": "&"}


def once(value: Column, read: Callable[[Column], Column]) -> Column:
    """read(value), where value is made once however often it is read."""
    return F.get(F.transform(F.array(value), read), 0)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def unescape(c: Column) -> Column:
    """The usual character entities; the ampersand last."""
    for entity, char in _ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def collapse(c: Column) -> Column:
    """Entities decoded, white space runs made one blank, ends trimmed."""
    return F.trim(F.regexp_replace(unescape(c), r"(?U)\s+", " "))


def for_matching(c: Column) -> Column:
    """Lower case, ё as е, blanks collapsed: the form in which keywords are compared."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё ", "е "), r"(?U)\s+", " "))


def for_search(c: Column) -> Column:
    """Lower-cased letters and digits, everything else one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-zа-яё]+", " "))


def tokens(c: Column) -> Column:
    """Distinct runs of letters, digits, _ and - of a text in matching form."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)([\w-]+)"), 1))


def percent_near(c: Column, labels: tuple[str, ...]) -> Column:
    """The first percentage at most 100 other characters after a label; null unless it is 0 to 100."""
    found = F.regexp_extract(c, rf"(?iU)(?:{'|'.join(labels)})[^%\d]{{0,100}}(\d{{1,3}}(?:[.,]\d+)?)\s*%", 1)
    value = F.replace(blank_to_null(found), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value.between(0, 100), value)


def days_near(c: Column, labels: tuple[str, ...]) -> Column:
    """The first number of days at most 100 other characters after a label."""
    found = F.regexp_extract(c, rf"(?iU)(?:{'|'.join(labels)})[^0-9]{{0,100}}(\d{{1,3}})\s*(?:календарн\w*|рабоч\w*)?\s*(?:дн\w*|сут\w*)", 1)
    return blank_to_null(found).try_cast("int")


def tax_id(c: Column) -> Column:
    """The first 10 or 12 digits that adjoin no others, blanks removed; '' if none."""
    return F.coalesce(F.regexp_substr(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""), F.lit(r"(?<!\d)(?:\d{12}|\d{10})(?!\d)")), F.lit(""))


def labelled_tax_id(c: Column) -> Column:
    """The tax id after its label; digits may be spaced."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?iU)(?:ИНН|И\.Н\.Н\.)\s*[:№]?\s*(\d(?:\s*\d){9}(?:\s*\d\s*\d)?)\b", 1)
    return tax_id(found)


def number(c: Column) -> Column:
    """Digits with blanks and a decimal comma or point to double; null otherwise."""
    return F.replace(F.regexp_replace(c, r"(?U)[\s ]", ""), F.lit(","), F.lit(".")).try_cast("double")


def thousands(c: Column) -> Column:
    """Rounded, with blanks between thousands."""
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit(" "))


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def dotted_time(c: Column, zone: str | None = None) -> Column:
    """dd.MM.yyyy[ HH:mm] anywhere in a text; midnight by default; from a zone to UTC if one is named."""
    day = F.regexp_extract(c, r"(\d{2}\.\d{2}\.\d{4})(?:\s+(\d{2}:\d{2}))?", 1)
    time = blank_to_null(F.regexp_extract(c, r"(\d{2}\.\d{2}\.\d{4})(?:\s+(\d{2}:\d{2}))?", 2))
    at = F.try_to_timestamp(F.concat_ws(" ", blank_to_null(day), F.coalesce(time, F.lit("00:00"))), F.lit("dd.MM.yyyy HH:mm")).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), at) if zone else at


def clean_list(c: Column) -> Column:
    """Trimmed, blanks dropped, first spelling of each kept whatever its case."""
    trimmed = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.aggregate(trimmed, none, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


#: Keys and scalars of a JSON text in order; a key keeps its colon.
#: Every repetition is possessive: a repeated group that may give back recurses once a round, and a long value ends the JVM.
_JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:?|-?\d[\d.eE+-]*+|true|false|null'


def flatten_json(c: Column) -> Column:
    """All texts inside a JSON value in order, blank-joined, however deep; keys only where they have a blank or Cyrillic.

    A text that is no JSON object or array stays as it is; a null is ''.
    """

    def said(token: Column) -> Column:
        key = F.endswith(token, F.lit(":"))
        quoted = F.startswith(token, F.lit('"'))
        bare = F.regexp_replace(token, r"\s*:$", "")
        plain = F.when(~quoted, bare).when(F.contains(bare, F.lit("\\")), F.get(F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<string>"), 0)).otherwise(F.substr(bare, F.lit(2), F.length(bare) - 2))
        return F.when(key, F.when(F.rlike(plain, F.lit("[ а-яА-ЯёЁ]")), plain)).when(token != "null", plain)

    def read(text: Column) -> Column:
        tokens = F.filter(F.transform(F.regexp_extract_all(text, F.lit(_JSON_TOKEN), 0), said), lambda x: F.trim(x) != "")
        nested = F.rlike(text, F.lit(r"^\s*[\[{]")) & F.try_parse_json(text).isNotNull()
        return F.trim(F.when(nested, F.array_join(tokens, " ")).otherwise(F.coalesce(text, F.lit(""))))

    return once(c, read)
