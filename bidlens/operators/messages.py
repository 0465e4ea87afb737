"""Texts that people read, assembled from columns; nulls have their words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as t
from .market import PLATFORM_NAMES, label

# Recommendations in messages, and words for what is not known.
ADVICE = {"participate": "Участвовать", "skip": "Пропустить", "review": "На проверку"}
NO_TITLE, NO_CUSTOMER, NO_VALUE, NO_PLATFORM = "Без названия", "Заказчик не указан", "не указан", "Не указана"
STUB = "\n<i>(ИИ-заглушка — используется вместо локального Ollama)</i>"
MOST_RISKS = 3


def _safe(c: Column, without: str = "") -> Column:
    return t.escape_html(F.coalesce(F.nullif(c, F.lit("")), F.lit(without)))


def alert_message() -> Column:
    """The alert on a tender and its analysis: score, platform, title, price, deadline, customer, summary, at most three risks, advice, link."""
    price = F.coalesce(F.concat(t.thousands(F.col("price")), F.lit(" "), F.col("currency")), F.lit(NO_VALUE))
    deadline = F.coalesce(F.date_format("deadline", "dd.MM.yyyy"), F.lit(NO_VALUE))
    named = F.slice(F.coalesce("risks", F.array().cast("array<string>")), 1, MOST_RISKS)
    risks = F.when(F.size(named) > 0, F.concat(F.lit("\n⚠️ <b>Риски:</b> "), F.array_join(F.transform(named, t.escape_html), "; "))).otherwise("")
    platform = _safe(label("platform", PLATFORM_NAMES), NO_PLATFORM)
    return F.concat(
        F.when(F.col("relevance_score") >= 70, "🔔").otherwise("📋"),
        F.format_string(" <b>Новый тендер (%s/100)</b>\n\n", F.col("relevance_score").cast("string")),
        F.format_string("🏷️ <b>Площадка:</b> %s\n📋 %s\n", platform, _safe(F.col("title"), NO_TITLE)),
        F.format_string("💰 %s | ⏰ до %s\n🏢 %s\n\n", price, deadline, _safe(F.col("customer"), NO_CUSTOMER)),
        F.format_string("📝 %s\n%s\n", _safe(F.col("summary")), risks),
        F.format_string("💡 <b>Рекомендация:</b> %s%s\n\n", _safe(label("recommendation", ADVICE)), F.when(F.coalesce("is_stub", F.lit(False)), STUB).otherwise("")),
        F.format_string('🔗 <a href="%s">Открыть тендер</a>', _safe(F.col("url"))),
    )


# The wording of a result in a list, of a tender's description for the model, and of the question around it.
UNPRICED, UNDATED = "не указана", "не указана"
PARTIAL = "ВНИМАНИЕ: детали загружены частично; отсутствующие поля считать неизвестными, а не подтверждёнными."
DIAGNOSED = "Диагностика деталей: присутствует; внутренний текст диагностики модели не передаётся"
QUESTION = (
    "Проанализируй следующий тендер.\n\nСначала определи РЕАЛЬНЫЙ ПРЕДМЕТ ЗАКУПКИ. Затем сравни его с контекстом пользователя.\n\n"
    "Не ставь высокий score только из-за отдельного совпадения ключевого слова. Оценивай именно то, что фактически закупается.\n\n"
    "Если категория прямо указана в контексте пользователя, считай её интересующей категорией. Не переопределяй интерес пользователя самостоятельно.\n\n"
    "Не придумывай отсутствующие сведения.\n"
)
CONTEXT = ("\n\n=== КОНТЕКСТ ПОЛЬЗОВАТЕЛЯ ===\nЭто реальные требования пользователя. Используй их как основной критерий релевантности.\n\n", "\n=== КОНЕЦ КОНТЕКСТА ПОЛЬЗОВАТЕЛЯ ===\n")
DATA = ("\n=== ДАННЫЕ ТЕНДЕРА ===\n", "\n=== КОНЕЦ ДАННЫХ ТЕНДЕРА ===\n\nВерни только требуемый JSON.")


def result_message(place: Column) -> Column:
    """One tender of a numbered list of results: title, day, customer, region, price, deadline, and a link where there is one."""
    day = F.coalesce(F.date_format(F.coalesce("published_at", "start_date"), "dd.MM.yyyy"), F.lit(UNDATED))
    price = F.coalesce(F.concat(t.thousands(F.col("price")), F.lit(" "), F.col("currency")), F.lit(UNPRICED))
    link = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit('\n🔗 <a href="'), t.escape_html(F.col("url")), F.lit('">Открыть тендер</a>'))).otherwise("")
    return F.concat(
        F.lit("<b>"), place.cast("string"), F.lit(". "), _safe(F.col("title"), NO_TITLE), F.lit("</b>\n📅 дата закупки: "), day,
        F.lit("\n🏢 "), _safe(F.col("customer"), NO_VALUE), F.lit("\n📍 регион: "), _safe(F.col("region"), NO_VALUE), F.lit("\n💰 "), price,
        F.lit("\n⏰ до "), F.coalesce(F.date_format("deadline", "dd.MM.yyyy"), F.lit(NO_VALUE)), link,
    )


def _plain(c: Column) -> Column:
    """A number with at least one decimal and no zeros after it."""
    return F.regexp_replace(c.cast("decimal(24,6)").cast("string"), r"(\.\d+?)0+$", "$1")


def tender_text(text: Column) -> Column:
    """A tender as lines for the model; what is unknown has no line.  ``text`` is its full text."""

    def line(head: str, value: Column, tail: str = "") -> Column:
        return t.once(value.cast("string"), lambda v: F.when(v != "", F.concat(F.lit(head), v, F.lit(tail))))

    advance = F.concat(F.lit("Аванс: да ("), F.coalesce(_plain(F.col("advance_percent")), F.lit("?")), F.lit("%)"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Площадка: "), F.coalesce("platform", F.lit(""))),
        F.concat(F.lit("Название: "), F.coalesce("title", F.lit(""))),
        F.concat(F.lit("Статус деталей: "), F.coalesce("detail_status", F.lit(""))),
        F.when(F.coalesce("detail_diagnostics", F.lit("")) != "", DIAGNOSED),
        line("Заказчик: ", F.col("customer")),
        line("ИНН заказчика: ", F.col("customer_inn")),
        line("Регион: ", F.col("region")),
        F.concat(F.lit("Начальная цена: "), _plain(F.col("price")), F.lit(" "), F.col("currency")),
        F.concat(F.lit("Срок подачи: "), F.date_format("deadline", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")),
        line("Тип закупки: ", F.col("law_type")),
        F.when(F.col("advance_required"), advance),
        line("Постоплата/отсрочка: ", F.col("postpayment_days"), " дней"),
        line("Обеспечение заявки: ", _plain(F.col("application_security_percent")), "%"),
        line("Обеспечение контракта: ", _plain(F.col("contract_security_percent")), "%"),
        F.when(F.col("detail_status") == "partial", PARTIAL),
        line("Описание/предмет закупки: ", F.coalesce(t.once(text, lambda v: F.when(v != "", v)), F.col("description"))),
    )


def user_prompt(text: Column, context: Column) -> Column:
    """The question on a tender's text, with the user's requirements where there are some."""
    block = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(CONTEXT[0]), context, F.lit(CONTEXT[1]))).otherwise("")
    return F.concat(F.lit(QUESTION), block, F.lit(DATA[0]), text, F.lit(DATA[1]))
