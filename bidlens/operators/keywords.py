"""Keyword matching as an equi-join of tokens with expanded word forms.

A word matches a whole token that equals it or, from six letters on, consists of the word
less its last two letters and a known noun ending.  So a keyword's words are expanded to at
most 43 literal forms each, a text's distinct tokens are exploded once, and all
keywords of all profiles are matched in one join instead of one scan a keyword.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import for_matching, for_search, once, tokens

# Noun endings, generic keywords and the context words that they need.
SUFFIXES = (
    "а", "я", "ы", "и", "е", "о", "у", "ю", "ь", "ов", "ев", "ей", "ам", "ям", "ом", "ем", "ах", "ях", "ами", "ями", "ою", "ею", "ой", "ью",
    "ик", "ика", "ику", "иком", "ике", "ики", "иков", "иками", "иках", "к", "ка", "ку", "ком", "ке", "ки", "ков", "ками", "ках",
)
GENERIC = ("поставка оборудования", "поставка комплектующих", "поставка запасных частей", "запасные части", "комплектующие", "техническое обслуживание")
CONTEXT = (
    "насос", "насосы", "насосного", "насосная", "компрессор", "компрессоры", "компрессорного", "бульдозер", "бульдозеры", "автогрейдер", "автогрейдера",
    "камаз", "маз", "howo", "трактор", "тракторы", "сельскохозяйственной техники", "сельскохозяйственная техника", "автотранспорт", "автотранспортных средств",
    "транспортных средств", "транспортной техники", "дорожных машин", "дорожные машины", "швейных машин", "швейные машины", "вычислительных машин", "принтер", "принтеров",
    "мфу", "станок", "станки", "станочного", "подшипник", "подшипники", "муфта", "муфты", "полумуфта", "полумуфты", "редуктор", "редукторы", "редукторный", "электрооборудование",
    "электротехническое оборудование", "оборудование связи", "сервер", "серверы", "серверного", "компьютер", "компьютеры", "компьютерного", "оргтехника", "медицинское оборудование",
    "пожарной техники", "пожарная техника", "видеонаблюдение", "пожарная сигнализация", "система пожарной сигнализации", "системы пожарной сигнализации",
    "системы видеонаблюдения", "система видеонаблюдения", "оборудование для дск", "дск",
)
# Forms of query words that stand for each other.
QUERY_FORMS = {
    "станок": ("станок", "станка", "станки", "станков", "станкам", "станками", "станке", "станком"),
    "подшипник": ("подшипник", "подшипника", "подшипники", "подшипников", "подшипнику", "подшипникам", "подшипником", "подшипниками", "подшипнике", "подшипниках"),
    "лебедка": ("лебедка", "лебедки", "лебедку", "лебедкой", "лебедок", "лебедкам", "лебедками", "лебедкою"),
    "редуктор": ("редуктор", "редуктора", "редукторы", "редукторов", "редукторам", "редукторами", "редукторе", "редуктором"),
}
STEM_FROM = 6
#: Rows of expanded word forms that may be broadcast.
BROADCAST_FORMS = 500_000
#: So many forms may stand in the plan, where they sort out tokens before these become rows.
LITERAL_FORMS = 2_000


def forms(word: Column) -> Column:
    """All tokens that a word matches."""
    stem = F.substring(word, F.lit(1), F.length(word) - 2)
    inflected = F.transform(F.array(*[F.lit(s) for s in SUFFIXES]), lambda s: F.concat(stem, s))
    return F.when(F.length(word) >= STEM_FROM, F.array_distinct(F.concat(F.array(word), inflected))).otherwise(F.array(word))


def keyword_forms(keywords: DataFrame, column: str = "keyword") -> DataFrame:
    """(keyword, n_words, word, form) for distinct keywords; a blank keyword has no row."""
    words = tokens(for_matching(F.col(column)))
    one = keywords.select(F.col(column).alias("keyword")).distinct().select("keyword", words.alias("words")).where(F.size("words") > 0)
    return one.select("keyword", F.size("words").alias("n_words"), F.explode("words").alias("word")).select("keyword", "n_words", "word", F.explode(forms(F.col("word"))).alias("form"))


def keyword_matches(texts: DataFrame, keywords: DataFrame, *, id_col: str, text_col: str, keyword_col: str = "keyword") -> DataFrame:
    """(id, keyword): a keyword matches where each of its words does, in any order and distance."""
    expanded = keyword_forms(keywords, keyword_col)
    words = tokens(for_matching(F.col(text_col)))
    few = [r[0] for r in expanded.select("form").distinct().limit(LITERAL_FORMS + 1).collect()]
    if len(few) <= LITERAL_FORMS:
        words = F.filter(words, lambda w: w.isin(few))
    if expanded.limit(BROADCAST_FORMS + 1).count() <= BROADCAST_FORMS:
        expanded = F.broadcast(expanded)  # tokens that no keyword knows are gone before the shuffle
    said = texts.select(id_col, F.explode(words).alias("form"))
    hits = said.join(expanded, "form").groupBy(id_col, "keyword", "n_words")
    return hits.agg(F.size(F.collect_set("word")).alias("k")).where("k = n_words").select(id_col, "keyword")


def said_keywords(texts: DataFrame, keywords: DataFrame, *, id_col: str, text_col: str, keyword_col: str = "keyword") -> DataFrame:
    """Texts with ``said``, the array of the keywords that match them as in :func:`keyword_matches`.

    While the keywords have few forms (LITERAL_FORMS) these stand in the plan: a text is parted into tokens once, and neither it nor its tokens are shuffled.
    """
    rows = keyword_forms(keywords, keyword_col).limit(LITERAL_FORMS + 1).collect()
    if len(rows) > LITERAL_FORMS:
        found = keyword_matches(texts, keywords, id_col=id_col, text_col=text_col, keyword_col=keyword_col).groupBy(id_col).agg(F.collect_set("keyword").alias("said"))
        return texts.join(found, id_col, "left").withColumn("said", F.coalesce("said", F.array().cast("array<string>")))
    forms_of, words_of = {}, {}
    for r in rows:
        forms_of.setdefault(r["word"], set()).add(r["form"])
        words_of.setdefault(r["keyword"], set()).add(r["word"])
    known = sorted(set().union(*forms_of.values()))

    def whole(held: Column, words: set[str]) -> Column:
        return reduce(Column.__and__, [F.exists(held, _one_of(forms_of[w])) for w in sorted(words)])

    def matching(held: Column) -> Column:
        return F.array_compact(F.array(*[F.when(whole(held, words), F.lit(keyword)) for keyword, words in sorted(words_of.items())]).cast("array<string>"))

    # blanks part tokens however many they are, so they need not be collapsed
    words = tokens(F.translate(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "ё", "е"))
    return texts.withColumn("said", once(F.filter(words, _one_of(known)), matching))


def _one_of(values) -> Callable[[Column], Column]:
    return lambda w: w.isin(sorted(values))


def normal(keyword: str) -> str:
    """A literal keyword in the form in which texts are compared."""
    return " ".join(keyword.lower().replace("ё", "е").split())


def literal_words(keyword: str) -> list[str]:
    """The words of a literal keyword, parted as texts are."""
    return list(dict.fromkeys(re.findall(r"[\w-]+", normal(keyword))))


def literal_forms(word: str) -> list[str]:
    return list(dict.fromkeys([word, *(word[:-2] + s for s in SUFFIXES)])) if len(word) >= STEM_FROM else [word]


def contains(text_tokens: Column, keyword: str) -> Column:
    """The same test for one literal keyword, as an expression over a text's tokens."""
    tests = [F.arrays_overlap(text_tokens, F.array(*[F.lit(f) for f in literal_forms(w)])) for w in literal_words(keyword)]
    out = tests[0] if tests else F.lit(False)
    for x in tests[1:]:
        out = out & x
    return out


def any_of(text_tokens: Column, keywords) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | contains(text_tokens, k)
    return out


def with_tokens(text: str, test: Callable[[Column], Column]) -> Column:
    """A test on the tokens of a text column, which are made once however often the test names them."""
    return F.get(F.transform(F.array(tokens(for_matching(F.col(text)))), test), 0)


def _soft(words: Column, text: str, include, exclude, least: int) -> Column:
    return ~any_of(words, exclude) & ((F.length(text) >= least) | any_of(words, include))


def soft(df: DataFrame, text: str, include, exclude, least: int = 10) -> Column:
    """No excluded keyword, and a text of some length or a direct match."""
    return with_tokens(text, lambda words: _soft(words, text, include, exclude, least))


def quality_gate(platform: str = "b2b_center") -> Column:
    """On one platform only complete details count: customer, price, and a deadline or end."""
    complete = (F.lower("detail_status") != "failed") & (F.trim(F.coalesce("customer", F.lit(""))) != "") & F.col("price").isNotNull() & (F.col("deadline").isNotNull() | F.col("end_date").isNotNull())
    return (F.col("platform") != platform) | complete


def strict(df: DataFrame, text: str, include, exclude, least: int = 10) -> Column:
    """Soft, complete, and a specific keyword, or a generic one in context."""
    known = {normal(g) for g in GENERIC}
    specific, generic = [k for k in include if normal(k) not in known], [k for k in include if normal(k) in known]

    def test(words: Column) -> Column:
        hit = F.lit(not include) | any_of(words, specific) | (any_of(words, generic) & any_of(words, CONTEXT))
        return _soft(words, text, include, exclude, least) & hit

    return quality_gate() & with_tokens(text, test)


def _query_group(query: str) -> tuple[str, tuple[str, ...]]:
    """A query in search form, and the group of forms it belongs to."""
    query = re.sub("[^0-9a-zа-яё]+", " ", query.lower()).strip()
    return query, next((g for g in QUERY_FORMS.values() if query in g), (query,))


def query_relevance(text: Column, query: str) -> Column:
    """The query as part of the text, or any form of its word group as a whole token."""
    query, group = _query_group(query)
    return once(for_search(text), lambda said: F.contains(said, F.lit(query)) | F.arrays_overlap(F.split(said, " "), F.array(*[F.lit(g) for g in group])))


def query_relevance_substring(text: Column, query: str, external_id: Column | None = None) -> Column:
    """The looser rule: any form anywhere in the text; a numeric query has to be the row's id where one is given."""
    query, group = _query_group(query)
    if query.isdigit() and external_id is not None:
        return external_id == query
    return once(for_search(text), lambda said: F.exists(F.array(*[F.lit(g) for g in group]), lambda g: F.contains(said, g)))


#: Letters of a gram; shorter forms are grams themselves.
GRAM = 3
#: So many forms are looked for one after another in each text, which costs less than the text's grams.
FEW_FORMS = 64
#: Grams of all queries that may be broadcast.
BROADCAST_GRAMS = 500_000


def grams(text: Column, sizes: tuple[int, ...] = (GRAM,)) -> Column:
    """Distinct runs of so many letters of a text."""

    def of(chars: Column, q: int) -> Column:
        return F.transform(F.slice(chars, F.lit(1), F.greatest(F.size(chars) - (q - 1), F.lit(0))), lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, q)]))

    # the letters are bound once: inside the lambda they would be parted anew for each of them
    return F.array_distinct(F.flatten(F.get(F.transform(F.array(F.split(text, "")), lambda chars: F.array(*[of(chars, q) for q in sizes])), 0)))


def query_forms(queries: DataFrame, column: str = "query") -> DataFrame:
    """(query, form) of distinct queries in search form: all forms of the group that a query is in, else itself."""
    groups = F.create_map(*[x for g in QUERY_FORMS.values() for form in g for x in (F.lit(form), F.array(*[F.lit(f) for f in g]))])
    normal_form = for_search(F.col(column))
    rows = queries.select(F.col(column).alias("query")).distinct().withColumn("plain", normal_form if column == "query" else for_search(F.col("query"))).where("plain <> ''")
    return rows.select("query", "plain", F.explode(F.coalesce(groups[F.col("plain")], F.array("plain"))).alias("form"))


def substring_matches(texts: DataFrame, queries: DataFrame, *, id_col: str, text_col: str, external_id_col: str | None = None, query_col: str = "query") -> DataFrame:
    """(id, query): texts that hold any form of a query anywhere in their search form; a numeric query has to be the row's external id where one is given.

    A few forms (FEW_FORMS) are looked for in each text.  Of more, each is looked for by its rarest gram in an inverted index of the texts' grams, so a
    query costs what holds that gram and not a look at every text.  The texts' grams are counted, and kept, only where some form has them.
    """
    forms = query_forms(queries, query_col)
    numeric = F.rlike("plain", F.lit("^[0-9]+$"))
    exact = None
    if external_id_col is not None:
        exact = texts.select(id_col, F.col(external_id_col).alias("plain")).join(forms.where(numeric).select("query", "plain").distinct(), "plain").select(id_col, "query")
        forms = forms.where(~numeric)
    said = texts.select(id_col, for_search(F.col(text_col)).alias("said"))
    few = [r["form"] for r in forms.select("form").distinct().limit(FEW_FORMS + 1).collect()]
    met = _met_by_looks(said, forms, few, id_col) if len(few) <= FEW_FORMS else _met_by_grams(said, forms, id_col)
    return met if exact is None else met.unionByName(exact)


def _met_by_looks(said: DataFrame, forms: DataFrame, few: list[str], id_col: str) -> DataFrame:
    """(id, query) by a look for each form, no text leaves its task: a shuffle has ids and queries only."""
    if not few:
        return said.select(id_col, F.lit(None).cast("string").alias("query")).where(F.lit(False))
    held = once(F.col("said"), lambda text: F.filter(F.array(*[F.lit(f) for f in few]), lambda f: F.contains(text, f)))
    return said.select(id_col, F.explode(held).alias("form")).join(F.broadcast(forms.select("query", "form")), "form").select(id_col, "query").distinct()


def _met_by_grams(said: DataFrame, forms: DataFrame, id_col: str) -> DataFrame:
    """(id, query) by each form's rarest gram."""
    size = F.least(F.length("form"), F.lit(GRAM))
    parts = forms.select("query", "form", F.explode(F.when(size == 1, grams(F.col("form"), (1,))).when(size == 2, grams(F.col("form"), (2,))).otherwise(grams(F.col("form")))).alias("gram"))
    wanted = parts.select("gram").distinct()
    if wanted.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        wanted = F.broadcast(wanted)
    lengths = tuple(sorted(r[0] for r in forms.select(size).distinct().collect())) or (GRAM,)  # three at most
    index = said.select(id_col, F.explode(grams(F.col("said"), lengths)).alias("gram")).join(wanted, "gram", "left_semi")
    held = index.groupBy("gram").agg(F.count("*").alias("texts"))
    rarest = parts.join(held, "gram", "left").groupBy("query", "form").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("g")).where("g.texts > 0").select("query", "form", F.col("g.gram").alias("gram"))
    return index.join(rarest, "gram").select(id_col, "query", "form").join(said, id_col).where(F.contains("said", F.col("form"))).select(id_col, "query").distinct()
