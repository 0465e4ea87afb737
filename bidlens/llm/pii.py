"""Personal data replaced by keyed surrogates of the same type and format.

Found: e-mail addresses, phone numbers, IPv4 addresses, card numbers, US social security numbers,
IBANs, secrets after a key word or in the form of a well-known service's keys, and names after a title.  A surrogate is a function of a key,
the type and the entity's canonical form (digits only, lower case), so one entity has one
surrogate in all texts and formats.  It keeps the format: digits for digits, letters of
the same script and case for letters, octets for octets, a given name of the title's
gender, the country code of a phone number with "+", valid check digits of cards and IBANs.  A family name has one surrogate, with and
without a given name; a full name that a text gives with a title is replaced there without it too.  Two entities with one surrogate, or a
surrogate that equals a real entity, are given another attempt until all differ - of those that clash, the one with fewest attempts
and then the smallest canonical form keeps its own; from the
attempt WIDE on the format gives way where it leaves too few surrogates.  DataFrame functions
only; the text is read twice and never shuffled while the exceptions are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, unused

KEY = "bidlens"
#: Entities whose first surrogate clashed; up to so many are carried as a literal map.
LITERAL_EXCEPTIONS = 5_000
#: From this attempt on mail names grow longer, phone numbers change their country, and secrets become hex digits.
WIDE = 8

_WORD = r"\p{L}\p{N}"
EMAIL = rf"(?<![{_WORD}._%+-])[{_WORD}._%+-]++@[{_WORD}-]++(?:\.[{_WORD}-]++)++"
SECRET = r"(?i:(?<=token = \")|(?<=token=\")|(?<=token=)|(?<=password=)|(?<=password = )|(?<=password:)|(?<=password: )|(?<=passwd=)|(?<=passwd: )|(?<=secret=)|(?<=api_key=)|(?<=apikey=))[A-Za-z0-9_\-]{8,128}"
# How keys of well-known services begin.
SERVICE = r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[0-9A-Za-z_-]{35}|xox[abp]-[0-9A-Za-z-]{10,72}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9_-])"
SERVICE_HEAD = r"^(?:AKIA|gh[pousr]_|AIza|xox[abp]-|sk-)"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
PHONE = r"(?<![\d.+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![\w-])"
CARD = r"(?<![\d.])\d{4}(?:[ -]?\d{4}){3}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d)(?!\.\d)"
# Country codes are free of prefixes, so digits alone tell how long one is, wherever the number is spaced.
COUNTRY = r"^\+(?:[17]|2\D*[07]|3\D*[0-469]|4\D*[013-9]|5\D*[1-8]|6\D*[0-6]|8\D*[1246]|9\D*[0-58]|\d\D*\d\D*\d)"
# Titles with their gender.
MALE = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "г-н"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "г-жа"]
NEUTRAL = ["Dr", "Prof", "Professor", "Доктор", "Профессор"]
#: Given names by which a title without gender is read as a woman's, beside those that end in "a".
WOMEN = ["jane", "mary", "elizabeth", "susan", "karen", "ruth", "alice", "grace", "rachel", "любовь"]
_TITLES = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
NAME = rf"\b(?:{_TITLES})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
_FIRST = "".join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL}))
# What starts with a letter starts a word, and numbers start with one of a few characters: most places of a text are passed by one look.
ANY = rf"(?<![{_WORD}])(?:{EMAIL}|(?<=[=:\" ]){SECRET}|(?=[Agxs]){SERVICE}|(?=[{_FIRST}]){NAME}|(?=[A-Z]){IBAN})|(?=[\d+(])(?:{PHONE}|{CARD}|{SSN}|{IP})"

GIVEN_MALE = ["Adam", "Boris", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leon", "Marco", "Niels", "Oscar", "Paul"]
GIVEN_FEMALE = ["Alma", "Bella", "Clara", "Diana", "Emma", "Freya", "Greta", "Hanna", "Irina", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula"]
GIVEN_MALE_CYRILLIC = ["Адам", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Иван", "Кирилл", "Лев", "Марк", "Никита", "Олег", "Павел", "Роман", "Семён"]
GIVEN_FEMALE_CYRILLIC = ["Алла", "Белла", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья"]
_HEX, _LATIN, _CYRILLIC, _GREEK = "0123456789abcdef", "bcdfghjklmnpqrst", "бвгджзклмнпрстфх", "αβγδεζηθικλμνξοπ"
_VOWELS, _VOWELS_CYRILLIC = "aeiouaeiouaeioua", "аеиоуаеиоуаеиоуа"


def _bare(e: Column) -> Column:
    return F.regexp_replace(e, rf"^(?:{_TITLES})\.? ", "")


def _kind(e: Column) -> Column:
    def full(pattern: str) -> Column:
        return F.rlike(e, F.lit(f"^(?:{pattern})$"))

    named = full(NAME.replace(r"\b", ""))
    given = F.lower(F.substring_index(_bare(e), " ", 1))
    woman = F.rlike(e, F.lit(f"^(?:{'|'.join(FEMALE)})\\.? ")) | (F.rlike(e, F.lit(f"^(?:{'|'.join(NEUTRAL)})\\.? ")) & (given.isin(*WOMEN) | F.rlike(given, F.lit("[aа]$"))))
    name = F.when(~F.contains(_bare(e), F.lit(" ")), "family").when(woman, "name-f").otherwise("name-m")
    out = F.when(F.contains(e, F.lit("@")), "email").when(named, name)
    for pattern, kind in ((CARD, "card"), (SSN, "ssn"), (IP, "ip"), (PHONE, "phone")):
        out = out.when(full(pattern), kind)
    return out.when(full(IBAN.replace(r"\b", "")), "iban").otherwise("secret")


def _canonical(e: Column, kind: Column) -> Column:
    """The form that all spellings of one entity share."""
    return (
        F.when(kind == "phone", F.regexp_replace(e, r"[^\d+]", ""))
        .when(kind.isin("card", "ssn"), F.regexp_replace(e, r"\D", ""))
        .when(kind.isin("family", "name-f", "name-m"), F.lower(_bare(e)))
        .when(kind == "iban", F.regexp_replace(F.upper(e), " ", ""))
        .when(kind == "email", F.lower(e))
        .otherwise(e)
    )


def _family_of(kind: Column, canonical: Column) -> Column:
    return F.when(kind.startswith("name"), F.substring_index(canonical, " ", -1)).otherwise(canonical)


def _stream(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """128 keyed hex digits."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, canonical, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\x1f+")), 256))


def _digits(stream: Column) -> Column:
    """120 decimal digits, all alike in frequency: 15 of each 60-bit number in the stream."""
    return F.concat(*[F.right(F.lpad(F.conv(F.substring(stream, 16 * i + 1, 15), 16, 10), 19, "0"), F.lit(15)) for i in range(8)])


def _shaped(text: Column, stream: Column) -> Column:
    """text with every digit and letter replaced after the stream; the n-th of them by its n-th digit."""
    digits = _digits(stream)
    latin, cyrillic, greek = (F.translate(stream, _HEX, a) for a in (_LATIN, _CYRILLIC, _GREEK))
    chars = F.filter(F.split(text, ""), lambda c: F.rlike(c, F.lit(r"[\p{L}\p{N}]")))

    def other(c: Column, i: Column) -> Column:
        nth = F.pmod(i, F.lit(120)) + 1
        low = F.when(F.rlike(c, F.lit(r"\p{IsCyrillic}")), F.substring(cyrillic, nth, F.lit(1))).when(F.rlike(c, F.lit(r"\p{IsGreek}")), F.substring(greek, nth, F.lit(1))).otherwise(F.substring(latin, nth, F.lit(1)))
        return F.when(F.rlike(c, F.lit("[0-9]")), F.substring(digits, nth, F.lit(1))).when(F.rlike(c, F.lit(r"\p{Lu}")), F.upper(low)).when(F.rlike(c, F.lit(r"\p{L}")), low).otherwise(c)

    # what stands between two of them stays; splitting there leaves one piece more than characters
    between = F.split(text, r"[\p{L}\p{N}]", -1)
    return F.array_join(F.zip_with(between, F.transform(chars, other), lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")


def _with_check_digit(card: Column) -> Column:
    """A card number whose last digit makes its Luhn sum a multiple of ten."""
    number = F.regexp_replace(card, r"\D", "")
    turned = F.reverse(F.split(F.substr(number, F.lit(1), F.length(number) - 1), ""))
    doubled = F.transform(turned, lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10).otherwise(c.cast("int")))
    check = F.pmod(-F.aggregate(doubled, F.lit(0), lambda n, d: n + d), F.lit(10))
    return F.concat(F.substr(card, F.lit(1), F.length(card) - 1), check.cast("string"))


def _with_check_pair(iban: Column) -> Column:
    """An IBAN whose third and fourth characters make it 1 modulo 97."""
    country, rest = F.substring(iban, 1, 2), F.substr(iban, F.lit(5))
    moved = F.split(F.concat(F.replace(rest, F.lit(" "), F.lit("")), country, F.lit("00")), "")
    left = F.aggregate(moved, F.lit(0), lambda n, c: F.when(F.rlike(c, F.lit("[0-9]")), (n * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97))
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), rest)


def _byte(stream: Column, i: int) -> Column:
    return F.conv(F.substring(stream, 2 * i + 1, 2), 16, 10).cast("int")


def _pick(names: list[str], stream: Column, i: int) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), F.pmod(_byte(stream, i), F.lit(len(names))) + 1)


def _family(canonical: Column, stream: Column) -> Column:
    """A family name in the script of canonical, in lower case."""

    def syllables(consonants: str, vowels: str) -> Column:
        c, v = F.translate(stream, _HEX, consonants), F.translate(stream, _HEX, vowels)
        return F.concat(*[x for i in range(9, 17, 2) for x in (F.substring(c, i, 1), F.substring(v, i + 1, 1))])

    russian = F.concat(syllables(_CYRILLIC, _VOWELS_CYRILLIC), F.when(canonical.endswith("а"), "ва").otherwise("в"))
    return F.when(F.rlike(canonical, F.lit(r"\p{IsCyrillic}")), russian).otherwise(F.concat(syllables(_LATIN, _VOWELS), F.lit("n")))


def _given(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """A given name of the kind's gender in the script of canonical; from WIDE on of two, then three names."""
    stream = _stream(kind, F.substring_index(canonical, " ", 1), attempt, key)
    russian, female = F.rlike(canonical, F.lit(r"\p{IsCyrillic}")), kind == "name-f"

    def pick(i: int) -> Column:
        latin = F.when(female, _pick(GIVEN_FEMALE, stream, i)).otherwise(_pick(GIVEN_MALE, stream, i))
        return F.when(russian, F.when(female, _pick(GIVEN_FEMALE_CYRILLIC, stream, i)).otherwise(_pick(GIVEN_MALE_CYRILLIC, stream, i))).otherwise(latin)

    more = [F.when(attempt >= n * WIDE, F.concat(F.lit("-"), pick(n))).otherwise("") for n in (1, 2)]
    return F.concat(pick(0), *more)


def _surrogate(x: Column, key: str) -> Column:
    """The replacement of the entity struct x (e, kind, canonical, attempt, stream, family), in e's own format; a name without its title."""
    e, kind, stream, wide = x["e"], x["kind"], x["stream"], x["attempt"] >= WIDE
    host = F.substring_index(e, "@", -1)
    mailhost = F.concat(_shaped(F.substring_index(host, ".", 1), _stream(F.lit("host"), F.lower(host), F.lit(0), key)), F.lit(".example."), F.substring_index(host, ".", -1))
    longer = F.when(wide, F.translate(F.substring(stream, 100, 8), _HEX, _LATIN)).otherwise("")
    email = F.concat(_shaped(F.substring_index(e, "@", 1), stream), longer, F.lit("@"), mailhost)
    phone_head = F.when(wide, "").otherwise(F.regexp_extract(e, COUNTRY, 0))
    hexed = F.substring(stream, F.lit(1), F.length(e))
    family = F.initcap(x["family"])
    name = F.when(kind == "family", family).otherwise(F.concat(_given(kind, x["canonical"], x["attempt"], key), F.lit(" "), family))
    bare, head = _bare(e), F.regexp_extract(e, SERVICE_HEAD, 0)
    return (
        F.when(kind == "email", email)
        .when(kind.isin("family", "name-f", "name-m"), F.when(bare == F.upper(bare), F.upper(name)).otherwise(name))
        .when(kind == "ip", F.array_join(F.array(*[(F.pmod(_byte(stream, i), F.lit(254)) + 1).cast("string") for i in range(4)]), "."))
        .when(kind == "phone", F.concat(phone_head, _shaped(F.substr(e, F.length(phone_head) + 1), stream)))
        .when(kind == "card", _with_check_digit(_shaped(e, stream)))
        .when(kind == "iban", _with_check_pair(F.concat(F.substring(e, 1, 2), _shaped(F.substr(e, F.lit(3)), stream))))
        .when((kind == "secret") & (head != ""), F.concat(head, _shaped(F.substr(e, F.length(head) + 1), stream)))
        .when((kind == "secret") & (wide | F.rlike(e, F.lit("^[0-9a-f]+$"))), hexed)
        .when((kind == "secret") & F.rlike(e, F.lit("^[0-9A-F]+$")), F.upper(hexed))
        .otherwise(_shaped(e, stream))
    )


def described(entities: Column) -> Column:
    """Array of (e, kind, canonical) structs for an array of entities; each step is evaluated once an entity."""
    kinds = F.transform(entities, lambda e: F.struct(e.alias("e"), _kind(e).alias("kind")))
    return F.transform(kinds, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), _canonical(x["e"], x["kind"]).alias("canonical")))


def surrogates(entities: Column, attempt, key: str) -> Column:
    """Array of surrogates, names without titles, for an array of described entities; attempt maps a kind and a canonical form to their number of tries."""
    tried = F.transform(
        entities,
        lambda x: F.struct(
            x["e"].alias("e"), x["kind"].alias("kind"), x["canonical"].alias("canonical"), attempt(x["kind"], x["canonical"]).alias("attempt"), _family_of(x["kind"], x["canonical"]).alias("of")
        ),
    )

    def keyed(x: Column) -> Column:
        stream = _stream(x["kind"], x["canonical"], x["attempt"], key)
        named = x["kind"].isin("family", "name-f", "name-m")
        family = F.when(named, _family(x["of"], _stream(F.lit("family"), x["of"], attempt(F.lit("family"), x["of"]), key)))
        return F.struct(x["e"].alias("e"), x["kind"].alias("kind"), x["canonical"].alias("canonical"), x["attempt"].alias("attempt"), stream.alias("stream"), family.alias("family"))

    return F.transform(F.transform(tried, keyed), lambda x: _surrogate(x, key))


def _spelled(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """The surrogate in canonical form, which has to be unique; of a full name only the given name is new, its family name is an entity by itself."""
    one = F.array(F.struct(canonical.alias("e"), kind.alias("kind"), canonical.alias("canonical")))
    other = F.get(F.transform(surrogates(one, lambda k, c: attempt, key), lambda s: _canonical(s, kind)), 0)
    full = F.concat(F.lower(_given(kind, canonical, attempt, key)), F.lit(" "), F.substring_index(canonical, " ", -1))
    return F.when(kind.startswith("name"), full).otherwise(other)


def find_entities(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Distinct (kind, canonical) over all texts; the family name of a full name is an entity too."""
    def with_family(x: Column) -> Column:
        own = F.struct(x["kind"].alias("kind"), x["canonical"].alias("canonical"))
        family = F.struct(F.lit("family").alias("kind"), _family_of(x["kind"], x["canonical"]).alias("canonical"))
        return F.when(x["kind"].startswith("name"), F.array(own, family)).otherwise(F.array(own))

    found = described(F.array_distinct(F.regexp_extract_all(f"`{text_col}`", F.lit(ANY), 0)))
    return docs.select(F.explode(F.flatten(F.transform(found, with_family))).alias("x")).select("x.kind", "x.canonical").distinct()


def clashing(entities: DataFrame, key: str, most: int = 20) -> DataFrame:
    """(kind, canonical, attempt) for entities whose first surrogate is another's or a real entity."""
    now = entities.withColumn("attempt", F.lit(0))
    late = None
    for _ in range(most):
        made = materialize(now.select("kind", "canonical", "attempt", _spelled(F.col("kind"), F.col("canonical"), F.col("attempt"), key).alias("s")), "made")
        taken = made.groupBy("kind", "s").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count("*").alias("n"))
        real = entities.where(~F.col("kind").startswith("name")).select("kind", F.col("canonical").alias("s"), F.lit(True).alias("real"))
        judged = made.join(taken.where("n > 1").select("kind", "s", "first"), ["kind", "s"], "left").join(real, ["kind", "s"], "left")
        again = judged.where("real or (first is not null and (first.canonical <> canonical or first.attempt <> attempt))").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        new = materialize(again, "clashes")
        if not new.limit(1).count():
            break
        kept = new if late is None else late.join(new, ["kind", "canonical"], "left_anti").unionByName(new)
        late = materialize(kept, "exceptions")
        now = entities.join(late, ["kind", "canonical"], "left").select("kind", "canonical", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    else:
        raise RuntimeError(f"{new.count()} surrogates still clash after {most} attempts")
    return late if late is not None else entities.limit(0).withColumn("attempt", F.lit(0))


def replace_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """docs with surrogates in text_col, and n_entities (which replaces a column of that name).

    Null texts stay null with 0 entities; texts without entities, empty ones among them, stay as they are.  Ids
    are not used: a text's surrogates depend on the entities in it alone, so repeated rows stay alike.  A very long text's entities are one array.
    An empty table stays empty.  Other columns, whatever their names, pass unchanged.
    """
    kept_columns = [c for c in docs.columns if c.lower() != "n_entities"]
    docs = docs.select(*[f"`{c}`" for c in kept_columns])
    text = F.col(f"`{text_col}`")
    entities = materialize(find_entities(docs, text_col=text_col), "entities")
    late = clashing(entities, key)
    few = late.limit(LITERAL_EXCEPTIONS + 1).collect()
    found = F.regexp_extract_all(text, F.lit(ANY), 0)
    rows = docs
    mine, late_map, known, fresh = unused(docs, "digest", "late", "known", "fresh")
    if len(few) <= LITERAL_EXCEPTIONS:
        pairs = [x for r in few for x in (F.lit(f"{r['kind']}\x1f{r['canonical']}"), F.lit(r["attempt"]))]
        attempts = F.create_map(*pairs) if pairs else None
    else:
        digest = F.sha2(text, 256)
        of = docs.select(digest.alias("digest"), F.explode(described(F.array_distinct(found))).alias("x")).select("digest", "x.kind", "x.canonical")
        of = of.unionByName(of.where(F.col("kind").startswith("name")).select("digest", F.lit("family").alias("kind"), _family_of(F.col("kind"), F.col("canonical")).alias("canonical"))).distinct()
        by_text = of.join(late, ["kind", "canonical"]).groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "canonical"), "attempt"))).alias("late"))
        by_text = materialize(by_text, "late").select(F.col("digest").alias(mine), F.col("late").alias(late_map))
        rows = docs.join(by_text, digest == F.col(mine), "left")
        attempts = F.col(late_map)

    def attempt(kind: Column, canonical: Column) -> Column:
        if attempts is None:
            return F.lit(0)
        return F.coalesce(F.try_element_at(attempts, F.concat_ws("\x1f", kind, canonical)), F.lit(0))

    rows = rows.withColumn(known, described(found)).withColumn(fresh, surrogates(F.col(known), attempt, key))
    said = F.arrays_zip(F.col(known).alias("x"), F.col(fresh).alias("s"))
    titled = F.transform(said, lambda z: F.concat(F.regexp_extract(z["x"]["e"], rf"^(?:{_TITLES})\.? ", 0), z["s"]))
    full = F.array_distinct(F.transform(F.filter(said, lambda z: z["x"]["kind"].startswith("name")), lambda z: F.struct(_bare(z["x"]["e"]).alias("old"), z["s"].alias("new"))))

    def bare_names(names: Column) -> Column:
        def step(t: Column, n: Column) -> Column:
            return F.regexp_replace(t, F.concat(F.lit(rf"(?<![{_WORD}])\Q"), n["old"], F.lit(rf"\E(?![{_WORD}])")), n["new"])

        return F.when(F.size(names) == 0, parts).otherwise(F.transform(parts, lambda part: F.aggregate(names, part, step)))

    parts = F.split(text, ANY, -1)
    between = F.get(F.transform(F.array(full), bare_names), 0)
    joined = F.array_join(F.zip_with(between, titled, lambda part, s: F.concat(part, F.coalesce(s, F.lit("")))), "")
    n = F.when(F.col(known).isNull(), 0).otherwise(F.size(known))
    out = [F.when(n > 0, joined).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in kept_columns]
    return rows.select(*out, n.cast("long").alias("n_entities"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents with surrogates for personal data."""
    return replace_pii(documents(spark, sf_dir)).select("doc_id", "text", "n_entities")
