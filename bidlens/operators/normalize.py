"""Record normalisation: times, terms, texts, merges and the detail contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

TIMES = ("start_date", "end_date", "published_at", "deadline")
# Keys of the raw record that hold searchable text, required detail fields, known statuses.
RAW_TEXT_KEYS = ("details", "lots", "lot", "specification", "specifications", "items", "products", "document_text", "document_contents", "attachments_text", "document_search_text")
TERM_TEXT_KEYS = ("details", "document_text", "document_contents", "attachments_text")
DETAIL_STATUSES = ("success", "partial", "failed")
REQUIRED = ("title", "url", "customer", "price", "deadline")
BLOCKED_TEXT = "Площадка вернула блокировку/WAF/CAPTCHA"


def to_utc(df: DataFrame, columns: tuple[str, ...] = TIMES, offset: str = "+03:00") -> DataFrame:
    """Zone-less times of a fixed offset to UTC."""
    return df.withColumns({c: F.convert_timezone(F.lit(offset), F.lit("UTC"), F.col(c)) for c in columns})


def raw_value(key: str, raw: str = "raw_data") -> Column:
    return F.get_json_object(raw, f"$.{key}")


def full_text(raw: str = "raw_data") -> Column:
    """All searchable text of a tender, blank-joined, blanks left out."""
    parts = [F.col(c) for c in ("title", "description", "customer", "region", "customer_inn")]
    parts += [t.flatten_json(raw_value(k, raw)) for k in RAW_TEXT_KEYS]
    return F.array_join(F.filter(F.transform(F.array(*parts), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), " ")


def enrich_terms(df: DataFrame) -> DataFrame:
    """Fill null terms from the texts; an advance is required where its percentage is known and positive."""
    text = F.trim(F.regexp_replace(F.concat_ws(" ", "description", *[t.flatten_json(raw_value(k)) for k in TERM_TEXT_KEYS]), r"(?U)\s+", " "))
    out = df.withColumn("_text", text)
    out = out.withColumns(
        {
            "advance_percent": F.coalesce("advance_percent", t.percent_near(F.col("_text"), t.ADVANCE)),
            "postpayment_days": F.coalesce("postpayment_days", t.days_near(F.col("_text"), t.POSTPAYMENT)),
            "application_security_percent": F.coalesce("application_security_percent", t.percent_near(F.col("_text"), t.APPLICATION_SECURITY)),
            "contract_security_percent": F.coalesce("contract_security_percent", t.percent_near(F.col("_text"), t.CONTRACT_SECURITY)),
        }
    )
    known = F.col("advance_percent").isNotNull() & (F.col("_text") != "")
    return out.withColumn("advance_required", F.when(known, F.col("advance_percent") > 0).otherwise(F.col("advance_required"))).drop("_text")


def customer_tax_id() -> Column:
    """The tax id from the column, the raw record, or a labelled text."""
    raw = [t.tax_id(raw_value(k)) for k in ("customer_inn", "inn", "customerInn", "customer_inn_number")]
    text = F.concat_ws(" ", "customer", "description", raw_value("details"), raw_value("customer"), raw_value("organizer"))
    return F.coalesce(*[t.blank_to_null(c) for c in (t.tax_id(F.col("customer_inn")), *raw, t.labelled_tax_id(text))], F.lit(""))


def detail_contract(df: DataFrame) -> DataFrame:
    """detail_status and detail_diagnostics by the contract: blocked pages fail, missing fields demote to partial."""
    blocked = F.coalesce(raw_value("waf_blocked"), F.lit("false")).isin("true", "1") | F.coalesce(raw_value("captcha"), F.lit("false")).isin("true", "1") | F.coalesce(raw_value("access_blocked"), F.lit("false")).isin("true", "1")
    gaps = [F.when(F.col(c).isNull() if c in ("price", "deadline") else F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(c)) for c in REQUIRED]
    missing = F.array_compact(F.array(*gaps))
    given = F.lower(F.coalesce(F.nullif(F.col("detail_status"), F.lit("")), F.lit("success")))
    status = F.when(given.isin(*DETAIL_STATUSES), given).otherwise("success")
    demoted = F.when((F.size("_missing") > 0) & (status == "success"), "partial").otherwise(status)
    note = F.when(F.size("_missing") > 0, F.concat(F.lit("Отсутствуют поля: "), F.array_join("_missing", ", ")))
    told = F.left(F.concat_ws("; ", note), F.lit(4000))
    return df.withColumn("_missing", missing).withColumns(
        {
            "detail_status": F.when(blocked, "failed").otherwise(demoted),
            "detail_diagnostics": F.when(blocked, F.coalesce(raw_value("detail_diagnostics"), F.lit(BLOCKED_TEXT))).otherwise(told),
        }
    ).drop("_missing")


def merge_detail(listing: DataFrame, detail: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Listing rows with every detail value that is neither null nor ''; 0 counts as a value."""
    joined = listing.alias("l").join(detail.alias("d"), key, "left")
    kinds = dict(listing.dtypes)

    def merged(c: str) -> Column:
        mine = F.nullif(F.col(f"d.{c}"), F.lit("")) if kinds[c] == "string" else F.col(f"d.{c}")
        return F.coalesce(mine, F.col(f"l.{c}")).alias(c)

    return joined.select(key, *[merged(c) if c in columns else F.col(f"l.{c}") for c in listing.columns if c != key])


def evolve(old: DataFrame, new_columns: dict[str, tuple[str, object]]) -> DataFrame:
    """old with missing columns added: name to (type, default); present columns get the default where null."""
    return old.withColumns(
        {c: (F.coalesce(F.col(c), F.lit(d).cast(kind)) if c in old.columns else F.lit(d).cast(kind)) for c, (kind, d) in new_columns.items()}
    )


# The fields that a detail page's value replaces.
MERGED = (
    "title", "description", "price", "currency", "start_date", "end_date", "deadline", "published_at", "region", "customer", "customer_inn", "law_type",
    "advance_percent", "postpayment_days", "application_security_percent", "contract_security_percent", "url",
)
DIAGNOSTICS_MOST = 4000


def merge_detail_full(listing: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """A listing's rows with what their detail pages say: all MERGED fields, the advance flag, provenance, documents, status and diagnostics.

    A value that is neither null nor '' wins.  A known advance percentage decides the flag.  Provenance maps are merged key by key, the detail's value first; documents are the
    detail's where it has some.  An unknown status counts as success, diagnostics are cut to 4,000 characters.  A deadline that is still unknown is the
    end date.  Rows without a detail page stay as they are, but for the deadline.
    """
    kinds = dict(listing.dtypes)
    joined = listing.alias("l").join(detail.withColumn("_detailed", F.lit(True)).alias("d"), key, "left")
    has = F.col("d._detailed").isNotNull()

    def won(c: str) -> Column:
        mine = F.nullif(F.col(f"d.{c}"), F.lit("")) if kinds[c] == "string" else F.col(f"d.{c}")
        return F.coalesce(mine, F.col(f"l.{c}"))

    out = {c: won(c) for c in MERGED}
    out["deadline"] = F.coalesce(out["deadline"], out["end_date"])
    percent = F.col("d.advance_percent")
    out["advance_required"] = F.when(percent.isNotNull(), percent > 0).when(F.col("d.advance_required"), True).otherwise(F.col("l.advance_required"))
    none = F.create_map().cast("map<string,string>")
    out["field_sources"] = F.map_zip_with(F.coalesce("l.field_sources", none), F.coalesce("d.field_sources", none), lambda k, a, b: F.coalesce(b, a))
    out["documents"] = F.when(F.size("d.documents") > 0, F.col("d.documents")).otherwise(F.col("l.documents"))
    status = F.lower(F.coalesce(F.nullif(F.col("d.detail_status"), F.lit("")), F.lit("success")))
    out["detail_status"] = F.when(~has, F.col("l.detail_status")).when(status.isin(*DETAIL_STATUSES), status).otherwise("success")
    out["detail_diagnostics"] = F.when(has, F.left(F.coalesce("d.detail_diagnostics", F.lit("")), F.lit(DIAGNOSTICS_MOST))).otherwise(F.col("l.detail_diagnostics"))
    return joined.select(key, *[(out[c] if c in out else F.col(f"l.{c}")).alias(c) for c in listing.columns if c != key])
