"""The given star-schema tables seen as procurement tables.

Every mapping is a projection over a scan (and at most two equi-joins), so filters and column
lists still reach the Parquet reader.  The same expressions serve the SQL side: only the
spelling of a number of days differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant at which "now" stands in all compared queries.
NOW = "1998-08-02 00:00:00"
NOW_SPARK = f"TIMESTAMP_NTZ'{NOW}'"
NOW_SQL = f"TIMESTAMP '{NOW}'"

_TENDER = """
  o_orderkey AS tender_id,
  {platform} AS platform,
  CAST(o_orderkey AS STRING) AS external_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'Поставка подшипников' WHEN 1 THEN 'Закупка муфт и ПОЛУМУФТ' WHEN 2 THEN 'Муфта'
       WHEN 3 THEN 'Техническое обслуживание станков' ELSE 'Поставка комплектующих' END AS title,
  concat('https://', {platform}, '.example/procedure/', CAST(o_orderkey AS STRING)) AS url,
  CASE o_orderkey % 6
    WHEN 0 THEN 'Поставка подшипников для оборудования. Аванс 30%. Отсрочка платежа 45 календарных дней. Обеспечение заявки 2%. Обеспечение исполнения контракта 10%.'
    WHEN 1 THEN 'Ремонт станков. Предоплата 15,5%. Срок оплаты 20 рабочих дней. ИНН 7701234567'
    WHEN 2 THEN 'Поставка офисных кресел и столов'
    WHEN 3 THEN 'Строительство станции и монтаж оборудования. Обеспечение заявки 120%'
    WHEN 4 THEN ''
    ELSE 'Поставка оборудования: насосы и редукторы. Постоплата 7 дней; обеспечение договора 35%. ИНН: 78 01 23 45 67' END AS description,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price,
  'RUB' AS currency,
  o_orderdate AS start_date,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate + {days}(CAST(o_orderkey % 40 AS INT)) END AS end_date,
  o_orderdate AS published_at,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate + {days}(CAST(o_orderkey % 30 AS INT)) END AS deadline,
  n_name AS region,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE c_name END AS customer,
  CASE WHEN o_orderkey % 4 = 0 THEN lpad(CAST(o_custkey AS STRING), 10, '7') WHEN o_orderkey % 4 = 1 THEN 'bad 12' ELSE '' END AS customer_inn,
  CASE o_orderpriority WHEN '1-URGENT' THEN '44-ФЗ' WHEN '2-HIGH' THEN '223-ФЗ' ELSE '' END AS law_type,
  CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS advance_required,
  CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE CAST(o_orderkey % 50 AS DOUBLE) END AS advance_percent,
  CASE WHEN o_orderkey % 6 < 2 THEN NULL ELSE CAST(o_orderkey % 90 AS INT) END AS postpayment_days,
  CASE WHEN o_orderkey % 7 < 2 THEN NULL ELSE CAST(o_orderkey % 9 AS DOUBLE) END AS application_security_percent,
  CASE WHEN o_orderkey % 8 < 2 THEN NULL ELSE CAST(o_orderkey % 45 AS DOUBLE) END AS contract_security_percent,
  CASE o_orderkey % 7 WHEN 0 THEN 'partial' WHEN 1 THEN 'failed' WHEN 2 THEN '' WHEN 3 THEN 'OK' ELSE 'success' END AS detail_status,
  CASE o_orderkey % 4 WHEN 0 THEN '{{"document_text":"Предоплата 30%. Отсрочка платежа 45 календарных дней.","lot":"Лот 1"}}'
       WHEN 1 THEN '{{"details":{{"Срок поставки":"30 дней","code":"x1"}},"organizer":"ООО Вектор, ИНН 7812345678"}}'
       WHEN 2 THEN 'not json' ELSE NULL END AS raw_data,
  o_orderdate AS first_seen_at,
  o_orderdate + {days}(CAST(o_orderkey % 5 AS INT)) AS updated_at
"""
_PLATFORM = "CASE o_orderkey % 6 WHEN 0 THEN 'eis' WHEN 1 THEN 'b2b_center' WHEN 2 THEN 'fabrikant' WHEN 3 THEN 'rts_tender' WHEN 4 THEN 'tmk' ELSE 'rosatom' END"
_ANALYSIS = """
  o_orderkey AS tender_id, CAST((o_orderkey * 37) % 101 AS INT) AS relevance_score,
  CASE WHEN (o_orderkey * 37) % 101 >= 80 THEN 'participate' WHEN (o_orderkey * 37) % 101 >= 70 THEN 'review' WHEN o_orderkey % 50 = 7 THEN 'other' ELSE 'skip' END AS recommendation,
  o_orderdate AS analyzed_at
"""

TENDERS_SQL = (
    "SELECT " + _TENDER.format(platform=_PLATFORM, days="to_days") + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
)
ANALYSES_SQL = "SELECT " + _ANALYSIS + " FROM orders WHERE o_orderkey % 3 <> 0"
#: Opens a query over both tables.
WITH = f"WITH tenders AS ({TENDERS_SQL}), analyses AS ({ANALYSES_SQL})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt over all cores where it has fewer files than there are; larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def tenders(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """One row per procurement notice; ``heavy`` for queries whose work per row is large, which a small table's one file would leave to one core."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    orders = spread(orders) if heavy else orders
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return joined.selectExpr(*items(_TENDER.format(platform=_PLATFORM, days="make_dt_interval")))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one model analysis a tender."""
    return table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").selectExpr(*items(_ANALYSIS))


def items(text: str) -> list[str]:
    """The items of a select list: commas outside brackets and quotes part them."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(text[start:i].strip())
                start = i + 1
    return [*out, text[start:].strip()]


_PROFILE = """
  CAST(c_nationkey * 10 + ascii(c_mktsegment) % 10 AS BIGINT) AS profile_id, concat('user', CAST(c_nationkey % 7 AS STRING)) AS user_id,
  concat(c_mktsegment, ' ', CAST(c_nationkey AS STRING)) AS name,
  CASE WHEN c_nationkey % 6 = 0 THEN NULL ELSE CAST(count(*) * 500 AS DOUBLE) END AS min_price,
  CASE WHEN c_nationkey % 4 = 0 THEN 300000.0 WHEN c_nationkey % 11 = 1 THEN -1.0 END AS max_price,
  c_nationkey % 5 = 0 AS want_advance, CAST(c_nationkey % 3 * 10 AS DOUBLE) AS min_advance_percent,
  CASE WHEN c_nationkey % 3 = 1 THEN 60 END AS max_postpayment_days, CAST(c_nationkey % 2 * 7 AS INT) AS min_submission_days,
  0.0 AS min_application_security_percent, CASE WHEN c_nationkey % 2 = 0 THEN 5.0 END AS max_application_security_percent,
  CAST(c_nationkey % 2 AS DOUBLE) AS min_contract_security_percent, CASE WHEN c_nationkey % 7 = 0 THEN 0.5 END AS max_contract_security_percent,
  CAST(c_nationkey * 5 AS INT) AS min_ai_score, c_nationkey % 8 <> 0 AS enabled,
  CASE c_nationkey % 4 WHEN 0 THEN {l}'подшипник'{r} WHEN 1 THEN {l}'станок', 'муфта'{r} WHEN 2 THEN {l}'поставка оборудования'{r} ELSE {l}'Ремонт станка'{r} END AS keywords,
  CASE WHEN c_nationkey % 3 = 0 THEN {l}min(n_name), ' '{r} ELSE {l}'нет такого'{r} END AS regions
"""
PROFILES_SQL = "SELECT " + _PROFILE.format(l="[", r="]") + " FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey, c_mktsegment"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search profile per nation and market segment."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counted = joined.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.min("n_name").alias("nation"))
    text = _PROFILE.format(l="array(", r=")").replace("count(*)", "n").replace("min(n_name)", "nation")
    return counted.selectExpr(*items(text))


RUNS_SQL = """SELECT CAST(o_custkey AS BIGINT) AS profile_id, o_orderkey AS search_number, o_orderdate AS finished_at, CAST(o_orderkey % 40 AS INT) AS found,
  CAST(o_orderkey % 20 AS INT) AS filtered, CAST(o_orderkey % 7 AS INT) AS new_count, CAST(o_orderkey % 3 AS INT) AS notified FROM orders"""


def profile_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run of a profile."""
    return table(spark, sf_dir, "orders").selectExpr(*items(RUNS_SQL[len("SELECT ") : RUNS_SQL.rindex(" FROM orders")]))


#: Versions of a tender over time, from the lines of an order.
VERSIONS_SQL = """SELECT l_orderkey AS tender_id, CAST(l_linenumber AS INT) AS seq, l_shipdate AS observed_at, l_extendedprice AS price, l_linestatus AS title,
  CASE WHEN l_quantity < 10 THEN NULL ELSE l_returnflag END AS region FROM lineitem"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*items(VERSIONS_SQL[len("SELECT ") : VERSIONS_SQL.rindex(" FROM lineitem")]))


BOARD_SQL = """SELECT event_id, user_id AS tender_id, ts,
  CASE WHEN event_id % 11 = 0 THEN 'assign' WHEN event_id % 13 = 0 THEN 'unassign' WHEN event_id % 7 = 0 THEN 'label_add' WHEN event_id % 17 = 0 THEN 'label_remove' ELSE 'status' END AS kind,
  CASE WHEN event_id % 11 = 0 THEN concat('user', CAST(event_id % 5 AS STRING)) WHEN event_id % 13 = 0 THEN ''
       WHEN event_id % 7 = 0 OR event_id % 17 = 0 THEN CASE event_id % 4 WHEN 0 THEN 'Срочно' WHEN 1 THEN 'срочно ' WHEN 2 THEN 'VIP' ELSE 'архив' END
       ELSE CASE event_type WHEN 'view' THEN 'reviewing' WHEN 'click' THEN 'participating' WHEN 'signup' THEN 'docs_preparation' WHEN 'purchase' THEN 'submitted' ELSE 'skipped' END END AS value,
  event_id % 19 = 0 AS force FROM events"""


def board_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, assignment and label events of the board."""
    return as_board_events(table(spark, sf_dir, "events"))


def as_board_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(*items(BOARD_SQL[len("SELECT ") : BOARD_SQL.rindex(" FROM events")]))
