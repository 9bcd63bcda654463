"""Deterministic mapping from the driver's TPC-H-like tables to the 20 operational tables.

The reports read an insurance MGA database (submissions, quotes, options, documents, tracers, ...).
The test harness only ships TPC-H-like parquet, so every operational table is *derived* from those
tables by one SQL statement each.  The same text runs unchanged in Spark SQL and in DuckDB, which is
what makes the DuckDB oracle independent of the Spark code path: both engines start from the same
derived rows.  The derivation plants NULL flags, purged rows, unparsable dates, ties, blank names and
orphan lookups on purpose (see FIXTURES.md).

Nothing in the core library imports this module; plans only see a ``Tables`` object.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import bytes_of, materialized
from ..session import deal_by_size
from .catalog import Tables, TABLE_NAMES, read_table

# Source tables of the driver's test data that the mapping reads.
SOURCE_TABLES = ("orders", "lineitem", "customer", "nation", "region", "part")

# Fixed fixture parameters (FIXTURES.md §3).
FIXTURE_AS_OF = "2001-06-15"
FIXTURE_COHORT_YEARS = (1995, 2001)
FIXTURE_QUARTER = ("2001-04-01", "2001-06-30")

FIXTURE_SQL: dict[str, str] = {
    "bms_submission_mst": """
SELECT o_orderkey AS submission_id, 'SUB' || CAST(o_orderkey AS STRING) AS submission_code, CAST(o_orderdate AS DATE) AS created_dt,
  o_custkey % 20 AS user_id_accexecutive, CASE WHEN o_custkey % 97 = 0 THEN NULL ELSE o_custkey % 25 END AS original_producer_id,
  CASE WHEN o_custkey % 41 = 0 THEN 0 WHEN o_custkey % 7 = 0 THEN NULL ELSE 1 END AS flg_active,
  CASE WHEN o_orderkey % 53 = 0 THEN 1 WHEN o_orderkey % 3 = 0 THEN NULL ELSE 0 END AS purge_status FROM orders
""",
    "bms_quote_mst": """
SELECT quote_id, submission_id, 'Q' || CAST(quote_id AS STRING) AS quote_code, created_dt, quote_dt, bind_dt,
  CASE WHEN fin = 'F' THEN bind_dt + 10 END AS trans_finalize_dt,
  CASE WHEN bind_dt IS NOT NULL THEN 'POL' || CAST(quote_id AS STRING) WHEN quote_id % 11 = 0 THEN '  ' END AS policy_number,
  quote_id % 10 AS lkp_transaction_type_id, quote_id % 8 + 1 AS status_id,
  CASE WHEN quote_id % 4 = 0 THEN cust % 25 END AS original_producer_id,
  CASE WHEN quote_id % 43 = 0 OR cust % 25 = 13 OR (cust % 25 IN (11, 12) AND quote_id % 13 <> 0) OR (cust % 25 = 14 AND quote_id % 5 <> 0) THEN 0 WHEN quote_id % 9 = 0 THEN NULL ELSE 1 END AS flg_active,
  CASE WHEN quote_id % 59 = 0 THEN 1 WHEN quote_id % 2 = 0 THEN 0 END AS purge_status
FROM (SELECT l_orderkey * 7 + l_linenumber - 1 AS quote_id, l_orderkey AS submission_id, MIN(o_custkey) AS cust, MIN(l_linestatus) AS fin,
  MIN(CAST(o_orderdate AS DATE)) + MIN(l_linenumber) AS created_dt, CASE WHEN MIN(l_linenumber) % 2 = 0 THEN MIN(CAST(o_orderdate AS DATE)) + MIN(l_linenumber) + 3 END AS quote_dt,
  CASE WHEN MIN(l_orderkey * 7 + l_linenumber - 1) % 23 <= MIN(o_custkey) % 25 THEN MIN(CAST(o_orderdate AS DATE)) + MIN(CAST(l_quantity AS INT)) * 2 + CASE WHEN MIN(o_custkey) % 25 IN (14, 20) THEN 120 ELSE 0 END END AS bind_dt
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, l_linenumber) q
""",
    "bms_options_mst": """
SELECT l_orderkey * 7 + l_linenumber - 1 AS quote_id, l_partkey AS product_id, l_partkey % 50 AS business_id, l_suppkey % 20 AS user_id_acc_executive,
  CAST(l_shipdate AS DATE) AS created_dt, CASE WHEN l_partkey % 3 = 0 THEN CAST(l_shipdate AS DATE) + 15 END AS updated_dt,
  CASE WHEN l_suppkey % 37 = 0 THEN 'n/a' ELSE CAST(CAST(o_orderdate AS DATE) + CAST(l_quantity AS INT) + 20 AS STRING) END AS effective_dt,
  CAST(o_orderdate AS DATE) + CAST(l_quantity AS INT) + 30 AS proposed_eff_date, CAST(o_orderdate AS DATE) + CAST(l_quantity AS INT) + 395 AS proposed_exp_date,
  CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS sub_total_premium,
  CAST(l_quantity AS DECIMAL(18,2)) AS total_fee_taxable, CASE WHEN l_tax > 0 THEN CAST(l_tax * 100 AS DECIMAL(18,2)) END AS total_fee_non_taxable,
  CASE WHEN l_partkey % 29 = 0 THEN 0 WHEN l_partkey % 13 = 0 THEN NULL ELSE 1 END AS flg_active
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
""",
    "bms_quote_insured_mst": """
SELECT DISTINCT l_orderkey * 7 + l_linenumber - 1 AS quote_id, c_name AS insured_name, ' City ' || CAST(c_custkey % 12 AS STRING) AS adr_phy_city,
  n_name AS adr_phy_state_code, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE lpad(CAST(c_custkey % 99999 AS STRING), 5, '0') END AS adr_phy_zip
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
""",
    "bms_tracers": """
SELECT l_orderkey * 7 + l_linenumber - 1 AS quote_id, l_suppkey % 3 AS tracer_sub_type_id, CAST(o_orderdate AS DATE) + CAST(l_quantity AS INT) AS created_dt,
  CASE l_partkey % 7 WHEN 0 THEN 'Quote Sent' WHEN 1 THEN 'Renewal Quote Sent' WHEN 2 THEN 'Endorsement 1 start on policy No. 7' WHEN 3 THEN 'Endorsement 1 Finalized on policy No. 7'
  WHEN 4 THEN 'Internal Endorsement start on policy No. 7' WHEN 5 THEN 'Internal Endorsement Finalized on policy No. 7' ELSE 'Quote note' END AS tracer_desc
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
""",
    "adm_bm_tracer_sub_types": """
SELECT r_regionkey AS tracer_sub_type_id, CASE WHEN r_regionkey < 2 THEN 'SSPNS' ELSE 'OTHER' END AS tracer_type_code FROM region
""",
    "dms_file_mst": """
SELECT o_orderkey AS file_id, 'SUB' || CAST(o_orderkey AS STRING) AS submission_number, CASE WHEN o_orderkey % 47 = 0 THEN 0 WHEN o_orderkey % 5 = 0 THEN NULL ELSE 1 END AS flg_active, CASE WHEN o_orderkey % 61 = 0 THEN 1 END AS purge_status FROM orders
""",
    "dms_document_detail_mst": """
SELECT l_orderkey AS file_id, CAST(o_orderdate AS DATE) + CAST(l_quantity AS INT) AS created_dt, CASE WHEN l_partkey % 67 = 0 THEN 1 END AS purge_status,
  CASE l_partkey % 9 WHEN 0 THEN ' Quote to Agent ' WHEN 1 THEN 'Re: quote to ag v2' WHEN 2 THEN 'Signed RTB form' WHEN 3 THEN 'Request to Bind' WHEN 4 THEN 'Binder to Agt'
  WHEN 5 THEN 'Endt to Agent' WHEN 6 THEN 'Policy to Agent' WHEN 7 THEN 'DBI Renewal Invoice 3' ELSE 'Loss runs' END AS document_name
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
""",
    "adm_co_users": """
SELECT n_nationkey AS user_id, ' ' || n_name AS first_name, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN '' ELSE 'M' END AS middle_name, CASE WHEN n_nationkey % 5 = 0 THEN ' ' WHEN n_nationkey = 7 THEN NULL ELSE 'Last' || CAST(n_nationkey AS STRING) || ' ' END AS last_name FROM nation WHERE n_nationkey <> 19
""",
    "adm_co_agencies": """
SELECT n_nationkey AS agency_id, CASE n_nationkey WHEN 0 THEN 'AGT001' WHEN 1 THEN 'AGT002' WHEN 2 THEN 'AGT044' WHEN 3 THEN 'AGT070' WHEN 4 THEN 'AGT071' WHEN 5 THEN 'AGT055' WHEN 6 THEN 'AGT059'
  WHEN 7 THEN 'AGT092' WHEN 8 THEN 'AGT093' WHEN 9 THEN 'HOUSE' WHEN 10 THEN NULL ELSE 'AGT' || CAST(100 + n_nationkey AS STRING) END AS agency_code, n_name AS agency_name, CASE WHEN n_nationkey = 24 THEN 0 WHEN n_nationkey = 23 THEN NULL ELSE 1 END AS flg_active FROM nation
""",
    "adm_bm_lkp_transaction_types": """
SELECT n_nationkey AS lkp_id, CASE n_nationkey WHEN 0 THEN 'New Business' WHEN 1 THEN 'Renewal' WHEN 2 THEN 'Renewals' WHEN 3 THEN 'Endorsement' WHEN 4 THEN 'Endorsements' WHEN 5 THEN 'Cancellation'
  WHEN 6 THEN 'Cancel Pro Rata' WHEN 7 THEN 'Notice of Cancellation 10 Day' ELSE 'Audit' END AS lkp_desc FROM nation WHERE n_nationkey < 9
""",
    "adm_bm_statuses": """
SELECT n_nationkey AS status_id, CASE n_nationkey WHEN 1 THEN 'NB_QUOTE_OFFERED' WHEN 2 THEN 'NB_BINDER_CANCELLED' WHEN 3 THEN 'NB_BINDER_REQUESTED' WHEN 4 THEN 'REN_QUOTE_OFFERED' WHEN 5 THEN 'REN_BINDER_CANCELLED' WHEN 6 THEN 'REN_BINDER_REQUESTED' ELSE 'CLOSED' END AS status_code,
  CASE n_nationkey WHEN 1 THEN 'New Business Quote Offered' ELSE 'Status ' || CAST(n_nationkey AS STRING) END AS main_status_text FROM nation WHERE n_nationkey BETWEEN 1 AND 7
""",
    "adm_co_products": """
SELECT p_partkey AS product_id, ' ' || p_name AS product_name, p_size % 6 AS class_type_id FROM part
""",
    "adm_co_class_types": """
SELECT r_regionkey AS class_type_id, r_name || ' ' AS class_type_name FROM region
""",
    "bms_locations": """
SELECT n_nationkey AS location_id, n_nationkey * 2 AS business_id FROM nation
""",
    "bms_building_mst": """
SELECT n_nationkey AS location_id, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 1 END AS flg_active FROM nation
""",
    "adm_co_lkp_email_process_parameters": """
SELECT r_regionkey AS lkp_id, CASE r_regionkey WHEN 0 THEN 'QUOTE' WHEN 1 THEN 'RENEWAL_QUOTE' ELSE 'BINDER' END AS lkp_code FROM region
""",
    "bms_email_confirmation_details": """
SELECT l_orderkey * 7 + l_linenumber - 1 AS quote_id, l_partkey % 50 AS business_id, l_suppkey % 4 AS lkp_email_process_parameter_id, CASE WHEN l_suppkey % 11 = 0 THEN 0 ELSE 1 END AS flg_active, CAST(o_orderdate AS DATE) + CAST(l_quantity AS INT) + 2 AS created_dt FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 2 = 0
""",
    "bms_template_memos": """
SELECT l_orderkey * 7 + l_linenumber - 1 AS quote_id, l_partkey % 50 AS business_id, l_suppkey % 3 AS lkp_email_process_parameters_id, CASE WHEN l_suppkey % 13 = 0 THEN 0 ELSE 1 END AS flg_active, CAST(o_orderdate AS DATE) + CAST(l_quantity AS INT) + 1 AS created_dt FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 3 = 0
""",
    "bms_quote_closed": """
SELECT l_orderkey * 7 + l_linenumber - 1 AS quote_id, CASE WHEN l_suppkey % 17 = 0 THEN 0 WHEN l_suppkey % 19 = 0 THEN NULL ELSE 1 END AS flg_active, CASE WHEN l_linestatus = 'F' AND (o_custkey % 25 BETWEEN 16 AND 18 OR l_partkey % 4 = 0) THEN 1 WHEN l_partkey % 5 = 0 THEN NULL ELSE 0 END AS flg_decline, CAST(o_orderdate AS DATE) + CAST(l_quantity AS INT) AS created_dt FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'
""",
}

assert set(FIXTURE_SQL) == set(TABLE_NAMES)

_SOURCE_RE = re.compile(r"\b(" + "|".join(SOURCE_TABLES) + r")\b")


def _spark_text(sql: str) -> str:
    """Turn bare source-table names into ``spark.sql`` DataFrame placeholders."""
    return _SOURCE_RE.sub(lambda m: "{" + m.group(1) + "}", sql)


def fixture_cte(names: list[str] | tuple[str, ...]) -> str:
    """``WITH`` clause defining the given operational tables over the raw test tables (DuckDB/ANSI)."""
    parts = [f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in names]
    return "WITH " + ",\n".join(parts)


#: The join below every table of a line's grain.
_LINES = "lineitem JOIN orders ON o_orderkey = l_orderkey"


def _line_rows(src: dict[str, DataFrame]) -> DataFrame:
    """``_LINES`` joined once and staged, with the columns that some table is made from."""
    text = " ".join(FIXTURE_SQL.values())
    lines, orders = ([c for c in src[n].columns if re.search(rf"\b{c}\b", text)] for n in ("lineitem", "orders"))
    return materialized(src["lineitem"].select(*lines).join(src["orders"].select(*orders), F.expr("o_orderkey = l_orderkey")))


def derive_tables(spark: SparkSession, sf_dir: str, lines_once: bool = False) -> Tables:
    """Build all 20 operational tables lazily from the raw test tables under ``sf_dir``.

    Each table is one Spark SQL statement over DataFrame parameters, so no session-global view is
    created and Catalyst prunes every derivation down to the columns a report reads.  The session's shuffles
    get partitions in proportion to the source files (``session.deal_by_size``).  With ``lines_once`` the join of
    lines and orders, below most of the tables, is written once and read by each: for queries that read many of
    the tables, which would shuffle both sides again for each.
    """
    src = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in SOURCE_TABLES}
    deal_by_size(spark, sum(bytes_of(df) for df in src.values()))
    given = src | ({"line_rows": _line_rows(src)} if lines_once else {})
    frames: dict[str, DataFrame] = {}
    for name, sql in FIXTURE_SQL.items():
        text = _spark_text(sql.replace(_LINES, "{line_rows}") if lines_once else sql)
        frames[name] = spark.sql(text, **{n: df for n, df in given.items() if f"{{{n}}}" in text})
    return Tables(**frames)


def materialize(spark: SparkSession, sf_dir: str, out_dir: str) -> Tables:
    """Write the derived tables once as parquet under ``out_dir`` and return readers over them.

    Reports then run against plain parquet scans (pushdown, pruning, row-group statistics), which is
    how they run on real operational extracts.
    """
    derived = derive_tables(spark, sf_dir)
    for name in TABLE_NAMES:
        getattr(derived, name).write.mode("overwrite").parquet(f"{out_dir}/{name}")
    return Tables(**{n: read_table(spark, f"{out_dir}/{n}", n) for n in TABLE_NAMES})
