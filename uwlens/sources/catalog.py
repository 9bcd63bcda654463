"""Explicit schemas for the 20 operational tables and the loader that checks them.

Types are the ones the report SQL implies (there is no DDL upstream).  A column is declared by a
*family* rather than one exact type where the source systems disagree: temporal columns may arrive
as DATE or TIMESTAMP, money may arrive as DECIMAL or as text ("$1,234.50").  Loading checks names
and families and projects the declared columns only, so every scan is pruned to what reports use.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# family -> accepted Spark types
_FAMILIES: dict[str, tuple[type, ...]] = {
    "id": (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType),
    "flag": (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.BooleanType, T.DecimalType),
    "text": (T.StringType,),
    "time": (T.TimestampType, T.TimestampNTZType, T.DateType),
    "date_or_text": (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType),
    "money": (T.DecimalType, T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.StringType),
}

SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "bms_submission_mst": [
        ("submission_id", "id"), ("submission_code", "text"), ("created_dt", "time"),
        ("user_id_accexecutive", "id"), ("original_producer_id", "id"),
        ("flg_active", "flag"), ("purge_status", "flag"),
    ],
    "bms_quote_mst": [
        ("quote_id", "id"), ("submission_id", "id"), ("quote_code", "text"), ("policy_number", "text"),
        ("created_dt", "time"), ("quote_dt", "time"), ("bind_dt", "time"), ("trans_finalize_dt", "time"),
        ("lkp_transaction_type_id", "id"), ("status_id", "id"), ("original_producer_id", "id"),
        ("flg_active", "flag"), ("purge_status", "flag"),
    ],
    "bms_options_mst": [
        ("quote_id", "id"), ("product_id", "id"), ("business_id", "id"), ("user_id_acc_executive", "id"),
        ("created_dt", "time"), ("updated_dt", "time"), ("effective_dt", "date_or_text"),
        ("proposed_eff_date", "time"), ("proposed_exp_date", "time"),
        ("sub_total_premium", "money"), ("total_fee_taxable", "money"), ("total_fee_non_taxable", "money"),
        ("flg_active", "flag"),
    ],
    "bms_quote_insured_mst": [
        ("quote_id", "id"), ("insured_name", "text"), ("adr_phy_city", "text"),
        ("adr_phy_state_code", "text"), ("adr_phy_zip", "text"),
    ],
    "bms_tracers": [
        ("quote_id", "id"), ("tracer_sub_type_id", "id"), ("created_dt", "time"), ("tracer_desc", "text"),
    ],
    "adm_bm_tracer_sub_types": [("tracer_sub_type_id", "id"), ("tracer_type_code", "text")],
    "dms_file_mst": [
        ("file_id", "id"), ("submission_number", "text"), ("flg_active", "flag"), ("purge_status", "flag"),
    ],
    "dms_document_detail_mst": [
        ("file_id", "id"), ("created_dt", "time"), ("document_name", "text"), ("purge_status", "flag"),
    ],
    "adm_co_users": [
        ("user_id", "id"), ("first_name", "text"), ("middle_name", "text"), ("last_name", "text"),
    ],
    "adm_co_agencies": [
        ("agency_id", "id"), ("agency_code", "text"), ("agency_name", "text"), ("flg_active", "flag"),
    ],
    "adm_bm_lkp_transaction_types": [("lkp_id", "id"), ("lkp_desc", "text")],
    "adm_bm_statuses": [("status_id", "id"), ("status_code", "text"), ("main_status_text", "text")],
    "adm_co_products": [("product_id", "id"), ("product_name", "text"), ("class_type_id", "id")],
    "adm_co_class_types": [("class_type_id", "id"), ("class_type_name", "text")],
    "bms_locations": [("location_id", "id"), ("business_id", "id")],
    "bms_building_mst": [("location_id", "id"), ("flg_active", "flag")],
    "adm_co_lkp_email_process_parameters": [("lkp_id", "id"), ("lkp_code", "text")],
    "bms_email_confirmation_details": [
        ("quote_id", "id"), ("business_id", "id"), ("lkp_email_process_parameter_id", "id"),
        ("flg_active", "flag"), ("created_dt", "time"),
    ],
    "bms_template_memos": [
        ("quote_id", "id"), ("business_id", "id"), ("lkp_email_process_parameters_id", "id"),
        ("flg_active", "flag"), ("created_dt", "time"),
    ],
    "bms_quote_closed": [
        ("quote_id", "id"), ("flg_active", "flag"), ("flg_decline", "flag"), ("created_dt", "time"),
    ],
}

TABLE_NAMES: tuple[str, ...] = tuple(SCHEMAS)


class SchemaError(ValueError):
    pass


_CHECKED = "_uwlens_checked_as"


def check_schema(df: DataFrame, name: str) -> DataFrame:
    """Validate ``df`` against the declared table and project the declared columns in order.

    Idempotent: a frame already checked as ``name`` is returned as is (same object, so anything
    memoised on it - e.g. a broadcast size probe - is kept)."""
    if getattr(df, _CHECKED, None) == name:
        return df
    actual = {f.name.lower(): f for f in df.schema.fields}
    cols = []
    for col, family in SCHEMAS[name]:
        f = actual.get(col.lower())
        if f is None:
            raise SchemaError(f"{name}: missing column {col}")
        if not isinstance(f.dataType, _FAMILIES[family]):
            raise SchemaError(f"{name}.{col}: type {f.dataType.simpleString()} is not a {family}")
        cols.append(df[f.name].alias(col))
    out = df.select(*cols)
    try:
        setattr(out, _CHECKED, name)
    except AttributeError:  # pragma: no cover
        pass
    return out


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Read one operational table (parquet by default) and check it against its declaration."""
    return check_schema(spark.read.format(fmt).load(path), name)


@dataclass
class Tables:
    """The 20 operational tables a report run reads; each is a lazily evaluated DataFrame."""

    bms_submission_mst: DataFrame
    bms_quote_mst: DataFrame
    bms_options_mst: DataFrame
    bms_quote_insured_mst: DataFrame
    bms_tracers: DataFrame
    adm_bm_tracer_sub_types: DataFrame
    dms_file_mst: DataFrame
    dms_document_detail_mst: DataFrame
    adm_co_users: DataFrame
    adm_co_agencies: DataFrame
    adm_bm_lkp_transaction_types: DataFrame
    adm_bm_statuses: DataFrame
    adm_co_products: DataFrame
    adm_co_class_types: DataFrame
    bms_locations: DataFrame
    bms_building_mst: DataFrame
    adm_co_lkp_email_process_parameters: DataFrame
    bms_email_confirmation_details: DataFrame
    bms_template_memos: DataFrame
    bms_quote_closed: DataFrame

    def __post_init__(self) -> None:
        for f in fields(self):
            setattr(self, f.name, check_schema(getattr(self, f.name), f.name))


def load_tables(spark: SparkSession, root: str, fmt: str = "parquet", as_of: date | None = None) -> Tables:
    """Load every operational table from ``root/<table>`` (a parquet file or directory), or, with ``as_of``, from
    the snapshot of that date that was published under ``root`` (``snapshots``)."""
    if as_of is not None:
        from .snapshots import load_snapshot

        return load_snapshot(spark, root, as_of)
    return Tables(**{n: read_table(spark, f"{root}/{n}", n, fmt) for n in TABLE_NAMES})
