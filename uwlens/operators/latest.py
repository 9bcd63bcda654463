"""Top-1 per group as hash aggregates, so that a hot key is reduced before the shuffle.

``top1`` takes the extreme struct of the order keys: struct ordering is lexicographic, so the extreme struct
*is* the first row.  A struct has no fixed-width buffer, so Spark plans that as a sort-based aggregation, which
sorts every row on both sides of the shuffle.  ``top1_hashed`` needs no sort where all columns have a fixed
width (times, numbers, flags): one hash aggregate keeps, per key, the largest *code* - the first order column
and a hash of the row in one decimal(38,0) - and the payload of the row that has it.  A second code with the
hash reversed shows whether another row reaches the same first order value.  Only such keys go on to the
second step, the struct aggregate over their rows.  ``top1_by_id`` does it for payloads of any type: it
aggregates the fixed-width order and id, and fetches the winner by its id.

Either way a key that holds a third of all rows costs one row per task in the shuffle, and no window holds a
whole group.  Ties are broken by the remaining order keys and then the payload, which makes the pick
deterministic where the source ordering leaves it undefined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import money as M
from ..functions.dates import try_date
from .filters import active_lenient
from .lineage import materialized


def top1(df: DataFrame, keys: list[str], order: list[Column], payload: list[str], descending: bool) -> DataFrame:
    """First row per ``keys`` by ``order`` (all descending or all ascending; NULL is the lowest
    value, i.e. NULLS LAST when descending and NULLS FIRST when ascending)."""
    fields = [o.alias(f"_o{i}") for i, o in enumerate(order)] + [F.col(p) for p in payload]
    agg = F.max if descending else F.min
    return df.groupBy(*keys).agg(agg(F.struct(*fields)).alias("_top")).select(
        *keys, *[F.col(f"_top.{p}").alias(p) for p in payload])


_HASH_SPAN = 1 << 62
_STEP = 10**19
_NO_VALUE = 10**18
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_FIXED = _WHOLE + _TIMES + (T.BooleanType, T.DecimalType, T.FloatType, T.DoubleType)


def _big(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def top1_hashed(df: DataFrame, keys: list[str], order: list[Column], payload: list[str], descending: bool) -> DataFrame:
    """``top1`` without a sort, for a first order column that is a time or a whole number below 10^18 in size
    and a payload of fixed width, as a materialised frame; other frames take the sorted way."""
    rows = df.select(*keys, *[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(p).alias(f"_p{i}") for i, p in enumerate(payload)])
    first = rows.schema["_o0"].dataType
    if not isinstance(first, _WHOLE + _TIMES) or not all(isinstance(rows.schema[f"_p{i}"].dataType, _FIXED) for i in range(len(payload))):
        return top1(df, keys, order, payload, descending)
    value = F.unix_micros(F.col("_o0").cast("timestamp")) if isinstance(first, _TIMES) else F.col("_o0")
    value = (value if descending else -value).cast("decimal(19,0)")  # NULL comes last when descending, else first
    code = F.coalesce(value, _big(-_NO_VALUE if descending else _NO_VALUE).cast("decimal(19,0)")) * _big(_STEP)
    mark = F.shiftrightunsigned(F.xxhash64(*[c for c in rows.columns if c not in keys]), 2).cast("decimal(19,0)")
    coded = rows.select("*", (code + mark).cast("decimal(38,0)").alias("_code"), (code + (_big(_HASH_SPAN) - mark)).cast("decimal(38,0)").alias("_back"))
    # one row alone at the top: both codes are its own, and their hashes add up to the span
    several = F.pmod(F.max("_code") + F.max("_back"), _big(_STEP)) != _big(_HASH_SPAN)
    seen = Observation()
    best = materialized(coded.groupBy(*keys).agg(several.alias("_several"), *[F.max_by(f"_p{i}", "_code").alias(p) for i, p in enumerate(payload)])
                        .observe(seen, F.count_if("_several").alias("several")))
    if not seen.get["several"]:
        return best.drop("_several")
    again = rows.join(best.where("_several").select(*keys), keys, "left_semi")
    settled = top1(again.withColumnsRenamed({f"_p{i}": p for i, p in enumerate(payload)}), keys,
                   [F.col(f"_o{i}") for i in range(len(order))], payload, descending)
    return materialized(best.where("not _several").drop("_several").unionByName(settled))


def top1_by_id(df: DataFrame, keys: list[str], order: Column, id_col: str, payload: list[str]) -> DataFrame:
    """First row per ``keys`` by a small whole number ``order`` and the lowest ``id_col``, a unique whole number."""
    half = 1 << 63  # ids may be negative
    code = order.cast("decimal(19,0)") * _big(_STEP) + F.col(id_col).cast("decimal(19,0)") + _big(half)
    best = df.groupBy(*keys).agg(F.min(code.cast("decimal(38,0)")).alias("_code"))
    best = best.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.pmod("_code", _big(_STEP)) - _big(half)).cast("bigint").alias("_id"))
    return df.join(best, F.col(id_col) == F.col("_id"), "left_semi").select(*keys, *payload)


def latest_option(options: DataFrame, payload: list[str]) -> DataFrame:
    """Per quote, the active option most recently touched: ISNULL(updated_dt, created_dt) DESC.

    Ties (same timestamp) go to the higher premium (NULL last), then the higher product id, then
    the payload values - the same order the DuckDB oracle uses.
    """
    prem_t = options.schema["sub_total_premium"].dataType
    src = options.where(active_lenient("flg_active"))
    order = [F.coalesce("updated_dt", "created_dt"), M.parse_money("sub_total_premium", prem_t), F.col("product_id")]
    return top1_hashed(src, ["quote_id"], order, payload, descending=True)


def option_effective_date(options: DataFrame) -> DataFrame:
    """(quote_id, eff_date): TRY_CONVERT(date, effective_dt) of the latest active option."""
    eff_t = options.schema["effective_dt"].dataType
    return latest_option(options.withColumn("eff_date", try_date("effective_dt", eff_t)), ["eff_date"])


def option_dollars(options: DataFrame) -> DataFrame:
    """(quote_id, prem, fees) of the latest active option: parsed premium and
    ISNULL(taxable, 0) + ISNULL(non-taxable, 0) fees, both DECIMAL(18,2) (NULL when a value does
    not fit, like the source's TRY_CONVERT)."""
    s = options.schema
    prem = M.parse_money("sub_total_premium", s["sub_total_premium"].dataType)
    fees = (M.money_or_zero("total_fee_taxable", s["total_fee_taxable"].dataType)
            + M.money_or_zero("total_fee_non_taxable", s["total_fee_non_taxable"].dataType)).try_cast(M.MONEY)
    return latest_option(options.withColumn("prem", prem).withColumn("fees", fees), ["prem", "fees"])


def preferred_quote(quotes: DataFrame, payload: list[str]) -> DataFrame:
    """Per submission, the bound quote with the lowest id, else the lowest-id quote."""
    return top1_by_id(quotes, ["submission_id"], F.col("bind_dt").isNull().cast(T.IntegerType()), "quote_id", payload)
