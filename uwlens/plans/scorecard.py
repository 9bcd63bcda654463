"""Rolling three-month agency scorecard: funnel counts, production dollars, ratios, four scores
and a problem type with explanation and recommended action, per rolled-up agency.

Plan shape (each step one function, so every intermediate result is testable on its own):

  quote facts    one row per live quote that was started, bound or declined in the window, with its
                 conditions as columns; quotes and closures are read once
  universe       submissions with any activity in the window (created, quote started or bound),
                 flagged "created in window" and "had a quote started in window"
  dollars        latest-option premium and fees of the facts' quotes only, not of the whole option table
  measures       the universe's submissions and its priced facts as one tagged stack of rows, reduced per
                 (agency, tag, id) and then per agency: 13 conditional distinct counts and 10 sums from one
                 pair of aggregates - no row-multiplying Expand and no join of partial results
  metrics        active agencies with their measures
  final          roll-up of member agencies to reporting codes, re-aggregated
  scored         ratios, scores and the problem type (first matching rule wins)

Facts, universe, dollars and priced facts are materialised with their true sizes, each because the next
step and a later one read it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as D
from ..functions import fixed_values as V
from ..functions import money as M
from ..functions import text as X
from ..operators import filters as FL
from ..operators.distinct import distinct_flags
from ..operators.latest import option_dollars
from ..operators.lineage import materialized
from ..params import ReportParams
from ..sources.catalog import Tables
from .common import agencies, live_quotes, live_submissions, types_where

QUOTE_START_MEASURES = [
    "submissions_quoted", "quotes_started", "raw_quote_rows_started", "quotes_started_bound",
    "nb_quotes_started", "nb_quotes_bound", "renewal_quotes_started", "renewal_quotes_bound",
]
PRODUCTION_MEASURES = [
    "binds", "binds_from_cohort", "sum_days_to_bind", "cnt_days_to_bind", "bound_premium", "bound_fees",
    "bound_premium_from_cohort", "bound_fees_from_cohort", "nb_binds", "renewal_binds",
    "nb_bound_premium", "renewal_bound_premium",
]
DECLINE_MEASURES = ["declines", "declined_premium"]
ALL_MEASURES = (["submissions_created", "submissions_activity"] + QUOTE_START_MEASURES + DECLINE_MEASURES
                + PRODUCTION_MEASURES)


def _producer_submissions(t: Tables) -> DataFrame:
    return (live_submissions(t).where(F.col("original_producer_id").isNotNull())
            .select("submission_id", F.col("original_producer_id").alias("agency_id"), "created_dt"))


def _decline_closures(t: Tables, p: ReportParams) -> DataFrame:
    w = p.rolling3
    return (t.bms_quote_closed.where(FL.active_lenient("flg_active") & FL.flag_set("flg_decline")
                                     & D.in_window("created_dt", w.start, w.end))
            .groupBy("quote_id").agg(F.count(F.lit(1)).alias("n_closures")))


def quote_facts(t: Tables, p: ReportParams) -> DataFrame:
    """Live quotes that count in some measure: ``started`` or ``bound_in`` the window or with decline
    closures in it (``n_closures``).  A quote that is none of these adds nothing to any measure."""
    w = p.rolling3
    q = live_quotes(t).select("quote_id", "submission_id", F.coalesce("quote_dt", "created_dt").alias("start_dt"), "bind_dt",
                              "lkp_transaction_type_id")
    tt = types_where(t).select("lkp_id", "lkp_desc")
    q = q.join(_decline_closures(t, p), "quote_id", "left")
    started = F.coalesce(D.in_window("start_dt", w.start, w.end), F.lit(False))
    bound_in = F.coalesce(D.in_window("bind_dt", w.start, w.end), F.lit(False))
    q = q.where(started | bound_in | F.col("n_closures").isNotNull())
    q = q.join(tt, q.lkp_transaction_type_id == tt.lkp_id, "left")
    desc = F.coalesce("lkp_desc", F.lit(""))
    return q.select("quote_id", "submission_id", "start_dt", "bind_dt", started.alias("started"), bound_in.alias("bound_in"),
                    (desc == V.TT_NEW_BUSINESS).alias("nb"), desc.isin(*V.TT_RENEWALS).alias("rn"),
                    F.coalesce("n_closures", F.lit(0)).alias("n_closures"))


def submission_universe(t: Tables, p: ReportParams, facts: DataFrame | None = None) -> DataFrame:
    """(submission_id, agency_id, created_in, quoted_in) of live producer submissions created,
    quote-started or bound in the window.

    The OR across the submission and its quotes: the facts started or bound in the window, one row per
    submission (with "some quote started in the window"), are attached to the submissions in one pass.
    ``quoted_in`` is exactly the condition of the "submissions quoted" count."""
    w = p.rolling3
    facts = quote_facts(t, p) if facts is None else facts
    touched = facts.where("started or bound_in").groupBy("submission_id").agg(F.max("started").alias("_q"))
    created_in = F.coalesce(D.in_window("created_dt", w.start, w.end), F.lit(False))
    u = _producer_submissions(t).join(touched, "submission_id", "left").where(created_in | F.col("_q").isNotNull())
    return u.select("submission_id", "agency_id", created_in.alias("created_in"), F.coalesce("_q", F.lit(False)).alias("quoted_in"))


def needed_option_dollars(t: Tables, facts: DataFrame) -> DataFrame:
    """Latest-option premium and fees of the quotes the scorecard prices: bound in the window or declined in it."""
    priced = facts.where(F.col("bound_in") | (F.col("n_closures") > 0)).select("quote_id")
    return option_dollars(t.bms_options_mst.join(priced, "quote_id", "left_semi"))


def submissions_created(t: Tables, p: ReportParams) -> DataFrame:
    w = p.rolling3
    sb = _producer_submissions(t).where(D.in_window("created_dt", w.start, w.end))
    return sb.groupBy("agency_id").agg(F.count_distinct("submission_id").alias("submissions_created"))


def submission_counts(universe: DataFrame) -> DataFrame:
    """Submissions created, with activity, and with a quote started in the window, per agency."""
    return distinct_flags(universe, ["agency_id"], "submission_id", {
        "submissions_created": F.col("created_in"), "submissions_activity": F.lit(True),
        "submissions_quoted": F.col("quoted_in")})


def stacked(universe: DataFrame, priced: DataFrame) -> DataFrame:
    """Submissions and priced facts as one stack of rows: agency, tagged id and the columns the measures need."""
    no, nothing = F.lit(False), F.lit(0).cast(M.MONEY)
    tag = lambda n, c: F.struct(F.lit(n).alias("tag"), F.col(c).cast("bigint").alias("id")).alias("_id")
    subs = universe.select("agency_id", tag(0, "submission_id"), F.lit(True).alias("sub"), "created_in", "quoted_in",
                           no.alias("s"), no.alias("b"), no.alias("bound"), no.alias("nb"), no.alias("rn"),
                           F.lit(0).cast(T.LongType()).alias("n_closures"), F.lit(None).cast(T.IntegerType()).alias("days"),
                           nothing.alias("prem"), nothing.alias("fees"))
    quotes = priced.select("agency_id", tag(1, "quote_id"), no.alias("sub"), no.alias("created_in"), no.alias("quoted_in"),
                           F.col("started").alias("s"), F.col("bound_in").alias("b"), F.col("bind_dt").isNotNull().alias("bound"),
                           "nb", "rn", "n_closures", D.days_between("start_dt", "bind_dt").cast(T.IntegerType()).alias("days"),
                           F.coalesce("prem", nothing).alias("prem"), F.coalesce("fees", nothing).alias("fees"))
    return subs.unionByName(quotes)


def measures(universe: DataFrame, priced: DataFrame) -> DataFrame:
    """All measures per agency of the universe.

    A quote with several decline closures counts once but its premium once per closure, as the source
    defines it; agencies without facts have zeros, since their submissions are in the stack."""
    s, b, bound, nb, rn = (F.col(c) for c in ("s", "b", "bound", "nb", "rn"))
    prem, fees, zero = F.col("prem"), F.col("fees"), F.lit(0).cast(M.MONEY)
    dated = b & F.col("days").isNotNull()
    flags = {
        "submissions_created": F.col("created_in"), "submissions_activity": F.col("sub"), "submissions_quoted": F.col("quoted_in"),
        "quotes_started": s, "quotes_started_bound": s & bound,
        "nb_quotes_started": s & nb, "nb_quotes_bound": s & nb & bound,
        "renewal_quotes_started": s & rn, "renewal_quotes_bound": s & rn & bound,
        "binds": b, "binds_from_cohort": b & s, "nb_binds": b & nb, "renewal_binds": b & rn,
        "declines": F.col("n_closures") > 0,
    }
    sums = {
        "raw_quote_rows_started": F.when(s, 1).otherwise(0).cast(T.LongType()),
        "sum_days_to_bind": F.when(dated, F.col("days").cast(M.MONEY)).otherwise(zero),
        "cnt_days_to_bind": F.when(dated, 1).otherwise(0).cast(T.LongType()),
        "bound_premium": F.when(b, prem).otherwise(zero), "bound_fees": F.when(b, fees).otherwise(zero),
        "bound_premium_from_cohort": F.when(b & s, prem).otherwise(zero),
        "bound_fees_from_cohort": F.when(b & s, fees).otherwise(zero),
        "nb_bound_premium": F.when(b & nb, prem).otherwise(zero),
        "renewal_bound_premium": F.when(b & rn, prem).otherwise(zero),
        "declined_premium": (prem * F.col("n_closures")).cast(T.DecimalType(38, 2)),
    }
    return distinct_flags(stacked(universe, priced), ["agency_id"], "_id", flags, sums)


def agency_measures(t: Tables, p: ReportParams) -> DataFrame:
    """``measures`` of the window."""
    facts = materialized(quote_facts(t, p))
    u = materialized(submission_universe(t, p, facts))
    dollars = needed_option_dollars(t, facts)
    priced = materialized(facts.join(u.select("submission_id", "agency_id"), "submission_id").join(dollars, "quote_id", "left"))
    return measures(u, priced)


def agency_metrics(t: Tables, p: ReportParams) -> DataFrame:
    """All measures per active agency of the spine (universe agencies and created agencies).

    Submissions created in the window are a subset of the universe (same submission filters), so the spine
    is simply the universe's agencies."""
    ag = agencies(t, FL.active_lenient("flg_active")).select("agency_id", "agency_code", "agency_name")
    return agency_measures(t, p).join(ag, "agency_id").select("agency_id", "agency_code", "agency_name", *ALL_MEASURES)


def rollup_map(spark: SparkSession) -> DataFrame:
    """Fixed member-code -> reporting (code, name) map as a broadcastable 7-row table."""
    schema = "member_code string, rollup_code string, rollup_name string"
    return F.broadcast(spark.createDataFrame(list(V.AGENCY_ROLLUP), schema))


def rolled_up(metrics: DataFrame) -> DataFrame:
    m = rollup_map(metrics.sparkSession)
    df = metrics.join(m, metrics.agency_code == m.member_code, "left")
    return df.select(F.coalesce("rollup_code", "agency_code").alias("agency_code"),
                     F.coalesce("rollup_name", "agency_name").alias("agency_name"), *ALL_MEASURES)


def final_agg(metrics: DataFrame) -> DataFrame:
    return rolled_up(metrics).groupBy("agency_code", "agency_name").agg(*[F.sum(m).alias(m) for m in ALL_MEASURES])


# ---------------------------------------------------------------- ratios, scores, problem type

def _n(x: str) -> Column:
    """Exact decimal literal (a Python float literal would turn the arithmetic into DOUBLE)."""
    return F.lit(Decimal(x))


def _d6(c: Column) -> Column:
    return c.cast(M.FINE)


def _decline_factor() -> Column:
    x = _n("1.0") - _d6(F.col("declines")) / F.nullif(_d6(F.col("submissions_quoted")) + _n(f"{V.DECLINE_SMOOTHING}.0"), F.lit(0))
    return F.when(x < _n("0.0"), _n("0.0")).otherwise(x)


def _throughput_capped() -> Column:
    return F.when(F.col("binds") >= F.col("submissions_created"), _n("1.0")).otherwise(
        _d6(F.col("binds")) / F.nullif(_d6(F.col("submissions_created")), F.lit(0)))


def _volume_ramp() -> Column:
    c = _d6(F.col("submissions_created"))
    return c / F.nullif(c + _n(f"{V.VOLUME_RAMP}.0"), F.lit(0))


def _cohort_share() -> Column:
    r = _d6(F.col("binds_from_cohort")) / F.nullif(_d6(F.col("binds")), F.lit(0))
    return F.when(F.col("binds") == 0, _n("0.0")).otherwise(F.when(r > _n("1.0"), _n("1.0")).otherwise(r))


def _speed() -> Column:
    avg = _d6(F.col("sum_days_to_bind")) / F.nullif(_d6(F.col("cnt_days_to_bind")), F.lit(0))
    # an average of -10 days would divide by zero; the score is then unknown (NULL)
    return F.when(F.col("cnt_days_to_bind") == 0, _n("0.0")).otherwise(
        F.try_divide(_n("1.0"), _n("1.0") + avg / _n(f"{V.SPEED_SCALE_DAYS}.0")))


def _volume_factor() -> Column:
    a = F.col("submissions_activity")
    return F.when(a >= V.CREDIBILITY_FULL, _n("1.0")).when(a <= 0, _n("0.0")).otherwise(_d6(a) / _n(f"{V.CREDIBILITY_FULL}.0"))


def scores(df: DataFrame) -> DataFrame:
    money2 = M.MONEY
    dollars = F.col("bound_premium") + F.col("bound_fees")
    created0 = F.col("submissions_created") == 0
    mvs = F.when(created0, None).otherwise(
        dollars * _throughput_capped() * _decline_factor() * _volume_ramp() / _n(f"{V.MVS_DIVISOR}.0"))
    momentum = F.when(created0, None).otherwise(
        dollars * _throughput_capped() * _cohort_share() * _decline_factor() * _volume_ramp() / _n(f"{V.MVS_DIVISOR}.0"))
    ops = (F.when(F.col("submissions_activity") == 0, None).when(F.col("quotes_started") == 0, None).otherwise(
        _n("100.0")
        * (_d6(F.col("submissions_quoted")) / F.nullif(_d6(F.col("submissions_activity")), F.lit(0)))
        * (_d6(F.col("quotes_started_bound")) / F.nullif(_d6(F.col("quotes_started")), F.lit(0)))
        * _decline_factor() * _speed() * _volume_factor()))
    pipeline = (F.when(created0, None).when(F.col("quotes_started") == 0, None).otherwise(
        _n("100.0")
        * (_d6(F.col("quotes_started_bound")) / F.nullif(_d6(F.col("quotes_started")), F.lit(0)))
        * _decline_factor() * _volume_ramp()))
    return (df.withColumn("mvs_overall", mvs.cast(money2)).withColumn("mvs_momentum", momentum.cast(money2))
            .withColumn("ops_efficiency_score", ops.cast(money2)).withColumn("pipeline_health_score", pipeline.cast(money2)))


def _ratio_below(num: str, den: str, threshold: str) -> Column:
    return (_d6(F.col(num)) / F.nullif(_d6(F.col(den)), F.lit(0))) < F.lit(threshold).cast(T.DecimalType(3, 2))


def _ratio_at_least(num: Column, den: str, threshold: str) -> Column:
    return (_d6(num) / F.nullif(_d6(F.col(den)), F.lit(0))) >= F.lit(threshold).cast(T.DecimalType(3, 2))


def problem_rule() -> Column:
    """Index (1-8) of the first matching problem rule."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    vol, thr = V.RULE_MIN_VOLUME, V.RULE_RATIO
    return (
        F.when((z("submissions_created") == 0) & (z("submissions_activity") == 0), 1)
        .when((z("submissions_created") > 0) & (z("submissions_quoted") == 0) & (z("quotes_started") == 0)
              & (z("binds") == 0), 2)
        .when((z("submissions_created") >= vol[3]) & _ratio_below("submissions_quoted", "submissions_created", thr[3]), 3)
        .when((z("submissions_activity") >= vol[4]) & _ratio_below("submissions_quoted", "submissions_activity", thr[4]), 4)
        .when((z("quotes_started") >= vol[5]) & _ratio_below("quotes_started_bound", "quotes_started", thr[5]), 5)
        .when((z("submissions_quoted") >= vol[6]) & _ratio_at_least(F.col("declines"), "submissions_quoted", thr[6]), 6)
        .when((z("binds") >= vol[7]) & _ratio_at_least(F.col("binds") - F.col("binds_from_cohort"), "binds", thr[7]), 7)
        .otherwise(8)
    )


def _text_of(rule: Column, field: int, width: int) -> Column:
    texts = F.array(*[F.lit(r[field]) for r in V.PROBLEM_TYPES])
    return F.substring(F.element_at(texts, rule), 1, width)


def agency_scorecard(t: Tables, p: ReportParams) -> DataFrame:
    f = scores(final_agg(agency_metrics(t, p))).withColumn("_rule", problem_rule())
    r4 = M.ratio4
    carry = F.col("binds") - F.col("binds_from_cohort")
    hit_den = F.col("bound_premium") + F.col("declined_premium")
    hit = F.when(hit_den == 0, None).otherwise(
        _d6(F.col("bound_premium")) / F.nullif(_d6(hit_den), F.lit(0))).cast(M.RATIO)
    avg_prem = F.when(F.col("binds") == 0, None).otherwise(
        F.col("bound_premium") / F.nullif(F.col("binds").cast(M.MONEY), F.lit(0).cast(M.MONEY))).cast(M.MONEY)
    lw, ew, aw = V.PROBLEM_TEXT_WIDTHS
    out = f.orderBy(F.col("mvs_overall").desc(), F.col("bound_premium").desc(), F.col("submissions_created").desc(),
                    F.col("agency_name").asc(), F.col("agency_code").asc())
    return out.select(
        X.fixed_width("agency_code", 50).alias("agency_code"), X.fixed_width("agency_name", 150).alias("agency_name"),
        F.col("submissions_created").alias("submissions_created_r3m"),
        F.col("submissions_activity").alias("submissions_activity_r3m"),
        F.col("submissions_quoted").alias("submissions_quoted_r3m"),
        F.col("quotes_started").alias("quotes_started_r3m"),
        F.col("raw_quote_rows_started").alias("raw_quote_rows_started_r3m"),
        F.col("quotes_started_bound").alias("quotes_started_bound_to_date"),
        r4("submissions_quoted", "submissions_created").alias("sub_to_quote_pct_vs_intake"),
        r4("submissions_quoted", "submissions_activity").alias("sub_to_quote_pct_vs_activity"),
        r4("quotes_started_bound", "quotes_started").alias("quote_to_bind_pct"),
        F.col("nb_quotes_started").alias("nb_quotes_started_r3m"),
        F.col("nb_quotes_bound").alias("nb_quotes_bound_to_date"),
        r4("nb_quotes_bound", "nb_quotes_started").alias("nb_quote_to_bind_pct"),
        F.col("renewal_quotes_started").alias("renewal_quotes_started_r3m"),
        F.col("renewal_quotes_bound").alias("renewal_quotes_bound_to_date"),
        r4("renewal_quotes_bound", "renewal_quotes_started").alias("renewal_quote_to_bind_pct"),
        F.col("declines").alias("declines_created_r3m"),
        r4("declines", "submissions_quoted").alias("decline_rate_pct"),
        F.col("binds").alias("binds_r3m"), F.col("binds_from_cohort").alias("binds_r3m_from_cohort"),
        carry.alias("binds_r3m_carryover"), r4(carry, F.col("binds")).alias("carryover_pct"),
        r4("binds", "submissions_created").alias("binds_per_intake_pct"),
        r4("binds", "submissions_activity").alias("binds_per_activity_pct"),
        F.col("bound_premium").cast(M.MONEY).alias("bound_premium_r3m"),
        F.col("bound_fees").cast(M.MONEY).alias("bound_fees_r3m"),
        F.col("declined_premium").cast(M.MONEY).alias("declined_premium_r3m"),
        hit.alias("dollar_hit_ratio_pct"),
        F.col("nb_binds").alias("nb_binds_r3m"), F.col("renewal_binds").alias("renewal_binds_r3m"),
        F.col("nb_bound_premium").cast(M.MONEY).alias("nb_bound_premium_r3m"),
        F.col("renewal_bound_premium").cast(M.MONEY).alias("renewal_bound_premium_r3m"),
        avg_prem.alias("avg_bound_premium_per_bind"),
        F.col("bound_premium_from_cohort").cast(M.MONEY).alias("bound_premium_r3m_from_cohort"),
        (F.col("bound_premium") - F.col("bound_premium_from_cohort")).cast(M.MONEY).alias("bound_premium_r3m_carryover"),
        F.col("bound_fees_from_cohort").cast(M.MONEY).alias("bound_fees_r3m_from_cohort"),
        (F.col("bound_fees") - F.col("bound_fees_from_cohort")).cast(M.MONEY).alias("bound_fees_r3m_carryover"),
        "mvs_overall", "mvs_momentum", "ops_efficiency_score", "pipeline_health_score",
        _text_of(F.col("_rule"), 1, lw).alias("problem_type_label"),
        _text_of(F.col("_rule"), 2, ew).alias("problem_type_explanation"),
        _text_of(F.col("_rule"), 3, aw).alias("primary_recommended_action"),
    )
