"""Scorecard problem rules, clamps and guards on hand-built agency rows (branches the fixture data
cannot reach: rule 1, the decline clamp below zero, a -10 day average)."""

from decimal import Decimal

from pyspark.sql import functions as F

from uwlens.plans import scorecard as SC

COLS = ["submissions_created", "submissions_activity", "submissions_quoted", "quotes_started",
        "quotes_started_bound", "declines", "binds", "binds_from_cohort", "sum_days_to_bind", "cnt_days_to_bind",
        "bound_premium", "bound_fees"]


def _frame(spark, rows):
    schema = ", ".join(f"{c} {'decimal(38,2)' if c in ('sum_days_to_bind', 'bound_premium', 'bound_fees') else 'long'}"
                       for c in COLS)
    return spark.createDataFrame([tuple(Decimal(v) if isinstance(v, float) else v for v in r) for r in rows], schema)


def _rule(r):
    cr, ac, qu, st, sb, de, bi, bc = r[:8]
    if cr == 0 and ac == 0:
        return 1
    if cr > 0 and qu == 0 and st == 0 and bi == 0:
        return 2
    if cr >= 10 and qu / cr < 0.30:
        return 3
    if ac >= 10 and qu / ac < 0.40:
        return 4
    if st >= 5 and sb / st < 0.20:
        return 5
    if qu >= 5 and de / qu >= 0.50:
        return 6
    if bi >= 5 and (bi - bc) / bi >= 0.70:
        return 7
    return 8


ROWS = [
    (0, 0, 0, 0, 0, 0, 0, 0, 0.0, 0, 0.0, 0.0),            # 1 no activity
    (3, 3, 0, 0, 0, 0, 0, 0, 0.0, 0, 0.0, 0.0),            # 2 intake not worked
    (10, 12, 2, 4, 1, 0, 1, 1, 5.0, 1, 100.0, 1.0),        # 3 low quoted / created
    (2, 10, 3, 4, 2, 0, 1, 1, 5.0, 1, 100.0, 1.0),         # 4 low quoted / activity
    (4, 6, 5, 10, 1, 0, 1, 1, 5.0, 1, 100.0, 1.0),         # 5 low bind rate
    (4, 6, 5, 5, 2, 30, 2, 2, 5.0, 2, 100.0, 1.0),         # 6 declines; clamp of (1 - 30/15) below 0
    (4, 6, 5, 5, 2, 0, 10, 2, 50.0, 10, 1000.0, 10.0),     # 7 carryover
    (4, 6, 5, 5, 2, 0, 2, 2, 10.0, 2, 500.0, 5.0),         # 8 healthy
    (4, 6, 5, 5, 2, 0, 2, 2, -20.0, 2, 500.0, 5.0),        # 8 with average days -10: speed undefined
    (3, 30, 3, 3, 3, 0, 9, 9, 9.0, 9, 900.0, 9.0),         # binds >= created: throughput capped at 1
]


def test_problem_rules_match_brute_force(spark):
    df = _frame(spark, ROWS).withColumn("rule", SC.problem_rule())
    assert [r.rule for r in df.collect()] == [_rule(r) for r in ROWS]


def test_scores_guards_and_clamps(spark):
    out = SC.scores(_frame(spark, ROWS)).collect()
    assert out[0].mvs_overall is None and out[0].ops_efficiency_score is None   # created = activity = 0
    assert out[1].ops_efficiency_score is None and out[1].pipeline_health_score is None  # no quotes started
    assert out[5].mvs_overall == Decimal("0.00") and out[5].pipeline_health_score == Decimal("0.00")  # clamp to 0
    assert out[8].ops_efficiency_score is None and out[8].mvs_overall is not None     # 1/(1 + -10/10)
    # capped throughput: 909 * 1 * 1 * 3/18 / 1000 = 0.1515 -> 0.15
    assert out[9].mvs_overall == Decimal("0.15")
    # pipeline health row 8: 100 * 2/5 * 1 * 4/19 = 8.421... -> 8.42
    assert out[7].pipeline_health_score == Decimal("8.42")


def test_problem_texts_are_cut_to_column_width(spark):
    df = _frame(spark, ROWS[6:7]).withColumn("rule", SC.problem_rule())
    action = df.select(SC._text_of(F.col("rule"), 3, 160).alias("a")).first().a
    assert len(action) == 160 and action.endswith("cliff")
