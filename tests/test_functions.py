from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from uwlens.functions import dates as D
from uwlens.functions import fmt as FMT
from uwlens.functions import labels as L
from uwlens.functions import money as M
from uwlens.functions import text as X


def _weekdays_inclusive(s: date, e: date) -> int:
    return sum(1 for i in range((e - s).days + 1) if (s + timedelta(days=i)).weekday() < 5)


def test_business_days_inclusive_equals_weekday_count(spark):
    base = date(2024, 1, 1)
    pairs = [(base + timedelta(days=i), base + timedelta(days=i + k)) for i in range(7) for k in range(0, 75)]
    df = spark.createDataFrame(pairs, "s date, e date").select("s", "e", D.business_days_inclusive("s", "e").alias("bd"))
    for r in df.collect():
        assert r.bd == _weekdays_inclusive(r.s, r.e), (r.s, r.e)


def test_business_days_exclusive_weekend_starts_go_negative(spark):
    sat, sun, mon = date(2024, 1, 6), date(2024, 1, 7), date(2024, 1, 8)
    rows = [(sat, sat, -2), (sat, sun, -2), (sat, mon, -1), (sun, sun, -1), (mon, mon, 0),
            (mon, date(2024, 1, 9), 1), (date(2024, 1, 5), mon, 1)]
    df = spark.createDataFrame(rows, "s date, e date, want int")
    got = df.select("want", D.business_days_exclusive("s", "e").alias("bd")).collect()
    assert all(r.bd == r.want for r in got), got


def test_business_days_on_timestamps_use_calendar_dates(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 8, 23, 59), datetime(2024, 1, 9, 0, 1))], "s timestamp, e timestamp")
    r = df.select(D.days_between("s", "e").alias("d"), D.business_days_inclusive("s", "e").alias("bi")).first()
    assert (r.d, r.bi) == (1, 2)


def test_null_inputs_give_null(spark):
    df = spark.createDataFrame([(None, date(2024, 1, 8))], "s date, e date")
    r = df.select(D.business_days_exclusive("s", "e").alias("x"), D.business_days_inclusive("e", "s").alias("y")).first()
    assert r.x is None and r.y is None


def test_iso_week_label_keeps_calendar_year(spark):
    df = spark.createDataFrame([(date(2025, 12, 29),), (date(2021, 1, 3),)], "d date")
    y, w = D.week_label("d")
    got = [(r.y, r.w) for r in df.select(y.alias("y"), w.alias("w")).collect()]
    assert got == [(2025, 1), (2021, 53)]


def test_try_date(spark):
    df = spark.createDataFrame([("2001-06-15",), ("06/15/2001",), ("n/a",), (None,), ("",)], "x string")
    got = [r.d for r in df.select(D.try_date("x").alias("d")).collect()]
    assert got == [date(2001, 6, 15), date(2001, 6, 15), None, None, None]


DATE_TEXTS = {
    "2026-01-05": (2026, 1, 5), "2026/1/5": (2026, 1, 5), "2026.01.05": (2026, 1, 5), "20260105": (2026, 1, 5), "260105": (2026, 1, 5),
    "1/5/2026": (2026, 1, 5), "01-05-2026": (2026, 1, 5), "1.5.26": (2026, 1, 5), "12/31/50": (1950, 12, 31), "12/31/49": (2049, 12, 31),
    "Jan 5 2026": (2026, 1, 5), "JANUARY 5, 2026": (2026, 1, 5), "jan 5,26": (2026, 1, 5), "5 Jan 2026": (2026, 1, 5),
    "5-Jan-26": (2026, 1, 5), "05 january, 2026": (2026, 1, 5), "2026 Jan 5": (2026, 1, 5), "2026 5 Jan": (2026, 1, 5),
    "Jan 2026": (2026, 1, 1), "January, 2026": (2026, 1, 1), "2026 May": (2026, 5, 1), "2026": (2026, 1, 1), "  2026-01-05  ": (2026, 1, 5),
    "2026-01-05 23:59:59.999": (2026, 1, 5), "2026-01-05T10:11:12Z": (2026, 1, 5), "2026-01-05T10:11:12.1234567+05:30": (2026, 1, 5),
    "1/5/2026 3:04 PM": (2026, 1, 5), "Jan  5 2026  3:04PM": (2026, 1, 5), "20260105 10:11": (2026, 1, 5), "1/5/2026 3 pm": (2026, 1, 5),
    "2024-02-29": (2024, 2, 29), "5 sept 2026": None, "2026-02-30": None, "2023-02-29": None, "13/1/2026": None, "2026-13-01": None,
    "2026-01-05 25:00": None, "2026-01-05 10:61": None, "Foo 5 2026": None, "2026-01": None, "1/5": None, "n/a": None, "": None, "   ": None,
    "tomorrow": None, "2026-01-05 x": None, "0000-01-05": None, "12345": None,
}


def test_every_date_form_of_the_source(spark):
    df = spark.createDataFrame([(x,) for x in DATE_TEXTS] + [(None,)], "x string")
    got = {r.x: r.d for r in df.select("x", D.try_date("x").alias("d")).collect()}
    assert got.pop(None) is None
    assert got == {x: want and date(*want) for x, want in DATE_TEXTS.items()}


def test_a_date_text_is_matched_against_one_pattern(spark, capsys):
    df = spark.createDataFrame([("2026-01-05\n",), ("2026-01-05\n\n",), ("#2026#1#5",), ("2026#1#5",)], "x string").select(D.try_date("x").alias("d"))
    assert [r.d for r in df.collect()] == [date(2026, 1, 5), None, None, None]
    capsys.readouterr()
    df.explain("extended")
    plan = capsys.readouterr().out.partition("Optimized Logical Plan")[2].partition("Physical Plan")[0].lower()
    assert plan.count("regexp_replace") <= 2 and "regexp_extract" not in plan and "rlike" not in plan


def test_agency_ids_from_text(spark):
    from uwlens.plans.reports import agency_id_from_text
    texts = {"12": 12, " 12 ": 12, "-7": -7, "+7": 7, "": None, " ": None, "n/a": None, "2001-06-15": None, "12.5": None, "1e3": None,
             "99999999999": None, "12\n": 12, "1 2": None, "x1": None}
    got = {r.x: r.n for r in spark.createDataFrame([(x,) for x in texts], "x string").select("x", agency_id_from_text("x").alias("n")).collect()}
    assert got == texts


@pytest.mark.parametrize("text,want", [
    ("$1,234.50", Decimal("1234.50")), ("1234.5", Decimal("1234.50")), (" 12.345 ", Decimal("12.35")),
    ("1e3", None), ("abc", None), ("", None), (None, None), ("-5", Decimal("-5.00")), (".5", Decimal("0.50")),
])
def test_parse_money_text(spark, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(M.parse_money("x").alias("m")).first().m == want


def test_ratio4_rounds_half_up_and_guards_zero(spark):
    df = spark.createDataFrame([(1, 32), (3, 160), (2, 3), (5, 0)], "a long, b long")
    got = [r.r for r in df.select(M.ratio4("a", "b").alias("r")).collect()]
    assert got == [Decimal("0.0313"), Decimal("0.0188"), Decimal("0.6667"), None]


def test_person_names(spark):
    rows = [(" Ann ", None, " Lee "), (" Ann ", "", " "), (" Ann ", "M", None), (None, None, "Lee")]
    df = spark.createDataFrame(rows, "f string, m string, l string")
    got = df.select(X.person_name_short("f", "l").alias("s"), X.person_name_full3("f", "m", "l").alias("f3"),
                    X.person_name_full3_trimlast("f", "m", "l").alias("f3t")).collect()
    assert [tuple(r) for r in got] == [
        ("Ann Lee", "Ann  Lee", "Ann  Lee"), ("Ann", "Ann  ", "Ann "), (None, "Ann M ", "Ann M"), (None, "  Lee", "  Lee")]


def test_policy_status_and_bands(spark):
    rows = [(None, None, None), (date(2024, 1, 1), None, -1), (date(2024, 1, 1), date(2024, 1, 2), 3), (None, None, 4)]
    df = spark.createDataFrame(rows, "b date, f date, lag int")
    got = df.select(L.policy_status("b", "f").alias("st"), L.sla_band_max("lag", 3).alias("mx"),
                    L.sla_band_calendar("lag", 3).alias("cal"), L.sla_band_min("lag", 4).alias("mn")).collect()
    assert [tuple(r) for r in got] == [
        ("Not Bound", None, "Red", None), ("Bound – Not Finalized", "Data Issue", "Data Issue", "Data Issue"),
        ("Policy Finalized", "Green", "Green", "Red"), ("Not Bound", "Red", "Red", "Green")]


def test_document_classes(spark):
    names = [" Quote to Agent ", "Re: quote to ag v2", "Signed RTB form", " Binder to Agt", "Binder to Agt",
             "Endt to Agent", "Policy to Agent", "DBI Renewal Invoice 3"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(L.doc_is_quote_to_agent("n").alias("q"), L.doc_is_quote_to_agent_prefix("n").alias("qp"),
                    L.doc_is_bind_request("n").alias("br"), L.doc_is_binder_sent("n").alias("bs"),
                    L.doc_is_endorsement_sent("n").alias("en"), L.doc_is_policy_sent("n").alias("po"),
                    L.doc_is_renewal_invoice("n").alias("ri")).collect()
    assert [tuple(r) for r in got] == [
        (True, True, False, False, False, False, False),
        (True, False, False, False, False, False, False),
        (False, False, True, False, False, False, False),
        (False, False, False, False, False, False, False),  # leading blank defeats the untrimmed prefix test
        (False, False, False, True, False, False, False),
        (False, False, False, False, True, False, False),
        (False, False, False, False, False, True, False),
        (False, False, False, False, False, False, True)]


def test_type_tests_three_valued(spark):
    df = spark.createDataFrame([(None,), ("Renewal",), ("Cancel Pro Rata",), ("Notice of Cancellation 10 Day",),
                                ("Endorsement",), ("Audit",)], "d string")
    got = df.select(L.tt_heatmap("d").alias("h"), L.tt_forecast("d").alias("f")).collect()
    assert [tuple(r) for r in got] == [(None, True), (True, True), (True, False), (False, True), (True, False),
                                       (False, True)]


def test_formats(spark):
    df = spark.createDataFrame([(date(2001, 6, 5), "2001-06-05 extra", Decimal("0.00"))], "d date, t string, m decimal(18,2)")
    from pyspark.sql import types as T
    r = df.select(FMT.us_date("d").alias("u"), FMT.us_date("t", T.StringType()).alias("ut"),
                  M.money_text("m").alias("mt"), X.fixed_width("t", 4).alias("w")).first()
    assert tuple(r) == ("06-05-2001", "2001-06-05", "0.00", "2001")


def test_coalesce_in_window_equals_window_on_coalesce(spark):
    rows = [(None, None), (date(2024, 1, 1), None), (None, date(2024, 1, 5)), (date(2023, 12, 1), date(2024, 1, 5)),
            (date(2024, 1, 9), date(2023, 1, 1)), (None, date(2024, 1, 10))]
    df = spark.createDataFrame(rows, "a date, b date")
    s, e = date(2024, 1, 1), date(2024, 1, 10)
    from pyspark.sql import functions as F
    got = [(r.x, r.y) for r in df.select(D.coalesce_in_window("a", "b", s, e).alias("x"),
                                         F.coalesce(D.in_window(F.coalesce("a", "b"), s, e), F.lit(False)).alias("y")).collect()]
    assert all(bool(x) == bool(y) for x, y in got), got
