"""Collected order of sorted reports (the differential runs sort their rows first)."""

import datetime as dt
import re

import pytest

SF = "/root/testdata/sf0.01"


def _us(text):
    return None if text is None else dt.datetime.strptime(text, "%m-%d-%Y").date()


def _number(code):
    rest = code.replace("AGT", "")
    return int(rest) if re.fullmatch(r"[0-9]+", rest) else None


#: report -> visible sort keys of a row, ascending, NULL first
KEYS = {
    "rpt_agency_retention": lambda r: (_number(r.agency_code), r.agency_code, r.cohort_year),
    "rpt_quotes_due": lambda r: (_us(r.proposed_eff_date), r.submission_number, r.quote_number),
    "rpt_quote_followup": lambda r: (_us(r.quote_sent_date),),
    "rpt_submission_lookup": lambda r: (r.submission_number, r.agency_name, r.insured_name),
}


@pytest.mark.parametrize("name", sorted(KEYS))
def test_rows_come_sorted(spark, name):
    import __spark_entry__ as E
    rows = E.queries()[name](spark, SF).collect()
    keys = [tuple((k is not None, k) for k in KEYS[name](r)) for r in rows]
    assert len(keys) > 10 and len(set(keys)) > 5
    assert all(a <= b for a, b in zip(keys, keys[1:]))
