"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each statement starts from the same fixture mapping as the Spark side (``FIXTURE_SQL``: the
operational tables derived from the raw test tables) and states the report from its definition:
literal windows, key sets instead of correlated blocks, filtered aggregates of one fact row per quote.
The labels, codes and patterns come from ``oracle_values`` and not from the package, so that a changed
value on one side shows.  Exact-arithmetic conventions, so both engines
produce identical values:

* counts are BIGINT, money and ratios are DOUBLE made from an exact decimal or integer result;
* a 4-place ratio a/b is rounded half-up in integers: ((20000*a + b) // (2*b)) / 10000;
* scores are computed in DOUBLE and rounded to 2 places;
* DATEDIFF(WEEK) (Saturday->Sunday crossings) uses floor((days since 1970-01-01 + 4) / 7).
"""

from __future__ import annotations

import oracle_values as V
from uwlens.sources.fixtures import FIXTURE_SQL

AS_OF = "DATE '2001-06-15'"

_PLAIN = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*$'"


def _money(x: str) -> str:
    s = f"replace(replace(CAST({x} AS VARCHAR), ',', ''), '$', '')"
    return f"CASE WHEN regexp_matches({s}, {_PLAIN}) THEN TRY_CAST(trim({s}) AS DECIMAL(18,2)) END"


def _with(tables: list[str], body: str) -> str:
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in tables)
    return f"WITH {ctes},\n{body}"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _wk(d: str) -> str:
    return f"floor(((CAST({d} AS DATE) - DATE '1970-01-01') + 4) / 7.0)"


def _dow(d: str) -> str:  # 0 = Sunday ... 6 = Saturday
    return f"dayofweek(CAST({d} AS DATE))"


def _bd_exclusive(s: str, e: str) -> str:
    return (f"(CAST({e} AS DATE) - CAST({s} AS DATE)) - 2 * ({_wk(e)} - {_wk(s)})"
            f" - CASE WHEN {_dow(s)} IN (0, 6) THEN 1 ELSE 0 END - CASE WHEN {_dow(e)} = 6 THEN 1 ELSE 0 END")


def _bd_inclusive(s: str, e: str) -> str:
    return (f"(CAST({e} AS DATE) - CAST({s} AS DATE)) + 1 - 2 * ({_wk(e)} - {_wk(s)})"
            f" - CASE WHEN {_dow(s)} = 0 THEN 1 ELSE 0 END - CASE WHEN {_dow(e)} = 6 THEN 1 ELSE 0 END")


def _status(b: str = "bind_dt", f: str = "trans_finalize_dt") -> str:
    return (f"CASE WHEN {b} IS NULL THEN {_q(V.POLICY_NOT_BOUND)} WHEN {f} IS NULL THEN {_q(V.POLICY_BOUND_NOT_FINALIZED)}"
            f" ELSE {_q(V.POLICY_FINALIZED)} END")


def _uw_short(first: str = "first_name", last: str = "last_name") -> str:
    return f"trim({first}) || CASE WHEN trim({last}) = '' THEN '' ELSE ' ' || trim({last}) END"


def _try_date(x: str) -> str:
    return f"COALESCE(TRY_CAST({x} AS DATE), CAST(TRY_STRPTIME({x}, '%m/%d/%Y') AS DATE))"


def _ratio4(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN NULL ELSE CAST((20000 * CAST({a} AS HUGEINT) + ({b})) // (2 * CAST({b} AS HUGEINT)) AS DOUBLE) / 10000.0 END"


def _pos(*keys: str) -> str:
    """The row's place in the report's order: ascending keys, NULL first, unless a key says otherwise."""
    return f"row_number() OVER (ORDER BY {', '.join(k if ' NULLS ' in k else k + ' ASC NULLS FIRST' for k in keys)}) AS position"


_WEEKS = (f"win AS (SELECT CAST(date_trunc('week', {AS_OF} - 14) AS DATE) AS s, "
          f"CAST(date_trunc('week', {AS_OF}) AS DATE) AS e)")

_LIVE_ROW = "COALESCE(flg_active, 1) = 1 AND COALESCE(purge_status, 0) = 0"

_LIVE = "COALESCE({a}.flg_active, 1) = 1 AND COALESCE({a}.purge_status, 0) = 0"

_OPX = f"""latest_opt AS (
  SELECT quote_id, {_try_date('effective_dt')} AS eff FROM bms_options_mst WHERE COALESCE(flg_active, 1) = 1
  QUALIFY row_number() OVER (PARTITION BY quote_id ORDER BY COALESCE(updated_dt, created_dt) DESC NULLS LAST,
    {_money('sub_total_premium')} DESC NULLS LAST, product_id DESC NULLS LAST, {_try_date('effective_dt')} DESC NULLS LAST) = 1)"""

_DOCS = f"""docs AS (
  SELECT df.submission_number, dd.created_dt, dd.document_name FROM dms_file_mst df
  JOIN dms_document_detail_mst dd ON dd.file_id = df.file_id
  WHERE {_LIVE.format(a='df')} AND COALESCE(dd.purge_status, 0) = 0)"""

_KPI_TABLES = ["bms_submission_mst", "bms_quote_mst", "adm_co_users", "adm_bm_lkp_transaction_types", "bms_options_mst",
               "dms_file_mst", "dms_document_detail_mst"]

_KPI_SPINE = """spine AS (
  SELECT q.*, sb.submission_code, sb.created_dt AS sb_created, tt.lkp_desc, uw.first_name, uw.last_name
  FROM bms_quote_mst q JOIN bms_submission_mst sb ON sb.submission_id = q.submission_id
  JOIN adm_co_users uw ON uw.user_id = sb.user_id_accexecutive
  LEFT JOIN adm_bm_lkp_transaction_types tt ON tt.lkp_id = q.lkp_transaction_type_id
  WHERE {live_q} AND {live_s} AND tt.lkp_desc IN {types})"""


def _spine(types) -> str:
    return _KPI_SPINE.format(live_q=_LIVE.format(a="q"), live_s=_LIVE.format(a="sb"), types=_in(types))


def _like_any(col: str, pats) -> str:
    return "(" + " OR ".join(f"{col} LIKE {_q(p)}" for p in pats) + ")"


def _like_all(col: str, pats) -> str:
    return "(" + " AND ".join(f"{col} LIKE {_q(p)}" for p in pats) + ")"


def _week_cols(d: str) -> str:
    return f"CAST(year(CAST({d} AS DATE)) AS BIGINT) AS week_year, CAST(weekofyear(CAST({d} AS DATE)) AS BIGINT) AS week_of_year"


#: the 52 weekly as-of dates up to the fixed one, each with its own window
_YEAR_OF_WEEKS = f"""win AS (SELECT as_of, CAST(date_trunc('week', as_of - 14) AS DATE) AS s, CAST(date_trunc('week', as_of) AS DATE) AS e
  FROM (SELECT CAST({AS_OF} - CAST(7 * range AS INTEGER) AS DATE) AS as_of FROM range(52)))"""


def kpi1(weeks: str = _WEEKS, first: str = "") -> str:
    first = first or _pos(_uw_short(), 'CAST(sent AS DATE)', 'eff', 'CAST(sb_created AS DATE)', 'quote_id')
    body = f"""{weeks}, {_OPX}, {_DOCS},
pq AS (
  SELECT q.* FROM bms_quote_mst q LEFT JOIN adm_bm_lkp_transaction_types tt ON tt.lkp_id = q.lkp_transaction_type_id
  WHERE {_LIVE.format(a='q')} AND tt.lkp_desc = {_q(V.TT_NEW_BUSINESS)}
  QUALIFY row_number() OVER (PARTITION BY q.submission_id ORDER BY CASE WHEN q.bind_dt IS NOT NULL THEN 0 ELSE 1 END, q.quote_id) = 1),
quote_doc AS (SELECT submission_number, MIN(created_dt) AS d FROM docs
       WHERE {_like_any('upper(trim(document_name))', V.DOC_QUOTE_TO_AGENT_CONTAINS)} GROUP BY 1),
quote_trc AS (SELECT tr.quote_id, MIN(tr.created_dt) AS d FROM bms_tracers tr
       JOIN adm_bm_tracer_sub_types st ON st.tracer_sub_type_id = tr.tracer_sub_type_id
       WHERE st.tracer_type_code = {_q(V.TRACER_SUBTYPE_QUOTE)} AND tr.tracer_desc LIKE {_q(V.TRACER_QUOTE_PREFIX)} GROUP BY 1),
base AS (
  SELECT sb.submission_code, sb.created_dt AS sb_created, pq.quote_id, pq.quote_code, pq.policy_number, pq.bind_dt, pq.trans_finalize_dt,
         uw.first_name, uw.last_name, latest_opt.eff, COALESCE(quote_doc.d, quote_trc.d) AS sent
  FROM bms_submission_mst sb JOIN pq ON pq.submission_id = sb.submission_id
  JOIN adm_co_users uw ON uw.user_id = sb.user_id_accexecutive
  LEFT JOIN latest_opt ON latest_opt.quote_id = pq.quote_id
  LEFT JOIN quote_doc ON quote_doc.submission_number = sb.submission_code
  LEFT JOIN quote_trc ON quote_trc.quote_id = pq.quote_id
  WHERE {_LIVE.format(a='sb')})
SELECT {first}, {_week_cols('sent')}, {_uw_short()} AS underwriter, {_q(V.KPI1_TRANSACTION_LABEL)} AS transaction_type,
  submission_code AS submission_number, quote_code AS quote_number, policy_number, {_status()} AS policy_status,
  eff AS policy_effective_dt, CAST(sb_created AS DATE) AS submission_received_dt, CAST(sent AS DATE) AS quote_sent_dt,
  CAST({_bd_exclusive('sb_created', 'sent')} AS BIGINT) AS kpi1_business_days,
  CASE WHEN {_bd_exclusive('sb_created', 'sent')} < 0 THEN 'Data Issue'
       WHEN {_bd_exclusive('sb_created', 'sent')} <= {V.KPI1_GREEN_MAX_BUSINESS_DAYS} THEN 'Green' ELSE 'Red' END AS kpi1_status
FROM base, win WHERE sent IS NOT NULL AND CAST(sent AS DATE) >= win.s AND CAST(sent AS DATE) < win.e"""
    return _with(_KPI_TABLES + ["bms_tracers", "adm_bm_tracer_sub_types"], body)


def kpi2() -> str:
    body = f"""{_WEEKS}, {_OPX}, {_DOCS}, {_spine(V.TT_NB_AND_RENEWAL)},
req AS (SELECT submission_number, MIN(created_dt) AS req_dt FROM docs
        WHERE {_like_any('upper(document_name)', V.DOC_BIND_REQUEST)} GROUP BY 1),
sent AS (SELECT r.submission_number, r.req_dt, MIN(d.created_dt) AS sent_dt FROM req r
         JOIN docs d ON d.submission_number = r.submission_number AND d.created_dt >= r.req_dt
         WHERE {_like_any('upper(d.document_name)', V.DOC_BINDER_SENT)} GROUP BY 1, 2),
base AS (SELECT s.*, sent.req_dt, sent.sent_dt, latest_opt.eff FROM spine s
         JOIN sent ON sent.submission_number = s.submission_code LEFT JOIN latest_opt ON latest_opt.quote_id = s.quote_id)
SELECT {_pos(_uw_short(), 'CAST(sent_dt AS DATE)', 'eff', 'quote_id')}, {_week_cols('sent_dt')}, {_uw_short()} AS underwriter, lkp_desc AS transaction_type,
  submission_code AS submission_number, quote_code AS quote_number, policy_number, {_status()} AS policy_status,
  eff AS policy_effective_dt, req_dt AS binder_requested_dttime, sent_dt AS binder_sent_dttime,
  CAST(sent_dt AS DATE) AS binder_sent_dt, CAST({_bd_inclusive('req_dt', 'sent_dt')} AS BIGINT) AS kpi2_business_days,
  CASE WHEN req_dt IS NULL THEN {_q(V.NO_BINDER_REQUEST)} WHEN sent_dt IS NULL THEN {_q(V.NO_BINDER_SENT)}
       WHEN {_bd_inclusive('req_dt', 'sent_dt')} < 0 THEN 'Data Issue'
       WHEN {_bd_inclusive('req_dt', 'sent_dt')} <= {V.KPI2_GREEN_MAX_BUSINESS_DAYS} THEN 'Green' ELSE 'Red' END AS kpi2_status
FROM base, win WHERE sent_dt IS NOT NULL AND CAST(sent_dt AS DATE) >= win.s AND CAST(sent_dt AS DATE) < win.e"""
    return _with(_KPI_TABLES, body)


def kpi3() -> str:
    body = f"""{_WEEKS}, {_OPX}, {_DOCS}, {_spine(V.TT_ENDORSEMENTS)},
endt_span AS (SELECT quote_id,
          MAX(CASE WHEN {_like_any('tracer_desc', V.TRACER_ENDORSEMENT_START)} THEN created_dt END) AS req_dt,
          MAX(CASE WHEN {_like_any('tracer_desc', V.TRACER_ENDORSEMENT_FINALIZED)} THEN created_dt END) AS fin_dt
        FROM bms_tracers WHERE tracer_desc LIKE {_q(V.TRACER_ENDORSEMENT_ANY)} GROUP BY 1),
s2 AS (SELECT s.*, endt_span.req_dt, endt_span.fin_dt FROM spine s LEFT JOIN endt_span ON endt_span.quote_id = s.quote_id),
endt_doc AS (SELECT s2.quote_id, MIN(d.created_dt) AS d FROM s2 JOIN docs d
        ON d.submission_number = s2.submission_code AND s2.req_dt IS NOT NULL AND d.created_dt >= s2.req_dt
        WHERE {_like_all('upper(d.document_name)', V.DOC_ENDORSEMENT_SENT_ALL)} GROUP BY 1),
base AS (SELECT s2.*, COALESCE(endt_doc.d, s2.fin_dt) AS sent, latest_opt.eff FROM s2 LEFT JOIN endt_doc ON endt_doc.quote_id = s2.quote_id
         LEFT JOIN latest_opt ON latest_opt.quote_id = s2.quote_id)
SELECT {_pos(_uw_short(), 'CAST(sent AS DATE)', 'eff', 'quote_id')}, {_week_cols('sent')}, {_uw_short()} AS underwriter, {_q(V.KPI3_TRANSACTION_LABEL)} AS transaction_type,
  quote_code AS quote_number, policy_number, {_status()} AS policy_status, eff AS endorsement_effective_dt,
  req_dt AS endorsement_requested_dttime, sent AS endorsement_sent_dttime, CAST(sent AS DATE) AS endorsement_sent_dt,
  CAST(CASE WHEN req_dt IS NULL THEN NULL ELSE {_bd_inclusive('req_dt', 'sent')} END AS BIGINT) AS kpi3_business_days,
  CASE WHEN req_dt IS NULL THEN {_q(V.NO_ENDORSEMENT_REQUEST)} WHEN sent IS NULL THEN {_q(V.NO_ENDORSEMENT_SENT)}
       WHEN {_bd_inclusive('req_dt', 'sent')} < 0 THEN 'Data Issue'
       WHEN {_bd_inclusive('req_dt', 'sent')} <= {V.KPI3_GREEN_MAX_BUSINESS_DAYS} THEN 'Green' ELSE 'Red' END AS kpi3_status
FROM base, win WHERE sent IS NOT NULL AND CAST(sent AS DATE) >= win.s AND CAST(sent AS DATE) < win.e"""
    return _with(_KPI_TABLES + ["bms_tracers"], body)


def kpi4() -> str:
    body = f"""{_WEEKS}, {_OPX}, {_DOCS}, {_spine(V.TT_NB_AND_RENEWAL)},
policy_doc AS (SELECT submission_number, MIN(created_dt) AS d FROM docs
       WHERE {_like_all('upper(document_name)', V.DOC_POLICY_SENT_ALL)} GROUP BY 1),
base AS (SELECT s.*, COALESCE(policy_doc.d, s.trans_finalize_dt) AS sent, latest_opt.eff FROM spine s
         LEFT JOIN policy_doc ON policy_doc.submission_number = s.submission_code LEFT JOIN latest_opt ON latest_opt.quote_id = s.quote_id)
SELECT {_pos(_uw_short(), 'CAST(sent AS DATE)', 'eff', 'quote_id')}, {_week_cols('sent')}, {_uw_short()} AS underwriter, lkp_desc AS transaction_type,
  submission_code AS submission_number, quote_code AS quote_number, policy_number, {_status()} AS policy_status,
  eff AS policy_effective_dt, CAST(sent AS DATE) AS policy_sent_dt,
  CAST(CAST(sent AS DATE) - eff AS BIGINT) AS kpi4_calendar_days,
  CASE WHEN CAST(sent AS DATE) - eff < 0 THEN 'Data Issue'
       WHEN CAST(sent AS DATE) - eff <= {V.KPI4_GREEN_MAX_CALENDAR_DAYS} THEN 'Green' ELSE 'Red' END AS kpi4_status
FROM base, win WHERE sent IS NOT NULL AND CAST(sent AS DATE) >= win.s AND CAST(sent AS DATE) < win.e"""
    return _with(_KPI_TABLES, body)


def kpi5() -> str:
    body = f"""{_WEEKS}, {_OPX}, {_DOCS}, {_spine(V.TT_RENEWALS)},
agent_doc AS (SELECT submission_number, MIN(created_dt) AS d FROM docs
        WHERE {_like_any('upper(trim(document_name))', V.DOC_QUOTE_TO_AGENT_PREFIX)} GROUP BY 1),
invoice_doc AS (SELECT submission_number, MIN(created_dt) AS d FROM docs
        WHERE upper(trim(document_name)) LIKE {_q(V.DOC_RENEWAL_INVOICE_PREFIX)} GROUP BY 1),
quote_trc AS (SELECT quote_id, MIN(created_dt) AS d FROM bms_tracers WHERE tracer_desc IN {_in(V.TRACER_QUOTE_SENT)} GROUP BY 1),
base AS (SELECT s.*, COALESCE(agent_doc.d, invoice_doc.d, quote_trc.d, s.quote_dt, s.created_dt) AS sent, latest_opt.eff FROM spine s
         LEFT JOIN agent_doc ON agent_doc.submission_number = s.submission_code LEFT JOIN invoice_doc ON invoice_doc.submission_number = s.submission_code
         LEFT JOIN quote_trc ON quote_trc.quote_id = s.quote_id LEFT JOIN latest_opt ON latest_opt.quote_id = s.quote_id)
SELECT {_pos(_uw_short(), 'CAST(sent AS DATE)', 'eff', 'quote_id')}, {_week_cols('sent')}, {_uw_short()} AS underwriter, {_q(V.KPI5_TRANSACTION_LABEL)} AS transaction_type,
  submission_code AS submission_number, quote_code AS quote_number, policy_number, {_status()} AS policy_status,
  eff AS renewal_effective_dt, CAST(sent AS DATE) AS renewal_quote_sent_dt, CAST(trans_finalize_dt AS DATE) AS finalize_dt,
  CAST(eff - CAST(sent AS DATE) AS BIGINT) AS kpi5_days_before_eff,
  CASE WHEN eff IS NULL THEN NULL WHEN eff - CAST(sent AS DATE) < 0 THEN 'Data Issue'
       WHEN eff - CAST(sent AS DATE) >= {V.KPI5_GREEN_MIN_LEAD_DAYS} THEN 'Green' ELSE 'Red' END AS kpi5_status
FROM base, win WHERE sent IS NOT NULL AND CAST(sent AS DATE) >= win.s AND CAST(sent AS DATE) < win.e"""
    return _with(_KPI_TABLES + ["bms_tracers"], body)


def _code_number(code: str) -> str:
    return f"TRY_CAST(NULLIF(replace({code}, {_q(V.AGENCY_CODE_PREFIX)}, ''), '') AS INTEGER)"


def retention() -> str:
    body = f"""producers AS (
  SELECT submission_id, TRY_CAST(NULLIF(trim(substr(CAST(original_producer_id AS VARCHAR), 1, 50)), '') AS INTEGER) AS agency_id
  FROM bms_submission_mst WHERE {_LIVE_ROW}),
renewals AS (
  SELECT submission_id, quote_id, bind_dt IS NOT NULL AS bound, year(CAST(COALESCE(quote_dt, created_dt) AS DATE)) AS cohort_year
  FROM bms_quote_mst
  WHERE {_LIVE_ROW} AND lkp_transaction_type_id IN (SELECT lkp_id FROM adm_bm_lkp_transaction_types WHERE lkp_desc IN {_in(V.TT_RENEWALS)})),
quotes AS (
  SELECT agency_id, cohort_year, quote_id, bool_or(bound) AS bound FROM renewals JOIN producers USING (submission_id)
  WHERE agency_id IS NOT NULL AND cohort_year BETWEEN 1995 AND 2001 GROUP BY ALL),
cohorts AS (
  SELECT agency_id, cohort_year, COUNT(*) AS started, COUNT(*) FILTER (bound) AS bound FROM quotes GROUP BY ALL)
SELECT {_pos(_code_number('agency_code'), 'agency_code', 'cohort_year', 'agency_id')},
  substr(agency_code, 1, 50) AS agency_code, substr(agency_name, 1, 150) AS agency_name,
  CAST(cohort_year AS BIGINT) AS cohort_year, CAST(started AS BIGINT) AS renewals_started,
  CAST(bound AS BIGINT) AS renewals_bound, CAST((20000 * bound + started) // (2 * started) AS DOUBLE) / 100.0 AS renewal_retention_pct
FROM cohorts JOIN (SELECT agency_id, agency_code, agency_name FROM adm_co_agencies
  WHERE COALESCE(flg_active, 1) = 1 AND agency_code NOT IN {_in(V.RETENTION_EXCLUDED_AGENCY_CODES)}) USING (agency_id)"""
    return _with(["bms_submission_mst", "bms_quote_mst", "adm_bm_lkp_transaction_types", "adm_co_agencies"], body)


def heatmap() -> str:
    body = f"""kinds AS (
  SELECT lkp_id, lkp_desc FROM adm_bm_lkp_transaction_types WHERE {_tt_heat()}),
labels AS (  -- one row of an agency id, its least (code, name)
  SELECT agency_id, min({{'code': trim(agency_code), 'name': trim(agency_name)}}) AS label FROM adm_co_agencies GROUP BY 1),
lines AS (
  SELECT product_id, trim(product_name) AS product, trim(class_type_name) AS lob
  FROM adm_co_products LEFT JOIN adm_co_class_types USING (class_type_id)),
policies AS (
  SELECT q.quote_id, q.policy_number, {_status('q.bind_dt', 'q.trans_finalize_dt')} AS policy_status, kinds.lkp_desc,
         COALESCE(q.original_producer_id, sb.original_producer_id) AS agency_id
  FROM (SELECT * FROM bms_quote_mst WHERE flg_active = 1 AND trim(policy_number) <> ''
          AND created_dt >= DATE '2001-01-01' AND created_dt < DATE '2001-06-16') q
  JOIN kinds ON kinds.lkp_id = q.lkp_transaction_type_id LEFT JOIN bms_submission_mst sb USING (submission_id)),
sites AS (
  SELECT DISTINCT business_id FROM bms_locations
  WHERE location_id IN (SELECT location_id FROM bms_building_mst WHERE flg_active = 1)),
premiums AS (
  SELECT quote_id, product_id, CAST(sub_total_premium AS VARCHAR) AS premium FROM bms_options_mst
  WHERE flg_active = 1 AND {_money('sub_total_premium')} > 0 AND business_id IN (SELECT business_id FROM sites)),
risks AS (
  SELECT quote_id, insured_name, adr_phy_city AS raw_city, adr_phy_state_code AS raw_state,
         trim(adr_phy_city) AS city, trim(adr_phy_state_code) AS state, trim(adr_phy_zip) AS zip FROM bms_quote_insured_mst)
SELECT {_pos('raw_state', 'raw_city', 'policy_number', 'quote_id', 'product_id', 'insured_name')}, policy_number, COALESCE(lob, '') AS lob, COALESCE(product, '') AS product_name, policy_status,
  COALESCE(label.code, '') AS agency_id, COALESCE(label.name, '') AS agency_name, COALESCE(city, '') AS risk_city,
  COALESCE(state, '') AS risk_state, COALESCE(zip, '') AS risk_zip, lkp_desc AS transaction_type,
  substr(premium, 1, 50) AS written_premium
FROM policies JOIN risks USING (quote_id) JOIN premiums USING (quote_id)
LEFT JOIN lines USING (product_id) LEFT JOIN labels ON labels.agency_id = policies.agency_id"""
    return _with(["bms_options_mst", "bms_quote_mst", "bms_quote_insured_mst", "adm_co_products", "adm_co_class_types",
                  "adm_bm_lkp_transaction_types", "bms_submission_mst", "adm_co_agencies", "bms_locations",
                  "bms_building_mst"], body)


def _name3(trim_last: bool) -> str:
    part = "trim(COALESCE(substr(u.{c}, 1, 100), ''))"
    first, middle, last = part.format(c="first_name"), part.format(c="middle_name"), part.format(c="last_name")
    if trim_last:
        return f"{first} || ' ' || {middle} || CASE WHEN {last} = '' THEN '' ELSE ' ' || {last} END"
    return f"{first} || ' ' || {middle} || ' ' || {last}"


def _us(d: str) -> str:
    return f"strftime(CAST({d} AS DATE), '%m-%d-%Y')"


# quotes with their submission's code and the agency they belong to (the quote's own, else the submission's)
_PLACED = """placed AS (
  SELECT q.*, sb.submission_code, COALESCE(q.original_producer_id, sb.original_producer_id) AS agency_id
  FROM bms_quote_mst q LEFT JOIN bms_submission_mst sb USING (submission_id))"""


def quotes_due() -> str:
    body = f"""{_email_union("IN " + _in(V.EMAIL_QUOTE_OR_RENEWAL))},
mailed AS (SELECT DISTINCT business_id, quote_id FROM em),
due AS (
  SELECT quote_id, business_id, user_id_acc_executive AS user_id, sub_total_premium AS premium, proposed_eff_date AS eff, proposed_exp_date AS expires
  FROM bms_options_mst JOIN mailed USING (business_id, quote_id)
  WHERE flg_active = 1 AND sub_total_premium > {V.PREMIUM_THRESHOLD}
    AND proposed_eff_date BETWEEN DATE '2001-04-01' AND DATE '2001-06-30'),
open_statuses AS (SELECT status_id, main_status_text FROM adm_bm_statuses WHERE status_code IN {_in(V.OPEN_QUOTE_STATUSES)}),
brokers AS (SELECT u.user_id, {_name3(False)} AS broker FROM adm_co_users u),
{_PLACED},
agencies AS (SELECT agency_id, agency_code, agency_name FROM adm_co_agencies)
SELECT {_pos('eff', 'submission_code', 'quote_code', 'quote_id', 'business_id', 'insured_name')},
  substr(submission_code, 1, 100) AS submission_number, substr(quote_code, 1, 100) AS quote_number, broker AS uw_broker,
  substr(insured_name, 1, 400) AS insured_name, substr(COALESCE(agency_code, ''), 1, 100) AS agency_code,
  substr(COALESCE(agency_name, ''), 1, 400) AS agency_name, substr(lkp_desc, 1, 400) AS transaction_type,
  substr(CAST(premium AS VARCHAR), 1, 50) AS premium, {_us('eff')} AS proposed_eff_date, {_us('expires')} AS proposed_exp_date,
  CAST(date_diff('day', {AS_OF}, CAST(eff AS DATE)) AS VARCHAR) AS days_until_effective_date,
  substr(main_status_text, 1, 400) AS quote_status
FROM due JOIN brokers USING (user_id) JOIN placed USING (quote_id) JOIN open_statuses USING (status_id)
JOIN (SELECT quote_id, insured_name FROM bms_quote_insured_mst) insured USING (quote_id)
LEFT JOIN agencies USING (agency_id) LEFT JOIN adm_bm_lkp_transaction_types kinds ON kinds.lkp_id = placed.lkp_transaction_type_id
WHERE placed.flg_active = 1"""
    return _with(["bms_quote_mst", "bms_options_mst", "bms_quote_insured_mst", "adm_co_users",
                  "adm_bm_lkp_transaction_types", "bms_submission_mst", "adm_bm_statuses", "adm_co_agencies",
                  "bms_email_confirmation_details", "bms_template_memos", "adm_co_lkp_email_process_parameters"], body)


def renewals_forecast() -> str:
    body = f"""{_PLACED},
outside AS (SELECT lkp_id FROM adm_bm_lkp_transaction_types WHERE NOT ({_tt_forecast()})),
policies AS (
  SELECT quote_id, policy_number, submission_code, agency_id, {_status()} AS policy_status, lkp_transaction_type_id AS lkp_id
  FROM placed ANTI JOIN outside ON outside.lkp_id = placed.lkp_transaction_type_id
  WHERE COALESCE(flg_active, 1) = 1 AND trim(substr(policy_number, 1, 100)) <> ''),
terms AS (
  SELECT quote_id, user_id_acc_executive AS user_id, effective_dt, proposed_exp_date, sub_total_premium FROM bms_options_mst
  WHERE COALESCE(flg_active, 1) = 1 AND proposed_exp_date > {AS_OF}),
writers AS (SELECT u.user_id, {_name3(True)} AS writer FROM adm_co_users u),
risks AS (
  SELECT quote_id, trim(adr_phy_city) AS city, trim(adr_phy_state_code) AS state, trim(adr_phy_zip) AS zip FROM bms_quote_insured_mst),
agencies AS (SELECT agency_id, substr(agency_code, 1, 50) AS code, substr(agency_name, 1, 150) AS name FROM adm_co_agencies)
SELECT code AS agency_code, name AS agency_name, COALESCE(writer, ' ') AS underwriter, substr(policy_number, 1, 100) AS policy_number,
  substr(submission_code, 1, 100) AS submission_number, substr(CAST(quote_id AS VARCHAR), 1, 100) AS quote_id, policy_status,
  COALESCE(substr(lkp_desc, 1, 100), '') AS transaction_type, substr(effective_dt, 1, 10) AS effective_date,
  {_us('proposed_exp_date')} AS expiration_date, substr(CAST(sub_total_premium AS VARCHAR), 1, 50) AS written_premium,
  COALESCE(city, '') AS risk_city, COALESCE(state, '') AS risk_state, COALESCE(zip, '') AS risk_zip
FROM policies JOIN terms USING (quote_id) LEFT JOIN risks USING (quote_id) LEFT JOIN agencies USING (agency_id)
LEFT JOIN writers USING (user_id) LEFT JOIN adm_bm_lkp_transaction_types USING (lkp_id)"""
    return _with(["bms_options_mst", "bms_quote_mst", "bms_submission_mst", "bms_quote_insured_mst", "adm_co_agencies",
                  "adm_co_users", "adm_bm_lkp_transaction_types"], body)


def followup() -> str:
    d1, d2, d3 = V.FOLLOW_UP_DAYS
    body = f"""{_email_union("= " + _q(V.EMAIL_QUOTE))},
first_mail AS (
  SELECT business_id, quote_id, MIN(created_dt) AS sent FROM em GROUP BY ALL
  HAVING MIN(created_dt) >= DATE '2001-05-01' AND MIN(created_dt) < DATE '2001-06-16'),
offered AS (
  SELECT quote_id, quote_code, status_text FROM bms_quote_mst
  JOIN (SELECT status_id, substr(main_status_text, 1, 400) AS status_text FROM adm_bm_statuses) USING (status_id)
  WHERE flg_active = 1 AND status_text = {_q(V.STATUS_NB_QUOTE_OFFERED_TEXT)})
SELECT {_pos('sent', 'quote_id', 'business_id', 'proposed_eff_date', 'proposed_exp_date', 'sub_total_premium')}, substr(quote_code, 1, 100) AS quote_code, substr(CAST(business_id AS VARCHAR), 1, 100) AS business_id,
  {_us('sent')} AS quote_sent_date, {_us(f'CAST(sent AS DATE) + {d1}')} AS first_follow_up_due_date,
  {_us(f'CAST(sent AS DATE) + {d2}')} AS second_follow_up_due_date, {_us(f'CAST(sent AS DATE) + {d3}')} AS qcl_due_date,
  {_us('proposed_eff_date')} AS proposed_eff_date, {_us('proposed_exp_date')} AS proposed_exp_date,
  substr(CAST(sub_total_premium AS VARCHAR), 1, 50) AS premium, status_text AS quote_status
FROM first_mail JOIN offered USING (quote_id) JOIN bms_options_mst USING (business_id, quote_id)
WHERE flg_active = 1 AND sub_total_premium > {V.PREMIUM_THRESHOLD}"""
    return _with(["bms_quote_mst", "bms_options_mst", "adm_bm_statuses", "bms_email_confirmation_details",
                  "bms_template_memos", "adm_co_lkp_email_process_parameters"], body)


def submission_lookup() -> str:
    body = f"""insured AS (
  SELECT submission_id, substr(insured_name, 1, 200) AS insured_name
  FROM (SELECT submission_id, quote_id FROM bms_quote_mst WHERE {_LIVE_ROW}) LEFT JOIN bms_quote_insured_mst USING (quote_id)),
agencies AS (
  SELECT agency_id AS original_producer_id, substr(agency_name, 1, 150) AS agency_name FROM adm_co_agencies
  WHERE COALESCE(flg_active, 1) = 1)
SELECT {_pos('submission_code', 'agency_name', 'insured_name')},
  substr(submission_code, 1, 50) AS submission_number, agency_name, insured_name
FROM (SELECT * FROM bms_submission_mst WHERE {_LIVE_ROW})
LEFT JOIN agencies USING (original_producer_id) LEFT JOIN insured USING (submission_id)"""
    return _with(["bms_submission_mst", "adm_co_agencies", "bms_quote_mst", "bms_quote_insured_mst"], body)


# ------------------------------------------------------------------------------------------ scorecard

_SC_TABLES = ["bms_submission_mst", "bms_quote_mst", "adm_bm_lkp_transaction_types", "bms_options_mst",
              "bms_quote_closed", "adm_co_agencies"]

#: measure -> (condition on a deal, what is added up; None counts distinct quotes)
_DEAL_MEASURES = {
    "quotes_started": ("started", None), "raw_quote_rows_started": ("started", "1"),
    "quotes_started_bound": ("started AND bound", None),
    "nb_quotes_started": ("started AND nb", None), "nb_quotes_bound": ("started AND nb AND bound", None),
    "renewal_quotes_started": ("started AND rn", None), "renewal_quotes_bound": ("started AND rn AND bound", None),
    "binds": ("won", None), "binds_from_cohort": ("won AND started", None),
    "nb_binds": ("won AND nb", None), "renewal_binds": ("won AND rn", None),
    "sum_days_to_bind": ("won", "days"), "cnt_days_to_bind": ("won AND days IS NOT NULL", "1"),
    "bound_premium": ("won", "prem"), "bound_fees": ("won", "fees"),
    "bound_premium_from_cohort": ("won AND started", "prem"), "bound_fees_from_cohort": ("won AND started", "fees"),
    "nb_bound_premium": ("won AND nb", "prem"), "renewal_bound_premium": ("won AND rn", "prem"),
}


def _sc_ctes() -> str:
    """One fact row per live quote of a live submission with a producer; every measure is a filtered
    aggregate of it.  A quote started or won in the window makes its submission a touched one, so the
    funnel needs no list of submissions; declines do, as any quote of a touched submission may be declined."""
    def inside(d: str) -> str:
        return f"COALESCE({d} >= DATE '2001-03-15' AND {d} < DATE '2001-06-16', FALSE)"
    newest = ("ORDER BY COALESCE(updated_dt, created_dt) DESC NULLS LAST, prem DESC NULLS LAST, "
              "product_id DESC NULLS LAST, fees DESC NULLS LAST")
    funnel = ",\n    ".join(
        (f"COUNT(DISTINCT quote_id) FILTER ({cond})" if amount is None else f"SUM({amount}) FILTER ({cond})") + f" AS {name}"
        for name, (cond, amount) in _DEAL_MEASURES.items())
    zeros = ", ".join(f"COALESCE({c}, 0) AS {c}" for c in _SC_MEASURES)
    totals = ", ".join(f"SUM({c}) AS {c}" for c in _SC_MEASURES)
    return f"""prices AS (
  SELECT quote_id, first(prem {newest}) AS prem, first(fees {newest}) AS fees
  FROM (SELECT *, {_money('sub_total_premium')} AS prem,
               CAST(COALESCE(total_fee_taxable, 0) + COALESCE(total_fee_non_taxable, 0) AS DECIMAL(18,2)) AS fees
        FROM bms_options_mst WHERE COALESCE(flg_active, 1) = 1) GROUP BY quote_id),
subs AS (
  SELECT submission_id, original_producer_id AS agency_id, {inside('created_dt')} AS created_in FROM bms_submission_mst
  WHERE {_LIVE_ROW} AND original_producer_id IS NOT NULL),
deals AS (
  SELECT agency_id, submission_id, quote_id, prem, fees, bind_dt IS NOT NULL AS bound,
    {inside('COALESCE(quote_dt, created_dt)')} AS started, {inside('bind_dt')} AS won,
    COALESCE(lkp_desc = {_q(V.TT_NEW_BUSINESS)}, FALSE) AS nb, COALESCE(lkp_desc IN {_in(V.TT_RENEWALS)}, FALSE) AS rn,
    CAST(date_diff('day', CAST(COALESCE(quote_dt, created_dt) AS DATE), CAST(bind_dt AS DATE)) AS DECIMAL(18,2)) AS days
  FROM (SELECT *, lkp_transaction_type_id AS lkp_id FROM bms_quote_mst WHERE {_LIVE_ROW}) JOIN subs USING (submission_id)
  LEFT JOIN adm_bm_lkp_transaction_types USING (lkp_id) LEFT JOIN prices USING (quote_id)),
touched AS (
  SELECT submission_id, agency_id, bool_or(created_in) AS created_in, bool_or(quoted) AS quoted
  FROM (SELECT submission_id, agency_id, created_in, FALSE AS quoted FROM subs WHERE created_in
        UNION ALL SELECT submission_id, agency_id, FALSE, started FROM deals WHERE started OR won) GROUP BY ALL),
intake AS (
  SELECT agency_id, COUNT(*) FILTER (created_in) AS submissions_created, COUNT(*) AS submissions_activity,
    COUNT(*) FILTER (quoted) AS submissions_quoted FROM touched GROUP BY 1),
funnel AS (
  SELECT agency_id,
    {funnel}
  FROM deals WHERE started OR won GROUP BY 1),
lost AS (
  SELECT agency_id, COUNT(DISTINCT quote_id) AS declines, SUM(COALESCE(prem, 0)) AS declined_premium
  FROM deals SEMI JOIN touched USING (submission_id)
  JOIN (SELECT quote_id FROM bms_quote_closed
        WHERE COALESCE(flg_active, 1) = 1 AND flg_decline = 1 AND {inside('created_dt')}) closures USING (quote_id)
  GROUP BY 1),
measures AS (
  SELECT agency_id, {zeros} FROM intake LEFT JOIN funnel USING (agency_id) LEFT JOIN lost USING (agency_id)),
metrics AS (
  SELECT agency_code, agency_name, measures.* FROM measures JOIN adm_co_agencies USING (agency_id)
  WHERE COALESCE(flg_active, 1) = 1),
rollmap(agency_code, rollup_code, rollup_name) AS (VALUES {", ".join(f"({_q(a)}, {_q(b)}, {_q(c)})" for a, b, c in V.AGENCY_ROLLUP)}),
reported AS (
  SELECT * REPLACE (COALESCE(rollup_code, agency_code) AS agency_code, COALESCE(rollup_name, agency_name) AS agency_name)
  FROM metrics LEFT JOIN rollmap USING (agency_code)),
final_agg AS (SELECT agency_code, agency_name, {totals} FROM reported GROUP BY ALL)"""


def _score_sql() -> dict[str, str]:
    cr, ac, qu = "CAST(submissions_created AS DOUBLE)", "CAST(submissions_activity AS DOUBLE)", "CAST(submissions_quoted AS DOUBLE)"
    decline = f"GREATEST(0.0, 1.0 - CAST(declines AS DOUBLE) / ({qu} + 10.0))"
    thr = f"CASE WHEN binds >= submissions_created THEN 1.0 ELSE CAST(binds AS DOUBLE) / {cr} END"
    ramp = f"({cr} / ({cr} + 15.0))"
    dollars = "CAST(bound_premium + bound_fees AS DOUBLE)"
    share = "CASE WHEN binds = 0 THEN 0.0 ELSE LEAST(1.0, CAST(binds_from_cohort AS DOUBLE) / CAST(binds AS DOUBLE)) END"
    qb = "CAST(quotes_started_bound AS DOUBLE) / CAST(quotes_started AS DOUBLE)"
    avg = "CAST(sum_days_to_bind AS DOUBLE) / CAST(cnt_days_to_bind AS DOUBLE)"
    speed = f"CASE WHEN cnt_days_to_bind = 0 THEN 0.0 ELSE 1.0 / NULLIF(1.0 + ({avg}) / 10.0, 0.0) END"
    vol = f"CASE WHEN submissions_activity >= 20 THEN 1.0 WHEN submissions_activity <= 0 THEN 0.0 ELSE {ac} / 20.0 END"
    return {
        "mvs_overall": f"CASE WHEN submissions_created = 0 THEN NULL ELSE round({dollars} * ({thr}) * {decline} * {ramp} / 1000.0, 2) END",
        "mvs_momentum": f"CASE WHEN submissions_created = 0 THEN NULL ELSE round({dollars} * ({thr}) * ({share}) * {decline} * {ramp} / 1000.0, 2) END",
        "ops_efficiency_score": (f"CASE WHEN submissions_activity = 0 OR quotes_started = 0 THEN NULL ELSE "
                                 f"round(100.0 * ({qu} / {ac}) * ({qb}) * {decline} * ({speed}) * ({vol}), 2) END"),
        "pipeline_health_score": (f"CASE WHEN submissions_created = 0 OR quotes_started = 0 THEN NULL ELSE "
                                  f"round(100.0 * ({qb}) * {decline} * {ramp}, 2) END"),
    }


def _problem_case(field: int, width: int) -> str:
    conds = [
        "COALESCE(submissions_created, 0) = 0 AND COALESCE(submissions_activity, 0) = 0",
        "COALESCE(submissions_created, 0) > 0 AND COALESCE(submissions_quoted, 0) = 0 AND COALESCE(quotes_started, 0) = 0 AND COALESCE(binds, 0) = 0",
        "submissions_created >= 10 AND submissions_quoted * 100 < 30 * submissions_created",
        "submissions_activity >= 10 AND submissions_quoted * 100 < 40 * submissions_activity",
        "quotes_started >= 5 AND quotes_started_bound * 100 < 20 * quotes_started",
        "submissions_quoted >= 5 AND declines * 100 >= 50 * submissions_quoted",
        "binds >= 5 AND (binds - binds_from_cohort) * 100 >= 70 * binds",
    ]
    whens = " ".join(f"WHEN {c} THEN {_q(V.PROBLEM_TYPES[i][field])}" for i, c in enumerate(conds))
    return f"substr(CASE {whens} ELSE {_q(V.PROBLEM_TYPES[7][field])} END, 1, {width})"


def scorecard() -> str:
    scores_sql = _score_sql()
    lw, ew, aw = V.PROBLEM_TEXT_WIDTHS
    cents = lambda c: f"CAST(({c}) * 100 AS HUGEINT)"
    body = f"""{_sc_ctes()}
SELECT {_pos(scores_sql['mvs_overall'] + ' DESC NULLS LAST', 'bound_premium DESC NULLS LAST',
                 'submissions_created DESC NULLS LAST', 'agency_name', 'agency_code')},
  substr(agency_code, 1, 50) AS agency_code, substr(agency_name, 1, 150) AS agency_name,
  CAST(submissions_created AS BIGINT) AS submissions_created_r3m, CAST(submissions_activity AS BIGINT) AS submissions_activity_r3m,
  CAST(submissions_quoted AS BIGINT) AS submissions_quoted_r3m, CAST(quotes_started AS BIGINT) AS quotes_started_r3m,
  CAST(raw_quote_rows_started AS BIGINT) AS raw_quote_rows_started_r3m,
  CAST(quotes_started_bound AS BIGINT) AS quotes_started_bound_to_date,
  {_ratio4('submissions_quoted', 'submissions_created')} AS sub_to_quote_pct_vs_intake,
  {_ratio4('submissions_quoted', 'submissions_activity')} AS sub_to_quote_pct_vs_activity,
  {_ratio4('quotes_started_bound', 'quotes_started')} AS quote_to_bind_pct,
  CAST(nb_quotes_started AS BIGINT) AS nb_quotes_started_r3m, CAST(nb_quotes_bound AS BIGINT) AS nb_quotes_bound_to_date,
  {_ratio4('nb_quotes_bound', 'nb_quotes_started')} AS nb_quote_to_bind_pct,
  CAST(renewal_quotes_started AS BIGINT) AS renewal_quotes_started_r3m,
  CAST(renewal_quotes_bound AS BIGINT) AS renewal_quotes_bound_to_date,
  {_ratio4('renewal_quotes_bound', 'renewal_quotes_started')} AS renewal_quote_to_bind_pct,
  CAST(declines AS BIGINT) AS declines_created_r3m, {_ratio4('declines', 'submissions_quoted')} AS decline_rate_pct,
  CAST(binds AS BIGINT) AS binds_r3m, CAST(binds_from_cohort AS BIGINT) AS binds_r3m_from_cohort,
  CAST(binds - binds_from_cohort AS BIGINT) AS binds_r3m_carryover,
  {_ratio4('binds - binds_from_cohort', 'binds')} AS carryover_pct,
  {_ratio4('binds', 'submissions_created')} AS binds_per_intake_pct,
  {_ratio4('binds', 'submissions_activity')} AS binds_per_activity_pct,
  CAST(bound_premium AS DOUBLE) AS bound_premium_r3m, CAST(bound_fees AS DOUBLE) AS bound_fees_r3m,
  CAST(declined_premium AS DOUBLE) AS declined_premium_r3m,
  {_ratio4(cents('bound_premium'), cents('bound_premium + declined_premium'))} AS dollar_hit_ratio_pct,
  CAST(nb_binds AS BIGINT) AS nb_binds_r3m, CAST(renewal_binds AS BIGINT) AS renewal_binds_r3m,
  CAST(nb_bound_premium AS DOUBLE) AS nb_bound_premium_r3m, CAST(renewal_bound_premium AS DOUBLE) AS renewal_bound_premium_r3m,
  CASE WHEN binds = 0 THEN NULL ELSE CAST((2 * {cents('bound_premium')} + binds) // (2 * binds) AS DOUBLE) / 100.0 END
    AS avg_bound_premium_per_bind,
  CAST(bound_premium_from_cohort AS DOUBLE) AS bound_premium_r3m_from_cohort,
  CAST(bound_premium - bound_premium_from_cohort AS DOUBLE) AS bound_premium_r3m_carryover,
  CAST(bound_fees_from_cohort AS DOUBLE) AS bound_fees_r3m_from_cohort,
  CAST(bound_fees - bound_fees_from_cohort AS DOUBLE) AS bound_fees_r3m_carryover,
  {scores_sql['mvs_overall']} AS mvs_overall, {scores_sql['mvs_momentum']} AS mvs_momentum,
  {scores_sql['ops_efficiency_score']} AS ops_efficiency_score, {scores_sql['pipeline_health_score']} AS pipeline_health_score,
  {_problem_case(1, lw)} AS problem_type_label, {_problem_case(2, ew)} AS problem_type_explanation,
  {_problem_case(3, aw)} AS primary_recommended_action
FROM final_agg"""
    return _with(_SC_TABLES, body)


#: each holds the option's creation date, written in one text form and read back
DATE_FORM_COLUMNS = ("compact", "slashes", "dots", "us_short", "six_digits", "month_first", "day_first", "dashes", "year_first",
                     "iso_time", "us_time")

REPORT_SQL = {
    "rpt_kpi1_submission_to_quote": kpi1,
    "rpt_kpi2_binder": kpi2,
    "rpt_kpi3_endorsement": kpi3,
    "rpt_kpi4_policy_sent": kpi4,
    "rpt_kpi5_renewal_lead": kpi5,
    "rpt_agency_retention": retention,
    "rpt_heatmap_detail": heatmap,
    "rpt_quotes_due": quotes_due,
    "rpt_renewals_forecast": renewals_forecast,
    "rpt_agency_scorecard": scorecard,
    "rpt_quote_followup": followup,
    "rpt_submission_lookup": submission_lookup,
}




# ------------------------------------------------------------------------------------------ operators

_ALL = list(FIXTURE_SQL)


def _b(cond: str) -> str:
    return f"CAST(CASE WHEN ({cond}) THEN 1 WHEN NOT ({cond}) THEN 0 END AS BIGINT)"


def _tt_heat(d: str = "lkp_desc") -> str:
    return (f"({d} IN {_in(V.TT_HEATMAP)} OR {d} LIKE {_q(V.TT_CANCEL_PREFIX)}) AND ({d} IS NULL OR {d} NOT LIKE {_q(V.TT_NOTICE_PREFIX)})")


def _tt_forecast(d: str = "lkp_desc") -> str:
    return f"({d} IS NULL OR ({d} NOT IN {_in(V.TT_FORECAST_EXCLUDED)} AND {d} NOT LIKE {_q(V.TT_CANCEL_PREFIX)}))"


_DOC_PREDS = {
    "is_quote_to_agent": _like_any("upper(trim(document_name))", V.DOC_QUOTE_TO_AGENT_CONTAINS),
    "is_quote_to_agent_prefix": _like_any("upper(trim(document_name))", V.DOC_QUOTE_TO_AGENT_PREFIX),
    "is_bind_request": _like_any("upper(document_name)", V.DOC_BIND_REQUEST),
    "is_binder_sent": _like_any("upper(document_name)", V.DOC_BINDER_SENT),
    "is_endorsement_sent": _like_all("upper(document_name)", V.DOC_ENDORSEMENT_SENT_ALL),
    "is_policy_sent": _like_all("upper(document_name)", V.DOC_POLICY_SENT_ALL),
    "is_renewal_invoice": f"upper(trim(document_name)) LIKE {_q(V.DOC_RENEWAL_INVOICE_PREFIX)}",
}

def _band_max(x: str, n: int) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 0 THEN 'Data Issue' WHEN {x} <= {n} THEN 'Green' ELSE 'Red' END"


def _sub_quotes() -> str:
    return (f"sq AS (SELECT q.quote_id, q.submission_id, q.bind_dt, q.lkp_transaction_type_id, sb.original_producer_id AS agency_id "
            f"FROM bms_quote_mst q JOIN bms_submission_mst sb ON sb.submission_id = q.submission_id WHERE {_LIVE.format(a='q')})")


def _email_union(code_pred: str) -> str:
    return f"""codes AS (SELECT lkp_id FROM adm_co_lkp_email_process_parameters WHERE lkp_code {code_pred}),
em AS (
  SELECT business_id, quote_id, created_dt FROM bms_email_confirmation_details
  WHERE flg_active = 1 AND lkp_email_process_parameter_id IN (SELECT lkp_id FROM codes)
  UNION ALL
  SELECT business_id, quote_id, created_dt FROM bms_template_memos
  WHERE flg_active = 1 AND lkp_email_process_parameters_id IN (SELECT lkp_id FROM codes))"""


_EMAIL_TABLES = ["bms_email_confirmation_details", "bms_template_memos", "adm_co_lkp_email_process_parameters"]


def _sc_select(view: str, cols: list[str], money: set[str]) -> str:
    parts = [f"CAST({c} AS DOUBLE) AS {c}" if c in money else f"CAST({c} AS BIGINT) AS {c}" for c in cols]
    return ", ".join(parts)


_SC_MEASURES = ["submissions_created", "submissions_activity", "submissions_quoted", "quotes_started",
                "raw_quote_rows_started", "quotes_started_bound", "nb_quotes_started", "nb_quotes_bound",
                "renewal_quotes_started", "renewal_quotes_bound", "declines", "declined_premium", "binds",
                "binds_from_cohort", "sum_days_to_bind", "cnt_days_to_bind", "bound_premium", "bound_fees",
                "bound_premium_from_cohort", "bound_fees_from_cohort", "nb_binds", "renewal_binds", "nb_bound_premium",
                "renewal_bound_premium"]
_SC_MONEY = {"sum_days_to_bind", "bound_premium", "bound_fees", "bound_premium_from_cohort", "bound_fees_from_cohort",
             "nb_bound_premium", "renewal_bound_premium", "declined_premium"}
_QS_MEASURES = ["submissions_quoted", "quotes_started", "raw_quote_rows_started", "quotes_started_bound",
                "nb_quotes_started", "nb_quotes_bound", "renewal_quotes_started", "renewal_quotes_bound"]
_PA_MEASURES = ["binds", "binds_from_cohort", "sum_days_to_bind", "cnt_days_to_bind", "bound_premium", "bound_fees",
                "bound_premium_from_cohort", "bound_fees_from_cohort", "nb_binds", "renewal_binds", "nb_bound_premium",
                "renewal_bound_premium"]


def _sc(select: str) -> str:
    return _with(_SC_TABLES, f"{_sc_ctes()}\n{select}")


def _from_scorecard(cols: list[str]) -> str:
    return f"SELECT {', '.join(cols)} FROM ({scorecard()}) x"


def operator_sql() -> dict[str, str]:
    fq = "COALESCE(q.original_producer_id, sb.original_producer_id)"
    doc_cols = ", ".join(f"{_b(v)} AS {k}" for k, v in _DOC_PREDS.items())
    any_doc = " OR ".join(f"({_DOC_PREDS[k]})" for k in ["is_quote_to_agent", "is_bind_request", "is_policy_sent",
                                                         "is_quote_to_agent_prefix", "is_renewal_invoice"])
    mins = ", ".join(f"MIN(CASE WHEN {_DOC_PREDS[p]} THEN created_dt END) AS {n}" for n, p in [
        ("quote_doc_dt", "is_quote_to_agent"), ("bind_req_dt", "is_bind_request"), ("policy_doc_dt", "is_policy_sent"),
        ("agent_quote_doc_dt", "is_quote_to_agent_prefix"), ("renewal_invoice_dt", "is_renewal_invoice")])
    lag = _bd_exclusive("sb.created_dt", "q.quote_dt")
    cal = "(CAST(q.bind_dt AS DATE) - CAST(q.created_dt AS DATE))"
    sq_money = _money("o.sub_total_premium")
    agency_sub = ("(SELECT min(trim(a.agency_{c})) FROM adm_co_agencies a WHERE a.agency_id = "
                  "COALESCE(q.original_producer_id, (SELECT s.original_producer_id FROM bms_submission_mst s "
                  "WHERE s.submission_id = q.submission_id)))")
    counts = " UNION ALL ".join(f"SELECT '{n}' AS table_name, CAST(COUNT(*) AS BIGINT) AS row_count FROM {n}" for n in _ALL)
    return {
        "src_scan": _with(_ALL, counts),
        "param_windows": _with(["bms_submission_mst"], f"""d AS (SELECT DISTINCT CAST(created_dt AS DATE) AS as_of FROM bms_submission_mst)
SELECT as_of, CAST(date_trunc('week', as_of - 14) AS DATE) AS weeks_start, CAST(date_trunc('week', as_of) AS DATE) AS weeks_end,
  CAST(date_trunc('year', as_of) AS DATE) AS ytd_start, as_of + 1 AS ytd_end, CAST(as_of - INTERVAL 3 MONTH AS DATE) AS rolling3_start,
  CAST(date_trunc('month', as_of) - INTERVAL 1 MONTH AS DATE) AS prev_month_start FROM d"""),
        "proj_alias_const": _with(["bms_quote_mst"], f"""x AS (SELECT 1)
SELECT quote_code AS quote_number, {_q(V.KPI1_TRANSACTION_LABEL)} AS transaction_type, policy_number,
  CAST(quote_id * 10 AS BIGINT) AS quote_id_x10 FROM bms_quote_mst"""),
        "flt_soft_delete_lenient": _with(["bms_submission_mst"], f"""x AS (SELECT 1)
SELECT submission_id, CAST(flg_active AS BIGINT) AS flg_active, CAST(purge_status AS BIGINT) AS purge_status
FROM bms_submission_mst WHERE {_LIVE_ROW} AND user_id_accexecutive IS NOT NULL"""),
        "flt_soft_delete_strict": _with(["bms_options_mst"], """x AS (SELECT 1)
SELECT quote_id, product_id, business_id FROM bms_options_mst WHERE flg_active = 1"""),
        "flt_in_like_3vl": _with(["bms_quote_mst", "adm_bm_lkp_transaction_types"], f"""x AS (SELECT 1)
SELECT q.quote_id, tt.lkp_desc, {_b(_tt_forecast('tt.lkp_desc'))} AS in_forecast
FROM bms_quote_mst q LEFT JOIN adm_bm_lkp_transaction_types tt ON tt.lkp_id = q.lkp_transaction_type_id
WHERE {_LIVE.format(a='q')} AND {_tt_heat('tt.lkp_desc')}"""),
        "flt_not_in_null": _with(["bms_submission_mst", "adm_co_agencies"], f"""x AS (SELECT 1)
SELECT sb.submission_id, ag.agency_code FROM bms_submission_mst sb JOIN adm_co_agencies ag ON ag.agency_id = sb.original_producer_id
WHERE ag.agency_code NOT IN {_in(V.RETENTION_EXCLUDED_AGENCY_CODES)}"""),
        "flt_doc_name_like": _with(["dms_document_detail_mst"], f"""x AS (SELECT 1)
SELECT file_id, created_dt, document_name, {doc_cols} FROM dms_document_detail_mst"""),
        "flt_halfopen_window": _with(["bms_quote_mst"], """x AS (SELECT 1)
SELECT quote_id, created_dt FROM bms_quote_mst WHERE created_dt >= DATE '2001-03-15' AND created_dt < DATE '2001-06-16'"""),
        "flt_closed_window": _with(["bms_options_mst"], """x AS (SELECT 1)
SELECT quote_id, product_id, proposed_eff_date FROM bms_options_mst
WHERE proposed_eff_date >= DATE '2001-04-01' AND proposed_eff_date <= DATE '2001-06-30'"""),
        "flt_nonblank": _with(["bms_quote_mst"], """x AS (SELECT 1)
SELECT quote_id, policy_number FROM bms_quote_mst WHERE trim(policy_number) <> ''"""),
        "flt_premium_threshold": _with(["bms_options_mst"], f"""x AS (SELECT 1)
SELECT quote_id, product_id, CAST(COALESCE(sub_total_premium, 0) AS DOUBLE) AS premium FROM bms_options_mst
WHERE COALESCE(sub_total_premium, 0) > {V.PREMIUM_THRESHOLD}"""),
        "fn_parse_money": _with(["bms_options_mst"], f"""x AS (SELECT 1)
SELECT quote_id, product_id, CAST({_money('CAST(sub_total_premium AS VARCHAR)')} AS DOUBLE) AS from_text,
  CAST({_money("'$' || CAST(sub_total_premium AS VARCHAR)")} AS DOUBLE) AS from_dollar_text,
  CAST({_money('effective_dt')} AS DOUBLE) AS from_date_text FROM bms_options_mst"""),
        "join_inner_dims": _with(["bms_quote_mst", "bms_submission_mst", "adm_co_users"], f"""x AS (SELECT 1)
SELECT q.quote_id, sb.submission_code, {_uw_short('uw.first_name', 'uw.last_name')} AS underwriter
FROM bms_quote_mst q JOIN bms_submission_mst sb ON sb.submission_id = q.submission_id
JOIN adm_co_users uw ON uw.user_id = sb.user_id_accexecutive"""),
        "join_left_lookup": _with(["bms_quote_mst", "adm_bm_lkp_transaction_types", "adm_bm_statuses"], """x AS (SELECT 1)
SELECT q.quote_id, tt.lkp_desc, st.status_code FROM bms_quote_mst q
LEFT JOIN adm_bm_lkp_transaction_types tt ON tt.lkp_id = q.lkp_transaction_type_id
LEFT JOIN adm_bm_statuses st ON st.status_id = q.status_id"""),
        "join_left_filter_on": _with(["bms_submission_mst", "adm_co_agencies"], """x AS (SELECT 1)
SELECT sb.submission_id, ag.agency_name FROM bms_submission_mst sb
LEFT JOIN adm_co_agencies ag ON ag.agency_id = sb.original_producer_id AND COALESCE(ag.flg_active, 1) = 1"""),
        "join_left_to_inner": _with(["bms_quote_mst", "adm_bm_lkp_transaction_types"], f"""x AS (SELECT 1)
SELECT q.quote_id, tt.lkp_desc FROM bms_quote_mst q LEFT JOIN adm_bm_lkp_transaction_types tt ON tt.lkp_id = q.lkp_transaction_type_id
WHERE {_LIVE.format(a='q')} AND tt.lkp_desc IN {_in(V.TT_NB_AND_RENEWAL)}"""),
        "join_coalesce_key": _with(["bms_quote_mst", "bms_submission_mst", "adm_co_agencies"], f"""x AS (SELECT 1)
SELECT q.quote_id, {fq} AS agency_id, ag.agency_code FROM bms_quote_mst q
LEFT JOIN bms_submission_mst sb ON sb.submission_id = q.submission_id
LEFT JOIN adm_co_agencies ag ON ag.agency_id = {fq}"""),
        "semi_exists_joined": _with(["bms_options_mst", "bms_locations", "bms_building_mst"], """x AS (SELECT 1)
SELECT o.quote_id, o.product_id, o.business_id FROM bms_options_mst o WHERE EXISTS (
  SELECT 1 FROM bms_locations l JOIN bms_building_mst b ON b.location_id = l.location_id AND b.flg_active = 1
  WHERE l.business_id = o.business_id)"""),
        "apply_min_per_key": _with(["dms_file_mst", "dms_document_detail_mst"], f"""{_DOCS}
SELECT submission_number, {mins} FROM docs WHERE {any_doc} GROUP BY submission_number"""),
        "top1_latest_option": _with(["bms_options_mst"], f"""o AS (
  SELECT quote_id, {_try_date('effective_dt')} AS eff_date, {_money('sub_total_premium')} AS prem,
    CAST(COALESCE(total_fee_taxable, 0) + COALESCE(total_fee_non_taxable, 0) AS DECIMAL(18,2)) AS fees,
    COALESCE(updated_dt, created_dt) AS touched, product_id
  FROM bms_options_mst WHERE COALESCE(flg_active, 1) = 1
  QUALIFY row_number() OVER (PARTITION BY quote_id ORDER BY touched DESC NULLS LAST, prem DESC NULLS LAST,
    product_id DESC NULLS LAST, eff_date DESC NULLS LAST, prem DESC NULLS LAST, fees DESC NULLS LAST) = 1)
SELECT quote_id, eff_date, CAST(prem AS DOUBLE) AS prem, CAST(fees AS DOUBLE) AS fees FROM o"""),
        "top1_per_group_bound_first": _with(["bms_quote_mst", "adm_bm_lkp_transaction_types"], f"""x AS (SELECT 1)
SELECT q.submission_id, q.quote_id, q.quote_code, q.bind_dt FROM bms_quote_mst q
JOIN adm_bm_lkp_transaction_types tt ON tt.lkp_id = q.lkp_transaction_type_id
WHERE {_LIVE.format(a='q')} AND tt.lkp_desc = {_q(V.TT_NEW_BUSINESS)}
QUALIFY row_number() OVER (PARTITION BY q.submission_id ORDER BY CASE WHEN q.bind_dt IS NULL THEN 1 ELSE 0 END, q.quote_id) = 1"""),
        "asof_first_after": _with(["bms_tracers", "bms_quote_mst", "bms_submission_mst", "dms_file_mst",
                                   "dms_document_detail_mst"], f"""{_DOCS},
endt_span AS (SELECT quote_id, MAX(CASE WHEN {_like_any('tracer_desc', V.TRACER_ENDORSEMENT_START)} THEN created_dt END) AS req_dt
        FROM bms_tracers WHERE tracer_desc LIKE {_q(V.TRACER_ENDORSEMENT_ANY)} GROUP BY 1),
a AS (SELECT endt_span.quote_id, sb.submission_code, endt_span.req_dt FROM endt_span JOIN bms_quote_mst q ON q.quote_id = endt_span.quote_id
      JOIN bms_submission_mst sb ON sb.submission_id = q.submission_id)
SELECT a.quote_id, a.submission_code, a.req_dt,
  (SELECT MIN(d.created_dt) FROM docs d WHERE d.submission_number = a.submission_code AND d.created_dt >= a.req_dt
     AND {_like_all('upper(d.document_name)', V.DOC_ENDORSEMENT_SENT_ALL)}) AS sent_dt
FROM a"""),
        "union_min_two_sources": _with(_EMAIL_TABLES, f"""{_email_union("= " + _q(V.EMAIL_QUOTE))}
SELECT business_id, quote_id, MIN(created_dt) AS sent_dt FROM em GROUP BY 1, 2"""),
        "semi_or_two_sources": _with(["bms_options_mst"] + _EMAIL_TABLES, f"""{_email_union("IN " + _in(V.EMAIL_QUOTE_OR_RENEWAL))}
SELECT quote_id, business_id, product_id FROM bms_options_mst SEMI JOIN em USING (business_id, quote_id)"""),
        "scalar_subq_agency": _with(["bms_quote_mst", "bms_submission_mst", "adm_co_agencies"], f"""x AS (SELECT 1)
SELECT q.quote_id, COALESCE({agency_sub.format(c='code')}, '') AS agency_code,
  COALESCE({agency_sub.format(c='name')}, '') AS agency_name FROM bms_quote_mst q"""),
        "join_fanout_kept": _with(["bms_options_mst", "bms_quote_mst", "bms_quote_insured_mst"], """x AS (SELECT 1)
SELECT o.quote_id, o.product_id, ins.insured_name FROM bms_options_mst o JOIN bms_quote_mst q ON q.quote_id = o.quote_id
JOIN bms_quote_insured_mst ins ON ins.quote_id = q.quote_id"""),
        "agg_group_sum_count": _with(["bms_submission_mst"], f"""x AS (SELECT 1)
SELECT original_producer_id AS agency_id, CAST(year(created_dt) AS BIGINT) AS created_year, CAST(COUNT(*) AS BIGINT) AS n_submissions,
  CAST(SUM(CASE WHEN {_LIVE_ROW} THEN 1 ELSE 0 END) AS BIGINT) AS n_live FROM bms_submission_mst GROUP BY 1, 2"""),
        "agg_count_distinct": _with(["bms_quote_mst", "bms_submission_mst"], f"""{_sub_quotes()}
SELECT agency_id, CAST(COUNT(DISTINCT submission_id) AS BIGINT) AS n_submissions, CAST(COUNT(DISTINCT quote_id) AS BIGINT) AS n_quotes
FROM sq GROUP BY 1"""),
        "agg_cond_count_distinct": _with(["bms_quote_mst", "bms_submission_mst"], f"""{_sub_quotes()}
SELECT agency_id, CAST(COUNT(DISTINCT CASE WHEN bind_dt IS NOT NULL THEN quote_id END) AS BIGINT) AS quotes_bound,
  CAST(COUNT(DISTINCT CASE WHEN lkp_transaction_type_id = 0 THEN quote_id END) AS BIGINT) AS quotes_type0,
  CAST(COUNT(DISTINCT CASE WHEN bind_dt IS NOT NULL AND lkp_transaction_type_id = 1 THEN quote_id END) AS BIGINT) AS quotes_bound_type1,
  CAST(COUNT(DISTINCT CASE WHEN bind_dt IS NOT NULL THEN submission_id END) AS BIGINT) AS submissions_bound
FROM sq GROUP BY 1"""),
        "agg_cond_sum": _with(["bms_options_mst", "bms_quote_mst", "bms_submission_mst"], f"""{_sub_quotes()}
SELECT sq.agency_id, CAST(SUM(CASE WHEN sq.bind_dt IS NOT NULL THEN COALESCE({sq_money}, 0) ELSE 0 END) AS DOUBLE) AS bound_premium,
  CAST(SUM(CASE WHEN sq.bind_dt IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS bound_rows
FROM bms_options_mst o JOIN sq ON sq.quote_id = o.quote_id GROUP BY 1"""),
        "agg_pivot_max": _with(["bms_tracers"], f"""x AS (SELECT 1)
SELECT quote_id, MAX(CASE WHEN {_like_any('tracer_desc', V.TRACER_ENDORSEMENT_START)} THEN created_dt END) AS req_dt,
  MAX(CASE WHEN {_like_any('tracer_desc', V.TRACER_ENDORSEMENT_FINALIZED)} THEN created_dt END) AS fin_dt
FROM bms_tracers WHERE tracer_desc LIKE {_q(V.TRACER_ENDORSEMENT_ANY)} GROUP BY 1"""),
        "kpi1_backfill": kpi1(_YEAR_OF_WEEKS, "as_of"),
        "sort_numeric_suffix": _with(["bms_submission_mst", "adm_co_agencies"], f"""x AS (SELECT 1)
SELECT sb.submission_id, ag.agency_code, CAST({_code_number('ag.agency_code')} AS BIGINT) AS code_number,
  {_pos(_code_number('ag.agency_code'), 'ag.agency_code', 'sb.submission_id')}
FROM bms_submission_mst sb JOIN adm_co_agencies ag ON ag.agency_id = sb.original_producer_id"""),
        "union_distinct_spine": _sc("SELECT DISTINCT agency_id FROM touched"),
        "fn_strings": _with(["bms_quote_insured_mst"], """x AS (SELECT 1)
SELECT quote_id, trim(adr_phy_city) AS city_trim, upper(insured_name) AS insured_upper, substr(insured_name, 1, 5) AS insured_left5,
  substr(adr_phy_state_code, 1, 4) AS state_w4 FROM bms_quote_insured_mst"""),
        "fn_person_name": _with(["bms_options_mst", "adm_co_users"], f"""x AS (SELECT 1)
SELECT o.quote_id, o.product_id, {_uw_short('u.first_name', 'u.last_name')} AS name_short, {_name3(False)} AS name_full3,
  {_name3(True)} AS name_full3_trimlast FROM bms_options_mst o JOIN adm_co_users u ON u.user_id = o.user_id_acc_executive"""),
        "fn_format": _with(["bms_options_mst"], f"""x AS (SELECT 1)
SELECT quote_id, product_id, {_us('proposed_eff_date')} AS eff_us, substr(effective_dt, 1, 10) AS eff_text_us,
  substr(CAST(COALESCE(sub_total_premium, 0) AS VARCHAR), 1, 50) AS premium_text,
  substr(CAST(CAST(proposed_eff_date AS DATE) - {AS_OF} AS VARCHAR), 1, 10) AS days_until FROM bms_options_mst"""),
        "fn_dates": _with(["bms_quote_mst"], """x AS (SELECT 1)
SELECT quote_id, CAST(created_dt AS DATE) AS created_day, CAST(created_dt AS DATE) + 3 AS plus3, CAST(created_dt AS DATE) - 14 AS minus14,
  CAST(CAST(created_dt AS DATE) - INTERVAL 3 MONTH AS DATE) AS minus3m, CAST(date_trunc('month', created_dt) AS DATE) AS month_start,
  CAST(CAST(bind_dt AS DATE) - CAST(created_dt AS DATE) AS BIGINT) AS days_to_bind, CAST(year(created_dt) AS BIGINT) AS created_year
FROM bms_quote_mst"""),
        "fn_try_cast": _with(["bms_options_mst"], f"""x AS (SELECT 1)
SELECT quote_id, product_id, {_try_date('effective_dt')} AS eff_date,
  CAST(TRY_CAST(NULLIF(trim(substr(CAST(business_id AS VARCHAR), 1, 50)), '') AS INTEGER) AS BIGINT) AS business_int,
  CAST(TRY_CAST(NULLIF(trim(substr(effective_dt, 1, 50)), '') AS INTEGER) AS BIGINT) AS eff_as_int,
  {', '.join(f'CAST(created_dt AS DATE) AS {n}' for n in DATE_FORM_COLUMNS)} FROM bms_options_mst"""),
        "fn_ratio": _with(["bms_quote_mst", "bms_submission_mst"], f"""{_sub_quotes()},
a AS (SELECT agency_id, COUNT(DISTINCT quote_id) AS quotes, COUNT(DISTINCT CASE WHEN bind_dt IS NOT NULL THEN quote_id END) AS bound
      FROM sq GROUP BY 1)
SELECT agency_id, CAST(quotes AS BIGINT) AS quotes, CAST(bound AS BIGINT) AS bound, {_ratio4('bound', 'quotes')} AS bind_ratio,
  {_ratio4('quotes - bound', 'quotes')} AS open_ratio FROM a"""),
        "fn_business_days_inclusive": _with(["bms_quote_mst", "bms_submission_mst"], f"""x AS (SELECT 1)
SELECT q.quote_id, CAST({_bd_inclusive('q.created_dt', 'q.bind_dt')} AS BIGINT) AS bd_inclusive
FROM bms_quote_mst q JOIN bms_submission_mst sb ON sb.submission_id = q.submission_id WHERE q.bind_dt IS NOT NULL"""),
        "fn_business_days_exclusive": _with(["bms_quote_mst", "bms_submission_mst"], f"""x AS (SELECT 1)
SELECT q.quote_id, CAST({_bd_exclusive('sb.created_dt', 'q.bind_dt')} AS BIGINT) AS bd_exclusive,
  CAST({lag} AS BIGINT) AS bd_exclusive_quote
FROM bms_quote_mst q JOIN bms_submission_mst sb ON sb.submission_id = q.submission_id"""),
        "fn_iso_week_label": _with(["bms_tracers"], """x AS (SELECT 1)
SELECT DISTINCT quote_id, tracer_sub_type_id, created_dt, CAST(year(created_dt) AS BIGINT) AS week_year,
  CAST(weekofyear(created_dt) AS BIGINT) AS week_of_year FROM bms_tracers"""),
        "fn_null": _with(["bms_quote_mst"], """x AS (SELECT 1)
SELECT quote_id, COALESCE(quote_dt, created_dt) AS start_dt, CAST(COALESCE(purge_status, 0) AS BIGINT) AS purge_or_zero,
  NULLIF(trim(policy_number), '') AS policy_or_null, COALESCE(trans_finalize_dt, bind_dt, quote_dt, created_dt) AS latest_known
FROM bms_quote_mst"""),
        "fn_policy_status": _with(["bms_quote_mst"], f"""x AS (SELECT 1)
SELECT quote_id, {_status()} AS policy_status FROM bms_quote_mst"""),
        "fn_sla_band": _with(["bms_quote_mst", "bms_submission_mst"], f"""x AS (SELECT 1)
SELECT q.quote_id, {_band_max(f'({lag})', 3)} AS band_max3, {_band_max(f'({lag})', 5)} AS band_max5,
  CASE WHEN {cal} < 0 THEN 'Data Issue' WHEN {cal} <= 30 THEN 'Green' ELSE 'Red' END AS band_calendar30,
  CASE WHEN {cal} IS NULL THEN NULL WHEN {cal} < 0 THEN 'Data Issue' WHEN {cal} >= 45 THEN 'Green' ELSE 'Red' END AS band_min45
FROM bms_quote_mst q JOIN bms_submission_mst sb ON sb.submission_id = q.submission_id"""),
        "fn_follow_up": _with(["bms_email_confirmation_details"], f"""x AS (SELECT 1)
SELECT DISTINCT quote_id, business_id, created_dt, {_us('created_dt')} AS sent_us, {_us('CAST(created_dt AS DATE) + 3')} AS first_follow_up,
  {_us('CAST(created_dt AS DATE) + 25')} AS second_follow_up, {_us('CAST(created_dt AS DATE) + 30')} AS qcl_due
FROM bms_email_confirmation_details"""),
        "sc_submission_universe": _sc("SELECT submission_id, agency_id FROM touched"),
        "sc_submissions_created": _sc("SELECT agency_id, CAST(submissions_created AS BIGINT) AS submissions_created FROM intake WHERE submissions_created > 0"),
        "sc_submissions_activity": _sc("SELECT agency_id, CAST(submissions_activity AS BIGINT) AS submissions_activity FROM intake"),
        "sc_quote_start": _sc(f"SELECT agency_id, {_sc_select('measures', _QS_MEASURES, _SC_MONEY)} FROM measures"),
        "sc_production": _sc(f"SELECT agency_id, {_sc_select('measures', _PA_MEASURES, _SC_MONEY)} FROM measures"),
        "sc_decline": _sc("SELECT agency_id, CAST(declines AS BIGINT) AS declines, CAST(declined_premium AS DOUBLE) AS declined_premium FROM lost"),
        "sc_agency_metrics": _sc(f"SELECT agency_code, agency_name, {_sc_select('metrics', _SC_MEASURES, _SC_MONEY)} FROM metrics"),
        "sc_rollup": _sc("""SELECT agency_code, agency_name, CAST(submissions_created AS BIGINT) AS submissions_created,
  CAST(binds AS BIGINT) AS binds FROM reported"""),
        "sc_final": _sc(f"SELECT agency_code, agency_name, {_sc_select('final_agg', _SC_MEASURES, _SC_MONEY)} FROM final_agg"),
        "sc_ratios": _from_scorecard(["agency_code", "agency_name", "sub_to_quote_pct_vs_intake", "sub_to_quote_pct_vs_activity",
                                      "quote_to_bind_pct", "decline_rate_pct", "carryover_pct", "dollar_hit_ratio_pct",
                                      "avg_bound_premium_per_bind"]),
        "sc_scores": _from_scorecard(["agency_code", "agency_name", "mvs_overall", "mvs_momentum", "ops_efficiency_score",
                                      "pipeline_health_score"]),
        "sc_problem_type": _from_scorecard(["agency_code", "agency_name", "problem_type_label", "problem_type_explanation",
                                            "primary_recommended_action"]),
        "asof_first_after_events": """SELECT s.event_id, s.user_id, strftime(s.ts, '%Y-%m-%d %H:%M:%S.%f') AS signup_ts,
  strftime((SELECT MIN(b.ts) FROM events b WHERE b.event_type = 'purchase' AND b.user_id = s.user_id AND b.ts >= s.ts),
           '%Y-%m-%d %H:%M:%S.%f') AS first_purchase_ts
FROM events s WHERE s.event_type = 'signup'""",
    }


def all_sql() -> dict[str, str]:
    out = {k: f() for k, f in REPORT_SQL.items()}
    out.update(operator_sql())
    return out
