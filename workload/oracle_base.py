"""Common table expressions that rebuild the panel in plain SQL.

Written independently of the Spark operators. ``e0`` literals are doubles; a
plain ``100.0`` would be a decimal.
"""

from __future__ import annotations


def half_up(x: str, decimals: int) -> str:
    scale = f"1e{decimals}"
    return f"(CASE WHEN abs(({x}) * {scale}) < 4503599627370496e0 THEN floor(({x}) * {scale} + 0.5e0) / {scale} ELSE {x} END)"


def steady(x: str) -> str:
    """Round an order-dependent double: four decimals when large, nine otherwise."""
    return f"CASE WHEN abs({x}) >= 1e3 THEN {half_up(x, 4)} ELSE {half_up(x, 9)} END"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0e0))"


def month_end(q: str, months: int) -> str:
    """Last day of the month ``months`` after the last month of quarter ``q``."""
    return (
        f"last_day(CAST(make_date(CAST(1970 + {q} // 4 AS BIGINT), CAST({q} % 4 * 3 + 3 AS BIGINT), 1)"
        f" + INTERVAL {months} MONTH AS DATE))"
    )


def label(q: str) -> str:
    return f"((1970 + {q} // 4)::VARCHAR || 'Q' || ({q} % 4 + 1)::VARCHAR)"


def ordinal(key: str) -> str:
    """Ordinal of a valid trimmed key, NULL otherwise."""
    k = f"trim({key})"
    return (
        f"CASE WHEN regexp_full_match({k}, '\\d{{4}}Q[1-4]') THEN (CAST(substr({k}, 1, 4) AS BIGINT) - 1970) * 4"
        f" + CAST(substr({k}, 6, 1) AS BIGINT) - 1 END"
    )


SYMBOL = "CASE {k} WHEN 0 THEN 'SPY' WHEN 1 THEN 'QQQ' WHEN 2 THEN 'NA' WHEN 3 THEN 'NULL' ELSE {k}::VARCHAR END"

ENTITIES = {
    "part": ("l_partkey", "SELECT p_partkey AS k, p_name AS company, CASE WHEN p_partkey % 47 <> 0 THEN p_brand END AS sector, p_type AS industry FROM part"),
    "supplier": (
        "l_suppkey",
        "SELECT s_suppkey AS k, s_name AS company, CASE WHEN s_suppkey % 47 <> 0 THEN 'N' || s_nationkey::VARCHAR END AS sector,"
        " 'G' || (s_nationkey % 5)::VARCHAR AS industry FROM supplier",
    ),
}


def statements(entity: str = "part") -> str:
    key, about = ENTITIES[entity]
    sign = "CASE WHEN returned THEN -1 ELSE 1 END"
    return f"""
lines AS (
  SELECT {key} AS k, CAST(l_shipdate AS DATE) AS day, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
         CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax,
         CAST(l_quantity AS BIGINT) AS qty, l_linenumber AS line, l_returnflag = 'R' AS returned, l_linestatus = 'F' AS filled
  FROM lineitem),
aligned AS (
  SELECT *, (year(day - INTERVAL 2 MONTH) - 1970) * 4 + quarter(day - INTERVAL 2 MONTH) - 1 AS q_ord FROM lines),
amounts AS (
  SELECT k, q_ord, max(day) AS last_day, min(line) AS least_line,
    CAST(sum(price) AS BIGINT) AS gross, CAST(sum(qty) AS BIGINT) AS units,
    CAST(sum(CASE WHEN returned THEN -(price // 2) ELSE price END) AS BIGINT) AS ebit_c,
    CAST(sum({sign} * ((price * (100 - disc)) // 100)) AS BIGINT) AS pretax_c,
    CAST(sum({sign} * ((price * tax) // 100)) AS BIGINT) AS tax_c,
    CAST(sum((price * disc * CASE WHEN k % 11 = 0 THEN 25 ELSE 4 END) // 100) AS BIGINT) AS tcl_c,
    CAST(sum(CASE WHEN filled OR NOT returned THEN price // 4 END) AS BIGINT) AS gw_c,
    CAST(sum((price * tax) // 50) AS BIGINT) AS std_c, CAST(sum((price * disc) // 50) AS BIGINT) AS ltd_c,
    CAST(sum(price // 10) AS BIGINT) AS cash_c, CAST(sum(CASE WHEN filled THEN price // 20 END) AS BIGINT) AS sti_c,
    CAST(sum((price * tax) // 20) AS BIGINT) AS capx_c,
    CAST(sum(CASE WHEN returned THEN -(price // 3) ELSE price // 5 END) AS BIGINT) AS ocf_c
  FROM aligned GROUP BY k, q_ord),
about AS ({about}),
statements AS (
  SELECT a.k, {label('q_ord')} || '_' || {SYMBOL.format(k='a.k')} AS "KEY", {SYMBOL.format(k='a.k')} AS symbol,
    company, sector, industry, {label('q_ord')} AS period_key, q_ord,
    CASE WHEN a.k >= 2 THEN 1970 + q_ord // 4 END AS period_year,
    CASE WHEN a.k >= 2 THEN 'Q' || (q_ord % 4 + 1)::VARCHAR END AS period_quarter,
    CASE WHEN a.k < 2 THEN {month_end('q_ord', 2)} ELSE last_day END AS fiscal_period_end_date,
    CASE WHEN (a.k + q_ord) % 19 <> 0 THEN
      (CASE WHEN a.k < 2 THEN {month_end('q_ord', 2)} ELSE last_day END)
      + CAST(20 + (a.k * 7 + q_ord) % 60 + CASE WHEN (a.k + q_ord) % 5 = 0 THEN 365 WHEN (a.k + q_ord) % 97 = 0 THEN -400 ELSE 0 END AS INTEGER)
    END AS filing_date,
    CASE WHEN a.k >= 2 THEN DATE '2001-12-01' END AS run_date,
    ebit_c / 1e2 AS ebit, pretax_c / 1e2 AS pretax_income, -tax_c / 1e2 AS tax_provision,
    -(gross // 100) / 1e2 AS interest_expense,
    CASE WHEN least_line < 7 THEN gross / 1e2 END AS total_current_assets, tcl_c / 1e2 AS total_current_liabilities,
    CASE WHEN units % 17 <> 0 THEN units * 1000 / 1e2 END AS net_ppe, gw_c / 1e2 AS goodwill,
    std_c / 1e2 AS short_term_debt_and_capital_lease, ltd_c / 1e2 AS long_term_debt_and_capital_lease,
    cash_c / 1e2 AS cash_and_cash_equivalents, sti_c / 1e2 AS short_term_investments,
    CASE WHEN (a.k + q_ord) % 43 <> 0 THEN
      CASE WHEN (a.k + q_ord) % 37 = 0 THEN 0e0 ELSE (gross * 2 - tcl_c * 3) / 1e2 END END AS total_stockholders_equity,
    gross * 3 / 1e2 AS total_assets, (gross + tcl_c * 3) / 1e2 AS total_liabilities, (gross * 2 - tcl_c * 3) / 1e2 AS equity,
    CASE WHEN (a.k + q_ord) % 41 <> 0 THEN
      CASE WHEN (a.k + q_ord) % 23 = 0 THEN 0e0 ELSE (gross // units) * 1000 / 1e2 END END AS market_cap,
    CASE WHEN (a.k + q_ord) % 31 <> 0 THEN
      CASE WHEN (a.k + q_ord) % 29 = 0 THEN 0e0 ELSE (gross // units) / 1e2 END END AS price,
    CASE WHEN (a.k + q_ord) % 13 <> 0 THEN CASE WHEN (a.k + q_ord) % 7 = 0 THEN 0e0 ELSE 0.5e0 END END AS de_reported,
    capx_c, ocf_c, (ocf_c - capx_c) / 1e2 AS free_cash_flow
  FROM amounts a LEFT JOIN about ON a.k = about.k)"""


W = "OVER (PARTITION BY symbol ORDER BY q_ord)"


def chain(entity: str = "part") -> str:
    """Links, capital, profit, returns on capital and their split, unrounded."""
    return f"""{statements(entity)},
linked AS (
  SELECT *, q_ord - lag(q_ord) {W} AS prev_key_gap,
    date_diff('day', lag(fiscal_period_end_date) {W}, fiscal_period_end_date) AS prev_day_gap
  FROM statements),
capital AS (
  SELECT *, coalesce(prev_key_gap = 1 AND prev_day_gap BETWEEN 60 AND 130, false) AS link,
    -tax_provision AS tax_expense, {div('-tax_provision', 'pretax_income')} AS tax_rate,
    total_current_assets - total_current_liabilities + net_ppe + goodwill AS ic_raw,
    short_term_debt_and_capital_lease + long_term_debt_and_capital_lease AS debt
  FROM linked),
profit AS (
  SELECT *, ebit * (1 - tax_rate) AS nopat,
    CASE WHEN prev_key_gap = 1 THEN (lag(ic_raw) {W} + ic_raw) / 2e0 END AS avg_ic,
    {div('debt', 'total_stockholders_equity')} AS de_file,
    market_cap + debt - cash_and_cash_equivalents - short_term_investments AS entv
  FROM capital),
returns_on AS (SELECT *, {div('ebit', 'avg_ic')} AS pre, {div('nopat', 'avg_ic')} AS post FROM profit),
annual AS (
  SELECT *, CASE WHEN post > -1 THEN ((1 + post) * (1 + post)) * ((1 + post) * (1 + post)) - 1 END AS post_annual,
    CASE WHEN pre > -1 THEN ((1 + pre) * (1 + pre)) * ((1 + pre) * (1 + pre)) - 1 END AS pre_annual,
    lag(ebit) {W} AS e0, ebit AS e1, 1 - lag(tax_rate) {W} AS q0, 1 - tax_rate AS q1,
    1e0 / nullif(lag(avg_ic) {W}, 0e0) AS v0, 1e0 / nullif(avg_ic, 0e0) AS v1,
    lag(avg_ic) {W} AS i0, lag(post) {W} AS post0, lag(nopat) {W} AS nopat0, lag(tax_rate) {W} AS t0
  FROM returns_on),
split AS (
  SELECT *, CASE WHEN NOT link THEN 'UNCLASSIFIED_NONCONSECUTIVE'
      WHEN post IS NULL OR post0 IS NULL THEN 'UNCLASSIFIED_MISSING_INPUT' ELSE 'VALID' END AS status,
    (e1 - e0) * ((q0 * v0 + q1 * v1) / 3 + (q1 * v0 + q0 * v1) / 6) AS s_e,
    (q1 - q0) * ((e0 * v0 + e1 * v1) / 3 + (e1 * v0 + e0 * v1) / 6) AS s_q,
    (v1 - v0) * ((e0 * q0 + e1 * q1) / 3 + (e1 * q0 + e0 * q1) / 6) AS s_i
  FROM annual),
drivers AS (
  SELECT *, CASE WHEN status = 'VALID' THEN post - post0 END AS change,
    CASE WHEN status = 'VALID' THEN s_e END AS c_e, CASE WHEN status = 'VALID' THEN s_q END AS c_q,
    CASE WHEN status = 'VALID' THEN s_i END AS c_i,
    CASE WHEN status <> 'VALID' THEN NULL WHEN avg_ic <= 0 OR i0 <= 0 THEN 'NEGATIVE_IC_MECHANICAL_ONLY'
      WHEN NOT coalesce(tax_rate BETWEEN 0 AND 1, true) THEN 'TAX_RATE_OUT_OF_RANGE' ELSE 'VALID' END AS quality
  FROM split),
priced AS (
  SELECT *, change - (c_e + c_q + c_i) AS residual, CASE WHEN status = 'VALID' THEN quality = 'VALID' END AS econ,
    abs(c_e) + abs(c_q) + abs(c_i) AS magnitude,
    CASE WHEN lead(q_ord) {W} IS NULL THEN 0e0
      WHEN price > 0 AND lead(price) {W} > 0 THEN {half_up(f'lead(price) {W} / price - 1', 9)} END AS fr,
    lead(q_ord) {W} IS NULL AS is_last
  FROM drivers),
full_panel AS (
  SELECT *, coalesce({half_up(f'(1 + lag(fr) {W}) * (1 + lag(fr, 2) {W}) * (1 + lag(fr, 3) {W}) - 1', 9)}, 0e0) AS mom
  FROM priced)"""


def stored(entity: str = "part") -> str:
    """The panel as stored: measures rounded, plus the sequence columns."""
    rounded = {
        "tax_rate": 2, "nopat": 2, "avg_ic": 2, "pre": 2, "post": 2, "de_file": 2,
        "change": 6, "c_e": 6, "c_q": 6, "c_i": 6, "residual": 6, "post_annual": 6,
    }
    replaced = ", ".join(f"{half_up(c, d)} AS {c}" for c, d in rounded.items())
    return f"""{chain(entity)},
stored AS (SELECT * REPLACE ({replaced}) FROM full_panel)"""


RANGES = f"""
ranges AS (
  SELECT r.range_id, r.ticker, {label('r.s')} AS start_quarter, coalesce({label('r.e')}, '') AS end_quarter,
    r.s AS start_ord, r.e AS end_ord, r.e IS NULL AS open_end
  FROM (
    SELECT p_partkey * 4 AS range_id, {SYMBOL.format(k='p_partkey')} AS ticker, 100 + p_partkey % 12 AS s,
      CASE p_partkey % 10 WHEN 0 THEN 112 + p_partkey % 12 WHEN 1 THEN 100 + p_partkey % 12 WHEN 2 THEN 108 + p_partkey % 12 END AS e
    FROM part WHERE p_partkey % 10 <> 3
    UNION ALL
    SELECT p_partkey * 4 + 1, {SYMBOL.format(k='p_partkey')}, 114 + p_partkey % 12, NULL FROM part WHERE p_partkey % 10 = 0
    UNION ALL
    SELECT p_partkey * 4 + 2, 'X' || p_partkey::VARCHAR, 100 + p_partkey % 12,
      CASE WHEN p_partkey % 50 = 8 THEN 106 + p_partkey % 12 END
    FROM part WHERE p_partkey % 50 IN (7, 8)) r)"""


def _window(column: str, rows: int) -> list[str]:
    """Names of the lag columns, oldest first."""
    return [f"{column}_{k}" if k else column for k in range(rows - 1, -1, -1)]


def _slope(column: str) -> str:
    a, b, c, d = _window(column, 4)
    return f"(-0.3e0 * {a} + -0.1e0 * {b} + 0.1e0 * {c} + 0.3e0 * {d})"


def _sum(column: str) -> str:
    return "(" + " + ".join(_window(column, 4)) + ")"


def prepared(entity: str = "part", inclusive_end: bool = False, open_member: bool = True) -> str:
    """The prepared panel with short measure names."""
    inside = "q_ord <= r.end_ord" if inclusive_end else "q_ord < r.end_ord"
    until = f"(r.end_ord IS NULL OR {inside})" if open_member else f"(r.end_ord IS NOT NULL AND {inside})"
    lags = ", ".join(
        f"lag({c}, {k}) {W} AS {c}_{k}"
        for c, depth in (
            ("link", 3), ("roic_posttax_q", 4), ("avg_ic", 4), ("c_e", 3), ("c_q", 3), ("c_i", 3),
            ("is_valid", 3), ("is_econ", 3), ("is_pos", 3),
        )
        for k in range(1, depth + 1)
    )
    ok4 = "link AND coalesce(link_1, false) AND coalesce(link_2, false)"
    ok5 = f"{ok4} AND coalesce(link_3, false)"
    trends = {"roic": "roic_posttax_q", "ebit_contribution": "c_e", "tax_contribution": "c_q", "ic_contribution": "c_i"}
    cells = [f"CASE WHEN {ok4} THEN {_slope(c)} END AS {n}_trend_4q" for n, c in trends.items()]
    for stem, c in list(trends.items())[1:]:
        cells.append(f"CASE WHEN {ok4} THEN {_sum(c)} END AS {stem}_sum_4q")
        cells.append(f"CASE WHEN {ok4} THEN {_sum(c)} END / 4e0 AS {stem}_mean_4q")
    mean = f"({_sum('avg_ic')} / 4e0)"
    cells += [
        f"CASE WHEN {ok5} THEN roic_posttax_q - roic_posttax_q_4 END AS roic_change_4q",
        f"CASE WHEN {ok5} THEN avg_ic - avg_ic_4 END AS avg_ic_change_4q",
        f"CASE WHEN {ok5} AND avg_ic_4 > 0 THEN avg_ic / avg_ic_4 - 1 END AS avg_ic_pct_change_4q",
        f"CASE WHEN {ok4} AND {mean} > 0 THEN {_slope('avg_ic')} / {mean} END AS avg_ic_trend_4q_rel",
    ]
    for name, c in (("n_decomp_valid", "is_valid"), ("n_econ_valid", "is_econ"), ("n_positive_avg_ic", "is_pos")):
        hits = " + ".join(f"coalesce({x}, 0)" for x in _window(c, 4))
        cells.append(f"CASE WHEN {ok4} THEN {hits} END AS {name}_4q")
    return f"""{stored(entity)},{RANGES},
as_of AS (SELECT max(run_date) AS d FROM stored),
matched AS (
  SELECT s.*, r.range_id AS relevance_range_id, r.range_id IS NOT NULL AS in_index,
    EXISTS (SELECT 1 FROM ranges x WHERE x.ticker = s.symbol) AS ticker_in_relevance_file
  FROM stored s LEFT JOIN ranges r ON s.symbol = r.ticker AND q_ord >= r.start_ord AND {until}),
timed AS (
  SELECT *, {month_end('q_ord', 2)} AS formation_date, {month_end('q_ord', 5)} AS return_window_end FROM matched),
cleaned AS (
  SELECT *, date_diff('day', fiscal_period_end_date, formation_date) AS signal_lag_days,
    (year(formation_date) * 12 + month(formation_date)) - (year(fiscal_period_end_date) * 12 + month(fiscal_period_end_date)) AS signal_lag_months,
    return_window_end > (SELECT d FROM as_of) AS unrealized,
    CASE WHEN return_window_end <= (SELECT d FROM as_of) THEN fr END AS fwd_return,
    nullif(mom, 0e0) AS momentum_3q_clean, nullif(market_cap, 0e0) AS market_cap_clean, nullif(price, 0e0) AS price_clean,
    CASE WHEN pre IS NOT NULL THEN {div('ebit', 'avg_ic')} END AS roic_pretax_q,
    CASE WHEN post IS NOT NULL THEN {div('nopat', 'avg_ic')} END AS roic_posttax_q,
    {div('debt', 'total_stockholders_equity')} AS debt_to_equity_q,
    CASE WHEN status = 'VALID' THEN 1 ELSE 0 END AS is_valid, CASE WHEN econ THEN 1 ELSE 0 END AS is_econ,
    CASE WHEN avg_ic > 0 THEN 1 WHEN avg_ic IS NOT NULL THEN 0 END AS is_pos
  FROM timed),
wide AS (SELECT *, signal_lag_months < 2 AS below_min, {lags} FROM cleaned),
trended AS (SELECT *, {ok4} AS window_ok_4q, {ok5} AS window_ok_5q, {', '.join(cells)} FROM wide),
layered AS (
  SELECT *, symbol IN ('SPY', 'QQQ') AS is_benchmark, symbol NOT IN ('SPY', 'QQQ') AND in_index AS pop,
    coalesce(n_econ_valid_4q = 4, false) AS all_econ_valid_4q,
    roic_pretax_q IS NOT NULL AS has_pre, roic_posttax_q IS NOT NULL AS has_post, roic_trend_4q IS NOT NULL AS has_trend,
    ebit_contribution_trend_4q IS NOT NULL AND tax_contribution_trend_4q IS NOT NULL AND ic_contribution_trend_4q IS NOT NULL AS has_contrib
  FROM trended),
p AS (
  SELECT *, has_pre AND has_post AND has_trend AS has_all, pop AND fwd_return IS NOT NULL AS ev FROM layered)"""
