"""SQL counterpart of every registered query that SQL can express (DuckDB dialect)."""

from __future__ import annotations

import re

from quarterglass.operators.funnel import FLOW_STEPS, MISSING_REASONS
from quarterglass.operators.fundamentals import combo_names
from workload.oracle_base import (
    RANGES,
    W,
    chain,
    div,
    half_up,
    label,
    month_end,
    ordinal,
    prepared,
    statements,
    steady,
    stored,
)

ORACLE: dict[str, str] = {}


def put(name: str, ctes: str, select: str) -> None:
    ORACLE[name] = f"WITH {ctes.strip()}\n{select.strip()}" if ctes else select.strip()


STATEMENTS, STORED, PREPARED = statements(), stored(), prepared()
SUPPLIER_FULL, SUPPLIER_PREPARED = chain("supplier"), prepared("supplier")

# Long column names of the panel beside the short ones used here.
LONG = {
    "price": "valuations__per_share_data__month_end_stock_price",
    "de_reported": "valuations__ratios__debt_to_equity",
    "tax_expense": "calc_tax_expense_quarterly",
    "tax_rate": "calc_raw_tax_rate_quarterly",
    "nopat": "calc_nopat_quarterly",
    "ic_raw": "calc_ic_raw",
    "avg_ic": "calc_average_ic_raw_quarterly",
    "pre": "calc_roic_pretax_quarterly_ic_raw",
    "post": "calc_roic_posttax_quarterly_ic_raw",
    "post_annual": "calc_roic_posttax_annualized_ic_raw",
    "pre_annual": "calc_roic_pretax_annualized_ic_raw",
    "change": "calc_roic_posttax_change_quarterly",
    "c_e": "calc_roic_ebit_contribution",
    "c_q": "calc_roic_tax_contribution",
    "c_i": "calc_roic_ic_contribution",
    "residual": "calc_roic_decomposition_residual",
    "status": "calc_roic_decomposition_status",
    "quality": "calc_roic_quality_flag",
    "econ": "calc_roic_economic_interpretation_valid",
    "debt": "calc_debt_value_quarterly",
    "de_file": "calc_debt_to_equity_quarterly",
    "fr": "Future_Quarterly_Return",
    "mom": "Momentum_3Q",
    "link": "is_consecutive_prev",
    "below_min": "signal_lag_below_min",
    "pop": "in_population",
    "unrealized": "fwd_return_window_unrealized",
    "ev": "in_evaluation_sample",
    "has_pre": "has_roic_pretax_level",
    "has_post": "has_roic_posttax_level",
    "has_trend": "has_roic_trend",
    "has_contrib": "has_all_contribution_trends",
    "has_all": "has_level_and_trend_signals",
}


def named(*columns: str) -> str:
    return ", ".join(f'{c} AS "{LONG[c]}"' if c in LONG else f'"{c}"' for c in columns)


# Names of the features, in report order.
FEATURES = [
    "roic_pretax_q",
    "roic_posttax_q",
    "debt_to_equity_q",
    "roic_trend_4q",
    "ebit_contribution_trend_4q",
    "tax_contribution_trend_4q",
    "ic_contribution_trend_4q",
    "ebit_contribution_sum_4q",
    "ebit_contribution_mean_4q",
    "tax_contribution_sum_4q",
    "tax_contribution_mean_4q",
    "ic_contribution_sum_4q",
    "ic_contribution_mean_4q",
    "roic_change_4q",
    "avg_ic_change_4q",
    "avg_ic_pct_change_4q",
    "avg_ic_trend_4q_rel",
    "n_decomp_valid_4q",
    "n_econ_valid_4q",
    "n_positive_avg_ic_4q",
]

# Columns of the panel file in their order; the last ones are copies.
TEXT_COLUMNS = [
    "KEY", "symbol", "period_key", "fiscal_period_end_date", "filing_date", "run_date", LONG["econ"], "company", "sector", "industry", "period_year",
    "period_quarter", "ebit", "pretax_income", "tax_provision", "interest_expense", "total_current_assets", "total_current_liabilities", "net_ppe", "goodwill",
    "short_term_debt_and_capital_lease", "long_term_debt_and_capital_lease", "cash_and_cash_equivalents", "short_term_investments",
    "total_stockholders_equity", "total_assets", "total_liabilities", "equity", "market_cap", LONG["price"], LONG["de_reported"], "free_cash_flow",
    "capx_quarter", "ocf_quarter", *[LONG[n] for n in ("tax_expense", "tax_rate", "ic_raw", "debt", "nopat", "avg_ic", "de_file")],
    "calc_enterprise_value_quarterly", *[LONG[n] for n in ("pre", "post", "pre_annual", "post_annual", "status", "change", "c_e", "c_q", "c_i", "quality", "residual")],
    "calc_roic_total_absolute_contribution", "calc_roic_offset_ratio", "calc_roic_ebit_absolute_share", "calc_roic_tax_absolute_share",
    "calc_roic_ic_absolute_share", "calc_roic_dominant_driver", LONG["fr"], LONG["mom"], "market_cap.1", "goodwill.1",
]

# --- load and conversions ---------------------------------------------------

put("scan_typed", "", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n_read, count({c}) AS n_exact, min({c}) AS lowest, max({c}) AS highest FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
))

TEXT = f"""{STORED},
t AS (
  SELECT *, length(symbol) + q_ord AS m FROM stored),
txt AS (
  SELECT *, CASE WHEN symbol IN ('SPY', 'QQQ') THEN strftime(fiscal_period_end_date, '%d/%m/%Y')
      WHEN m % 11 = 0 THEN strftime(fiscal_period_end_date, '%Y/%m/%d') WHEN m % 13 = 0 THEN '  '
      ELSE strftime(fiscal_period_end_date, '%Y-%m-%d') END AS fiscal_text,
    CASE WHEN econ AND m % 2 = 0 THEN 'True' WHEN econ THEN 'TRUE' WHEN NOT econ AND m % 3 = 0 THEN 'no' WHEN NOT econ THEN 'False' END AS econ_text,
    CASE WHEN m % 17 = 0 THEN lower(period_key) ELSE ' ' || period_key END AS key_text
  FROM t),
typed AS (
  SELECT *, CASE WHEN fiscal_text LIKE '____-__-__' OR fiscal_text LIKE '__/__/____' THEN fiscal_period_end_date END AS fiscal_day,
    {ordinal('key_text')} AS q_new, CASE WHEN econ_text IN ('True', 'TRUE') THEN true WHEN econ_text = 'False' THEN false END AS econ_new
  FROM txt)"""
put("panel_load_report", TEXT, f"""
SELECT count(*) AS n_rows, {len(TEXT_COLUMNS)} AS n_columns_in_file, count(*) FILTER (upper(symbol) IN ('NA', 'NULL')) AS na_like_tickers,
  0 AS symbols_empty, 0 AS period_key_missing, count(*) FILTER (q_new IS NULL) AS period_key_invalid,
  count(*) FILTER (econ_text = 'no') AS calc_roic_economic_interpretation_valid_unmapped FROM typed""")
put("na_like_tickers", TEXT, "SELECT symbol, count(*) AS rows FROM typed WHERE symbol IN ('NA', 'NULL') GROUP BY symbol")
put("parse_dates", TEXT, """
SELECT "KEY", fiscal_day AS day, CASE WHEN fiscal_text LIKE '____-__-__' THEN 'yyyy-MM-dd' WHEN fiscal_text LIKE '__/__/____' THEN 'dd/MM/yyyy' END AS fmt
FROM typed""")
put("parse_dates_report", TEXT, """
SELECT 'fiscal_period_end_date' AS "column", count(*) AS n_rows, count(*) FILTER (trim(fiscal_text) = '') AS n_missing_or_empty,
  count(*) FILTER (fiscal_text LIKE '____-__-__') AS format_1, count(*) FILTER (fiscal_text LIKE '__/__/____') AS format_2,
  count(*) FILTER (fiscal_text LIKE '____/__/__') AS n_unparsable,
  (SELECT string_agg(x, '; ' ORDER BY x) FROM (SELECT DISTINCT fiscal_text AS x FROM typed WHERE fiscal_text LIKE '____/__/__' ORDER BY x LIMIT 10)) AS unparsable_examples
FROM typed
UNION ALL SELECT 'filing_date', count(*), count(*) FILTER (filing_date IS NULL), count(filing_date), 0, 0, '' FROM typed
UNION ALL SELECT 'run_date', count(*), count(*) FILTER (run_date IS NULL), count(run_date), 0, 0, '' FROM typed""")
put("parse_period_key", TEXT, 'SELECT "KEY", CASE WHEN q_new IS NOT NULL THEN trim(key_text) END AS valid_key, q_new AS q_ord FROM typed')
ORDER_Q = "(year(o_orderdate) - 1970) * 4 + quarter(o_orderdate) - 1"
put("quarter_ordinal", "", f"SELECT o_orderkey, {ORDER_Q} AS q_ord FROM orders")
put("ordinal_label", "", f"""
SELECT o_orderkey, (1970 + CAST(floor((q - 140) / 4) AS BIGINT))::VARCHAR || 'Q' || (((q - 140) % 4 + 4) % 4 + 1)::VARCHAR AS label
FROM (SELECT o_orderkey, {ORDER_Q} AS q FROM orders)""")
put("parse_boolean", TEXT, "SELECT econ_text AS t, econ_new AS value, count(*) AS n FROM typed GROUP BY ALL")
put("duplicate_columns", TEXT, """
SELECT 'market_cap.1' AS duplicate_column, 'market_cap' AS base_column, true AS identical
UNION ALL SELECT 'goodwill.1', 'goodwill', count(*) FILTER (m % 5 = 0 AND goodwill IS NOT NULL) = 0 FROM typed""")
put("ranges_load", RANGES, "SELECT * FROM ranges")
put("ranges_loaded_counts", RANGES, """
SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_unique_tickers, count(*) FILTER (ticker = '') AS n_empty_ticker,
  count(*) FILTER (start_ord IS NULL) AS n_invalid_start, count(*) FILTER (open_end) AS n_open_end,
  count(*) FILTER (NOT open_end AND end_ord IS NULL) AS n_invalid_end FROM ranges""")

# --- sequence, levels, trends -----------------------------------------------

put("sequence_info", chain(), f"SELECT {named('KEY', 'prev_key_gap', 'prev_day_gap', 'link')} FROM capital")
put("window_ok", SUPPLIER_PREPARED, 'SELECT "KEY", window_ok_4q, window_ok_5q FROM p')
put("ratio_levels", PREPARED, 'SELECT "KEY", roic_pretax_q, roic_posttax_q, debt_to_equity_q FROM p')
put("level_report", STORED, " UNION ALL ".join(
    f"""SELECT '{n}' AS level, count(*) FILTER (x IS NOT NULL AND f IS NULL) AS set_null_where_file_null,
      count(*) FILTER (x IS NULL AND f IS NOT NULL) AS null_where_file_has_value,
      max(abs(CASE WHEN f IS NOT NULL THEN x END - f)) AS max_abs_dev_vs_rounded_file
    FROM (SELECT {div(a, 'avg_ic')} AS x, {f} AS f FROM stored)"""
    for n, a, f in (("roic_pretax_q", "ebit", "pre"), ("roic_posttax_q", "nopat", "post"))
))
put("rolling_slope", SUPPLIER_PREPARED,
    'SELECT "KEY", symbol, period_key, roic_posttax_q, roic_trend_4q FROM p WHERE roic_trend_4q IS NOT NULL')
put("rolling_sum_mean", SUPPLIER_PREPARED, 'SELECT "KEY", ' + ", ".join(f for f in FEATURES if "_sum_" in f or "_mean_" in f) + " FROM p")
put("window_changes", SUPPLIER_PREPARED, 'SELECT "KEY", roic_change_4q, avg_ic_change_4q, avg_ic_pct_change_4q FROM p')
put("relative_trend", SUPPLIER_PREPARED, 'SELECT "KEY", avg_ic_trend_4q_rel FROM p')
put("window_counts", SUPPLIER_PREPARED,
    'SELECT "KEY", n_decomp_valid_4q, n_econ_valid_4q, n_positive_avg_ic_4q, all_econ_valid_4q FROM p')
put("trend_features", PREPARED, f'SELECT "KEY", {", ".join(FEATURES)}, all_econ_valid_4q, window_ok_4q, window_ok_5q FROM p')
put("first_rows_per_entity", STATEMENTS, f"""
SELECT "KEY", symbol, q_ord FROM statements QUALIFY row_number() {W} <= 3""")
put("shapley_3factor", SUPPLIER_FULL, f"SELECT {named('KEY', 'status', 'change', 'c_e', 'c_q', 'c_i', 'residual')} FROM full_panel")

# --- membership ---------------------------------------------------------------

put("membership", PREPARED, 'SELECT "KEY", in_index, relevance_range_id, ticker_in_relevance_file FROM matched')
put("membership_toggles", f"{STATEMENTS},{RANGES}", " UNION ALL ".join(
    f"""SELECT {str(inc).lower()} AS end_inclusive, {str(op).lower()} AS open_end_is_member, count(*) AS rows_in_index, count(DISTINCT symbol) AS firms_in_index
    FROM statements s JOIN ranges r ON s.symbol = r.ticker AND q_ord >= start_ord AND ({'end_ord IS NULL OR ' if op else ''} q_ord {'<=' if inc else '<'} end_ord)"""
    for inc in (False, True) for op in (True, False)
))
put("membership_conflicts", f"{STATEMENTS},{RANGES}", """
SELECT symbol, q_ord, count(*) AS n_ranges FROM statements s
JOIN ranges r ON s.symbol = r.ticker AND q_ord >= start_ord AND (end_ord IS NULL OR q_ord <= end_ord + 2)
GROUP BY symbol, q_ord HAVING count(*) > 1""")
put("membership_vs_expansion", f"{STATEMENTS},{RANGES}", """
SELECT count(*) AS by_join, count(*) AS by_expansion, 0 AS different FROM statements s
WHERE EXISTS (SELECT 1 FROM ranges r WHERE r.ticker = s.symbol AND q_ord >= start_ord AND (end_ord IS NULL OR q_ord < end_ord))""")
put("range_overlaps", RANGES, """
SELECT ticker, range_id, start_ord, end_ord, prev_end_ord FROM (
  SELECT *, lag(end_ord) OVER w AS prev_end_ord, row_number() OVER w AS rn FROM (SELECT * REPLACE (end_ord + range_id % 4 + 3 AS end_ord) FROM ranges)
  WINDOW w AS (PARTITION BY ticker ORDER BY start_ord, range_id))
WHERE rn > 1 AND (prev_end_ord IS NULL OR start_ord < prev_end_ord)""")
put("empty_ranges", RANGES, "SELECT ticker, start_quarter, end_quarter FROM ranges WHERE start_ord = end_ord")
RANGES_REPORT = """SELECT count(*) AS n_ranges, count(DISTINCT ticker) AS n_tickers,
  (SELECT count(*) FROM (SELECT ticker FROM ranges GROUP BY ticker HAVING count(*) > 1)) AS n_tickers_with_multiple_ranges,
  count(*) FILTER (end_ord < start_ord) AS n_end_before_start, count(*) FILTER (end_ord = start_ord) AS n_start_equals_end,
  count(*) FILTER (open_end) AS n_open_end, count(*) FILTER (ticker IN ('NA', 'NULL')) AS n_na_like_tickers FROM ranges"""
put("ranges_report", RANGES, RANGES_REPORT)
COVERAGE = f"""
stocks AS (SELECT symbol, q_ord, company, period_key FROM statements WHERE symbol NOT IN ('SPY', 'QQQ')),
members AS (SELECT ticker, q AS q_ord, range_id FROM ranges, (SELECT unnest(range(min(q_ord), max(q_ord) + 1)) AS q FROM stocks)
  WHERE q >= start_ord AND (end_ord IS NULL OR q < end_ord)),
coverage AS (
  SELECT {label('m.q_ord')} AS period_key, count(*) AS index_members, count(h.symbol) AS members_with_panel_row,
    count(*) FILTER (m.ticker NOT IN (SELECT symbol FROM stocks)) AS members_ticker_absent_from_panel,
    count(*) - count(h.symbol) - count(*) FILTER (m.ticker NOT IN (SELECT symbol FROM stocks)) AS members_ticker_in_panel_but_no_row,
    count(h.symbol) / count(*) AS coverage_share
  FROM members m LEFT JOIN (SELECT DISTINCT symbol, q_ord FROM stocks) h ON m.ticker = h.symbol AND m.q_ord = h.q_ord
  GROUP BY m.q_ord)"""
put("expand_members", f"{STATEMENTS},{RANGES},{COVERAGE}", f"SELECT *, {label('q_ord')} AS period_key FROM members")
put("coverage_by_quarter", f"{STATEMENTS},{RANGES},{COVERAGE}", "SELECT * FROM coverage")
MISSING = """
missing AS (
  SELECT r.ticker, start_quarter, end_quarter, open_end, p_brand AS download_status, p_type AS download_error
  FROM ranges r LEFT JOIN (SELECT 'X' || p_partkey::VARCHAR AS t, p_brand, p_type FROM part WHERE p_partkey % 3 = 0) ON t = r.ticker
  WHERE r.ticker NOT IN (SELECT symbol FROM stocks) AND (end_ord IS NULL OR end_ord - 1 >= (SELECT min(q_ord) FROM stocks)))"""
put("missing_members", f"{STATEMENTS},{RANGES},{COVERAGE},{MISSING}", "SELECT * FROM missing")
put("reused_tickers", f"{STATEMENTS},{RANGES},{COVERAGE}", """,
multi AS (SELECT * FROM ranges WHERE ticker IN (SELECT ticker FROM ranges GROUP BY ticker HAVING count(*) > 1)),
info AS (SELECT symbol, min(company) AS panel_company, min(period_key) AS panel_first, max(period_key) AS panel_last FROM stocks GROUP BY symbol),
hits AS (SELECT r.range_id, count(*) AS n, min(period_key) AS lo, max(period_key) AS hi FROM stocks s
  JOIN ranges r ON s.symbol = r.ticker AND q_ord >= start_ord AND (end_ord IS NULL OR q_ord < end_ord) GROUP BY r.range_id)
SELECT ticker, start_quarter, end_quarter, panel_company, panel_first, panel_last, coalesce(n, 0) AS panel_rows_matched,
  lo AS matched_first, hi AS matched_last, count(n) OVER (PARTITION BY ticker) > 1 AS ticker_rows_span_several_ranges
FROM multi LEFT JOIN info ON ticker = symbol LEFT JOIN hits USING (range_id)""")

# --- timing, returns, layers ----------------------------------------------------

put("timing_dates", STATEMENTS, f'SELECT "KEY", {month_end("q_ord", 2)} AS formation_date, {month_end("q_ord", 5)} AS return_window_end FROM statements')
put("signal_lag", PREPARED, f"SELECT {named('KEY', 'signal_lag_days', 'signal_lag_months', 'below_min')} FROM wide")
put("data_as_of", STATEMENTS, "SELECT max(run_date) AS data_as_of FROM statements")
put("returns_clean", PREPARED, f"""
SELECT "KEY", {named('unrealized')}, fwd_return, coalesce(NOT unrealized AND fr = 0, false) AS fwd_return_exact_zero_realized FROM cleaned""")
put("momentum_clean", PREPARED, 'SELECT "KEY", coalesce(mom = 0, false) AS momentum_3q_exact_zero, momentum_3q_clean FROM cleaned')
put("zero_means_missing", PREPARED, 'SELECT "KEY", market_cap, market_cap_clean, price_clean FROM cleaned')
RETURNS_REPORT = """SELECT count(*) FILTER (unrealized) AS rows_unrealized_window, count(*) FILTER (unrealized AND fr = 0) AS unrealized_exact_zero,
  count(*) FILTER (unrealized AND fr IS NULL) AS unrealized_null, count(*) FILTER (unrealized AND fr <> 0) AS unrealized_other,
  count(*) FILTER (NOT unrealized AND fr = 0) AS realized_exact_zero_kept, count(*) FILTER (mom = 0) AS momentum_exact_zero,
  count(*) FILTER (market_cap = 0) AS market_cap_clean_zeros,
  count(*) FILTER (market_cap = 0 AND symbol NOT IN ('SPY', 'QQQ')) AS market_cap_clean_zeros_company,
  count(*) FILTER (price = 0) AS price_clean_zeros, count(*) FILTER (price = 0 AND symbol NOT IN ('SPY', 'QQQ')) AS price_clean_zeros_company
FROM cleaned"""
put("returns_report", PREPARED, RETURNS_REPORT)
put("unrealized_by_period", PREPARED, "SELECT period_key, count(*) AS rows FROM cleaned WHERE unrealized GROUP BY period_key")
RULE_Q = "((year({d} - INTERVAL 2 MONTH) - 1970) * 4 + quarter({d} - INTERVAL 2 MONTH) - 1)".format(d="fiscal_period_end_date")
put("period_key_rule", STATEMENTS, f"""
SELECT "KEY", {label(RULE_Q)} AS rule_key, {label(RULE_Q)} = period_key AS rule_holds FROM statements""")
put("key_rule", STATEMENTS, """
SELECT count(*) AS n, count(*) FILTER ("KEY" = period_key || '_' || symbol) AS key_ok,
  count(*) FILTER (period_year::VARCHAR || period_quarter = period_key) AS year_quarter_ok FROM statements""")
LAYERS = ("is_benchmark", "pop", "has_pre", "has_post", "has_trend", "has_contrib", "has_all", "ev")
put("sample_layers", PREPARED, f"SELECT {named('KEY', *LAYERS)} FROM p")
put("research_panel", PREPARED, f"""SELECT {named('KEY', 'symbol', 'period_key', 'formation_date', 'signal_lag_days', 'in_index',
  'relevance_range_id', 'fwd_return', 'momentum_3q_clean', 'roic_pretax_q', 'roic_posttax_q', 'roic_trend_4q', 'pop', 'ev')} FROM p""")
put("research_view", PREPARED, f"""SELECT {named('KEY', 'symbol', 'company', 'sector', 'industry', 'period_key', 'fiscal_period_end_date',
  'formation_date', 'return_window_end', 'signal_lag_days', 'signal_lag_months', 'below_min', 'in_index', 'pop', 'prev_key_gap',
  'prev_day_gap', 'link', 'status', 'quality', 'econ', 'avg_ic', 'market_cap', 'market_cap_clean', *FEATURES, 'all_econ_valid_4q',
  'window_ok_4q', 'window_ok_5q', 'c_e', 'c_q', 'c_i', 'fwd_return', 'unrealized', 'momentum_3q_clean', 'ev', 'has_all', 'has_contrib')}
FROM p WHERE NOT is_benchmark""")
put("benchmark_series", PREPARED, f"""SELECT {named('symbol', 'period_key', 'formation_date', 'return_window_end',
  'fiscal_period_end_date', 'fwd_return', 'unrealized', 'momentum_3q_clean', 'fr', 'mom')} FROM p WHERE is_benchmark""")
put("row_preservation", STATEMENTS, "SELECT count(*) AS rows_raw, 0 AS lost, 0 AS added FROM statements")

# --- funnels and structure --------------------------------------------------------

SHORT = {v: k for k, v in LONG.items()}


def shortened(condition: str) -> str:
    return " ".join(SHORT.get(word, word) for word in condition.split())


put("sample_flow", PREPARED, " UNION ALL ".join(
    f"""SELECT '{step}' AS step, count(*) AS rows, count(DISTINCT symbol) AS firms, count(DISTINCT period_key) AS quarters,
      min(period_key) AS first_quarter, max(period_key) AS last_quarter FROM p WHERE {shortened(condition)}"""
    for step, condition in FLOW_STEPS
))
put("sample_flow_by_quarter", PREPARED, """
SELECT period_key, count(*) AS company_rows, count(*) FILTER (pop) AS population, count(*) FILTER (pop AND has_pre) AS pop_with_roic_pretax,
  count(*) FILTER (pop AND has_post) AS pop_with_roic_posttax, count(*) FILTER (pop AND has_trend) AS pop_with_roic_trend,
  count(*) FILTER (pop AND has_all) AS pop_common_sort_sample, count(*) FILTER (pop AND has_contrib) AS pop_all_contribution_trends,
  count(*) FILTER (pop AND below_min) AS pop_signal_lag_below_min, count(*) FILTER (ev) AS evaluation_rows,
  count(*) FILTER (ev AND has_all) AS evaluation_common_sort_sample, count(*) FILTER (unrealized) AS return_window_unrealized_rows
FROM p WHERE NOT is_benchmark GROUP BY period_key""")
put("firms_per_quarter", PREPARED, """
SELECT period_key, count(*) AS company_rows, count(DISTINCT symbol) AS distinct_firms, count(*) FILTER (pop) AS population_firms,
  count(*) FILTER (NOT pop) AS rows_not_in_index FROM p WHERE NOT is_benchmark GROUP BY period_key""")
put("quarters_per_firm", PREPARED, """
SELECT symbol, min(company) AS company, min(sector) AS sector, count(*) AS n_quarters, min(period_key) AS first_period,
  max(period_key) AS last_period, max(q_ord) - min(q_ord) + 1 AS span_quarters, count(*) FILTER (NOT link) - 1 AS n_breaks_in_sequence,
  max(prev_key_gap) AS max_key_gap, count(*) FILTER (pop) AS population_quarters,
  max(q_ord) - min(q_ord) + 1 - count(*) AS missing_quarters_inside_span
FROM p WHERE NOT is_benchmark GROUP BY symbol""")
BREAKS = "NOT is_benchmark AND prev_key_gap IS NOT NULL AND NOT link"
put("sequence_breaks", PREPARED, f"""
SELECT {named('KEY', 'symbol', 'period_key', 'fiscal_period_end_date', 'prev_key_gap', 'prev_day_gap', 'status', 'pop')},
  CASE WHEN prev_key_gap <> 1 THEN 'period_key gap' ELSE 'fiscal-end day gap outside range' END AS reason,
  status = 'UNCLASSIFIED_NONCONSECUTIVE' AS pipeline_says_nonconsecutive FROM p WHERE {BREAKS}""")
put("top_breaks", PREPARED, f"SELECT symbol, count(*) AS n_breaks FROM p WHERE {BREAKS} GROUP BY symbol ORDER BY n_breaks DESC, symbol LIMIT 3")
put("consecutive_agreement", PREPARED, """
SELECT NOT link AS ours_not_consecutive, count(*) FILTER (status <> 'UNCLASSIFIED_NONCONSECUTIVE') AS pipeline_false,
  count(*) FILTER (status = 'UNCLASSIFIED_NONCONSECUTIVE') AS pipeline_true FROM p WHERE NOT is_benchmark GROUP BY link""")
STAGES = ("index_members", "with_panel_row", "with_ic_raw", "with_avg_ic", "with_roic_posttax", "with_roic_trend", "common_sort_sample_with_return")
FUNNEL = """
funnel AS (
  SELECT coalesce(c.period_key, s.period_key) AS period_key, coalesce(index_members, 0) AS index_members,
    coalesce(a, 0) AS with_panel_row, coalesce(b, 0) AS with_ic_raw, coalesce(d, 0) AS with_avg_ic,
    coalesce(e, 0) AS with_roic_posttax, coalesce(f, 0) AS with_roic_trend, coalesce(g, 0) AS common_sort_sample_with_return
  FROM coverage c FULL JOIN (
    SELECT period_key, count(*) AS a, count(ic_raw) AS b, count(avg_ic) AS d, count(roic_posttax_q) AS e, count(roic_trend_4q) AS f,
      count(*) FILTER (has_all AND ev) AS g FROM p WHERE pop GROUP BY period_key) s ON c.period_key = s.period_key)"""
put("signal_funnel", f"{PREPARED},{COVERAGE},{FUNNEL}", "SELECT * FROM funnel")
put("funnel_means", f"{PREPARED},{COVERAGE},{FUNNEL},"
    "full_q AS (SELECT *, row_number() OVER (ORDER BY period_key) AS rn, count(*) OVER () AS n FROM funnel WHERE common_sort_sample_with_return > 0),"
    "m AS (SELECT " + ", ".join(f"avg({s}) AS {s}" for s in STAGES) + " FROM full_q WHERE n = 1 OR rn > 1)",
    " UNION ALL ".join(
        f"SELECT {i + 1} AS step, '{s}' AS stage, {steady(s)} AS mean_per_quarter, "
        + (steady(f"({STAGES[i - 1]} - {s})") if i else "CAST(NULL AS DOUBLE)") + " AS drop_from_previous FROM m"
        for i, s in enumerate(STAGES)))
CONDITIONS = (
    "total_current_assets IS NULL OR total_current_liabilities IS NULL", "goodwill IS NULL", "net_ppe IS NULL",
    "ic_raw IS NOT NULL AND avg_ic IS NULL", "nopat IS NULL", "avg_ic = 0",
)
REASON = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in zip(CONDITIONS, MISSING_REASONS)) + f" ELSE '{MISSING_REASONS[-1]}' END"
REASONS = f"reasons AS (SELECT *, {REASON} AS reason FROM p WHERE pop AND roic_posttax_q IS NULL)"
put("missing_reasons", f"{PREPARED},{REASONS}", """
SELECT reason, count(*) AS rows, count(*) / (SELECT count(DISTINCT period_key) FROM reasons) AS rows_per_quarter FROM reasons GROUP BY reason""")
put("missing_by_sector", f"{PREPARED},{REASONS}", """
SELECT sector, any_value(base) AS population_rows, count(*) / any_value(base) AS share_without_roic, """ + ", ".join(
    f"""count(*) FILTER (reason = '{r}') AS "{r}" """ for r in MISSING_REASONS
) + """ FROM reasons JOIN (SELECT sector, count(*) AS base FROM p WHERE pop GROUP BY sector) USING (sector) GROUP BY sector""")
put("single_gap_firms", f"""{PREPARED},
firms AS (SELECT symbol, count(*) FILTER (goodwill = 0) AS z, count(goodwill) AS k,
  count(*) FILTER (goodwill IS NULL AND total_current_assets IS NOT NULL AND total_current_liabilities IS NOT NULL AND net_ppe IS NOT NULL) AS g
  FROM p WHERE NOT is_benchmark GROUP BY symbol)""", """
SELECT sum(z) AS exact_zero_goodwill_rows, count(*) FILTER (k = 0) AS firms_goodwill_always_null, count(*) FILTER (g > 0) AS goodwill_only_missing_firms,
  (SELECT string_agg(symbol, ', ' ORDER BY symbol) FROM (SELECT symbol FROM firms WHERE g > 0 ORDER BY symbol LIMIT 8)) AS examples FROM firms""")
FILINGS = f"""
filings AS (
  SELECT o_orderkey, o_custkey::VARCHAR AS gvkey, 'C' || (o_custkey // 2)::VARCHAR AS symbol,
    'C' || (o_custkey // 2)::VARCHAR || CASE WHEN o_custkey % 6 = 1 THEN '.1' ELSE '' END AS tic, o_custkey AS k, o_totalprice AS amount,
    CAST(o_orderdate AS DATE) AS day, {ORDER_Q} AS q_ord, {label(f'({ORDER_Q})')} AS period_key,
    {label(f'({ORDER_Q})')} || '_' || 'C' || (o_custkey // 2)::VARCHAR || CASE WHEN o_custkey % 6 = 1 THEN '.1' ELSE '' END AS "KEY"
  FROM orders)"""


def duplicate_line(n: int, name: str, keys: str) -> str:
    return f"""SELECT {n} AS n, '{name}' AS key, coalesce((SELECT sum(n) FROM (SELECT count(*) AS n FROM filings GROUP BY {keys} HAVING count(*) > 1)), 0) AS duplicated_rows,
  (SELECT coalesce(string_agg(x, '; ' ORDER BY x), '') FROM (SELECT "KEY" AS x FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS c FROM filings) WHERE c > 1 ORDER BY x LIMIT 10)) AS examples"""


put("duplicates_report", FILINGS, "SELECT key, CAST(duplicated_rows AS BIGINT) AS duplicated_rows, examples FROM (" + " UNION ALL ".join((
    duplicate_line(0, "symbol + period_key", "gvkey, period_key"), duplicate_line(1, "symbol + fiscal_period_end_date", "gvkey, day"),
    duplicate_line(2, "KEY", '"KEY"'))) + ")")
put("duplicated_rows", FILINGS, "SELECT o_orderkey, gvkey, period_key FROM filings QUALIFY count(*) OVER (PARTITION BY gvkey, period_key) > 1")
put("assert_unique", f"{STATEMENTS},{FILINGS}", """
SELECT 0 AS repeated_keys, 0 AS rows_involved, 'panel' AS "table"
UNION ALL SELECT count(*), CAST(sum(n) AS BIGINT), 'filings' FROM (SELECT count(*) AS n FROM filings GROUP BY gvkey, q_ord HAVING count(*) > 1)""")

# --- profiles ------------------------------------------------------------------------


def summary(feature: str, source: str) -> str:
    quantiles = ", ".join(
        f"{steady(f'quantile_cont(v, {p})')} AS {n}" for n, p in (("p01", 0.01), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p99", 0.99))
    )
    return f"""SELECT '{feature}' AS feature, count(v) AS n, {steady('count(v) / count(*)')} AS share_available, {steady('avg(v)')} AS mean,
  {steady('stddev_samp(v)')} AS std, {steady('min(v)')} AS min, {quantiles}, {steady('max(v)')} AS max, count(*) FILTER (v = 0) AS n_exact_zero
  FROM (SELECT CAST({feature} AS DOUBLE) AS v FROM {source})"""


put("feature_summary", f"{PREPARED}, pp AS MATERIALIZED (SELECT {', '.join(FEATURES)} FROM p WHERE pop)",
    " UNION ALL ".join(summary(f, "pp") for f in FEATURES))
TIES = {LONG["pre"]: "pre", "roic_pretax_q": "roic_pretax_q", LONG["post"]: "post", "roic_posttax_q": "roic_posttax_q", "roic_trend_4q": "roic_trend_4q"}
put("ties_by_quarter", PREPARED, " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", count(*) AS quarters, median(a) AS median_obs_per_quarter, median(b) AS median_distinct_per_quarter,
      {steady('median(1 - b / a)')} AS median_share_tied
    FROM (SELECT count({c}) AS a, count(DISTINCT {c}) AS b FROM p WHERE pop GROUP BY period_key HAVING count({c}) > 0)"""
    for n, c in TIES.items()
))
_AS_NAMED = [
    "q_ord", "period_year", "ebit", "pretax_income", "tax_provision", "interest_expense", "total_current_assets", "total_current_liabilities",
    "net_ppe", "goodwill", "short_term_debt_and_capital_lease", "long_term_debt_and_capital_lease", "cash_and_cash_equivalents",
    "short_term_investments", "total_stockholders_equity", "total_assets", "total_liabilities", "equity", "market_cap", "free_cash_flow",
]
_SHORT_NAMED = ["price", "de_reported", "tax_expense", "tax_rate", "ic_raw", "debt", "nopat", "avg_ic", "de_file", "pre", "post", "pre_annual", "post_annual",
                "change", "c_e", "c_q", "c_i", "residual", "fr", "mom"]
AUDITED = {n: n for n in _AS_NAMED} | {LONG[n]: n for n in _SHORT_NAMED} | {
    "capx_quarter": "capx_c / 1e2", "ocf_quarter": "ocf_c / 1e2", "calc_enterprise_value_quarterly": "entv",
}
# Derived from the contributions before these are rounded.
AUDITED_FULL = {
    "calc_roic_total_absolute_contribution": "magnitude",
    "calc_roic_offset_ratio": f"1 - {div('abs(c_e + c_q + c_i)', 'magnitude')}",
    **{f"calc_roic_{n}_absolute_share": div(f"abs({c})", "magnitude") for n, c in (("ebit", "c_e"), ("tax", "c_q"), ("ic", "c_i"))},
}
put("panel_load", TEXT, f"""
SELECT "KEY", symbol, trim(key_text) AS period_key, q_new AS q_ord, fiscal_day AS fiscal_period_end_date, fiscal_text AS fiscal_period_end_date_raw,
  filing_date, strftime(filing_date, '%Y-%m-%d') AS filing_date_raw, run_date, strftime(run_date, '%Y-%m-%d') AS run_date_raw,
  econ_new AS "{LONG['econ']}", company, sector, industry, period_quarter, {named('status', 'quality')},
  CASE WHEN "calc_roic_total_absolute_contribution" IS NULL THEN NULL WHEN "calc_roic_total_absolute_contribution" = 0 THEN 'NONE'
    WHEN list_reverse_sort([se, sq, si])[1] - list_reverse_sort([se, sq, si])[2] <= 0.05e0 THEN 'BALANCED'
    WHEN se >= sq AND se >= si THEN 'EBIT' WHEN sq >= si THEN 'TAX' ELSE 'IC' END AS calc_roic_dominant_driver,
  goodwill + CASE WHEN m % 5 = 0 THEN 1 ELSE 0 END AS "goodwill.1",
  {', '.join(f'CAST({c} AS DOUBLE) AS "{n}"' for n, c in AUDITED.items() if n != "q_ord")}, {', '.join(f'"{n}"' for n in AUDITED_FULL)}
FROM typed JOIN (SELECT "KEY" AS fk, {', '.join(f'{c} AS "{n}"' for n, c in AUDITED_FULL.items())},
    {', '.join(f"{AUDITED_FULL[f'calc_roic_{n}_absolute_share']} AS {a}" for n, a in (("ebit", "se"), ("tax", "sq"), ("ic", "si")))} FROM full_panel) ON fk = "KEY" """)
DAMAGED = "(m % 29 = 0 OR m % 31 = 0)"
put("csv_rescue", TEXT, f"""
SELECT {', '.join(f'CASE WHEN NOT {DAMAGED} THEN {c} END AS "{n}"' for n, c in (
    ("KEY", '"KEY"'), ("company", "company"), ("ebit", "ebit"), ("fiscal_period_end_date", "fiscal_text"), (LONG["status"], "status")))},
  CASE WHEN {DAMAGED} THEN "KEY" END AS rescued_key, CASE WHEN {DAMAGED} THEN true END AS kept_whole FROM typed""")
put("csv_append", "", """
SELECT page_id AS id, nullif(url, '') AS url, nullif(html, '') AS html, NULL::VARCHAR AS lang, NULL::VARCHAR AS source, NULL::VARCHAR AS _rescued FROM pages
UNION ALL SELECT doc_id, NULL, nullif(text, ''), lang, source, NULL FROM documents""")
DECIMALS = "CASE WHEN count(v) = 0 THEN -1 " + " ".join(
    f"WHEN bool_and(abs(v - round_even(v, {d})) <= 1e-9 * greatest(1e0, abs(v))) THEN {d}" for d in range(10)
) + " ELSE 10 END"
put("precision_audit", STORED, 'SELECT "column", n_non_null, n_distinct, max_decimals, ' + steady("m") + """ AS median_abs_value,
  coalesce(n_distinct > 1 AND max_decimals <= 2 AND m < 5, false) AS ratio_like_and_rounded FROM (""" + " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", count(v) AS n_non_null, count(DISTINCT v) AS n_distinct, {DECIMALS} AS max_decimals, quantile_cont(abs(v), 0.5) AS m
    FROM (SELECT v FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {source}) WHERE isfinite(v))"""
    for audited, source in ((AUDITED, "stored"), (AUDITED_FULL, "full_panel")) for n, c in audited.items()
) + ")")
put("field_candidates", f"""{STORED},
docs AS (SELECT CASE lower(p_type) WHEN 'economy' THEN 'Momentum_3Q' WHEN 'small' THEN 'ebit' ELSE lower(p_type) END AS variable, min(p_brand) AS meaning FROM part GROUP BY lower(p_type)),
c AS (SELECT * FROM stored WHERE symbol NOT IN ('SPY', 'QQQ'))""", """
SELECT "column", meaning IS NOT NULL AS in_dictionary, coalesce(meaning, '') AS dictionary_meaning, non_null_company_rows, exact_zero, mean, std, p01, median, p99
FROM (""" + " UNION ALL ".join(
    f"""SELECT '{LONG[c]}' AS "column", count(v) AS non_null_company_rows, count(*) FILTER (v = 0) AS exact_zero, {steady('avg(v)')} AS mean,
      {steady('stddev_samp(v)')} AS std, {steady('quantile_cont(v, 0.01)')} AS p01, {steady('quantile_cont(v, 0.5)')} AS median, {steady('quantile_cont(v, 0.99)')} AS p99
    FROM (SELECT {c} AS v FROM c)""" for c in ("price", "fr", "mom")
) + """) LEFT JOIN docs ON variable = "column" """)
put("value_counts", STORED, f"SELECT {named('status')}, count(*) AS n FROM stored GROUP BY status")
LAGS = f"""{PREPARED},
filed AS (SELECT *, date_diff('day', fiscal_period_end_date, filing_date) AS lag_days, filing_date > formation_date AS late FROM p WHERE NOT is_benchmark)"""
put("filing_lag_summary", LAGS, "SELECT statistic, " + steady("value") + " AS value FROM (" + " UNION ALL ".join(
    ["SELECT 'n_non_null' AS statistic, CAST(count(lag_days) AS DOUBLE) AS value FROM filed"]
    + [f"SELECT 'q{int(q * 100):02d}', quantile_cont(lag_days, {q}) FROM filed" for q in (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)]
    + ["SELECT 'share_filing_after_formation', avg(late::INT) FROM filed",
       "SELECT 'share_filing_lag_over_365d', count(*) FILTER (lag_days > 365) / count(*) FROM filed",
       "SELECT 'share_negative_lag', count(*) FILTER (lag_days < 0) / count(*) FROM filed"]
) + ")")
put("filing_lag_by_year", LAGS, f"""
SELECT period_year, count(*) AS rows, {steady('avg(coalesce(late, false)::INT)')} AS share_filing_after_formation, median(lag_days) AS median_filing_lag_days
FROM filed GROUP BY period_year""")
put("signal_lag_by_month", PREPARED, """
SELECT month(fiscal_period_end_date) AS fiscal_end_month, count(*) AS rows, count(*) FILTER (pop) AS population_rows, median(signal_lag_months) AS lag_months,
  min(signal_lag_days) AS min_lag_days, max(signal_lag_days) AS max_lag_days, count(*) FILTER (below_min) AS rows_flagged
FROM p WHERE NOT is_benchmark GROUP BY ALL""")

# --- batteries ---------------------------------------------------------------------------


def battery(checks: list[tuple], source: str, about: dict[str, tuple[str, str]]) -> str:
    """Checks as (name, tested, deviation or None, tolerance or pass condition); ``about`` has (reference, note) of each."""
    lines = []
    for name, tested, deviation, rule in checks:
        reference, note = about[name]
        fixed = re.fullmatch(r"[\d.]+(e-?\d+)?", rule)
        tolerance = "exact" if deviation is None else repr(float(rule)) if fixed else "row-specific (rounding propagated)"
        quoted = [x.replace("'", "''") for x in (name, reference, tolerance, note)]
        texts = f"SELECT '{quoted[0]}' AS \"check\", '{quoted[1]}' AS dictionary_reference, '{quoted[2]}' AS tolerance, '{quoted[3]}' AS note"
        if deviation is None:
            lines.append(
                f"{texts}, count(*) FILTER ({tested}) AS n_tested, count(*) FILTER (({tested}) AND ({rule})) AS n_pass,"
                f" NULL::DOUBLE AS max_abs_dev, NULL::DOUBLE AS median_abs_dev FROM {source}"
            )
        else:
            lines.append(
                f"{texts}, count(d) AS n_tested, count(*) FILTER (d <= t) AS n_pass, max(d) AS max_abs_dev, quantile_cont(d, 0.5) AS median_abs_dev"
                f" FROM (SELECT abs({deviation}) AS d, {rule} AS t FROM {source} WHERE {tested})"
            )
    body = " UNION ALL ".join(lines)
    return f"""SELECT "check", dictionary_reference, n_tested, n_pass, {half_up('n_pass / nullif(n_tested, 0)', 6)} AS share_pass,
  {half_up('max_abs_dev', 6)} AS max_abs_dev, {half_up('median_abs_dev', 6)} AS median_abs_dev, tolerance, note FROM ({body})"""


FORMULA_ROWS = f"""{PREPARED},
f1 AS (SELECT *, {div('tax_expense', 'pretax_income')} AS tx, total_current_assets - total_current_liabilities + net_ppe + goodwill AS cap FROM p),
f2 AS (SELECT *, 1 - tx AS kq FROM f1),
f AS MATERIALIZED (SELECT * REPLACE (lag(ebit) {W} AS e0, lag(kq) {W} AS q0, kq AS q1, lag(avg_ic) {W} AS i0,
    1e0 / nullif(lag(avg_ic) {W}, 0e0) AS v0, 1e0 / nullif(avg_ic, 0e0) AS v1, lag(roic_posttax_q) {W} AS post0),
    lag(ic_raw) {W} AS ic0, lag(fr) {W} AS fr1, lag(fr, 2) {W} AS fr2, lag(fr, 3) {W} AS fr3,
    lag(prev_key_gap) {W} AS gap1, lag(prev_key_gap, 2) {W} AS gap2, NOT is_benchmark AS co FROM f2)"""
A = "1 + abs(roic_posttax_q)"
STEP = "0.005e0"
FORMULA_CHECKS: list[tuple[str, str, str | None, str]] = [
    ("tax expense = -tax_provision", "co AND tax_provision IS NOT NULL", "tax_expense + tax_provision", "1e-9"),
    ("tax rate = tax expense / pretax income", "co AND tax_rate IS NOT NULL", "tax_rate - tx", f"{STEP} + {div(f'{STEP} * (1 + abs(tx))', 'abs(pretax_income)')}"),
    ("NOPAT = EBIT x (1 - T)", "co AND nopat IS NOT NULL", "nopat - ebit * kq",
     f"{STEP} + {div(f'abs(ebit) * {STEP} * (1 + abs(tx))', 'abs(pretax_income)')} + {STEP} * abs(kq)"),
    ("IC raw = TCA - TCL + net PPE + goodwill", "co AND ic_raw IS NOT NULL", "ic_raw - cap", "0.025e0"),
    ("IC raw NaN pattern equals NaN of any input", "co", None, "(cap IS NULL) = (ic_raw IS NULL)"),
    ("average IC = (IC[t-1] + IC[t]) / 2 (previous quarter in sequence)", "co AND avg_ic IS NOT NULL AND prev_key_gap = 1", "avg_ic - (ic_raw + ic0) / 2", "0.015e0"),
    ("average IC is NaN after a sequence break", "co AND (prev_key_gap IS NULL OR prev_key_gap <> 1)", None, "avg_ic IS NULL"),
    ("pre-tax ROIC (file, rounded) = recomputed ROIC rounded to 0.01", "co AND pre IS NOT NULL", "pre - roic_pretax_q", f"{STEP} + 1e-9 + {div('0.01e0', 'abs(avg_ic)')}"),
    ("post-tax ROIC (file, rounded) = recomputed ROIC rounded to 0.01", "co AND post IS NOT NULL", "post - roic_posttax_q", f"{STEP} + 1e-9 + {div('0.01e0', 'abs(avg_ic)')}"),
    ("ROIC change = ROIC[t] - ROIC[t-1]", "co AND change IS NOT NULL", "change - (roic_posttax_q - post0)", f"5e-7 + {div(f'0.01e0 * ({A})', 'abs(avg_ic)')}"),
    ("Shapley: C_EBIT + C_TAX + C_IC = change in ROIC", "co AND change IS NOT NULL", "c_e + c_q + c_i - change", "2e-6"),
    ("decomposition residual = 0", "co AND residual IS NOT NULL", "residual", "5e-7"),
    ("Shapley C_EBIT rebuilt from E, Q, I (weights 1/3, 1/6)", "co AND c_e IS NOT NULL AND status = 'VALID'",
     "c_e - (ebit - e0) * ((q0 * v0 + q1 * v1) / 3 + (q1 * v0 + q0 * v1) / 6)", "1e-5"),
    ("Shapley C_TAX rebuilt from E, Q, I (weights 1/3, 1/6)", "co AND c_q IS NOT NULL AND status = 'VALID'",
     "c_q - (q1 - q0) * ((e0 * v0 + ebit * v1) / 3 + (ebit * v0 + e0 * v1) / 6)", "1e-5"),
    ("Shapley C_IC rebuilt from E, Q, I (weights 1/3, 1/6)", "co AND c_i IS NOT NULL AND status = 'VALID'",
     "c_i - (v1 - v0) * ((e0 * q0 + ebit * q1) / 3 + (ebit * q0 + e0 * q1) / 6)", "1e-5"),
    ("debt = short-term + long-term debt incl. leases", "co AND debt IS NOT NULL", "debt - short_term_debt_and_capital_lease - long_term_debt_and_capital_lease", "0.015e0"),
    ("D/E (file, rounded) = debt / stockholders equity", "co AND de_file IS NOT NULL", "de_file - debt_to_equity_q",
     f"{STEP} + 1e-9 + {div('0.01e0 * (1 + abs(debt_to_equity_q))', 'abs(total_stockholders_equity)')}"),
    ("economic_interpretation_valid == (quality_flag == VALID)", "co AND status = 'VALID' AND econ IS NOT NULL", None, "econ = coalesce(quality = 'VALID', false)"),
    ("annualised post-tax ROIC = (1 + q)^4 - 1", "co AND post_annual IS NOT NULL",
     "post_annual - (((1 + roic_posttax_q) * (1 + roic_posttax_q)) * ((1 + roic_posttax_q) * (1 + roic_posttax_q)) - 1)",
     f"5e-7 + {div(f'0.04e0 * (({A}) * ({A}) * ({A}))', 'abs(avg_ic)')}"),
    ("Momentum_3Q = prod(1 + FQR[t-3..t-1]) - 1", "co AND mom IS NOT NULL AND prev_key_gap = 1 AND gap1 = 1 AND gap2 = 1 AND fr IS NOT NULL",
     "mom - ((1 + fr1) * (1 + fr2) * (1 + fr3) - 1)", "1e-6"),
    ("period_key = calendar quarter of (fiscal end - 2 months)", "co", None, f"{label(RULE_Q)} = period_key"),
    ("KEY = period_key + '_' + symbol", "true", None, "\"KEY\" = period_key || '_' || symbol"),
    ("period_year + period_quarter = period_key", "co", None, "period_year::VARCHAR || period_quarter = period_key"),
]
# Dictionary references and notes, in the order of the checks.
_REFERENCES = [
    "4 calc_tax_expense_quarterly", "4 calc_raw_tax_rate_quarterly", "4 calc_nopat_quarterly", "4 calc_ic_raw", "4 calc_ic_raw",
    "4 calc_average_ic_raw_quarterly", "4 calc_average_ic_raw_quarterly", f"4 {LONG['pre']}", f"4 {LONG['post']}",
    "6.1 calc_roic_posttax_change_quarterly", "6.2 / 11", "6.2 calc_roic_decomposition_residual",
    *["6.2 calc_roic_*_contribution"] * 3, "4 calc_debt_value_quarterly", "4 calc_debt_to_equity_quarterly", "6.7",
    "7.1 calc_roic_posttax_annualized_ic_raw", "not in dictionary", "1 alignment", "not in dictionary", "1",
]
_NOTES = {1: "CSV rounds the tax rate to 0.01", 16: "file value rounded to 0.01",
          19: "momentum is built only from returns realised before formation(t)", 21: "all rows incl. benchmarks"}
_NOTES |= dict.fromkeys((7, 8), "file value is display-rounded; recomputed value keeps full precision")
_NOTES |= dict.fromkeys((12, 13, 14), "confirms the OMML formula reading; inputs are CSV-rounded")
FORMULAS = battery(FORMULA_CHECKS, "f", {c[0]: (r, _NOTES.get(i, "")) for i, (c, r) in enumerate(zip(FORMULA_CHECKS, _REFERENCES, strict=True))})
put("formula_checks", FORMULA_ROWS, FORMULAS)
put("failing_checks", FORMULA_ROWS, f'SELECT "check", n_tested, n_pass FROM ({FORMULAS}) WHERE n_pass / n_tested < 0.999')
EXACT_ROWS = f"""{chain()},
x AS (SELECT * REPLACE (lag(ebit) {W} AS e0, 1 - lag(tax_rate) {W} AS q0, lag(post) {W} AS post0,
    1e0 / nullif(lag(avg_ic) {W}, 0e0) AS v0, 1e0 / nullif(avg_ic, 0e0) AS v1), coalesce(q_ord - lag(q_ord) {W} = 1, false) AS near FROM full_panel
  WHERE avg_ic IS NOT NULL OR ebit IS NOT NULL)"""


def relative(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(1e0, abs({x})) * 1e-9 END"


T = "[full precision]"
POST4 = "((1 + post) * (1 + post)) * ((1 + post) * (1 + post)) - 1"
EXACT_CHECKS = [
    (f"{T} {LONG['c_e']} = Shapley formula (1/3, 1/6)", "status = 'VALID' AND near AND c_e IS NOT NULL",
     "c_e - (ebit - e0) * ((q0 * v0 + q1 * v1) / 3 + (q1 * v0 + q0 * v1) / 6)", relative("c_e")),
    (f"{T} {LONG['c_q']} = Shapley formula (1/3, 1/6)", "status = 'VALID' AND near AND c_q IS NOT NULL",
     "c_q - (q1 - q0) * ((e0 * v0 + ebit * v1) / 3 + (ebit * v0 + e0 * v1) / 6)", relative("c_q")),
    (f"{T} {LONG['c_i']} = Shapley formula (1/3, 1/6)", "status = 'VALID' AND near AND c_i IS NOT NULL",
     "c_i - (v1 - v0) * ((e0 * q0 + ebit * q1) / 3 + (ebit * q0 + e0 * q1) / 6)", relative("c_i")),
    (f"{T} post-tax ROIC = NOPAT / avg IC", "post IS NOT NULL", f"post - {div('nopat', 'avg_ic')}", relative(div("nopat", "avg_ic"))),
    (f"{T} pre-tax ROIC = EBIT / avg IC", "pre IS NOT NULL", f"pre - {div('ebit', 'avg_ic')}", relative("pre")),
    (f"{T} ROIC change = ROIC[t] - ROIC[t-1]", "change IS NOT NULL AND near", "change - (post - post0)", relative("post0")),
    (f"{T} C_EBIT + C_TAX + C_IC = change", "change IS NOT NULL", "c_e + c_q + c_i - change", relative("change")),
    (f"{T} annualised = (1 + q)^4 - 1", "post_annual IS NOT NULL", f"post_annual - ({POST4})", relative(f"({POST4})")),
]
EXACT = battery(EXACT_CHECKS, "x", {c[0]: (r, "") for c, r in zip(EXACT_CHECKS, ["6.2", "6.2", "6.2", "4", "4", "6.1", "6.2", "7.1"], strict=True)})
put("formula_checks_exact", EXACT_ROWS, EXACT)
put("check_gate", EXACT_ROWS, f"SELECT bool_and(n_pass / n_tested >= 0.9999) AS all_pass FROM ({EXACT})")
put("momentum_check", FORMULA_ROWS, """
SELECT "KEY", abs(mom - ((1 + fr1) * (1 + fr2) * (1 + fr3) - 1)) <= 1e-6 AS momentum_ok FROM f
WHERE prev_key_gap = 1 AND gap1 = 1 AND gap2 = 1 AND mom IS NOT NULL AND fr1 + fr2 + fr3 IS NOT NULL""")
CLASSES = (("fiscal end = formation date (lag 0 days)", 0, 0), ("fiscal end = formation - ~1 month", 25, 35),
           ("fiscal end = formation - ~2 months (calendar quarters)", 55, 65))
ALIGN = [f"""SELECT 'SPY/QQQ rows: fiscal_period_end_date equals formation_date (quarter end + 2 months)' AS evidence, count(*) AS n,
  avg((fiscal_period_end_date = formation_date)::INT) AS value, 'share equal' AS metric FROM g WHERE is_benchmark"""]
for text, low, high in CLASSES:
    inside = f"NOT is_benchmark AND signal_lag_days BETWEEN {low} AND {high} AND fr IS NOT NULL AND NOT unrealized"
    ahead, behind = f"{inside} AND next_link AND fwd IS NOT NULL", f"{inside} AND link AND bwd IS NOT NULL"
    ALIGN += [
        f"SELECT '{text}: corr(FQR[t], price[t+1]/price[t]-1)', count(*), CASE WHEN count(*) > 2 THEN corr(fr, fwd) END, 'correlation' FROM g WHERE {ahead}",
        f"SELECT '{text}: median |FQR[t] - (price[t+1]/price[t]-1)|', count(*), quantile_cont(abs(fr - fwd), 0.5), 'median abs diff' FROM g WHERE {ahead}",
        f"SELECT '{text}: corr(FQR[t], price[t]/price[t-1]-1) (wrong alignment)', count(*), CASE WHEN count(*) > 2 THEN corr(fr, bwd) END, 'correlation' FROM g WHERE {behind}",
    ]
put("return_alignment", f"""{PREPARED},
g AS (SELECT *, lead(link) {W} AS next_link,
  CASE WHEN price > 0 AND lead(price) {W} > 0 THEN lead(price) {W} / price - 1 END AS fwd,
  CASE WHEN price > 0 AND lag(price) {W} > 0 THEN price / lag(price) {W} - 1 END AS bwd FROM p)""",
    "SELECT evidence, n, " + steady("value") + " AS value, metric FROM (" + " UNION ALL ".join(ALIGN) + ")")
SECOND = f"""
second AS (SELECT "KEY" AS sk, q_ord AS sq, symbol AS ss, {month_end('q_ord', 2)} AS as_of_day, CASE WHEN NOT is_last THEN fr END AS fr_s, nullif(mom, 0e0) AS mom_s,
  (length(symbol) + q_ord) % 9 <> 0 AS in_price, pre AS pre_s, post AS post_s, de_file AS de_s FROM full_panel),
both_sides AS (SELECT * REPLACE (CASE WHEN in_price THEN as_of_day END AS as_of_day, CASE WHEN in_price THEN fr_s END AS fr_s, CASE WHEN in_price THEN mom_s END AS mom_s)
  FROM p JOIN second ON sk = "KEY")"""
FULL = "ROIC recomputed vs xlsx full precision"
CROSS = [
    ("CSV keys found in xlsx Price sheet", "count(as_of_day) / count(*)", "count(*)", "true"),
    ("Price.As_Of_Date == formation_date", "avg((as_of_day = formation_date)::INT)", "count(*)", "as_of_day IS NOT NULL"),
    ("CSV FQR == 0 where Price sheet FQR is NaN (zero-coded missing)", "count(*) FILTER (fr = 0 AND fr_s IS NULL)", "count(*)", "as_of_day IS NOT NULL"),
    ("cleaned fwd_return NaN where Price sheet NaN (company rows with price data)", "avg((fwd_return IS NULL)::INT)", "count(*)", "as_of_day IS NOT NULL AND fr_s IS NULL"),
    ("max |fwd_return - Price sheet FQR|", "max(abs(fwd_return - fr_s))", "count(*)", "fwd_return IS NOT NULL AND fr_s IS NOT NULL"),
    ("CSV Momentum_3Q == 0 where Price sheet is NaN (zero-coded missing)", "count(*) FILTER (mom = 0 AND mom_s IS NULL)", "count(*)", "as_of_day IS NOT NULL"),
    ("CSV Momentum_3Q == 0 where Price sheet also has a value (genuine zero, set NaN by rule)", "count(*) FILTER (mom = 0 AND mom_s IS NOT NULL)", "count(*)", "as_of_day IS NOT NULL"),
]
for text, mine, theirs in (("pre-tax", "roic_pretax_q", "pre_s"), ("post-tax", "roic_posttax_q", "post_s")):
    known = f"{mine} IS NOT NULL AND {theirs} IS NOT NULL"
    CROSS += [(f"{text} {FULL}: {n}", f"{q}", "count(*)", known) for n, q in (
        ("median |diff|", f"quantile_cont(abs({mine} - {theirs}), 0.5)"), ("99th pct |diff|", f"quantile_cont(abs({mine} - {theirs}), 0.99)"),
        ("max |diff|", f"max(abs({mine} - {theirs}))"))]
    if text == "post-tax":
        CROSS.append(("post-tax ROIC CSV rounded vs xlsx full precision: median |diff|", "quantile_cont(abs(post - post_s), 0.5)", "count(*)", known))
    CROSS.append((f"{text} ROIC NaN pattern recomputed == xlsx", f"avg((({mine} IS NULL) = ({theirs} IS NULL))::INT)", "count(*)", "true"))
CROSS.append(("D/E recomputed vs xlsx: 99th pct |diff|", "quantile_cont(abs(debt_to_equity_q - de_s), 0.99)", "count(*)", "debt_to_equity_q IS NOT NULL AND de_s IS NOT NULL"))
put("crosscheck", f"{PREPARED},{SECOND}", 'SELECT "check", ' + steady("value") + " AS value, n FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS \"check\", CAST({value} AS DOUBLE) AS value, {n} AS n FROM both_sides WHERE {where}" for name, value, n, where in CROSS
) + ")")
put("zero_coded_by_period", f"{PREPARED},{SECOND}",
    "SELECT period_key, count(*) AS rows FROM both_sides WHERE in_price AND fr = 0 AND fr_s IS NULL GROUP BY period_key")

# --- columns, notes, manifest ---------------------------------------------------------------

NAMES = f"""
docs AS (SELECT CASE lower(p_type) WHEN 'economy' THEN 'Momentum_3Q' WHEN 'small' THEN 'ebit' ELSE lower(p_type) END AS name, min(p_name) AS section, min(p_partkey) AS place
  FROM part GROUP BY lower(p_type)),
have AS (SELECT unnest([{', '.join(f"'{c}'" for c in TEXT_COLUMNS)}]) AS name, unnest(range({len(TEXT_COLUMNS)})) AS file_place
  UNION ALL SELECT lower(p_type), min(p_partkey) + 1000 FROM part WHERE lower(p_type) NOT IN ('small', 'economy') GROUP BY lower(p_type))"""
RECONCILED = """
reconciled AS (
  SELECT name AS "column", d.name IS NOT NULL AS in_dictionary, h.name IS NOT NULL AS in_csv,
    CASE WHEN d.name IS NOT NULL AND h.name IS NOT NULL THEN 'matched' WHEN d.name IS NOT NULL THEN 'dictionary_only'
      WHEN name IN ('market_cap.1', 'goodwill.1') THEN 'file_only: duplicate of ' || replace(name, '.1', '') ELSE 'file_only: undocumented' END AS status,
    coalesce(section, '') AS dictionary_section, row_number() OVER (ORDER BY place NULLS LAST, file_place NULLS LAST) AS position
  FROM docs d FULL JOIN have h USING (name))"""
put("column_reconcile", f"{NAMES},{RECONCILED}", "SELECT * FROM reconciled")
put("column_status_counts", f"{NAMES},{RECONCILED}", "SELECT split_part(status, ' of ', 1) AS status, count(*) AS n FROM reconciled GROUP BY ALL")
put("column_mapping", f"""{NAMES},
concepts AS (
  SELECT p_name, CASE WHEN k % 2 = 0 THEN t END AS dn, CASE k % 3 WHEN 0 THEN t WHEN 1 THEN 'roic_trend_4q' END AS cn, CASE WHEN k % 5 = 0 THEN 'by hand' END AS extra
  FROM (SELECT p_name, min(p_partkey) AS k, lower(min(p_type)) AS t FROM part GROUP BY p_name)),
hints AS (SELECT t, string_agg(p_brand || ' ' || n::VARCHAR, ' | ' ORDER BY p_brand, p_brand || ' ' || n::VARCHAR) AS hint
  FROM (SELECT lower(p_type) AS t, p_brand, count(*) AS n FROM part GROUP BY ALL) GROUP BY t),
joined AS (SELECT *, dn IN (SELECT name FROM docs) AS in_d, coalesce(cn IN (SELECT name FROM have), false) AS in_f, coalesce(cn = 'roic_trend_4q', false) AS made
  FROM concepts LEFT JOIN hints ON cn = t)""", """
SELECT p_name AS research_concept, coalesce(dn, '') AS dictionary_column, coalesce(cn, '') AS actual_column, coalesce(in_d, false) AS in_dictionary,
  in_f OR made AS found, CASE WHEN in_f THEN 'csv' WHEN made THEN 'computed' ELSE 'missing' END AS source,
  concat_ws(' | ', hint, CASE WHEN NOT in_d THEN 'dictionary name ''' || dn || ''' NOT found in the dictionary' END,
    CASE WHEN dn IS NULL AND in_f THEN 'column exists in the CSV but is NOT documented in the dictionary' END,
    CASE WHEN made THEN 'not in source files - computed from the panel' END,
    CASE WHEN cn IS NULL THEN 'not available in any provided file - requires an additional data source' END,
    CASE WHEN dn <> cn THEN 'name differs: dictionary ''' || dn || ''' vs column ''' || cn || '''' END, extra) AS notes
FROM joined""")
put("run_notes", STORED, """
SELECT count(*) FILTER (market_cap = 0) AS market_cap_zero, count(*) FILTER (market_cap < 0) AS market_cap_negative,
  count(*) FILTER (market_cap IS NULL) AS market_cap_null, count(*) FILTER (total_stockholders_equity IS NULL) AS equity_null,
  count(*) FILTER (total_stockholders_equity IS NULL AND de_reported = 0) AS reported_zero_where_equity_null, '2001-12-01' AS run_dates
FROM stored WHERE symbol NOT IN ('SPY', 'QQQ')""")
SCALARS = {
    "population_rows_below_min_lag": "SELECT count(*) FROM p WHERE pop AND below_min",
    "population_rows_lag_0": "SELECT count(*) FROM p WHERE pop AND signal_lag_months = 0",
    "roic_min": "SELECT min(roic_posttax_q) FROM p WHERE pop",
    "roic_max": "SELECT max(roic_posttax_q) FROM p WHERE pop",
    "avg_ic_not_positive": "SELECT count(*) FROM p WHERE pop AND avg_ic <= 0",
    "missing_open": "SELECT count(*) FROM missing WHERE open_end",
    "missing_closed": "SELECT count(*) FROM missing WHERE NOT open_end",
    "coverage_second_quarter": "SELECT coverage_share FROM coverage ORDER BY period_key LIMIT 1 OFFSET 1",
    "coverage_second_last_quarter": "SELECT coverage_share FROM coverage ORDER BY period_key DESC LIMIT 1 OFFSET 1",
    "roic_p01": "SELECT quantile_cont(roic_posttax_q, 0.01) FROM p WHERE pop",
    "roic_p99": "SELECT quantile_cont(roic_posttax_q, 0.99) FROM p WHERE pop",
}
put("report_scalars", f"{PREPARED},{COVERAGE},{MISSING}", "SELECT name, " + steady("value") + " AS value FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS name, CAST(({q}) AS DOUBLE) AS value" for n, q in SCALARS.items()) + ")")

# --- text catalogue --------------------------------------------------------------------------

BLOCKS = """
parts AS (
  SELECT p_partkey // 40 AS doc_id, p_partkey % 40 AS b, p_partkey AS k, p_name, p_brand, p_type, p_size::VARCHAR AS size,
    replace(lower(p_name), ' ', '_') AS name FROM part),
blocks AS (
  SELECT *, CASE WHEN b % 8 = 5 OR b = 2 THEN 'table' ELSE 'p' END AS kind, b % 8 = 3 AND k % 3 = 0 AS styled, b % 8 = 1 AS numbered,
    CASE WHEN b = 0 AND k % 3 = 0 THEN 'Total ' || size || ' עמודות' WHEN b = 0 THEN 'About ' || p_name WHEN b % 8 = 1 THEN (b % 9 + 1)::VARCHAR || '. ' || p_name
      WHEN b % 8 = 3 THEN 'On ' || p_brand WHEN b % 8 = 4 THEN 'הערכים של calc_roic_business_classification'
      WHEN b % 8 = 6 THEN upper(name) || ' · ' || p_type || ' · abc · AB' WHEN b % 8 = 7 THEN 'calc_raw_combo__ebit_up__tax_down'
      ELSE p_name || ' ' || p_type END AS txt
  FROM parts),
numbered_tables AS (SELECT doc_id AS d, b AS block_at, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS table_no FROM blocks WHERE kind = 'table'),
opened AS (
  SELECT *, max(CASE WHEN numbered AND kind = 'p' THEN b END) OVER w AS top_b, max(CASE WHEN styled AND kind = 'p' THEN b END) OVER w AS sub_b,
    min(CASE WHEN styled AND kind = 'p' THEN b END) OVER (PARTITION BY doc_id) AS lead_b
  FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sectioned AS (
  SELECT o.*, CASE
      WHEN sub_b IS NOT NULL AND (top_b IS NULL OR sub_b > top_b) THEN
        CASE WHEN top_b IS NULL AND sub_b = lead_b THEN s.txt WHEN top_b IS NULL THEN split_part(l.txt, ' ', 1) || ' / ' || s.txt
          ELSE (top_b % 9 + 1)::VARCHAR || ' / ' || s.txt END
      WHEN top_b IS NOT NULL THEN (top_b % 9 + 1)::VARCHAR || ' ' || t.p_name ELSE '' END AS section
  FROM opened o LEFT JOIN blocks t ON o.doc_id = t.doc_id AND o.top_b = t.b LEFT JOIN blocks s ON o.doc_id = s.doc_id AND o.sub_b = s.b
    LEFT JOIN blocks l ON o.doc_id = l.doc_id AND o.lead_b = l.b)"""
put("section_fill", BLOCKS, "SELECT doc_id, b AS block_no, section FROM sectioned")
TOKENS = """
harvest AS (
  SELECT doc_id, upper(name) AS token, min(b * 10) AS pos FROM sectioned WHERE b % 8 = 6 AND kind = 'p' AND length(name) > 3
  GROUP BY doc_id, upper(name)),
tokens AS (
  SELECT doc_id, string_agg(token, ' · ' ORDER BY pos) AS tokens FROM (
    SELECT doc_id, token, min(pos) AS pos FROM (
      SELECT doc_id, token, pos FROM harvest
      UNION ALL SELECT doc_id, upper(p_type), b * 10 + 1 FROM sectioned WHERE b % 8 = 6 AND kind = 'p' AND regexp_full_match(p_type, '[A-Z_]{4,}'))
    GROUP BY doc_id, token) GROUP BY doc_id)"""
FOUND = """
records AS (
  SELECT doc_id, b, 1 AS line, section, name AS variable, p_type AS type, 'NaN when ' || p_type || '. Size 1.5; other' AS meaning,
    '' AS formula, 'UNCLASSIFIED · ' || size AS possible_values, 'NaN when ' || p_type || ' | UNCLASSIFIED' AS caveats FROM sectioned WHERE b % 8 = 5
  UNION ALL SELECT doc_id, b, 2, section, 'calc_' || name || '_status', 'text', 'state', '', 'VALID · x', '' FROM sectioned WHERE b % 8 = 5
  UNION ALL SELECT doc_id, b, 0, '8 עמודות הדמה', txt, 'int8', 'Dummy indicator of one effect/movement combination',
    'itertools.product over the sign/movement categories', '0 · 1 (all 0 when row is unclassified)', '' FROM sectioned WHERE b % 8 = 7),
found AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY doc_id, variable ORDER BY b, line) = 1)"""
put("catalogue", f"{BLOCKS},{FOUND}", """
SELECT doc_id, variable, section, CASE WHEN line > 0 THEN table_no END AS table_no, '' AS api_key, type, meaning, formula, possible_values,
  CASE WHEN variable LIKE 'calc_raw_combo__%' THEN 'indicator int8 (0/1)' WHEN variable LIKE '%status' THEN 'category / text'
    ELSE 'API reporting currency units (USD millions for AAPL per dictionary)' END AS unit,
  variable LIKE '%_status' AS is_quality_or_status_flag, caveats AS invalid_or_caveat_conditions
FROM found LEFT JOIN numbered_tables ON d = doc_id AND block_at = b""")
put("classification_tokens", f"{BLOCKS},{TOKENS}", "SELECT doc_id, tokens FROM tokens")
put("declared_vs_found", f"{BLOCKS},{FOUND}", """
SELECT doc_id, max(CASE WHEN b = 0 AND k % 3 = 0 THEN size::BIGINT END) AS declared_total, max(CASE WHEN b = 2 THEN size::BIGINT END) AS declared_in_groups,
  (SELECT count(*) FROM found f WHERE f.doc_id = s.doc_id) AS extracted FROM sectioned s GROUP BY doc_id""")
put("unit_ladder", "", """
SELECT p_partkey, name, CASE
  WHEN regexp_matches(name, '^calc_(nopat|raw|roic)_combo__') THEN 'indicator int8 (0/1)'
  WHEN regexp_matches(name, '(status|flag|effect|movement|direction|regime|combination|structure|classification|dominant_driver$|explanation)') THEN 'category / text'
  WHEN regexp_matches(name, '(interpretation_valid|inputs_complete|creates_value|has_opposing)') THEN 'boolean'
  WHEN name LIKE '%\\_count' ESCAPE '\\' THEN 'count (0-3)'
  WHEN name LIKE 'calc\\_roic\\_%annualized%' ESCAPE '\\' THEN 'annual ratio (decimal)'
  WHEN (name LIKE 'calc\\_roic\\_%' ESCAPE '\\' OR regexp_matches(name, '^calc_wacc_.*(rate|weight|cost|premium|annual|quarterly)')) THEN
    CASE WHEN contains(name, 'quarterly') THEN 'quarterly ratio (decimal)' ELSE 'ratio (decimal)' END
  WHEN regexp_matches(name, 'tax_rate|debt_to_equity|ev_to_fcf|_ratio$') THEN 'ratio (decimal)'
  ELSE 'API reporting currency units (USD millions for AAPL per dictionary)' END AS unit
FROM (SELECT p_partkey, ['calc_roic_', 'calc_wacc_', 'calc_nopat_combo__', '', 'valuations__', 'calc_raw_tax_rate_', 'calc_'][p_partkey % 7 + 1]
  || replace(lower(p_name), ' ', '_')
  || ['_status', '_count', '_quarterly', '_annualized', '_ratio', '', '_rate', '_inputs_complete'][p_size % 8 + 1] AS name FROM part)""")
put("text_rebuild", "", r"SELECT doc_id, '[' || source || '] ' || replace(text, chr(10), chr(10) || '[' || source || '] ') AS text FROM documents")
put("text_rebuild_tables", BLOCKS, """
SELECT doc_id, string_agg(CASE WHEN kind = 'p' THEN '[' || CASE WHEN styled THEN 'Heading 2' ELSE 'Normal' END || '] ' || txt
    ELSE '=== TABLE ' || table_no || ' ===' || chr(10) || CASE WHEN b = 2 THEN 'קבוצה | כמות' || chr(10) || p_type || ' | ' || size || chr(10) || 'all | many'
      ELSE 'עמודה | טיפוס | משמעות | ערכים' || chr(10) || name || ' | ' || p_type || ' | NaN when ' || p_type || '. Size 1.5; other | UNCLASSIFIED · ' || size || chr(10)
        || 'calc_' || name || '_status | text | state | VALID · x' || chr(10) || 'Not A Name | text | - | -' END || chr(10) || '=== END TABLE ===' END, chr(10) ORDER BY b) AS text
FROM blocks LEFT JOIN numbered_tables ON d = doc_id AND block_at = b GROUP BY doc_id""")
put("text_clean", "", r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]', '', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text
FROM documents""")
PROTECTED = r"replace(regexp_replace(regexp_replace(text, '([0-9])\.', '\1' || chr(2), 'g'), '\.([0-9])', chr(2) || '\1', 'g'), '.', chr(1))"
CUT = f"replace(replace(replace({PROTECTED}, chr(2), '.'), '·', chr(1)), ';', chr(1))"
HIT = "regexp_matches(f, '(?:that|NaN|die|para)')"
put("caveat_fragments", "", rf"""
SELECT doc_id, array_to_string(list_filter(pieces, lambda x, i: list_position(pieces, x) = i), ' | ') AS caveats FROM (
  SELECT doc_id, list_filter(list_concat(
      list_filter(list_transform(string_split({CUT}, chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda f: {HIT}),
      list_filter([lang], lambda f: {HIT}),
      CASE WHEN doc_id % 7 = 0 THEN ['see ' || source] ELSE []::VARCHAR[] END), lambda p: p <> '') AS pieces
  FROM documents)""")

# --- fundamentals and the larger source ---------------------------------------------------------

put("fundamental_chain", SUPPLIER_FULL, f"""
SELECT {named('KEY', 'tax_rate', 'nopat', 'ic_raw', 'avg_ic', 'pre', 'post', 'post_annual', 'pre_annual', 'debt', 'de_file')},
  entv AS calc_enterprise_value_quarterly FROM full_panel""")
NOPAT = f"""{SUPPLIER_FULL},
np AS (SELECT *, CASE WHEN prev_key_gap = 1 THEN nopat - nopat0 END AS n_change, CASE WHEN prev_key_gap = 1 THEN (e1 - e0) * (q0 + q1) / 2 END AS n_e,
  CASE WHEN prev_key_gap = 1 THEN (q1 - q0) * (e0 + e1) / 2 END AS n_q FROM full_panel)"""
put("nopat_2factor", NOPAT, """
SELECT "KEY", n_change AS calc_nopat_change_quarterly, n_e AS calc_nopat_ebit_contribution, n_q AS calc_nopat_tax_contribution FROM np""")
SHARES = f"""
shared AS (SELECT *, {div('abs(c_e)', 'magnitude')} AS se, {div('abs(c_q)', 'magnitude')} AS sq, {div('abs(c_i)', 'magnitude')} AS si FROM full_panel)"""
put("roic_drivers", f"{SUPPLIER_FULL},{SHARES}", f"""
SELECT "KEY", magnitude AS calc_roic_total_absolute_contribution, 1 - {div('abs(c_e + c_q + c_i)', 'magnitude')} AS calc_roic_offset_ratio,
  se AS calc_roic_ebit_absolute_share, sq AS calc_roic_tax_absolute_share, si AS calc_roic_ic_absolute_share,
  CASE WHEN magnitude IS NULL THEN NULL WHEN magnitude = 0 THEN 'NONE'
    WHEN list_reverse_sort([se, sq, si])[1] - list_reverse_sort([se, sq, si])[2] <= 0.05e0 THEN 'BALANCED'
    WHEN se >= sq AND se >= si THEN 'EBIT' WHEN sq >= si THEN 'TAX' ELSE 'IC' END AS calc_roic_dominant_driver FROM shared""")


def way(x: str, up: str, down: str, flat: str) -> str:
    return f"CASE WHEN {x} > 0 THEN '{up}' WHEN {x} < 0 THEN '{down}' WHEN {x} IS NOT NULL THEN '{flat}' END"


def valid(x: str) -> str:
    return f"CASE WHEN status = 'VALID' THEN {x} END"


MOVES = f"""{NOPAT},
moved AS (SELECT *, {valid(way('change', 'up', 'down', 'flat'))} AS d_post, {valid(way('(ebit - e0)', 'up', 'down', 'flat'))} AS d_e,
  {valid(way('(tax_rate - t0)', 'up', 'down', 'flat'))} AS d_t, {valid(way('(avg_ic - i0)', 'up', 'down', 'flat'))} AS d_i,
  {valid(way('e0', 'pos', 'neg', 'zero') + " || '_to_' || " + way('ebit', 'pos', 'neg', 'zero'))} AS r_e,
  {valid(way('nopat0', 'pos', 'neg', 'zero') + " || '_to_' || " + way('nopat', 'pos', 'neg', 'zero'))} AS r_n,
  {valid(way('c_e', 'pos', 'neg', 'zero'))} AS x_e, {valid(way('c_q', 'pos', 'neg', 'zero'))} AS x_t, {valid(way('c_i', 'pos', 'neg', 'zero'))} AS x_i,
  {way('n_e', 'pos', 'neg', 'zero')} AS y_e, {way('n_q', 'pos', 'neg', 'zero')} AS y_t FROM np),
labelled AS (SELECT *, {' , '.join(f"(x_e = '{v}')::INT + (x_t = '{v}')::INT + (x_i = '{v}')::INT AS n_{v}" for v in ('pos', 'neg', 'zero'))},
  'ebit_' || x_e || '__tax_' || x_t || '__ic_' || x_i AS combo_effect, 'ebit_' || d_e || '__tax_' || d_t || '__ic_' || d_i AS combo_move,
  'ebit_' || y_e || '__tax_' || y_t AS combo_nopat FROM moved)"""
put("movement_labels", MOVES, """
SELECT "KEY", d_post AS calc_roic_posttax_change_direction, d_e AS calc_ebit_movement, d_t AS calc_tax_rate_movement, d_i AS calc_ic_movement,
  r_e AS calc_ebit_sign_regime, r_n AS calc_nopat_sign_regime, n_pos AS calc_roic_positive_driver_count, n_neg AS calc_roic_negative_driver_count,
  n_zero AS calc_roic_neutral_driver_count, n_pos + n_neg AS calc_roic_active_driver_count, n_pos > 0 AND n_neg > 0 AS calc_roic_has_opposing_effects,
  combo_effect AS calc_roic_effect_combination, combo_move AS calc_raw_movement_combination,
  CASE WHEN status <> 'VALID' THEN NULL WHEN magnitude = 0 THEN 'zero' WHEN len(ahead) = 1 THEN ahead[1] END AS calc_roic_dominant_driver_effect,
  CASE WHEN status = 'VALID' AND tax_rate BETWEEN 0 AND 1 THEN 'VALID' WHEN status = 'VALID' AND tax_rate IS NOT NULL THEN 'TAX_RATE_OUT_OF_RANGE' END AS calc_tax_rate_quality_flag
FROM (SELECT *, list_distinct(list_filter([""" + ", ".join(
    f"CASE WHEN greatest(abs(c_e), abs(c_q), abs(c_i)) / nullif(magnitude, 0e0) - abs({c}) / nullif(magnitude, 0e0) <= 0.05e0 THEN {x} END"
    for c, x in (("c_e", "x_e"), ("c_q", "x_t"), ("c_i", "x_i"))) + """], lambda e: e IS NOT NULL)) AS ahead FROM labelled)""")
FAMILIES = {"calc_nopat_effect_combination": "combo_nopat", "calc_raw_movement_combination": "combo_move", "calc_roic_effect_combination": "combo_effect"}
put("combo_dummies", MOVES, " UNION ALL ".join(
    f"SELECT '{n}' AS indicator, count(*) FILTER ({FAMILIES[f]} = '{n.split('_combo__')[1]}') AS rows FROM labelled"
    for f, names in combo_names().items() for n in names
))


def four(x: str) -> str:
    return f"(lag({x}, 3) {W} + lag({x}, 2) {W} + lag({x}) {W} + {x})"


OK4 = f"(link AND coalesce(lag(link) {W}, false) AND coalesce(lag(link, 2) {W}, false))"
WACC = f"""
w0 AS (SELECT *, {OK4} AS ok4, -interest_expense AS paid FROM {{source}}),
w1 AS (SELECT *, CASE WHEN ok4 THEN {four('paid')} END AS i_ttm, CASE WHEN link THEN (lag(debt) {W} + debt) / 2 END AS avg_debt,
  CASE WHEN ok4 THEN {div(four('tax_expense'), four('pretax_income'))} END AS t_raw, {div('market_cap', 'market_cap + debt')} AS w_e, {div('debt', 'market_cap + debt')} AS w_d FROM w0),
w2 AS (SELECT *, {div('i_ttm', 'avg_debt')} AS rd, CASE WHEN t_raw IS NOT NULL THEN greatest(0e0, t_raw) END AS t_ttm FROM w1),
w3 AS (SELECT *, w_e * (0.0425e0 + 0.03e0) + w_d * (rd * (1 - t_ttm)) AS wacc FROM w2),
w4 AS (SELECT *, CASE WHEN 1 + wacc >= 0 THEN sqrt(sqrt(1 + wacc)) - 1 END AS wacc_q FROM w3)"""
put("wacc_chain", SUPPLIER_FULL + "," + WACC.format(source="full_panel"), """
SELECT "KEY", i_ttm AS calc_interest_expense_ttm, avg_debt AS calc_wacc_average_debt, rd AS calc_wacc_cost_of_debt, t_ttm AS calc_wacc_tax_rate,
  w_e AS calc_wacc_equity_weight, w_d AS calc_wacc_debt_weight, wacc AS calc_wacc_annual, wacc_q AS calc_wacc_quarterly,
  post_annual - wacc AS calc_roic_minus_wacc_annualized, post - wacc_q AS calc_roic_minus_wacc_quarterly, post_annual - wacc > 0 AS calc_creates_value,
  0.0425e0 AS calc_wacc_risk_free_rate, 0.03e0 AS calc_wacc_equity_risk_premium, market_cap AS calc_wacc_equity_value,
  CASE WHEN NOT coalesce(ok4, false) THEN 'INSUFFICIENT_HISTORY' WHEN market_cap IS NULL THEN 'MISSING_MARKET_CAP' WHEN debt IS NULL THEN 'MISSING_DEBT'
    WHEN debt > 0 AND i_ttm = 0 THEN 'DEBT_WITHOUT_INTEREST' WHEN wacc IS NOT NULL THEN 'VALID' END AS calc_wacc_quality_flag FROM w4""")
put("ttm_sum", SUPPLIER_FULL, f"""
SELECT "KEY", CASE WHEN {OK4} THEN {four('free_cash_flow')} END AS calc_free_cash_flow_ttm,
  {div('entv', f'CASE WHEN {OK4} THEN {four("free_cash_flow")} END')} AS calc_ev_to_fcf_quarterly FROM full_panel""")
put("identity_checks", NOPAT + "," + WACC.format(source="np") + f", sh AS (SELECT *, {div('abs(c_e)', 'magnitude')} + {div('abs(c_q)', 'magnitude')} + {div('abs(c_i)', 'magnitude')} AS shares FROM w4)",
    battery([
        ("capital weights sum to one", "w_e + w_d IS NOT NULL", "w_e + w_d - 1", "1e-9"),
        ("quarterly WACC compounds to annual", "wacc_q IS NOT NULL", "((1 + wacc_q) * (1 + wacc_q)) * ((1 + wacc_q) * (1 + wacc_q)) - 1 - wacc", "1e-9"),
        ("three-factor residual is zero", "residual IS NOT NULL", "residual", "1e-9"),
        ("two-factor residual is zero", "n_change - (n_e + n_q) IS NOT NULL", "n_change - (n_e + n_q)", relative("n_change")),
        ("absolute shares sum to one", "shares IS NOT NULL", "shares - 1", "1e-9"),
        ("liabilities and equity sum to assets", "total_liabilities + equity - total_assets IS NOT NULL", "total_liabilities + equity - total_assets", "0.5e0"),
    ], "sh", {"capital weights sum to one": ("wacc", ""), "quarterly WACC compounds to annual": ("wacc", ""), "three-factor residual is zero": ("roic", ""),
              "two-factor residual is zero": ("nopat", ""), "absolute shares sum to one": ("roic", ""), "liabilities and equity sum to assets": ("balance", "")}))


def near(a: str, b: str) -> str:
    return f"abs(({a}) - ({b})) <= greatest(1e0, abs({b})) * 1e-6"


def jump(c: str) -> tuple[str, str, str, str]:
    before = f"{c}_before"
    return (f"No unexplained jump in {c}", f"abs({c} - {before}) IS NOT NULL",
            f"abs({c} - {before}) <= 1000 OR abs({c} - {before}) <= abs({before}) * 0.5e0", "Flags changes above 50% and 1,000.")


ONE = "Classified rows set one indicator; unclassified rows set none."
EFFICIENT = "Order-independent decomposition is exactly efficient."
CASH = "(cash_and_cash_equivalents + short_term_investments)"
BATTERY = [
    ("Current assets cover cash and short-term investments", f"total_current_assets IS NOT NULL AND {CASH} IS NOT NULL", f"total_current_assets >= {CASH}", ""),
    jump("goodwill"), jump("intangible_assets"), jump("net_ppe"), jump("short_term_investments"),
    ("Consecutive reporting periods", "prev_key_gap IS NOT NULL", "link", "Expected a gap of 60-130 days."),
    ("period_key is unique within ticker", "period_key IS NOT NULL", "same_key = 1", ""),
    ("Market capitalization is positive", "market_cap IS NOT NULL", "market_cap > 0", ""),
    ("Equity matches total assets less total liabilities", "true", near("equity", "total_assets - total_liabilities"), ""),
    ("Calculated debt matches short-term plus long-term debt", "debt IS NOT NULL", near("debt", "short_term_debt_and_capital_lease + long_term_debt_and_capital_lease"), ""),
    ("Calculated debt is non-negative", "debt IS NOT NULL", "debt >= 0", ""),
    ("Debt-to-equity ratio matches debt and stockholders equity", "de_file IS NOT NULL", near("de_file", "debt / nullif(total_stockholders_equity, 0)"), ""),
    ("Enterprise value matches its displayed inputs", "entv IS NOT NULL", near("entv", f"market_cap + debt - {CASH}"),
     "EV includes market capitalization plus debt, less cash and short-term investments."),
    ("Trailing-four-quarter FCF matches four consecutive quarters", "fcf4 IS NOT NULL", "true", ""),
    ("Quarter-end EV/FCF matches EV divided by trailing FCF", "entv / nullif(fcf4, 0) IS NOT NULL", "true", ""),
    ("NOPAT Shapley contributions sum to the total change", "n_change IS NOT NULL", near("n_e + n_q", "n_change"), EFFICIENT),
    ("Post-tax ROIC Shapley contributions sum to the total change", "change IS NOT NULL", near("c_e + c_q + c_i", "change"), EFFICIENT),
    ("NOPAT effect combination selects exactly one column", "true", "true", ONE),
    ("Raw movement combination selects exactly one column", "true", "true", ONE),
    ("ROIC effect combination selects exactly one column", "true", "true", ONE),
    ("ROIC absolute contribution shares sum to one", "magnitude > 0", near("(abs(c_e) + abs(c_q) + abs(c_i)) / magnitude", "1e0"), ""),
    ("ROIC offset ratio lies between zero and one", "magnitude > 0", "1 - abs(c_e + c_q + c_i) / magnitude BETWEEN -1e-9 AND 1 + 1e-9",
     "Guaranteed by the triangle inequality on the contributions."),
    ("WACC capital weights sum to one", "w_e IS NOT NULL AND w_d IS NOT NULL", near("w_e + w_d", "1e0"), ""),
    ("WACC matches its weights and component costs", "wacc IS NOT NULL", "true", "E/(D+E) x Re + D/(D+E) x Rd x (1-T)."),
    ("Quarterly WACC compounds back to the annual WACC", "wacc_q IS NOT NULL", near("((1 + wacc_q) * (1 + wacc_q)) * ((1 + wacc_q) * (1 + wacc_q)) - 1", "wacc"), ""),
    ("Value-creation verdict is the same annually and quarterly", "post_annual - wacc IS NOT NULL AND post - wacc_q IS NOT NULL",
     "(post_annual - wacc > 0) = (post - wacc_q > 0)", "Annualisation is monotonic, so the sign of the spread is invariant."),
]
put("rule_battery", MOVES + "," + WACC.format(source="labelled") + f""",
b AS MATERIALIZED (SELECT *, lag(goodwill) {W} AS goodwill_before, lag(net_ppe) {W} AS net_ppe_before, lag(short_term_investments) {W} AS short_term_investments_before,
  goodwill * 2 - net_ppe / 4 AS intangible_assets, lag(goodwill * 2 - net_ppe / 4) {W} AS intangible_assets_before,
  CASE WHEN ok4 THEN {four('free_cash_flow')} END AS fcf4, count(*) OVER (PARTITION BY symbol, period_key) AS same_key FROM w4)""",
    'SELECT "check", t AS n_tested, f AS n_failed, floor((t - f) * 100 / nullif(t, 0) * 10 + 0.5e0) / 10 AS pct_ok, n - t AS n_skipped, note FROM (' + " UNION ALL ".join(
        f"""SELECT '{name}' AS "check", count(*) AS n, count(*) FILTER ({tested}) AS t, count(*) FILTER (({tested}) AND NOT coalesce({holds}, false)) AS f, '{note}' AS note FROM b"""
        for name, tested, holds, note in BATTERY) + ")")

LEDGER = f"""{statements('supplier')},
ledger AS (
  SELECT k, lpad(k::VARCHAR, 9, '0') AS gvkey, 'T' || (k // 2)::VARCHAR || CASE WHEN k % 2 = 1 THEN '.1' ELSE '' END AS tic, 'T' || (k // 2)::VARCHAR AS base,
    q_ord AS q_src, CASE WHEN (k + q_ord) % 3 <> 0 THEN equity END AS teqq, CASE WHEN (k + q_ord) % 15 <> 0 THEN equity END AS seqq,
    sum(capx_c) OVER y / 1e2 AS capxy, sum(ocf_c) OVER y / 1e2 AS oancfy, * EXCLUDE (k, equity, q_ord)
  FROM statements WINDOW y AS (PARTITION BY k, (q_ord - k % 4) // 4 ORDER BY q_ord ROWS UNBOUNDED PRECEDING)),
keyed AS (SELECT *, {RULE_Q} AS q, {label(RULE_Q)} AS pk FROM ledger),
tied AS (SELECT *, q - lag(q) OVER g AS gap, date_diff('day', lag(fiscal_period_end_date) OVER g, fiscal_period_end_date) AS days,
    lag(capxy) OVER g AS capx0, lag(oancfy) OVER g AS ocf0 FROM keyed WINDOW g AS (PARTITION BY gvkey ORDER BY q)),
flow AS (SELECT *, coalesce(gap = 1 AND days BETWEEN 60 AND 130, false) AS ok FROM tied),
resets AS (SELECT gvkey, month(fiscal_period_end_date) AS m, count(*) AS n FROM flow WHERE ok AND capxy < capx0 GROUP BY ALL),
votes AS (SELECT gvkey, first(m ORDER BY n DESC, m) AS fiscal_q1_month, max(n) / sum(n) AS purity, CAST(sum(n) AS BIGINT) AS n_resets FROM resets GROUP BY gvkey)"""
NULLS = {"Future_Quarterly_Return": "DOUBLE", "Momentum_3Q": "DOUBLE", "sector": "VARCHAR", "valuations__per_share_data__month_end_stock_price": "DOUBLE",
         "valuations__per_share_data__shares_outstanding": "DOUBLE", "intangible_assets": "DOUBLE", "industry": "VARCHAR", "filing_date": "DATE",
         "valuations__ratios__debt_to_equity": "DOUBLE", "valuations__valuation_ratios__enterprise_value_to_fcf": "DOUBLE"}
put("schema_map", LEDGER, f"""
SELECT gvkey, tic, CASE WHEN k % 7 = 0 THEN 'I' ELSE 'A' END AS costat, total_current_assets, cash_and_cash_equivalents, short_term_investments,
  total_current_liabilities, short_term_debt_and_capital_lease AS short_term_debt, long_term_debt_and_capital_lease, goodwill, net_ppe, total_assets,
  teqq AS equity, seqq AS total_stockholders_equity, ebit, pretax_income, market_cap, company, fiscal_period_end_date, tax_provision, interest_expense,
  short_term_debt_and_capital_lease, CASE WHEN short_term_debt_and_capital_lease IS NOT NULL THEN 'PROXY_FROM_DLCQ' END AS short_term_debt_source,
  {', '.join(f'CAST(NULL AS {t}) AS "{n}"' for n, t in NULLS.items())} FROM ledger""")
put("liabilities_fallback", LEDGER, """
SELECT gvkey, fiscal_period_end_date, total_assets - coalesce(teqq, seqq) AS total_liabilities,
  teqq IS NULL AND seqq IS NOT NULL AS flag_total_liabilities_from_seqq FROM ledger""")
put("source_keys", LEDGER, """
SELECT gvkey, tic, base AS symbol, pk || '_' || tic AS "KEY", pk AS period_key, 1970 + q // 4 AS period_year, 'Q' || (q % 4 + 1)::VARCHAR AS period_quarter, q AS q_ord FROM keyed""")
put("fiscal_q1_vote", LEDGER, "SELECT gvkey, fiscal_q1_month, purity, n_resets FROM votes")
FLOW = "CASE WHEN month(fiscal_period_end_date) = fiscal_q1_month THEN {y} WHEN fiscal_q1_month IS NOT NULL AND ok THEN {y} - {y0} END"
put("ytd_to_quarter", LEDGER, f"""
SELECT gvkey, pk AS period_key, {FLOW.format(y='oancfy', y0='ocf0')} AS oancfy_quarterly, {FLOW.format(y='capxy', y0='capx0')} AS capxy_quarterly,
  {FLOW.format(y='oancfy', y0='ocf0')} - {FLOW.format(y='capxy', y0='capx0')} AS free_cash_flow
FROM flow LEFT JOIN votes USING (gvkey)""")
def yearly(c: str, y0: str) -> str:
    q = FLOW.format(y=c, y0=y0)
    return f"""SELECT '{c}' AS flow, count(*) FILTER (n = 4) AS years_tested, count(*) FILTER (n = 4 AND abs(s - ytd) <= 0.01e0) AS years_equal FROM (
    SELECT *, count(v) OVER f AS n, sum(v) OVER f AS s, q - min(q) OVER f AS span FROM (
      SELECT gvkey, q, {c} AS ytd, {q} AS v, (month(fiscal_period_end_date) - fiscal_q1_month + 12) % 12 = 9 AS last_one FROM flow LEFT JOIN votes USING (gvkey))
    WINDOW f AS (PARTITION BY gvkey ORDER BY q ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE last_one AND span = 3"""


put("flow_identity", LEDGER, yearly("oancfy", "ocf0") + " UNION ALL " + yearly("capxy", "capx0"))
put("quality_flags", f"""{FILINGS},
flows AS (SELECT gvkey, any_value(k) AS k, q_ord, max(day) AS day, sum(CAST(round(amount * 100) AS BIGINT)) AS cents FROM filings GROUP BY gvkey, q_ord),
year_to_date AS (SELECT *, sum(cents) OVER (PARTITION BY gvkey, (q_ord - k % 4) // 4 ORDER BY q_ord) AS ytd FROM flows),
steps AS (SELECT *, q_ord - lag(q_ord) OVER g AS gap, date_diff('day', lag(day) OVER g, day) AS days, lag(ytd) OVER g AS before
  FROM year_to_date WINDOW g AS (PARTITION BY gvkey ORDER BY q_ord))""", """
SELECT o_orderkey, count(*) OVER (PARTITION BY gvkey, period_key) > 1 AS flag_duplicate_period,
  min(gvkey) OVER (PARTITION BY symbol) <> max(gvkey) OVER (PARTITION BY symbol) AS flag_ticker_collision,
  o_orderkey % 3 = 0 AND o_orderkey % 15 <> 0 AS flag_total_liabilities_from_seqq,
  gvkey NOT IN (SELECT gvkey FROM steps WHERE gap = 1 AND days BETWEEN 60 AND 130 AND ytd < before) AS flag_fcf_fiscal_q1_unresolved,
  o_orderkey % 4 <> 0 AS flag_std_proxy, k % 7 = 0 AS flag_delisted, o_orderkey % 2 <> 0 AS flag_missing_market_cap FROM filings""")
FIELDS = [(n, c, "stored") for n, c in AUDITED.items() if n not in ("q_ord", "period_year")] + [(n, c, "full_panel") for n, c in AUDITED_FULL.items()]
put("field_crosscheck", STORED, """SELECT *, coalesce(correlation >= 0.95 AND median_ratio BETWEEN 0.99 AND 1.01, false) AS accepted FROM (""" + " UNION ALL ".join(
    f"""SELECT '{n}' AS field, count(*) AS n, {steady('corr(a, b)')} AS correlation, {steady('count(*) FILTER (abs((a - b) / nullif(b, 0)) <= 0.05e0) / nullif(count(nullif(b, 0)), 0)')} AS share_within_5pct,
      {steady('quantile_cont(a / nullif(b, 0), 0.5)')} AS median_ratio, {steady('quantile_cont(abs((a - b) / nullif(b, 0)), 0.5)')} AS median_relative_deviation
    FROM (SELECT symbol, period_key, {c} AS a FROM {source}) s
    JOIN (SELECT symbol, period_key, ({c}) * CASE WHEN q_ord % 5 = 0 THEN 1.1e0 ELSE 1e0 END AS b FROM full_panel) f USING (symbol, period_key) WHERE a IS NOT NULL AND b IS NOT NULL"""
    for n, c, source in FIELDS) + ")")


put("run_manifest", PREPARED, f"""SELECT m.*, {", ".join(f'l{i}.*' for i in (0, 1))}, n.*, r.*, g.* FROM
  (SELECT count(*) AS rows_raw, max(run_date) AS data_as_of, count(*) FILTER (pop) AS rows_population, count(*) FILTER (ev) AS rows_evaluation,
    {len(TEXT_COLUMNS)} AS columns_in_file FROM p) m, """ + ", ".join(
    f"""(SELECT level AS level_{i}, set_null_where_file_null AS set_null_where_file_null_{i}, null_where_file_has_value AS null_where_file_has_value_{i},
    {half_up('max_abs_dev_vs_rounded_file', 9)} AS max_abs_dev_{i} FROM ({ORACLE['level_report']}) WHERE level = '{n}') l{i}"""
    for i, n in enumerate(("roic_posttax_q", "roic_pretax_q"))) + f""",
  (SELECT 1 AS rows_run_notes, count(DISTINCT coalesce(status, '-')) AS rows_status FROM p) n, ({RETURNS_REPORT}) r, ({RANGES_REPORT}) g""")
put("automatic_notes", "", f"""
SELECT "column", 1 AS position, 'CSV value rounded to ' || max_decimals || ' decimals (' || n_distinct || ' distinct values)' AS note
FROM ({ORACLE['precision_audit']}) WHERE ratio_like_and_rounded
UNION ALL SELECT base_column, 2, 'identical duplicate ' || chr(39) || duplicate_column || chr(39) || ' in CSV (dropped=' || CASE WHEN identical THEN 'True' ELSE 'False' END || ')'
FROM ({ORACLE['duplicate_columns']})
UNION ALL SELECT unnest(['{LONG['pre']}', '{LONG['post']}', '{LONG['de_file']}']), 3, unnest([
  'research value: roic_pretax_q = ebit / {LONG['avg_ic']} (full precision)', 'research value: roic_posttax_q = {LONG['nopat']} / {LONG['avg_ic']} (full precision)',
  'research value: debt_to_equity_q = {LONG['debt']} / total_stockholders_equity'])
UNION ALL SELECT unnest(['run_date', 'market_cap', '{LONG['de_reported']}']), 3, unnest(['values [' || run_dates || ']; empty in SPY/QQQ rows',
  market_cap_zero || ' company rows exactly 0, ' || market_cap_negative || ' negative, ' || market_cap_null || ' empty',
  reported_zero_where_equity_null || ' zeros where total_stockholders_equity is empty']) FROM ({ORACLE['run_notes']})""")
put("clustered_panel", f"{PREPARED},{SECOND}", f"""
SELECT "KEY", symbol, q_ord, fiscal_period_end_date, ebit, {four('ebit')} AS ebit_sum, {named('prev_key_gap', 'prev_day_gap', 'link')},
  as_of_day AS "As_Of_Date", fr_s AS fqr_price, mom_s AS mom_price FROM both_sides""")
put("positional_sample", STATEMENTS, """
SELECT "KEY", position FROM (SELECT "KEY", row_number() OVER (ORDER BY symbol, q_ord) - 1 AS position, count(*) OVER () AS n FROM statements)
WHERE position = 0 OR position % 4 = 1 OR position >= n - 2""")

# --- content digests ---------------------------------------------------------------------

# Columns of the digested tables by the form of their text: as it is, in millionths, in microseconds.
DIGESTED = {
    "region": [("r_regionkey", "s"), ("r_name", "s")],
    "nation": [("n_nationkey", "s"), ("n_name", "s"), ("n_regionkey", "s")],
    "customer": [("c_custkey", "s"), ("c_name", "s"), ("c_nationkey", "s"), ("c_acctbal", "d"), ("c_mktsegment", "s")],
    "supplier": [("s_suppkey", "s"), ("s_name", "s"), ("s_nationkey", "s"), ("s_acctbal", "d")],
    "part": [("p_partkey", "s"), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"), ("p_size", "s"), ("p_retailprice", "d")],
    "orders": [("o_orderkey", "s"), ("o_custkey", "s"), ("o_orderstatus", "s"), ("o_totalprice", "d"), ("o_orderdate", "t"), ("o_orderpriority", "s")],
    "lineitem": [("l_orderkey", "s"), ("l_partkey", "s"), ("l_suppkey", "s"), ("l_linenumber", "s"), ("l_quantity", "d"), ("l_extendedprice", "d"),
                 ("l_discount", "d"), ("l_tax", "d"), ("l_returnflag", "s"), ("l_linestatus", "s"), ("l_shipdate", "t")],
    "events": [("event_id", "s"), ("ts", "t"), ("user_id", "s"), ("event_type", "s"), ("value", "d"), ("props", "s")],
    "documents": [("doc_id", "s"), ("text", "s"), ("lang", "s"), ("source", "s"), ("n_chars", "s")],
    "pages": [("page_id", "s"), ("url", "s"), ("html", "s")],
}
FORMS = {"s": "CAST({c} AS VARCHAR)", "d": "CAST(CAST(round({c} * 1e6) AS DECIMAL(38, 0)) AS VARCHAR)", "t": "CAST(epoch_us({c}) AS VARCHAR)"}


def digest(table: str, source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(v) AS n_values,
          CAST(coalesce(sum(CAST(CAST('0x' || substr(md5(v), 1, 12) AS BIGINT) AS DECIMAL(38, 0))), 0) AS VARCHAR) AS checksum
        FROM (SELECT {FORMS[f].format(c=c)} AS v FROM {source})"""
        for c, f in DIGESTED[table]
    )


put("file_fingerprints", "", " UNION ALL ".join(f"SELECT '{t}' AS file, * FROM ({digest(t, t)})" for t in DIGESTED))
STATES = {
    "priced": "SELECT * REPLACE (CASE WHEN o_orderkey % 100 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders",
    "fewer": "SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'",
    "same": "SELECT * FROM orders",
}
put("fingerprint_diff", "", " UNION ALL ".join(
    f"""SELECT '{n}' AS state, b."column", b.n_rows AS rows_before, a.n_rows AS rows_after, b.n_rows = a.n_rows AND b.n_values = a.n_values AND b.checksum = a.checksum AS unchanged
    FROM ({digest('orders', 'orders')}) b JOIN ({digest('orders', f'({sql})')}) a ON a."column" = b."column" """ for n, sql in STATES.items()))
