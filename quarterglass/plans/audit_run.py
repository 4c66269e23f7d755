"""The whole run: prepare the panel once, then every audit table from the written panel."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterglass.operators import columns, coverage, crosscheck, evidence, formulas, funnel, profile, uniqueness
from quarterglass.operators.layers import benchmark_series, research_view
from quarterglass.operators.membership import empty_ranges, expand_members, validate_ranges
from quarterglass.plans.research_panel import prepared_panel
from quarterglass.plans.run_summary import run_manifest, run_notes
from quarterglass.settings import DEFAULTS, PanelSettings
from quarterglass.sources.fingerprints import content_digest, require_unchanged
from quarterglass.sources.panel_text import dates_report, duplicate_columns, load_report
from quarterglass.sources.sinks import save_manifest, save_panel, save_table


@dataclass(frozen=True)
class SecondSource:
    """Tables of the cross-check: prices, full-precision values, download manifest."""

    price: DataFrame
    data: DataFrame
    manifest: DataFrame | None = None


def audit_tables(
    panel: DataFrame,
    ranges: DataFrame,
    settings: PanelSettings = DEFAULTS,
    catalogue: DataFrame | None = None,
    second: SecondSource | None = None,
    file_columns: list[str] | None = None,
    text: DataFrame | None = None,
    concepts: DataFrame | None = None,
    rules: Callable[[], DataFrame] | None = None,
) -> dict[str, Callable[[], DataFrame]]:
    """Report name -> function that plans it. ``panel`` should be a stored table: all reports read it.

    ``file_columns`` are the columns of the source file, by default those of the panel. With ``text``, the file as it was
    read, there are load reports and the real copies of columns; with ``concepts`` and a catalogue the column mapping.
    """
    file_columns = file_columns or panel.columns
    s, c = settings, settings.columns
    stocks, population = panel.filter(~F.col("is_benchmark")), panel.filter("in_population")
    bounds = coverage.study_window(stocks).first()
    members = expand_members(ranges, s.membership, bounds.first_ord, bounds.last_ord)
    covered = coverage.coverage_by_quarter(members, stocks)
    manifest = second.manifest if second else None
    measured = [n for n in profile.numeric_columns(panel) if n in file_columns and n != "q_ord"]
    tied = [c.roic_pretax_file, "roic_pretax_q", c.roic_posttax_file, "roic_posttax_q", s.trend.main_trend]
    tables: dict[str, Callable[[], DataFrame]] = {
        "coverage_firms_per_quarter": lambda: funnel.firms_per_quarter(panel),
        "coverage_quarters_per_firm": lambda: funnel.quarters_per_firm(panel),
        "duplicates_check": lambda: uniqueness.duplicates_report(panel),
        "sequence_breaks": lambda: funnel.sequence_breaks(panel, s),
        "consecutiveness_vs_pipeline": lambda: funnel.consecutive_agreement(panel, s),
        "precision_audit": lambda: profile.precision_audit(panel, measured, s.precision),
        "dictionary_formula_checks": lambda: formulas.formula_checks(panel, s),
        "return_window_verification": lambda: evidence.return_alignment(panel, s),
        "filing_lag_summary": lambda: profile.filing_lag_summary(panel, s),
        "filing_lag_by_year": lambda: profile.filing_lag_by_year(panel, s),
        "signal_lag_by_fiscal_month": lambda: profile.signal_lag_by_month(panel, s),
        "relevance_coverage_by_quarter": lambda: covered,
        "relevance_members_missing_from_panel": lambda: coverage.missing_members(
            ranges, stocks, F.lit(bounds.first_ord), s.membership, manifest
        ),
        "relevance_reused_tickers": lambda: coverage.reused_tickers(ranges, stocks),
        "relevance_empty_ranges_under_rule": lambda: empty_ranges(ranges, s.membership),
        "relevance_members_expanded": lambda: members,
        "sample_flow": lambda: funnel.sample_flow(panel),
        "sample_flow_by_quarter": lambda: funnel.sample_flow_by_quarter(panel),
        "feature_summary_population": lambda: profile.feature_summary(population, s.trend.numeric_features()),
        "signal_funnel_by_quarter": lambda: funnel.signal_funnel(panel, covered, s),
        "roic_missing_reasons": lambda: funnel.missing_reasons(panel, s),
        "roic_missing_reasons_by_sector": lambda: funnel.missing_by_sector(panel, s),
        "ties_by_quarter": lambda: profile.ties_by_quarter(population, tied),
        "panel_research_view": lambda: research_view(panel, s),
        "benchmarks": lambda: benchmark_series(panel, s),
    }
    if rules is not None:
        tables["rule_battery"] = rules
    copies = duplicate_columns(text) if text is not None else None
    if text is not None:
        tables["load_report"] = lambda: load_report(text, s.load)
        tables["date_formats"] = lambda: dates_report(text, dict(s.load.date_formats))
        tables["duplicate_columns"] = lambda: copies
    if catalogue is not None:
        session = panel.sparkSession
        present = session.createDataFrame(list(enumerate(file_columns)), "position long, column string")
        if copies is None:
            copies = session.createDataFrame([], "duplicate_column string, base_column string, identical boolean")
        tables["return_field_candidates"] = lambda: profile.field_candidates(panel, file_columns, catalogue)
        tables["column_reconciliation_full"] = lambda: columns.reconcile_columns(catalogue, present, copies)
        if concepts is not None:
            derived = session.createDataFrame([(n,) for n in s.trend.feature_columns()], "column string")
            precision = lambda: profile.precision_audit(panel, measured, s.precision)
            tables["column_mapping"] = lambda: columns.column_mapping(
                concepts, catalogue, present, derived, columns.automatic_notes(precision(), copies, run_notes(stocks, s), c)
            )
    if second is not None:
        tables["crosscheck_summary"] = lambda: crosscheck.crosscheck(panel, second.price, second.data, c)
        tables["full_precision_formula_checks"] = lambda: formulas.full_precision_checks(second.data, c)
    return tables


def run_audit(
    spark: SparkSession,
    raw: DataFrame,
    ranges: DataFrame,
    out_dir: str,
    settings: PanelSettings = DEFAULTS,
    catalogue: DataFrame | None = None,
    second: SecondSource | None = None,
    verify_source: bool = False,
    parallel: int = 4,
    text: DataFrame | None = None,
    concepts: DataFrame | None = None,
    rules: Callable[[DataFrame], DataFrame] | None = None,
) -> list[str]:
    """Write panel, tables and manifest under ``out_dir``; returns the table names.

    The panel is written first and read back, so the reports share one scan
    format and a lost executor costs a re-read, not a rebuild. Reports are
    independent jobs and run ``parallel`` at a time. Rows that share a key are
    saved before the run stops on them. ``verify_source`` digests ``raw`` before
    and after and stops if it changed meanwhile. ``rules`` makes a further table
    of the stored panel, such as a rule battery. Every write counts its rows,
    and the manifest has these counts.
    """
    if verify_source:
        content_digest(raw).write.mode("overwrite").parquet(f"{out_dir}/logs/source_digest")
    keys = ("symbol", "q_ord")
    validate_ranges(ranges, settings.membership)
    if uniqueness.key_counts(raw, keys).limit(1).count():  # reads the keys only
        save_table(uniqueness.duplicated_rows(raw, keys), f"{out_dir}/tables/duplicate_rows")
        uniqueness.require_unique(raw, keys)
    counts = {"panel_prepared": save_panel(prepared_panel(raw, ranges, settings), f"{out_dir}/data/panel_prepared")}
    panel = spark.read.parquet(f"{out_dir}/data/panel_prepared")
    file_columns = text.columns if text is not None else raw.columns
    battery = (lambda: rules(panel)) if rules else None
    tables = audit_tables(panel, ranges, settings, catalogue, second, file_columns, text, concepts, battery)
    with ThreadPoolExecutor(parallel) as pool:
        rows = pool.map(lambda name: save_table(tables[name](), f"{out_dir}/tables/{name}"), tables)
        counts |= dict(zip(tables, rows, strict=True))
    digest = spark.read.parquet(f"{out_dir}/logs/source_digest") if verify_source else None
    save_manifest(run_manifest(panel, ranges, settings, len(file_columns), counts, digest), f"{out_dir}/logs/run_manifest")
    if verify_source:
        require_unchanged(digest, content_digest(raw))
    return list(tables)
