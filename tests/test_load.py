import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarterglass.settings import DEFAULTS as S
from quarterglass.sources import panel_text as PT
from quarterglass.sources.fingerprints import content_digest, digest_diff, require_unchanged
from quarterglass.sources.ranges import load_ranges, ranges_load_report

CSV = """KEY,symbol,period_key,fiscal_period_end_date,filing_date,run_date,ebit,market_cap,market_cap
2020Q1_NA,NA,2020Q1,2020-03-31,,2026-09-05,,5,5
2020Q2_NA,NA,2020Q2,31/06/2020,2020-08-01,2026-09-05,1.5,,
2020Q3_NULL,NULL,2020Q3,30/09/2020,bad-date,2026-09-05,0,7,7
"""


@pytest.fixture()
def path(tmp_path):
    file = tmp_path / "panel.csv"
    file.write_text(CSV)
    return str(file)


def names():
    return PT.repeated_headers(CSV.splitlines()[0].split(","))


def test_headers():
    assert names()[-2:] == ["market_cap", "market_cap.1"]
    assert PT.duplicate_pairs(names()) == [("market_cap.1", "market_cap")]


def test_panel_load(spark, path):
    panel = PT.load_panel(spark, path, names(), S.load, ["ebit", "market_cap"])
    rows = sorted(panel.collect(), key=lambda r: r.KEY)
    assert [r.symbol for r in rows] == ["NA", "NA", "NULL"] and "market_cap.1" not in panel.columns
    assert [r.ebit for r in rows] == [None, 1.5, 0.0]
    assert [r.fiscal_period_end_date for r in rows] == [dt.date(2020, 3, 31), None, dt.date(2020, 9, 30)]
    assert rows[1].fiscal_period_end_date_raw == "31/06/2020" and rows[2].filing_date is None
    assert [r.q_ord for r in rows] == [200, 201, 202]


def test_reports(spark, path):
    text = PT.read_csv_text(spark, path, names())
    report = {r.column: r for r in PT.dates_report(text, dict(S.load.date_formats)).collect()}
    fiscal, filing = report["fiscal_period_end_date"], report["filing_date"]
    assert (fiscal.format_1, fiscal.format_2, fiscal.n_unparsable, fiscal.unparsable_examples) == (1, 1, 1, "31/06/2020")
    assert (filing.n_missing_or_empty, filing.n_unparsable, filing.unparsable_examples) == (1, 1, "bad-date")
    assert PT.load_report(text, S.load).first().na_like_tickers == 3
    assert PT.duplicate_columns(text).first().identical


def test_differing_copy_is_kept(spark, tmp_path):
    file = tmp_path / "p.csv"
    file.write_text("KEY,symbol,period_key,ebit,ebit\nk,A,2020Q1,1,2\n")
    panel = PT.load_panel(spark, str(file), ["KEY", "symbol", "period_key", "ebit", "ebit.1"], S.load, ["ebit"])
    assert "ebit.1" in panel.columns


def test_ranges_keep_file_order(spark, tmp_path):
    lines = [f"T{i},2010Q{i % 4 + 1},{'' if i % 2 else '2012Q1'}" for i in range(50)]
    (tmp_path / "r.csv").write_text("ticker,start_quarter,end_quarter\n" + "\n".join(lines) + "\nBAD,2010Q9,x\n")
    ranges = load_ranges(spark, str(tmp_path / "r.csv"), S.load)
    rows = sorted(ranges.collect(), key=lambda r: r.range_id)
    assert [r.range_id for r in rows] == list(range(51)) and [r.ticker for r in rows[:50]] == [f"T{i}" for i in range(50)]
    report = ranges_load_report(ranges).first()
    assert (report.n_rows, report.n_open_end, report.n_invalid_start, report.n_invalid_end) == (51, 25, 1, 1)


def test_digest_shows_the_changed_column(spark):
    rows = spark.range(1000).selectExpr("id", "id / 7 AS part", "cast(id AS string) AS name", "timestamp_micros(id) AS at", "array(id) AS own")
    before = content_digest(rows)
    assert all(r.unchanged for r in digest_diff(before, content_digest(rows.repartition(7))).collect())
    changed = rows.withColumn("name", F.when(F.col("id") == 5, None).otherwise(F.col("name")))
    assert {r.column for r in digest_diff(before, content_digest(changed)).filter("NOT unchanged").collect()} == {"name"}
    with pytest.raises(RuntimeError, match="id"):
        require_unchanged(before, content_digest(rows.limit(999)))
