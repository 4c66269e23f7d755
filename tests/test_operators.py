"""Quantiles, checks, catalogue, larger-source mapping and the audit run on small inputs."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterglass.functions import measures as M
from quarterglass.functions import text as X
from quarterglass.operators import catalogue as K
from quarterglass.operators import formulas as FO
from quarterglass.operators import fundamentals as FU
from quarterglass.operators import source_mapping as SM
from quarterglass.operators.columns import reconcile_columns
from quarterglass.operators.quantiles import count_distinct_by, exact_quantiles, grid_cell
from quarterglass.settings import DEFAULTS as S


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=30_000)
    b = rng.integers(0, 5, 30_000).astype(float)  # heavy repeats
    b[:10_000] = 2.0  # one value holds a third of the rows
    c = [None] * 29_999 + [4.0]
    rows = [(float(x), float(y), z) for x, y, z in zip(a, b, c)]
    frame = spark.createDataFrame(rows, "a double, b double, c double").repartition(7)
    p = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {(r.feature, r.p): r.quantile for r in exact_quantiles(frame, ["a", "b", "c"], p).collect()}
    for q in p:
        assert got["a", q] == pytest.approx(np.quantile(a, q), abs=1e-12)
        assert got["b", q] == pytest.approx(np.quantile(b, q), abs=1e-12)
        assert got["c", q] == 4.0
    counts = {r.feature: (r.n, r.n_distinct) for r in count_distinct_by(frame, ["a", "b", "c"]).collect()}
    assert counts == {"a": (30_000, 30_000), "b": (30_000, 5), "c": (1, 1)}


def test_grid_cells_keep_the_order(spark):
    rng = np.random.default_rng(5)
    edges = [2.0**k for k in range(-60, 60)]
    values = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000), edges, np.nextafter(edges, 0), [0.0, 5e-324]])
    values = np.concatenate([values, -values])
    frame = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", grid_cell(F.col("v")).alias("c"))
    rows = sorted((r.v, r.c) for r in frame.collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))
    small = frame.withColumn("v", F.col("v"))
    got = {r.p: r.quantile for r in exact_quantiles(small, ["v"], [0.1, 0.5, 0.77]).collect()}
    for p, quantile in got.items():
        assert quantile == pytest.approx(np.quantile(values, p), rel=1e-9)


def test_quantiles_of_an_empty_column(spark):
    frame = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    got = {(r.feature, r.p): r.quantile for r in exact_quantiles(frame, ["a", "b"], [0.5]).collect()}
    assert got == {("b", 0.5): 1.5}


@pytest.mark.parametrize("values,expected", [([1.0, 2.5, 3.25], 2), ([1.0, 2.0], 0), ([1 / 3], 9), ([None], -1)])
def test_decimals_needed(spark, values, expected):
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert frame.agg(M.decimals_needed(F.col("v"), 9).alias("d")).first().d == expected


def test_half_up_and_split(spark):
    row = spark.range(1).select(
        M.half_up(F.lit(0.125), 2).alias("a"), M.half_up(F.lit(3e300), 6).alias("b"), M.half_up(F.lit(-0.125), 2).alias("c")
    )
    assert tuple(row.first()) == (0.13, 3e300, -0.12)
    parts = M.three_factor_split(*[F.lit(v) for v in (10.0, 12.0, 0.8, 0.7, 100.0, 90.0)])
    total = spark.range(1).select(M.total(list(parts)).alias("t")).first().t
    assert total == pytest.approx(12 * 0.7 / 90 - 10 * 0.8 / 100, abs=1e-15)


def test_summarise_counts_null_deviation_as_untested_and_null_tolerance_as_failed(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (0.0, None), (None, 1.0), (3.0, 1.0)], "d double, t double")
    check = FO.Check("x", "ref", F.lit(True), F.col("d"), F.col("t"))
    exact = FO.Check("y", "ref", F.col("d").isNotNull(), passes=F.col("d") > 0)
    out = {r.check: r for r in FO.summarise(rows, [check, exact]).collect()}
    assert (out["x"].n_tested, out["x"].n_pass, out["x"].max_abs_dev, out["x"].median_abs_dev) == (3, 1, 3.0, 1.0)
    assert (out["y"].n_tested, out["y"].n_pass, out["y"].tolerance) == (3, 2, "exact")
    table = FO.summarise(rows, [check, exact])
    assert FO.failing(table).count() == 2 and not FO.gate(table).first().all_pass


BLOCKS = [
    (1, 0, "p", "Heading 1", "Intro words", None),
    (1, 1, "p", "Normal", "It has 3 עמודות", None),
    (1, 2, "p", "Heading 2", "More", None),
    (1, 3, "p", "Normal", "6.1 Status and change", None),
    (1, 4, "table", "", "", [["עמודה", "טיפוס", "חישוב"], ["calc_roic_quality_flag", "text", "f"], ["Bad Name", "", ""]]),
    (1, 5, "p", "Heading 2", "Details", None),
    (1, 6, "table", "", "", [["עמודה", "משמעות"], ["calc_roic_business_classification", "NaN when 1.5 x. fine"], ["calc_roic_quality_flag", "again"]]),
    (1, 7, "p", "Normal", "הערכים של calc_roic_business_classification", None),
    (1, 8, "p", "Normal", "GROWTH_LED · some · GROWTH_LED — TAX_LED · ABC", None),
    (1, 9, "p", "Normal", "calc_nopat_combo__ebit_pos__tax_neg", None),
    (1, 10, "table", "", "", [["קבוצה", "כמות"], ["a", "2"], ["b", "1"], ["c", "x"]]),
]


@pytest.fixture()
def blocks(spark):
    return spark.createDataFrame(
        BLOCKS, "doc_id long, block_no int, kind string, style string, text string, rows array<array<string>>"
    )


def test_sections(blocks):
    got = {r.block_no: r.section for r in K.section_fill(blocks).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 5, 6)] == [
        "Intro words", "Intro words", "Intro / More", "6.1 Status and change", "6.1 Status and change", "6.1 / Details", "6.1 / Details",
    ]


def test_catalogue(blocks):
    got = {r.variable: r for r in K.catalogue(blocks).collect()}
    assert set(got) == {"calc_roic_quality_flag", "calc_roic_business_classification", "calc_nopat_combo__ebit_pos__tax_neg"}
    flag = got["calc_roic_quality_flag"]
    assert (flag.section, flag.formula, flag.unit, flag.is_quality_or_status_flag) == (
        "6.1 Status and change", "f", "category / text", True,
    )
    assert flag.invalid_or_caveat_conditions.startswith("VALID only when")
    business = got["calc_roic_business_classification"]
    assert business.possible_values == "GROWTH_LED · TAX_LED" and business.invalid_or_caveat_conditions == "NaN when 1.5 x"
    declared = K.declared_vs_found(blocks, K.catalogue(blocks)).first()
    assert (declared.declared_total, declared.declared_in_groups, declared.extracted) == (3, 3, 3)


def test_carry_forward_crosses_run_boundaries(spark):
    rows = spark.range(5000).select(F.lit(1).alias("doc_id"), F.col("id").alias("block_no"))
    value = F.when(F.col("block_no").isin(3, 777, 4000), F.col("block_no"))
    out = {r.block_no: r.v for r in K.carry_forward(rows, value, "v", chunk=64).collect()}
    assert out[2] is None and out[3] == 3 and out[776] == 3 and out[3999] == 777 and out[4999] == 4000


def test_table_numbers_cross_run_boundaries(spark):
    rows = spark.range(3000).selectExpr("id % 2 AS doc_id", "id div 2 AS block_no", "CASE WHEN id div 2 % 7 = 3 THEN 'table' ELSE 'p' END AS kind")
    out = K.running_count(rows, F.col("kind") == "table", "n", chunk=64).collect()
    assert all(r.n == (r.block_no + 4) // 7 for r in out) and len(out) == 3000
    numbers = [r.table_no for r in K.number_tables(rows.filter("doc_id = 0")).orderBy("block_no").collect()]
    assert [n for n in numbers if n] == list(range(1, 215)) and numbers.count(None) == 1500 - 214


def test_records_and_text_have_table_numbers(blocks):
    got = {r.variable: r.table_no for r in K.catalogue(blocks, {"calc_roic_quality_flag": "own words"}).collect()}
    assert got == {"calc_roic_quality_flag": 1, "calc_roic_business_classification": 2, "calc_nopat_combo__ebit_pos__tax_neg": None}
    lines = K.text_rebuild(blocks).first().text.split("\n")
    assert lines[4:6] == ["=== TABLE 1 ===", "עמודה | טיפוס | חישוב"] and "=== TABLE 3 ===" in lines and lines.count("=== END TABLE ===") == 3


def test_text_helpers(spark):
    row = spark.range(1).select(X.clean_text(F.lit("‏ a \t b‪ ")).alias("t")).first()
    assert row.t == "a b"


def test_reconcile(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "2")], "variable string, section string")
    have = spark.createDataFrame([("a",), ("a.1",), ("z",)], "column string")
    copies = spark.createDataFrame([("a.1", "a")], "duplicate_column string, base_column string")
    got = {r.column: r.status for r in reconcile_columns(docs, have, copies).collect()}
    assert got == {"a": "matched", "b": "dictionary_only", "a.1": "file_only: duplicate of a", "z": "file_only: undocumented"}


def test_reconciled_names_keep_both_orders(spark):
    docs = spark.createDataFrame([("b", "2", 7), ("q", "1", 9), ("a", "1", 8)], "variable string, section string, position long")
    have = spark.createDataFrame([("z", 0), ("a", 1), ("y", 2), ("b", 3)], "column string, position long")
    copies = spark.createDataFrame([], "duplicate_column string, base_column string")
    rows = reconcile_columns(docs, have, copies).orderBy("position").collect()
    assert [(r.position, r.column) for r in rows] == [(1, "b"), (2, "a"), (3, "q"), (4, "z"), (5, "y")]


def ledger(spark, values, start=dt.date(2019, 9, 30)):
    days = [start, dt.date(2019, 12, 31), dt.date(2020, 3, 31), dt.date(2020, 6, 30), dt.date(2020, 9, 30)]
    rows = [("1", f"A.{i}", d, v) for i, (d, v) in enumerate(zip(days, values))]
    keyed = SM.add_keys(spark.createDataFrame(rows, "gvkey string, tic string, fiscal_period_end_date date, capxy double"))
    return SM.link_filings(keyed, S.sequence)


def test_year_to_date_becomes_quarterly(spark):
    rows = ledger(spark, [5810.0, 11675.0, 17015.0, 23886.0, 5810.0])
    votes = SM.fiscal_q1_vote(rows)
    assert (votes.first().fiscal_q1_month, votes.first().purity) == (9, 1.0)
    flows = SM.ytd_to_quarter(rows, votes, ["capxy"]).orderBy("q_ord").collect()
    assert [r.capxy_quarterly for r in flows] == [5810.0, 5865.0, 5340.0, 6871.0, 5810.0]
    assert flows[0].symbol == "A" and flows[0].KEY == "2019Q3_A.0"


def test_unknown_first_quarter_stays_null(spark):
    rows = ledger(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    flows = SM.ytd_to_quarter(rows, SM.fiscal_q1_vote(rows), ["capxy"]).collect()
    assert all(r.capxy_quarterly is None for r in flows)


def test_february_belongs_to_the_previous_year(spark):
    row = spark.createDataFrame([("1", "X", dt.date(2017, 2, 28))], "gvkey string, tic string, fiscal_period_end_date date")
    assert SM.add_keys(row).first().period_key == "2016Q4"


def test_indicator_names():
    names = FU.combo_names()
    assert sum(len(v) for v in names.values()) == 63
    assert "calc_raw_combo__ebit_up__tax_down__ic_flat" in names["calc_raw_movement_combination"]


def test_materiality(spark):
    row = spark.range(1).select(
        M.materiality(F.lit(-200.0), 1.0, 0.01).alias("a"), M.materiality(F.lit(10.0), 1.0, 0.01).alias("b")
    )
    assert tuple(row.first()) == (2.0, 1.0)


def test_audit_run_writes_every_table(spark, sf_dir, tmp_path):
    from quarterglass.plans.audit_run import SecondSource, run_audit
    from quarterglass.sources import trade_panel as TP

    catalogue = K.catalogue(TP.part_blocks(spark, sf_dir)).select("variable", "meaning", "section").dropDuplicates(["variable"])
    catalogue = catalogue.withColumn("position", F.crc32(F.col("variable").cast("binary")))
    concepts = spark.createDataFrame(
        [("return", None, "Future_Quarterly_Return", None), ("roic", None, "calc_roic_posttax_quarterly_ic_raw", "by hand"), ("goodwill", "x", "goodwill", None)],
        "concept string, dictionary string, column string, note string",
    )
    full = TP.full_precision(spark, sf_dir)
    second = SecondSource(TP.price_sheet(spark, sf_dir), full)
    done = run_audit(
        spark, TP.panel(spark, sf_dir), TP.ranges(spark, sf_dir), str(tmp_path), catalogue=catalogue, second=second,
        verify_source=True, text=TP.panel_text(spark, sf_dir), concepts=concepts, rules=lambda rows: FO.failing(FO.formula_checks(rows, S)),
    )
    assert len(done) == 34
    read = lambda name: spark.read.option("header", True).csv(f"{tmp_path}/tables/{name}")
    status = {r.column: r.status for r in read("column_reconciliation_full").collect()}
    assert status["market_cap.1"] == "file_only: duplicate of market_cap" and status["ebit"] == "file_only: undocumented"
    notes = {r.research_concept: r.notes or "" for r in read("column_mapping").collect()}
    assert "research value: roic_posttax_q" in notes["roic"] and notes["roic"].endswith("by hand") and "NOT found" in notes["goodwill"]
    assert "identical duplicate 'goodwill.1' in CSV (dropped=False)" in notes["goodwill"] and read("load_report").count() == 1
    flow = spark.read.option("header", True).csv(f"{tmp_path}/tables/sample_flow").collect()
    assert len(flow) == 13 and int(max(r.rows for r in flow if r.step.startswith("1 "))) == full.count()
    manifest = spark.read.json(f"{tmp_path}/logs/run_manifest").first()
    assert manifest.relevance_report.n_ranges > 0 and manifest.data_as_of == "2001-12-01" and manifest.columns_in_file == 63
    rows = {t.table: t.rows for t in manifest.tables}
    assert set(rows) == {*done, "panel_prepared"} and rows["panel_prepared"] == full.count() and rows["sample_flow"] == 13
    assert all(rows[name] == read(name).count() for name in ("sequence_breaks", "benchmarks", "precision_audit"))
    assert len(manifest.level_report) == 2 and {s.column for s in manifest.sources} >= {"KEY", "ebit"}


def test_audit_run_saves_duplicates_and_stops(spark, sf_dir, tmp_path):
    from quarterglass.plans.audit_run import run_audit
    from quarterglass.sources import trade_panel as TP

    raw = TP.panel(spark, sf_dir)
    twice = raw.union(raw.orderBy("KEY").limit(2))
    with pytest.raises(ValueError, match="rows share"):
        run_audit(spark, twice, TP.ranges(spark, sf_dir), str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/tables/duplicate_rows").count() == 4


def test_quantiles_of_values_in_one_cell(spark):
    """A million distinct values within 2 ** -19 of each other; no window partition holds more than a grid level."""
    from quarterglass.operators.quantiles import _PARTS, cell_part, exact_quantiles, grid_cell

    rows = spark.range(1_000_000).selectExpr("1 + id * 1e-12 AS v", "-(1 + id * 1e-12) AS w")
    cells = rows.select(grid_cell(F.col("v")).alias("c"), cell_part(F.col("v")).alias("s"), "v")
    assert cells.select("c").distinct().count() == 1
    assert cells.groupBy("c", "s").agg(F.count_distinct("v").alias("n")).agg(F.max("n")).first()[0] <= 2**_PARTS
    assert cells.agg(F.count_distinct("s")).first()[0] > 8
    found = {(r.feature, r.p): r.quantile for r in exact_quantiles(rows, ["v", "w"], [0.0, 0.25, 1.0]).collect()}
    assert found["v", 0.0] == 1 and found["v", 1.0] == 1 + 999_999 * 1e-12 and found["w", 0.0] == -(1 + 999_999 * 1e-12)
    low, high = 1 + 249_999 * 1e-12, 1 + 250_000 * 1e-12
    assert low <= found["v", 0.25] <= high


def executed_nodes(frame):
    """Names of the nodes of the plan as it ran, those behind a reused exchange left out."""
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.findall(r"^[\s:+|*()\d-]*([A-Z]\w+)", text, re.M)


def test_quantiles_read_their_source_once(spark, tmp_path):
    spark.range(40_000).selectExpr("sin(id) AS a", "id % 7 * 1.5 AS b", "id").write.parquet(f"{tmp_path}/t")
    frame = spark.read.parquet(f"{tmp_path}/t")
    nodes = executed_nodes(exact_quantiles(frame, ["a", "b"], [0.01, 0.5, 0.99]))
    assert nodes.count("FileScan") == 1 and nodes.count("Exchange") <= 6 and nodes.count("ReusedExchange") == 1
    assert nodes.count("Window") == 4 and nodes.count("SortMergeJoin") == 0


@pytest.mark.parametrize("name", ["crosscheck", "formula_checks", "report_scalars", "feature_summary", "field_crosscheck", "precision_audit", "return_alignment"])
def test_queries_start_no_job_when_they_are_planned(name, spark, sf_dir):
    from workload.queries import REGISTRY

    spark.sparkContext.setJobGroup(f"plan-{name}", "planning")
    REGISTRY[name](spark, sf_dir)
    spark.sparkContext._jsc.clearJobGroup()
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(f"plan-{name}") for s in tracker.getJobInfo(j).stageIds]
    # reading the schema of a Parquet file is a job of one task
    assert all(tracker.getStageInfo(s).numTasks == 1 for s in stages)
