"""Records with a rescue column, tables clustered by entity, and positions in an ordered table."""

import pytest
from pyspark.sql import functions as F

from quarterglass.operators import positions as PO
from quarterglass.operators import sequence as SE
from quarterglass.operators.crosscheck import with_prices_by_entity
from quarterglass.settings import DEFAULTS as S
from quarterglass.sources import csv_lines as CL
from quarterglass.sources import panel_text as PT
from quarterglass.sources import trade_panel as TP
from quarterglass.sources.sinks import save_clustered, save_table


def test_records_parse_or_are_rescued_whole(spark):
    good = ['1, a b ,NA', '2,"x, ""y""\nz\r\n",NULL', '3,"",', ",,"]
    bad = ["4,too few", "5,a,b,too many", '6,"open quote,b', "7"]
    lines = spark.createDataFrame([(t,) for t in [*good, *bad, None]], "line string").repartition(3)
    rows = {r.line: r for r in CL.parse_lines(lines, ["k", "a.1", "b"]).collect()}
    fields = {t: tuple(rows[t])[1:] for t in rows}
    assert fields[good[0]] == ("1", " a b ", "NA", None) and fields[good[1]] == ("2", 'x, "y"\nz\r\n', "NULL", None)
    assert fields[good[2]] == ("3", None, None, None) and fields[good[3]] == (None, None, None, None)
    assert all(fields[t] == (None, None, None, t) for t in bad) and fields[None] == (None, None, None, None)


def test_records_of_any_text_come_back(spark):
    texts = ["plain", 'q"q', "a,b", "l\nm", "\r", " lead", "trail ", "#x", "\\n", '"', "日本", "x" * 200_000, "\t", "'", '""', "a\\\"b"]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "i int, t string, none string")
    back = CL.parse_lines(rows.select("i", CL.to_line(["t", "none", "i"]).alias("line")), ["t", "none", "n"])
    assert {r.i: (r.t, r.none, r.n, r[CL.RESCUED]) for r in back.collect()} == {i: (t, None, str(i), None) for i, t in enumerate(texts)}


def test_a_file_of_records_is_typed_and_its_copies_go(spark):
    names = PT.repeated_headers(["KEY", "symbol", "period_key", "fiscal_period_end_date", "ebit", "ebit", "goodwill", "goodwill"])
    lines = spark.createDataFrame(
        [("2020Q1_NA,NA,2020Q1,31/03/2020,1.5,1.5,2,2",), ("2020Q2_B,B,2020Q2,x,,,3,4",), ("2020Q3_B,B,2020Q3",)], "line string"
    )
    panel, rescued = PT.load_lines(lines, names, S.load, ["ebit", "ebit.1", "goodwill", "goodwill.1"])
    rows = panel.orderBy("KEY").collect()
    assert "ebit.1" not in panel.columns and [r["goodwill.1"] for r in rows] == [2.0, 4.0]
    assert [(r.symbol, r.ebit, r.fiscal_period_end_date_raw) for r in rows] == [("NA", 1.5, "31/03/2020"), ("B", None, "x")]
    assert [r[0] for r in rescued.collect()] == ["2020Q3_B,B,2020Q3"]


def test_copies_are_compared_on_records_of_their_own(spark, sf_dir):
    """The pass that compares copies deals no links or texts, and finds what the whole records would show."""
    lines, names = TP.panel_lines(spark, sf_dir)
    pairs = [n for pair in PT.duplicate_pairs(names) for n in pair]
    few, own = TP.panel_lines(spark, sf_dir, only=pairs)
    assert own == pairs
    found = [{r.duplicate_column: r.identical for r in PT.duplicate_columns(CL.parse_lines(*side)).collect()} for side in ((lines, names), (few, own))]
    assert found[0] == found[1] == {"market_cap.1": True, "goodwill.1": False}
    plan = PT.duplicate_columns(CL.parse_lines(few, own))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "p_name" not in plan
    typed, _ = PT.load_lines(lines, names, S.load, ["market_cap", "goodwill"], (few, own))
    assert "market_cap.1" not in typed.columns and "goodwill.1" in typed.columns


def test_appended_rows_keep_all_columns(spark):
    one, two = spark.createDataFrame([(1, "a")], "i int, s string"), spark.createDataFrame([("b", 2.0)], "s string, d double")
    assert [tuple(r) for r in CL.append_rows([one, two, one]).orderBy("s", "i").collect()] == [(1, "a", None), (1, "a", None), (None, "b", 2.0)]


def test_writes_count_their_rows(spark, tmp_path):
    assert save_table(spark.range(1234).repartition(5), f"{tmp_path}/t") == 1234
    assert save_table(spark.range(0), f"{tmp_path}/none") == 0


def test_windows_and_prices_over_clustered_tables_need_no_exchange(spark, panel, tmp_path):
    prices = panel.select(
        "symbol", "q_ord", F.col("fiscal_period_end_date").alias("As_Of_Date"), S.columns.forward_return, S.columns.momentum
    ).filter("q_ord % 3 <> 0")
    stored = save_clustered(panel, "clustered_panel_test", f"{tmp_path}/panel", 4)
    sheet = save_clustered(prices, "clustered_prices_test", f"{tmp_path}/prices", 4)
    chain = lambda rows, other: with_prices_by_entity(SE.add_sequence_info(SE.add_window_sum(rows, "ebit", 4), S.sequence), other, S.columns)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = chain(stored, sheet)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Window [") == 1
        columns = ["KEY", "ebit_sum", "prev_key_gap", "is_consecutive_prev", "As_Of_Date", "fqr_price", "mom_price"]
        assert sorted(map(tuple, out.select(columns).collect())) == sorted(map(tuple, chain(panel, prices).select(columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE clustered_panel_test")
        spark.sql("DROP TABLE clustered_prices_test")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 5000])
def test_positions_are_those_of_a_full_sort(spark, n):
    rows = [(None if i % 97 == 5 else f"s{i * 7919 % 50}", (i * 31) % 5003, i) for i in range(n)]
    frame = spark.createDataFrame(rows, "s string, q int, i int").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    found = {r.i: r.position for r in PO.with_position(frame, ["s", "q"], 8).collect()}
    assert found == {r[2]: k for k, r in enumerate(order)}
    sample = {r.i: r.position for r in PO.positional_sample(frame, ["s", "q"], runs=8).collect()}
    assert sample == {r[2]: k for k, r in enumerate(order) if k == 0 or k % 4 == 1 or k >= n - 2}


def test_no_run_holds_most_of_a_skewed_table(spark):
    """One entity has nine of ten rows; its quarters still part them."""
    frame = spark.range(20_000).selectExpr("CASE WHEN id % 10 = 0 THEN cast(id AS string) ELSE 'hot' END AS s", "cast(id AS int) AS q")
    placed = PO.with_position(frame, ["s", "q"], 16)
    assert placed.agg(F.count_distinct("position"), F.max("position")).first()[:] == (20_000, 19_999)
    sizes = [r["count"] for r in PO.in_runs(frame, ["s", "q"], 16).groupBy("__run").count().collect()]
    assert len(sizes) > 12 and max(sizes) < 4_000
