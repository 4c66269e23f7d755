"""Reports from packed values: exact, and few shuffled rows."""

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarterglass.operators.crosscheck import field_agreement
from quarterglass.operators.packed import correlations, facts, pack, quantiles


def test_packed_values_give_exact_facts_and_quantiles(spark):
    n = np.arange(4_000)
    a = np.where(n % 7 == 0, np.nan, ((n * 37) % 1_009 - 400) / 8)
    b = np.where(n % 5 == 0, 0.0, 1 + n * 2.0**-50)  # one narrow cell, and many equal values
    frame = spark.createDataFrame(pd.DataFrame({"a": a, "b": b})).select(F.when(~F.isnan("a"), F.col("a")).alias("a"), "b")
    packed = pack(frame, [F.col("a"), F.col("b"), F.lit(None)], [(F.col("a"), F.col("b")), (F.lit(0.1), F.col("b"))], rows=300)
    held = {0: a[~np.isnan(a)], 1: b}
    rows = {r.fid: r for r in facts(packed, 9, near=0.5).collect()}
    assert set(rows) == {0, 1}
    for fid, v in held.items():
        r = rows[fid]
        assert (r.n, r.n_distinct, r.largest, r.n_near) == (len(v), len(np.unique(v)), v.max(), (v <= 0.5).sum())
    assert rows[0].max_decimals == 3
    p = [0.0, 0.25, 0.5, 0.99]
    for absolute in (False, True):
        got = {(r.fid, r.p): r.quantile for r in quantiles(packed, p, absolute=absolute).collect()}
        expected = {(fid, q): np.quantile(np.abs(v) if absolute else v, q) for fid, v in held.items() for q in p}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    both = {r.p: r.quantile for r in quantiles(packed, p, width=2).collect()}
    assert all(abs(both[q] - np.quantile(np.concatenate(list(held.values())), q)) < 1e-12 for q in p)
    moments = {r.fid: r for r in correlations(packed).collect()}
    known = ~np.isnan(a)
    assert moments[0].n == known.sum() and abs(moments[0].correlation - np.corrcoef(a[known], b[known])[0, 1]) < 1e-9
    assert moments[1].n == len(b) and np.isnan(moments[1].correlation)


def test_buckets_do_not_depend_on_the_order_of_a_tasks_rows(spark):
    """A task that runs again gets its rows in another order and cuts other pieces; what each bucket holds stays the same."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        found = []
        for order in (F.col("id"), -F.col("id")):
            rows = spark.range(0, 2_000, 1, 4).withColumn("a", F.when(F.col("id") % 9 > 0, F.col("id") / 7)).sortWithinPartitions(order)
            packed = pack(rows, [F.col("a")], [(F.col("a"), F.col("id").cast("double"))], rows=200)
            held = {}
            for r in packed.collect():
                n = np.frombuffer(r["items"], np.float64)[0] if r.fid < 0 else np.frombuffer(r["times"], np.uint32).sum()
                held[r.fid, r.bucket] = held.get((r.fid, r.bucket), 0) + int(n)
            found.append(held)
        assert found[0] == found[1] and len([fid for fid, _ in found[0] if fid < 0]) == 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_field_agreement_shuffles_no_row_per_value(spark):
    """The pairs of a field travel as moments and packed distinct ratios, not as a row each."""
    fields = [f"f{i}" for i in range(20)]
    ours = spark.range(3_000).select("id", *[(F.col("id") * (i + 1) / 7).alias(f) for i, f in enumerate(fields)])
    table = field_agreement(ours, ours, fields, ["id"])
    assert {r.n for r in table.collect()} == {3_000}
    plan = table._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "MapInArrow" in plan and not [line for line in plan.splitlines() if "Generate posexplode(array(struct(" in line]


def test_sides_of_one_entity_meet_without_another_exchange(spark, sf_dir):
    """Sides dealt by symbol for their windows are joined on it; the quarter only chooses among an entity's rows."""
    rows = [("a", 1, 1.0), ("a", 2, 4.0), ("a", 3, 9.0), ("b", 1, 2.0), ("b", None, 5.0), (None, 1, 7.0)]
    ours = spark.createDataFrame(rows, "symbol string, q int, f double")
    theirs = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 2, 4.0), ("b", 2, 2.0), ("b", None, 5.0), (None, 1, 7.0)], "symbol string, q int, f double")
    r = field_agreement(ours, theirs, ["f"], ["symbol", "q"]).first()
    assert (r.field, r.n, r.median_ratio, r.share_within_5pct) == ("f", 3, 1.0, 2 / 3)
    by_entity = Window.partitionBy("symbol").orderBy("q")
    linked = [side.withColumn("f", F.col("f") - F.lag("q").over(by_entity)) for side in (ours, theirs)]
    plan = field_agreement(*linked, ["f"], ["symbol", "q"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [symbol" in plan and not re.search(r"hashpartitioning\(symbol#\d+, q#", plan)


def _optimized(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_a_record_is_parsed_once_behind_a_condition(spark):
    from quarterglass.sources import csv_lines as CL

    lines = spark.createDataFrame([("1,x",), ("2",), (None,)], "line string")
    good = CL.parse_lines(lines, ["a", "b"]).filter(F.col(CL.RESCUED).isNull())
    assert _optimized(good.select("a")).count("from_csv") == 1
    assert sorted(good.select("a").collect(), key=str) == [("1",), (None,)]


def test_a_row_meets_few_splitters(spark):
    from quarterglass.operators.positions import in_runs

    frame = spark.range(5_000).select((F.col("id") * 7_919 % 5_000).alias("i"))
    placed = in_runs(frame, ["i"], 16)
    assert "filter(__s" not in _optimized(placed)
    rows = sorted((r.i, r["__run"]) for r in placed.collect())
    runs = [run for _, run in rows]
    assert runs == sorted(runs) and runs[0] == 0 and set(runs) == set(range(17))


def test_checksums_add_up_longs(spark):
    from quarterglass.sources.fingerprints import content_digest

    frame = spark.range(1_000).select("id", F.col("id").cast("string").alias("text"))
    digest = {r.column: r for r in content_digest(frame).collect()}
    expected = sum(int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) for i in range(1_000))
    assert digest["id"].checksum == digest["text"].checksum == str(expected)
    assert _optimized(content_digest(frame)).count("as bigint)) as decimal(20,0))") == 4  # longs are summed, sums become decimals
