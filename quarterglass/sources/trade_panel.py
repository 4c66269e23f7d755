"""Panels, membership ranges and text inputs derived from trade tables.

Order lines are summed per entity and quarter into the panel schema, so the
panel operators run on data of any size. Amounts are summed as whole cents:
sums do not depend on row order. Each group-by combines on the map side, so an
entity with a third of all lines sends one partial row per task and quarter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterglass.functions.measures import half_up
from quarterglass.functions.nulls import positive_or_null, ratio
from quarterglass.functions.quarters import date_ordinal, month_end_after, ordinal_key
from quarterglass.operators.fundamentals import add_capital_and_profit, add_roic_drivers
from quarterglass.operators.sequence import add_lags, add_sequence_info, by_entity, drop_lags, lag_name
from quarterglass.settings import Columns, LoadRule, SequenceRule
from quarterglass.sources.csv_lines import quoted, to_line
from quarterglass.sources.ranges import type_ranges

C = Columns()
RUN_DATE = "2001-12-01"


@dataclass(frozen=True)
class Entity:
    """Which key of the order lines is the panel's entity, and where its attributes are."""

    line_key: str
    table: str
    table_key: str
    company: str
    sector: str
    industry: str


PART = Entity("l_partkey", "part", "p_partkey", "p_name", "p_brand", "p_type")
SUPPLIER = Entity(
    "l_suppkey", "supplier", "s_suppkey", "s_name", "concat('N', s_nationkey)", "concat('G', s_nationkey % 5)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_of(key: Column) -> Column:
    """Keys 0 and 1 are the benchmarks; 2 and 3 carry tickers that look like missing values."""
    special = {0: "SPY", 1: "QQQ", 2: "NA", 3: "NULL"}
    out = key.cast("string")
    for k, text in special.items():
        out = F.when(key == k, text).otherwise(out)
    return out


def _cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("long")


def quarterly_amounts(lines: DataFrame, key: str) -> DataFrame:
    """One row per (k, q_ord) with amounts in cents."""
    day = F.to_date("l_shipdate")
    rows = lines.select(
        F.col(key).alias("k"),
        day.alias("day"),
        date_ordinal(F.add_months(day, -2)).alias("q_ord"),
        _cents("l_extendedprice").alias("price"),
        _cents("l_discount").alias("disc"),
        _cents("l_tax").alias("tax"),
        F.col("l_quantity").cast("long").alias("qty"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_returnflag") == "R").alias("returned"),
        (F.col("l_linestatus") == "F").alias("filled"),
    )
    sums = {
        "gross": "price",
        "units": "qty",
        "ebit_c": "CASE WHEN returned THEN -(price div 2) ELSE price END",
        "pretax_c": "CASE WHEN returned THEN -1 ELSE 1 END * ((price * (100 - disc)) div 100)",
        "tax_c": "CASE WHEN returned THEN -1 ELSE 1 END * ((price * tax) div 100)",
        "tcl_c": "(price * disc * CASE WHEN k % 11 = 0 THEN 25 ELSE 4 END) div 100",
        "gw_c": "CASE WHEN filled OR NOT returned THEN price div 4 END",
        "std_c": "(price * tax) div 50",
        "ltd_c": "(price * disc) div 50",
        "cash_c": "price div 10",
        "sti_c": "CASE WHEN filled THEN price div 20 END",
        "capx_c": "(price * tax) div 20",
        "ocf_c": "CASE WHEN returned THEN -(price div 3) ELSE price div 5 END",
    }
    return rows.groupBy("k", "q_ord").agg(
        F.max("day").alias("last_day"),
        F.min("line").alias("least_line"),
        *[F.sum(F.expr(e)).alias(n) for n, e in sums.items()],
    )


def raw_statements(spark: SparkSession, sf_dir: str, entity: Entity = PART) -> DataFrame:
    """Identity and raw statement columns, one row per entity and quarter.

    ``m`` = key + quarter decides which cells are missing or zero-coded. Attributes are joined by symbol, on the partitioning
    that the windows need anyway: what is dealt by symbol are cents without texts, and no task gets a table of all entities.
    """
    q = quarterly_amounts(table(spark, sf_dir, "lineitem"), entity.line_key).withColumn("symbol", symbol_of(F.col("k")))
    about = table(spark, sf_dir, entity.table).select(
        symbol_of(F.col(entity.table_key)).alias("__entity"),
        F.expr(entity.company).alias("company"),
        F.expr(f"CASE WHEN {entity.table_key} % 47 <> 0 THEN {entity.sector} END").alias("sector"),
        F.expr(entity.industry).alias("industry"),
    )
    ordinal = F.col("q_ord")
    rows = q.join(about.hint("shuffle_hash"), F.col("symbol") == F.col("__entity"), "left").withColumns(
        {
            "period_key": ordinal_key(ordinal),
            "fiscal_period_end_date": F.when(F.col("k") < 2, month_end_after(ordinal, 2)).otherwise(F.col("last_day")),
            "m": F.col("k") + ordinal,
        }
    )
    lag_days = "20 + (k * 7 + q_ord) % 60 + CASE WHEN m % 5 = 0 THEN 365 WHEN m % 97 = 0 THEN -400 ELSE 0 END"
    return rows.selectExpr(
        "concat_ws('_', period_key, symbol) AS KEY",
        "symbol",
        "company",
        "sector",
        "industry",
        "period_key",
        "q_ord",
        "CASE WHEN k >= 2 THEN CAST(substring(period_key, 1, 4) AS int) END AS period_year",
        "CASE WHEN k >= 2 THEN substring(period_key, 5, 2) END AS period_quarter",
        "fiscal_period_end_date",
        f"CASE WHEN m % 19 <> 0 THEN date_add(fiscal_period_end_date, CAST({lag_days} AS int)) END AS filing_date",
        f"CASE WHEN k >= 2 THEN date '{RUN_DATE}' END AS run_date",
        "ebit_c / 100D AS ebit",
        "pretax_c / 100D AS pretax_income",
        "-tax_c / 100D AS tax_provision",
        "-(gross div 100) / 100D AS interest_expense",
        "CASE WHEN least_line < 7 THEN gross / 100D END AS total_current_assets",
        "tcl_c / 100D AS total_current_liabilities",
        "CASE WHEN units % 17 <> 0 THEN units * 1000 / 100D END AS net_ppe",
        "gw_c / 100D AS goodwill",
        "std_c / 100D AS short_term_debt_and_capital_lease",
        "ltd_c / 100D AS long_term_debt_and_capital_lease",
        "cash_c / 100D AS cash_and_cash_equivalents",
        "sti_c / 100D AS short_term_investments",
        "CASE WHEN m % 43 = 0 THEN NULL WHEN m % 37 = 0 THEN 0D ELSE (gross * 2 - tcl_c * 3) / 100D END"
        " AS total_stockholders_equity",
        "gross * 3 / 100D AS total_assets",
        "(gross + tcl_c * 3) / 100D AS total_liabilities",
        "(gross * 2 - tcl_c * 3) / 100D AS equity",
        "CASE WHEN m % 41 = 0 THEN NULL WHEN m % 23 = 0 THEN 0D ELSE (gross div units) * 1000 / 100D END AS market_cap",
        f"CASE WHEN m % 31 = 0 THEN NULL WHEN m % 29 = 0 THEN 0D ELSE (gross div units) / 100D END AS {C.price}",
        f"CASE WHEN m % 13 = 0 THEN NULL WHEN m % 7 = 0 THEN 0D ELSE 0.5D END AS {C.de_reported}",
        "(ocf_c - capx_c) / 100D AS free_cash_flow",
        "capx_c / 100D AS capx_quarter",
        "ocf_c / 100D AS ocf_quarter",
    )


def full_precision(spark: SparkSession, sf_dir: str, entity: Entity = PART) -> DataFrame:
    """Statements with links and every derived measure, unrounded."""
    linked = add_sequence_info(raw_statements(spark, sf_dir, entity), SequenceRule())
    return with_returns(add_roic_drivers(add_capital_and_profit(linked)))


def with_returns(panel: DataFrame) -> DataFrame:
    """Forward return and momentum as a source delivers them: zero where unknown at the edges."""
    w = by_entity()
    price = positive_or_null(F.col(C.price))
    nxt = F.lead(C.price).over(w)
    change = half_up(ratio(positive_or_null(nxt), price) - 1, 9)
    is_last = F.lead("q_ord").over(w).isNull()
    out = panel.withColumns({"__chg": change, "__last": is_last})
    out = out.withColumn(C.forward_return, F.when(F.col("__last"), 0.0).otherwise(F.col("__chg")))
    out = add_lags(out, {C.forward_return: 3})
    one, two, three = (1 + F.col(lag_name(C.forward_return, k)) for k in (1, 2, 3))
    product = half_up(one * two * three - 1, 9)
    out = out.withColumn(C.momentum, F.coalesce(product, F.lit(0.0)))
    return drop_lags(out).drop("__chg", "__last")


# Decimals at which the panel file stores its measures.
STORED_DECIMALS = {
    C.tax_rate: 2,
    C.nopat: 2,
    C.avg_ic: 2,
    C.roic_pretax_file: 2,
    C.roic_posttax_file: 2,
    C.de_file: 2,
    C.roic_change: 6,
    C.c_ebit: 6,
    C.c_tax: 6,
    C.c_ic: 6,
    C.residual: 6,
    C.roic_annualized: 6,
}


def as_stored(full: DataFrame) -> DataFrame:
    """The panel as a file would hold it: measures rounded, links and unrounded extras gone."""
    rounded = full.withColumns({n: half_up(F.col(n), d) for n, d in STORED_DECIMALS.items()})
    return rounded.drop("prev_key_gap", "prev_day_gap", "is_consecutive_prev")


def panel(spark: SparkSession, sf_dir: str, entity: Entity = PART) -> DataFrame:
    return as_stored(full_precision(spark, sf_dir, entity))


def price_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second source of returns: no zero-coding, some keys absent."""
    full = full_precision(spark, sf_dir)
    unknown = F.lead("q_ord").over(by_entity()).isNull()
    rows = full.withColumn("__unknown", unknown).filter((F.length("symbol") + F.col("q_ord")) % 9 != 0)
    return rows.select(
        "KEY",
        month_end_after(F.col("q_ord"), 2).alias("As_Of_Date"),
        F.when(~F.col("__unknown"), F.col(C.forward_return)).alias(C.forward_return),
        F.nullif(F.col(C.momentum), F.lit(0.0)).alias(C.momentum),
    )


def ranges_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership ranges as text, derived from the part key; range_id numbers them.

    By the key's last digit: 0 two ranges, 1 an empty one, 2 a closed one, 3
    none, else an open one. Some keys add a ticker (X...) without panel rows.
    """
    own = "struct(k * 4 + {j} AS id, symbol AS ticker, s + {lo} AS lo, {hi} AS hi)"
    stranger = "struct(k * 4 + 2 AS id, concat('X', k) AS ticker, s AS lo, {hi} AS hi)"
    never = "CAST(NULL AS int)"
    spans = f"""concat(
      CASE WHEN k % 10 = 0 THEN array({own.format(j=0, lo=0, hi='s + 12')}, {own.format(j=1, lo=14, hi=never)})
           WHEN k % 10 = 1 THEN array({own.format(j=0, lo=0, hi='s')})
           WHEN k % 10 = 2 THEN array({own.format(j=0, lo=0, hi='s + 8')})
           WHEN k % 10 = 3 THEN array()
           ELSE array({own.format(j=0, lo=0, hi=never)}) END,
      CASE WHEN k % 50 = 7 THEN array({stranger.format(hi=never)})
           WHEN k % 50 = 8 THEN array({stranger.format(hi='s + 6')})
           ELSE array() END)"""
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "CAST(100 + p_partkey % 12 AS int) AS s")
    listed = parts.withColumn("symbol", symbol_of(F.col("k"))).selectExpr(f"inline({spans})")
    return listed.select(
        F.col("id").alias("range_id"),
        "ticker",
        ordinal_key(F.col("lo")).alias("start_quarter"),
        F.coalesce(ordinal_key(F.col("hi")), F.lit("")).alias("end_quarter"),
    )


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_ranges(ranges_text(spark, sf_dir), LoadRule())


def panel_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored panel as an all-text CSV scan would return it, defects included."""
    stored = panel(spark, sf_dir)
    mixed = F.length("symbol") + F.col("q_ord")
    day = F.col("fiscal_period_end_date")
    fiscal = (
        F.when(F.col("symbol").isin("SPY", "QQQ"), F.date_format(day, "dd/MM/yyyy"))
        .when(mixed % 11 == 0, F.date_format(day, "yyyy/MM/dd"))
        .when(mixed % 13 == 0, "  ")
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    flag = F.col(C.econ_valid)
    econ = (
        F.when(flag & (mixed % 2 == 0), "True").when(flag, "TRUE").when(~flag & (mixed % 3 == 0), "no").when(~flag, "False")
    )
    odd_key = F.when(mixed % 17 == 0, F.lower("period_key")).otherwise(F.concat(F.lit(" "), F.col("period_key")))
    given = {"KEY", "symbol", "period_key", "q_ord", "fiscal_period_end_date", "filing_date", "run_date", C.econ_valid}
    others = [n for n in stored.columns if n not in given]
    return stored.select(
        "KEY",
        F.concat(F.col("symbol"), F.lit(" ")).alias("symbol"),
        odd_key.alias("period_key"),
        fiscal.alias("fiscal_period_end_date"),
        F.date_format("filing_date", "yyyy-MM-dd").alias("filing_date"),
        F.date_format("run_date", "yyyy-MM-dd").alias("run_date"),
        econ.alias(C.econ_valid),
        *[F.col(n).cast("string").alias(n) for n in others],
        F.col("market_cap").cast("string").alias("market_cap.1"),
        F.when(mixed % 5 == 0, F.col("goodwill") + 1).otherwise(F.col("goodwill")).cast("string").alias("goodwill.1"),
    )


def panel_lines(spark: SparkSession, sf_dir: str, damaged: bool = False, only: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(lines, column names): the panel file as records, of the columns ``only`` if given. Damage cuts one record in 29 after
    its fifth field and gives one in 31 a field too many, both by the entity's place in the quarters."""
    text = panel_text(spark, sf_dir)
    if only is not None:
        text = text.select(*[F.col(quoted(n)) for n in only])
    line = to_line(text.columns)
    if damaged:
        mixed = F.length("KEY") - 7 + F.expr("(int(substring(KEY, 1, 4)) - 1970) * 4 + int(substring(KEY, 6, 1)) - 1")
        line = F.when(mixed % 29 == 0, F.substring_index(line, ",", 5)).when(mixed % 31 == 0, F.concat(line, F.lit(",more"))).otherwise(line)
    return text.select(line.alias("line")), text.columns


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger-source table by supplier: year-to-date flows, natural signs, full tickers."""
    rows = raw_statements(spark, sf_dir, SUPPLIER)
    number = F.when(F.col("symbol") == "SPY", 0).when(F.col("symbol") == "QQQ", 1).when(F.col("symbol") == "NA", 2)
    number = number.when(F.col("symbol") == "NULL", 3).otherwise(F.col("symbol").try_cast("long")).cast("long")
    rows = rows.withColumn("n", number)
    # fiscal year starts in quarter 1 + n % 4
    shifted = F.col("q_ord") - F.col("n") % 4
    year = F.floor(shifted / 4)
    ytd = Window.partitionBy("n", "fy").orderBy("q_ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("fy", year)
    cents = {n: F.round(F.col(n) * 100).cast("long") for n in ("capx_quarter", "ocf_quarter")}
    mixed = F.col("n") + F.col("q_ord")
    return rows.withColumns(
        {"capxy": F.sum(cents["capx_quarter"]).over(ytd) / 100.0, "oancfy": F.sum(cents["ocf_quarter"]).over(ytd) / 100.0}
    ).select(
        F.lpad(F.col("n").cast("string"), 9, "0").alias("gvkey"),
        F.concat(F.lit("T"), F.expr("n div 2").cast("string"), F.when(F.col("n") % 2 == 1, ".1").otherwise("")).alias("tic"),
        F.col("company").alias("conm"),
        F.col("fiscal_period_end_date").alias("datadate"),
        F.when(F.col("n") % 7 == 0, "I").otherwise("A").alias("costat"),
        F.col("total_current_assets").alias("actq"),
        F.col("cash_and_cash_equivalents").alias("cheq"),
        F.col("short_term_investments").alias("ivstq"),
        F.col("total_current_liabilities").alias("lctq"),
        F.col("short_term_debt_and_capital_lease").alias("dlcq"),
        F.col("long_term_debt_and_capital_lease").alias("dlttq"),
        F.col("goodwill").alias("gdwlq"),
        F.col("net_ppe").alias("ppentq"),
        F.col("total_assets").alias("lseq"),
        F.when(mixed % 3 != 0, F.col("equity")).alias("teqq"),
        F.when(mixed % 15 != 0, F.col("equity")).alias("seqq"),
        F.col("ebit").alias("oiadpq"),
        F.col("pretax_income").alias("piq"),
        F.col("market_cap").alias("mkvaltq"),
        (-F.col("tax_provision")).alias("txtq"),
        (-F.col("interest_expense")).alias("xintq"),
        "oancfy",
        "capxy",
    )


def order_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: a source in which a firm files several times in a quarter."""
    rows = table(spark, sf_dir, "orders")
    k = F.col("o_custkey")
    ticker = F.concat(F.lit("C"), F.expr("o_custkey div 2").cast("string"))
    return rows.select(
        k.cast("string").alias("gvkey"),
        F.concat(ticker, F.when(k % 6 == 1, ".1").otherwise("")).alias("tic"),
        F.to_date("o_orderdate").alias("fiscal_period_end_date"),
        F.when(k % 7 == 0, "I").otherwise("A").alias("costat"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("equity"),
        F.when(F.col("o_orderkey") % 15 != 0, F.col("o_totalprice")).alias("total_stockholders_equity"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("short_term_debt_and_capital_lease"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("market_cap"),
        F.col("o_orderkey"),
    )


def order_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and quarter: its last filing's day and the year-to-date sum of its orders, in cents.

    Fiscal years start in quarter 1 + customer % 4.
    """
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), _cents("o_totalprice").alias("cents"))
    flows = rows.groupBy("o_custkey", date_ordinal(F.col("day")).alias("q")).agg(F.max("day").alias("fiscal_period_end_date"), F.sum("cents").alias("cents"))
    year = F.floor((F.col("q") - F.col("o_custkey") % 4) / 4)
    ytd = Window.partitionBy("o_custkey", year).orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    return flows.select(
        F.col("o_custkey").cast("string").alias("gvkey"), F.concat(F.lit("C"), F.expr("o_custkey div 2").cast("string")).alias("tic"),
        "fiscal_period_end_date", F.sum("cents").over(ytd).alias("ytd"),
    )


def part_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document blocks from the part table: per 40 parts one document of headings, texts and tables."""
    p = table(spark, sf_dir, "part").select(
        F.expr("p_partkey div 40").alias("doc_id"),
        (F.col("p_partkey") % 40).cast("int").alias("block_no"),
        F.regexp_replace(F.lower("p_name"), " ", "_").alias("name"),
        "p_name",
        "p_brand",
        "p_type",
        F.col("p_size").cast("string").alias("size"),
        F.col("p_retailprice").cast("decimal(12,1)").cast("string").alias("price"),
        F.col("p_partkey").alias("k"),
    )
    b, k = F.col("block_no"), F.col("k")
    kind = F.when((b % 8 == 5) | (b == 2), "table").otherwise("p")
    style = F.when((b % 8 == 3) & (k % 3 == 0), "Heading 2").otherwise("Normal")
    numbered = F.concat((b % 9 + 1).cast("string"), F.lit("."), F.lit(" "), F.col("p_name"))
    text = (
        F.when((b == 0) & (k % 3 == 0), F.concat(F.lit("Total "), F.col("size"), F.lit(" עמודות")))
        .when(b == 0, F.concat(F.lit("About "), F.col("p_name")))
        .when(b % 8 == 1, numbered)
        .when(b % 8 == 3, F.concat(F.lit("On "), F.col("p_brand")))
        .when(b % 8 == 4, F.lit("הערכים של calc_roic_business_classification"))
        .when(b % 8 == 6, F.concat_ws(" · ", F.upper(F.regexp_replace("p_name", " ", "_")), "p_type", F.lit("abc"), F.lit("AB")))
        .when(b % 8 == 7, F.lit("calc_raw_combo__ebit_up__tax_down"))
        .otherwise(F.concat_ws(" ", "p_name", "p_type"))
    )
    header = F.array(F.lit("עמודה"), F.lit("טיפוס"), F.lit("משמעות"), F.lit("ערכים"))
    row = F.array(
        F.col("name"),
        F.col("p_type"),
        F.concat(F.lit("NaN when "), F.col("p_type"), F.lit(". Size 1.5; other")),
        F.concat(F.lit("UNCLASSIFIED · "), F.col("size")),
    )
    second = F.array(F.concat(F.lit("calc_"), F.col("name"), F.lit("_status")), F.lit("text"), F.lit("state"), F.lit("VALID · x"))
    bad = F.array(F.lit("Not A Name"), F.lit("text"), F.lit("-"), F.lit("-"))
    groups = F.array(
        F.array(F.lit("קבוצה"), F.lit("כמות")), F.array(F.col("p_type"), F.col("size")), F.array(F.lit("all"), F.lit("many"))
    )
    tables = F.when(b == 2, groups).otherwise(F.array(header, row, second, bad))
    return p.select(
        "doc_id",
        "block_no",
        kind.alias("kind"),
        F.when(kind == "p", style).otherwise("").alias("style"),
        F.when(kind == "p", text).otherwise("").alias("text"),
        F.when(kind == "table", tables).alias("rows"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as paragraph blocks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.split("text", "\n").alias("lines"))
    lines = docs.select("doc_id", "source", F.posexplode("lines").alias("block_no", "text"))
    return lines.select(
        "doc_id", "block_no", F.lit("p").alias("kind"), F.col("source").alias("style"), "text",
        F.lit(None).cast("array<array<string>>").alias("rows"),
    )
