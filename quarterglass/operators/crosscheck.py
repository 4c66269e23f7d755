"""The prepared panel against a second source: a price table and a full-precision table, both on KEY."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterglass.functions.nulls import is_true
from quarterglass.operators.packed import correlations, facts, measured, pack, quantiles
from quarterglass.settings import Columns


def joined_sources(panel: DataFrame, price: DataFrame, data: DataFrame, c: Columns) -> DataFrame:
    """Panel with the second source's columns beside its own."""
    mine = ["KEY", "period_key", "formation_date", c.forward_return, c.momentum, "fwd_return"]
    mine += ["roic_pretax_q", "roic_posttax_q", "debt_to_equity_q", c.roic_posttax_file]
    prices = price.select(
        "KEY", "As_Of_Date", F.col(c.forward_return).alias("fqr_price"), F.col(c.momentum).alias("mom_price")
    )
    full = data.select(
        "KEY",
        F.col(c.roic_pretax_file).alias("pre_full"),
        F.col(c.roic_posttax_file).alias("post_full"),
        F.col(c.de_file).alias("de_full"),
    )
    return panel.select(*mine).join(prices, "KEY", "left").join(full, "KEY", "left")


def with_prices_by_entity(panel: DataFrame, price: DataFrame, c: Columns) -> DataFrame:
    """Panel with the price table's values of the same entity and quarter (J7), joined on the entity alone.

    An entity's prices become one map by quarter, as long as the calendar at most, so two tables clustered by entity meet
    without an exchange. Of several prices of a quarter the largest is taken.
    """
    values = F.struct("As_Of_Date", F.col(c.forward_return).alias("fqr_price"), F.col(c.momentum).alias("mom_price"))
    one = price.groupBy("symbol", "q_ord").agg(F.max(values).alias("v"))
    sheet = one.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("q_ord", "v"))).alias("__prices"))
    found = F.col("__prices")[F.col("q_ord")]
    joined = panel.join(sheet, "symbol", "left")
    return joined.withColumns({n: found[n] for n in ("As_Of_Date", "fqr_price", "mom_price")}).drop("__prices")


def crosscheck(panel: DataFrame, price: DataFrame, data: DataFrame, c: Columns) -> DataFrame:
    """Seventeen agreement metrics (A22), all from the counted values of twelve columns of the joined sources."""
    m = joined_sources(panel, price, data, c)
    has_price = F.col("As_Of_Date").isNotNull()
    zero_return, zero_momentum = F.col(c.forward_return) == 0, F.col(c.momentum) == 0
    gap = has_price & F.col("fqr_price").isNull()
    same_gaps = lambda mine, theirs: F.col(mine).isNull() == F.col(theirs).isNull()
    flags = {
        "found": has_price,
        "same_day": F.when(has_price, is_true(F.col("As_Of_Date") == F.col("formation_date"))),
        "zero_return": is_true(zero_return & gap),
        "cleaned": F.when(gap, F.col("fwd_return").isNull()),
        "zero_momentum": is_true(zero_momentum & has_price & F.col("mom_price").isNull()),
        "true_momentum": is_true(zero_momentum & F.col("mom_price").isNotNull()),
        "pre_gaps": same_gaps("roic_pretax_q", "pre_full"),
        "post_gaps": same_gaps("roic_posttax_q", "post_full"),
    }
    values = {
        "distance": F.abs(F.col("fwd_return") - F.col("fqr_price")),
        "pre": F.abs(F.col("roic_pretax_q") - F.col("pre_full")),
        "post": F.abs(F.col("roic_posttax_q") - F.col("post_full")),
        "rounded": F.when(F.col("roic_posttax_q").isNotNull(), F.abs(F.col(c.roic_posttax_file) - F.col("post_full"))),
        "de": F.abs(F.col("debt_to_equity_q") - F.col("de_full")),
    }
    names = [*flags, *values]
    rows = m.select(*[v.cast("double").alias(k) for k, v in (flags | values).items()])
    one = measured(rows, names, [0.5, 0.99])
    cell = lambda key: F.col("m")[key]
    share = lambda name: F.try_divide(cell(f"{name}:sum"), cell(f"{name}:n"))
    count = lambda name: F.coalesce(cell(f"{name}:sum"), F.lit(0.0))
    full = "ROIC recomputed vs xlsx full precision"
    # Names of the metrics, in report order.
    lines: list[tuple[str, Column, str]] = [
        ("CSV keys found in xlsx Price sheet", share("found"), "found"),
        ("Price.As_Of_Date == formation_date", share("same_day"), "same_day"),
        ("CSV FQR == 0 where Price sheet FQR is NaN (zero-coded missing)", count("zero_return"), "same_day"),
        ("cleaned fwd_return NaN where Price sheet NaN (company rows with price data)", share("cleaned"), "cleaned"),
        ("max |fwd_return - Price sheet FQR|", cell("distance:max"), "distance"),
        ("CSV Momentum_3Q == 0 where Price sheet is NaN (zero-coded missing)", count("zero_momentum"), "same_day"),
        ("CSV Momentum_3Q == 0 where Price sheet also has a value (genuine zero, set NaN by rule)", count("true_momentum"), "same_day"),
        (f"pre-tax {full}: median |diff|", cell("pre:0.5"), "pre"),
        (f"pre-tax {full}: 99th pct |diff|", cell("pre:0.99"), "pre"),
        (f"pre-tax {full}: max |diff|", cell("pre:max"), "pre"),
        ("pre-tax ROIC NaN pattern recomputed == xlsx", share("pre_gaps"), "pre_gaps"),
        (f"post-tax {full}: median |diff|", cell("post:0.5"), "post"),
        (f"post-tax {full}: 99th pct |diff|", cell("post:0.99"), "post"),
        (f"post-tax {full}: max |diff|", cell("post:max"), "post"),
        ("post-tax ROIC CSV rounded vs xlsx full precision: median |diff|", cell("rounded:0.5"), "post"),
        ("post-tax ROIC NaN pattern recomputed == xlsx", share("post_gaps"), "post_gaps"),
        ("D/E recomputed vs xlsx: 99th pct |diff|", cell("de:0.99"), "de"),
    ]
    n_rows = lambda name: F.coalesce(cell(f"{name}:n"), F.lit(0.0)).cast("long")
    cells = [F.struct(F.lit(name).alias("check"), value.alias("value"), n_rows(n).alias("n")) for name, value, n in lines]
    return one.select(F.inline(F.array(*cells)))


def zero_coded_by_period(panel: DataFrame, price: DataFrame, c: Columns) -> DataFrame:
    """Quarters of the returns stored as zero although the price table has none."""
    rows = panel.select("KEY", "period_key", c.forward_return).join(
        price.select("KEY", F.col(c.forward_return).alias("theirs")), "KEY"
    )
    found = rows.filter((F.col(c.forward_return) == 0) & F.col("theirs").isNull())
    return found.groupBy("period_key").agg(F.count(F.lit(1)).alias("rows"))


def field_agreement(ours: DataFrame, theirs: DataFrame, fields: list[str], on: list[str]) -> DataFrame:
    """Per field: pairs, correlation, median ratio, median relative deviation, share within 5 %.

    Both sides are read once: ratios and deviations of the joined rows travel as packed distinct values, pairs as moments of
    pieces of the rows, in one shuffle, and every column comes from these. The first of ``on`` is the entity: sides that are
    clustered by it meet on it alone, without another exchange or sort, and the other keys choose among an entity's rows, of
    which there is one per quarter.
    """
    other = theirs.select(*[F.col(n).alias(f"o_{n}") for n in (*on, *fields)])
    same = [F.col(on[0]) == F.col(f"o_{on[0]}")]
    same += [F.col(n).between(F.col(f"o_{n}"), F.col(f"o_{n}")) for n in on[1:]]  # an equality would ask for a row's own exchange
    joined = ours.select(*on, *fields).join(other.hint("merge"), same)
    pairs = [(F.col(f).cast("double"), F.col(f"o_{f}").cast("double")) for f in fields]
    measures = [m for a, b in pairs for m in (F.try_divide(a, b), F.abs(F.try_divide(a - b, b)))]
    packed = pack(joined, measures, pairs)
    median = lambda kind: F.max(F.when(F.col("fid") % 2 == kind, F.col("quantile")))
    medians = quantiles(packed, [0.5]).groupBy(F.expr("fid div 2").cast("int").alias("fid"))
    medians = medians.agg(median(0).alias("median_ratio"), median(1).alias("median_relative_deviation"))
    near = facts(packed, near=0.05).filter("fid % 2 = 1")
    near = near.select(F.expr("fid div 2").cast("int").alias("fid"), (F.col("n_near") / F.col("n")).alias("share_within_5pct"))
    found = correlations(packed).join(F.broadcast(near), "fid", "left").join(F.broadcast(medians), "fid", "left")  # one row per field
    every = ours.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(f) for f in fields])).alias("fid", "field"))
    table = every.join(F.broadcast(found), "fid", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    accepted = (F.col("correlation") >= 0.95) & F.col("median_ratio").between(0.99, 1.01)
    columns = ["field", "n", "correlation", "share_within_5pct", "median_ratio", "median_relative_deviation"]
    return table.select(*columns, is_true(accepted).alias("accepted"))
