"""Variable catalogue from documents that are already split into blocks.

Blocks table: doc_id, block_no, kind ('p' or 'table'), style, text,
rows array<array<string>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterglass.functions import text as X

# Header words of variable tables and the catalogue field they name.
HEADER_FIELDS = {
    "עמודה": "variable",
    "טיפוס": "type",
    "משמעות": "meaning",
    "משמעות וערכים": "meaning",
    "ערכים אפשריים": "possible_values",
    "ערכים": "possible_values",
    "מפתח ב-API": "api_key",
    "section / key": "api_key",
    "חישוב": "formula",
}
FIRST_HEADER = "עמודה"
GROUP_HEADER = ("קבוצה", "כמות")
TOTAL_PATTERN = r"(\d+)\s*עמודות"
CLASS_MARKER = "הערכים של calc_roic_business_classification"
CLASS_VARIABLE = "calc_roic_business_classification"
DUMMY_SECTION = "8 עמודות הדמה"
FIELDS = ("type", "api_key", "meaning", "formula", "possible_values")

# Caveats stated in the documentation's prose.
PROSE_CAVEATS = {
    "calc_raw_tax_rate_quarterly": "Not clipped to [0,1]; negative (tax benefit) or >1 possible; NaN when pretax_income = 0 [4].",
    "calc_nopat_quarterly": "Uses the unclipped quarterly tax rate; a tax rate >100% makes NOPAT move opposite to EBIT [5].",
    "calc_ic_raw": "Can be negative when current liabilities exceed assets [4].",
    "calc_average_ic_raw_quarterly": "NaN unless the previous record is the consecutive previous quarter [4].",
    "calc_roic_pretax_quarterly_ic_raw": "Quarterly ratio (single-quarter numerator / average capital). Negative IC gives a mechanical, non-economic ratio [6.7].",
    "calc_roic_posttax_quarterly_ic_raw": "Quarterly ratio. Negative IC -> mechanical ratio; tax rate out of range is flagged, not clipped [6.7].",
    "calc_roic_posttax_change_quarterly": "NaN when calc_roic_decomposition_status != VALID; a classified row needs 3 consecutive quarters [6.1].",
    "calc_roic_ebit_contribution": "NaN when status != VALID. Effect sign is not the EBIT movement direction (tax rate >100% flips it) [5, 6.3].",
    "calc_roic_tax_contribution": "NaN when status != VALID. Contribution of Q = 1 - T, so a lower tax rate is a positive contribution [6.2, 6.4].",
    "calc_roic_ic_contribution": "NaN when status != VALID. A fall in IC is NOT always positive: with negative NOPAT a smaller denominator lowers ROIC. The sign is not the direction of IC [6.3].",
    "calc_roic_quality_flag": "VALID only when the pair is economically interpretable; NEGATIVE_IC_MECHANICAL_ONLY and TAX_RATE_OUT_OF_RANGE are computable but not economic [6.7].",
    "calc_roic_economic_interpretation_valid": "Empty when decomposition status != VALID [6.7].",
    "calc_ic_movement": "Direction of average IC itself (I1 - I0), depends on ROIC status [6.4].",
    "calc_roic_dominant_driver": "BALANCED when top two absolute shares differ by <= 0.05; NONE when all contributions neutral [6.6].",
    "calc_debt_to_equity_quarterly": "NaN when equity = 0; negative when equity negative [4].",
    "calc_ev_to_fcf_quarterly": "Negative (meaningless) when TTM FCF < 0; NaN when FCF = 0 [4].",
    "calc_roic_posttax_annualized_ic_raw": "NaN when quarterly ratio <= -100% [7.1].",
    "calc_roic_pretax_annualized_ic_raw": "NaN when quarterly ratio <= -100% [7.1].",
    "calc_wacc_cost_of_debt": "Biased downward when interest is reported as zero despite debt (flag DEBT_WITHOUT_INTEREST) [7.6].",
    "calc_wacc_annual": "Not computed for INSUFFICIENT_HISTORY / MISSING_MARKET_CAP / MISSING_DEBT; DEBT_WITHOUT_INTEREST biases it down [7.6].",
    "interest_expense": "Negative sign = expense; reported as zero in many quarters even with debt [2, 7.6].",
    "tax_provision": "The source reports tax expense with a negative sign [2].",
}

_CHUNK = 4096


def carry_forward(blocks: DataFrame, value: Column, name: str, chunk: int = _CHUNK) -> DataFrame:
    """Last non-missing ``value`` at or before each block of its document.

    A document is filled in runs of ``chunk`` blocks plus one carried value per
    run, so a document holding a third of all blocks still spreads over tasks.
    """
    marked = blocks.withColumns({"__v": value, "__c": F.floor(F.col("block_no") / chunk)})
    runs = marked.groupBy("doc_id", "__c").agg(
        F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("block_no"))).alias("__tail")
    )
    before = Window.partitionBy("doc_id").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select("doc_id", "__c", F.last("__tail", ignorenulls=True).over(before).alias("__in"))
    inside = Window.partitionBy("doc_id", "__c").orderBy("block_no")
    local = marked.withColumn("__own", F.last("__v", ignorenulls=True).over(inside))
    joined = local.join(carried, ["doc_id", "__c"], "left")
    return joined.withColumn(name, F.coalesce("__own", "__in")).drop("__v", "__c", "__own", "__in")


def running_count(blocks: DataFrame, condition: Column, name: str, chunk: int = _CHUNK) -> DataFrame:
    """How many blocks up to each one of its document meet the condition, in runs of ``chunk`` blocks as in ``carry_forward``."""
    marked = blocks.withColumns({"__m": F.coalesce(condition.cast("int"), F.lit(0)), "__c": F.floor(F.col("block_no") / chunk)})
    runs = marked.groupBy("doc_id", "__c").agg(F.sum("__m").alias("__n"))
    before = Window.partitionBy("doc_id").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select("doc_id", "__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__in"))
    inside = Window.partitionBy("doc_id", "__c").orderBy("block_no")
    local = marked.withColumn("__own", F.sum("__m").over(inside))
    joined = local.join(carried, ["doc_id", "__c"])
    return joined.withColumn(name, (F.col("__own") + F.col("__in")).cast("int")).drop("__m", "__c", "__own", "__in")


def number_tables(blocks: DataFrame) -> DataFrame:
    """Blocks with ``table_no``: the place of a table among its document's, from 1; NULL for paragraphs."""
    is_table = F.col("kind") == "table"
    return running_count(blocks, is_table, "table_no").withColumn("table_no", F.when(is_table, F.col("table_no")))


def section_fill(blocks: DataFrame) -> DataFrame:
    """Blocks with the section they belong to (K1).

    A numbered heading opens a section; a paragraph in a heading style becomes
    a sub-heading behind the section's number.
    """
    text = F.col("text")
    paragraph = F.col("kind") == "p"
    numbered = paragraph & text.rlike(X.SECTION_PATTERN) & ~text.contains("calc_")
    number, title = F.regexp_extract(text, X.SECTION_PATTERN, 1), F.regexp_extract(text, X.SECTION_PATTERN, 2)
    styled = paragraph & ~numbered & F.lower("style").startswith("heading")
    opened = F.when(numbered, F.struct(F.col("block_no").alias("at"), number.alias("no"), title.alias("title")))
    with_top = carry_forward(blocks, opened, "__top")
    sub = F.when(styled | numbered, F.struct(F.col("block_no").alias("at"), F.when(styled, text).alias("title")))
    both = carry_forward(with_top, sub, "__sub")
    # before any numbered heading, the first styled heading's first word takes the number's place
    lead = blocks.filter(styled).groupBy("doc_id").agg(F.min_by(text, "block_no").alias("__lead"), F.min("block_no").alias("__lead_at"))
    both = both.join(lead, "doc_id", "left")
    prefix = F.coalesce(F.col("__top.no"), F.split("__lead", " ")[0])
    first_lead = F.col("__top").isNull() & (F.col("__sub.at") == F.col("__lead_at"))
    under = F.when(first_lead, F.col("__sub.title")).otherwise(F.concat(prefix, F.lit(" / "), F.col("__sub.title")))
    section = F.when(F.col("__sub.title").isNotNull(), under).when(
        F.col("__top").isNotNull(), F.concat_ws(" ", "__top.no", "__top.title")
    )
    out = both.withColumn("section", F.coalesce(section, F.lit("")))
    return out.drop("__top", "__sub", "__lead", "__lead_at")


def _record_field(row: Column, header: Column, field: str) -> Column:
    """Cell of ``row`` under the last header word that means ``field``."""
    found = F.coalesce(
        *[
            F.when(F.array_contains(header, word), F.get(row, F.array_position(header, word).cast("int") - 1))
            for word, meaning in HEADER_FIELDS.items()
            if meaning == field
        ]
    )
    return F.coalesce(found, F.lit(""))


def table_records(sectioned: DataFrame) -> DataFrame:
    """Rows of variable tables as records, with the number of their table (K2); blocks need sections and table numbers."""
    header = F.get(F.col("rows"), 0)
    tables = sectioned.filter((F.col("kind") == "table") & (F.get(header, 0) == FIRST_HEADER))
    lines = tables.select("doc_id", "block_no", "section", "table_no", header.alias("header"), F.posexplode("rows").alias("line", "row"))
    cells = {f: _record_field(F.col("row"), F.col("header"), f) for f in ("variable", *FIELDS)}
    out = lines.filter("line > 0").withColumns(cells | {"variable": X.stripped(cells["variable"])})
    out = out.filter(F.col("variable").rlike(X.VARIABLE_PATTERN))
    return out.select("doc_id", "block_no", "line", "section", "table_no", "variable", *FIELDS)


def dummy_records(sectioned: DataFrame) -> DataFrame:
    """Records generated from paragraphs that name indicator columns (K3)."""
    named = sectioned.filter((F.col("kind") == "p") & F.col("text").rlike(X.COMBO_PATTERN))
    # The generated record's texts.
    return named.select(
        "doc_id",
        "block_no",
        F.lit(0).alias("line"),
        F.lit(DUMMY_SECTION).alias("section"),
        F.lit(None).cast("int").alias("table_no"),
        F.col("text").alias("variable"),
        F.lit("int8").alias("type"),
        F.lit("").alias("api_key"),
        F.lit("Dummy indicator of one effect/movement combination").alias("meaning"),
        F.lit("itertools.product over the sign/movement categories").alias("formula"),
        F.lit("0 · 1 (all 0 when row is unclassified)").alias("possible_values"),
    )


def classification_tokens(sectioned: DataFrame, marker: str = CLASS_MARKER) -> DataFrame:
    """Upper-case tokens between the marker paragraph and the next numbered heading (K4)."""
    text = F.col("text")
    paragraph = F.col("kind") == "p"
    starts = paragraph & text.contains(marker)
    stops = paragraph & text.rlike(X.SECTION_PATTERN) & ~text.contains("calc_")
    state = F.when(starts, F.lit(True)).when(stops, F.lit(False))
    inside = carry_forward(sectioned, state, "__on").filter(F.col("__on") & paragraph & ~starts)
    tokens = inside.select("doc_id", "block_no", F.posexplode(F.split("text", "[·—]")).alias("pos", "token"))
    tokens = tokens.withColumn("token", X.stripped(F.col("token"))).filter(F.col("token").rlike(X.TOKEN_PATTERN))
    # repeats leave before the list is built: a list holds distinct tokens only
    first = tokens.groupBy("doc_id", "token").agg(F.min(F.struct("block_no", "pos")).alias("at"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "token")))
    return first.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda t: t["token"]), " · ").alias("tokens"))


def catalogue(blocks: DataFrame, caveats: dict[str, str] | None = None) -> DataFrame:
    """One row per documented variable of a document, first mention wins.

    ``caveats`` has the caveats that a documentation states in its prose, by variable; ``PROSE_CAVEATS`` by default.
    """
    sectioned = section_fill(number_tables(blocks))
    records = table_records(sectioned).unionByName(dummy_records(sectioned))
    fields = ["section", "table_no", *FIELDS]
    first = records.groupBy("doc_id", "variable").agg(
        F.min_by(F.struct(*fields), F.struct("block_no", "line")).alias("r")
    )
    out = first.select("doc_id", "variable", "r.*").join(classification_tokens(sectioned), "doc_id", "left")
    listed = (F.col("variable") == CLASS_VARIABLE) & F.col("tokens").isNotNull()
    out = out.withColumn("possible_values", F.when(listed, F.col("tokens")).otherwise(F.col("possible_values")))
    return describe(out.drop("tokens"), PROSE_CAVEATS if caveats is None else caveats)


def describe(records: DataFrame, caveats: dict[str, str]) -> DataFrame:
    """Unit, quality marker and caveats of each variable (K5-K7)."""
    name = F.col("variable")
    known = F.create_map(*[F.lit(x) for pair in caveats.items() for x in pair]).cast("map<string,string>")
    return records.withColumns(
        {
            "unit": X.unit_of(name, F.col("type")),
            "is_quality_or_status_flag": name.rlike(X.QUALITY_PATTERN),
            "invalid_or_caveat_conditions": X.caveat_text([F.col("meaning"), F.col("possible_values")], known[name]),
        }
    )


def declared_vs_found(blocks: DataFrame, found: DataFrame, total: str = TOTAL_PATTERN) -> DataFrame:
    """Per document: stated total, sum of the group table, variables extracted (K8)."""
    stated = F.regexp_extract("text", total, 1)
    totals = blocks.filter((F.col("kind") == "p") & F.col("text").rlike(total)).groupBy("doc_id")
    totals = totals.agg(F.min_by(stated, "block_no").try_cast("long").alias("declared_total"))
    header = F.get(F.col("rows"), 0)
    groups = blocks.filter(
        (F.col("kind") == "table") & (F.get(header, 0) == GROUP_HEADER[0]) & (F.get(header, 1) == GROUP_HEADER[1])
    )
    groups = groups.groupBy("doc_id").agg(F.min_by("rows", "block_no").alias("rows"))
    counts = F.transform(F.expr("slice(rows, 2, size(rows))"), lambda r: F.get(r, 1).try_cast("long"))
    groups = groups.select(
        "doc_id", F.aggregate(counts, F.lit(0).cast("long"), lambda s, v: s + F.coalesce(v, F.lit(0))).alias("declared_in_groups")
    )
    extracted = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("extracted"))
    return totals.join(groups, "doc_id", "full").join(extracted, "doc_id", "full")


def text_rebuild(blocks: DataFrame) -> DataFrame:
    """Document text from its blocks, in block order (K9).

    The result is one cell per document, so a document's blocks fit one row by definition.
    """
    line = F.when(F.col("kind") == "p", F.concat(F.lit("["), F.col("style"), F.lit("] "), F.col("text"))).otherwise(
        F.concat_ws(
            "\n",
            F.concat(F.lit("=== TABLE "), F.col("table_no").cast("string"), F.lit(" ===")),
            F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ")), "\n"),
            F.lit("=== END TABLE ==="),
        )
    )
    ordered = F.sort_array(F.collect_list(F.struct("block_no", line.alias("line"))))
    numbered = number_tables(blocks)
    return numbered.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda b: b["line"]), "\n").alias("text"))
