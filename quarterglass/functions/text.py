"""Column expressions for the variable catalogue's text work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Invisible direction marks removed from every text.
BIDI_MARKS = "[‎‏‪-‮⁦-⁩]"

# Patterns of headings, variable names and quality columns.
SECTION_PATTERN = r"^(\d{1,2}(?:\.\d{1,2})?)\.?\s+(\D.{0,70})$"
VARIABLE_PATTERN = r"^[a-z][a-z0-9_]*$"
COMBO_PATTERN = r"^calc_(nopat|raw|roic)_combo__[a-z_]+$"
TOKEN_PATTERN = r"^[A-Z_]{4,}$"
QUALITY_PATTERN = r"(?:status|quality_flag|interpretation_valid|inputs_complete|residual)"
FRAGMENT_SPLIT = r"(?<!\d)[.](?!\d)|[·;]"
CAVEAT_TRIGGERS = r"(?:NaN|ריק|חסר משמעות|מכני|אינו תקף|UNCLASSIFIED|מוטה|שלילי כש)"

# Units by variable name, first hit wins.
_CATEGORY = (
    r"(status|flag|effect|movement|direction|regime|combination|structure|classification"
    r"|dominant_driver$|dominant_driver_effect|explanation)"
)
_BOOLEAN = r"(interpretation_valid|inputs_complete|creates_value|has_opposing)"
_PLAIN_TEXT = ("symbol", "company", "sector", "industry", "period_key", "period_quarter")
_WACC_RATE = r"^calc_wacc_.*(?:rate|weight|cost|premium|annual|quarterly)"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Direction marks out, runs of blanks and tabs squeezed, ends trimmed."""
    squeezed = F.regexp_replace(F.regexp_replace(text, BIDI_MARKS, ""), r"[ \t]+", " ")
    return stripped(squeezed)


def unit_of(name: Column, declared_type: Column) -> Column:
    """Unit of a documented variable from its name and declared type."""
    quarterly = F.when(name.contains("quarterly"), "quarterly ratio (decimal)").otherwise("ratio (decimal)")
    is_ratio = name.rlike(r"tax_rate|debt_to_equity|ev_to_fcf|_ratio$")
    return (
        F.when(name.rlike(r"^calc_(nopat|raw|roic)_combo__"), "indicator int8 (0/1)")
        .when(declared_type.startswith("טקסט YYYY"), "date (YYYY-MM-DD text)")
        .when(name.rlike(_CATEGORY), "category / text")
        .when(name.rlike(_BOOLEAN), "boolean")
        .when(name.endswith("_count"), "count (0-3)")
        .when(name.isin(*_PLAIN_TEXT), "text")
        .when(name == "period_year", "integer year")
        .when(
            name == "valuations__per_share_data__month_end_stock_price",
            "price per share (currency not stated in dictionary)",
        )
        .when(
            name == "valuations__per_share_data__shares_outstanding",
            "number of shares (scale not stated in dictionary)",
        )
        .when(name.startswith("calc_roic_") & name.contains("annualized"), "annual ratio (decimal)")
        .when(name.startswith("calc_roic_") | name.rlike(_WACC_RATE), quarterly)
        .when(is_ratio, "ratio (decimal)")
        .otherwise("API reporting currency units (USD millions for AAPL per dictionary)")
    )


def caveat_text(sources: list[Column], literal: Column, triggers: str = CAVEAT_TRIGGERS) -> Column:
    """Sentence fragments that carry a trigger word, then the literal caveat, repeats removed.

    All work stays inside the row: fragments of one text never leave it.
    """

    def picked(text: Column) -> Column:
        fragments = F.transform(F.split(F.coalesce(text, F.lit("")), FRAGMENT_SPLIT), lambda f: stripped(f))
        return F.filter(fragments, lambda f: f.rlike(triggers))

    own = F.when(F.coalesce(literal, F.lit("")) != "", F.array(literal)).otherwise(F.array().cast("array<string>"))
    pieces = F.concat(*[picked(s) for s in sources], own)
    return F.array_join(F.array_distinct(F.filter(pieces, lambda f: f != "")), " | ")
