"""Text to date with an explicit list of formats; nothing is guessed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def parse_date(text: Column, formats: Sequence[str]) -> Column:
    """First format that fits wins; NULL when none does."""
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def format_hit(text: Column, formats: Sequence[str]) -> Column:
    """The format that parsed the text, NULL when blank or unparsable."""
    ladder = F.lit(None).cast("string")
    for fmt in reversed(formats):
        ladder = F.when(F.try_to_date(text, fmt).isNotNull(), F.lit(fmt)).otherwise(ladder)
    return ladder
