"""Delimited records as lines of text: written from tables, parsed under a schema, the unreadable ones rescued.

A record is one value of a text column, so quoted fields may hold separators, quotes and line breaks, and records parse
where they are, in any number of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESCUED = "_rescued"
_QUOTES = {"quote": '"', "escape": '"'}
#: Only the empty field is NULL, and no field loses spaces or is cut for its length.
_READ = _QUOTES | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RESCUED, "multiLine": "true", "maxCharsPerColumn": "-1", "maxColumns": "100000"}
_WRITE = _QUOTES | {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": "", "emptyValue": ""}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def to_line(names: Sequence[str]) -> Column:
    """The named columns of a row as one record."""
    return F.to_csv(F.struct(*[F.col(quoted(n)).cast("string").alias(n) for n in names]), _WRITE)


def parse_lines(lines: DataFrame, names: Sequence[str], line_col: str = "line") -> DataFrame:
    """All columns of ``lines``, the fields of each record as text, and ``_rescued``.

    A record with more or fewer fields than ``names``, such as one cut short or with an open quote, is not spread over
    fields that may not be its own: all its fields are NULL and ``_rescued`` keeps its whole text. It is NULL otherwise.
    A NULL line has NULL fields and nothing to rescue.
    """
    schema = ", ".join(f"{quoted(n)} string" for n in (*names, RESCUED))
    # generated, not projected: a condition on a projected record would be pushed below it and write and parse it once more
    parsed = lines.select("*", F.explode(F.array(F.from_csv(line_col, schema, _READ))).alias("__r"))
    bad = F.col(f"__r.{RESCUED}")
    fields = [F.when(bad.isNull(), F.col(f"__r.{quoted(n)}")).alias(n) for n in names]
    return parsed.select(*[quoted(c) for c in lines.columns], *fields, bad.alias(RESCUED))


def append_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts under one set of columns, by name and in order of first appearance; what a part lacks is NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
