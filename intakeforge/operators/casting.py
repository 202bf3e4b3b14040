"""Typed casts of staged text: one projection per batch, native expressions, unparseable cells become NULL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeforge.functions.values import parse_date_as

# What numeric text may carry besides the number.
MONEY_TOKENS = ["$", "€", "£", "¥", "USD", "EUR", "GBP", "CAD", "JPY", "CHF", "AUD"]
TRUE_CELLS = ["true", "t", "yes", "y", "1"]
FALSE_CELLS = ["false", "f", "no", "n", "0"]
GROUPED = r"^-?\d{1,3}(,\d{3})+(\.\d*)?$"
SPARK_TYPES: dict[str, T.DataType] = {"string": T.StringType(), "integer": T.LongType(), "number": T.DecimalType(38, 6), "date": T.DateType(), "boolean": T.BooleanType()}
LINEAGE = ["_source_file", "_sheet", "_row_number", "_content_hash", "_ingested_at"]


@dataclass(frozen=True)
class ColumnPlan:
    """One output column: its type, the staged column it comes from (None: a typed NULL) and the date layout."""

    output: str
    kind: str = "string"
    source: str | None = None
    date_format: str = "ymd-"


def quoted(name: str) -> Column:
    """A column whose header may hold dots, brackets or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def cast_string(c: Column) -> Column:
    """Trimmed text; only blank text is NULL (null tokens such as n/a stay)."""
    return F.nullif(F.trim(c), F.lit(""))


def number_text(c: Column) -> Column:
    """Numeric text without signs of money, percent and spaces; an opening bracket becomes a minus sign."""
    s = F.upper(F.trim(c))
    for token in [*MONEY_TOKENS, "%", " ", ")"]:
        s = F.replace(s, F.lit(token), F.lit(""))
    s = F.replace(s, F.lit("("), F.lit("-"))
    # Commas count only as thousands groups before the point.
    return F.when(~s.contains(","), s).when(s.rlike(GROUPED), F.replace(s, F.lit(","), F.lit("")))


def cast_number(c: Column) -> Column:
    return number_text(c).try_cast("decimal(38,6)")


def cast_integer(c: Column) -> Column:
    """Half away from zero."""
    return F.round(cast_number(c)).cast("bigint")


def cast_date(c: Column, token: str = "ymd-") -> Column:
    return parse_date_as(F.trim(c), token)


def cast_boolean(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin(TRUE_CELLS), F.lit(True)).when(s.isin(FALSE_CELLS), F.lit(False))


def cast_column(p: ColumnPlan) -> Column:
    if p.source is None:
        return F.lit(None).cast(SPARK_TYPES[p.kind]).alias(p.output)
    c = quoted(p.source)
    out = {"string": cast_string, "integer": cast_integer, "number": cast_number, "boolean": cast_boolean}.get(p.kind)
    return (cast_date(c, p.date_format) if p.kind == "date" else out(c)).alias(p.output)


def conform(staged: DataFrame, plan: list[ColumnPlan], keep: list[str] | None = None) -> DataFrame:
    """Schema fields in plan order, then what is kept as it is (lineage)."""
    kept = [k for k in (LINEAGE if keep is None else keep) if k in staged.columns]
    return staged.select(*[cast_column(p) for p in plan], *[quoted(k) for k in kept])
