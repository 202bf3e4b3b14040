"""Cell values as native Column expressions: null tokens, typed parsers, date layouts, signatures.

Two families with different rules live side by side:

* ``cell_*`` follow the grammar of the intake tables (a number is digits, plain or with correct thousands commas, ...).
* the other functions follow the survey's F01-F15 (exponents, ``.5``, nine date layouts).

All return NULL for NULL input unless stated otherwise, never raise and never call Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for a missing cell.
NULL_TOKENS = ["", "na", "n/a", "null", "none", "nan", "-", "--", "#n/a", "nil"]
TRUE_TOKENS = ["true", "t", "yes", "y"]
FALSE_TOKENS = ["false", "f", "no", "n"]
# Date layouts in the order in which they are tried.
DATE_TOKENS = ["ymd-", "ymd/", "mdy/", "dmy/", "dmy.", "dmy-", "mdy-", "dmy-mon", "ymd."]
DATE_PATTERNS = {
    "ymd-": "yyyy-M-d",
    "ymd/": "yyyy/M/d",
    "ymd.": "yyyy.M.d",
    "mdy/": "M/d/yyyy",
    "mdy-": "M-d-yyyy",
    "dmy/": "d/M/yyyy",
    "dmy.": "d.M.yyyy",
    "dmy-": "d-M-yyyy",
    "dmy-mon": "d-MMM-yyyy",
}
# The layouts that a cell of the intake tables may have.
CELL_DATE_TOKENS = ["ymd-", "ymd/", "mdy/", "dmy/", "dmy.", "dmy-mon"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_UNSIGNED = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
_MONEY = r"(?:\$|€|£|USD|EUR|GBP|CAD)"
CELL_INT = r"^[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)$"
CELL_NUMBER = rf"^[+-]?{_UNSIGNED}$"
CELL_CURRENCY = rf"^(?:\([+-]?(?:{_MONEY} ?)?{_UNSIGNED}(?: ?{_MONEY})?\)|[+-]?(?:{_MONEY} ?)?{_UNSIGNED}(?: ?{_MONEY})?)$"
CELL_PERCENT = r"^[+-]?\d+(?:\.\d+)? ?%$"
#: White space as Python's ``str.strip`` knows it.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _visible_ends(c: Column) -> Column:
    """Whether a text begins and ends with a visible ASCII sign."""
    visible = lambda x: F.ascii(x).between(33, 126)
    return visible(c) & visible(F.right(c, F.lit(1)))


def strip(c: Column) -> Column:
    """Outer white space of any kind removed. Most cells begin and end with a visible ASCII sign and pass as they are."""
    return F.when(_visible_ends(c), c).otherwise(F.btrim(c, F.lit(SPACES)))


def is_null_like(c: Column) -> Column:
    """True for NULL, blank and the null tokens in any case; never NULL."""
    return c.isNull() | F.coalesce(F.lower(strip(c)).isin(NULL_TOKENS), F.lit(True))


def present(c: Column) -> Column:
    """The trimmed cell, or NULL where it is null-like (no null token has more than four bytes)."""
    s = strip(c)
    return F.when((F.octet_length(s) > 4) | ~F.lower(s).isin(NULL_TOKENS), s)


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9.+-]", "")


_BARE = r"^[+-]?[0-9]+(?:[.][0-9]+)?$"


def trimmed_number(s: Column) -> Column:
    """A number, currency or percent of the intake grammar as double, of a trimmed cell; brackets negate; NULL if it is none.

    Most numbers are bare digits and pass by the first, simple pattern.
    """
    value = F.when(s.rlike(CELL_CURRENCY) | s.rlike(CELL_PERCENT), _plain(s).try_cast("double"))
    return F.when(s.rlike(_BARE), s.try_cast("double")).otherwise(F.when(s.startswith("("), -F.abs(value)).otherwise(value))


def cell_number(c: Column) -> Column:
    """`trimmed_number` of a cell with its outer white space."""
    return trimmed_number(strip(c))


def cell_date(c: Column) -> Column:
    """The date under any layout of the intake grammar, first layout that fits."""
    s = strip(c)
    return F.coalesce(*[parse_date_as(s, t) for t in CELL_DATE_TOKENS])


def date_shape(token: str) -> str:
    """The strict shape of a layout: a four-digit year, one or two digits for day and month."""
    order, sep = token[:3], token[3]
    if token == "dmy-mon":
        return r"^\d{1,2}-[A-Za-z]{3,}-\d{4}$"
    part = {"y": r"\d{4}", "m": r"\d{1,2}", "d": r"\d{1,2}"}
    return "^" + ("\\" + sep).join(part[x] for x in order) + "$"


def _calendar(y: Column, m: Column, d: Column) -> Column:
    """The date of three numbers, NULL where no such day exists; no exception is raised and caught per row."""
    return F.when(_exists(y, m, d), F.make_date(y, m, d))


def parse_date_as(c: Column, token: str) -> Column:
    """The date under one layout, NULL where the text has another shape or the day doesn't exist."""
    part = F.split(c, "[" + "\\" + token[3] + "]")
    at = {x: F.get(part, i) for i, x in enumerate(token[:3])}
    number = lambda x: at[x].try_cast("int")
    month = F.when(F.length(at["m"]) >= 3, F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(at["m"], 1, 3))).cast("int")) if token.endswith("-mon") else number("m")
    return F.when(c.rlike(date_shape(token)), _calendar(number("y"), month, number("d")))


_ANY_DATE = r"^(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-[A-Za-z]{3,}-\d{4})$"


#: The same with the layouts that only profiling knows.
_ANY_DATE_WIDE = _ANY_DATE[:-2] + r"|\d{4}\.\d{1,2}\.\d{1,2}|\d{1,2}-\d{1,2}-\d{4})$"


def with_is_date(df: DataFrame, cell: str, out: str, only: Column | None = None, wide: bool = False) -> DataFrame:
    """Adds whether a trimmed cell is a date under any layout, NULL where ``only`` doesn't hold.

    ``wide`` takes all layouts of `DATE_TOKENS` and timestamps; else the layouts of the intake grammar.

    The parts are columns of their own, so that each is computed once per row.
    """
    only = F.lit(True) if only is None else only
    df = df.withColumn("_text", strip_time(F.col(cell)) if wide else F.col(cell))
    c = F.col("_text")
    df = df.withColumn("_part", F.when(only & c.rlike(_ANY_DATE_WIDE if wide else _ANY_DATE), F.split(c, "[-/.]")))
    df = df.withColumn("_a", F.get("_part", F.lit(0)).try_cast("int")).withColumn("_c", F.get("_part", F.lit(2)).try_cast("int"))
    df = df.withColumn("_b", F.coalesce(F.get("_part", F.lit(1)).try_cast("int"), F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.get("_part", F.lit(1)), 1, 3))).cast("int")))

    a, b, z = F.col("_a"), F.col("_b"), F.col("_c")
    valid = F.when(F.length(F.get("_part", F.lit(0))) == 4, _exists(a, b, z)).when((F.substring(c, -5, 1) == ".") | F.get("_part", F.lit(1)).rlike("[A-Za-z]"), _exists(z, b, a)).otherwise(_exists(z, a, b) | _exists(z, b, a))
    return df.withColumn(out, F.when(only, F.col("_part").isNotNull() & F.coalesce(valid, F.lit(False)))).drop("_text", "_part", "_a", "_b", "_c")


def with_layout_flags(df: DataFrame, cell: str) -> DataFrame:
    """Adds ``_is_<i>`` for each of `DATE_TOKENS`: whether the trimmed cell is a date under that layout."""
    df = df.withColumn("_part", F.split(cell, "[-/.]"))
    for i in range(3):
        df = df.withColumn(f"_n{i}", F.get("_part", F.lit(i)).try_cast("int"))
    df = df.withColumn("_m", F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.get("_part", F.lit(1)), 1, 3))).cast("int"))
    for i, token in enumerate(DATE_TOKENS):
        at = {x: F.col(f"_n{k}") for k, x in enumerate(token[:3])}
        month = F.col("_m") if token.endswith("-mon") else at["m"]
        df = df.withColumn(f"_is_{i}", F.col(cell).rlike(date_shape(token)) & F.coalesce(_exists(at["y"], month, at["d"]), F.lit(False)))
    return df.drop("_part", "_n0", "_n1", "_n2", "_m")


def _exists(y: Column, m: Column, d: Column) -> Column:
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 29).otherwise(28)).otherwise(31)
    return (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last)


# --- the survey's profiling functions ---------------------------------------------------------------------------------

_STRICT_GROUPS = r"(?:\d{1,3}(?:,\d{3})+|\d+)"
INT_RE = rf"^[+-]?{_STRICT_GROUPS}$"
FLOAT_RE = rf"^[+-]?(?:{_STRICT_GROUPS}(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
CURRENCY_RE = rf"^\(?[+-]?(?:[$€£¥₹]|USD|EUR|GBP|CAD|JPY|CHF|AUD|INR)? ?[+-]?(?:{_STRICT_GROUPS}(?:\.\d*)?|\.\d+) ?(?:[$€£¥₹]|USD|EUR|GBP|CAD|JPY|CHF|AUD|INR)?\)?$"
MARKER_RE = r"[$€£¥₹(]|USD|EUR|GBP|CAD|JPY|CHF|AUD|INR"
PERCENT_RE = rf"^[+-]?(?:{_STRICT_GROUPS}(?:\.\d*)?|\.\d+) ?%$"


def parse_int(c: Column) -> Column:
    s = F.trim(c)
    return F.when(s.rlike(INT_RE), F.replace(s, F.lit(","), F.lit("")).try_cast("bigint"))


def parse_float(c: Column) -> Column:
    s = F.trim(c)
    return F.when(s.rlike(FLOAT_RE), F.replace(s, F.lit(","), F.lit("")).try_cast("double"))


def parse_currency(c: Column) -> Column:
    """Brackets have to be balanced; brackets or a minus sign negate."""
    s = F.trim(c)
    balanced = s.startswith("(") == s.endswith(")")
    digits = F.regexp_replace(s, r"[^0-9.]", "").try_cast("double")
    negative = s.startswith("(") | s.contains("-")
    return F.when(s.rlike(CURRENCY_RE) & balanced, F.when(negative, -digits).otherwise(digits))


def has_currency_marker(c: Column) -> Column:
    return c.rlike(MARKER_RE)


def parse_percent(c: Column) -> Column:
    """In percent units: 13% is 13."""
    s = F.trim(c)
    return F.when(s.rlike(PERCENT_RE), F.regexp_replace(s, r"[,% ]", "").try_cast("double"))


def parse_bool(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin(TRUE_TOKENS), F.lit(True)).when(s.isin(FALSE_TOKENS), F.lit(False))


def strip_time(c: Column) -> Column:
    """The date part of a timestamp text."""
    ch = F.substring(c, 11, 1)
    return F.when((ch == "T") | ((ch == " ") & F.substring(c, 12, 1000).contains(":")), F.substring(c, 1, 10)).otherwise(c)


def parse_date(c: Column, token: str | None = None) -> Column:
    s = strip_time(F.trim(c))
    return parse_date_as(s, token) if token else F.coalesce(*[parse_date_as(s, t) for t in DATE_TOKENS])


def numeric_value(c: Column) -> Column:
    return F.coalesce(parse_float(c), parse_currency(c), parse_percent(c))


def pattern_signature(c: Column, max_len: int = 24) -> Column:
    """Runs of digits, upper-case letters, other letters and spaces collapsed to 9, A, a and a space."""
    s = F.substring(c, 1, 64)
    for pattern, to in ((r"\p{Nd}", "9"), (r"\p{Lu}", "A"), (r"[\p{L}&&[^A]]", "a"), (r"\s", " "), (r"(.)\1+", "$1")):
        s = F.regexp_replace(s, pattern, to)
    return F.substring(s, 1, max_len)


def currency_fits(c: Column) -> Column:
    return strip(c).rlike(CELL_CURRENCY)


def fits_type(c: Column, kind: str, token: str | None = None) -> Column:
    """Whether a present cell fits an inferred type of the intake tables."""
    s = strip(c)
    if kind == "int":
        return s.rlike(CELL_INT)
    if kind == "float":
        return s.rlike(CELL_NUMBER)
    if kind == "currency":
        return s.rlike(CELL_CURRENCY)
    if kind == "percent":
        return s.rlike(CELL_PERCENT)
    if kind == "bool":
        return F.lower(s).isin(TRUE_TOKENS + FALSE_TOKENS)
    if kind == "date":
        return (parse_date_as(s, token) if token in DATE_PATTERNS else cell_date(s)).isNotNull()
    return F.lit(True)
