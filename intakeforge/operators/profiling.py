"""Column profiles of staged text in long form: counts, parse rates, inferred types, samples, signatures, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intakeforge.functions import values as V
from intakeforge.operators.casting import quoted
from intakeforge.session import cut

THRESHOLD = 0.95


def unpivot(rows: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(kept columns, column_name, value): one row per cell, values as text."""
    keep = keep or []
    cast = rows.select(*[quoted(k) for k in keep], *[quoted(c).cast("string").alias(c) for c in columns])
    return cast.unpivot([quoted(k) for k in keep], [quoted(c) for c in columns], "column_name", "value")


def null_distinct(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_rows, n_null, n_distinct over trimmed present values, by column."""
    by = [*(by or []), "column_name"]
    p = V.present(F.col("value"))
    return cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(p.isNull()).alias("n_null"), F.count_distinct(p).alias("n_distinct"))


def _type_flags() -> dict[str, Column]:
    v = F.col("value")
    return {
        "bool": V.parse_bool(v).isNotNull(),
        "int": V.parse_int(v).isNotNull(),
        "float": V.parse_float(v).isNotNull(),
        "percent": V.parse_percent(v).isNotNull(),
        "currency": V.parse_currency(v).isNotNull(),
        "marker": V.parse_currency(v).isNotNull() & V.has_currency_marker(v),
        "date": F.col("is_date"),
    }


def value_counts(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, value, n) of the distinct trimmed values, NULL for the null-like ones: each is parsed once, however often it occurs."""
    return cells.withColumn("value", V.present(F.col("value"))).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))


def _cells_that(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))


def parse_counts(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_present and how many present cells parse as integer, number, date and boolean (which also takes 0 and 1)."""
    by = [*(by or []), "column_name"]
    p = V.with_is_date(value_counts(cells, by).filter("value IS NOT NULL"), "value", "is_date", wide=True)
    v = F.col("value")
    return p.groupBy(*by).agg(
        F.sum("n").alias("n_present"),
        _cells_that(V.parse_int(v).isNotNull()).alias("n_integer"),
        _cells_that(V.numeric_value(v).isNotNull()).alias("n_number"),
        _cells_that(F.col("is_date")).alias("n_date"),
        _cells_that(V.parse_bool(v).isNotNull() | v.isin("0", "1")).alias("n_boolean"),
    )


def infer_types(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """inferred_type by the ordered tests bool, int, float, percent, currency with a sign of money, date; else string or empty."""
    by = [*(by or []), "column_name"]
    p = V.with_is_date(value_counts(cells, by), "value", "is_date", wide=True)
    flags = _type_flags()
    a = p.groupBy(*by).agg(_cells_that(F.col("value").isNotNull()).alias("n"), *[_cells_that(f).alias(f"n_{k}") for k, f in flags.items()])
    return a.select(*by, _inferred().alias("inferred_type"))


def detect_date_formats(cells: DataFrame, by: list[str]) -> DataFrame:
    """The first layout that most present cells have, where these are at least 95 %; NULL else."""
    p = V.with_layout_flags(cells.withColumn("value", V.strip_time(V.present(F.col("value")))).filter("value IS NOT NULL"), "value")
    a = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"_is_{i}").alias(f"n_{i}") for i in range(len(V.DATE_TOKENS))])
    best = F.greatest(*[F.col(f"n_{i}") for i in range(len(V.DATE_TOKENS))])
    token = F.coalesce(*[F.when(F.col(f"n_{i}") == best, F.lit(t)) for i, t in enumerate(V.DATE_TOKENS)])
    return a.select(*by, F.when(best / F.col("n") >= THRESHOLD, token).alias("date_format"))


def cell_types(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(column_name, cell_type, n): cells that are empty, numbers (also money and percent), dates or other text."""
    by = [*(by or []), "column_name"]
    p = V.with_is_date(value_counts(cells, by), "value", "is_date", wide=True)
    kind = F.when(F.col("value").isNull(), "empty").when(V.numeric_value(F.col("value")).isNotNull(), "number").when(F.col("is_date"), "date").otherwise("string")
    return p.groupBy(*by, kind.alias("cell_type")).agg(F.sum("n").alias("n"))


def first_seen_sample(cells: DataFrame, order: str, by: list[str] | None = None, k: int = 5) -> DataFrame:
    """The first k distinct present values with their first place; a report, k is part of it."""
    by = [*(by or []), "column_name"]
    d = cells.withColumn("value", V.present(F.col("value"))).filter("value IS NOT NULL").groupBy(*by, "value").agg(F.min(order).alias("first_seen"))
    w = Window.partitionBy(*by).orderBy("first_seen", "value")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_signatures(cells: DataFrame, order: str, by: list[str] | None = None, k: int = 3) -> DataFrame:
    """The k most frequent pattern signatures (ties: first seen) with their counts."""
    by = [*(by or []), "column_name"]
    p = cells.withColumn("value", V.present(F.col("value"))).filter("value IS NOT NULL")
    d = p.groupBy(*by, V.pattern_signature(F.col("value")).alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "first_seen")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def histogram(numbers: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by bin, the number of edges strictly below the value. ``numbers``: keys, number, n."""
    j = numbers.join(edges, keys) if keys else numbers.crossJoin(F.broadcast(edges))
    return j.groupBy(*keys, F.size(F.filter("edges", lambda e: F.col("number") > e)).alias("bin")).agg(F.sum("n").alias("n"))


def category_shares(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count and share of each present value within its column."""
    by = [*(by or []), "column_name"]
    d = cells.withColumn("value", V.present(F.col("value"))).filter("value IS NOT NULL").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    total = d.groupBy(*by).agg(F.sum("n").alias("total"))
    return d.join(total, by).withColumn("share", F.col("n") / F.col("total")).drop("total")


TOP_DISTINCT = 50


def table_profile(cells: DataFrame, order: str) -> DataFrame:
    """One row per column of a table in long form: counts, type, date layout, parse rates, samples, signatures, frequent values.

    ``order`` tells which of the cells was seen first. Rates are of the present cells, NULL without any; ``null_rate`` is 1 for no rows.
    ``samples`` are the first five distinct values, ``signatures`` the three most frequent ones with their shares; ``top_values`` has the
    shares of all values of a column that is not numeric and has no more than 50. Each distinct value is parsed once.
    """
    by = ["column_name"]
    base = cut(cells.withColumn("value", V.present(F.col("value"))).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen")))
    v = F.col("value")
    flags = _type_flags() | {"number": V.numeric_value(v).isNotNull(), "boolean": V.parse_bool(v).isNotNull() | v.isin("0", "1")}
    a = V.with_is_date(base, "value", "is_date", wide=True).groupBy(*by).agg(F.sum("n").alias("n_rows"), _cells_that(v.isNotNull()).alias("n"), F.count("value").alias("distinct_count"), *[_cells_that(f).alias(f"n_{k}") for k, f in flags.items()])
    there = base.filter("value IS NOT NULL")
    days = V.with_layout_flags(there.withColumn("value", V.strip_time(v)), "value").groupBy(*by).agg(*[_cells_that(F.col(f"_is_{i}")).alias(f"d_{i}") for i in range(len(V.DATE_TOKENS))])
    w = Window.partitionBy(*by).orderBy("first_seen", "value")
    seen = there.withColumn("_r", F.row_number().over(w)).filter("_r <= 5").groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value"))), lambda x: x["value"]).alias("samples"))
    sig = there.groupBy(*by, V.pattern_signature(v).alias("signature")).agg(F.sum("n").alias("k"), F.min("first_seen").alias("first_seen"))
    sig = sig.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("k"), "first_seen", "signature"))).filter("_r <= 3").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_r", "signature", "k"))).alias("sig"))
    few = there.join(a.filter((F.col("distinct_count") <= TOP_DISTINCT)).select(*by), by, "left_semi").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "value", "n"))).alias("top"))
    j = a.join(days, by, "left").join(seen, by, "left").join(sig, by, "left").join(few, by, "left")
    rate = lambda k: F.when(F.col("n") > 0, F.col(f"n_{k}") / F.col("n"))
    best = F.greatest(*[F.col(f"d_{i}") for i in range(len(V.DATE_TOKENS))])
    token = F.coalesce(*[F.when(F.col(f"d_{i}") == best, F.lit(t)) for i, t in enumerate(V.DATE_TOKENS)])
    kind = _inferred()
    share = lambda pairs, k, x: F.map_from_entries(F.transform(pairs, lambda y: F.struct(y[k], y[x] / F.col("n"))))
    return j.select(
        *by, "n_rows", F.when(F.col("n_rows") > 0, 1 - F.col("n") / F.col("n_rows")).otherwise(1.0).alias("null_rate"), "distinct_count", kind.alias("inferred_type"),
        F.when((kind == "date") & (best / F.col("n") >= THRESHOLD), token).alias("date_format"), rate("int").alias("rate_integer"), rate("number").alias("rate_number"), rate("date").alias("rate_date"), rate("boolean").alias("rate_boolean"),
        "samples", share(F.col("sig"), "signature", "k").alias("signatures"), F.when(~kind.isin("int", "float", "percent", "currency"), share(F.col("top"), "value", "n")).alias("top_values"),
    )


def _inferred() -> Column:
    rate = lambda k: F.col(f"n_{k}") / F.col("n") >= THRESHOLD
    return (
        F.when(F.col("n") == 0, "empty").when(rate("bool"), "bool").when(rate("int"), "int").when(rate("float"), "float").when(rate("percent"), "percent")
        .when(rate("currency") & (F.col("n_marker") > 0), "currency").when(rate("date"), "date").otherwise("string")
    )


def header_scores(lines: DataFrame, file: str = "source_object_id", row: str = "row_idx", scan: int = 20, ahead: int = 15) -> DataFrame:
    """Score of each of the first ``scan`` lines of a file as its header; ``lines`` has the file, the row and ``cells``.

    Mostly text, no repeats, wide, and columns of one kind below it. Only the first scan + ahead lines of a file count, which
    is what the score is defined on.
    """
    head = lines.select(file, row, "cells").filter(F.col(row) < scan + ahead)
    cell = head.select(file, row, F.posexplode("cells").alias("j", "raw")).withColumn("value", V.present(F.col("raw")))
    v = F.col("value")
    cell = V.with_is_date(cell.withColumn("is_number", V.numeric_value(v).isNotNull()), "value", "is_date", wide=True)
    kind = F.when(F.col("is_number"), "number").when(F.col("is_date"), "date").otherwise("string")
    cell = cell.withColumn("kind", F.when(v.isNotNull(), kind))
    width = head.groupBy(file).agg(F.max(F.size("cells")).alias("width"))
    full = cell.filter("value IS NOT NULL")
    per = full.groupBy(file, row).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "string").alias("n_text"), F.count_distinct(F.lower("value")).alias("n_distinct"))
    cand = per.filter(F.col(row) < scan)
    below = cand.select(file, F.col(row).alias("at")).join(full, file).filter((F.col(row) > F.col("at")) & (F.col(row) <= F.col("at") + ahead))
    kinds = below.groupBy(file, "at", "j", "kind").agg(F.count(F.lit(1)).alias("k"))
    cols = kinds.groupBy(file, "at", "j").agg((F.max("k") / F.sum("k")).alias("modal"))
    shape = cols.groupBy(file, F.col("at").alias(row)).agg(F.avg("modal").alias("consistency"), F.count(F.lit(1)).alias("populated"))
    j = cand.join(width, file).join(shape, [file, row], "left").fillna(0, ["consistency", "populated"])
    fill = F.col("n") / F.col("width")
    score = 1.5 * F.col("n_text") / F.col("n") + F.col("n_distinct") / F.col("n") + 2.0 * fill + 1.5 * F.col("consistency") * F.col("populated") / F.col("width") - F.when(fill < 0.5, 0.6).otherwise(0.0)
    return j.select(file, row, score.alias("score"))


def detect_headers(scores: DataFrame, file: str = "source_object_id", row: str = "row_idx") -> DataFrame:
    """The best row per file (scores to four places, ties to the earliest)."""
    return scores.groupBy(file).agg(F.max(F.struct(F.round("score", 4).alias("s"), (-F.col(row)).alias("r"))).alias("b")).select(file, (-F.col("b.r")).alias("header_row"))
