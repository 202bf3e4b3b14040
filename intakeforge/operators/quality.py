"""Column-level data quality of loads: mask profiles, null and parse rates, distributions, and breaks between loads.

Every cell is generalised to a character-class mask and counted by (load, column, mask); masks are few, so the map side
combines almost everything before the one small shuffle. Null shares, parse rates, pattern and range violations and the
divergence of masks all come from that table. Only columns whose distinct values or distribution matter are counted by
value as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intakeforge.functions import values as V
from intakeforge.operators.versions import distinct_deliveries, with_previous
from intakeforge.session import cut

# The columns of the invoice table and what is asked of them.
TEXT_COLUMNS = ["invoice_number", "line_number", "invoice_date", "vendor_id", "vendor_name", "sku", "description", "qty", "unit_price", "line_total", "tax_pct", "currency", "po_number", "due_date"]
NUMBER_COLUMNS = ["line_number", "qty", "unit_price", "line_total"]
DATE_COLUMNS = ["invoice_date", "due_date"]
DISTINCT_COLUMNS = ["sku", "description", "po_number"]
QUANTILE_COLUMNS = ["qty", "unit_price"]
SHARE_COLUMNS = ["currency", "tax_pct"]
RANGE_COLUMNS = ["qty", "unit_price", "line_total"]
PO_PATTERN = "^PO-[0-9]+$"
CURRENCIES = ["USD", "EUR", "GBP", "CAD"]

_UPPER, _LOWER, _DIGITS = "BCDEFGHIJKLMNOPQRSTUVWXYZ", "bcdefghijklmnopqrstuvwxyz", "012345678"


def mask(c: Column) -> Column:
    """Character-class mask of the whole value, runs marked by ``+``: ``PO-123`` is ``A+-9+``. NULL stays NULL."""
    s = F.translate(c, _UPPER + _LOWER + _DIGITS, "A" * 25 + "a" * 25 + "9" * 9)
    # Of ASCII cells all letters are translated.
    s = F.when(F.octet_length(s) == F.length(s), s).otherwise(F.regexp_replace(s, r"[\p{L}&&[^Aa]]", "a"))
    return F.regexp_replace(s, r"([9Aa\s])\1+", "$1+")


def literal_mask(c: Column) -> Column:
    """The mask of codes, whose letters are part of the pattern: only digits are generalised, ``PO-123`` is ``PO-9+``."""
    return F.regexp_replace(F.translate(c, _DIGITS, "9" * 9), "9+", "9+")


ROLES = {"number": NUMBER_COLUMNS, "date": DATE_COLUMNS, "listed": ["po_number", "currency"]}


def _by_role(columns: list[str]) -> list[tuple[str | None, list[str]]]:
    """The columns by what is asked of their values, so that no cell is tested for another column's role."""
    tested = [c for own in ROLES.values() for c in own]
    parts = [(r, [c for c in own if c in columns]) for r, own in ROLES.items()] + [(None, [c for c in columns if c not in tested])]
    return [(r, own) for r, own in parts if own]


def _cells(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return rows.select(key, *columns).unpivot([key], columns, "source_column", "cell").withColumn("cell", V.present(F.col("cell")))


def _typed(cells: DataFrame, role: str | None, masked: bool) -> DataFrame:
    """Adds to trimmed cells what their role asks: number, parsed, conform, outside, and the mask."""
    cell, name = F.col("cell"), F.col("source_column")
    number, parsed, conform = F.lit(None).cast("double"), F.lit(False), F.lit(False)
    if role == "number":
        cells = cells.withColumn("number", V.trimmed_number(cell))
        number, parsed = F.col("number"), F.col("number").isNotNull()
    elif role == "date":
        cells, parsed = V.with_is_date(cells, "cell", "is_date"), F.coalesce("is_date", F.lit(False))
    elif role == "listed":
        conform = F.coalesce(F.when(name == "po_number", cell.rlike(PO_PATTERN)).otherwise(cell.isin(CURRENCIES)), F.lit(False))
    outside = F.coalesce(name.isin(RANGE_COLUMNS) & ((number < 0.01) | (number > 1_000_000)), F.lit(False))
    m = (literal_mask if role == "listed" else mask)(cell) if masked else F.when(cell.isNotNull(), F.lit("*"))
    kept = [c for c in cells.columns if c not in ("number", "is_date")]
    return cells.select(*kept, number.alias("number"), parsed.alias("parsed"), conform.alias("conform"), outside.alias("outside"), m.alias("mask"))


def _by_mask(typed: DataFrame, key: str, n: Column) -> DataFrame:
    part = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    return typed.groupBy(key, "source_column", "mask").agg(
        F.sum(n).alias("n"), part(F.col("parsed")).alias("parsed"), part(F.col("conform")).alias("conform"), part(F.col("number").isNotNull()).alias("numbers"), part(F.col("outside")).alias("outside"), F.min("number").alias("low"), F.max("number").alias("high")
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mask_profile(rows: DataFrame, key: str = "source_object_id", columns: list[str] | None = None, masked: bool | None = None) -> DataFrame:
    """Counts by (load, column, mask): n, parsed (numbers or dates), conform (pattern or allowed values), numbers, outside.

    ``mask`` is NULL for null-like cells. With ``masked`` False only columns with a role get masks, others ``*``. Extra
    columns of ``rows`` are not read; a NULL load is a load of its own. The map side combines: masks are few.
    """
    return _union([_by_mask(_typed(_cells(rows, key, own), role, masked is not False or role is not None), key, F.lit(1)) for role, own in _by_role(columns or TEXT_COLUMNS)])


def dominant_masks(masks: DataFrame, share: float) -> DataFrame:
    """(source_column, mask): the masks that hold that share of a column's present cells over all loads, 1 / share at most."""
    m = masks.filter("mask IS NOT NULL").groupBy("source_column", "mask").agg(F.sum("n").alias("mn"))
    total = m.groupBy("source_column").agg(F.sum("mn").alias("cn"))
    return m.join(total, "source_column").filter(F.col("mn") >= share * F.col("cn")).select("source_column", "mask")


#: A mask with so large a share of a column's cells is part of its pattern.
DOMINANT_SHARE = 0.1
#: Columns whose values are counted one by one: few per load, or asked for by value.
VALUE_COLUMNS = [*DISTINCT_COLUMNS, *QUANTILE_COLUMNS, *SHARE_COLUMNS, *DATE_COLUMNS, "line_number"]


def value_table(rows: DataFrame, key: str = "source_object_id") -> DataFrame:
    """(load, column, cell, n) with what its role asks of each distinct value; ``cell`` is NULL for the null-like ones."""
    counted = [(role, _cells(rows, key, own).groupBy(key, "source_column", "cell").agg(F.count(F.lit(1)).alias("n"))) for role, own in _by_role(VALUE_COLUMNS)]
    return _union([_typed(c, role, role is not None) for role, c in counted])


def present_counts(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows of `mask_profile` for columns of which only the null share is asked: present cells have the mask ``*``.

    Counted side by side in one row per load, so that no cell becomes a row.
    """
    a = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.count(V.present(F.col(c))).alias(c) for c in columns]).unpivot([key, "_n"], columns, "source_column", "_k")
    both = F.array(F.struct(F.lit(None).cast("string").alias("mask"), (F.col("_n") - F.col("_k")).alias("n")), F.struct(F.lit("*").alias("mask"), F.col("_k").alias("n")))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("double")
    return a.select(key, "source_column", F.explode(both).alias("m")).filter("m.n > 0").select(key, "source_column", "m.mask", "m.n", *[zero.alias(c) for c in ("parsed", "conform", "numbers", "outside")], none.alias("low"), none.alias("high"))


def load_profile(masks: DataFrame, key: str = "source_object_id") -> DataFrame:
    """One row per load and column from its masks: rows, nulls, parse rate, shares of violations, range, dominant mask.

    ``n_rare`` counts the cells whose mask is no part of the pattern that `dominant_masks` mines from all loads.
    """
    kept = F.col("mask").isNotNull()
    pattern = F.broadcast(dominant_masks(masks, DOMINANT_SHARE).withColumn("is_pattern", F.lit(True)))
    masks = masks.join(pattern, ["source_column", "mask"], "left")
    return masks.groupBy(key, "source_column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("n_present"),
        F.sum("parsed").alias("n_parsed"),
        F.sum("conform").alias("n_conform"),
        F.sum("numbers").alias("n_numbers"),
        F.sum("outside").alias("n_outside"),
        F.coalesce(F.sum(F.when(kept & F.col("is_pattern").isNull(), F.col("n"))), F.lit(0)).alias("n_rare"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.count(F.when(kept, True)).alias("n_masks"),
        F.max(F.when(kept, F.struct("n", "mask"))).alias("top"),
    )


def all_values(rows: DataFrame, key: str = "source_object_id") -> DataFrame:
    """(load, column, cell, n) of every distinct value of all text columns; ``cell`` is NULL for the null-like ones."""
    return _cells(rows, key, TEXT_COLUMNS).groupBy(key, "source_column", "cell").agg(F.count(F.lit(1)).alias("n"))


def value_shares(values: DataFrame, profiles: DataFrame, key: str = "source_object_id") -> DataFrame:
    """(origin, load, column, value, n, share) of every value, none left out, of `all_values` (``invoices``) and of the stored profiles.

    The share is of the present cells of the load and column. Stored profiles hold shares without counts.
    """
    K = [key, "source_column"]
    there = values.filter("cell IS NOT NULL")
    total = there.groupBy(*K).agg(F.sum("n").alias("total"))
    loads = there.join(total.select(F.col(key).alias("_k"), F.col("source_column").alias("_c"), "total"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("source_column") == F.col("_c")))
    loads = loads.select(F.lit("invoices").alias("origin"), *K, F.col("cell").alias("value"), F.col("n").cast("double").alias("n"), (F.col("n") / F.col("total")).alias("share"))
    stored = stored_profiles(profiles).select(F.lit("stored").alias("origin"), F.col("source_object_id").alias(key), "source_column", F.explode("top_values").alias("value", "share"))
    return loads.unionByName(stored.withColumn("n", F.lit(None).cast("double")).select(loads.columns))


def stored_profiles(profiles: DataFrame) -> DataFrame:
    """The stored profiles, one row per object and column: of repeated ones that of the least profile_id."""
    cols = ["null_rate", "distinct_count", "row_count", "parse_rates", "top_values"]
    w = Window.partitionBy("source_object_id", "col_name").orderBy("profile_id")
    return profiles.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").select("source_object_id", F.col("col_name").alias("source_column"), *cols)


def full_profile(values: DataFrame, profiles: DataFrame, key: str = "source_object_id", top: int = 10) -> DataFrame:
    """One row per load and column, from exact counts of all its values (``invoices``), and per stored profile (``stored``).

    Every column is tested for integers, numbers (also currency and percent), dates and booleans: ``parse_rates`` are shares
    of the present cells, NULL where there are none. ``low``/``high`` is the range of its numbers, ``first_day``/``last_day``
    that of its dates; days and months with slashes are read in the order that more cells of the column allow, month first
    where both do. ``n_parsed`` counts numbers and dates. ``top_values`` are the shares of the ``top`` most frequent values,
    a report; `value_shares` has all. Stored profiles have no ranges, masks and counts of parsed cells. ``values`` is an
    `all_values`, which is read twice.
    """
    K = [key, "source_column"]
    cell, n = F.col("cell"), F.col("n")
    part = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    slashed = cell.rlike(V.date_shape("mdy/"))
    plain = F.when(cell.rlike("^[0-9]{1,4}[-/.]"), F.coalesce(*[V.parse_date_as(cell, t) for t in V.CELL_DATE_TOKENS if t not in ("mdy/", "dmy/")]))
    t = values.withColumn("number", V.trimmed_number(cell)).withColumn("mask", mask(cell))
    t = t.withColumn("plain", plain).withColumn("mdy", F.when(slashed, V.parse_date_as(cell, "mdy/"))).withColumn("dmy", F.when(slashed, V.parse_date_as(cell, "dmy/")))
    us, eu = F.coalesce("plain", "mdy", "dmy"), F.coalesce("plain", "dmy", "mdy")
    by_mask = t.groupBy(*K, "mask").agg(
        F.sum("n").alias("n"), F.count("cell").alias("n_distinct"), part(F.col("number").isNotNull()).alias("n_numbers"), part(us.isNotNull()).alias("n_dates"),
        part(cell.rlike(V.CELL_INT)).alias("n_integers"), part(F.lower("cell").isin([*V.TRUE_TOKENS, *V.FALSE_TOKENS, "0", "1"])).alias("n_booleans"),
        F.min("number").alias("low"), F.max("number").alias("high"), part(F.col("mdy").isNotNull()).alias("n_mdy"), part(F.col("dmy").isNotNull()).alias("n_dmy"),
        F.min(us).alias("us_low"), F.max(us).alias("us_high"), F.min(eu).alias("eu_low"), F.max(eu).alias("eu_high"),
    )
    kept = F.col("mask").isNotNull()
    sums = ["n_distinct", "n_numbers", "n_dates", "n_integers", "n_booleans", "n_mdy", "n_dmy"]
    prof = by_mask.groupBy(*K).agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(kept, n)), F.lit(0)).alias("n_present"), *[F.sum(c).alias(c) for c in sums],
        *[f(c).alias(c) for f, names in ((F.min, ("low", "us_low", "eu_low")), (F.max, ("high", "us_high", "eu_high"))) for c in names],
        F.count(F.when(kept, True)).alias("n_masks"), F.max(F.when(kept, F.struct("n", "mask"))).alias("top"),
    )
    w = Window.partitionBy(*K).orderBy(F.desc("n"), "cell")
    first = values.filter("cell IS NOT NULL").withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= top)
    first = first.groupBy(F.col(key).alias("_k"), F.col("source_column").alias("_c")).agg(F.array_sort(F.collect_list(F.struct("_rank", "cell", "n"))).alias("_top"))
    j = prof.join(first, F.col(key).eqNullSafe(F.col("_k")) & (F.col("source_column") == F.col("_c")), "left")
    rate = lambda c: F.when(F.col("n_present") > 0, F.col(c) / F.col("n_present"))
    rates = F.when(F.col("n_present") > 0, F.create_map(*[x for name in ("integer", "number", "date", "boolean") for x in (F.lit(name), rate(f"n_{name}s"))]))
    shares = F.map_from_entries(F.transform("_top", lambda x: F.struct(x["cell"], x["n"] / F.col("n_present"))))
    european = F.col("n_dmy") > F.col("n_mdy")
    day = lambda side: F.when(european, F.col(f"eu_{side}")).otherwise(F.col(f"us_{side}"))
    loads = j.select(
        F.lit("invoices").alias("origin"), *K, "n_rows", "n_present", (1 - F.col("n_present") / F.col("n_rows")).alias("null_rate"), "n_distinct", (F.col("n_numbers") + F.col("n_dates")).alias("n_parsed"), "n_numbers", rates.alias("parse_rates"),
        "low", "high", day("low").alias("first_day"), day("high").alias("last_day"), "n_masks", F.col("top.mask").alias("dominant_mask"), shares.alias("top_values"),
    )
    stored = stored_profiles(profiles).select(F.lit("stored").alias("origin"), F.col("source_object_id").alias(key), "source_column", F.col("row_count").alias("n_rows"), "null_rate", F.col("distinct_count").alias("n_distinct"), "parse_rates", "top_values")
    return loads.unionByName(stored, allowMissingColumns=True)


def quantile_edges(numbers: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """``edges``, the distinct values at positions min(n-1, round_half_even(i*n/bins)) of each sorted group.

    ``numbers`` has the keys, ``number`` and its count ``n``; a number may have several rows. Ranks are found in two levels, over value ranges and inside
    them, so that a group of any size is never sorted in one task.
    """
    v = F.col("number")
    b = numbers.withColumn("range", F.floor(F.signum(v) * F.log2(1 + F.abs(v)) * 16))
    whole = Window.partitionBy(*keys)
    ranges = b.groupBy(*keys, "range").agg(F.sum("n").alias("rn"))
    ranges = ranges.select(*keys, "range", F.coalesce(F.sum("rn").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("rn").over(whole).alias("total"))
    # Half to even in whole numbers: i * total / bins is never a double.
    names = [f"_at_{i}" for i in range(1, bins)]
    for i, name in enumerate(names, 1):
        whole_, rest = F.expr(f"({i} * total) div {bins}"), F.expr(f"({i} * total) % {bins}")
        ranges = ranges.withColumn(name, F.least(F.col("total") - 1, whole_ + F.when(2 * rest > bins, 1).when(2 * rest == bins, whole_ % 2).otherwise(0)))

    def holds(low: Column, high: Column) -> Column:
        hit = F.lit(False)
        for name in names:
            hit = hit | ((F.col(name) >= low) & (F.col(name) < high))
        return hit

    # Only ranges that hold one of the positions are sorted.
    wanted = ranges.filter(holds(F.col("before"), F.col("before") + F.col("rn"))).select(*keys, "range", "before", *names)
    within = Window.partitionBy(*keys, "range").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.col("upto")
    # Hashed by partition: a few rows of each group, which would be broadcast by their compressed size.
    ranked = b.join(wanted.hint("shuffle_hash"), [*keys, "range"]).withColumn("upto", F.sum("n").over(within))
    return ranked.filter(holds(upto - F.col("n"), upto)).groupBy(*keys).agg(F.array_sort(F.collect_set("number")).alias("edges"))


def bin_of(number: Column, edges: Column, bins: int = 10) -> Column:
    """The number of edges below a number; spelled out, so that it is compiled with its stage."""
    out = F.lit(0)
    for i in range(bins - 1):
        out = out + F.when(number > F.get(edges, F.lit(i)), 1).otherwise(0)
    return out


def psi(pairs: DataFrame, keys: list[str], floor: float = 1e-4) -> DataFrame:
    """Population stability index over rows (keys, bin, expected, actual) of counts; both shares are floored.

    ``n_expected`` and ``n_actual`` are the group's totals.
    """
    cells = pairs.groupBy(*keys, "bin").agg(F.sum("expected").alias("e"), F.sum("actual").alias("a"))
    totals = pairs.groupBy(*keys).agg(F.sum("expected").alias("n_expected"), F.sum("actual").alias("n_actual"))
    share = lambda c, t: F.greatest(F.when(F.col(t) > 0, F.col(c) / F.col(t)).otherwise(F.lit(0.0)), F.lit(floor))
    j = cells.join(totals, keys).withColumn("es", share("e", "n_expected")).withColumn("as", share("a", "n_actual"))
    return j.groupBy(*keys).agg(F.sum((F.col("as") - F.col("es")) * F.log(F.col("as") / F.col("es"))).alias("psi"), F.max("n_expected").alias("n_expected"), F.max("n_actual").alias("n_actual"))


def load_shifts(values: DataFrame, before: DataFrame, key: str = "source_object_id") -> DataFrame:
    """PSI of each load and column against the load before: quantile bins for numbers, value shares for categories.

    ``values`` is a `value_table`, which is read several times.
    """
    K = [key, "source_column"]
    prev = before.select(F.col(key), F.col("prev_object_id")).filter("prev_object_id IS NOT NULL")
    numbers = values.filter(F.col("source_column").isin(QUANTILE_COLUMNS) & F.col("number").isNotNull()).select(*K, "number", "n")
    edges = cut(quantile_edges(numbers, K))
    # Every number is binned once by the edges of its own load, for the load after it, and by those of the load before.
    old = edges.select(F.col(key).alias("prev_object_id"), "source_column", F.col("edges").alias("old_edges")).join(prev, "prev_object_id").select(*K, "old_edges")
    number = F.col("number")
    binned = numbers.join(edges.join(old, K, "left").hint("shuffle_hash"), K).select(*K, "n", bin_of(number, F.col("edges")).cast("string").alias("own"), F.when(F.col("old_edges").isNotNull(), bin_of(number, F.col("old_edges")).cast("string")).alias("bin"))
    binned = cut(binned.groupBy(*K, "own", "bin").agg(F.sum("n").alias("n")))
    zero = F.lit(0).cast("long")
    expected = binned.select(F.col(key).alias("prev_object_id"), "source_column", F.col("own").alias("bin"), F.col("n").alias("expected"), zero.alias("actual"))
    # Its file is far smaller than its rows, so that it would be broadcast by the file's size.
    expected = expected.hint("merge").join(prev, "prev_object_id").select(key, "source_column", "bin", "expected", "actual")
    actual = binned.filter("bin IS NOT NULL").select(*K, "bin", zero.alias("expected"), F.col("n").alias("actual"))
    shares = values.filter(F.col("source_column").isin(SHARE_COLUMNS) & F.col("cell").isNotNull()).select(*K, F.col("cell").alias("value"), "n")
    e2 = shares.withColumnRenamed(key, "prev_object_id").join(prev, "prev_object_id").select(key, "source_column", F.col("value").alias("bin"), F.col("n").alias("expected"), F.lit(0).cast("long").alias("actual"))
    a2 = shares.join(prev, key).select(key, "source_column", F.col("value").alias("bin"), F.lit(0).cast("long").alias("expected"), F.col("n").alias("actual"))
    return psi(cut(expected.unionByName(actual).unionByName(e2).unionByName(a2)), K)


def invoice_issues(rows: DataFrame, before: DataFrame) -> DataFrame:
    """(source_object_id, source_column, issue) for the loads of the invoice table.

    ``before`` has the object before of each (`versions.with_previous`). Shares over no rows, or no present cells, are
    undefined and raise no issue. Unknown loads, and the first of a feed, are only tested for pattern and range.
    """
    key, K = "source_object_id", ["source_object_id", "source_column"]
    # Read several times below, and far smaller than the rows: computed once, in the shared checkpoint folder. Of columns
    # without a test of their values only the null share counts, so that their masks aren't built.
    values = cut(value_table(rows))
    rest = [c for c in TEXT_COLUMNS if c not in VALUE_COLUMNS]
    tested = [c for c in rest if any(c in own for own in ROLES.values())]
    others = mask_profile(rows, columns=tested).unionByName(present_counts(rows, key, [c for c in rest if c not in tested]))
    prof = cut(load_profile(cut(_by_mask(values, key, F.col("n")).unionByName(others))))
    distinct = values.filter(F.col("source_column").isin(DISTINCT_COLUMNS) & F.col("cell").isNotNull()).groupBy(*K).agg(F.count(F.lit(1)).alias("n_distinct"))
    now = prof.join(distinct, K, "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
    link = before.select(key, "prev_object_id")
    old = now.select(F.col(key).alias("prev_object_id"), "source_column", F.struct("n_rows", "n_present", "n_parsed", "n_distinct").alias("old"))
    j = now.join(link, key, "left").join(old, ["prev_object_id", "source_column"], "left").join(load_shifts(values, before), K, "left")
    name = F.col("source_column")
    null_rate = lambda p: 1 - F.col(f"{p}n_present") / F.col(f"{p}n_rows")
    rate = lambda p: F.when(F.col(f"{p}n_present") > 0, F.col(f"{p}n_parsed") / F.col(f"{p}n_present"))
    known = F.col("old.n_rows").isNotNull()
    over = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)) > 0.05
    tests = [
        ("null_rate_shift", known & (F.abs(null_rate("") - null_rate("old.")) > 0.2)),
        ("parse_rate_drop", name.isin(NUMBER_COLUMNS + DATE_COLUMNS) & (rate("old.") - rate("") > 0.2)),
        ("distinct_collapse", name.isin(DISTINCT_COLUMNS) & known & (F.col("old.n_distinct") >= 10) & (F.col("n_distinct") < 0.2 * F.col("old.n_distinct"))),
        ("distribution_shift", name.isin(QUANTILE_COLUMNS + SHARE_COLUMNS) & (F.col("psi") > 0.25) & (F.col("n_expected") >= 50) & (F.col("n_actual") >= 50)),
        # The mined pattern proposes loads, the exact one confirms them.
        ("pattern_violation", name.isin("po_number", "currency") & over("n_rare", "n_present") & (F.when(F.col("n_present") > 0, 1 - F.col("n_conform") / F.col("n_present")) > 0.05)),
        ("range_violation", name.isin(RANGE_COLUMNS) & over("n_outside", "n_numbers")),
    ]
    return _issues(j, tests)


def _issues(j: DataFrame, tests: list[tuple[str, Column]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(test, F.lit(issue)) for issue, test in tests]))
    return j.select("source_object_id", "source_column", F.explode(found).alias("issue"))


def profile_issues(profiles: DataFrame, before: DataFrame) -> DataFrame:
    """(source_object_id, source_column, issue) from stored column profiles; repeated profiles of a column count once."""
    cols = ["null_rate", "distinct_count", "parse_rates", "top_values"]
    pairs = lambda m: F.array_sort(F.map_entries(m))
    p = profiles.select("source_object_id", F.col("col_name").alias("source_column"), "profile_id", "null_rate", "distinct_count", pairs("parse_rates").alias("parse_rates"), pairs("top_values").alias("top_values"))
    p = p.filter("source_object_id IS NOT NULL AND source_column IS NOT NULL").groupBy("source_object_id", "source_column").agg(F.min(F.struct("profile_id", *cols)).alias("r")).select("source_object_id", "source_column", *[F.col(f"r.{c}").alias(c) for c in cols])
    p = p.withColumn("parse_rates", F.map_from_entries("parse_rates")).withColumn("top_values", F.map_from_entries("top_values"))
    link = before.select("source_object_id", "prev_object_id")
    old = p.select(F.col("source_object_id").alias("prev_object_id"), "source_column", F.struct(*cols).alias("old"))
    j = p.join(link, "source_object_id").join(old, ["prev_object_id", "source_column"])
    get = lambda m, k: F.greatest(F.coalesce(F.element_at(m, k), F.lit(0.0)), F.lit(1e-4))
    keys = F.array_union(F.map_keys("top_values"), F.map_keys("old.top_values"))
    index = F.aggregate(keys, F.lit(0.0), lambda acc, k: acc + (get(F.col("top_values"), k) - get(F.col("old.top_values"), k)) * F.log(get(F.col("top_values"), k) / get(F.col("old.top_values"), k)))
    shared = F.array_intersect(F.map_keys("parse_rates"), F.map_keys("old.parse_rates"))
    drop = F.exists(shared, lambda k: F.element_at(F.col("old.parse_rates"), k) - F.element_at(F.col("parse_rates"), k) > 0.2)
    return _issues(
        j,
        [
            ("null_rate_shift", F.abs(F.col("null_rate") - F.col("old.null_rate")) > 0.2),
            ("distinct_collapse", (F.col("old.distinct_count") >= 10) & (F.col("distinct_count") < 0.2 * F.col("old.distinct_count"))),
            ("parse_rate_drop", drop),
            ("distribution_shift", (F.size("top_values") > 0) & (F.size("old.top_values") > 0) & (index > 0.25)),
        ],
    )


def quality_issues(rows: DataFrame, profiles: DataFrame, objects: DataFrame) -> DataFrame:
    """Breaks of every load in the invoice table and in the stored profiles."""
    before = cut(with_previous(distinct_deliveries(objects)).select("source_object_id", "prev_object_id"))
    return invoice_issues(rows, before).unionByName(profile_issues(profiles, before))


def mask_report(rows: DataFrame, objects: DataFrame, rare: float = 0.01) -> DataFrame:
    """Mask mining per load and column: dominant mask and share, share of rare-mask cells, divergence from the load before.

    A mask is rare where it holds less than ``rare`` of the column's present cells over all loads. The divergence is the
    population stability index over masks; NULL where there is no load before. ``n_before`` are the present cells of that load, 0 without one.
    """
    key, K = "source_object_id", ["source_object_id", "source_column"]
    m = cut(_cells(rows, key, TEXT_COLUMNS).select(*K, mask(F.col("cell")).alias("mask")).filter("mask IS NOT NULL").groupBy(*K, "mask").agg(F.count(F.lit(1)).alias("n")))
    usual = dominant_masks(m, rare).withColumn("usual", F.lit(True))
    per = m.join(F.broadcast(usual), ["source_column", "mask"], "left").groupBy(*K).agg(F.sum("n").alias("n_present"), F.count(F.lit(1)).alias("n_masks"), F.max(F.struct("n", "mask")).alias("top"), F.sum(F.when(F.col("usual").isNull(), F.col("n")).otherwise(0)).alias("n_rare"))
    prev = with_previous(distinct_deliveries(objects)).select(key, "prev_object_id").filter("prev_object_id IS NOT NULL")
    prev = cut(prev)
    e = m.withColumnRenamed(key, "prev_object_id").join(prev, "prev_object_id").select(*K, F.col("mask").alias("bin"), F.col("n").alias("expected"), F.lit(0).cast("long").alias("actual"))
    a = m.join(prev, key).select(*K, F.col("mask").alias("bin"), F.lit(0).cast("long").alias("expected"), F.col("n").alias("actual"))
    div = psi(e.unionByName(a), K).filter("n_expected > 0 AND n_actual > 0").select(*K, F.col("psi").alias("mask_divergence"), F.col("n_expected").alias("n_before"))
    return per.join(div, K, "left").fillna(0, ["n_before"]).select(*K, "n_present", "n_masks", F.col("top.mask").alias("dominant_mask"), (F.col("top.n") / F.col("n_present")).alias("dominant_share"), (F.col("n_rare") / F.col("n_present")).alias("rare_share"), "n_before", "mask_divergence")


def mask_breaks(report: DataFrame, rare: float = 0.05, divergence: float = 0.25, least: int = 50) -> DataFrame:
    """(source_object_id, source_column, issue, figure): ``rare_masks`` where more than ``rare`` of a load's cells have rare masks,
    ``mask_shift`` where the masks diverge from the load before, with at least ``least`` cells in both."""
    tests = [("rare_masks", F.col("rare_share") > rare, F.col("rare_share")), ("mask_shift", (F.col("mask_divergence") > divergence) & (F.col("n_present") >= least) & (F.col("n_before") >= least), F.col("mask_divergence"))]
    found = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(issue).alias("issue"), figure.alias("figure"))) for issue, t, figure in tests]))
    return report.select("source_object_id", "source_column", F.explode(found).alias("f")).select("source_object_id", "source_column", "f.issue", "f.figure")
