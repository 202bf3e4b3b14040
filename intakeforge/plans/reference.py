"""Queries of the survey's operators: casts, materialization, profiles, drift statistics, resolvers, audit."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intakeforge.functions import values as V
from intakeforge.operators import audit, casting, chain, drift_events, loading, materialize, profiling, quality, records, resolving
from intakeforge.operators.casting import ColumnPlan
from intakeforge.operators.versions import distinct_deliveries, with_previous
from intakeforge.plans.intake import _VERSIONS_SQL
from intakeforge.plans.registry import Registry
from intakeforge.session import cut, ensure_checkpoint_dir, table

registry = Registry()


def _money(c: str, sign: str = "$"):  # noqa: ANN202
    return F.concat(F.lit(sign), F.format_number(F.col(c), 2))


def _day(c: str, pattern: str):  # noqa: ANN202
    return F.date_format(F.col(c).cast("date"), pattern)


# --- casts ------------------------------------------------------------------------------------------------------------


@registry.add(
    """WITH staged AS (SELECT CAST(o_orderkey AS VARCHAR) "Order No.", ' ' || o_orderstatus || ' ' "Status (code)", format('{:,.2f}', o_totalprice) "Total", strftime(o_orderdate, '%m/%d/%Y') "Order Date" FROM orders)
SELECT CAST(round(TRY_CAST("Order No." AS DECIMAL(38, 6))) AS BIGINT) order_no, nullif(trim("Status (code)"), '') status, CAST(TRY_CAST(replace("Total", ',', '') AS DECIMAL(38, 6)) AS DOUBLE) total,
  strftime(TRY_STRPTIME("Order Date", '%m/%d/%Y'), '%Y-%m-%d') order_date, CAST(NULL AS VARCHAR) remark FROM staged"""
)
def c_typed_cast_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    staged = o.select(F.col("o_orderkey").cast("string").alias("Order No."), F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")).alias("Status (code)"), F.format_number("o_totalprice", 2).alias("Total"), _day("o_orderdate", "MM/dd/yyyy").alias("Order Date"))
    plan = [ColumnPlan("order_no", "integer", "Order No."), ColumnPlan("status", "string", "Status (code)"), ColumnPlan("total", "number", "Total"), ColumnPlan("order_date", "date", "Order Date", "mdy/"), ColumnPlan("remark")]
    return casting.conform(staged, plan).withColumn("total", F.col("total").cast("double")).withColumn("order_date", F.col("order_date").cast("string"))


@registry.add(
    r"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN '$' || format('{:,.2f}', l_extendedprice) WHEN 'R' THEN '(' || format('{:,.2f}', l_extendedprice) || ' EUR)' ELSE '1.234,' || format('{:.0f}', l_quantity) END raw FROM lineitem),
s AS (SELECT *, replace(replace(replace(replace(replace(upper(trim(raw)), '$', ''), 'EUR', ''), ' ', ''), ')', ''), '(', '-') n FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, raw, CAST(TRY_CAST(CASE WHEN NOT contains(n, ',') THEN n WHEN regexp_full_match(n, '-?[0-9]{1,3}(,[0-9]{3})+([.][0-9]*)?') THEN replace(n, ',', '') END AS DECIMAL(38, 6)) AS DOUBLE) amount FROM s"""
)
def c_currency_number_cast(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("l_returnflag") == "A", _money("l_extendedprice")).when(F.col("l_returnflag") == "R", F.concat(F.lit("("), F.format_number("l_extendedprice", 2), F.lit(" EUR)"))).otherwise(F.concat(F.lit("1.234,"), F.col("l_quantity").cast("bigint").cast("string")))
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))
    return t.withColumn("amount", casting.cast_number(F.col("raw")).cast("double"))


@registry.add(
    "SELECT p_partkey, CAST(round(TRY_CAST(CAST(CAST(p_size AS DECIMAL(18, 1)) + 0.5 AS VARCHAR) AS DECIMAL(38, 6))) AS BIGINT) up, CAST(round(TRY_CAST('-' || CAST(CAST(p_size AS DECIMAL(18, 1)) + 0.5 AS VARCHAR) AS DECIMAL(38, 6))) AS BIGINT) down FROM part"
)
def c_integer_rounding(spark: SparkSession, d: str) -> DataFrame:
    text = (F.col("p_size").cast("decimal(18,1)") + F.lit("0.5").cast("decimal(2,1)")).cast("string")
    return table(spark, d, "part").select("p_partkey", casting.cast_integer(text).alias("up"), casting.cast_integer(F.concat(F.lit("-"), text)).alias("down"))


@registry.add(
    """SELECT o_orderkey, strftime(TRY_STRPTIME(strftime(o_orderdate, '%m/%d/%Y'), '%m/%d/%Y'), '%Y-%m-%d') mdy, strftime(TRY_STRPTIME(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y'), '%Y-%m-%d') dmy, strftime(TRY_STRPTIME(strftime(o_orderdate, '%d-%b-%Y'), '%d-%b-%Y'), '%Y-%m-%d') named,
  strftime(TRY_STRPTIME(strftime(o_orderdate, '%d/%m/%Y'), '%m/%d/%Y'), '%Y-%m-%d') wrong FROM orders"""
)
def c_date_layouts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    parse = lambda pattern, token: casting.cast_date(_day("o_orderdate", pattern), token).cast("string")
    return o.select("o_orderkey", parse("MM/dd/yyyy", "mdy/").alias("mdy"), parse("dd.MM.yyyy", "dmy.").alias("dmy"), parse("dd-MMM-yyyy", "dmy-mon").alias("named"), parse("dd/MM/yyyy", "mdy/").alias("wrong"))


@registry.add(
    "SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false WHEN 'signup' THEN true WHEN 'error' THEN false END flag FROM events"
)
def c_boolean_cast(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    raw = F.when(t == "click", " Yes ").when(t == "view", "N").when(t == "signup", "1").when(t == "error", "0").otherwise("maybe")
    return table(spark, d, "events").select("event_id", casting.cast_boolean(raw).alias("flag"))


# --- materialization --------------------------------------------------------------------------------------------------

_LINE = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@registry.add(f"SELECT {', '.join(_LINE)} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in _LINE[2:])}) = 1")
def w_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(*_LINE)
    return materialize.latest_per_key(rows, ["l_orderkey", "l_linenumber"], [F.col("l_shipdate")])


@registry.add("SELECT o_orderstatus, count(*) rows_staged, count(*) FILTER (o_totalprice < 1000 OR o_orderpriority = '1-URGENT') rows_rejected FROM orders GROUP BY 1")
def m_reject_counters(spark: SparkSession, d: str) -> DataFrame:
    key = F.when((F.col("o_totalprice") >= 1000) & (F.col("o_orderpriority") != "1-URGENT"), F.col("o_orderkey"))
    o = table(spark, d, "orders").withColumn("order_key", key)
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows_staged"), F.count_if(~materialize.has_key(["order_key"])).alias("rows_rejected"))


_UPSERT_SQL = """WITH target AS (SELECT o_orderkey, o_totalprice price, o_orderpriority prio FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
source AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice * 2 END price, o_orderstatus ext_status FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
SELECT COALESCE(t.o_orderkey, s.o_orderkey) o_orderkey, CASE WHEN s.o_orderkey IS NOT NULL THEN s.price ELSE t.price END price, t.prio, s.ext_status FROM target t FULL OUTER JOIN source s ON t.o_orderkey = s.o_orderkey"""


@registry.add(_UPSERT_SQL)
def m_upsert_two_batches(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    target = o.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("prio"))
    source = o.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") * 2).alias("price"), F.col("o_orderstatus").alias("ext_status"))
    return materialize.upsert(target, source, ["o_orderkey"])


@registry.add(
    "SELECT c_custkey party_id, c_name party_name, c_nationkey nation_id, c_acctbal balance, c_mktsegment ext_segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier"
)
def m_schema_evolution_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("party_id"), F.col("c_name").alias("party_name"), F.col("c_nationkey").alias("nation_id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("ext_segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("party_id"), F.col("s_name").alias("party_name"), F.col("s_nationkey").alias("nation_id"), F.col("s_acctbal").alias("balance"))
    return materialize.accumulate([c, s])


_INVOICE_PLAN = {"invoice_number": "invoice_number", "line_number": "line_number", "vendor_id": "supplier_id", "vendor_name": "supplier_name", "sku": "sku", "description": "item_description", "qty": "quantity", "unit_price": "unit_price", "line_total": "line_total", "currency": "currency", "tax_pct": "ext_tax_pct"}
_NUMBER_TEXT = "upper(trim({0}))"
for _token in ["$", "€", "£", "¥", "USD", "EUR", "GBP", "CAD", "JPY", "CHF", "AUD", "%", " ", ")"]:
    _NUMBER_TEXT = f"replace({_NUMBER_TEXT}, '{_token}', '')"
_NUMBER_TEXT = f"replace({_NUMBER_TEXT}, '(', '-')"


def _as_number(c: str) -> str:
    n = _NUMBER_TEXT.format(c)
    return f"TRY_CAST(CASE WHEN NOT contains({n}, ',') THEN {n} WHEN regexp_full_match({n}, '-?[0-9]{{1,3}}(,[0-9]{{3}})+([.][0-9]*)?') THEN replace({n}, ',', '') END AS DECIMAL(38, 6))"


_TYPED_SQL = f"""typed AS (SELECT ingested_at, line_id, nullif(trim(invoice_number), '') invoice_number, CAST(round({_as_number("line_number")}) AS BIGINT) line_number, nullif(trim(vendor_id), '') supplier_id, nullif(trim(vendor_name), '') supplier_name, nullif(trim(sku), '') sku,
  nullif(trim(description), '') item_description, CAST({_as_number("qty")} AS DOUBLE) quantity, CAST({_as_number("unit_price")} AS DOUBLE) unit_price, CAST({_as_number("line_total")} AS DOUBLE) line_total, nullif(trim(currency), '') currency, nullif(trim(tax_pct), '') ext_tax_pct FROM invoices_2026_08)"""


def _load_invoices(spark: SparkSession, d: str) -> tuple[str, list[loading.LoadResult]]:
    """The invoice lines loaded into a typed table in two batches, by their time of ingest."""
    rows = table(spark, d, "invoices_2026_08")
    fields = [r.asDict() for r in table(spark, d, "field_spec").filter("schema_name = 'supplier_invoice' AND field_name NOT LIKE '%date' AND field_name NOT IN ('tax_rate', 'po_number')").select("field_id", "field_name", "field_type", "is_required").orderBy("field_id").collect()]
    plan = loading.build_plan(_INVOICE_PLAN, fields, rows.columns, ["invoice_number", "line_number"])
    path = f"{ensure_checkpoint_dir(spark)}/invoices-{uuid.uuid4().hex}"
    middle = F.lit("2026-08-15").cast("timestamp_ntz")
    order = [F.col("ingested_at"), F.col("line_id")]
    return path, [loading.load(part, plan, path, order) for part in (rows.filter(F.col("ingested_at") < middle), rows.filter((F.col("ingested_at") >= middle) | F.col("ingested_at").isNull()))]


@registry.add(
    f"""WITH {_TYPED_SQL}, b AS (SELECT *, ingested_at IS NULL OR ingested_at >= TIMESTAMP '2026-08-15' late FROM typed WHERE invoice_number IS NOT NULL AND line_number IS NOT NULL)
SELECT * EXCLUDE (ingested_at, line_id, late) FROM b QUALIFY row_number() OVER (PARTITION BY invoice_number, line_number ORDER BY late DESC, ingested_at DESC NULLS LAST, line_id DESC) = 1"""
)
def m_materialize(spark: SparkSession, d: str) -> DataFrame:
    """Plan, casts, rejects, latest rows, upsert of a second batch and atomic swap: the table as a reader finds it."""
    path, _ = _load_invoices(spark, d)
    out = loading.read_table(spark, path)
    numbers = [c for c, t in out.dtypes if t.startswith("decimal")]
    return out.withColumns({c: F.col(c).cast("double") for c in numbers})


@registry.add(
    f"""WITH {_TYPED_SQL}, b AS (SELECT *, CASE WHEN ingested_at < TIMESTAMP '2026-08-15' THEN 1 ELSE 2 END batch FROM typed)
SELECT batch, count(*) rows_staged, count(DISTINCT (invoice_number, line_number)) FILTER (invoice_number IS NOT NULL AND line_number IS NOT NULL) rows_written, count(*) FILTER (invoice_number IS NULL OR line_number IS NULL) rows_rejected FROM b GROUP BY 1"""
)
def m_load_counters(spark: SparkSession, d: str) -> DataFrame:
    """Rows staged, written and rejected of both loads, as the loads observed them."""
    _, done = _load_invoices(spark, d)
    return spark.createDataFrame([(i, r.rows_staged, r.rows_written, r.rows_rejected) for i, r in enumerate(done, 1)], "batch int, rows_staged long, rows_written long, rows_rejected long")


@registry.add("SELECT o.source_object_id, o.feed_id FROM source_object o WHERE o.raw_table IS NOT NULL AND NOT EXISTS (SELECT 1 FROM invoices_2026_08 i WHERE i.source_object_id = o.source_object_id)")
def m_unmaterialized_objects(spark: SparkSession, d: str) -> DataFrame:
    staged = table(spark, d, "source_object").filter("raw_table IS NOT NULL").select("source_object_id", "feed_id")
    return staged.join(table(spark, d, "invoices_2026_08").select("source_object_id").distinct(), "source_object_id", "left_anti")


@registry.add(
    """SELECT source_object_id, feed_id, content_hash IS NULL OR row_number() OVER (PARTITION BY feed_id, content_hash, sheet_name ORDER BY ingested_at, source_object_id) = 1 is_new FROM source_object"""
)
def s_redelivery_skip(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "source_object").select("source_object_id", "feed_id", "content_hash", F.coalesce("sheet_name", F.lit("")).alias("sheet"), "ingested_at")
    return materialize.new_deliveries(o, ["feed_id", "content_hash", "sheet"], ["ingested_at", "source_object_id"]).select("source_object_id", "feed_id", "is_new")


@registry.add("SELECT sha256(text) content_hash, count(*) copies, min(doc_id) first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1")
def s_content_hash_skip(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    return t.groupBy(F.sha2(F.col("text"), 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


# --- profiles ---------------------------------------------------------------------------------------------------------

_NULL_SQL = "'', 'na', 'n/a', 'null', 'none', 'nan', '-', '--', '#n/a', 'nil'"
_TEXT = ", ".join(quality.TEXT_COLUMNS)
_CELLS_SQL = f"""cells AS (SELECT source_object_id, src_row, line_id, column_name, CASE WHEN lower(trim(value)) NOT IN ({_NULL_SQL}) THEN trim(value) END v
  FROM (SELECT source_object_id, src_row, line_id, {_TEXT} FROM invoices_2026_08) UNPIVOT INCLUDE NULLS (value FOR column_name IN ({_TEXT})))"""
_DIGITS = "([0-9]{1,3}(,[0-9]{3})+|[0-9]+)"
_FLOAT = rf"({_DIGITS}([.][0-9]*)?|[.][0-9]+)"
_SIGN = r"([$€£¥₹]|USD|EUR|GBP|CAD|JPY|CHF|AUD|INR)"
_IS_INT = f"regexp_full_match(v, '[+-]?{_DIGITS}')"
_IS_FLOAT = f"regexp_full_match(v, '[+-]?{_FLOAT}([eE][+-]?[0-9]+)?')"
_IS_PERCENT = f"regexp_full_match(v, '[+-]?{_FLOAT} ?%')"
_IS_MONEY = f"(regexp_full_match(v, '[(]?[+-]?{_SIGN}? ?[+-]?{_FLOAT} ?{_SIGN}?[)]?') AND starts_with(v, '(') = ends_with(v, ')'))"
_IS_BOOL = "lower(v) IN ('true', 't', 'yes', 'y', 'false', 'f', 'no', 'n')"


def _shape(shape: str, fmt: str, text: str = "v") -> str:
    return f"(regexp_full_match({text}, '{shape}') AND TRY_STRPTIME({text}, '{fmt}') IS NOT NULL)"


_LAYOUTS = {
    "ymd-": ("[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "%Y-%m-%d"),
    "ymd/": ("[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}", "%Y/%m/%d"),
    "mdy/": ("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "%m/%d/%Y"),
    "dmy/": ("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "%d/%m/%Y"),
    "dmy.": ("[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}", "%d.%m.%Y"),
    "dmy-": ("[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "%d-%m-%Y"),
    "mdy-": ("[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "%m-%d-%Y"),
    "dmy-mon": ("[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}", "%d-%b-%Y"),
    "ymd.": ("[0-9]{4}[.][0-9]{1,2}[.][0-9]{1,2}", "%Y.%m.%d"),
}
_IS_DATE = "(" + " OR ".join(_shape(*_LAYOUTS[t]) for t in V.DATE_TOKENS) + ")"


def _cells(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    return profiling.unpivot(table(spark, d, "invoices_2026_08"), columns or quality.TEXT_COLUMNS, ["source_object_id", "line_id"])


@registry.add(f"WITH {_CELLS_SQL} SELECT column_name, count(*) n_rows, count(*) - count(v) n_null, count(DISTINCT v) n_distinct FROM cells GROUP BY 1")
def a_profile_nulls_distinct(spark: SparkSession, d: str) -> DataFrame:
    return profiling.null_distinct(_cells(spark, d))


@registry.add(
    f"""WITH {_CELLS_SQL} SELECT column_name, count(v) n_present, count(*) FILTER ({_IS_INT}) n_integer, count(*) FILTER ({_IS_FLOAT} OR {_IS_MONEY} OR {_IS_PERCENT}) n_number,
  count(*) FILTER ({_IS_DATE}) n_date, count(*) FILTER ({_IS_BOOL} OR v IN ('0', '1')) n_boolean FROM cells WHERE v IS NOT NULL GROUP BY 1"""
)
def a_parse_rates(spark: SparkSession, d: str) -> DataFrame:
    return profiling.parse_counts(_cells(spark, d))


@registry.add(
    f"""WITH {_CELLS_SQL}, a AS (SELECT source_object_id, column_name, count(v) n, count(*) FILTER ({_IS_BOOL}) b, count(*) FILTER ({_IS_INT}) i, count(*) FILTER ({_IS_FLOAT}) f, count(*) FILTER ({_IS_PERCENT}) p,
  count(*) FILTER ({_IS_MONEY}) c, count(*) FILTER ({_IS_MONEY} AND regexp_matches(v, '[$€£¥₹(]|USD|EUR|GBP|CAD|JPY|CHF|AUD|INR')) m, count(*) FILTER ({_IS_DATE}) d FROM cells GROUP BY ALL)
SELECT source_object_id, column_name, CASE WHEN n = 0 THEN 'empty' WHEN b / n >= 0.95 THEN 'bool' WHEN i / n >= 0.95 THEN 'int' WHEN f / n >= 0.95 THEN 'float' WHEN p / n >= 0.95 THEN 'percent'
  WHEN c / n >= 0.95 AND m > 0 THEN 'currency' WHEN d / n >= 0.95 THEN 'date' ELSE 'string' END inferred_type FROM a"""
)
def f_infer_type(spark: SparkSession, d: str) -> DataFrame:
    return profiling.infer_types(_cells(spark, d), ["source_object_id"])


_LAYOUT_COUNTS = ", ".join(f"count(*) FILTER ({_shape(*_LAYOUTS[t])}) n{i}" for i, t in enumerate(V.DATE_TOKENS))
_BEST = "greatest(" + ", ".join(f"n{i}" for i in range(len(V.DATE_TOKENS))) + ")"


@registry.add(
    f"""WITH {_CELLS_SQL}, a AS (SELECT source_object_id, column_name, count(*) n, {_LAYOUT_COUNTS} FROM cells WHERE v IS NOT NULL AND column_name IN ('invoice_date', 'due_date') GROUP BY ALL)
SELECT source_object_id, column_name, CASE WHEN {_BEST} / n >= 0.95 THEN CASE {" ".join(f"WHEN n{i} = {_BEST} THEN '{t}'" for i, t in enumerate(V.DATE_TOKENS))} END END date_format FROM a"""
)
def f_detect_date_format(spark: SparkSession, d: str) -> DataFrame:
    return profiling.detect_date_formats(_cells(spark, d, ["invoice_date", "due_date"]), ["source_object_id", "column_name"])


@registry.add(
    f"""WITH {_CELLS_SQL}, a AS (SELECT column_name, count(*) n_rows, count(v) n, count(DISTINCT v) distinct_count, count(*) FILTER ({_IS_BOOL}) b, count(*) FILTER ({_IS_INT}) i, count(*) FILTER ({_IS_FLOAT}) f, count(*) FILTER ({_IS_PERCENT}) p,
  count(*) FILTER ({_IS_MONEY}) c, count(*) FILTER ({_IS_MONEY} AND regexp_matches(v, '[$€£¥₹(]|USD|EUR|GBP|CAD|JPY|CHF|AUD|INR')) m, count(*) FILTER ({_IS_DATE}) d, count(*) FILTER ({_IS_FLOAT} OR {_IS_MONEY} OR {_IS_PERCENT}) nn,
  count(*) FILTER ({_IS_BOOL} OR v IN ('0', '1')) bb, {", ".join(f"count(*) FILTER ({_shape(*_LAYOUTS[t])}) n{k}" for k, t in enumerate(V.DATE_TOKENS))} FROM cells GROUP BY 1),
s AS (SELECT column_name, v, min(line_id) seen FROM cells WHERE v IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY seen, v) <= 5),
t AS (SELECT column_name, string_agg(v, ' | ' ORDER BY seen, v) samples FROM s GROUP BY 1),
k AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN b / n >= 0.95 THEN 'bool' WHEN i / n >= 0.95 THEN 'int' WHEN f / n >= 0.95 THEN 'float' WHEN p / n >= 0.95 THEN 'percent' WHEN c / n >= 0.95 AND m > 0 THEN 'currency' WHEN d / n >= 0.95 THEN 'date' ELSE 'string' END inferred_type,
  greatest({", ".join(f"n{k}" for k in range(len(V.DATE_TOKENS)))}) best FROM a),
q AS (SELECT column_name, string_agg(v || '=' || times, ' | ' ORDER BY times DESC, v) top FROM (SELECT column_name, v, count(*) times FROM cells WHERE v IS NOT NULL GROUP BY 1, 2) JOIN k USING (column_name) WHERE distinct_count <= 50 AND inferred_type NOT IN ('int', 'float', 'percent', 'currency') GROUP BY 1)
SELECT column_name, n_rows, 1 - n / n_rows null_rate, distinct_count, inferred_type, CASE WHEN inferred_type = 'date' AND best / n >= 0.95 THEN CASE {" ".join(f"WHEN n{k} = best THEN '{t}'" for k, t in enumerate(V.DATE_TOKENS))} END END date_format,
  i / n rate_integer, nn / n rate_number, d / n rate_date, bb / n rate_boolean, samples, top top_values FROM k LEFT JOIN t USING (column_name) LEFT JOIN q USING (column_name)"""
)
def a_table_profile(spark: SparkSession, d: str) -> DataFrame:
    """The whole invoice table, one row per column."""
    p = profiling.table_profile(_cells(spark, d), "line_id")
    there = F.col("n_rows") * (1 - F.col("null_rate"))
    top = F.array_sort(F.transform(F.map_entries("top_values"), lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("k"), F.round(e["value"] * there).cast("long").cast("string").alias("c"))))
    return p.withColumn("samples", F.array_join("samples", " | ")).withColumn("top_values", F.array_join(F.transform(top, lambda x: F.concat(x["k"], F.lit("="), x["c"])), " | ")).drop("signatures")


_SIGNATURE_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[0-9]+', '9', 'g'), '[A-Z]+', 'A', 'g'), '[a-z]+', 'a', 'g'), '[ ]+', ' ', 'g')"


@registry.add(
    f"""WITH c AS (SELECT p_partkey k, column_name, substring(value, 1, 64) s FROM (SELECT p_partkey, p_name, p_brand, p_type FROM part) UNPIVOT (value FOR column_name IN (p_name, p_brand, p_type))),
g AS (SELECT column_name, {_SIGNATURE_SQL} signature, count(*) n, min(k) first_seen FROM c GROUP BY ALL)
SELECT column_name, signature, n, first_seen, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, first_seen) AS INT) rank FROM g QUALIFY rank <= 3"""
)
def f_pattern_signature(spark: SparkSession, d: str) -> DataFrame:
    cells = profiling.unpivot(table(spark, d, "part"), ["p_name", "p_brand", "p_type"], ["p_partkey"])
    return profiling.top_signatures(cells, "p_partkey").select("column_name", "signature", "n", "first_seen", "rank")


@registry.add(
    """WITH g AS (SELECT 'event_type' column_name, event_type AS value, min(event_id) first_seen FROM events GROUP BY 2)
SELECT *, CAST(row_number() OVER (ORDER BY first_seen) AS INT) rank FROM g QUALIFY rank <= 5"""
)
def a_first_seen_sample(spark: SparkSession, d: str) -> DataFrame:
    cells = profiling.unpivot(table(spark, d, "events"), ["event_type"], ["event_id"])
    return profiling.first_seen_sample(cells, "event_id").select("column_name", "value", "first_seen", "rank")


def _numbers(df: DataFrame, key: str, c: str) -> DataFrame:
    return df.select(key, F.col(c).alias("number")).filter("number IS NOT NULL").groupBy(key, "number").agg(F.count(F.lit(1)).alias("n"))


_EDGES_SQL = """ranked AS (SELECT l_returnflag, l_extendedprice v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 k, count(*) OVER (PARTITION BY l_returnflag) total FROM lineitem),
edges AS (SELECT DISTINCT l_returnflag, v edge FROM ranked, range(1, 10) b(i) WHERE k = least(total - 1, CAST(round_even(total * i / 10.0, 0) AS BIGINT)))"""


@registry.add(f"WITH {_EDGES_SQL} SELECT l_returnflag, edge FROM edges")
def a_quantile_edges(spark: SparkSession, d: str) -> DataFrame:
    numbers = _numbers(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
    return quality.quantile_edges(numbers, ["l_returnflag"]).select("l_returnflag", F.explode("edges").alias("edge"))


@registry.add(f"WITH {_EDGES_SQL}, b AS (SELECT r.l_returnflag, (SELECT count(*) FROM edges e WHERE e.l_returnflag = r.l_returnflag AND r.v > e.edge) bin FROM ranked r) SELECT l_returnflag, CAST(bin AS INT) bin, count(*) n FROM b GROUP BY ALL")
def a_histogram(spark: SparkSession, d: str) -> DataFrame:
    numbers = _numbers(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
    return profiling.histogram(numbers, quality.quantile_edges(numbers, ["l_returnflag"]), ["l_returnflag"])


@registry.add("SELECT 'o_orderpriority' column_name, o_orderpriority AS value, count(*) n, count(*) / sum(count(*)) OVER () share FROM orders GROUP BY 2")
def a_category_distribution(spark: SparkSession, d: str) -> DataFrame:
    return profiling.category_shares(profiling.unpivot(table(spark, d, "orders"), ["o_orderpriority"])).select("column_name", "value", "n", "share")


# --- drift ------------------------------------------------------------------------------------------------------------


@registry.add(
    """WITH b AS (SELECT event_type bin, count(*) FILTER (ts < TIMESTAMP '2024-01-16') e, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') a FROM events GROUP BY 1),
t AS (SELECT *, sum(e) OVER () se, sum(a) OVER () sa FROM b)
SELECT 'event_type' column_name, sum((greatest(a / sa, 0.0001) - greatest(e / se, 0.0001)) * ln(greatest(a / sa, 0.0001) / greatest(e / se, 0.0001))) psi, CAST(max(se) AS BIGINT) n_expected, CAST(max(sa) AS BIGINT) n_actual FROM t"""
)
def d_psi_categorical(spark: SparkSession, d: str) -> DataFrame:
    old = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    pairs = table(spark, d, "events").groupBy(F.lit("event_type").alias("column_name"), F.col("event_type").alias("bin")).agg(F.count_if(old).alias("expected"), F.count_if(~old).alias("actual"))
    return quality.psi(pairs, ["column_name"])


@registry.add(
    """WITH old AS (SELECT l_linestatus, l_quantity v, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_quantity) - 1 k, count(*) OVER (PARTITION BY l_linestatus) total FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01'),
edges AS (SELECT DISTINCT l_linestatus, v edge FROM old, range(1, 10) b(i) WHERE k = least(total - 1, CAST(round_even(total * i / 10.0, 0) AS BIGINT))),
b AS (SELECT l_linestatus, (SELECT count(*) FROM edges e WHERE e.l_linestatus = l.l_linestatus AND l.l_quantity > e.edge) bin, l_shipdate < TIMESTAMP '1998-06-01' is_old FROM lineitem l),
c AS (SELECT l_linestatus, bin, count(*) FILTER (is_old) e, count(*) FILTER (NOT is_old) a FROM b GROUP BY ALL),
t AS (SELECT *, sum(e) OVER g se, sum(a) OVER g sa FROM c WINDOW g AS (PARTITION BY l_linestatus))
SELECT l_linestatus, sum((greatest(a / sa, 0.0001) - greatest(e / se, 0.0001)) * ln(greatest(a / sa, 0.0001) / greatest(e / se, 0.0001))) psi, CAST(max(se) AS BIGINT) n_expected, CAST(max(sa) AS BIGINT) n_actual FROM t GROUP BY 1"""
)
def d_psi_numeric(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_linestatus", "l_shipdate", "l_quantity")  # noqa: E741
    is_old = F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp_ntz")
    old, new = _numbers(l.filter(is_old), "l_linestatus", "l_quantity"), _numbers(l.filter(~is_old), "l_linestatus", "l_quantity")
    edges = quality.quantile_edges(old, ["l_linestatus"])
    binned = lambda n: profiling.histogram(n, edges, ["l_linestatus"])
    zero = F.lit(0).cast("long")
    pairs = binned(old).select("l_linestatus", F.col("bin").cast("string").alias("bin"), F.col("n").alias("expected"), zero.alias("actual"))
    pairs = pairs.unionByName(binned(new).select("l_linestatus", F.col("bin").cast("string").alias("bin"), zero.alias("expected"), F.col("n").alias("actual")))
    return quality.psi(pairs, ["l_linestatus"])


_PAIRS_SQL = f"""{_VERSIONS_SQL}, cp AS (SELECT * FROM column_profile QUALIFY row_number() OVER (PARTITION BY source_object_id, col_name ORDER BY profile_id) = 1)"""


def _profiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "column_profile").groupBy("source_object_id", "col_name").agg(F.min(F.struct("profile_id", "inferred_type", "date_format", "null_rate")).alias("r")).select("source_object_id", "col_name", "r.inferred_type", "r.date_format", "r.null_rate")
    return p, with_previous(distinct_deliveries(table(spark, d, "source_object"))).select("source_object_id", "prev_object_id")


@registry.add(
    f"""WITH {_PAIRS_SQL} SELECT c.source_object_id, c.col_name, abs(c.null_rate - o.null_rate) shift FROM cp c JOIN versions v USING (source_object_id) JOIN cp o ON o.source_object_id = v.prev AND o.col_name = c.col_name WHERE abs(c.null_rate - o.null_rate) > 0.2"""
)
def d_null_rate_shift(spark: SparkSession, d: str) -> DataFrame:
    p, link = _profiles(spark, d)
    old = p.select(F.col("source_object_id").alias("prev_object_id"), "col_name", F.col("null_rate").alias("old"))
    return p.join(link, "source_object_id").join(old, ["prev_object_id", "col_name"]).select("source_object_id", "col_name", F.abs(F.col("null_rate") - F.col("old")).alias("shift")).filter("shift > 0.2")


@registry.add(
    f"""WITH {_PAIRS_SQL} SELECT c.source_object_id, c.col_name, CASE WHEN c.inferred_type <> o.inferred_type AND c.inferred_type <> 'empty' AND o.inferred_type <> 'empty' THEN 'type_changed' WHEN c.inferred_type = o.inferred_type AND c.date_format <> o.date_format THEN 'format_changed' END kind
FROM cp c JOIN versions v USING (source_object_id) JOIN cp o ON o.source_object_id = v.prev AND o.col_name = c.col_name WHERE kind IS NOT NULL"""
)
def d_type_changed(spark: SparkSession, d: str) -> DataFrame:
    p, link = _profiles(spark, d)
    old = p.select(F.col("source_object_id").alias("prev_object_id"), "col_name", F.col("inferred_type").alias("ot"), F.col("date_format").alias("of"))
    t = F.col("inferred_type")
    kind = F.when((t != F.col("ot")) & (t != "empty") & (F.col("ot") != "empty"), "type_changed").when((t == F.col("ot")) & (F.col("date_format") != F.col("of")), "format_changed")
    return p.join(link, "source_object_id").join(old, ["prev_object_id", "col_name"]).select("source_object_id", "col_name", kind.alias("kind")).filter("kind IS NOT NULL")


@registry.add(
    f"""WITH {_PAIRS_SQL}, pairs AS (SELECT source_object_id, prev FROM versions WHERE prev IN (SELECT source_object_id FROM cp) AND source_object_id IN (SELECT source_object_id FROM cp))
SELECT p.source_object_id, c.col_name, 'added' kind FROM pairs p JOIN cp c USING (source_object_id) WHERE NOT EXISTS (SELECT 1 FROM cp o WHERE o.source_object_id = p.prev AND o.col_name = c.col_name)
UNION ALL SELECT p.source_object_id, o.col_name, 'removed' FROM pairs p JOIN cp o ON o.source_object_id = p.prev WHERE NOT EXISTS (SELECT 1 FROM cp c WHERE c.source_object_id = p.source_object_id AND o.col_name = c.col_name)"""
)
def d_added_removed_columns(spark: SparkSession, d: str) -> DataFrame:
    p, link = _profiles(spark, d)
    have = p.select("source_object_id").distinct()
    link = link.join(have, "source_object_id", "left_semi").join(have.withColumnRenamed("source_object_id", "prev_object_id"), "prev_object_id", "left_semi")
    now = link.join(p, "source_object_id").select("source_object_id", "col_name")
    before = link.join(p.withColumnRenamed("source_object_id", "prev_object_id"), "prev_object_id").select("source_object_id", "col_name")
    return now.join(before, ["source_object_id", "col_name"], "left_anti").withColumn("kind", F.lit("added")).unionByName(before.join(now, ["source_object_id", "col_name"], "left_anti").withColumn("kind", F.lit("removed")))


# --- resolvers --------------------------------------------------------------------------------------------------------

_KEY_SQL = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


@registry.add(
    f"""WITH labels AS (SELECT schema_name, field_name, {_KEY_SQL.format("field_name")} k, 1 tier FROM field_spec UNION SELECT schema_name, field_name, {_KEY_SQL.format("unnest(aliases)")}, 2 FROM field_spec),
best AS (SELECT schema_name, k, min(struct_pack(t := tier, f := field_name)) b FROM labels GROUP BY 1, 2),
m AS (SELECT proposal_id, schema_name, {_KEY_SQL.format("source_column")} k FROM mapping_proposal JOIN source_feed USING (feed_id) WHERE source_column IS NOT NULL)
SELECT proposal_id, b.f target_field, CASE b.t WHEN 1 THEN 'exact' ELSE 'dictionary' END tier, CASE b.t WHEN 1 THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END confidence FROM m JOIN best USING (schema_name, k)"""
)
def r_exact_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return resolving.exact_and_dictionary(_headers(spark, d), table(spark, d, "field_spec")).select("proposal_id", "target_field", "tier", "confidence")


def _headers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mapping_proposal").join(table(spark, d, "source_feed").select("feed_id", "schema_name"), "feed_id").filter("source_column IS NOT NULL")


_WORDS_SQL = "list_sort(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')))"


@registry.add(
    f"""WITH labels AS (SELECT schema_name, field_name, {_WORDS_SQL.format("l")} w FROM (SELECT schema_name, field_name, field_name l FROM field_spec UNION ALL SELECT schema_name, field_name, unnest(aliases) FROM field_spec)),
h AS (SELECT DISTINCT schema_name, lower(source_column) header, {_WORDS_SQL.format("source_column")} w FROM mapping_proposal JOIN source_feed USING (feed_id) WHERE source_column IS NOT NULL),
s AS (SELECT schema_name, header, field_name, max(len(list_intersect(h.w, l.w)) / len(list_distinct(list_concat(h.w, l.w)))) score FROM h JOIN labels l USING (schema_name) WHERE len(h.w) > 0 AND len(list_intersect(h.w, l.w)) > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY schema_name, header ORDER BY score DESC, field_name) rn, count(*) OVER (PARTITION BY schema_name, header, score) ties FROM s)
SELECT schema_name, header, field_name target_field, score FROM r WHERE rn = 1 AND ties = 1 AND score >= 0.75"""
)
def r_synonym_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return resolving.best_token_sets(_headers(spark, d), table(spark, d, "field_spec"))


_GRAMS_SQL = "list_distinct([substring('  ' || {0} || ' ', i, 3) FOR i IN range(1, CAST(length({0}) + 2 AS BIGINT))])"


@registry.add(
    f"""WITH f AS (SELECT schema_name, field_name, replace(field_name, '_', ' ') l FROM field_spec),
h AS (SELECT DISTINCT schema_name, lower(source_column) header, array_to_string(regexp_extract_all(lower(source_column), '[a-z0-9]+'), ' ') t FROM mapping_proposal JOIN source_feed USING (feed_id) WHERE source_column IS NOT NULL),
g AS (SELECT schema_name, header, field_name, {_GRAMS_SQL.format("t")} a, {_GRAMS_SQL.format("l")} b, list_distinct(string_split(t, ' ')) x, list_distinct(string_split(l, ' ')) y FROM h JOIN f USING (schema_name) WHERE t <> ''),
s AS (SELECT schema_name, header, field_name, 0.6 * (len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))) + 0.4 * (len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))) score FROM g)
SELECT schema_name, header, field_name, CAST(score AS DOUBLE) score FROM s WHERE score >= 0.35"""
)
def r_heuristic_scores(spark: SparkSession, d: str) -> DataFrame:
    return resolving.name_scores(_headers(spark, d), table(spark, d, "field_spec"))


@registry.add()
def r_label_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every header with every field by the best of the field's labels, its name and aliases."""
    return resolving.label_scores(_headers(spark, d), table(spark, d, "field_spec"))


@registry.add()
def r_greedy_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Each feed's headers assigned one to one by descending `r_label_scores`, where 0.35 or more."""
    h = _headers(spark, d)
    scores = resolving.label_scores(h, table(spark, d, "field_spec")).filter(F.col("score") >= resolving.NAME_THRESHOLD)
    pairs = h.select("feed_id", "schema_name", "source_column").distinct().join(scores, ["schema_name", "source_column"])
    return resolving.greedy_assignment(pairs, ["feed_id"], "source_column", "field_name", "score")


@registry.add(
    f"""WITH {_CELLS_SQL}, r AS (SELECT source_object_id, column_name, count(v) n, count(*) FILTER (CASE column_name WHEN 'currency' THEN lower(v) IN ('usd', 'eur', 'gbp', 'cad') ELSE regexp_full_match(v, 'PO-[0-9]+') END) ok
  FROM cells WHERE column_name IN ('currency', 'po_number') GROUP BY ALL)
SELECT source_object_id, column_name, ok / n rate, CASE WHEN ok / n >= 0.9 THEN 'ok' WHEN ok / n >= 0.5 THEN 'downgrade' ELSE 'veto' END status FROM r WHERE n > 0"""
)
def r_compat_rates(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d, ["currency", "po_number"]).withColumn("value", V.present(F.col("value"))).filter("value IS NOT NULL")
    fits = F.when(F.col("column_name") == "currency", F.lower("value").isin([c.lower() for c in quality.CURRENCIES])).otherwise(F.col("value").rlike(quality.PO_PATTERN))
    r = cells.groupBy("source_object_id", "column_name").agg((F.count_if(fits) / F.count(F.lit(1))).alias("rate"))
    return r.withColumn("status", resolving.compat_status(F.col("rate")))


_TIER_SQL = "CASE tier WHEN 'human' THEN 0 WHEN 'exact' THEN 1 WHEN 'dictionary' THEN 2 WHEN 'synonym' THEN 3 ELSE 4 END"


@registry.add(
    f"""SELECT spec_id, target_field, source_column winner, proposal_id FROM mapping_proposal WHERE target_field IS NOT NULL AND status = 'accepted'
QUALIFY row_number() OVER (PARTITION BY spec_id, target_field ORDER BY confidence DESC, {_TIER_SQL}, source_column, proposal_id) = 1"""
)
def r_collision_winner(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "mapping_proposal").filter("target_field IS NOT NULL AND status = 'accepted'")
    return resolving.collision_winners(p, ["spec_id", "target_field"]).select("spec_id", "target_field", F.col("source_column").alias("winner"), "proposal_id")


@registry.add(
    f"""WITH labels AS (SELECT schema_name, field_name, {_KEY_SQL.format("field_name")} k, 1 tier FROM field_spec UNION SELECT schema_name, field_name, {_KEY_SQL.format("unnest(aliases)")}, 2 FROM field_spec),
best AS (SELECT schema_name, k, min(struct_pack(t := tier, f := field_name)) b FROM labels GROUP BY 1, 2),
m AS (SELECT m.*, b.b.f predicted FROM mapping_proposal m JOIN source_feed f USING (feed_id) LEFT JOIN best b ON b.schema_name = f.schema_name AND b.k = {_KEY_SQL.format("m.source_column")} WHERE m.source_column IS NOT NULL AND m.status IN ('accepted', 'demoted'))
SELECT tier, count(*) n, count(predicted) mapped, count(*) FILTER (predicted = target_field) correct, count(*) FILTER (status = 'demoted') decoys, count(*) FILTER (status = 'demoted' AND predicted IS NOT NULL) decoy_hits FROM m GROUP BY 1"""
)
def a_benchmark_metrics(spark: SparkSession, d: str) -> DataFrame:
    h = _headers(spark, d).filter("status IN ('accepted', 'demoted')")
    found = resolving.exact_and_dictionary(h, table(spark, d, "field_spec")).select("proposal_id", F.col("target_field").alias("predicted"))
    return resolving.benchmark(h.join(found, "proposal_id", "left"), "tier")


def _resolver_columns(spark: SparkSession, d: str) -> DataFrame:
    """The profiled columns of every object with the schema of its feed."""
    schema = table(spark, d, "source_object").select("source_object_id", "feed_id").dropDuplicates(["source_object_id"]).join(table(spark, d, "source_feed").select("feed_id", "schema_name"), "feed_id")
    return table(spark, d, "column_profile").join(schema, "source_object_id")


@registry.add()
def r_chain(spark: SparkSession, d: str) -> DataFrame:
    """Every profiled column through the resolver chain: target field, tier, confidence, conflicts, vetoes and ``ext_`` names."""
    return chain.resolve(_resolver_columns(spark, d), table(spark, d, "field_spec")).withColumn("vetoes", F.array_join("vetoes", ","))


@registry.add()
def r_chain_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The chain measured against the decided mappings of the same headers in the same schema, by tier."""
    columns = _resolver_columns(spark, d)
    schema = table(spark, d, "source_feed").select("feed_id", "schema_name")
    decided = table(spark, d, "mapping_proposal").filter("status IN ('accepted', 'demoted') AND source_column IS NOT NULL").join(schema, "feed_id")
    decided = decided.groupBy("schema_name", F.col("source_column").alias("col_name")).agg(F.max("target_field").alias("true_field"))
    truth = columns.select("source_object_id", "schema_name", "col_name").distinct().join(decided, ["schema_name", "col_name"]).select("source_object_id", "col_name", "true_field")
    return chain.metrics(chain.resolve(columns, table(spark, d, "field_spec")), truth)


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    """feed_id, schema_name, source_column, target_field of the accepted mappings."""
    p = table(spark, d, "mapping_proposal").filter("status = 'accepted' AND target_field IS NOT NULL AND source_column IS NOT NULL")
    return p.join(table(spark, d, "source_feed").select("feed_id", "schema_name"), "feed_id").select("feed_id", "schema_name", "source_column", "target_field").distinct()


def _drift_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    objects, fields = table(spark, d, "source_object"), table(spark, d, "field_spec")
    before = cut(with_previous(distinct_deliveries(objects)).select("source_object_id", "feed_id", "prev_object_id"))
    profiles = cut(drift_events.profiles_of(objects))
    schema = table(spark, d, "source_feed").select("feed_id", "schema_name")
    headers = profiles.select("source_object_id", "col_name").join(before, "source_object_id").join(schema, "feed_id").select("source_object_id", "schema_name", "col_name")
    labels = cut(chain.normalized_labels(fields))
    names = cut(chain.normalized_headers(headers))
    sure = chain.named_fields(names, labels).unionByName(chain.synonym_fields(names, labels)).groupBy("schema_name", "col_name").agg(F.min_by("field_name", resolving.tier_rank(F.col("tier"))).alias("target_field"))
    resolved = headers.join(sure, ["schema_name", "col_name"]).select("source_object_id", "col_name", "target_field")
    return drift_events.drift_events(profiles, before, _mapping(spark, d), fields, resolved), before, profiles.select("source_object_id", "col_name")


@registry.add()
def d_events(spark: SparkSession, d: str) -> DataFrame:
    """All drift events of every object against the one before, with severity, detail and order."""
    return _drift_events(spark, d)[0]


@registry.add()
def d_carried_mapping(spark: SparkSession, d: str) -> DataFrame:
    """The accepted mappings as far as they hold for each later object: carried over, or led to renamed columns."""
    events, before, columns = _drift_events(spark, d)
    return drift_events.carried_mapping(cut(events), before, _mapping(spark, d), columns)


_SEVERE_SQL = f"""WITH {_VERSIONS_SQL}, prof AS (SELECT source_object_id, feed_id, unnest(from_json(profile_json, '[{{"name":"VARCHAR","inferred_type":"VARCHAR","date_format":"VARCHAR","null_rate":"DOUBLE"}}]')) p FROM source_object),
f AS (SELECT source_object_id, feed_id, p.name col, p.inferred_type t, p.date_format df, p.null_rate nr FROM prof),
m AS (SELECT DISTINCT feed_id, source_column col FROM mapping_proposal WHERE status = 'accepted' AND target_field IS NOT NULL AND source_column IS NOT NULL),
j AS (SELECT c.source_object_id, c.feed_id, c.col, c.t, o.t ot, c.df, o.df odf, c.nr, o.nr onr FROM f c JOIN versions v USING (source_object_id) JOIN f o ON o.source_object_id = v.prev AND o.col = c.col)
SELECT source_object_id, 'format_changed' kind, CASE WHEN m.col IS NULL THEN 'warning' ELSE 'breaking' END severity, j.col source_column, odf || ' to ' || df detail FROM j LEFT JOIN m ON m.feed_id = j.feed_id AND m.col = j.col WHERE t = ot AND df <> odf
UNION ALL SELECT source_object_id, 'null_rate_shift', 'warning', col, format('{{:.4f}} to {{:.4f}}', onr, nr) FROM j WHERE abs(nr - onr) > 0.2"""


@registry.add(_SEVERE_SQL)
def d_format_and_null_events(spark: SparkSession, d: str) -> DataFrame:
    """Those events that follow from one column alone, with their severities."""
    return d_events(spark, d).filter("kind IN ('format_changed', 'null_rate_shift')").drop("rank")


# --- logs -------------------------------------------------------------------------------------------------------------


@registry.add("SELECT spec_id, count(DISTINCT lower(trim(decided_by))) FILTER (lower(trim(decided_by)) <> lower(trim(proposer))) actors FROM mapping_proposal GROUP BY 1")
def g_valid_approvers(spark: SparkSession, d: str) -> DataFrame:
    return audit.distinct_actors(table(spark, d, "mapping_proposal"), "spec_id", "decided_by", "proposer")


_LOG = ["event_id", "source_object_id", "kind", "source_column", "severity", "status"]
_PART = lambda c: f"COALESCE(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
_CHAIN_SQL = f"""p AS (SELECT event_id, feed_id, severity, status, kind, sha256(concat_ws('|', {", ".join(map(_PART, _LOG))})) payload FROM drift_event),
l AS (SELECT *, list(payload) OVER (PARTITION BY feed_id ORDER BY event_id) ps FROM p),
h AS (SELECT * EXCLUDE (ps), list_reduce(list_prepend(repeat('0', 64), ps), lambda a, b: sha256(a || b)) hash FROM l),
c AS (SELECT *, COALESCE(lag(hash) OVER (PARTITION BY feed_id ORDER BY event_id), repeat('0', 64)) previous FROM h)"""


@registry.add(f"WITH {_CHAIN_SQL} SELECT event_id, feed_id, previous, hash FROM c")
def g_audit_chain(spark: SparkSession, d: str) -> DataFrame:
    return audit.chain(table(spark, d, "drift_event"), "event_id", _LOG, "feed_id").select("event_id", "feed_id", "previous", "hash")


@registry.add(
    f"""WITH {_CHAIN_SQL}, f AS (SELECT *, CASE WHEN kind = 'added' THEN repeat('0', 64) ELSE hash END stored FROM c WHERE kind IS DISTINCT FROM 'removed'),
b AS (SELECT *, COALESCE(lag(stored) OVER (PARTITION BY feed_id ORDER BY event_id), repeat('0', 64)) before FROM f),
r AS (SELECT event_id, feed_id, CASE WHEN severity = 'warning' AND status = 'open' THEN 'payload' WHEN before <> previous THEN 'previous' WHEN stored <> hash THEN 'hash' END reason FROM b)
SELECT * FROM r WHERE reason IS NOT NULL"""
)
def g_audit_chain_verify(spark: SparkSession, d: str) -> DataFrame:
    """A log tampered with after it was chained: entries changed, hashes replaced, entries taken out."""
    chained = audit.chain(table(spark, d, "drift_event"), "event_id", _LOG, "feed_id")
    forged = chained.withColumn("status", F.when((F.col("severity") == "warning") & (F.col("status") == "open"), "closed").otherwise(F.col("status")))
    forged = forged.withColumn("hash", F.when(F.col("kind") == "added", F.lit(audit.GENESIS)).otherwise(F.col("hash"))).filter("kind IS DISTINCT FROM 'removed'")
    return audit.broken_entries(forged, "event_id", _LOG, "feed_id")


@registry.add(f"WITH {_CHAIN_SQL} SELECT feed_id, arg_max(hash, event_id) head, count(*) entries FROM c GROUP BY 1")
def g_audit_chain_heads(spark: SparkSession, d: str) -> DataFrame:
    """Last hash and number of entries of each feed's log."""
    return audit.chain_heads(audit.chain(table(spark, d, "drift_event"), "event_id", _LOG, "feed_id"), "event_id", "feed_id")


@registry.add(
    f"""WITH {_CHAIN_SQL}, n AS (SELECT feed_id, count(*) entries, count(*) FILTER (status IS DISTINCT FROM 'open') left_over, bool_or(severity = 'breaking' AND status IS DISTINCT FROM 'open') rehashed FROM c GROUP BY 1)
SELECT feed_id, CASE WHEN left_over < entries THEN 'shorter' WHEN rehashed THEN 'other' END reason FROM n WHERE left_over < entries OR rehashed"""
)
def g_moved_heads(spark: SparkSession, d: str) -> DataFrame:
    """Logs without their open entries, the breaking ones made warnings, chained anew so that every link holds: their heads are not those that were anchored."""
    log = table(spark, d, "drift_event")
    anchors = audit.chain_heads(audit.chain(log, "event_id", _LOG, "feed_id"), "event_id", "feed_id")
    forged = log.filter("status IS DISTINCT FROM 'open'").withColumn("severity", F.when(F.col("severity") == "breaking", "warning").otherwise(F.col("severity")))
    return audit.moved_heads(audit.chain_heads(audit.chain(forged, "event_id", _LOG, "feed_id"), "event_id", "feed_id"), anchors, "feed_id")


# --- small functions and lookups --------------------------------------------------------------------------------------


@registry.add(f"WITH {_CELLS_SQL} SELECT column_name, CASE WHEN v IS NULL THEN 'empty' WHEN {_IS_FLOAT} OR {_IS_MONEY} OR {_IS_PERCENT} THEN 'number' WHEN {_IS_DATE} THEN 'date' ELSE 'string' END cell_type, count(*) n FROM cells GROUP BY ALL")
def f_cell_type(spark: SparkSession, d: str) -> DataFrame:
    """Cells of every column by their kind."""
    return profiling.cell_types(_cells(spark, d))


@registry.add("SELECT event_id, substring(CAST(ts AS VARCHAR), 1, 10) AS day FROM events")
def f_strip_time(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", V.strip_time(F.col("ts").cast("string")).alias("day"))


@registry.add("SELECT feed_id, 'raw_' || trim(regexp_replace(lower(feed_name), '[^a-z0-9]+', '_', 'g'), '_') || '_' || feed_id raw_table FROM source_feed")
def f_raw_table_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_feed").select("feed_id", loading.raw_table_column(F.col("feed_name"), F.col("feed_id")).alias("raw_table"))


@registry.add(r"SELECT proposal_id, nullif(lower(trim(regexp_replace(decided_by, '\s+', ' ', 'g'))), '') actor FROM mapping_proposal")
def f_actor_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mapping_proposal").select("proposal_id", audit.actor_key(F.col("decided_by")).alias("actor"))


@registry.add("SELECT tier, count(*) n FROM mapping_proposal GROUP BY 1")
def a_tier_tally(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mapping_proposal").groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@registry.add(f"WITH {_VERSIONS_SQL} SELECT source_object_id, prev prev_object_id FROM versions WHERE prev IS NOT NULL")
def w_previous_object(spark: SparkSession, d: str) -> DataFrame:
    """The object of the same feed just before each, re-sends left out."""
    return with_previous(distinct_deliveries(table(spark, d, "source_object"))).select("source_object_id", "prev_object_id").filter("prev_object_id IS NOT NULL")


_LATEST_SQL = "latest AS (SELECT feed_id, arg_max(source_object_id, (ingested_at, source_object_id)) source_object_id FROM source_object GROUP BY 1)"


@registry.add(f"WITH {_LATEST_SQL} SELECT * FROM latest")
def w_latest_object(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d)


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_object").groupBy("feed_id").agg(F.max_by("source_object_id", F.struct("ingested_at", "source_object_id")).alias("source_object_id"))


@registry.add(
    f"""WITH {_LATEST_SQL}, have AS (SELECT feed_id, unnest(from_json(columns_json, '["VARCHAR"]')) col FROM source_object JOIN latest USING (feed_id, source_object_id)),
m AS (SELECT DISTINCT feed_id, source_column, target_field FROM mapping_proposal JOIN source_feed USING (feed_id) WHERE status = 'accepted' AND target_field IS NOT NULL AND source_column IS NOT NULL)
SELECT m.feed_id, source_column, target_field FROM m WHERE NOT EXISTS (SELECT 1 FROM have WHERE have.feed_id = m.feed_id AND col = source_column)"""
)
def u_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    """Mapped columns that the latest object of their feed does not have: a load by that mapping must not run."""
    latest = _latest(spark, d).join(table(spark, d, "source_object").select("source_object_id", "columns_json"), "source_object_id")
    have = latest.select("feed_id", F.explode(F.from_json("columns_json", "array<string>")).alias("source_column"))
    return _mapping(spark, d).select("feed_id", "source_column", "target_field").distinct().join(have, ["feed_id", "source_column"], "left_anti")


@registry.add("SELECT feed_id FROM source_feed f WHERE EXISTS (SELECT 1 FROM source_feed g JOIN mapping_proposal m USING (feed_id) WHERE g.schema_name = f.schema_name AND g.feed_id <> f.feed_id AND m.status = 'accepted')")
def j_shared_schema(spark: SparkSession, d: str) -> DataFrame:
    """Feeds whose schema another feed with an accepted mapping loads too."""
    feeds = table(spark, d, "source_feed").select("feed_id", "schema_name")
    users = feeds.join(table(spark, d, "mapping_proposal").filter("status = 'accepted'").select("feed_id"), "feed_id", "left_semi").groupBy("schema_name").agg(F.min("feed_id").alias("first"), F.max("feed_id").alias("last"))
    # Another feed is there if the least or the greatest one is another: no pairs of feeds are needed.
    return feeds.join(users, "schema_name").filter("feed_id <> first OR feed_id <> last").select("feed_id")


@registry.add(
    """WITH o AS (SELECT feed_id, count(*) objects, count(raw_table) staged, max(ingested_at) last_seen FROM source_object GROUP BY 1), e AS (SELECT feed_id, count(*) FILTER (status = 'open') open_events, count(*) FILTER (status = 'open' AND severity = 'breaking') open_breaking FROM drift_event GROUP BY 1)
SELECT f.feed_id, COALESCE(objects, 0) objects, COALESCE(staged, 0) staged, CAST(last_seen AS VARCHAR) last_seen, COALESCE(open_events, 0) open_events, COALESCE(open_breaking, 0) open_breaking FROM source_feed f LEFT JOIN o USING (feed_id) LEFT JOIN e USING (feed_id)"""
)
def g_feed_status(spark: SparkSession, d: str) -> DataFrame:
    """Objects, staged ones and open drift of every feed."""
    o = table(spark, d, "source_object").groupBy("feed_id").agg(F.count(F.lit(1)).alias("objects"), F.count("raw_table").alias("staged"), F.max("ingested_at").cast("string").alias("last_seen"))
    e = table(spark, d, "drift_event").groupBy("feed_id").agg(F.count_if(F.col("status") == "open").alias("open_events"), F.count_if((F.col("status") == "open") & (F.col("severity") == "breaking")).alias("open_breaking"))
    return table(spark, d, "source_feed").select("feed_id").join(o, "feed_id", "left").join(e, "feed_id", "left").fillna(0, ["objects", "staged", "open_events", "open_breaking"])


@registry.add("SELECT feed_id, event_id, CAST(row_number() OVER (PARTITION BY feed_id ORDER BY event_id DESC) AS INT) back FROM drift_event QUALIFY back <= 3")
def g_log_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last three entries of each feed's log; three is the report."""
    return audit.tail(table(spark, d, "drift_event"), "event_id", "feed_id", 3).select("feed_id", "event_id", "back")


@registry.add()
def s_header_score(spark: SparkSession, d: str) -> DataFrame:
    """The header row found in the raw records of each object."""
    return profiling.detect_headers(profiling.header_scores(_raw_grid(spark, d)))


def _raw_grid(spark: SparkSession, d: str) -> DataFrame:
    lay = table(spark, d, "source_object").select("source_object_id", "delimiter")
    raw = table(spark, d, "raw_records").join(lay, "source_object_id")
    return raw.select("source_object_id", "row_idx", records.record_tokens("raw_text", F.coalesce("delimiter", F.lit(","))).alias("cells"))
