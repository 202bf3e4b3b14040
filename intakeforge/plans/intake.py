"""Queries of the general intake problems: records that fail, schema drift, column quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intakeforge.operators import quality, records, schema_drift
from intakeforge.plans.registry import Registry
from intakeforge.session import cut, table

registry = Registry()


_NULLS = "'', 'na', 'n/a', 'null', 'none', 'nan', '-', '--', '#n/a', 'nil'"
_UNSIGNED = r"([0-9]{1,3}(,[0-9]{3})+|[0-9]+)([.][0-9]+)?"
_MONEY = r"([$]|€|£|USD|EUR|GBP|CAD)"
_AMOUNT = rf"[+-]?({_MONEY} ?)?{_UNSIGNED}( ?{_MONEY})?"
_DATES = {
    "ymd-": ("[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "%Y-%m-%d"),
    "ymd/": ("[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}", "%Y/%m/%d"),
    "mdy/": ("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "%m/%d/%Y"),
    "dmy/": ("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "%d/%m/%Y"),
    "dmy.": ("[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}", "%d.%m.%Y"),
    "dmy-mon": ("[0-9]{1,2}-[A-Za-z]{3,}-[0-9]{4}", "%d-%b-%Y"),
}
_IS_DATE = {t: rf"(regexp_full_match(v, '{shape}') AND TRY_STRPTIME(regexp_replace(v, '-([A-Za-z]{{3}})[A-Za-z]*-', '-\1-'), '{fmt}') IS NOT NULL)" for t, (shape, fmt) in _DATES.items()}
_FITS_SQL = f"""CASE kind WHEN 'int' THEN regexp_full_match(v, '[+-]?([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+)') WHEN 'float' THEN regexp_full_match(v, '[+-]?{_UNSIGNED}')
  WHEN 'currency' THEN regexp_full_match(v, '{_AMOUNT}') OR regexp_full_match(v, '[(]{_AMOUNT}[)]') WHEN 'percent' THEN regexp_full_match(v, '[+-]?[0-9]+([.][0-9]+)? ?%') WHEN 'bool' THEN lower(v) IN ('true', 'false', 't', 'f', 'yes', 'no', 'y', 'n')
  WHEN 'date' THEN CASE {" ".join(f"WHEN fmt = '{t}' THEN {test}" for t, test in _IS_DATE.items())} ELSE {" OR ".join(_IS_DATE.values())} END ELSE true END"""


@registry.add(
    f"""WITH o AS (SELECT source_object_id, COALESCE(delimiter, ',') d, COALESCE(header_row, 0) h, len(from_json(columns_json, '["VARCHAR"]')) nc, from_json(profile_json, '[{{"position":"INTEGER","inferred_type":"VARCHAR","date_format":"VARCHAR"}}]') p FROM source_object),
r AS (SELECT raw_id, raw_text t, d, nc, p, '("([^"]|"")*"|[^"' || d || '][^' || d || ']*|)' c, '[' || d || ']' s FROM raw_records JOIN o USING (source_object_id) WHERE row_idx > h AND NOT regexp_full_match(raw_text, '\\s*')),
g AS (SELECT raw_id, nc, p, regexp_matches(t, '[\\x{{FFFD}}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]') undecoded, NOT regexp_matches(t, '^' || c || '(' || s || c || ')*$') broken, regexp_extract_all(d || t, s || c, 1) cells FROM r),
v AS (SELECT raw_id, i, x.inferred_type kind, x.date_format fmt, regexp_replace(CASE WHEN starts_with(cells[i], '"') THEN replace(substring(cells[i], 2, length(cells[i]) - 2), '""', '"') ELSE cells[i] END, '^\\s+|\\s+$', '', 'g') v
  FROM (SELECT raw_id, cells, unnest(range(1, nc + 1)) i, p FROM g WHERE NOT undecoded AND NOT broken AND len(cells) = nc), (SELECT unnest(p) x) WHERE x.position = i - 1),
bad AS (SELECT DISTINCT raw_id FROM v WHERE lower(v) NOT IN ({_NULLS}) AND NOT {_FITS_SQL})
SELECT raw_id, CASE WHEN undecoded THEN 'encoding' WHEN broken THEN 'quoting' WHEN len(cells) <> nc THEN 'column_count' ELSE 'bad_value' END reason FROM g WHERE undecoded OR broken OR len(cells) <> nc OR raw_id IN (SELECT raw_id FROM bad)"""
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return records.failed_records(table(spark, d, "raw_records"), table(spark, d, "source_object"))


@registry.add()
def p2_load(spark: SparkSession, d: str) -> DataFrame:
    """Valid records as typed rows and failed ones with reason and place, in one pass."""
    return records.typed_rows(records.read_records(table(spark, d, "raw_records"), table(spark, d, "source_object")), table(spark, d, "source_object"))


@registry.add()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.drift_changes(table(spark, d, "source_object"), table(spark, d, "source_feed"), table(spark, d, "field_spec"))


@registry.add()
def p4_unified_columns(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.unified_columns(table(spark, d, "source_object"), table(spark, d, "source_feed"), table(spark, d, "field_spec"))


@registry.add()
def p4_unified_rows(spark: SparkSession, d: str) -> DataFrame:
    objects = table(spark, d, "source_object")
    columns = schema_drift.unified_columns(objects, table(spark, d, "source_feed"), table(spark, d, "field_spec"))
    good = records.read_records(table(spark, d, "raw_records"), objects)
    return schema_drift.unified_rows(good, columns).select("raw_id", "source_object_id", F.to_json("cells").alias("cells"))


_NUMBER_SQL = rf"""CASE WHEN regexp_full_match(cell, '[(]{_AMOUNT}[)]') THEN -abs(TRY_CAST(regexp_replace(cell, '[^0-9.+-]', '', 'g') AS DOUBLE))
  WHEN regexp_full_match(cell, '{_AMOUNT}') OR regexp_full_match(cell, '[+-]?[0-9]+([.][0-9]+)? ?%') THEN TRY_CAST(regexp_replace(cell, '[^0-9.+-]', '', 'g') AS DOUBLE) END"""
_DATE_SQL = r"""COALESCE(
  CASE WHEN regexp_full_match(cell, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') THEN TRY_STRPTIME(cell, '%Y-%m-%d') END,
  CASE WHEN regexp_full_match(cell, '[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}') THEN TRY_STRPTIME(cell, '%Y/%m/%d') END,
  CASE WHEN regexp_full_match(cell, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') THEN COALESCE(TRY_STRPTIME(cell, '%m/%d/%Y'), TRY_STRPTIME(cell, '%d/%m/%Y')) END,
  CASE WHEN regexp_full_match(cell, '[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}') THEN TRY_STRPTIME(cell, '%d.%m.%Y') END,
  CASE WHEN regexp_full_match(cell, '[0-9]{1,2}-[A-Za-z]{3,}-[0-9]{4}') THEN TRY_STRPTIME(regexp_replace(cell, '-([A-Za-z]{3})[A-Za-z]*-', '-\1-'), '%d-%b-%Y') END)"""

_VERSIONS_SQL = """kept AS (
  SELECT feed_id, min(struct_pack(t := ingested_at, i := source_object_id)) r FROM source_object
  GROUP BY feed_id, COALESCE(content_hash, 'id ' || source_object_id), sheet_name),
versions AS (SELECT r.i source_object_id, lag(r.i) OVER (PARTITION BY feed_id ORDER BY r.t, r.i) prev FROM kept)"""

_P5_SQL = f"""WITH {_VERSIONS_SQL},
long AS (
  SELECT source_object_id, source_column, CASE WHEN lower(trim(cell)) NOT IN ({_NULLS}) THEN trim(cell) END cell
  FROM (SELECT source_object_id, {", ".join(quality.TEXT_COLUMNS)} FROM invoices_2026_08) UNPIVOT INCLUDE NULLS (cell FOR source_column IN ({", ".join(quality.TEXT_COLUMNS)}))),
typed AS (
  SELECT *, CASE WHEN source_column IN ('line_number', 'qty', 'unit_price', 'line_total') THEN {_NUMBER_SQL} END num,
    CASE WHEN source_column IN ('invoice_date', 'due_date') THEN {_DATE_SQL} END dt FROM long),
prof AS (
  SELECT source_object_id, source_column, count(*) n, count(cell) np, count(num) + count(dt) parsed, count(num) nn, count(DISTINCT cell) nd,
    count(*) FILTER (num < 0.01 OR num > 1000000) outside,
    count(*) FILTER (CASE source_column WHEN 'po_number' THEN NOT regexp_full_match(cell, 'PO-[0-9]+') WHEN 'currency' THEN cell NOT IN ('USD', 'EUR', 'GBP', 'CAD') END) bad
  FROM typed GROUP BY ALL),
pairs AS (SELECT p.*, o.n on_, o.np onp, o.parsed oparsed, o.nd ond, v.prev FROM prof p LEFT JOIN versions v USING (source_object_id) LEFT JOIN prof o ON o.source_object_id = v.prev AND o.source_column = p.source_column),
ranked AS (
  SELECT source_object_id, source_column, num, row_number() OVER w - 1 k, count(*) OVER (PARTITION BY source_object_id, source_column) total
  FROM typed WHERE source_column IN ('qty', 'unit_price') AND num IS NOT NULL WINDOW w AS (PARTITION BY source_object_id, source_column ORDER BY num)),
edges AS (SELECT DISTINCT source_object_id, source_column, num edge FROM ranked, range(1, 10) b(i) WHERE k = least(total - 1, round_even(total * i / 10.0, 0))),
sides AS (
  SELECT v.source_object_id, t.source_column, CAST((SELECT count(*) FROM edges e WHERE e.source_object_id = v.prev AND e.source_column = t.source_column AND t.num > e.edge) AS VARCHAR) bin, s.side
  FROM versions v, (VALUES (0), (1)) s(side), typed t
  WHERE t.source_object_id = CASE s.side WHEN 0 THEN v.prev ELSE v.source_object_id END AND t.source_column IN ('qty', 'unit_price') AND t.num IS NOT NULL AND v.prev IN (SELECT source_object_id FROM edges)
  UNION ALL
  SELECT v.source_object_id, t.source_column, t.cell, s.side FROM versions v, (VALUES (0), (1)) s(side), typed t
  WHERE t.source_object_id = CASE s.side WHEN 0 THEN v.prev ELSE v.source_object_id END AND t.source_column IN ('currency', 'tax_pct') AND t.cell IS NOT NULL),
bins AS (SELECT source_object_id, source_column, bin, count(*) FILTER (side = 0) e, count(*) FILTER (side = 1) a FROM sides GROUP BY ALL),
tot AS (SELECT *, sum(e) OVER g se, sum(a) OVER g sa FROM bins WINDOW g AS (PARTITION BY source_object_id, source_column)),
shift AS (SELECT source_object_id, source_column FROM tot WHERE se >= 50 AND sa >= 50 GROUP BY ALL
  HAVING sum((greatest(a / sa, 0.0001) - greatest(e / se, 0.0001)) * ln(greatest(a / sa, 0.0001) / greatest(e / se, 0.0001))) > 0.25),
cp AS (SELECT * FROM column_profile QUALIFY row_number() OVER (PARTITION BY source_object_id, col_name ORDER BY profile_id) = 1),
cpp AS (SELECT c.source_object_id, c.col_name, c.null_rate nr, o.null_rate onr, c.distinct_count dc, o.distinct_count odc, c.parse_rates pr, o.parse_rates opr, c.top_values tv, o.top_values otv
  FROM cp c JOIN versions v USING (source_object_id) JOIN cp o ON o.source_object_id = v.prev AND o.col_name = c.col_name),
tops AS (SELECT source_object_id, col_name, unnest(list_distinct(list_concat(map_keys(tv), map_keys(otv)))) k, tv, otv FROM cpp WHERE cardinality(tv) > 0 AND cardinality(otv) > 0),
tshare AS (SELECT source_object_id, col_name, greatest(COALESCE(element_at(tv, k)[1], 0), 0.0001) a, greatest(COALESCE(element_at(otv, k)[1], 0), 0.0001) e FROM tops),
rates AS (SELECT source_object_id, col_name, opr, pr, unnest(map_keys(opr)) k FROM cpp)
SELECT source_object_id, source_column, 'null_rate_shift' issue FROM pairs WHERE abs((1 - np / n) - (1 - onp / on_)) > 0.2
UNION ALL SELECT source_object_id, source_column, 'parse_rate_drop' FROM pairs WHERE source_column IN ('line_number', 'qty', 'unit_price', 'line_total', 'invoice_date', 'due_date') AND np > 0 AND onp > 0 AND oparsed / onp - parsed / np > 0.2
UNION ALL SELECT source_object_id, source_column, 'distinct_collapse' FROM pairs WHERE source_column IN ('sku', 'description', 'po_number') AND ond >= 10 AND nd < 0.2 * ond
UNION ALL SELECT source_object_id, source_column, 'distribution_shift' FROM shift
UNION ALL SELECT source_object_id, source_column, 'pattern_violation' FROM pairs WHERE source_column IN ('po_number', 'currency') AND np > 0 AND bad / np > 0.05
UNION ALL SELECT source_object_id, source_column, 'range_violation' FROM pairs WHERE source_column IN ('qty', 'unit_price', 'line_total') AND nn > 0 AND outside / nn > 0.05
UNION ALL SELECT source_object_id, col_name, 'null_rate_shift' FROM cpp WHERE abs(nr - onr) > 0.2
UNION ALL SELECT source_object_id, col_name, 'distinct_collapse' FROM cpp WHERE odc >= 10 AND dc < 0.2 * odc
UNION ALL SELECT DISTINCT source_object_id, col_name, 'parse_rate_drop' FROM rates WHERE element_at(opr, k)[1] - element_at(pr, k)[1] > 0.2
UNION ALL SELECT source_object_id, col_name, 'distribution_shift' FROM tshare GROUP BY ALL HAVING sum((a - e) * ln(a / e)) > 0.25"""


@registry.add(_P5_SQL)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_issues(table(spark, d, "invoices_2026_08"), table(spark, d, "column_profile"), table(spark, d, "source_object"))


_LONG_SQL = f"""long AS (
  SELECT source_object_id, source_column, CASE WHEN lower(trim(cell)) NOT IN ({_NULLS}) THEN trim(cell) END cell
  FROM (SELECT source_object_id, {", ".join(quality.TEXT_COLUMNS)} FROM invoices_2026_08) UNPIVOT INCLUDE NULLS (cell FOR source_column IN ({", ".join(quality.TEXT_COLUMNS)})))"""
_MASK_SQL = "cell"
for _class, _to in (("[0-9]{2,}", "9+"), ("[0-9]", "9"), ("[A-Z]{2,}", "\x01"), ("[A-Z]", "\x02"), (r"\p{L}{2,}", "a+"), (r"\p{L}", "a"), ("\x01", "A+"), ("\x02", "A"), ("[ ]{2,}", " +")):
    _MASK_SQL = f"regexp_replace({_MASK_SQL}, '{_class}', '{_to}', 'g')"
_MASKS_SQL = f"""{_VERSIONS_SQL}, {_LONG_SQL},
m AS (SELECT source_object_id, source_column, {_MASK_SQL} mask, count(*) n FROM long WHERE cell IS NOT NULL GROUP BY ALL),
o AS (SELECT source_column, mask, sum(n) < 0.01 * sum(sum(n)) OVER (PARTITION BY source_column) is_rare FROM m GROUP BY 1, 2),
per AS (SELECT source_object_id, source_column, sum(n) n_present, count(*) n_masks, max(struct_pack(n := n, mask := mask)) top, COALESCE(sum(n) FILTER (is_rare), 0) n_rare FROM m JOIN o USING (source_column, mask) GROUP BY 1, 2),
ab AS (SELECT v.source_object_id, source_column, mask, 0 e, n a FROM m JOIN versions v USING (source_object_id) WHERE prev IS NOT NULL UNION ALL SELECT v.source_object_id, source_column, mask, n, 0 FROM m JOIN versions v ON v.prev = m.source_object_id),
bins AS (SELECT source_object_id, source_column, mask, sum(e) e, sum(a) a FROM ab GROUP BY ALL),
tot AS (SELECT *, sum(e) OVER g se, sum(a) OVER g sa FROM bins WINDOW g AS (PARTITION BY source_object_id, source_column)),
div AS (SELECT source_object_id, source_column, max(se) n_before, sum((greatest(a / sa, 0.0001) - greatest(e / se, 0.0001)) * ln(greatest(a / sa, 0.0001) / greatest(e / se, 0.0001))) mask_divergence FROM tot WHERE se > 0 AND sa > 0 GROUP BY 1, 2),
report AS (SELECT source_object_id, source_column, CAST(n_present AS BIGINT) n_present, n_masks, top.mask dominant_mask, top.n / n_present dominant_share, n_rare / n_present rare_share, CAST(COALESCE(n_before, 0) AS BIGINT) n_before, mask_divergence FROM per LEFT JOIN div USING (source_object_id, source_column))"""


@registry.add(f"WITH {_MASKS_SQL} SELECT * FROM report")
def p5_masks(spark: SparkSession, d: str) -> DataFrame:
    return quality.mask_report(table(spark, d, "invoices_2026_08"), table(spark, d, "source_object"))


@registry.add(
    f"""WITH {_MASKS_SQL} SELECT source_object_id, source_column, 'rare_masks' issue, rare_share figure FROM report WHERE rare_share > 0.05
UNION ALL SELECT source_object_id, source_column, 'mask_shift', mask_divergence FROM report WHERE mask_divergence > 0.25 AND n_present >= 50 AND n_before >= 50"""
)
def p5_mask_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Loads whose cells have rare masks, or other masks than the load before."""
    return quality.mask_breaks(cut(quality.mask_report(table(spark, d, "invoices_2026_08"), table(spark, d, "source_object"))))


@registry.add()
def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """Figures of every column of every load, from its values and from the stored profiles."""
    return quality.full_profile(cut(quality.all_values(table(spark, d, "invoices_2026_08"))), table(spark, d, "column_profile"))


@registry.add(
    f"""WITH {_LONG_SQL}, v AS (SELECT source_object_id, source_column, cell, count(*) n FROM long WHERE cell IS NOT NULL GROUP BY ALL),
cp AS (SELECT * FROM column_profile QUALIFY row_number() OVER (PARTITION BY source_object_id, col_name ORDER BY profile_id) = 1)
SELECT 'invoices' origin, source_object_id, source_column, cell AS value, CAST(n AS DOUBLE) n, n / sum(n) OVER (PARTITION BY source_object_id, source_column) share FROM v
UNION ALL SELECT 'stored', source_object_id, col_name, e.key, NULL, e.value FROM (SELECT source_object_id, col_name, unnest(map_entries(top_values)) e FROM cp)"""
)
def p5_value_shares(spark: SparkSession, d: str) -> DataFrame:
    """Count and share of every value of every column of every load, and the shares that the stored profiles hold."""
    return quality.value_shares(cut(quality.all_values(table(spark, d, "invoices_2026_08"))), table(spark, d, "column_profile"))
