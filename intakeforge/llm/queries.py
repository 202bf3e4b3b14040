"""Queries of the problems on free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from intakeforge.llm import canonical, leakage, mixing, mojibake, name_links, text_quality
from intakeforge.plans.registry import Registry
from intakeforge.session import table

registry = Registry()


@registry.add()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_proposals(table(spark, d, "mapping_proposal"), table(spark, d, "source_feed"), table(spark, d, "field_spec")).select("proposal_id", "target_field")


@registry.add()
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Every mapped value with its score, and the unmatched ones."""
    return canonical.map_proposals(table(spark, d, "mapping_proposal"), table(spark, d, "source_feed"), table(spark, d, "field_spec"))


@registry.add()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_cells(table(spark, d, "invoices_2026_08"))


@registry.add()
def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, d, "invoices_2026_08"))


@registry.add()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return name_links.linked_pairs(table(spark, d, "invoices_2026_08"))


@registry.add()
def p6_members(spark: SparkSession, d: str) -> DataFrame:
    """Each linked id with the id that stands for its entity."""
    return name_links.linked_ids(table(spark, d, "invoices_2026_08"))


_GRAMS_SQL = """w AS (SELECT doc_id, row_number() OVER () k, text, regexp_extract_all(text, '[A-Za-z0-9]+') t FROM documents),
grams AS (SELECT k, doc_id, len(t) n_words, i, lower(array_to_string(t[i:i + 11], ' ')) g FROM w, range(1, len(t) - 10) r(i)),
items AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9]+') t FROM eval_items WHERE text IS NOT NULL),
igrams AS (SELECT DISTINCT CAST(item_id AS BIGINT) item_id, lower(array_to_string(t[i:i + 11], ' ')) g FROM items, range(1, len(t) - 10) r(i)),
hits AS (SELECT k, doc_id, n_words, item_id, i FROM grams JOIN igrams USING (g))"""


@registry.add(f"WITH {_GRAMS_SQL} SELECT DISTINCT doc_id, item_id FROM hits")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_pairs(table(spark, d, "documents"), table(spark, d, "eval_items"))


@registry.add(
    f"""WITH {_GRAMS_SQL}, steps AS (SELECT *, i - lag(i) OVER p step, i - row_number() OVER p run FROM hits WINDOW p AS (PARTITION BY k, item_id ORDER BY i)),
runs AS (SELECT k, item_id, run, count(*) + 11 longest FROM steps GROUP BY ALL), top AS (SELECT k, item_id, max(longest) longest FROM runs GROUP BY ALL)
SELECT doc_id, item_id, CAST(n_words AS INT) n_words, CAST(sum(least(12, COALESCE(step, 12))) AS INT) words_leaked, CAST(longest AS INT) longest, CAST(min(i) - 1 AS INT) first_word, CAST(max(i) + 10 AS INT) last_word
FROM steps JOIN top USING (k, item_id) GROUP BY k, doc_id, item_id, n_words, longest"""
)
def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@registry.add(
    f"""WITH {_GRAMS_SQL}, leaked AS (SELECT k, list_sort(list_distinct(flatten(list(range(i, i + 12))))) js FROM (SELECT DISTINCT k, i FROM hits) GROUP BY k),
marked AS (SELECT w.*, list_transform(range(1, len(t) + 1), lambda x: list_contains(COALESCE(js, []), x)) c, regexp_split_to_array(text, '[A-Za-z0-9]+') sep, len(COALESCE(js, [])) removed FROM w LEFT JOIN leaked USING (k))
SELECT doc_id, CAST(COALESCE(len(t), 0) AS INT) n_words, CAST(removed AS INT) words_removed,
  CASE WHEN removed = 0 THEN text WHEN removed <= 0.5 * len(t) THEN sep[1] || array_to_string(list_transform(range(1, len(t) + 1),
    lambda x: CASE WHEN NOT c[x] THEN t[x] WHEN x = 1 OR NOT c[x - 1] THEN ' ' ELSE '' END || CASE WHEN c[x] AND x < len(t) AND c[x + 1] THEN '' ELSE sep[x + 1] END), '') END clean_text FROM marked"""
)
def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@registry.add()
def p8_mix_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(table(spark, d, "documents"), table(spark, d, "mix_target"))


@registry.add()
def p8_mix_documents(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


@registry.add()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return text_quality.not_prose(table(spark, d, "documents"), table(spark, d, "common_words"))


@registry.add()
def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return text_quality.text_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_BLANK = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@registry.add(
    rf"""WITH c AS (SELECT list(DISTINCT lower(word)) common FROM common_words WHERE word IS NOT NULL),
d AS (SELECT CAST(doc_id AS BIGINT) doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{Nl}}\p{{No}}]+(?:[''’-][\p{{L}}\p{{Nl}}\p{{No}}]+)*') w, regexp_replace(text, '{_BLANK}', '', 'g') dense,
  list_filter(regexp_split_to_array(text, '{_BREAKS}'), lambda x: NOT regexp_full_match(x, '{_BLANK}*')) l FROM documents WHERE NOT regexp_full_match(text, '{_BLANK}*'))
SELECT doc_id, CAST(len(w) AS INT) n_words, CAST(len(l) AS INT) n_lines, CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w) END mean_word_length,
  CASE WHEN dense <> '' THEN len(regexp_extract_all(dense, '[^\p{{L}}\p{{N}}]')) / length(dense) END symbol_ratio,
  CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: regexp_matches(x, '[.!?…:;,][''"”’)\]]*{_BLANK}*$'))) / len(l) END punctuated_lines,
  CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains(common, x))) / len(w) END common_share FROM d, c"""
)
def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    """Those statistics that are counts and shares of words, signs and lines."""
    return p9_statistics(spark, d).select("doc_id", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_share")
