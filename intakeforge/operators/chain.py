"""The resolver chain: the columns of source objects mapped to target fields by tiers, checked against their values.

Tiers go from sure to unsure: a field's name, an alias, expanded words, then a score over names, types and values. A column
takes the first tier whose field its values fit; fields taken by sure tiers are closed to the score. Two columns with one
field leave it to the more confident one; columns without field keep their values under an ``ext_`` name.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeforge.functions import names as N
from intakeforge.operators import resolving
from intakeforge.operators.resolving import CONFIDENCE, NAME_THRESHOLD, TOKEN_SET_THRESHOLD, adjusted_confidence, compat_status, ngrams, overlap, tier_rank
from intakeforge.session import cut
from intakeforge.sources.staging import unique_names

# Unit words that tell labels apart, and what labels lose that differ by them alone; the model's greatest confidence.
UNIT_WORDS = ["percent", "usd", "eur", "gbp", "cad", "aud", "jpy", "chf"]
WITHOUT_UNITS, MODEL_CAP = 0.95, 0.75
NUMERIC = ["int", "float", "currency", "percent"]

_NAME = T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("hints", T.ArrayType(T.StringType())), T.StructField("full", T.ArrayType(T.StringType()))])


@F.pandas_udf(_NAME)
def _normalized(names: pd.Series) -> pd.DataFrame:
    found = [N.normalize_name(n) for n in names]
    return pd.DataFrame([(w, h, N.expand(w)) for w, h in found], columns=["words", "hints", "full"])


def normalized_labels(fields: DataFrame) -> DataFrame:
    """(schema_name, field_name, label, is_name, words, full, set): names and aliases of the fields, each label once.

    ``set`` are its expanded words with the field's unit, where that is one of `UNIT_WORDS`.
    """
    own = fields.filter("field_name IS NOT NULL")
    lab = own.select("schema_name", "field_name", "unit", F.col("field_name").alias("label"), F.lit(True).alias("is_name"))
    lab = lab.unionByName(own.select("schema_name", "field_name", "unit", F.explode("aliases").alias("label"), F.lit(False).alias("is_name")).filter("label IS NOT NULL"))
    lab = lab.groupBy("schema_name", "field_name", "unit", "label").agg(F.max("is_name").alias("is_name")).withColumn("n", _normalized("label"))
    unit = F.lower("unit")
    with_unit = F.when(unit.isin(UNIT_WORDS), F.array_union("n.full", F.array(unit))).otherwise(F.array_distinct("n.full"))
    return lab.select("schema_name", "field_name", "label", "is_name", "n.words", "n.full", with_unit.alias("set"))


def normalized_headers(columns: DataFrame) -> DataFrame:
    """(schema_name, col_name, words, full, set) of every distinct header; ``set`` are its expanded words with unit hints."""
    h = columns.select("schema_name", "col_name").filter("col_name IS NOT NULL").distinct().withColumn("n", _normalized("col_name"))
    hints = F.filter("n.hints", lambda x: x.isin(UNIT_WORDS))
    return h.select("schema_name", "col_name", "n.words", "n.full", F.array_union("n.full", hints).alias("set"))


def _share(a: Column, b: Column) -> Column:
    """Jaccard index; 0 where a side is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), overlap(a, b)).otherwise(F.lit(0.0))


def named_fields(headers: DataFrame, labels: DataFrame) -> DataFrame:
    """(schema_name, col_name, field_name, tier, score): headers that are a field's name, or else an alias (the first field's)."""
    key = F.array_join("words", "_")
    lab = labels.filter("size(words) > 0").groupBy("schema_name", key.alias("key")).agg(F.min(F.struct(F.when(F.col("is_name"), 0).otherwise(1).alias("r"), "field_name")).alias("b"))
    j = headers.withColumn("key", key).join(lab, ["schema_name", "key"])
    return j.select("schema_name", "col_name", F.col("b.field_name").alias("field_name"), F.when(F.col("b.r") == 0, "exact").otherwise("dictionary").alias("tier"), F.lit(1.0).alias("score"))


def synonym_fields(headers: DataFrame, labels: DataFrame) -> DataFrame:
    """(schema_name, col_name, field_name, tier, score): the field whose expanded label shares most words with the header.

    Words but units count 0.95; at least 0.75 is needed, and more than for any other field. Headers meet only labels they share
    a word with; labels are the few of a schema.
    """
    h = headers.filter("size(set) > 0").select("schema_name", "col_name", F.col("set").alias("hs"), F.explode("set").alias("w"))
    lab = labels.filter("size(set) > 0").select("schema_name", "field_name", F.col("set").alias("ls")).distinct().withColumn("w", F.explode("ls"))
    meet = h.join(lab, ["schema_name", "w"]).select("schema_name", "col_name", "field_name", "hs", "ls").distinct()
    units = F.array(*map(F.lit, UNIT_WORDS))
    bare = lambda c: F.array_except(c, units)
    score = F.greatest(_share(F.col("hs"), F.col("ls")), WITHOUT_UNITS * _share(bare("hs"), bare("ls")))
    per = meet.groupBy("schema_name", "col_name", "field_name").agg(F.max(score).alias("score"))
    w = Window.partitionBy("schema_name", "col_name").orderBy(F.desc("score"), F.desc("field_name"))
    ranked = per.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    best = ranked.filter((F.col("rank") == 1) & (F.col("score") >= TOKEN_SET_THRESHOLD) & (F.col("next").isNull() | (F.col("next") < F.col("score"))))
    return best.select("schema_name", "col_name", "field_name", F.lit("synonym").alias("tier"), "score")


def _value_share(values: Column, weights: Column | None, fits: object) -> Column:
    """The weight of the values that fit, or their share where each counts the same."""
    kept = F.filter(values, fits)
    if weights is not None:
        return F.aggregate(kept, F.lit(0.0), lambda acc, v: acc + F.element_at(weights, v))
    return F.size(kept) / F.size(values)


def compat_rate() -> Column:
    """The least of three rates of a column (`PROFILE`) for a field (`FIELD`): cells that parse as the field's type, that are
    among its allowed values, and distinct values that match its pattern; 1 where there is nothing to check."""
    top, sample = F.map_keys("top_values"), F.coalesce("sample_values", F.array().cast("array<string>"))
    has_top = F.coalesce(F.size("top_values") > 0, F.lit(False))
    typed = F.when(F.col("field_type") != "string", F.coalesce(F.element_at("parse_rates", F.col("field_type")), F.lit(0.0)))
    allowed = F.transform("allowed_values", F.lower)
    is_allowed = lambda v: F.array_contains(allowed, F.lower(v))
    share = lambda fits, weights: F.when(has_top, _value_share(top, weights, fits)).when(F.size(sample) > 0, _value_share(sample, None, fits)).otherwise(1.0)
    listed = F.when(F.size("allowed_values") > 0, share(is_allowed, F.col("top_values")))
    pattern = F.concat(F.lit("^(?:"), F.col("value_pattern"), F.lit(")$"))
    matched = F.when(F.col("value_pattern").isNotNull(), share(lambda v: F.regexp_like(v, pattern), None))
    nothing = (F.coalesce(F.col("row_count"), F.lit(0)) == 0) | F.coalesce(F.size("parse_rates") <= 0, F.lit(True))
    return F.when(nothing, 1.0).otherwise(F.least(F.coalesce(typed, F.lit(1.0)), F.coalesce(listed, F.lit(1.0)), F.coalesce(matched, F.lit(1.0))))


PROFILE = ["inferred_type", "row_count", "parse_rates", "top_values", "sample_values"]
FIELD = ["field_type", "allowed_values", "value_pattern"]


def model_scores(headers: DataFrame, labels: DataFrame) -> DataFrame:
    """(schema_name, col_name, field_name, name): how alike a header and the best label of each field of its schema are,
    0.6 by trigrams and 0.4 by expanded words. A field list is small and every header meets the fields of its schema."""
    text = F.array_join("full", " ")
    h = headers.select("schema_name", "col_name", F.array_distinct("full").alias("hw"), ngrams(text).alias("hg"))
    lab = labels.select("schema_name", "field_name", F.array_distinct("full").alias("lw"), ngrams(text).alias("lg"))
    return h.join(lab, "schema_name").groupBy("schema_name", "col_name", "field_name").agg(F.max(0.6 * overlap(F.col("hg"), F.col("lg")) + 0.4 * _share(F.col("hw"), F.col("lw"))).alias("name"))


def model_total(name: Column) -> Column:
    """The score of a column for a field: 0.6 name, 0.15 type fit, 0.15 value fit (type fit without a rule for values), half of
    it where the type fits less than half. Fields have no descriptions here, whose overlap would count 0.1."""
    odd = F.col("inferred_type").isin([*NUMERIC, "date", "bool"])
    of_type = F.when(F.coalesce(F.size("parse_rates") <= 0, F.lit(True)), 0.5).otherwise(F.coalesce(F.element_at("parse_rates", F.col("field_type")), F.lit(0.0)))
    type_fit = F.when(F.col("field_type") == "string", F.when(odd, 0.5).otherwise(1.0)).otherwise(of_type)
    allowed = F.transform("allowed_values", F.lower)
    pattern = F.concat(F.lit("^(?:"), F.col("value_pattern"), F.lit(")$"))
    sample = F.coalesce("sample_values", F.array().cast("array<string>"))
    value = F.when(F.size("allowed_values") > 0, _value_share(sample, None, lambda v: F.array_contains(allowed, F.lower(v)))).when(F.col("value_pattern").isNotNull(), _value_share(sample, None, lambda v: F.regexp_like(v, pattern)))
    value = F.when(F.size(sample) > 0, value)
    total = 0.6 * name + 0.15 * type_fit + 0.15 * F.coalesce(value, type_fit)
    return F.when(type_fit < 0.5, total * 0.5).otherwise(total)


def resolve(columns: DataFrame, fields: DataFrame, model: bool = True) -> DataFrame:
    """Every column of every object with its target field, tier and confidence, or the ``ext_`` name under which it is kept.

    ``columns``: source_object_id, schema_name, col_name, col_position and the figures of its profile (`PROFILE`); ``fields``: schema_name,
    field_name, unit, aliases and `FIELD`. Output: source_object_id, col_name, target_field, tier, confidence, extension_column,
    lost_to (the column that holds its field), vetoes (tiers whose field its values don't fit). Repeated columns of an object
    count once; columns of unknown schemas stay without field.
    """
    K = ["source_object_id", "col_name"]
    c = columns.filter("source_object_id IS NOT NULL AND col_name IS NOT NULL").groupBy(*K).agg(F.min_by(F.struct("schema_name", "col_position", *PROFILE), "col_position").alias("r")).select(*K, "r.*")
    c = cut(c)
    labels = cut(normalized_labels(fields))
    headers = cut(normalized_headers(c))
    rules = fields.groupBy("schema_name", "field_name").agg(F.first(F.struct(*FIELD)).alias("f")).select("schema_name", "field_name", "f.*")
    sure = named_fields(headers, labels).unionByName(synonym_fields(headers, labels))
    checked = cut(_checked(c.join(sure, ["schema_name", "col_name"]).join(rules, ["schema_name", "field_name"]), _tier_confidence()))
    taken = checked.filter("status <> 'veto'").groupBy(*K).agg(F.min_by(F.struct("field_name", "tier", "confidence"), tier_rank(F.col("tier"))).alias("b")).select(*K, "b.*")
    vetoes = checked.filter("status = 'veto'").select(*K, "tier")
    if model:
        open_ = c.join(taken.select(*K), K, "left_anti")
        closed = taken.select("source_object_id", "field_name").distinct()
        pairs = open_.join(model_scores(headers, labels), ["schema_name", "col_name"]).join(rules, ["schema_name", "field_name"]).join(closed, ["source_object_id", "field_name"], "left_anti")
        scored = pairs.withColumn("score", model_total(F.col("name"))).filter(F.col("score") >= NAME_THRESHOLD)
        won = resolving.greedy_assignment(scored, ["source_object_id"], "col_name", "field_name", "score")
        judged = _checked(won.join(c, K).join(rules, ["schema_name", "field_name"]).withColumn("tier", F.lit("model")), F.least(F.lit(MODEL_CAP), F.round("score", 4)))
        judged = cut(judged)
        taken = taken.unionByName(judged.filter("status <> 'veto'").select(*K, "field_name", "tier", "confidence"))
        vetoes = vetoes.unionByName(judged.filter("status = 'veto'").select(*K, "tier"))
    w = Window.partitionBy("source_object_id", "field_name").orderBy(F.desc("confidence"), tier_rank(F.col("tier")), "col_name")
    taken = taken.withColumn("holder", F.first("col_name").over(w))
    refused = vetoes.groupBy(*K).agg(F.array_sort(F.collect_set("tier")).alias("vetoes"))
    j = c.select(*K, "col_position").join(taken, K, "left").join(refused, K, "left")
    holds = F.col("holder") == F.col("col_name")
    out = j.select(*K, "col_position", F.when(holds, F.col("field_name")).alias("target_field"), F.coalesce("tier", F.lit("unresolved")).alias("tier"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(~holds, F.col("holder")).alias("lost_to"), F.coalesce("vetoes", F.array().cast("array<string>")).alias("vetoes"))
    return with_extension_names(out).drop("col_position")


def _tier_confidence() -> Column:
    out = F.lit(CONFIDENCE["exact"])
    for tier in ("dictionary", "synonym"):
        out = F.when(F.col("tier") == tier, CONFIDENCE[tier]).otherwise(out)
    return out


def _checked(pairs: DataFrame, confidence: Column) -> DataFrame:
    """(source_object_id, col_name, field_name, tier, confidence, status): the confidence is lower for a partly fitting column."""
    p = pairs.withColumn("status", compat_status(compat_rate())).withColumn("confidence", confidence)
    return p.select("source_object_id", "col_name", "field_name", "tier", F.coalesce(adjusted_confidence(F.col("confidence"), F.col("status")), F.lit(0.0)).alias("confidence"), "status")


def with_extension_names(resolved: DataFrame) -> DataFrame:
    """Adds ``extension_column`` to columns without field: ``ext_`` and the words of the header, unique in an object.

    The columns of one object are one header line, so that they fit one row.
    """
    name = F.concat(F.lit("ext_"), F.coalesce(F.nullif(F.array_join(_normalized("col_name")["words"], "_"), F.lit("")), F.lit("column")))
    free = resolved.filter("target_field IS NULL").select("source_object_id", "col_position", "col_name", name.alias("ext"))
    per = free.groupBy("source_object_id").agg(F.array_sort(F.collect_list(F.struct("col_position", "col_name", "ext"))).alias("cols"))
    per = per.select("source_object_id", "cols", unique_names(F.transform("cols", lambda x: x["ext"])).alias("names"))
    named = per.select("source_object_id", F.explode(F.transform("cols", lambda x, i: F.struct(x["col_name"].alias("col_name"), F.get("names", i).alias("extension_column")))).alias("x"))
    return resolved.join(named.select("source_object_id", "x.*"), ["source_object_id", "col_name"], "left")


UNCITED_CAP = 0.5
_RESPONSE = "mappings array<struct<source_column:string,target_field:string,confidence:double,rationale:string,evidence:array<string>>>, broken string"


def validated_responses(responses: DataFrame, columns: DataFrame, fields: DataFrame, held: DataFrame, cap: float = MODEL_CAP) -> tuple[DataFrame, DataFrame]:
    """(mappings, rejected) of a model's answers in JSON, which are taken for nothing more than text.

    ``responses``: feed_id, text; ``columns``: feed_id, schema_name, col_name asked for; ``fields``: schema_name, field_name; ``held``:
    feed_id, field_name that is taken. Code fences around the JSON go. An answer that is no object with a list of mappings, or has a
    mapping without column, is rejected whole, with its feed. Columns that were not asked for and repeated ones are dropped;
    unknown and taken fields are cleared; a confidence without evidence is 0.5 at most, any one ``cap`` at most and 0 at least.
    """
    body = F.regexp_replace(F.trim("text"), r"^```[A-Za-z]*\s*|\s*```$", "")
    r = responses.select("feed_id", F.from_json(body, _RESPONSE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r.broken").isNotNull() | F.col("r.mappings").isNull() | F.exists("r.mappings", lambda m: m["source_column"].isNull())
    rejected = r.filter(bad).select("feed_id")
    m = r.filter(~bad).select("feed_id", F.posexplode("r.mappings").alias("at", "m")).select("feed_id", "at", "m.*")
    asked = columns.select("feed_id", "schema_name", F.col("col_name").alias("source_column")).distinct()
    m = m.join(asked, ["feed_id", "source_column"]).withColumn("_r", F.row_number().over(Window.partitionBy("feed_id", "source_column").orderBy("at"))).filter("_r = 1")
    known = fields.select("schema_name", F.col("field_name").alias("target_field"), F.lit(True).alias("known")).distinct()
    taken = held.select("feed_id", F.col("field_name").alias("target_field"), F.lit(True).alias("taken")).distinct()
    m = m.join(known, ["schema_name", "target_field"], "left").join(taken, ["feed_id", "target_field"], "left")
    target = F.when(F.col("known") & F.col("taken").isNull(), F.col("target_field"))
    limit = F.when(F.coalesce(F.size("evidence") > 0, F.lit(False)), cap).otherwise(min(cap, UNCITED_CAP))
    confidence = F.when(target.isNotNull(), F.greatest(F.lit(0.0), F.least(limit, F.coalesce("confidence", F.lit(0.0))))).otherwise(0.0)
    return m.select("feed_id", "source_column", target.alias("target_field"), confidence.alias("confidence"), "rationale"), rejected


def metrics(resolved: DataFrame, truth: DataFrame) -> DataFrame:
    """Per tier: columns, mapped, correct and wrong ones, decoys mapped, and those a reviewer has to decide, with precision.

    ``truth``: source_object_id, col_name, true_field (NULL for a decoy). Columns without truth are left out.
    """
    j = resolved.join(truth, ["source_object_id", "col_name"])
    hit = F.col("target_field").isNotNull()
    right = hit & F.col("target_field").eqNullSafe(F.col("true_field"))
    queued = hit & (F.col("confidence") < CONFIDENCE["synonym"])
    a = j.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("mapped"), F.count_if(right).alias("correct"), F.count_if(hit & F.col("true_field").isNull()).alias("decoy_hits"), F.count_if(queued).alias("queued"), F.count_if(queued & ~right).alias("queued_wrong"))
    return a.withColumn("precision", F.when(F.col("mapped") > 0, F.col("correct") / F.col("mapped")))
