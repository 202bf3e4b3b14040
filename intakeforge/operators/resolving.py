"""Source headers resolved to target fields: exact names, aliases, token sets, n-gram scores, compatibility, collisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeforge.functions.names import normalize_name

# Confidence of each tier, and their order from strongest to weakest.
CONFIDENCE = {"exact": 0.95, "dictionary": 0.90, "synonym": 0.85}
TIERS = ["human", "exact", "dictionary", "synonym"]
TOKEN_SET_THRESHOLD, NAME_THRESHOLD = 0.75, 0.35
OK_RATE, VETO_RATE, PENALTY = 0.9, 0.5, 0.15


def header_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def words(c: Column) -> Column:
    """Distinct words of a header in lower case, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)))


def labels(specs: DataFrame) -> DataFrame:
    """(schema_name, target_field, label, tier rank): 1 for a field's name, 2 for its aliases."""
    names = specs.select("schema_name", F.col("field_name").alias("target_field"), F.col("field_name").alias("label"), F.lit(1).alias("rank"))
    return names.unionByName(specs.select("schema_name", F.col("field_name").alias("target_field"), F.explode("aliases").alias("label"), F.lit(2).alias("rank")))


def exact_and_dictionary(headers: DataFrame, specs: DataFrame) -> DataFrame:
    """Headers whose key is a field's name (exact) or alias (dictionary); names go before aliases, then the first field."""
    best = labels(specs).withColumn("key", header_key(F.col("label"))).groupBy("schema_name", "key").agg(F.min(F.struct("rank", "target_field")).alias("b"))
    j = headers.drop("target_field", "tier", "confidence").withColumn("key", header_key(F.col("source_column"))).join(best, ["schema_name", "key"])
    tier = F.when(F.col("b.rank") == 1, "exact").otherwise("dictionary")
    confidence = F.when(F.col("b.rank") == 1, CONFIDENCE["exact"]).otherwise(CONFIDENCE["dictionary"])
    return j.withColumn("target_field", F.col("b.target_field")).withColumn("tier", tier).withColumn("confidence", confidence).drop("key", "b")


def best_token_sets(headers: DataFrame, specs: DataFrame) -> DataFrame:
    """The field whose label shares most words with each distinct header, if it does so alone and by 0.75 or more.

    Headers meet only labels they share a word with.
    """
    h = headers.select("schema_name", F.lower("source_column").alias("header"), words(F.col("source_column")).alias("hw")).distinct()
    lab = labels(specs).withColumn("lw", words(F.col("label"))).select("schema_name", "target_field", "lw").distinct()
    meet = h.withColumn("w", F.explode("hw")).join(lab.withColumn("w", F.explode("lw")), ["schema_name", "w"])
    s = meet.groupBy("schema_name", "header", "target_field", "hw", "lw").agg(F.count(F.lit(1)).alias("shared"))
    s = s.groupBy("schema_name", "header", "target_field").agg(F.max(F.col("shared") / (F.size("hw") + F.size("lw") - F.col("shared"))).alias("score"))
    w = Window.partitionBy("schema_name", "header")
    r = s.withColumn("rn", F.row_number().over(w.orderBy(F.desc("score"), "target_field"))).withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy("schema_name", "header", "score")))
    return r.filter((F.col("rn") == 1) & (F.col("ties") == 1) & (F.col("score") >= TOKEN_SET_THRESHOLD)).select("schema_name", "header", "target_field", "score")


def ngrams(c: Column, n: int = 3) -> Column:
    """Distinct n-grams of the text padded by two spaces before and one after."""
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n))))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def name_scores(headers: DataFrame, specs: DataFrame) -> DataFrame:
    """0.6 trigram overlap + 0.4 word overlap of each distinct header with the fields of its schema, where 0.35 or more."""
    text = F.array_join(F.regexp_extract_all(F.lower("source_column"), F.lit("[a-z0-9]+"), 0), " ")
    h = headers.select("schema_name", F.lower("source_column").alias("header"), text.alias("t")).filter("t <> ''").distinct().withColumn("a", ngrams(F.col("t")))
    f = specs.select("schema_name", "field_name", F.replace("field_name", F.lit("_"), F.lit(" ")).alias("l")).withColumn("b", ngrams(F.col("l")))
    score = 0.6 * overlap(F.col("a"), F.col("b")) + 0.4 * overlap(F.array_distinct(F.split("t", " ")), F.array_distinct(F.split("l", " ")))
    return h.join(f, "schema_name").select("schema_name", "header", "field_name", score.alias("score")).filter(F.col("score") >= NAME_THRESHOLD)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _name_words(names: pd.Series) -> pd.Series:
    return names.map(lambda n: normalize_name(n)[0])


def label_scores(headers: DataFrame, specs: DataFrame) -> DataFrame:
    """(schema, header, field, score): 0.6 trigram overlap + 0.4 word overlap with the best label of the field, where above 0.

    Words are those of `normalize_name`: camel case split, without accents and unit hints. Headers without a word have none.
    """
    both = lambda c: F.array_join(F.col(c), " ")
    h = headers.select("schema_name", "source_column").distinct().withColumn("hw", _name_words("source_column")).filter("size(hw) > 0").withColumn("a", ngrams(both("hw")))
    lab = labels(specs).filter("label IS NOT NULL").select("schema_name", F.col("target_field").alias("field_name"), "label").distinct().withColumn("lw", _name_words("label")).filter("size(lw) > 0").withColumn("b", ngrams(both("lw")))
    score = 0.6 * overlap(F.col("a"), F.col("b")) + 0.4 * overlap(F.array_distinct("hw"), F.array_distinct("lw"))
    return h.join(lab, "schema_name").groupBy("schema_name", "source_column", "field_name").agg(F.max(score).alias("score")).filter("score > 0")


def greedy_assignment(scores: DataFrame, group: list[str], column: str, field: str, score: str) -> DataFrame:
    """One-to-one pairs by descending score (ties by column and field), group by group.

    Each round takes every pair that is the best of both its column and its field, which is what the sequential method ends
    with; it ends when no pair is left. Groups are one file's headers.
    """
    from intakeforge.session import cut

    rank = F.struct(F.col(score).alias("s"), F.col(column).alias("c"), F.col(field).alias("f"))
    best = lambda by: F.row_number().over(Window.partitionBy(*group, by).orderBy(F.desc(score), column, field))
    left, done = cut(scores.select(*group, column, field, score).withColumn("_r", rank)), None
    while not left.isEmpty():
        won = cut(left.withColumn("_a", best(column)).withColumn("_b", best(field)).filter("_a = 1 AND _b = 1").select(*group, column, field, score))
        done = won if done is None else done.unionByName(won)
        left = cut(left.join(won.select(*group, column), [*group, column], "left_anti").join(won.select(*group, field), [*group, field], "left_anti"))
    return done if done is not None else scores.select(*group, column, field, score).limit(0)


def compat_status(rate: Column) -> Column:
    return F.when(rate >= OK_RATE, "ok").when(rate >= VETO_RATE, "downgrade").otherwise("veto")


def adjusted_confidence(confidence: Column, status: Column) -> Column:
    """Lower by the penalty for a partly fitting column, NULL for a veto."""
    return F.when(status == "ok", confidence).when(status == "downgrade", F.round(confidence - PENALTY, 4))


def tier_rank(tier: Column) -> Column:
    out = F.when(tier == TIERS[0], 0)
    for i, t in enumerate(TIERS[1:], 1):
        out = out.when(tier == t, i)
    return out.otherwise(len(TIERS))


def collision_winners(proposals: DataFrame, by: list[str]) -> DataFrame:
    """Of the proposals for one target the most confident, then the strongest tier, then the first column."""
    w = Window.partitionBy(*by).orderBy(F.desc("confidence"), tier_rank(F.col("tier")), "source_column", "proposal_id")
    return proposals.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def benchmark(predicted: DataFrame, by: str) -> DataFrame:
    """Counts behind precision, recall and decoy hits of predictions against decided rows."""
    hit = F.col("predicted").isNotNull()
    decoy = F.col("status") == "demoted"
    return predicted.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("mapped"), F.count_if(F.col("predicted") == F.col("target_field")).alias("correct"), F.count_if(decoy).alias("decoys"), F.count_if(decoy & hit).alias("decoy_hits"))
