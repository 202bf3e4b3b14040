"""Drift events between the profiles of two objects of a feed: what changed, how bad it is, and which mapping still stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intakeforge.operators import resolving
from intakeforge.operators.chain import FIELD, NUMERIC, compat_rate
from intakeforge.operators.resolving import compat_status, ngrams, overlap

# Thresholds of the events.
NULL_RATE_JUMP, PSI_THRESHOLD, PSI_LEAST, DISTINCT_RATIO, RENAME_AT = 0.2, 0.25, 50, 0.5, 0.6
_PROFILE = "array<struct<name:string,position:int,inferred_type:string,date_format:string,null_rate:double,distinct_count:bigint,sample_values:array<string>,pattern_signatures:map<string,double>,top_values:map<string,double>>>"
SEVERITIES = ["breaking", "warning", "info"]


def profiles_of(objects: DataFrame) -> DataFrame:
    """(source_object_id, col_name, figures) from profile_json; malformed JSON has no columns, a repeated header its first one."""
    p = objects.filter("source_object_id IS NOT NULL").select("source_object_id", "row_count", F.explode(F.from_json("profile_json", _PROFILE)).alias("p")).select("source_object_id", "row_count", "p.*").filter("name IS NOT NULL")
    return p.groupBy("source_object_id", F.col("name").alias("col_name")).agg(F.min_by(F.struct("inferred_type", "date_format", "null_rate", "distinct_count", "row_count", "sample_values", "pattern_signatures", "top_values"), "position").alias("r")).select("source_object_id", "col_name", "r.*")


def _map_overlap(a: Column, b: Column) -> Column:
    """Sum of the lesser shares of the keys that two maps have in common."""
    return F.coalesce(F.aggregate(F.array_intersect(F.map_keys(a), F.map_keys(b)), F.lit(0.0), lambda acc, k: acc + F.least(F.element_at(a, k), F.element_at(b, k))), F.lit(0.0))


def profile_similarity(old: str, new: str) -> Column:
    """0.4 same type, 0.3 signature overlap, 0.3 value overlap: of frequent values, or half for numbers, or of samples."""
    o, n = (lambda f: F.col(f"{old}.{f}")), (lambda f: F.col(f"{new}.{f}"))
    full = lambda m: F.coalesce(F.size(m) > 0, F.lit(False))
    sample = F.coalesce(overlap(o("sample_values"), n("sample_values")), F.lit(0.0))
    values = F.when(full(o("top_values")) & full(n("top_values")), _map_overlap(o("top_values"), n("top_values"))).when(o("inferred_type").isin(NUMERIC) & n("inferred_type").isin(NUMERIC), 0.5).otherwise(sample)
    return 0.4 * F.when(o("inferred_type") == n("inferred_type"), 1.0).otherwise(0.0) + 0.3 * _map_overlap(o("pattern_signatures"), n("pattern_signatures")) + 0.3 * values


def top_value_psi(old: str, new: str) -> Column:
    """Population stability index of the frequent values; NULL where it says nothing: under 50 cells on a side, dates, or more
    different values than half the cells."""
    o, n = (lambda f: F.col(f"{old}.{f}")), (lambda f: F.col(f"{new}.{f}"))
    cells = lambda x: x("row_count") * (1 - x("null_rate"))
    share = lambda m, k: F.greatest(F.coalesce(F.element_at(m, k), F.lit(0.0)), F.lit(1e-4))
    keys = F.array_union(F.map_keys(o("top_values")), F.map_keys(n("top_values")))
    index = F.aggregate(keys, F.lit(0.0), lambda acc, k: acc + (share(n("top_values"), k) - share(o("top_values"), k)) * F.log(share(n("top_values"), k) / share(o("top_values"), k)))
    fits = (cells(o) >= PSI_LEAST) & (cells(n) >= PSI_LEAST) & (o("inferred_type") != "date") & (F.size(o("top_values")) > 0) & (F.size(n("top_values")) > 0) & (o("distinct_count") <= DISTINCT_RATIO * cells(o))
    return F.when(fits, index)


def renames(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(source_object_id, old_name, new_name, score): removed and added columns of an object paired one to one by descending score.

    The score is 0.5 profile similarity, 0.3 trigrams of the headers and 0.3 where the resolvers lead the new column to the old
    one's field, 1 at most. Only the changed columns of one object meet.
    """
    text = lambda c: F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0), "_")
    agrees = F.coalesce(F.col("old_target") == F.col("new_target"), F.lit(False))
    j = removed.join(added, "source_object_id")
    score = F.least(F.lit(1.0), 0.5 * profile_similarity("old", "new") + 0.3 * overlap(ngrams(text(F.col("old_name"))), ngrams(text(F.col("new_name")))) + F.when(agrees, 0.3).otherwise(0.0))
    scored = j.select("source_object_id", "old_name", "new_name", score.alias("score")).filter(F.col("score") >= RENAME_AT)
    return resolving.greedy_assignment(scored, ["source_object_id"], "old_name", "new_name", "score")


def drift_events(profiles: DataFrame, before: DataFrame, mapping: DataFrame, fields: DataFrame, resolved: DataFrame) -> DataFrame:
    """(source_object_id, rank, kind, severity, source_column, detail): the events of every object against the one before.

    ``profiles``: `profiles_of`; ``before``: source_object_id, feed_id, prev_object_id; ``mapping``: feed_id, schema_name, source_column,
    target_field, the mapping in force; ``fields``: the target fields; ``resolved``: source_object_id, col_name, target_field of sure
    resolvers. Kinds: renamed, removed, added, type_changed, format_changed, null_rate_shift, distribution_shift. A change of a mapped
    column is breaking where it makes its values unreadable: removed or renamed, another date layout, or a type that the field's
    rules veto. ``rank`` orders an object's events by severity, kind and column.
    """
    from intakeforge.session import cut

    cols = [c for c in profiles.columns if c not in ("source_object_id", "col_name")]
    pair = before.filter("prev_object_id IS NOT NULL").select("source_object_id", "prev_object_id", "feed_id")
    known = profiles.select("source_object_id").distinct()
    pair = pair.join(known, "source_object_id", "left_semi").join(known.withColumnRenamed("source_object_id", "prev_object_id"), "prev_object_id", "left_semi")
    target = mapping.groupBy("feed_id", F.col("source_column").alias("col_name")).agg(F.min(F.struct("schema_name", "target_field")).alias("m")).select("feed_id", "col_name", "m.schema_name", F.col("m.target_field").alias("target"))
    packed = profiles.select("source_object_id", "col_name", F.struct(*cols).alias("p"))
    new = pair.join(packed, "source_object_id").withColumnRenamed("p", "new")
    old = pair.join(packed.withColumnRenamed("source_object_id", "prev_object_id"), "prev_object_id").withColumnRenamed("p", "old")
    both = old.join(new.select("source_object_id", "col_name", "new"), ["source_object_id", "col_name"], "full_outer")
    both = both.drop("feed_id").join(pair.select("source_object_id", "feed_id"), "source_object_id").join(target, ["feed_id", "col_name"], "left")
    both = cut(both)
    removed = both.filter("new IS NULL").select("source_object_id", F.col("col_name").alias("old_name"), "old", F.col("target").alias("old_target"))
    added = both.filter("old IS NULL").select("source_object_id", F.col("col_name").alias("new_name"), "new")
    added = added.join(resolved.select("source_object_id", F.col("col_name").alias("new_name"), F.col("target_field").alias("new_target")), ["source_object_id", "new_name"], "left")
    pairs = cut(renames(removed, added))
    broken = lambda t, when=None: F.when(t.isNotNull() if when is None else t.isNotNull() & when, "breaking").otherwise("warning")
    event = lambda df, kind, severity, column, detail: df.select("source_object_id", F.lit(kind).alias("kind"), severity.alias("severity"), F.col(column).alias("source_column"), detail.alias("detail"))
    t = F.col("old_target")
    out = event(pairs.join(removed.drop("old"), ["source_object_id", "old_name"]), "renamed", broken(t), "new_name", F.concat(F.lit("from "), "old_name", F.lit(", score "), F.round("score", 4).cast("string")))
    out = out.unionByName(event(removed.join(pairs, ["source_object_id", "old_name"], "left_anti"), "removed", broken(t), "old_name", F.coalesce(F.concat(F.lit("held "), t), F.lit("not mapped"))))
    out = out.unionByName(event(added.join(pairs, ["source_object_id", "new_name"], "left_anti"), "added", F.lit("warning"), "new_name", F.coalesce("new_target", F.lit("no field"))))
    common = both.filter("old IS NOT NULL AND new IS NOT NULL")
    rules = fields.groupBy("schema_name", F.col("field_name").alias("target")).agg(F.first(F.struct(*FIELD)).alias("f")).select("schema_name", "target", "f.*")
    typed = common.filter("old.inferred_type <> new.inferred_type AND old.inferred_type <> 'empty' AND new.inferred_type <> 'empty'").join(rules, ["schema_name", "target"], "left")
    # Rates of the whole object are not in these profiles; its type says which of them is 1.
    kind = F.col("new.inferred_type")
    rates = F.create_map(F.lit("integer"), (kind == "int").cast("double"), F.lit("number"), kind.isin(NUMERIC).cast("double"), F.lit("date"), (kind == "date").cast("double"), F.lit("boolean"), (kind == "bool").cast("double"))
    typed = typed.withColumns({"row_count": F.col("new.row_count"), "parse_rates": rates, "top_values": F.col("new.top_values"), "sample_values": F.col("new.sample_values")})
    veto = F.col("field_type").isNotNull() & (compat_status(compat_rate()) == "veto")
    change = lambda f: F.concat(F.col(f"old.{f}"), F.lit(" to "), F.col(f"new.{f}"))
    out = out.unionByName(event(typed, "type_changed", broken(F.col("target"), veto), "col_name", change("inferred_type")))
    same = common.filter("old.inferred_type = new.inferred_type")
    out = out.unionByName(event(same.filter("old.date_format <> new.date_format"), "format_changed", broken(F.col("target")), "col_name", change("date_format")))
    shift = F.abs(F.col("new.null_rate") - F.col("old.null_rate"))
    out = out.unionByName(event(common.filter(shift > NULL_RATE_JUMP), "null_rate_shift", F.lit("warning"), "col_name", F.format_string("%.4f to %.4f", F.col("old.null_rate"), F.col("new.null_rate"))))
    index = same.withColumn("psi", top_value_psi("old", "new")).filter(F.col("psi") > PSI_THRESHOLD)
    out = out.unionByName(event(index, "distribution_shift", F.lit("warning"), "col_name", F.format_string("%.4f", F.col("psi"))))
    w = Window.partitionBy("source_object_id").orderBy(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), "kind", "source_column")
    return out.withColumn("rank", F.row_number().over(w)).select("source_object_id", "rank", "kind", "severity", "source_column", "detail")


def carried_mapping(events: DataFrame, before: DataFrame, mapping: DataFrame, columns: DataFrame) -> DataFrame:
    """(source_object_id, source_column, target_field, confidence, tier): the mapping in force as far as it holds for a drifted object.

    Columns that kept their header keep their field (``carryover``, 0.95) unless a changed type broke them; a renamed column takes
    the field of its old header (``rename``, its score, 0.85 at most) where no other column holds it. What is left goes through
    `chain.resolve`. ``columns``: source_object_id, col_name.
    """
    from intakeforge.operators.resolving import CONFIDENCE

    target = mapping.groupBy("feed_id", "source_column").agg(F.min("target_field").alias("target_field"))
    here = columns.join(before.select("source_object_id", "feed_id"), "source_object_id")
    broken = events.filter("kind = 'type_changed' AND severity = 'breaking'").select("source_object_id", F.col("source_column").alias("col_name"))
    kept = here.join(target.withColumnRenamed("source_column", "col_name"), ["feed_id", "col_name"]).join(broken, ["source_object_id", "col_name"], "left_anti")
    kept = kept.select("source_object_id", F.col("col_name").alias("source_column"), "target_field", F.lit(CONFIDENCE["exact"]).alias("confidence"), F.lit("carryover").alias("tier"))
    renamed = events.filter("kind = 'renamed'").select("source_object_id", F.col("source_column").alias("new_name"), F.regexp_extract("detail", "^from (.*), score [0-9.E-]+$", 1).alias("source_column"), F.regexp_extract("detail", "score ([0-9.E-]+)$", 1).cast("double").alias("score"))
    renamed = renamed.join(before.select("source_object_id", "feed_id"), "source_object_id").join(target, ["feed_id", "source_column"]).join(kept.select("source_object_id", "target_field"), ["source_object_id", "target_field"], "left_anti")
    renamed = renamed.select("source_object_id", F.col("new_name").alias("source_column"), "target_field", F.round(F.least(F.lit(CONFIDENCE["synonym"]), F.col("score")), 4).alias("confidence"), F.lit("rename").alias("tier"))
    w = Window.partitionBy("source_object_id", "target_field").orderBy(F.desc("confidence"), "source_column")
    return kept.unionByName(renamed).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
