"""Loading typed rows into a table: rejects, latest row per key, additive evolution, upsert with matched NULLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from intakeforge.operators.casting import quoted


def has_key(key: list[str]) -> Column:
    out = F.lit(True)
    for k in key:
        out = out & quoted(k).isNotNull()
    return out


def reject_null_keys(rows: DataFrame, key: list[str], counters: Observation | None = None) -> DataFrame:
    """Rows whose whole key is present; staged and rejected rows are counted in the same pass."""
    if counters is not None:
        rows = rows.observe(counters, F.count(F.lit(1)).alias("rows_staged"), F.count_if(~has_key(key)).alias("rows_rejected"))
    return rows.filter(has_key(key))


def latest_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row of greatest order per key, whole. An aggregate, so that the map side combines and a hot key is no group in memory.

    A schema without key is refused: it would keep one row of all. Rows equal in the order expressions are told apart by all
    other columns, so that the result doesn't depend on the partitioning.
    """
    if not key:
        raise ValueError("a table without key has no latest rows")
    rest = [c for c in rows.columns if c not in key]
    best = F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[quoted(c) for c in rest])).alias("_best")
    return rows.groupBy(*[quoted(k) for k in key]).agg(best).select(*[quoted(c) if c in key else F.col("_best").getField(c).alias(c) for c in rows.columns])


def upsert(target: DataFrame, source: DataFrame, key: list[str], planned: list[str] | None = None) -> DataFrame:
    """Target and source merged by key: matched rows take the source's planned columns, NULLs included.

    Columns only the target has survive on matched rows; those only the source has are added (NULL on old rows). Both sides
    are expected to be unique by key.
    """
    fresh = [c for c in source.columns if c not in key]
    planned = fresh if planned is None else planned
    old = [c for c in target.columns if c not in key]
    s = source.select(*[quoted(k).alias(f"_s_{k}") for k in key], *[quoted(c).alias(f"_s_{c}") for c in fresh], F.lit(True).alias("_in_source"))
    on = None
    for k in key:
        one = quoted(k) == F.col(f"`_s_{k}`")
        on = one if on is None else on & one
    j = target.join(s, on, "full_outer")
    matched = F.coalesce(F.col("_in_source"), F.lit(False))
    out = [F.coalesce(quoted(k), F.col(f"`_s_{k}`")).alias(k) for k in key]
    for c in old + [c for c in fresh if c not in old]:
        if c in planned and c in fresh:
            out.append(F.when(matched, F.col(f"`_s_{c}`")).otherwise(quoted(c) if c in old else F.lit(None)).alias(c))
        else:
            out.append(quoted(c))
    return j.select(*out)


def accumulate(batches: list[DataFrame]) -> DataFrame:
    """Batches of several feeds under one schema that only grows."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def new_deliveries(objects: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``is_new``: whether a row is the first one of its key; later ones repeat a delivery. NULL keys are never repeats."""
    first = objects.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    j = objects.join(first, keys, "left")
    return j.withColumn("is_new", F.coalesce(F.struct(*order) == F.col("_first"), F.lit(True))).drop("_first")
