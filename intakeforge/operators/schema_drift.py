"""Schemas that drift between the files of a feed: matched columns, changes of each step, and one consistent table."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intakeforge.functions.names import name_key, name_similarity
from intakeforge.operators.versions import distinct_deliveries, with_previous
from intakeforge.session import cut

#: Rows of the field list (aliases of a few target schemas) that are sent to every task; more is an error, not a cut.
MAX_SPEC_ROWS = 20_000
VALUE_WEIGHT, NAME_WEIGHT, SHAPE_WEIGHT = 0.5, 0.4, 0.1
MIN_SCORE = 0.45


def assign(score: list[list[float]]) -> list[int]:
    """Column of each row in an assignment of greatest total score (Hungarian method with potentials, O(n^2 m))."""
    n = len(score)
    m = len(score[0]) if n else 0
    if n > m:
        other = assign([list(c) for c in zip(*score)])
        out = [-1] * n
        for j, i in enumerate(other):
            out[i] = j
        return out
    inf = float("inf")
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, seen, way = [inf] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while True:
            seen[j0] = True
            i0, delta, j1 = match[j0], inf, 0
            for j in range(1, m + 1):
                if not seen[j]:
                    cost = -score[i0 - 1][j - 1] - u[i0] - v[j]
                    if cost < least[j]:
                        least[j], way[j] = cost, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if seen[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def value_similarity(old: dict, new: dict) -> float:
    """Overlap of the value sketches (samples and frequent values), weaker where a sketch has few values."""
    a = set(old.get("sample_values") or []) | set(old.get("top_values") or {})
    b = set(new.get("sample_values") or []) | set(new.get("top_values") or {})
    if not a or not b:
        return 0.0
    return len(a & b) / len(a | b) * min(1.0, min(len(a), len(b)) / 4)


def shape_similarity(old: dict, new: dict) -> float:
    """Same inferred type, and overlap of the pattern signatures' shares."""
    p, q = old.get("pattern_signatures") or {}, new.get("pattern_signatures") or {}
    shared = sum(min(p[k] or 0, q[k] or 0) for k in p.keys() & q.keys())
    return 0.5 * (old.get("inferred_type") == new.get("inferred_type")) + 0.5 * min(1.0, shared)


def column_score(old: dict, new: dict, fields: dict[str, str]) -> float:
    """Evidence that two headers name one column. The same target field, or the same words, count as the same name."""
    a, b = name_key(old["name"]), name_key(new["name"])
    known = fields.get(a), fields.get(b)
    if a and a == b or known[0] and known[0] == known[1]:
        name = 1.0
    elif known[0] and known[1]:
        name = 0.0
    else:
        name = name_similarity(old["name"], new["name"])
    return VALUE_WEIGHT * value_similarity(old, new) + NAME_WEIGHT * name + SHAPE_WEIGHT * shape_similarity(old, new)


def _columns(columns_json: str | None, profile_json: str | None) -> list[dict]:
    """The headers in file order, each with its profile; text that is no JSON list gives no columns or no profiles."""
    def load(text: str | None) -> list:
        try:
            x = json.loads(text or "[]")
        except ValueError:
            return []
        return x if isinstance(x, list) else []

    profiles = {p.get("position"): p for p in load(profile_json) if isinstance(p, dict)}
    return [{**profiles.get(k, {}), "name": str(h), "position": k} for k, h in enumerate(load(columns_json))]


def match_columns(old: list[dict], new: list[dict], fields: dict[str, str]) -> list[int]:
    """Index into ``old`` of each new column, or -1: equal headers in order first, then the best assignment of the rest."""
    places: dict[str, list[int]] = {}
    for i, c in enumerate(old):
        places.setdefault(c["name"], []).append(i)
    out = [places[c["name"]].pop(0) if places.get(c["name"]) else -1 for c in new]
    left = sorted(i for rest in places.values() for i in rest)
    free = [j for j, i in enumerate(out) if i < 0]
    if left and free:
        # Below the least score a pair counts nothing, so that it cannot displace a sound one.
        score = [[s if (s := column_score(old[i], new[j], fields)) >= MIN_SCORE else 0.0 for j in free] for i in left]
        for k, j in enumerate(assign(score)):
            if j >= 0 and score[k][j] > 0:
                out[free[j]] = left[k]
    return out


def column_changes(old: list[dict], new: list[dict], matched: list[int]) -> list[tuple[str, str]]:
    """(kind, header) of every change; of a removed column the old header. Column order is no change."""
    found = []
    for c, i in zip(new, matched):
        if i < 0:
            found.append(("added", c["name"]))
            continue
        p = old[i]
        if p["name"] != c["name"]:
            found.append(("renamed", c["name"]))
        a, b = p.get("inferred_type"), c.get("inferred_type")
        if a != b and a and b and "empty" not in (a, b):
            found.append(("type_changed", c["name"]))
        elif a == b == "date" and p.get("date_format") and c.get("date_format") and p["date_format"] != c["date_format"]:
            found.append(("format_changed", c["name"]))
    used = set(matched)
    return found + [("removed", c["name"]) for i, c in enumerate(old) if i not in used]


def field_keys(specs: DataFrame) -> dict[str, dict[str, str]]:
    """For each schema the target field of every field name and alias; keys that stand for two fields are left out."""
    rows = specs.select("schema_name", "field_name", "aliases").limit(MAX_SPEC_ROWS + 1).collect()
    if len(rows) > MAX_SPEC_ROWS:
        raise ValueError(f"more than {MAX_SPEC_ROWS} target fields")
    found: dict[str, dict[str, set[str]]] = {}
    for r in rows:
        for name in [r.field_name, *(r.aliases or [])]:
            if name and r.field_name:
                found.setdefault(r.schema_name, {}).setdefault(name_key(name), set()).add(r.field_name)
    return {s: {k: min(v) for k, v in names.items() if len(v) == 1} for s, names in found.items()}


STEP = "source_object_id long, prev_object_id long, ingested_at timestamp_ntz, changes array<struct<kind:string,source_column:string>>, columns array<struct<name:string,inferred_type:string,old:int>>"


def version_steps(objects: DataFrame, feeds: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per object that is no re-send: its columns, the matched column of the object before, and the changes.

    The first object of a feed has no changes and ``old`` -1 throughout. Malformed JSON counts as no columns.
    """
    chain = with_previous(distinct_deliveries(objects))
    text = objects.select("source_object_id", "columns_json", "profile_json").filter("source_object_id IS NOT NULL").groupBy("source_object_id").agg(F.max(F.struct("columns_json", "profile_json")).alias("r")).select("source_object_id", "r.*")
    schema = feeds.filter("feed_id IS NOT NULL").groupBy("feed_id").agg(F.max("schema_name").alias("schema_name"))
    old = text.select(F.col("source_object_id").alias("prev_object_id"), F.col("columns_json").alias("old_columns"), F.col("profile_json").alias("old_profile"))
    rows = chain.join(text, "source_object_id").join(old, "prev_object_id", "left").join(schema, "feed_id", "left")
    known = specs.sparkSession.sparkContext.broadcast(field_keys(specs))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = pa.list_(pa.struct([("kind", pa.string()), ("source_column", pa.string())]))
        column = pa.list_(pa.struct([("name", pa.string()), ("inferred_type", pa.string()), ("old", pa.int32())]))
        for b in batches:
            changes, columns = [], []
            for cj, pj, prev, oc, op, s in zip(*(b.column(k).to_pylist() for k in ("columns_json", "profile_json", "prev_object_id", "old_columns", "old_profile", "schema_name"))):
                new = _columns(cj, pj)
                before = _columns(oc, op) if prev is not None else []
                matched = match_columns(before, new, known.value.get(s, {}))
                changes.append([{"kind": k, "source_column": h} for k, h in column_changes(before, new, matched)] if prev is not None else [])
                columns.append([{"name": c["name"], "inferred_type": c.get("inferred_type"), "old": i} for c, i in zip(new, matched)])
            yield pa.RecordBatch.from_arrays(
                [b.column("source_object_id"), b.column("prev_object_id"), b.column("ingested_at"), pa.array(changes, change), pa.array(columns, column)],
                names=["source_object_id", "prev_object_id", "ingested_at", "changes", "columns"],
            )

    return rows.select("source_object_id", "prev_object_id", F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at"), "columns_json", "profile_json", "old_columns", "old_profile", "schema_name").mapInArrow(step, STEP)


def drift_changes(objects: DataFrame, feeds: DataFrame, specs: DataFrame, since: str = "2026-07-01") -> DataFrame:
    """(source_object_id, kind, source_column) of every change, for objects ingested from ``since`` on."""
    steps = version_steps(objects, feeds, specs).filter(F.col("ingested_at") >= F.lit(since).cast("timestamp_ntz"))
    return steps.select("source_object_id", F.explode("changes").alias("c")).select("source_object_id", "c.kind", "c.source_column")


def unified_columns(objects: DataFrame, feeds: DataFrame, specs: DataFrame) -> DataFrame:
    """Every column of every object with the unified column it belongs to.

    A unified column is a chain of matched columns; it is named by the first object and header of the chain. Roots are found
    by pointer doubling (as many rounds as the logarithm of the longest chain), with the lineage cut in between.
    """
    steps = version_steps(objects, feeds, specs)
    cols = steps.select("source_object_id", "prev_object_id", F.posexplode("columns").alias("position", "c"))
    links = cols.select("source_object_id", "position", F.col("c.name").alias("source_column"), F.col("c.inferred_type").alias("inferred_type"), F.when(F.col("c.old") >= 0, F.col("prev_object_id")).alias("up_object"), F.when(F.col("c.old") >= 0, F.col("c.old")).alias("up_position"))
    links = cut(links)
    state = links.select("source_object_id", "position", F.coalesce("up_object", "source_object_id").alias("root_object"), F.coalesce("up_position", "position").alias("root_position"))
    while True:
        up = state.select(F.col("source_object_id").alias("root_object"), F.col("position").alias("root_position"), F.col("root_object").alias("next_object"), F.col("root_position").alias("next_position"))
        moved = state.join(up, ["root_object", "root_position"]).select("source_object_id", "position", F.col("next_object").alias("root_object"), F.col("next_position").alias("root_position"), (F.col("next_object") != F.col("root_object")).alias("moved"))
        moved = cut(moved)
        state = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    root = links.select(F.col("source_object_id").alias("root_object"), F.col("position").alias("root_position"), F.col("source_column").alias("root_column"))
    return links.join(state, ["source_object_id", "position"]).join(root, ["root_object", "root_position"]).select("source_object_id", "position", "source_column", "inferred_type", "root_object", "root_position", "root_column")


def unified_rows(records: DataFrame, columns: DataFrame) -> DataFrame:
    """The good records as one consistent table: raw_id, source_object_id and a map from unified column to cell.

    ``records`` are those of `operators.records.read_records`. The key of a unified column is its first object and header.
    """
    key = F.concat_ws(":", F.col("root_object").cast("string"), F.col("root_position").cast("string"), F.col("root_column"))
    names = columns.groupBy("source_object_id").agg(F.array_sort(F.collect_list(F.struct("position", key.alias("k")))).alias("names"))
    good = records.filter("reason IS NULL")
    return good.join(names, "source_object_id").select("raw_id", "source_object_id", F.map_from_arrays(F.transform("names", lambda n: n["k"]), "cells").alias("cells"))
