"""The resolver chain against a plain sequential one, drift events, and loads into a table."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import DATA, rows
from intakeforge.functions import names as N
from intakeforge.operators import chain, drift_events, loading
from intakeforge.operators.casting import ColumnPlan
from intakeforge.plans import reference


def share(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def status(rate: float) -> str:
    return "ok" if rate >= 0.9 else "downgrade" if rate >= 0.5 else "veto"


def rate_of(p, f) -> float:  # noqa: ANN001
    if not p.row_count or not p.parse_rates:
        return 1.0
    rates = [1.0]
    if f.field_type != "string":
        rates.append(p.parse_rates.get(f.field_type, 0.0))
    values = list(p.top_values) if p.top_values else list(p.sample_values or [])
    if f.allowed_values:
        ok = [v for v in values if v.lower() in {a.lower() for a in f.allowed_values}]
        rates.append(1.0 if not values else sum(p.top_values[v] for v in ok) if p.top_values else len(ok) / len(values))
    if f.value_pattern:
        rates.append(sum(bool(re.fullmatch(f.value_pattern, v)) for v in values) / len(values) if values else 1.0)
    return min(rates)


def plain_chain(profiles: list, fields: list) -> dict[str, tuple]:
    """header -> (field, tier, confidence, holder), tier by tier and column by column."""
    units = set(chain.UNIT_WORDS)
    words = {p.col_name: N.normalize_name(p.col_name) for p in profiles}
    labels = [(f, lab, k == 0) for f in fields for k, lab in enumerate([f.field_name, *(f.aliases or [])])]
    taken: dict[str, list] = {}

    def offer(p, f, tier: str, confidence: float) -> None:  # noqa: ANN001
        s = status(rate_of(p, f))
        if p.col_name not in taken and s != "veto":
            taken[p.col_name] = [f.field_name, tier, confidence if s == "ok" else round(confidence - 0.15, 4)]

    for tier, confidence, is_name in (("exact", 0.95, True), ("dictionary", 0.9, False)):
        for p in profiles:
            own = words[p.col_name][0]
            named = sorted((f.field_name, f) for f, lab, first in labels if first and N.normalize_name(lab)[0] == own and own)
            hits = sorted({(f.field_name, id(f)): f for f, lab, first in labels if N.normalize_name(lab)[0] == own and own and not first}.values(), key=lambda f: f.field_name)
            if is_name and named:
                offer(p, named[0][1], tier, confidence)
            elif not is_name and hits and not named:
                offer(p, hits[0], tier, confidence)
    for p in profiles:
        full, hints = N.expand(words[p.col_name][0]), words[p.col_name][1]
        own = set(full) | (set(hints) & units)
        best: dict[str, float] = defaultdict(float)
        by_name = {f.field_name: f for f in fields}
        for f, lab, _ in labels:
            other = set(N.expand(N.normalize_name(lab)[0])) | ({f.unit.lower()} & units if f.unit else set())
            best[f.field_name] = max(best[f.field_name], share(own, other), 0.95 * share(own - units, other - units))
        ranked = sorted(((s, f) for f, s in best.items()), reverse=True)
        if own and ranked[0][0] >= 0.75 and (len(ranked) == 1 or ranked[1][0] < ranked[0][0]):
            offer(p, by_name[ranked[0][1]], "synonym", 0.85)
    held: dict[str, list] = defaultdict(list)
    for h, (f, tier, c) in taken.items():
        held[f].append((-c, ["exact", "dictionary", "synonym"].index(tier), h))
    return {h: (f, tier, c, min(held[f])[2]) for h, (f, tier, c) in taken.items()}


def test_sure_tiers_equal_the_plain_chain(spark) -> None:  # noqa: ANN001
    columns = reference._resolver_columns(spark, DATA)
    got = defaultdict(dict)
    for r in chain.resolve(columns, spark.read.parquet(f"{DATA}/field_spec.parquet"), model=False).collect():
        got[r.source_object_id][r.col_name] = r
    specs = defaultdict(list)
    for f in spark.read.parquet(f"{DATA}/field_spec.parquet").collect():
        specs[f.schema_name].append(f)
    per = defaultdict(dict)
    for p in sorted(columns.collect(), key=lambda p: -p.col_position):
        per[p.source_object_id, p.schema_name][p.col_name] = p
    assert per
    for (i, schema), profiles in per.items():
        want = plain_chain(list(profiles.values()), specs[schema])
        for h in profiles:
            r, w = got[i][h], want.get(h)
            if w is None:
                assert (r.target_field, r.tier) == (None, "unresolved") and r.extension_column.startswith("ext_"), h
            else:
                assert (r.tier, round(r.confidence, 4), r.target_field, r.lost_to) == (w[1], round(w[2], 4), w[0] if w[3] == h else None, None if w[3] == h else w[3]), h


SPEC = "schema_name string, field_name string, field_type string, unit string, aliases array<string>, allowed_values array<string>, value_pattern string"
COL = "source_object_id long, schema_name string, col_name string, col_position int, inferred_type string, row_count long, parse_rates map<string,double>, top_values map<string,double>, sample_values array<string>"


def test_vetoes_conflicts_and_extension_names(spark) -> None:  # noqa: ANN001
    fields = spark.createDataFrame([("s", "amount", "number", "usd", ["total amount"], None, None), ("s", "currency", "string", None, ["ccy"], ["USD", "EUR"], None), ("s", "po_number", "string", None, [], None, "PO-[0-9]+"), ("s", "item_description", "string", None, None, None, None)], SPEC)
    number = {"integer": 0.0, "number": 1.0, "date": 0.0, "boolean": 0.0}
    half = number | {"number": 0.6}
    text = {"integer": 0.0, "number": 0.0, "date": 0.0, "boolean": 0.0}
    cols = [
        (1, "s", "Amount", 0, "float", 10, half, {}, ["1"]),
        (1, "s", "Amt ($)", 1, "float", 10, number, {}, ["1"]),
        (1, "s", "CCY", 2, "string", 10, text, {"usd": 0.2, "xxx": 0.8}, []),
        (1, "s", "PO no", 3, "string", 10, text, {}, ["PO-1", "PO-2"]),
        (1, "s", "Note", 4, "string", 10, text, {}, ["x"]),
        (1, "s", "note", 5, "string", 10, text, None, None),
        (1, "s", "Item Descr.", 6, "string", 10, text, {}, ["x"]),
        (2, "unknown", "Amount", 0, "float", 10, number, {}, []),
        (None, "s", "Amount", 0, "float", 10, number, {}, []),
    ]
    got = {(r.source_object_id, r.col_name): r for r in chain.resolve(spark.createDataFrame(cols + cols[:1], COL), fields).collect()}
    short = lambda i, h: (got[i, h].target_field, got[i, h].tier, got[i, h].confidence, got[i, h].extension_column, got[i, h].lost_to)
    assert short(1, "Amt ($)") == ("amount", "synonym", 0.85, None, None)
    assert short(1, "Amount") == (None, "exact", 0.8, "ext_amount", "Amt ($)")
    assert got[1, "CCY"].vetoes[:1] == ["dictionary"] and got[1, "CCY"].target_field is None
    assert short(1, "PO no")[:3] == ("po_number", "synonym", 0.85) and short(1, "Item Descr.")[:2] == ("item_description", "synonym")
    assert [got[1, h].extension_column for h in ("Note", "note")] == ["ext_note", "ext_note_2"]
    assert short(2, "Amount") == (None, "unresolved", 0.0, "ext_amount", None) and len(got) == 8
    assert chain.resolve(spark.createDataFrame([], COL), fields).count() == 0


def profile(name: str, at: int, kind: str = "string", **more: object) -> dict:
    return {"name": name, "position": at, "inferred_type": kind, "date_format": None, "null_rate": 0.0, "distinct_count": 3, "sample_values": ["a", "b", "c"], "pattern_signatures": {"a": 1.0}, "top_values": {"a": 0.5, "b": 0.5}} | more


def test_drift_events(spark) -> None:  # noqa: ANN001
    import json

    old = [profile("Qty", 0, "int"), profile("Due", 1, "date", date_format="mdy/"), profile("Old Name", 2), profile("gone", 3, pattern_signatures={"9": 1.0}, sample_values=["1"], top_values={}), profile("kind", 4), profile("free", 5, "int")]
    new = [profile("Qty", 0, "string"), profile("Due", 1, "date", date_format="dmy/", null_rate=0.5), profile("Old-Name", 2), profile("fresh", 3, "date", sample_values=["z"], top_values={}), profile("kind", 4, top_values={"a": 0.99, "b": 0.01}), profile("free", 5, "string")]
    objects = spark.createDataFrame([(1, 100, json.dumps(old)), (2, 100, json.dumps(new)), (3, 100, "no json"), (None, 1, json.dumps(new))], "source_object_id long, row_count long, profile_json string")
    before = spark.createDataFrame([(1, 7, None), (2, 7, 1), (3, 7, 2)], "source_object_id long, feed_id long, prev_object_id long")
    mapping = spark.createDataFrame([(7, "s", "Qty", "quantity"), (7, "s", "Due", "due"), (7, "s", "Old Name", "name")], "feed_id long, schema_name string, source_column string, target_field string")
    fields = spark.createDataFrame([("s", "quantity", "integer", None, None, None, None), ("s", "due", "date", None, None, None, None)], SPEC)
    resolved = spark.createDataFrame([], "source_object_id long, col_name string, target_field string")
    events = drift_events.drift_events(drift_events.profiles_of(objects), before, mapping, fields, resolved)
    got = [(r.kind, r.severity, r.source_column) for r in events.orderBy("rank").collect()]
    assert got == [
        ("format_changed", "breaking", "Due"), ("renamed", "breaking", "Old-Name"), ("type_changed", "breaking", "Qty"), ("added", "warning", "fresh"),
        ("distribution_shift", "warning", "kind"), ("null_rate_shift", "warning", "Due"), ("removed", "warning", "gone"), ("type_changed", "warning", "free"),
    ]
    columns = drift_events.profiles_of(objects).select("source_object_id", "col_name")
    kept = drift_events.carried_mapping(events, before, mapping, columns).filter("source_object_id = 2")
    assert [r[:3] for r in rows(kept.select("source_column", "target_field", "tier"))] == [("Due", "due", "carryover"), ("Old-Name", "name", "rename")]


FIELDS = [{"field_name": "id", "field_type": "integer", "is_required": True}, {"field_name": "amount", "field_type": "number", "is_required": True}, {"field_name": "day", "field_type": "date", "is_required": True}]


@pytest.mark.parametrize(
    ("mapping", "key", "breaking", "message"),
    [
        ({"No": "id"}, ["id"], 2, "2 breaking drift events"),
        ({"No": "id", "Gone": "amount"}, ["id"], 0, "mapped columns are not there: Gone"),
        ({"Amt": "amount"}, ["id"], 0, "key columns are not mapped: id"),
        ({"No": "id"}, [], 0, "a table needs a key"),
    ],
)
def test_plans_that_must_not_run(mapping: dict, key: list, breaking: int, message: str) -> None:
    with pytest.raises(loading.PlanError, match=message):
        loading.build_plan(mapping, FIELDS, ["No", "Amt"], key, open_breaking=breaking)


def test_loads_reject_dedupe_upsert_and_swap(spark, tmp_path) -> None:  # noqa: ANN001
    path = str(tmp_path / "t")
    plan = loading.build_plan({"No.": "id", "Amt": "amount", "x": "ext_x", "y": "ext_y"}, FIELDS, ["No.", "Amt", "x"], ["id"])
    assert plan.warnings == ["required field day has no column", "column y of ext_y is not there"]
    first = spark.createDataFrame([("1", "1,000.50", "a", 1), ("1", "$2", "b", 2), ("n/a", "3", "c", 3), (None, "4", "d", 4), ("2", "bad", "e", 5)], "`No.` string, Amt string, x string, at int")
    r = loading.load(first, plan, path, [F.col("at")])
    assert (r.rows_staged, r.rows_written, r.rows_rejected) == (5, 2, 2)
    assert [tuple(x) for x in loading.read_table(spark, path).select("id", F.col("amount").cast("double"), "day", "ext_x", "ext_y").orderBy("id").collect()] == [(1, 2.0, None, "b", None), (2, None, None, "e", None)]
    before = loading.read_table(spark, path)
    second = loading.LoadPlan([ColumnPlan("id", "integer", "k"), ColumnPlan("amount", "number", "a"), ColumnPlan("ext_z", "string", "z")], ["id"])
    rows_ = spark.createDataFrame([("2", "(7)", "new"), ("3", None, None)], "k string, a string, z string")
    assert loading.load(rows_, second, path, [F.lit(1)]).rows_written == 2
    now = loading.read_table(spark, path)
    assert [tuple(x) for x in now.select("id", F.col("amount").cast("double"), "ext_x", "ext_z").orderBy("id").collect()] == [(1, 2.0, "b", None), (2, -7.0, "e", "new"), (3, None, None, None)]
    assert before.count() == 2  # a reader of the version before still finds it
    loading.assert_unique(now, ["id"])
    with pytest.raises(ValueError, match="occurs 2 times"):
        loading.assert_unique(now.unionByName(now), ["id"])
    empty = loading.load(rows_.limit(0), second, path, [F.lit(1)])
    assert (empty.rows_staged, empty.rows_written, empty.rows_rejected) == (0, 0, 0) and loading.read_table(spark, path).count() == 3


def test_staged_tables(spark, tmp_path) -> None:  # noqa: ANN001
    assert loading.raw_table_name("Müller & Co. / Feed 7", 12) == "raw_m_ller_co_feed_7_12"
    df = spark.createDataFrame([("a", None, 1), ("", "b", 2)], "`x.y` string, z string, _row_number int")
    folder = loading.stage_object(df, str(tmp_path), "Feed", 3)
    loading.stage_object(df, str(tmp_path), "Feed", 3)
    assert rows(loading.read_staged(spark, folder)) == [("", "b", "2"), ("a", "", "1")]
    objects = spark.createDataFrame([(1,), (2,), (None,)], "source_object_id long")
    assert rows(loading.unfinished(objects, spark.createDataFrame([(1,), (None,)], "source_object_id long"))) == [(2,), (None,)]


def test_answers_of_a_model_are_only_text(spark) -> None:  # noqa: ANN001
    import json

    answer = {"mappings": [
        {"source_column": "A", "target_field": "amount", "confidence": 0.99, "evidence": ["x"]},
        {"source_column": "A", "target_field": "day", "confidence": 0.9, "evidence": ["x"]},
        {"source_column": "B", "target_field": "day", "confidence": 0.7},
        {"source_column": "C", "target_field": "made_up", "confidence": 0.7, "evidence": ["x"]},
        {"source_column": "D", "target_field": "taken", "confidence": 0.7, "evidence": ["x"]},
        {"source_column": "E", "target_field": None},
        {"source_column": "never asked", "target_field": "amount", "confidence": 0.9},
    ]}
    texts = [(1, f"```json\n{json.dumps(answer)}\n```"), (2, "I cannot do that"), (3, None), (4, '{"mappings": [{"target_field": "day"}]}'), (5, '{"mappings": []}'), (6, '{"mappings": 7}')]
    columns = spark.createDataFrame([(1, "s", c) for c in "ABCDE"], "feed_id long, schema_name string, col_name string")
    fields = spark.createDataFrame([("s", f) for f in ("amount", "day", "taken")], "schema_name string, field_name string")
    held = spark.createDataFrame([(1, "taken")], "feed_id long, field_name string")
    found, rejected = chain.validated_responses(spark.createDataFrame(texts, "feed_id long, text string"), columns, fields, held)
    assert rows(found.select("source_column", "target_field", "confidence")) == [("A", "amount", 0.75), ("B", "day", 0.5), ("C", None, 0.0), ("D", None, 0.0), ("E", None, 0.0)]
    assert rows(rejected) == [(2,), (3,), (4,), (6,)]


def test_schemas_are_checked_as_a_whole(spark, tmp_path) -> None:  # noqa: ANN001
    import json

    from intakeforge.sources import schemas

    good = {"name": "s", "key": ["id"], "fields": [{"name": "id", "type": "integer", "required": True}, {"name": "cur", "aliases": ["ccy"], "allowed": ["EUR"], "pattern": "[A-Z]+"}]}
    (tmp_path / "s.json").write_text(json.dumps(good))
    got = [tuple(r)[:9] for r in schemas.read_schemas(spark, str(tmp_path)).orderBy("field_name").collect()]
    assert got == [("s", "cur", "string", False, None, ["ccy"], ["EUR"], "[A-Z]+", False), ("s", "id", "integer", True, None, [], None, None, True)]
    bad = good | {"key": ["no"], "fields": [{"name": "id", "type": "blob"}, {"name": "id", "pattern": "("}, {"name": ""}]}
    with pytest.raises(schemas.SchemaError) as e:
        schemas.parse_schema(json.dumps(bad))
    assert all(x in str(e.value) for x in ("occurs twice", "unknown type blob", "key field no", "broken pattern", "has no name"))
    for text in ("", "[]", '{"name": "x"}'):
        with pytest.raises(schemas.SchemaError):
            schemas.parse_schema(text)
