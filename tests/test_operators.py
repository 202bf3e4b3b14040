"""Values, names, drift matching, profiles, upserts and logs on hand-made cases."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from intakeforge.functions import cells as C
from intakeforge.functions import names as N
from intakeforge.functions import values as V
from intakeforge.operators import audit, materialize, quality, resolving, schema_drift, versions
from intakeforge.sources import staging


def column(spark, values, expr):  # noqa: ANN001, ANN201
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_cell_numbers(spark) -> None:  # noqa: ANN001
    cases = {"12": 12, "1,234.50": 1234.5, "-3": -3, "(12.00)": -12, "$1,250.50": 1250.5, "USD 5.49": 5.49, "5 EUR": 5, "-€2": -2, "13%": 13, "7.5 %": 7.5}
    cases |= dict.fromkeys(["1,23", "12,5x", "3..1", "1.234,50", "(12.00", "$$1", "USD  5", "", "1e3", ".5"])
    assert column(spark, list(cases), V.cell_number) == list(cases.values())


def test_cells_agree_with_columns(spark) -> None:  # noqa: ANN001
    values = ["1", "-1,000", "1,00", "$5", "(€5)", "5%", "5.5 %", "yes", "N", "2026-02-28", "2026-02-30", "31.12.2026", "29/02/2024", "02/29/2023", "5-Feb-2026", "05-XYZ-2026", "0000-00-00", "x", "", "1.5"]
    for kind, token in [("int", None), ("float", None), ("currency", None), ("percent", None), ("bool", None), ("date", "ymd-"), ("date", "dmy/"), ("date", "dmy."), ("date", "dmy-mon"), ("date", "mdy/")]:
        assert column(spark, values, lambda c: F.coalesce(V.fits_type(c, kind, token), F.lit(False))) == [C.fits(v, kind, token or "") for v in values], (kind, token)


def test_any_date_equals_every_layout(spark) -> None:  # noqa: ANN001
    rnd = random.Random(1)
    values = [f"{a}{s}{b}{s}{c}" for s in "-/." for a, b, c in itertools.product(["2026", "1", "31", "13"], ["2", "12", "13", "Feb"], ["2024", "29", "31", "7"])] + ["", "x"]
    rnd.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = V.with_is_date(V.with_is_date(df, "v", "narrow", F.lit(True)), "v", "wide", wide=True).select("v", "narrow", "wide", V.cell_date(F.col("v")).isNotNull().alias("n"), V.parse_date(F.col("v")).isNotNull().alias("w"))
    assert got.filter("NOT (narrow <=> n) OR NOT (wide <=> w)").count() == 0


def test_null_like_and_masks(spark) -> None:  # noqa: ANN001
    assert column(spark, [None, " N/A ", "--", "x", " ", "nil"], V.is_null_like) == [True, True, True, False, True, True]
    assert column(spark, [None, "PO-123", "a@b", "Größe 12"], quality.mask) == [None, "A+-9+", "a@a", "Aa+ 9+"]


@pytest.mark.parametrize(
    ("header", "words", "hints"),
    [
        ("Unit Price (USD)", ["unit", "price"], ["usd"]),
        ("InvoiceNo", ["invoice", "no"], []),
        ("Amount (net)", ["amount", "net"], []),
        ("Weight [kg]", ["weight"], ["kg"]),
        ("tax %", ["tax"], ["percent"]),
        ("Total(€)", ["total"], ["eur"]),
        ("PO#", ["po", "number"], []),
        ("price usd eur", ["price"], ["usd", "eur"]),
        ("USD", ["usd"], []),
        ("Ort/Straße é", ["ort", "stra", "e", "e"], []),
        (None, [], []),
    ],
)
def test_names(header: str, words: list[str], hints: list[str]) -> None:
    got = N.normalize_name(header)
    assert got[0] == words and sorted(got[1]) == sorted(hints)


def test_short_forms_are_written_out() -> None:
    assert N.expand(["po", "no"]) == ["purchase", "order", "number"] and N.expand(["date", "of", "po"], {"po": ["post"]}) == ["date", "post"]
    assert N.expand([]) == N.expand(["the"]) == []


def test_headers_are_unique(spark) -> None:  # noqa: ANN001
    raw = [["id", "", "ID", "_sheet"], ["a", "a", "a_2", "A", " a  b "], [], ["", None, "column_1"]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, h array<string>")
    got = [r.o for r in df.select("i", staging.unique_headers(F.col("h")).alias("o")).orderBy("i").collect()]
    assert got == [["id", "column_2", "ID_2", "_sheet_2"], ["a", "a_2", "a_2_2", "A_3", "a b"], [], ["column_1", "column_2", "column_1_2"]]


@pytest.mark.parametrize("seed", range(40))
def test_assignment_is_best(seed: int) -> None:
    rnd = random.Random(seed)
    n, m = rnd.randint(1, 4), rnd.randint(1, 5)
    score = [[rnd.randint(0, 9) for _ in range(m)] for _ in range(n)]
    got = schema_drift.assign(score)
    k = min(n, m)
    best = max(sum(score[i][j] for i, j in zip(p, q)) for p in itertools.permutations(range(n), k) for q in itertools.permutations(range(m), k))
    assert sum(score[i][j] for i, j in enumerate(got) if j >= 0) == best
    assert len({j for j in got if j >= 0}) == k


def test_column_matching() -> None:
    col = lambda name, kind="string", samples=("a", "b", "c", "d"), fmt=None: {"name": name, "inferred_type": kind, "sample_values": list(samples), "date_format": fmt}
    old = [col("Qty", "int", "1234"), col("Sku"), col("Due", "date", "5678", "mdy/"), col("x"), col("x")]
    new = [col("sku"), col("Due", "date", "5678", "ymd-"), col("Billed", "float", "1234"), col("Memo", samples="wxyz"), col("x")]
    got = schema_drift.column_changes(old, new, schema_drift.match_columns(old, new, {"qty": "quantity", "billed": "quantity"}))
    assert sorted(got) == sorted([("renamed", "sku"), ("format_changed", "Due"), ("renamed", "Billed"), ("type_changed", "Billed"), ("added", "Memo"), ("removed", "x")])
    assert schema_drift.match_columns([], new, {}) == [-1] * 5 and schema_drift.column_changes(old, [], []) == [("removed", c["name"]) for c in old]


def test_versions_skip_resends(spark) -> None:  # noqa: ANN001
    o = spark.createDataFrame([(1, 1, "2026-01-01 10:00:00", "a", ""), (2, 1, "2026-01-01 12:00:00", "b", ""), (3, 1, "2026-01-05 00:00:00", "a", ""), (4, 1, "2026-02-01 00:00:00", "c", ""), (5, 2, "2026-01-02 00:00:00", None, ""), (6, 2, "2026-01-03 00:00:00", None, ""), (7, None, "2026-01-03 00:00:00", "z", "")], "source_object_id long, feed_id long, t string, content_hash string, sheet_name string").withColumn("ingested_at", F.col("t").cast("timestamp_ntz"))
    got = rows(versions.with_previous(versions.distinct_deliveries(o)).select("source_object_id", "prev_object_id"))
    assert got == sorted([(1, None), (2, 1), (4, 2), (5, None), (6, 5)], key=repr)


def test_quantile_edges_equal_sorted_positions(spark) -> None:  # noqa: ANN001
    rnd = random.Random(5)
    values = [round(rnd.gauss(0, 50), 1) for _ in range(487)] + [3.0] * 100
    df = spark.createDataFrame([("g", v) for v in values], "g string, number double").groupBy("g", "number").agg(F.count(F.lit(1)).alias("n"))
    s = sorted(values)
    want = sorted({s[min(len(s) - 1, round(i * len(s) / 10))] for i in range(1, 10)})
    assert quality.quantile_edges(df, ["g"]).first().edges == want


def test_upsert_overwrites_with_null(spark) -> None:  # noqa: ANN001
    t = spark.createDataFrame([(1, "a", "keep"), (2, "b", "keep")], "k int, v string, ext_old string")
    s = spark.createDataFrame([(2, None, "new"), (3, "c", "new")], "k int, v string, ext_new string")
    assert rows(materialize.upsert(t, s, ["k"]).select("k", "v", "ext_old", "ext_new")) == [(1, "a", "keep", None), (2, None, "keep", "new"), (3, "c", None, "new")]
    once = materialize.upsert(t, s, ["k"])
    assert rows(materialize.upsert(once, s, ["k"]).select("k", "v")) == rows(once.select("k", "v"))
    with pytest.raises(ValueError):
        materialize.latest_per_key(t, [], [])


def test_greedy_assignment_equals_sequential(spark) -> None:  # noqa: ANN001
    rnd = random.Random(2)
    data = [("g", f"c{i}", f"f{j}", rnd.randint(0, 5) / 5) for i in range(7) for j in range(6)]
    want, used = set(), set()
    for s, c, f in sorted(((-s, c, f) for _, c, f, s in data)):
        if c not in used and f not in used:
            used |= {c, f}
            want.add((c, f, -s))
    df = spark.createDataFrame(data, "g string, c string, f string, s double")
    assert {(r.c, r.f, r.s) for r in resolving.greedy_assignment(df, ["g"], "c", "f", "s").collect()} == want


def test_chain_finds_tampering_and_removal(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(i, "f", f"p{i}", None) for i in range(6)], "id long, feed string, a string, b string")
    c = audit.chain(df, "id", ["a", "b"], "feed")
    assert audit.broken_entries(c, "id", ["a", "b"], "feed").count() == 0
    forged = c.withColumn("a", F.when(F.col("id") == 3, "x").otherwise(F.col("a")))
    assert rows(audit.broken_entries(forged, "id", ["a", "b"], "feed").select("id", "reason")) == [(3, "payload")]
    hashed = forged.withColumn("payload", audit.payload_hash(["a", "b"])).withColumn("hash", audit.link_hash(F.col("previous"), F.col("payload")))
    assert rows(audit.broken_entries(hashed, "id", ["a", "b"], "feed").select("id", "reason")) == [(4, "previous")]
    assert rows(audit.broken_entries(c.filter("id <> 2"), "id", ["a", "b"], "feed").select("id", "reason")) == [(3, "previous")]


def test_cut_tables_can_be_released(spark) -> None:  # noqa: ANN001
    import os

    from intakeforge import session

    session.release(spark)
    df = session.cut(spark.range(3).withColumnRenamed("id", "x"))
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert rows(df) == [(0,), (1,), (2,)] and os.path.isdir(path)
    assert session.release(spark) == 1 and not os.path.exists(path) and session.release(spark) == 0
