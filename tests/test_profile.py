"""Column profiles of loads against plain Python over the same cells."""

from __future__ import annotations

from collections import Counter
from datetime import date

import pytest

from helpers import DATA
from intakeforge.operators import quality
from intakeforge.plans.intake import registry


@pytest.fixture(scope="module")
def profile(spark):  # noqa: ANN001, ANN201
    return registry.queries["p5_profile"](spark, DATA).collect()


def test_profile_of_every_column_equals_counting(spark, profile) -> None:  # noqa: ANN001
    nulls = {"", "na", "n/a", "null", "none", "nan", "-", "--", "#n/a", "nil"}
    cells: dict = {}
    for r in spark.read.parquet(f"{DATA}/invoices_2026_08.parquet").collect():
        for c in quality.TEXT_COLUMNS:
            v = (r[c] or "").strip()
            cells.setdefault((r.source_object_id, c), Counter())[None if v.lower() in nulls else v] += 1
    got = {(r.source_object_id, r.source_column): r for r in profile if r.origin == "invoices"}
    assert set(got) == set(cells)
    shares = {(r.source_object_id, r.source_column, r.value): r.share for r in registry.queries["p5_value_shares"](spark, DATA).filter("origin = 'invoices'").collect()}
    want = {}
    for k, counts in cells.items():
        r, there = got[k], {v: n for v, n in counts.items() if v is not None}
        n = sum(there.values())
        assert (r.n_rows, r.n_present, r.n_distinct) == (sum(counts.values()), n, len(there)), k
        want |= {(*k, v): m / n for v, m in there.items()}
        first = dict(sorted(there.items(), key=lambda x: (-x[1], x[0]))[:10])
        assert (r.top_values or {}) == pytest.approx({v: m / n for v, m in first.items()}), k
        if k[1] == "tax_pct" and n:
            numbers = [float(v.rstrip("% ")) for v in there if v.rstrip("% ").replace(".", "", 1).isdigit()]
            assert (r.low, r.high) == (min(numbers), max(numbers)) and r.parse_rates["number"] > 0.5
        if k[1] == "invoice_date" and r.parse_rates and r.parse_rates["date"]:
            assert date(2020, 1, 1) < r.first_day <= r.last_day < date(2030, 1, 1)
    assert shares == pytest.approx(want)


def test_stored_profiles_come_out_once(spark, profile) -> None:  # noqa: ANN001
    stored = spark.read.parquet(f"{DATA}/column_profile.parquet").collect()
    first: dict = {}
    for p in sorted(stored, key=lambda p: p.profile_id):
        first.setdefault((p.source_object_id, p.col_name), (p.null_rate, p.distinct_count, p.row_count, p.parse_rates, p.top_values))
    assert {(r.source_object_id, r.source_column): (r.null_rate, r.n_distinct, r.n_rows, r.parse_rates, r.top_values) for r in profile if r.origin == "stored"} == first
    assert sum(r.origin == "stored" for r in profile) == len(first)


def test_days_with_slashes_are_read_in_one_order(spark) -> None:  # noqa: ANN001
    blank = dict.fromkeys(quality.TEXT_COLUMNS)
    rows = [blank | {"source_object_id": k, "due_date": v} for k, v in ((1, "03/02/2026"), (1, "25/02/2026"), (2, "03/02/2026"), (2, "2026-03-05"), (None, "7-Feb-2026"))]
    df = spark.createDataFrame(rows, "source_object_id long, " + ", ".join(f"{c} string" for c in quality.TEXT_COLUMNS))
    none = spark.read.parquet(f"{DATA}/column_profile.parquet").limit(0)
    got = {r.source_object_id: (r.first_day, r.last_day, r.n_distinct) for r in quality.full_profile(quality.all_values(df), none).filter("source_column = 'due_date'").collect()}
    assert got == {1: (date(2026, 2, 3), date(2026, 2, 25), 2), 2: (date(2026, 3, 2), date(2026, 3, 5), 2), None: (date(2026, 2, 7), date(2026, 2, 7), 1)}
