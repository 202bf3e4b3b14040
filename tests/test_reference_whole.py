"""Queries that finish what `r_heuristic_scores` leaves out."""

from __future__ import annotations

import duckdb

from helpers import DATA
from intakeforge.functions import names as N
from intakeforge.plans.reference import registry


def test_labels_and_greedy_assignment(spark) -> None:  # noqa: ANN001
    q = lambda s: duckdb.sql(s).fetchall()
    fields = q(f"SELECT schema_name, field_name, aliases FROM '{DATA}/field_spec.parquet'")
    heads = q(f"SELECT DISTINCT feed_id, schema_name, source_column FROM '{DATA}/mapping_proposal.parquet' JOIN '{DATA}/source_feed.parquet' USING (feed_id) WHERE source_column IS NOT NULL")

    def grams(words: list[str]) -> set[str]:
        text = f"  {' '.join(words)} "
        return {text[i : i + 3] for i in range(len(text) - 2)}

    def score(a: str, b: str) -> float:
        x, y = N.normalize_name(a)[0], N.normalize_name(b)[0]
        share = lambda p, q: len(p & q) / len(p | q)
        return 0.6 * share(grams(x), grams(y)) + 0.4 * share(set(x), set(y)) if x and y else 0.0

    want = {}
    for s, h in {(s, h) for _, s, h in heads}:
        for t, f, aliases in fields:
            if s == t and (best := max(score(h, x) for x in [f, *(aliases or [])] if x is not None)) > 0:
                want[s, h, f] = max(best, want.get((s, h, f), 0))
    got = {(r.schema_name, r.source_column, r.field_name): r.score for r in registry.queries["r_label_scores"](spark, DATA).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    taken, pairs = set(), set()
    for _, feed, h, f in sorted((-round(got[s, h, f], 12), feed, h, f) for feed, t, h in heads for (s, g, f) in got if (s, g) == (t, h) and got[s, h, f] >= 0.35):
        if (feed, "h", h) not in taken and (feed, "f", f) not in taken:
            taken |= {(feed, "h", h), (feed, "f", f)}
            pairs.add((feed, h, f))
    rows = registry.queries["r_greedy_assignment"](spark, DATA).collect()
    assert {(r.feed_id, r.source_column, r.field_name) for r in rows} == pairs and len(rows) == len(pairs)
