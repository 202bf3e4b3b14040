"""The header query against plain Python on records with quoted delimiters."""

from __future__ import annotations

import random
from collections import Counter

from intakeforge.plans.reference import registry


def scores(grid: list[list[str]], scan: int = 20, ahead: int = 15) -> int:
    """The best row, from the definition of the score; cells are words or digits here."""
    grid = [[c.strip() for c in r] for r in grid[: scan + ahead]]
    width, best = max(map(len, grid)), None
    for i, r in enumerate(grid[:scan]):
        full = [c for c in r if c]
        if not full:
            continue
        kinds: dict[int, Counter] = {}
        for below in grid[i + 1 : i + 1 + ahead]:
            for j, c in enumerate(below):
                if c:
                    kinds.setdefault(j, Counter())["number" if c.isdigit() else "string"] += 1
        consistency = sum(max(k.values()) / sum(k.values()) for k in kinds.values()) / len(kinds) if kinds else 0.0
        fill = len(full) / width
        score = 1.5 * sum(not c.isdigit() for c in full) / len(full) + len({c.lower() for c in full}) / len(full) + 2 * fill + 1.5 * consistency * len(kinds) / width - (0.6 if fill < 0.5 else 0)
        if best is None or round(score, 4) > best[0]:
            best = (round(score, 4), i)
    return best[1]


def test_quoted_delimiters_are_no_borders(spark, tmp_path) -> None:  # noqa: ANN001
    rnd = random.Random(11)
    raw, want, plain = [], {}, {}
    for f in range(30):
        d = rnd.choice([",", ";", "|"])
        grid = [[f"report{d} of {d} the{d} year{d} so far"]] if f % 2 else []
        grid.append(["id", "name", "qty", "note"])
        grid += [[str(10 * i), f"n{i}", str(i), rnd.choice(["", f"a{d}b", f"x{d}{d} y{d}z", "7", 'say "hi"'])] for i in range(rnd.randint(3, 12))]
        lines = [d.join('"' + c.replace('"', '""') + '"' if d in c or '"' in c else c for c in r) for r in grid]
        raw += [(f, i, t) for i, t in enumerate(lines)]
        want[f], plain[f] = scores(grid), scores([[c.strip('"') for c in t.split(d)] for t in lines])
        spark.createDataFrame([(f, d)], "source_object_id long, delimiter string").write.mode("append").parquet(str(tmp_path / "source_object.parquet"))
    spark.createDataFrame([*raw, (0, 99, None)], "source_object_id long, row_idx int, raw_text string").write.parquet(str(tmp_path / "raw_records.parquet"))
    got = {r.source_object_id: r.header_row for r in registry.queries["s_header_score"](spark, str(tmp_path)).collect()}
    assert want != plain
    assert got == want
