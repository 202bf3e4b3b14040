"""Names that meet by chance: dropped where they meet, and nothing else with them."""

from __future__ import annotations

import random
from itertools import combinations, product

import numpy as np
import pyarrow as pa

from intakeforge.llm import name_links


def invented(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bcdfghjklmnprstvwz") + r.choice("aeiou") for _ in range(r.choice((2, 3, 3, 4))))
    return sorted({" ".join(sorted((word(), word()))) for _ in range(n)})


def shuffled(spark) -> int:  # noqa: ANN001
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def varied() -> list[str]:
    r, out = random.Random(7), invented(150, 3)
    for t in list(out[:90]):
        a = list(t)
        i = r.randrange(len(a) - 1)
        a[i], a[i + 1] = a[i + 1], a[i]
        out += ["".join(a), t.replace(" ", ""), t[1:], f"{t} ltda {t[:3]}", " ".join(reversed(t.split(" ")))]
    long = "one two three four five six"
    return sorted({" ".join(t.split()) for t in out} | {long, long + " seven", long[:-1], "& &", "& & &", "ооо ромашка", "ооо ромашки", "北京钢铁有限公司", "北京钢铁有限", "a", "aa"})


def test_what_meets_by_chance_is_not_exchanged(spark) -> None:  # noqa: ANN001
    texts = invented(3000, 1)
    keys = spark.createDataFrame([(t, t.split(" ")) for t in texts], "text string, words array<string>")
    before = shuffled(spark)
    name_links.similar_texts(keys).collect()
    assert 0 < shuffled(spark) - before <= 1.2 * name_links.bands_for() * len(texts)


def test_pairs_are_all_that_share_a_band_and_are_alike(spark) -> None:  # noqa: ANN001
    texts = varied()
    n = name_links.bands_for()
    a, b = name_links._permutations(n * name_links.ROWS)
    words = {t: name_links.words_of(t) for t in texts}
    bands = {t: name_links.signature(words[t], a, b).reshape(n, name_links.ROWS) for t in texts}
    grams = {t: name_links.qgrams(words[t]) for t in texts}
    want = set()
    for x, y in combinations(texts, 2):
        both = len(grams[x] & grams[y])
        if (bands[x] == bands[y]).all(axis=1).any() and both >= name_links.LEAST_OVERLAP * len(grams[x] | grams[y]) and name_links.monge_elkan(words[x], words[y]) >= name_links.MIN_SIMILARITY:
            want.add((x, y))
    keys = spark.createDataFrame([(t, words[t]) for t in texts for _ in "ab"], "text string, words array<string>")
    got = [tuple(sorted(r)) for r in name_links.similar_texts(keys).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 150


def test_the_bound_is_never_below_the_similarity() -> None:
    texts = [t for t in varied() if name_links.letters(t)[0]]
    for x, y in product(texts[::7], texts[::5]):
        a, b = (np.array([name_links.letters(t)], dtype=np.int64) for t in (x, y))
        assert name_links.most_alike(a, b, a[0, 0], b[0, 0])[0] >= name_links.monge_elkan(name_links.words_of(x), name_links.words_of(y)) - 1e-9


def test_batches_may_part_a_band(monkeypatch) -> None:  # noqa: ANN001
    texts = varied()
    rows = sorted((i % 3, t) for i, t in enumerate(texts))
    grams = [len(name_links.qgrams(name_links.words_of(t))) for _, t in rows]
    t = pa.table({"text": [t for _, t in rows], "high": pa.array([0] * len(rows), pa.int64()), "low": pa.array([0] * len(rows), pa.int64()), "size": pa.array(grams, pa.int32()), "band": pa.array([b for b, _ in rows], pa.int64())})
    found = lambda batches: {tuple(p.values()) for x in name_links._meet(iter(batches)) for p in x.to_pylist()}
    want = found(t.to_batches())
    monkeypatch.setattr(name_links, "ROWS_AT_ONCE", 4)
    monkeypatch.setattr(name_links, "PAIRS_AT_ONCE", 5)
    assert want and found(t.to_batches(max_chunksize=7)) == want and found([]) == set()
