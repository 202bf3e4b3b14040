"""Text operators against brute force and hand-made cases."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import DATA, rows
from intakeforge.llm import canonical, leakage, mixing, mojibake, name_links, text_quality

# --- leakage ----------------------------------------------------------------------------------------------------------

WORDS = st.lists(st.sampled_from("abc"), max_size=16)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=9), max_size=4), WORDS, st.integers(1, 4))
def test_automaton_equals_brute_force(items: list[list[str]], doc: list[str], least: int) -> None:
    got = leakage.SuffixAutomaton(list(enumerate(items)), least).leaks(doc)
    want = {}
    for i, w in enumerate(items):
        grams = {tuple(w[k : k + least]) for k in range(len(w) - least + 1)}
        at = [k for k in range(len(doc) - least + 1) if tuple(doc[k : k + least]) in grams]
        if at:
            want[i] = (len({x for k in at for x in range(k, k + least)}), at[0], at[-1] + least - 1)
    assert {i: (v[0], v[2], v[3]) for i, v in got.items()} == want


def test_words_are_ascii_runs() -> None:
    assert leakage.words("The café, No_5K x") == ["the", "caf", "no", "5", "x"]
    assert leakage.words(None) == []


def test_leaks_and_cleaned_text(spark) -> None:  # noqa: ANN001
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, f"Before. {item.upper().replace(' ', ' - ')}! After all of it there is much more text to keep than was cut away here."), (2, "one two three"), (3, None), (4, ""), (5, item), (5, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, item), (9, "short"), (None, item), (10, None)], "item_id int, text string")
    assert rows(leakage.leaked_pairs(docs, items)) == [(1, 7), (1, 8), (5, 7), (5, 8)]
    clean = {r.doc_id: r for r in leakage.remove_leaks(docs, items).collect()}
    assert clean[1].clean_text.startswith("Before.") and "seven" not in clean[1].clean_text.lower() and clean[1].words_removed == 13
    assert clean[5].clean_text is None and clean[2].clean_text == "one two three" and clean[3].clean_text is None and clean[4].clean_text == ""
    one_by_one = leakage.find_leaks(docs, items, block_chars=1).select("doc_id", "item_id").distinct()
    assert rows(one_by_one) == rows(leakage.leaked_pairs(docs, items))


# --- encoding ---------------------------------------------------------------------------------------------------------

CLEAN = ["Größe M", "für Außen", "modèle à clé", "łatwy montaż", "señal roja", "4…20 mA", "don’t stack", "2 m² roll", "Ø 40 mm", "ROMÃ finish", "PROTEÇÃO UV", "Société Anonyme"]


def test_wrong_decodings_are_undone() -> None:
    counts = {w: 50 for t in CLEAN for w in t.split() if not w.isascii()}
    d = mojibake.Describer(mojibake.build_dictionaries(sorted(counts.items())), counts)
    for t in CLEAN:
        assert d.repair(t) == ("", t)
        for right, wrong in [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp437")]:
            try:
                bad = t.encode(right).decode(wrong)
            except UnicodeError:
                continue
            if bad != t:
                assert d.repair(bad)[1] == t, (t, right, wrong, bad)
    twice = "Größe M".encode().decode("cp1252").encode().decode("cp1252")
    assert d.repair(twice)[1] == "Größe M"


def test_garbled_cells(spark) -> None:  # noqa: ANN001
    data = [(i, "Größe M", "Zoë") for i in range(20)] + [(20, "GrÃ¶ÃŸe M", None), (21, "Gr��e", "x"), (21, "Gr��e", "x"), (22, None, ""), (23, "plain", "Zoë")]
    df = spark.createDataFrame(data, "line_id long, description string, vendor_name string").withColumn("text", F.lit("clash"))
    found = mojibake.find_garbled(df)
    assert rows(found.select("line_id", "column_name", "restored")) == [(20, "description", "Größe M"), (21, "description", None), (21, "description", None)]


# --- canonical values -------------------------------------------------------------------------------------------------


def test_tokens_and_distance() -> None:
    assert canonical.tokens_of("x_INV0ICE DATE (new)") == ["x", "invoice", "date", "new"]  # none is dropped here
    assert canonical.tokens_of("BI11 N0") == ["bill", "no"]
    assert canonical.tokens_of("currencyCode_1") == ["currency", "code", "1"]
    assert canonical.tokens_of(None) == [] and canonical.tokens_of("?") == []
    assert canonical.edit_distance("raet", "rate") == 1 and canonical.edit_distance("abc", "xyz") == 3


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", min_size=6, max_size=8), st.integers(0, 7), st.sampled_from("abc"))
def test_close_tokens_share_a_deletion(t: str, i: int, c: str) -> None:
    for other in {t[:i] + t[i + 1 :], t[:i] + c + t[i:], t[:i] + c + t[i + 1 :]}:
        assert set(canonical.deletions(t)) & set(canonical.deletions(other))


def test_mapping(spark) -> None:  # noqa: ANN001
    entries = spark.createDataFrame([("s", "due_date", "due_date"), ("s", "payment due", "due_date"), ("s", "tax_rate", "tax_rate"), ("s", "vat rate", "tax_rate"), ("t", "due_date", "other")], "scope string, label string, target string")
    history = spark.createDataFrame([("s", "settle by", "due_date")] * 3 + [("s", "tax office", None)] * 3 + [("s", "due fecha", "due_date")] + [("s", "due date 1", "due_date"), ("s", "vat rate_1", "tax_rate")], "scope string, value string, target string")
    asked = ["DUE_DATE", "paymentDue", "Paymentdue", "duedaet", "VAT RTAE", "Settle  by", "settlle by", "tax office", "tax offcie", "rate tax", "TAX RATE_1", "see note", "?", "", "fecha due", "colour"]
    want = ["due_date"] * 4 + ["tax_rate"] + ["due_date"] * 2 + ["(none)"] * 2 + ["tax_rate"] * 2 + ["(none)"] * 3 + ["due_date", "(none)"]
    got = {(r.scope, r.value): r.target for r in canonical.map_values(spark.createDataFrame([("s", a) for a in asked] * 2 + [("t", "DueDate"), (None, "x"), ("s", None)], "scope string, value string"), entries, history).collect()}
    assert got == dict(zip([("s", a) for a in asked], want)) | {("t", "DueDate"): "other"}


def test_held_out_history(spark) -> None:  # noqa: ANN001
    """Decided rows hidden from the history come out as they were decided, mostly."""
    m = spark.read.parquet("/root/testdata/sf0.01/mapping_proposal.parquet").join(spark.read.parquet("/root/testdata/sf0.01/source_feed.parquet").select("feed_id", "schema_name"), "feed_id")
    specs = spark.read.parquet("/root/testdata/sf0.01/field_spec.parquet")
    decided = m.filter("status IN ('accepted', 'demoted')").select(F.col("schema_name").alias("scope"), F.col("source_column").alias("value"), F.when(F.col("status") == "accepted", F.col("target_field")).alias("target"), "spec_id")
    held = decided.filter("spec_id % 4 = 0")  # a held-out part of a test, not of a query
    entries = specs.select(F.col("schema_name").alias("scope"), F.col("field_name").alias("target"), F.explode(F.concat(F.array("field_name"), "aliases")).alias("label"))
    found = canonical.map_values(held.select("scope", "value"), entries, decided.filter("spec_id % 4 <> 0").select("scope", "value", "target"))
    j = held.join(found.withColumnRenamed("target", "found"), ["scope", "value"]).select(F.avg((F.coalesce("target", F.lit("(none)")) == F.col("found")).cast("int"))).first()[0]
    assert j >= 0.9


def test_words_are_empty_only_where_the_history_says_so(spark) -> None:  # noqa: ANN001
    """A number that tells two columns apart stays; one that stands beside known wordings of the same target goes."""
    entries = spark.createDataFrame([("s", "address one", "a1"), ("s", "city", "city"), ("s", "zip", "zip")], "scope string, label string, target string")
    history = spark.createDataFrame([("s", "address 1", "a1"), ("s", "address 2", "a2"), ("s", "fld city", "city"), ("s", "fld zip", "zip")], "scope string, value string, target string")
    asked = ["ADDRESS_2", "Address 1", "fld address 2", "address 3"]
    got = {r.value: r.target for r in canonical.map_values(spark.createDataFrame([("s", a) for a in asked], "scope string, value string"), entries, history).collect()}
    assert got == {"ADDRESS_2": "a2", "Address 1": "a1", "fld address 2": "a2", "address 3": "(none)"}


def test_repairs_follow_shares_not_counts(spark) -> None:  # noqa: ANN001
    """The same history ten times over leads to the same repairs; a frequent word of its own is none's misspelling."""
    counts = [("percent", 11, 1), ("perecnt", 1, 0), ("lead", 18, 1), ("leaf", 9, 0), ("seller", 0, 1), ("sesller", 0, 0)]
    for k in (1, 10):
        rows = [(t, n * k, s) for t, n, s in counts]
        got = {r.token: r.repaired for r in canonical.token_repairs(spark.createDataFrame(rows, "token string, n long, spec int")).collect()}
        assert got == {"percent": "percent", "perecnt": "percent", "lead": "lead", "leaf": "leaf", "seller": "seller", "sesller": "seller"}


def test_short_forms_meet_by_their_first_letters(spark) -> None:  # noqa: ANN001
    words = ["quantity", "number", "amount", "date", "invoice", "nbr", "qualitative"]
    tokens = ["qty", "nbr", "amt", "dt", "inv", "q", "xyz", "quantity", "dtx"]
    got = {(r.token, r.long) for r in canonical.short_forms(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w,) for w in words], "long string")).collect()}
    assert got == {(t, w) for t in tokens for w in words if len(w) >= 4 and canonical.is_short_form(t, w)}


def test_garbled_texts_come_back_as_they_were_written(spark) -> None:  # noqa: ANN001
    """Clean cells of a table, a third of their distinct texts decoded wrongly: found, restored, and nothing else touched."""
    rnd = random.Random(5)
    rows_ = spark.read.parquet("/root/testdata/sf0.1/invoices_2026_08.parquet").select("line_id", "description", "vendor_name")
    bad = mojibake.find_garbled(rows_).select(F.col("text").alias("t")).distinct()
    cells = rows_.select("line_id", "description").withColumnRenamed("description", "text").unionByName(rows_.select("line_id", F.col("vendor_name").alias("text")))
    clean = [r.text for r in cells.filter(mojibake.suspicious(F.col("text"))).join(bad, F.col("text") == F.col("t"), "left_anti").groupBy("text").agg(F.count(F.lit(1)).alias("n")).orderBy("text").collect()]
    chains = [("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1250", "cp1252")]
    data, want = [], {}
    for i, t in enumerate(clean):
        data.append((3 * i, t, None))
        if rnd.random() < 0.3:
            right, wrong = rnd.choice(chains)
            try:
                broken = t.encode(right).decode(wrong)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if broken != t:
                data.append((3 * i + 1, broken, None))
                want[3 * i + 1] = t
    got = {r.line_id: r.restored for r in mojibake.find_garbled(spark.createDataFrame(data, "line_id long, description string, vendor_name string")).collect()}
    assert len(want) > 300 and sum(got.get(k) == t for k, t in want.items()) >= 0.95 * len(want)
    assert len(set(got) - set(want)) <= 0.01 * len(clean)


# --- names ------------------------------------------------------------------------------------------------------------


def vendors() -> list[tuple[str, str]]:
    """(id, name): twelve firms of each of four trades and of four given names, spelled in full and in short, none in any list."""
    rnd = random.Random(7)
    word = lambda k: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(k)).capitalize()
    out = []
    for trade, short in (("Masonry", "Msnry"), ("Plumbing", "Plmbg"), ("Bakery", "Bkry"), ("Florists", "Flor")):
        for k in range(12):
            own, i = f"{word(3)} {word(3)}", f"O-{trade}-{k}"
            out += [(i, f"{own} {trade} Ltd")] * 3 + [(i, f"{own} {short}")] * (k % 2)
    for given, nick in (("Mohamed", "Momo"), ("Jack", "Jonty"), ("Ingeborg", "Bolle"), ("Yusuf", "Joe")):
        for k in range(12):
            own, i = word(5), f"P-{given}-{k}"
            out += [(i, f"{given} {own}")] * 2 + [(i, f"{own}, {nick}")] * (1 + k % 2)
    return out


def test_qualifiers_are_learned(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame(vendors(), "id string, name string").groupBy("id", "name").agg(F.count(F.lit(1)).alias("n")).withColumn("tokens", F.expr("regexp_extract_all(replace(lower(name), ' ltd', ''), '[a-z]+', 0)"))
    got = {r.token: r["class"] for r in name_links.qualifier_classes(df).collect()}
    want = {"masonry": "masonry", "msnry": "masonry", "plmbg": "plumbing", "bkry": "bakery", "flor": "florists", "momo": "mohamed", "jonty": "jack", "bolle": "ingeborg", "joe": "yusuf"}
    # Of a pair that is always swapped either word may stand for the class.
    assert all(got[a] == got[b] for a, b in want.items()) and len({got[b] for b in want.values()}) == 8
    assert not set(got) - set(want) - set(want.values())


def test_name_words() -> None:
    assert name_links.name_words("Dr. Elizabeth K. Bińutijedä") == ["elizabeth", "k", "binutijeda"]
    assert name_links.name_words("The Hape-Samucu Electr. S.A.") == ["hape", "samucu", "electr"] and name_links.name_words("Yucu Pipolu A/S") == name_links.name_words("yucu-pipolu S A") == ["yucu", "pipolu"]
    assert name_links.name_words("K & G Trading") == ["k", "g", "trading"] and name_links.name_words("") == []


@pytest.mark.parametrize(
    ("a", "b", "least", "most"),
    [
        (["naro", "vozubo"], ["narovozubo"], 1.0, 1.0),
        (["vozubo", "naro"], ["narovozubo"], 1.0, 1.0),
        (["a1b2", "c3d4", "e5f6", "g7h8", "i9j0", "kk"], ["kk", "i9j0", "g7h8", "a1b2", "e5f6", "c3d4"], 1.0, 1.0),
        (["one", "two", "three", "four", "five"], ["onetwo", "three", "four", "five"], 1.0, 1.0),
        (["smith"], ["smith", "jones"], 0.5, 0.7),
        (["vozubo"], ["vozbuo"], 0.8, 0.9),
        ([], ["x"], 0.0, 0.0),
    ],
)
def test_monge_elkan_is_one_formula(a: list[str], b: list[str], least: float, most: float) -> None:
    s = name_links.monge_elkan(a, b)
    assert least <= s <= most and abs(s - name_links.monge_elkan(b, a)) < 1e-9


def test_a_chain_is_several_stars(spark) -> None:  # noqa: ANN001
    chain = [(a, b) for a, b in zip("abcdefgh", "bcdefgh")]
    e = spark.createDataFrame(chain + [(b, a) for a, b in chain], "a string, b string")
    got = {r.id: r.star for r in name_links.stars(e).collect()}
    assert len(set(got.values())) >= 3 and all((m, c) in chain or (c, m) in chain for m, c in got.items() if m != c)


def test_bands_reach_the_recall() -> None:
    n = name_links.bands_for(0.4, 0.97, 3)
    assert 1 - (1 - 0.4**3) ** n >= 0.97 > 1 - (1 - 0.4**3) ** (n - 1)


def test_links(spark) -> None:  # noqa: ANN001
    own = {"A1": "Naro Vozubo Masonry Ltd", "A2": "Vozubo-Naro Msnry Ltd.", "A3": "NAROVOZUBO MASONRY", "A4": "Naro Vozbuo Masonry", "B1": "Naro Vozubo Bakery Inc.", "P1": "Mohamed Yibupineji", "P2": "Yibupineji, Momo", "P3": "Ingeborg Yibupineji", "Q1": "N/A", "R1": "Bakery Liwu Gineci LLC", "S1": "J. Tesorabi", "S2": "Jack Tesorabi"}
    df = spark.createDataFrame(vendors() + [(i, n) for i, n in own.items()] * 3 + [(None, "Naro Vozubo Masonry"), ("Q2", None)], "vendor_id string, vendor_name string")
    assert rows(name_links.linked_pairs(df)) == [("A1", "A2"), ("A1", "A3"), ("A1", "A4"), ("A2", "A3"), ("A2", "A4"), ("A3", "A4"), ("P1", "P2"), ("S1", "S2")]
    got = {r.id: (r.star, r["size"]) for r in name_links.linked_ids(df).collect()}
    assert got == dict.fromkeys(["A1", "A2", "A3", "A4"], ("A1", 4)) | dict.fromkeys(["P1", "P2"], ("P1", 2)) | dict.fromkeys(["S1", "S2"], ("S1", 2))


def test_one_name_of_many_ids_is_one_node(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(f"V{i:04}", "Naro Vozubo") for i in range(500)] + [("W1", "Naro Vozubbo")], "vendor_id string, vendor_name string")
    _, edges = name_links.link_edges(name_links.name_keys(df))
    assert edges.count() == 2
    assert name_links.linked_ids(df).select("star").distinct().count() == 1 and name_links.linked_ids(df).count() == 501


def test_minhash_meets_what_brute_force_meets(spark) -> None:  # noqa: ANN001
    """Recall of the bands against all pairs of the distinct own words of a table, whatever qualifies them."""
    keys = name_links.name_keys(spark.read.parquet("/root/testdata/sf0.01/invoices_2026_08.parquet"))
    data = [(r.text, list(r.words)) for r in keys.select("text", "words").dropDuplicates(["text"]).collect()]
    want = {tuple(sorted((a, b))) for i, (a, x) in enumerate(data) for b, y in data[:i] if name_links.monge_elkan(x, y) >= name_links.MIN_SIMILARITY}
    got = {tuple(sorted((r.text, r.other))) for r in name_links.similar_texts(keys).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


# --- removal of leaks --------------------------------------------------------------------------------------------------


def test_removal_does_not_depend_on_blocks(spark) -> None:  # noqa: ANN001
    """Spans of items in different blocks that overlap are united in the original text before it is cut."""
    w = [f"w{i}" for i in range(1, 31)]
    items = spark.createDataFrame([(1, " ".join(w[:13])), (2, " ".join(w[7:20])), (3, "none of this"), (4, None)], "item_id long, text string")
    texts = ["Start: " + ", ".join(w) + ".", " ".join(w[:13]) + " and then, " + " ".join(w[:12]) + " with many more words that are not leaked at all here " * 3, None, "", "short", " ".join(w[3:16])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0])], "doc_id long, text string")
    whole = rows(leakage.remove_leaks(docs, items, max_coverage=0.9))
    for size in (1, 60, 100, 10_000):
        assert rows(leakage.remove_leaks(docs, items, max_coverage=0.9, block_chars=size)) == whole
    got = {r[0]: r[1:] for r in whole}
    assert got[0] == (31, 20, "Start:  , " + ", ".join(w[20:]) + ".") and got[2] == (0, 0, None) and got[3] == (0, 0, "")
    assert got[1][1] == 25 and " and then, " in got[1][2]


# --- mixing -----------------------------------------------------------------------------------------------------------


def test_sainte_lague() -> None:
    assert mixing.sainte_lague({"a": 53, "b": 24, "c": 23}, 7, {"a": 99, "b": 99, "c": 99}) == {"a": 3, "b": 2, "c": 2}
    assert mixing.sainte_lague({"a": 53, "b": 24, "c": 23}, 7, {"a": 1, "b": 99, "c": 99}) == {"a": 1, "b": 3, "c": 3}
    assert mixing.sainte_lague({}, 5, {}) == {} and mixing.sainte_lague({"a": 1}, 0, {"a": 9}) == {"a": 0}


@pytest.mark.parametrize("seed", range(30))
def test_sainte_lague_equals_plain_quotients(seed: int) -> None:
    rnd = random.Random(seed)
    w = {k: rnd.randint(1, 100) for k in "abcdef"[: rnd.randint(1, 6)]}
    seats = rnd.randint(0, 60)
    order = sorted(((-v / (2 * i + 1), k) for k, v in w.items() for i in range(seats)))[:seats]
    assert mixing.sainte_lague(w, seats, dict.fromkeys(w, 10**9)) == {k: sum(x == k for _, x in order) for k in w}


def test_mix_reaches_shares(spark) -> None:  # noqa: ANN001
    data = [(i, "word " * (5 + i % 40), "a" if i % 3 else "b") for i in range(3000)] + [(9001, None, "a"), (9002, "", "b"), (9003, "x y", None), (9004, "x y", "unlisted")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    target = spark.createDataFrame([("a", 0.3, 2), ("b", 0.6, 4), ("c", 0.1, 9), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    used = mixing.mix(docs, target, shard_tokens=5000)
    r = {x.source: x for x in mixing.mix_shares(docs, target, shard_tokens=5000).collect()}
    assert used.filter("copies > 4 OR source = 'a' AND copies > 2 OR n_tokens = 0").count() == 0 and set(r) == {"a", "b", "c"}
    # Nothing is there of c, so that a and b share the mix in their proportion.
    assert abs(r["a"].share - 1 / 3) < 0.02 and abs(r["b"].share - 2 / 3) < 0.02 and r["c"].share == 0
    assert rows(used) == rows(mixing.mix(docs, target, shard_tokens=5000))


# --- text quality -----------------------------------------------------------------------------------------------------

COMMON = frozenset("the and of to a in that is was for it with as at we but if before not all our no one by there had were on be".split())
PROSE = "We should hold the load before the second delivery, but no one noticed it. It was not in the file that we had, and all of the rows were there.\n"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (PROSE * 2, "prose"),
        ("one line without a stop that is of the kind we had before in the load\n" * 3, "prose"),
        ("- alpha\n- beta gamma\n- delta\n- epsilon\n", "list"),
        ("Steps:\n1. first\n2. second thing\n3. third\n", "list"),
        ("vat amount;\nstore id;\nnet sales;\n", "list"),
        ("Qty: 5\nPrice (late): 17\nTotal: 3\n", "list"),
        ("a\tb\tc\n1\t2\t3\n4\t5\t6\n", "table"),
        ("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n", "table"),
        ("Ccy       Price     Vendor\nEUR       4.00      Bomi\nUSD       5.10      Rute\n", "table"),
        ("test " * 80, "junk"),
        ("00000000  66 fa fa 05 4e 96\n00000010  c3 84 d6 d6 e1 21\n", "junk"),
        ("=====================\n---------------------\n", "junk"),
        ("Home | Print | Login | Help | Export | Home | Print | Login | Help | Top", "junk"),
        (PROSE + "- a\n- b\n", "prose"),
        ("x" * 5000, "junk"),
    ],
)
def test_kinds(text: str, kind: str) -> None:
    assert text_quality.analyse(text, COMMON)[-1] == kind


def test_statistics_of_blank_and_null(spark) -> None:  # noqa: ANN001
    docs = spark.createDataFrame([(1, None), (2, "  \n"), (3, "Hi."), (3, "Hi."), (4, "...")], "doc_id long, text string")
    common = spark.createDataFrame([("en", "hi"), ("en", None), ("en", "hi")], "lang string, word string")
    got = text_quality.text_statistics(docs, common).select("doc_id", "n_words", "mean_word_length", "common_share", "punctuated_lines")
    assert rows(got) == sorted([(3, 1, 2.0, 1.0, 1.0)] * 2 + [(4, 0, None, None, 1.0)], key=repr)


def test_labels_agree() -> None:
    """Accuracy against the hand labels, of which a few are wrong."""
    import duckdb

    d = DATA.replace("sf0.001", "sf0.1")
    c = duckdb.connect()
    common = frozenset(r[0].lower() for r in c.execute(f"SELECT word FROM '{d}/common_words.parquet'").fetchall())
    data = c.execute(f"SELECT text, label_class FROM '{d}/documents.parquet' JOIN '{d}/doc_labels.parquet' USING (doc_id) WHERE trim(text) <> ''").fetchall()
    assert sum(text_quality.analyse(t, common)[-1] == k for t, k in data) >= 0.95 * len(data)
