"""Variant spellings of names: identifiers of one organisation or person linked.

A name is parsed into a qualifier (the trade of an organisation, the given name of a person) and its own words. Which words are
qualifiers, and which of them stand for each other (abbreviations, nicknames), is learned from the names themselves: a
qualifier stands beside many different own words, and spellings of one identifier swap a qualifier for its variants. Own words
meet through MinHash bands over padded q-grams, tuned from the collision curve; pairs are verified by Monge-Elkan similarity
and equal qualifiers, and names are clustered into stars.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeforge.functions.names import fold
from intakeforge.functions.values import is_null_like
from intakeforge.llm.canonical import _short_form, deletions, edit_distance
from intakeforge.session import cut

# Legal forms of companies, and titles and fillers of names, written without dots.
LEGAL = ["llc", "inc", "incorporated", "corp", "corporation", "ltd", "limited", "plc", "llp", "lp", "co", "company", "gmbh", "gesellschaft", "mbh", "ag", "kg", "kgaa", "ohg", "ug", "ev", "sa", "societe", "anonyme", "sarl", "rl", "sas", "eurl", "bv", "nv", "srl", "spa", "sl", "as", "asa", "aktieselskab", "aps", "ab", "aktiebolag", "oy", "oyj", "sp", "spolka", "spz", "zoo", "oo", "sro", "kft", "zrt", "pty", "pte", "bhd"]
FILLERS = ["the", "and", "und", "et", "y", "u", "z", "of", "accounts", "payable", "ap", "dr", "mr", "mrs", "ms", "prof", "herr", "frau"]
#: Share of an identifier's rows from which a word is one of its main ones.
MAIN_SHARE = 0.4
#: A qualifier stands beside so many different words at least, and beside one for so many identifiers.
LEAST_COMPANY, COMPANY_PER_IDS = 6, 1000
#: Identifiers that have to swap a word for a qualifier, and the greatest share of them with both in one spelling.
LEAST_SWAPS, SPELLED_TOGETHER = 2, 0.1
#: A word that is swapped for two classes, for one so much of the times as for the other, stands for neither.
VAGUE = 0.4
QGRAM, ROWS = 3, 3
#: Least overlap of q-grams at which pairs are to be met, and the share of those that has to be met.
TUNED_AT, RECALL = 0.4, 0.97
MIN_SIMILARITY = 0.8
#: Pairs that meet by chance: far below the overlap that the bands are tuned for.
LEAST_OVERLAP = 0.25
#: Names of more words are compared without a bound from their letters.
BOUNDED_WORDS = 4
#: Rows and pairs of rows that a task holds at once, besides those of one band.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 1 << 16, 1 << 18

_LEGAL, _FILL = frozenset(LEGAL), frozenset(FILLERS)
_LETTERS = re.compile(r"(?<![^\W_])[a-z](?:[ /-]+[a-z])+(?![^\W_])")
_PLAIN = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe"})


def _plain(name: str) -> str:
    return fold(name.translate(_PLAIN)).lower().replace(".", "").replace("'", "").replace("’", "")


def name_words(name: str) -> list[str]:
    """Words of a name in any script, in lower case, without accents, dots, legal forms, titles and fillers; with initials.

    Legal forms may be written letter by letter ("S A", "A/S").
    """
    text = _LETTERS.sub(lambda m: " " if re.sub(r"[\W_]", "", m.group()) in _LEGAL else m.group(), _plain(name))
    return [t for t in re.findall(r"[^\W_]+", text) if t not in _LEGAL and t not in _FILL]


def spare_words(name: str) -> list[str]:
    """All words of a name in any script, for names that have no words of their own; a name of signs alone is one word."""
    text = _plain(name)
    return re.findall(r"\w+", text) or [text.strip() or name]


def words_of(text: str) -> list[str]:
    """The words of a `name_keys` text, which a space parts; one of signs alone is a single word (see `spare_words`)."""
    return text.split(" ") if re.search(r"\w", text) else [text]


@lru_cache(maxsize=1 << 17)
def similarity(a: str, b: str) -> float:
    """1 minus the edit distance by the longer length."""
    n = max(len(a), len(b))
    return 1 - edit_distance(a, b, n + 1) / n if n else 0.0


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Least of both sides' means of each word's best similarity, the words in any order.

    A word may also stand for two words of the other side written together, in either order.
    """
    if not a or not b:
        return 0.0
    best = {(0, i): 0.0 for i in range(len(a))} | {(1, j): 0.0 for j in range(len(b))}
    for side, x, y in ((0, a, b), (1, b, a)):
        for i, w in enumerate(x):
            for j, v in enumerate(y):
                if side == 0:
                    s = similarity(w, v) if w <= v else similarity(v, w)
                    best[0, i], best[1, j] = max(best[0, i], s), max(best[1, j], s)
                for k in range(len(y)):
                    n = len(v) + len(y[k])
                    if k != j and abs(n - len(w)) <= 0.25 * n and len(w) > max(len(v), len(y[k])):
                        s = similarity(w, v + y[k])
                        best[side, i] = max(best[side, i], s)
                        best[1 - side, j], best[1 - side, k] = max(best[1 - side, j], s), max(best[1 - side, k], s)
    return min(sum(best[0, i] for i in range(len(a))) / len(a), sum(best[1, j] for j in range(len(b))) / len(b))


def bands_for(similarity_: float = TUNED_AT, recall: float = RECALL, rows: int = ROWS) -> int:
    """Least number of bands at which pairs of that overlap meet with that probability: 1 - (1 - s^r)^b."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity_**rows))


def qgrams(words: list[str], q: int = QGRAM) -> set[str]:
    """q-grams of the words, each padded on both sides, so that their order doesn't matter."""
    return {p[i : i + q] for w in words for p in [f"{'#' * (q - 1)}{w}{'#' * (q - 1)}"] for i in range(len(p) - q + 1)}


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20260801)
    return r.integers(1, 1 << 32, n, dtype=np.uint64) | np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(words: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash of the words' q-grams by multiply-shift hashing."""
    h = np.array([xxhash.xxh64_intdigest(g) for g in qgrams(words)], dtype=np.uint64)
    if not len(h):
        return np.zeros(len(a), dtype=np.uint64)
    return ((h[:, None] * a[None, :] + b[None, :]) >> np.uint64(16)).min(axis=0)


MET = T.StructType([T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("high", T.LongType()), T.StructField("low", T.LongType()), T.StructField("size", T.IntegerType())])
PARSED = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("spare", T.ArrayType(T.StringType()))])


@F.pandas_udf(PARSED)
def _split(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(name_words(n), spare_words(n)) for n in names], columns=["tokens", "spare"])


@F.pandas_udf(MET)
def _bands(texts: pd.Series) -> pd.DataFrame:
    """The bands of a name's words, a bitmap of their q-grams in two parts, and the number of these."""
    n = bands_for()
    a, b = _permutations(n * ROWS)
    out = []
    for t in texts:
        words = words_of(t)
        s, grams, bits = signature(words, a, b).reshape(n, ROWS), qgrams(words), 0
        for g in grams:
            bits |= 1 << (xxhash.xxh32_intdigest(g) & 127)
        out.append(([xxhash.xxh64_intdigest(s[i].tobytes(), seed=i) - (1 << 63) for i in range(n)], (bits >> 64) - (1 << 63), (bits & ((1 << 64) - 1)) - (1 << 63), len(grams)))
    return pd.DataFrame(out, columns=["bands", "high", "low", "size"])


@F.pandas_udf(T.DoubleType())
def _monge_elkan(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([monge_elkan(words_of(x), words_of(y)) for x, y in zip(a, b)])


# --- pairs that meet --------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1 << 16)
def _grams(text: str) -> frozenset[str]:
    return frozenset(qgrams(words_of(text)))


@lru_cache(maxsize=1 << 16)
def letters(text: str) -> tuple[int, ...]:
    """Number of words, then a bitmap of the letters of each word and the words' lengths; zeros for names of many words."""
    w = words_of(text)
    if len(w) > BOUNDED_WORDS:
        return (0,) * (1 + 2 * BOUNDED_WORDS)
    rest = [0] * (BOUNDED_WORDS - len(w))
    return (len(w), *[sum({1 << (ord(c) % 63) for c in x}) for x in w], *rest, *map(len, w), *rest)


def most_alike(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """At least the Monge-Elkan similarity of each pair of names with ``n_a`` and ``n_b`` words, from rows of `letters`.

    A word needs an edit for each letter that only it has, and for each place by which it is longer; swaps change neither.
    """
    at = lambda x, i: (x[:, 1 + i], x[:, 1 + BOUNDED_WORDS + i])

    def alike(x: tuple, y: tuple) -> np.ndarray:
        apart = np.maximum(np.bitwise_count(x[0] & ~y[0]), np.bitwise_count(y[0] & ~x[0]))
        longer = np.maximum(x[1], y[1])
        return 1 - np.maximum(apart, np.abs(x[1] - y[1])) / np.maximum(longer, 1)

    best = {(0, i): np.zeros(len(a)) for i in range(n_a)} | {(1, j): np.zeros(len(a)) for j in range(n_b)}
    for side, x, y, n_x, n_y in ((0, a, b, n_a, n_b), (1, b, a, n_b, n_a)):
        for i in range(n_x):
            w = at(x, i)
            for j in range(n_y):
                v = at(y, j)
                if side == 0:
                    s = alike(w, v)
                    best[0, i], best[1, j] = np.maximum(best[0, i], s), np.maximum(best[1, j], s)
                for k in range(j + 1, n_y):
                    u = at(y, k)
                    n = v[1] + u[1]
                    s = np.where((np.abs(n - w[1]) <= 0.25 * n) & (w[1] > np.maximum(v[1], u[1])), alike(w, (v[0] | u[0], n)), 0)
                    for one in ((side, i), (1 - side, j), (1 - side, k)):
                        best[one] = np.maximum(best[one], s)
    return np.minimum(sum(best[0, i] for i in range(n_a)) / n_a, sum(best[1, j] for j in range(n_b)) / n_b)


def _alike_rows(texts: np.ndarray, high: np.ndarray, low: np.ndarray, size: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (left, right) of one band that can be alike; ``end``: the row after the last of each row's band.

    What is left out here has too few q-grams in common, or can't be similar enough: the tests that follow would drop it too.
    """
    known = np.array([letters(t) for t in texts], dtype=np.int64).reshape(len(texts), 1 + 2 * BOUNDED_WORDS)
    others = end - np.arange(len(texts)) - 1
    upto = np.cumsum(others)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(upto, upto[start] - others[start] + PAIRS_AT_ONCE, side="right")))
        n = others[start:stop]
        left = np.repeat(np.arange(start, stop), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        start = stop
        # Bits that differ come from q-grams that only one of the two has.
        apart = np.bitwise_count(high[left] ^ high[right]).astype(np.int64) + np.bitwise_count(low[left] ^ low[right])
        total = size[left] + size[right]
        ok = total - apart >= LEAST_OVERLAP * (total + apart)
        left, right = left[ok], right[ok]
        shape = known[left, 0] * (BOUNDED_WORDS + 1) + known[right, 0]
        for x in np.unique(shape):
            n_a, n_b = divmod(int(x), BOUNDED_WORDS + 1)
            l, r = left[shape == x], right[shape == x]
            if n_a and n_b:
                ok = most_alike(known[l], known[r], n_a, n_b) >= MIN_SIMILARITY - 1e-9
                l, r = l[ok], r[ok]
            yield l, r


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of texts that share a band and enough q-grams, of rows sorted by band and text: the first before the other."""
    held: list[pa.RecordBatch] = []
    rows, least = 0, ROWS_AT_ONCE
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            rows += batch.num_rows
            if rows < least:
                continue
        if not rows:
            continue
        t = pa.Table.from_batches(held)
        band = t["band"].to_numpy()
        first = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        # The last band may go on in the next batch.
        whole = rows if batch is None else int(first[-1])
        held, rows = t.slice(whole).to_batches(), rows - whole
        least = max(ROWS_AT_ONCE, 2 * rows)
        end = np.repeat(np.r_[first[1:], len(band)], np.diff(np.r_[first, len(band)]))[:whole]
        t = t.slice(0, whole)
        texts = np.array(t["text"].to_pylist(), dtype=object)
        bits = [t[c].to_numpy().view(np.uint64) for c in ("high", "low")]
        for left, right in _alike_rows(texts, *bits, t["size"].to_numpy().astype(np.int64), end):
            pairs = set()
            for a, b in zip(texts[left], texts[right]):
                x, y = _grams(a), _grams(b)
                both = len(x & y)
                if a != b and both >= LEAST_OVERLAP * (len(x) + len(y) - both):
                    pairs.add((a, b))
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["text", "other"])


# --- qualifiers -------------------------------------------------------------------------------------------------------


def main_words(spellings: DataFrame) -> DataFrame:
    """(id, words): the main words of each identifier, those that few identifiers have first. ``spellings``: (id, name, n, tokens)."""
    t = spellings.select("id", "n", F.explode(F.array_distinct("tokens")).alias("token")).filter("length(token) > 1").groupBy("id", "token").agg(F.sum("n").alias("n"))
    df = t.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = spellings.groupBy("id").agg(F.sum("n").alias("total"))
    main = t.join(total, "id").filter(F.col("n") >= MAIN_SHARE * F.col("total")).join(df, "token")
    # At most the words of an average name divided by the share, so that no group is large.
    return main.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("words")).select("id", F.transform("words", lambda x: x["token"]).alias("words"))


def company(main: DataFrame) -> DataFrame:
    """(token, company): the number of different words that a word stands beside, as a main word of identifiers.

    Of each identifier only the rarest other main word counts, so that all identifiers of one entity, and its namesakes, count
    as one.
    """
    pairs = main.filter("size(words) > 1").select(F.posexplode("words").alias("at", "token"), F.get("words", F.lit(0)).alias("first"), F.get("words", F.lit(1)).alias("second"))
    return pairs.groupBy("token").agg(F.count_distinct(F.when(F.col("at") == 0, F.col("second")).otherwise(F.col("first"))).alias("company"))


def qualifier_classes(spellings: DataFrame) -> DataFrame:
    """(token, class, company): the words that qualify names, each with the word that stands for its class.

    A qualifier stands beside many different words (`company`): at least ``LEAST_COMPANY``, and one for ``COMPANY_PER_IDS``
    identifiers; their number is bounded by the words of a name times that figure. Qualifiers that most names have together
    ("medical supply") are one class, as are words that spellings of one identifier swap for each other ("Bob", "Robert";
    "mfg", "manufacturing") but hardly have together. They have to be swapped beside different words, not only by the
    identifiers of one entity; of abbreviations one is enough. A word that is swapped for several classes alike has the class
    '' and tells nothing.
    """
    ids = spellings.agg(F.count_distinct("id").alias("ids"))
    main = cut(main_words(spellings))
    heads = cut(company(main).crossJoin(F.broadcast(ids)).filter((F.col("company") >= LEAST_COMPANY) & (F.col("company") * COMPANY_PER_IDS >= F.col("ids"))).select("token", "company"))
    tokens = cut(spellings.select("id", "name", F.explode(F.array_distinct("tokens")).alias("token")).filter("length(token) > 1"))
    own = tokens.select("id", "token").distinct()
    head = F.broadcast(heads.select(F.col("token").alias("head")))
    # The words beside which an identifier has its qualifiers.
    anchor = main.select("id", F.explode("words").alias("token")).join(head, F.col("token") == F.col("head"), "left_anti").groupBy("id").agg(F.array_sort(F.collect_set("token")).alias("anchors"))
    both = own.join(own.join(head, F.col("token") == F.col("head")).select("id", "head"), "id").filter("token <> head")
    of_name = tokens.join(head, F.col("token") == F.col("head")).select("id", "name", "head")
    together = tokens.join(of_name, ["id", "name"]).filter("token <> head").select("id", "token", "head", F.lit(True).alias("together")).distinct()
    seen = both.join(together, ["id", "token", "head"], "left").join(anchor, "id", "left")
    beside = F.get(F.filter("anchors", lambda x: x != F.col("token")), F.lit(0))
    alone = F.when(F.col("together").isNull(), beside)
    # Variants of one word mostly begin alike, so that two of them are no two words.
    seen = seen.groupBy("token", "head").agg(F.count(F.lit(1)).alias("ids"), F.count("together").alias("together"), F.count_distinct(alone).alias("swaps"), F.count_distinct(F.substring(alone, 1, 1)).alias("letters"))
    df = own.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    j = seen.join(df, "token").join(F.broadcast(df.join(head, F.col("token") == F.col("head")).select("head", F.col("df").alias("head_df"))), "head")
    abbreviates = _short_form("token", "head") | ((F.substring("token", 1, 3) == F.substring("head", 1, 3)) & (F.length("token") >= 3))
    swapped = (F.col("together") <= SPELLED_TOGETHER * F.col("ids")) & (F.col("letters") >= F.when(abbreviates, 1).otherwise(LEAST_SWAPS))
    paired = (F.col("together") >= 0.5 * F.col("df")) & (F.col("together") >= 0.5 * F.col("head_df"))
    found = j.join(F.broadcast(heads.select("token", F.lit(True).alias("is_head"))), "token", "left").withColumn("is_head", F.coalesce("is_head", F.lit(False)))
    # Most of what has a word has it for the qualifier, in part without that one.
    strong = F.col("swaps") >= F.when(abbreviates, 0.1).otherwise(0.28) * F.col("df")
    is_pair = paired & F.col("is_head")
    found = cut(found.filter(swapped & strong | is_pair).select("token", "head", "is_head", "swaps", is_pair.alias("is_pair")))
    # Heads are few (see above): their classes are united on the driver.
    strength = {r.token: r.company for r in heads.toLocalIterator()}
    root = {t: t for t in strength}

    def find(t: str) -> str:
        while root[t] != t:
            t = root[t]
        return t

    def unite(t: str, h: str) -> None:
        low, high = sorted((find(t), find(h)), key=lambda x: (strength[x], x))
        root[low] = high

    swaps: dict[str, dict[str, int]] = {}
    for r in sorted(found.filter("is_head").toLocalIterator(), key=lambda r: r.is_pair, reverse=True):
        if r.is_pair:
            unite(r.token, r.head)
        elif (strength[r.head], r.head) > (strength[r.token], r.token):
            own_classes = swaps.setdefault(r.token, {})
            own_classes[find(r.head)] = max(own_classes.get(find(r.head), 0), r.swaps)
    # A weak head joins the class it is swapped for; one that stands for several classes tells nothing.
    vague = set()
    for t, classes in sorted(swaps.items(), key=lambda x: (-strength[x[0]], x[0])):
        (h, most), *rest = sorted(classes.items(), key=lambda x: (-x[1], x[0]))
        if rest and rest[0][1] >= VAGUE * most and find(rest[0][0]) != find(h):
            vague.add(t)
        else:
            unite(t, h)
    spark = spellings.sparkSession
    known = spark.createDataFrame([(t, "" if t in vague else find(t), -1 if t in vague else strength[find(t)]) for t in sorted(strength)], "token string, class string, company long")
    others = found.filter("NOT is_head").join(F.broadcast(known.withColumnRenamed("token", "head")), "head").filter("class <> ''").groupBy("token", "class", "company").agg(F.max("swaps").alias("swaps"))
    others = others.groupBy("token").agg(F.reverse(F.array_sort(F.collect_list(F.struct("swaps", "class", "company")))).alias("c"))
    first, second = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    clear = second.isNull() | (second["swaps"] < VAGUE * first["swaps"])
    others = others.select("token", F.when(clear, first["class"]).otherwise("").alias("class"), F.when(clear, first["company"]).otherwise(-1).alias("company"))
    # Misspellings of qualifiers.
    index: dict[str, list[str]] = {}
    for t in sorted(strength):
        if len(t) >= 5:
            for v in deletions(t):
                index.setdefault(v, []).append(t)
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf(T.StringType())
    def misspelt(words: pd.Series) -> pd.Series:
        return words.map(lambda w: nearest_word(w, shared.value))

    rest = own.select("token").distinct().filter("length(token) >= 5").join(F.broadcast(known.select("token")), "token", "left_anti").join(others.select("token"), "token", "left_anti")
    typos = rest.withColumn("head", misspelt("token")).filter("head IS NOT NULL").join(F.broadcast(known.withColumnRenamed("token", "head")), "head").select("token", "class", "company")
    return cut(known.unionByName(others).unionByName(typos))


def nearest_word(word: str, index: dict[str, list[str]]) -> str | None:
    """The closest of the indexed words (by their deletions), at most one letter apart, two from eight letters on."""
    near = {h for v in deletions(word) for h in index.get(v, ())}
    limit = 2 if len(word) >= 8 else 1
    ranked = sorted((d, h) for h in near if (d := edit_distance(word, h)) <= limit)
    return ranked[0][1] if ranked else None


# --- names ------------------------------------------------------------------------------------------------------------


def name_keys(rows: DataFrame, id_: str = "vendor_id", name: str = "vendor_name") -> DataFrame:
    """(id, qualifier, words, text, n): the distinct own words under which an id is written, with its row count.

    The qualifier is that which most rows of the id have (a class before an initial, written ``e*``, before none), since single
    spellings drop or garble it. Names without own words are left out where the id has others; an id that has none at all goes
    by its words but the qualifier, else by all words in any script.
    """
    names = rows.select(F.col(id_).alias("id"), F.col(name).alias("name")).filter(~is_null_like(F.col("name")) & F.col("id").isNotNull()).groupBy("id", "name").agg(F.count(F.lit(1)).alias("n"))
    whole = names.filter(~F.col("name").contains("�"))
    names = whole.unionByName(names.join(whole.select("id").distinct(), "id", "left_anti"))
    spellings = cut(names.withColumn("p", _split("name")).select("id", "name", "n", "p.*"))
    classes = qualifier_classes(spellings)
    t = spellings.select("id", "name", F.posexplode("tokens").alias("at", "token")).join(classes, "token", "left")
    word = F.struct("at", "token")
    only = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, word))), lambda x: x["token"])
    single, known = F.col("token").rlike("^[a-z0-9]$"), F.col("class").isNotNull()
    parsed = t.groupBy("id", "name").agg(F.max(F.when(F.col("class") != "", F.struct("company", "class"))).alias("top"), only(~single & ~known).alias("own"), only(single).alias("initials"), F.collect_list(F.when(known, F.struct("at", "token", "class"))).alias("known"))
    parsed = spellings.join(parsed, ["id", "name"], "left")
    qualifier = F.when(F.col("top.class").isNotNull(), F.col("top.class")).when((F.size("initials") == 1) & (F.size("own") > 0), F.concat(F.get("initials", F.lit(0)), F.lit("*"))).otherwise("")
    # Several initials are a name ("K & G"), one goes with a given name. Without own words: the initials and what else qualifies
    # the name, else everything.
    own = F.when((F.size("own") > 0) & (F.size("initials") > 1), F.concat("own", "initials")).otherwise(F.coalesce("own", F.array().cast("array<string>")))
    other = F.transform(F.filter("known", lambda x: ~x["class"].eqNullSafe(F.col("top.class"))), lambda x: x["token"])
    spare = F.when(F.size(F.concat("initials", other)) > 0, F.concat("initials", other)).otherwise(F.col("spare"))
    parsed = cut(parsed.select("id", "n", qualifier.alias("qualifier"), own.alias("words"), F.coalesce(spare, "spare").alias("spare")))
    starred = F.col("qualifier").endswith("*")
    votes = parsed.groupBy("id", "qualifier").agg(F.sum("n").alias("n"))
    # A third of the rows with a full qualifier outweighs the rest without one.
    chosen = votes.groupBy("id").agg(F.max(F.struct((F.col("n") * F.when(F.col("qualifier") == "", 0.3).when(starred, 1.0).otherwise(3.0)).alias("w"), "qualifier")).alias("b")).select("id", "b.qualifier")
    own = parsed.filter("size(words) > 0").select("id", "words", "n")
    bare = parsed.filter("size(words) = 0").join(own.select("id").distinct(), "id", "left_anti").select("id", F.col("spare").alias("words"), "n")
    words = own.unionByName(bare).groupBy("id", F.array_sort("words").alias("words")).agg(F.sum("n").alias("n"))
    return words.join(chosen, "id").withColumn("text", F.array_join("words", " "))


def similar_texts(keys: DataFrame) -> DataFrame:
    """(text, other): pairs of different own words that meet in a band and are alike, each pair once, whatever qualifies them.

    Names that meet by chance, whose number grows as the square of that of the names, are dropped where they meet, so that
    only pairs that are nearly alike are exchanged.
    """
    band = keys.select("text").distinct().withColumn("met", _bands("text")).select("text", "met.high", "met.low", "met.size", F.explode("met.bands").alias("band"))
    pairs = band.repartition("band").sortWithinPartitions("band", "text").mapInArrow(_meet, "text string, other string").distinct()
    # A pair meets in many bands: without the mark its similarity would be taken before the pairs are made distinct.
    return pairs.filter(_monge_elkan.asNondeterministic()("text", "other") >= MIN_SIMILARITY)


def similar_keys(keys: DataFrame) -> DataFrame:
    """(key, other, q1, q2): pairs of distinct (qualifier, text) that name one entity, by alike texts and equal qualifiers.

    An initial goes with qualifiers of that first letter. Texts that are alike are expanded to keys by their qualifiers, so that
    a text under many qualifiers meets no more than its equals.
    """
    node = cut(keys.select("qualifier", "text").distinct().withColumn("key", F.xxhash64("qualifier", "text")))
    alike = cut(similar_texts(keys))
    alike = alike.unionByName(alike.select(F.col("other").alias("text"), F.col("text").alias("other")))
    right = node.select(F.col("key").alias("k2"), F.col("qualifier").alias("q2"), F.col("text").alias("other"))
    same = node.join(alike, "text").join(right.withColumn("qualifier", F.col("q2")), ["other", "qualifier"]).select("key", F.col("k2").alias("other"), F.col("qualifier").alias("q1"), "q2")
    starred = F.col("qualifier").endswith("*")
    short = node.filter(starred).withColumn("letter", F.substring("qualifier", 1, 1))
    long = right.filter("q2 <> '' AND NOT endswith(q2, '*')").withColumn("letter", F.substring("q2", 1, 1))
    itself = node.select("text", F.col("text").alias("other")).distinct()
    initial = short.join(alike.unionByName(itself), "text").join(long, ["other", "letter"]).select("key", F.col("k2").alias("other"), F.col("qualifier").alias("q1"), "q2")
    return same.filter("key < other").unionByName(initial)


def link_edges(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, node) and edges (a, b) between nodes, both ways.

    A node is a name, (qualifier, text): that which most rows of its ids have. So the ids of one name, however many, are one
    node and never pairs. Nodes are linked where an id of one has a name of the other too, and where two of their names are
    alike; an initial links to a full qualifier only where a single one is near.
    """
    keys = cut(keys.withColumn("key", F.xxhash64("qualifier", "text")))
    homes = cut(keys.groupBy("id").agg(F.max(F.struct("n", "text", "key")).alias("b")).select("id", F.col("b.key").alias("node")))
    held = keys.join(homes, "id").groupBy("key", "node").agg(F.sum("n").alias("n"))
    # A name that is no node's own belongs to the node that has it most; others that have it hang on that one.
    home = cut(held.groupBy("key").agg(F.max(F.struct((F.col("key") == F.col("node")).alias("own"), "n", "node")).alias("b")).select("key", F.col("b.node").alias("home")))
    shared = held.join(home, "key").filter("node <> home").select(F.col("node").alias("a"), F.col("home").alias("b"))
    pairs = cut(similar_keys(keys))
    starred = F.col("q1").endswith("*") & ~F.col("q2").endswith("*")
    single = pairs.filter(starred).groupBy("key").agg(F.count_distinct("q2").alias("k")).filter("k = 1").select("key")
    near = pairs.filter(~starred).select("key", "other").unionByName(pairs.filter(starred).join(single, "key").select("key", "other"))
    near = near.join(home.withColumnRenamed("home", "a"), "key").join(home.select(F.col("key").alias("other"), F.col("home").alias("b")), "other").filter("a <> b").select("a", "b")
    e = shared.unionByName(near)
    return homes, cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())


def stars(edges: DataFrame) -> DataFrame:
    """(id, star): star clustering. The id of highest degree among its open neighbours becomes a centre and takes these.

    Every member has a verified edge to its centre, so that chains of likeness fall into several stars. Ids without edge have
    no row; one whose neighbours all went elsewhere has none either. Each round every id that outranks all its open neighbours
    is a centre at once, so that the rounds follow the logarithm of the graph rather than its size; lineage is cut after each.
    """
    rank = edges.groupBy("a").agg(F.count(F.lit(1)).alias("d")).select(F.col("a").alias("id"), F.struct("d", F.col("a").alias("i")).alias("r"))
    open_edges = edges.join(rank.withColumnRenamed("id", "a").withColumnRenamed("r", "ra"), "a").join(rank.withColumnRenamed("id", "b").withColumnRenamed("r", "rb"), "b")
    open_edges = cut(open_edges.select("a", "b", "ra", "rb"))
    done = None
    while not open_edges.isEmpty():
        top = open_edges.groupBy("a").agg(F.max("rb").alias("best"), F.max("ra").alias("own"))
        centre = cut(top.filter("own > best").select(F.col("a").alias("star"), F.col("own").alias("rank")))
        member = open_edges.join(centre, open_edges.a == centre.star).groupBy("b").agg(F.max(F.struct("rank", "star")).alias("m")).select(F.col("b").alias("id"), F.col("m.star").alias("star"))
        found = cut(member.unionByName(centre.select(F.col("star").alias("id"), "star")))
        done = found if done is None else done.unionByName(found)
        gone = found.select("id")
        open_edges = cut(open_edges.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"))
    return done if done is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("star")).limit(0)


def linked_ids(rows: DataFrame, id_: str = "vendor_id", name: str = "vendor_name") -> DataFrame:
    """(id, star, size, links) of every id that shares its entity with another one.

    ``star`` is the least id of the entity, ``size`` the number of its ids and ``links`` that of verified links of the id's name
    to names of other ids, wherever these were clustered.
    """
    homes, edges = link_edges(cut(name_keys(rows, id_, name)))
    clustered = stars(edges)
    degree = edges.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("links"))
    member = homes.join(clustered.withColumnRenamed("id", "node"), "node", "left").join(degree, "node", "left").select("id", F.coalesce("star", "node").alias("node"), F.coalesce("links", F.lit(0)).alias("links"))
    member = cut(member)
    group = member.groupBy("node").agg(F.min("id").alias("star"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return member.join(group, "node").select("id", "star", "size", "links")


def linked_pairs(rows: DataFrame) -> DataFrame:
    """(vendor_id_a, vendor_id_b), a before b as strings, of all ids in one star."""
    s = cut(linked_ids(rows))
    a, b = s.select("star", F.col("id").alias("vendor_id_a")), s.select("star", F.col("id").alias("vendor_id_b"))
    return a.join(b, "star").filter("vendor_id_a < vendor_id_b").select("vendor_id_a", "vendor_id_b")
