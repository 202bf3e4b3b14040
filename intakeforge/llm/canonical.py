"""Free-entered values mapped to a reference list: tokens repaired by edit distance, entries ranked by soft TF-IDF."""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeforge.functions.names import fold
from intakeforge.session import cut

NONE = "(none)"
#: A reference entry counts as so many decided rows.
SPEC_WEIGHT = 1_000_000
#: Greatest rate of one misspelling against its word: of words of the reference list, and of other words.
LIST_TYPO_RATE, TYPO_RATE = 1 / 12, 1 / 24
#: A word without which so large a share of the wordings that hold it mean the same says nothing of its own, if so many times
#: as many mean the same as mean something else.
EMPTY_SHARE, EMPTY_ODDS = 0.5, 8
MIN_SCORE = 0.72
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_DIGIT = re.compile(r"(?<=[A-Za-z])[01]|[01](?=[A-Za-z])")
_PIECE = re.compile(r"[A-Za-z0-9]+")


def tokens_of(value: str | None) -> list[str]:
    """Lower-case words of a typed value: accents, camel case and digits read for letters undone; none is dropped."""
    found: list[str] = []
    for piece in _PIECE.findall(fold(value or "")):
        if piece.upper() == piece:
            piece = piece.lower()
        previous = None
        while previous != piece:
            previous = piece
            piece = _DIGIT.sub(lambda m: "o" if m.group() == "0" else "l", piece)
        found += _CAMEL.sub(" ", piece).lower().split()
    return found


def deletions(token: str) -> list[str]:
    """The token, and what is left after one deletion (two for six letters or more): close tokens share one of these."""
    out = {token}
    if len(token) >= 3:
        level = {token}
        for _ in range(2 if len(token) >= 6 else 1):
            level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
            out |= level
    return sorted(out)


def edit_distance(a: str, b: str, limit: int = 3) -> int:
    """Insertions, deletions, replacements and swaps of neighbours (each once), up to ``limit``."""
    if abs(len(a) - len(b)) >= limit:
        return limit
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and i > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            nxt.append(d)
        if min(nxt) >= limit:
            return limit
        before, row = row, nxt
    return min(row[-1], limit)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(v: pd.Series) -> pd.Series:
    return v.map(tokens_of)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _deletions(v: pd.Series) -> pd.Series:
    """Hashes of the `deletions`, which are shorter to join; what meets is compared letter by letter anyway."""
    return v.map(lambda t: [xxhash.xxh64_intdigest(d) - (1 << 63) for d in deletions(t)])


@F.pandas_udf(T.IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x, y) for x, y in zip(a, b)], dtype="int32")


def is_short_form(token: str, word: str) -> bool:
    """Whether the token abbreviates the word: same first letter, its letters in order in the word, and clearly shorter."""
    if not token or not word or token[0] != word[0] or len(token) < 2 or len(word) < len(token) + 2:
        return False
    rest = iter(word)
    return all(c in rest for c in token)


@F.pandas_udf(T.BooleanType())
def _short_form(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([is_short_form(x, y) for x, y in zip(a, b)], dtype=bool)


def _same_digits(a: str, b: str) -> Column:
    """Other digits are another thing, never a misspelling."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    return digits(a) == digits(b)


def short_forms(tokens: DataFrame, listed: DataFrame) -> DataFrame:
    """(token, long): tokens that abbreviate a word of ``listed`` (long), see `is_short_form`.

    An abbreviation begins with a letter sequence of its word, so that both meet by their first three letters in order (two of
    a token of two) and no token meets all words of its letter.
    """
    t = tokens.filter("length(token) >= 2").withColumn("start", F.substring("token", 1, 3))
    n = F.length("long")
    at = lambda i: F.substring("long", i, F.lit(1))
    two = F.transform(F.sequence(F.lit(2), n), lambda i: F.concat(at(F.lit(1)), at(i)))
    three = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.concat(at(F.lit(1)), at(i), at(j)))))
    w = listed.filter("length(long) >= 4").withColumn("start", F.explode(F.array_distinct(F.concat(two, three))))
    j = t.hint("merge").join(w, "start").drop("start")
    return j.filter(F.length("long") >= F.length("token") + 2).filter(_short_form("token", "long"))


def _near_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, repaired): the best close word of each of ``tokens`` (token, n) among ``words`` (token, n, spec), where there is one."""
    left = tokens.filter(F.length("token") >= 3).select("token", F.explode(_deletions("token")).alias("variant"))
    right = words.filter(F.length("token") >= 3).select(F.col("token").alias("word"), F.explode(_deletions("token")).alias("variant"))
    # Sizes are estimated before the variants are exploded, so that neither side may be broadcast by them.
    pairs = left.hint("merge").join(right, "variant").filter((F.col("token") != F.col("word")) & (F.abs(F.length("token") - F.length("word")) <= F.when(F.length("token") >= 6, 2).otherwise(1))).select("token", "word").distinct()
    pairs = pairs.filter(_same_digits("token", "word")).withColumn("distance", _distance("token", "word")).filter(F.col("distance") <= F.when(F.length("token") >= 6, 2).otherwise(1))
    pairs = pairs.join(tokens.select("token", "n"), "token").join(words.select(F.col("token").alias("word"), F.col("n").alias("word_n"), F.col("spec").alias("word_spec")), "word")
    expected = F.col("word_n") * F.when(F.col("word_spec") > 0, LIST_TYPO_RATE).otherwise(TYPO_RATE)
    pairs = pairs.filter((F.col("n") == 0) | (F.col("n") <= expected + 2 * F.sqrt(expected)))
    return pairs.groupBy("token").agg(F.min(F.struct("distance", (-F.col("word_spec")).alias("s"), (-F.col("word_n")).alias("k"), "word")).alias("b")).select("token", F.col("b.word").alias("repaired"))


def token_repairs(counts: DataFrame) -> DataFrame:
    """(token, repaired, known): every token of (token, n, spec), led to a close word of the vocabulary where it is none itself.

    Close means distance 1 (2 from six letters on). Words of the reference list stay; others give way to a close word whose
    misspelling they can be by their counts among decided values: no more than the greatest rate of one misspelling yields,
    within two standard deviations. So only shares count in a long history, and small counts are no proof in a short one. A
    token that no decision holds gives way to any word that stays. The join is on shared deletions, so no token meets all others.
    """
    # A short token that abbreviates a word of the list is no misspelling of another short word.
    short = short_forms(counts.filter("spec = 0 AND length(token) <= 4").select("token"), counts.filter("spec > 0").select(F.col("token").alias("long"))).select("token").distinct()
    open_ = counts.filter("spec = 0").join(short, "token", "left_anti")
    # Rarer words cannot have a misspelling that was decided.
    decided = cut(_near_words(open_.filter("n > 0"), counts.filter("spec > 0 OR n > 2")))
    stays = counts.filter("spec > 0 OR n > 0").join(decided.select("token"), "token", "left_anti")
    best = decided.unionByName(_near_words(open_.filter("n = 0"), stays))
    return counts.join(best, "token", "left").select("token", F.coalesce("repaired", "token").alias("repaired"), ((F.col("spec") > 0) | (F.col("n") > 0)).alias("known"))


def _phrases(values: DataFrame, repairs: DataFrame) -> DataFrame:
    """Adds ``phrase``, the sorted repaired words of a distinct value, to (scope, value, tokens)."""
    t = values.select("scope", "value", F.explode("tokens").alias("token"))
    return t.join(repairs.select("token", "repaired"), "token").groupBy("scope", "value").agg(F.array_sort(F.collect_set("repaired")).alias("phrase"))


def empty_words(voted: DataFrame) -> DataFrame:
    """(word): words that say nothing of their own, as the history shows: of the wordings that hold one, most are known without
    it too and mean the same, and hardly any means something else. Words of the reference list always say something."""
    t = voted.filter("size(phrase) > 1").select("scope", "phrase", "target", F.explode("phrase").alias("word"))
    t = t.withColumn("rest", F.array_remove("phrase", F.col("word")))
    without = voted.select("scope", F.col("phrase").alias("rest"), F.col("target").alias("other"))
    seen = t.join(without, ["scope", "rest"], "left").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target") == F.col("other")).alias("same"), F.count_if(F.col("target") != F.col("other")).alias("different"))
    listed = voted.filter(F.col("n") >= SPEC_WEIGHT).select(F.explode("phrase").alias("word")).distinct()
    return seen.filter((F.col("same") >= EMPTY_SHARE * F.col("n")) & (F.col("same") >= EMPTY_ODDS * F.col("different"))).select("word").join(listed, "word", "left_anti")


def _without(phrases: DataFrame, empty: DataFrame) -> DataFrame:
    """The phrases without ``empty`` words, where others are left."""
    t = phrases.select("scope", "value", F.explode("phrase").alias("word")).join(empty.withColumn("is_empty", F.lit(True)), "word", "left")
    g = t.groupBy("scope", "value").agg(F.array_sort(F.collect_set(F.when(F.col("is_empty").isNull(), F.col("word")))).alias("own"), F.array_sort(F.collect_set("word")).alias("all"))
    return g.select("scope", "value", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("all")).alias("phrase"))


def _letters(values: DataFrame, tokens: DataFrame) -> DataFrame:
    """(scope, value, letters, all_known): the tokens of a value run together, those that say nothing left out."""
    t = values.select("scope", "value", F.posexplode("tokens").alias("at", "token")).join(tokens, "token")
    g = t.groupBy("scope", "value").agg(F.array_sort(F.collect_list(F.struct("at", "token", "empty"))).alias("all"), F.min("known").alias("all_known"))
    own = F.filter("all", lambda x: ~x["empty"])
    return g.select("scope", "value", F.array_join(F.transform(F.when(F.size(own) > 0, own).otherwise(F.col("all")), lambda x: x["token"]), "").alias("letters"), "all_known")


def _vote(reference: DataFrame, phrases: DataFrame) -> DataFrame:
    """(scope, phrase, target, n): of one wording the reference list counts before decisions, the more frequent decision before
    the others."""
    votes = reference.drop("tokens").join(phrases, ["scope", "value"]).groupBy("scope", "phrase", "target").agg(F.sum("n").alias("n"))
    return votes.groupBy("scope", "phrase").agg(F.max(F.struct("n", F.col("target"))).alias("b")).select("scope", "phrase", F.col("b.target").alias("target"), F.col("b.n").alias("n"))


def learned_synonyms(voted: DataFrame) -> DataFrame:
    """(scope, word, other, sim): words that stand for each other, among the decided wordings and the reference list.

    Where a decided wording and a reference label of one target differ by one word each, the two words say the same; between
    two words of the list that has to hold for two targets. Every decided wording meets the few labels of its target only.
    """
    known = voted.filter(F.col("target") != NONE)
    spec = known.filter(F.col("n") >= SPEC_WEIGHT).select("scope", "target", F.col("phrase").alias("label"))
    words = spec.select("scope", F.explode("label").alias("other")).distinct()
    pairs = known.select("scope", "target", "phrase").join(spec, ["scope", "target"]).withColumn("a", F.array_except("phrase", "label")).withColumn("b", F.array_except("label", "phrase"))
    pairs = pairs.filter("size(a) = 1 AND size(b) = 1 AND size(label) > 1").select("scope", "target", F.get("a", F.lit(0)).alias("word"), F.get("b", F.lit(0)).alias("other"))
    support = pairs.groupBy("word", "other").agg(F.count_distinct("scope", "target").alias("targets"))
    listed = words.select(F.col("other").alias("word")).distinct().withColumn("listed", F.lit(True))
    support = support.join(listed, "word", "left").filter((F.col("targets") >= 2) | F.col("listed").isNull()).select("word", "other")
    return support.unionByName(support.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct().withColumn("sim", F.lit(0.9))


def map_values(queries: DataFrame, entries: DataFrame, history: DataFrame) -> DataFrame:
    """The entry meant by each distinct query, with its score and how it was found.

    ``queries``: (scope, value); ``entries``: (scope, label, target), the reference list with its aliases; ``history``:
    (scope, value, target) of decided values, target NULL where none was meant. Output: (scope, value, target, score, how),
    target ``(none)`` where no entry is meant. NULL or blank values are meant for none. Labels that stand for several targets
    go to the most often decided one, then the first by name. Values are counted and joined once each, however often they
    occur.
    """
    asked = queries.filter("scope IS NOT NULL AND value IS NOT NULL").select("scope", "value").distinct()
    known = entries.filter("scope IS NOT NULL AND label IS NOT NULL AND target IS NOT NULL").select("scope", F.col("label").alias("value"), "target").distinct().withColumn("n", F.lit(SPEC_WEIGHT).cast("long"))
    decided = history.filter("scope IS NOT NULL AND value IS NOT NULL").groupBy("scope", "value", F.coalesce("target", F.lit(NONE)).alias("target")).agg(F.count(F.lit(1)).alias("n"))
    reference = cut(known.unionByName(decided).withColumn("tokens", _tokens("value")))
    asked = cut(asked.withColumn("tokens", _tokens("value")))

    weight = F.when(F.col("n") >= SPEC_WEIGHT, 0).otherwise(F.col("n"))
    spoken = reference.select(F.explode(F.array_distinct("tokens")).alias("token"), weight.alias("n"), (F.col("n") >= SPEC_WEIGHT).cast("int").alias("spec"))
    heard = asked.select(F.explode(F.array_distinct("tokens")).alias("token"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("spec"))
    counts = cut(spoken.unionByName(heard).groupBy("token").agg(F.sum("n").alias("n"), F.max("spec").alias("spec")))
    repairs = cut(token_repairs(counts))

    rp = _phrases(reference.select("scope", "value", "tokens").distinct(), repairs)
    empty = cut(empty_words(cut(_vote(reference, rp))))
    voted = cut(_vote(reference, _without(rp, empty)))
    q = cut(_without(_phrases(asked, repairs), empty))
    # Wordings are far fewer than values: each is ranked once.
    ranked = cut(soft_tfidf(q.select("scope", "phrase").distinct(), voted))
    found = q.join(ranked, ["scope", "phrase"]).drop("phrase")
    open_ = q.join(ranked.filter(F.col("score") >= 1).select("scope", "phrase").distinct(), ["scope", "phrase"], "left_anti")

    # Written together, or with a word too many letters apart: whole wordings by edit distance of their letters. Where all
    # words are known ones, different letters rather mean different words.
    full = repairs.join(empty.select(F.col("word").alias("repaired"), F.lit(True).alias("empty")), "repaired", "left").select("token", "known", F.col("empty").isNotNull().alias("empty"))
    in_order = cut(_letters(asked.join(open_.select("scope", "value"), ["scope", "value"]), full))
    spelled = _letters(reference.select("scope", "value", "tokens").distinct(), full).join(reference.drop("tokens"), ["scope", "value"])
    spelled = spelled.groupBy("scope", F.col("letters").alias("word"), "target").agg(F.sum("n").alias("n"))
    spelled = cut(spelled.groupBy("scope", "word").agg(F.max(F.struct("n", "target")).alias("b")).select("scope", "word", F.col("b.target").alias("target"), F.col("b.n").alias("n")))
    variants = lambda df, c: df.select("scope", c).distinct().select("scope", c, F.explode(_deletions(c)).alias("v")).select("scope", c, F.xxhash64("scope", "v").alias("variant"))
    met = variants(in_order, "letters").hint("merge").join(variants(spelled, "word").withColumnRenamed("scope", "other"), "variant").filter("scope = other")
    met = met.filter((F.length("letters") >= 4) & (F.abs(F.length("letters") - F.length("word")) <= 2)).select("scope", "letters", "word").distinct().withColumn("distance", _distance("letters", "word"))
    near = in_order.join(met, ["scope", "letters"]).join(spelled, ["scope", "word"])
    near = near.filter(_same_digits("letters", "word") & (F.length("letters") >= 4) & (F.col("distance") <= F.when(F.length("letters") >= 8, 2).otherwise(1)))
    near = near.select("scope", "value", "target", "n", (F.lit(0.999) - F.when(F.col("all_known"), 2).otherwise(1) * F.col("distance") / F.length("letters")).alias("score"), F.lit("letters").alias("how"))

    best = near.filter(F.col("score") >= MIN_SCORE).unionByName(found).groupBy("scope", "value").agg(F.max(F.struct("score", "n", "target", "how")).alias("b")).select("scope", "value", F.col("b.target").alias("target"), F.col("b.score").alias("score"), F.col("b.how").alias("how"))
    return queries.filter("scope IS NOT NULL AND value IS NOT NULL").select("scope", "value").distinct().join(best, ["scope", "value"], "left").select("scope", "value", F.coalesce("target", F.lit(NONE)).alias("target"), "score", F.coalesce("how", F.lit("unmatched")).alias("how"))


def soft_tfidf(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Scores of distinct (scope, phrase) against (scope, phrase, target, n): soft cosine of IDF weights, 1 for equal wordings.

    Output: scope, phrase, target, n, score, how; the best entry of each target only, and those that score too little are left out.

    Misspelt words were repaired before; words that stand for each other (`learned_synonyms`) and abbreviations of reference
    words count in part. IDF counts wordings; a word that nothing in the scope is close to weighs most, so that a value with a
    word of its own is no near match. A near wording that few decisions hold counts a little less than one that many do.
    """
    e = entries.withColumn("id", F.sha2(F.concat_ws(" ", "scope", F.array_join("phrase", " ")), 256))
    et = e.select("scope", "id", "target", "n", F.size("phrase").alias("size"), F.explode("phrase").alias("other"))
    sizes = e.groupBy("scope").agg(F.count(F.lit(1)).alias("total"))
    idf = cut(et.groupBy("scope", "other").agg(F.count(F.lit(1)).alias("df")).join(sizes, "scope").select("scope", "other", F.log1p(F.col("total") / F.col("df")).alias("ew")))
    et = et.join(idf, ["scope", "other"])
    norms = et.groupBy("scope", "id").agg(F.sum(F.col("ew") * F.col("ew")).alias("en2"))

    q = queries.select("scope", F.col("phrase").alias("value"), F.size("phrase").alias("qsize"), F.explode("phrase").alias("word"))
    asked = q.select("scope", "word").distinct()
    same = asked.join(idf.withColumn("word", F.col("other")), ["scope", "word"]).select("scope", "word", "other", "ew", F.lit(1.0).alias("sim"))
    alike = asked.join(learned_synonyms(entries), "word").join(idf, ["scope", "other"]).select("scope", "word", "other", "ew", "sim")
    spec = entries.filter(F.col("n") >= SPEC_WEIGHT).select("scope", F.explode("phrase").alias("other")).distinct().join(idf, ["scope", "other"])
    short = short_forms(asked.select(F.col("word").alias("token")).distinct(), spec.select(F.col("other").alias("long")).distinct())
    short = asked.join(short.withColumnsRenamed({"token": "word", "long": "other"}), "word").join(spec, ["scope", "other"]).select("scope", "word", "other", "ew", F.lit(0.85).alias("sim"))
    close = same.unionByName(alike).unionByName(short).groupBy("scope", "word", "other", "ew").agg(F.max("sim").alias("sim"))
    close = cut(close)
    # The weight of a word is that of the word it is taken for.
    weights = close.groupBy("scope", "word").agg(F.max(F.struct("sim", "ew")).alias("b")).select("scope", "word", F.col("b.ew").alias("w"))
    qt = q.join(weights, ["scope", "word"], "left").join(sizes, "scope").withColumn("w", F.coalesce("w", F.log1p(F.col("total").cast("double"))))
    whole = Window.partitionBy("scope", "value")
    heavier = whole.orderBy(F.desc("w"), "word").rowsBetween(Window.unboundedPreceding, -1)
    qt = qt.withColumn("qn2", F.sum(F.col("w") * F.col("w")).over(whole)).withColumn("before", F.coalesce(F.sum(F.col("w") * F.col("w")).over(heavier), F.lit(0.0))).select("scope", "value", "word", "w", "qsize", "qn2", "before")
    alike = cut(qt.join(close, ["scope", "word"]))
    # An entry that scores enough shares one of the heaviest words, those without which too little weight is left.
    chosen = alike.filter(F.col("before") <= (1 - MIN_SCORE**2) * F.col("qn2")).join(et.select("scope", "other", "id"), ["scope", "other"]).select("scope", "value", "id").distinct()
    hits = chosen.join(et.select("scope", "id", "other", "size", "target", "n"), ["scope", "id"]).join(alike.drop("before"), ["scope", "value", "other"])
    once = [F.first(c).alias(c) for c in ("qn2", "qsize", "size", "target", "n")]
    per_word = hits.groupBy("scope", "value", "id", "word").agg(F.max(F.col("sim") * F.col("w") * F.col("ew")).alias("part"), F.max(F.col("word") == F.col("other")).alias("is_same"), *once)
    dots = per_word.groupBy("scope", "value", "id").agg(F.sum("part").alias("dot"), F.count_if("is_same").alias("shared"), *once)
    equal = (F.col("shared") == F.col("qsize")) & (F.col("shared") == F.col("size"))
    sure = F.when(F.col("n") >= SPEC_WEIGHT, 1.0).otherwise(1 - 0.1 / F.col("n"))
    score = F.when(equal, 1.0).otherwise(F.least(F.lit(0.998), sure * F.col("dot") / F.sqrt(F.col("qn2") * F.col("en2"))))
    scored = dots.join(norms, ["scope", "id"]).withColumn("score", score).filter(F.col("score") >= MIN_SCORE)
    best = scored.groupBy("scope", "value", "target").agg(F.max(F.struct("score", "n")).alias("b"))
    return best.select("scope", F.col("value").alias("phrase"), "target", "b.n", "b.score", F.lit("words").alias("how"))


def map_proposals(proposals: DataFrame, feeds: DataFrame, specs: DataFrame) -> DataFrame:
    """(proposal_id, typed, target_field, score, how) of every proposed or overridden row.

    The typed value is target_field, else source_column. The reference list is the feed's schema with its aliases; accepted and
    demoted rows are the decided history. A row without feed, or with nothing typed, is meant for no field.
    """
    schema = feeds.filter("feed_id IS NOT NULL").groupBy("feed_id").agg(F.max("schema_name").alias("scope"))
    rows = proposals.select("proposal_id", "feed_id", "source_column", "target_field", "status").join(schema, "feed_id", "left")
    history = rows.filter("status = 'accepted' AND target_field IS NOT NULL OR status = 'demoted'").select("scope", F.col("source_column").alias("value"), F.when(F.col("status") == "accepted", F.col("target_field")).alias("target"))
    entries = specs.select(F.col("schema_name").alias("scope"), F.col("field_name").alias("target"), F.explode(F.concat(F.array("field_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("label"))
    asked = rows.filter("status IN ('proposed', 'overridden')").select("proposal_id", "scope", F.coalesce("target_field", "source_column").alias("value"))
    found = map_values(asked.select("scope", "value"), entries, history)
    return asked.join(found, ["scope", "value"], "left").select("proposal_id", F.col("value").alias("typed"), F.coalesce("target", F.lit(NONE)).alias("target_field"), "score", F.coalesce("how", F.lit("unmatched")).alias("how"))


