"""Text decoded with the wrong encoding: chains of wrong and right encodings, chosen by description length.

For every text each chain (bytes by the wrong encoding, text by the right one, applied once or more) gives a candidate. A
candidate is as long as zstandard makes it with the best of several per-language dictionaries of frequent words, plus the
cost of its chain; the shortest one wins, and the text stays as it is where that is not shorter. Texts of some 30 characters are
too short for zstandard alone, which tells whole bytes: charges for strange signs and counts of words decide with it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intakeforge.session import cut

# Letters beyond ASCII of the languages that get a dictionary of their own.
ALPHABETS = {
    "german": "äöüßÄÖÜẞ",
    "french": "àâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸ",
    "spanish": "áéíñóúüÁÉÍÑÓÚÜ",
    "portuguese": "áâãàçéêíóôõúÁÂÃÀÇÉÊÍÓÔÕÚ",
    "polish": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ",
    "czech": "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ",
    "nordic": "åäöæøÅÄÖÆØ",
}
# Signs beyond ASCII that typed texts hold of themselves.
SIGNS = "“”‘’„…–—•°±²³µ½¼¾×Ø€£§®™«»¿¡"
# Encodings that senders use, and those by which their bytes get read.
RIGHT = ["utf-8", "cp1252", "iso8859-2", "cp1250"]
WRONG = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "iso8859-15", "cp852"]
#: Bytes that a step of a chain costs: by UTF-8, whose validity is proof by itself, less than between one-byte encodings.
STEP_COST = {"utf-8": 1.0}
BYTE_STEP_COST = 1.0
#: Bytes that a character costs that no language and no typed text uses, and a capital inside a small word.
STRANGE_COST, CAPITAL_COST = 3.5, 1.5
LEAST_GAIN = 0.5
#: Texts that one task judges, each some tenths of a millisecond: their bytes say nothing about the work.
TEXTS_A_TASK = 20_000
#: Bytes that each doubling of a word's count saves: zstandard alone charges all words of a dictionary about alike.
COUNT_GAIN = 0.5
#: Words and bytes of the dictionaries, which go to every task.
MAX_WORDS, MAX_DICTIONARY_BYTES = 200_000, 1_000_000

_LETTERS = frozenset("".join(ALPHABETS.values()))
_KNOWN = _LETTERS | frozenset(SIGNS)
_CAPITAL_INSIDE = re.compile(r"[^\W\d_A-ZÀ-ÖØ-ÞĀ-Ž][^\x00-\x7f]")
_WORD = re.compile(r"\S*[^\x00-\x7f]\S*")


def to_bytes(text: str, encoding: str) -> bytes | None:
    """The bytes that ``encoding`` would read as the text. cp1252 passes its undefined bytes on, as most programs do."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if not encoding.startswith("cp125"):
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) <= 0x9F:
                return None
            out.append(ord(c))
    return bytes(out)


def steps(text: str) -> Iterator[tuple[str, str, str]]:
    """(wrong, right, candidate) of every step that undoes one wrong decoding of the text."""
    seen = {text}
    for wrong in WRONG:
        raw = to_bytes(text, wrong)
        if raw is None:
            continue
        for right in RIGHT:
            if right == wrong:
                continue
            try:
                out = raw.decode(right)
            except UnicodeDecodeError:
                continue
            if out not in seen:
                seen.add(out)
                yield wrong, right, out


def candidates(text: str, depth: int = 3) -> list[tuple[str, float, str]]:
    """(chain, cost, candidate) of all chains; only steps by UTF-8, which prove themselves, are followed further."""
    out, level = [], [("", 0.0, text)]
    for _ in range(depth):
        following = []
        for chain, cost, t in level:
            for wrong, right, fixed in steps(t):
                c = (f"{chain} {wrong}>{right}".strip(), cost + STEP_COST.get(right, BYTE_STEP_COST), fixed)
                if not any(0x7F <= ord(x) <= 0x9F for x in fixed):
                    out.append(c)  # else only a step on the way
                if right == "utf-8" and not fixed.isascii():
                    following.append(c)
        level = following
    return out


def language_of(word: str) -> list[str]:
    """Languages whose alphabet holds every letter of the word beyond ASCII; signs belong to all."""
    letters = {c for c in word if ord(c) > 127}
    if not letters <= _KNOWN:
        return []
    letters -= frozenset(SIGNS) - _LETTERS
    return [k for k, v in ALPHABETS.items() if letters <= frozenset(v)]


def build_dictionaries(counts: list[tuple[str, int]], max_bytes: int = MAX_DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw dictionaries by language, most frequent words last (where zstandard finds them most cheaply).

    A word that is valid UTF-8 under a wrong encoding, or that a chain turns into a more frequent one, is taken for garbled
    and left out.
    """
    known = dict(counts)
    content: dict[str, list[bytes]] = {k: [] for k in ALPHABETS}
    size = dict.fromkeys(ALPHABETS, 0)
    for word, n in counts:
        languages = language_of(word)
        if not languages or any(">utf-8" in chain or known.get(fixed, 0) > n for chain, _, fixed in candidates(word, 2)):
            continue
        raw = word.encode() + b" "
        for k in languages:
            if size[k] + len(raw) <= max_bytes:
                content[k].append(raw)
                size[k] += len(raw)
    return {k: b"".join(reversed(v)) for k, v in content.items() if v}


class Describer:
    """Description lengths by per-language dictionaries; made once per worker."""

    def __init__(self, dictionaries: dict[str, bytes], counts: dict[str, int]) -> None:
        params = dict(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=3, strategy=zstandard.STRATEGY_BTULTRA2, window_log=21)
        self.packers = []
        for raw in dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(12, dict_size=len(raw), **params)
            d.precompute_compress(compression_params=p)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
        if not self.packers:
            self.packers.append(zstandard.ZstdCompressor(level=12))
        self.counts = counts
        #: Counts of the words of the text at hand that ``counts`` lacks.
        self.rare: dict[str, int] = {}

    def count(self, word: str) -> int:
        return self.counts.get(word) or self.rare.get(word, 0)

    def length(self, text: str) -> float:
        """Bytes of the text by its best dictionary, more for strange characters and capitals inside small words, less for
        frequent words."""
        raw = text.encode("utf-8", "surrogatepass")
        strange = sum(ord(c) > 127 and c not in _KNOWN for c in text)
        capitals = sum(m.group()[1].isupper() for m in _CAPITAL_INSIDE.finditer(text))
        seen = sum(math.log2(1 + self.count(w)) for w in _WORD.findall(text))
        return min(len(p.compress(raw)) for p in self.packers) + STRANGE_COST * strange + CAPITAL_COST * capitals - COUNT_GAIN * seen

    def sound(self, old: str, new: str, chain: str) -> bool:
        """The exact check of a chosen chain: UTF-8 proves itself; else the new words have to be the more frequent ones."""
        if ">utf-8" in chain:
            return True
        a, b = _WORD.findall(old), _WORD.findall(new)
        before = sum(self.count(w) for w in a)
        after = sum(self.count(w) for w in b)
        strange = any(ord(c) > 127 and c not in _KNOWN for c in old)
        return after > 2 * before or strange and after >= before

    def repair(self, text: str) -> tuple[str, str]:
        """(chain, text as written); no chain where the text is best as it is."""
        found = candidates(text)
        if not found:
            return "", text
        best, chain, out = self.length(text) - LEAST_GAIN, "", text
        for c, cost, fixed in found:
            if (n := self.length(fixed) + cost) < best and self.sound(text, fixed, c):
                best, chain, out = n, c, fixed
        return chain, out


_DESCRIBERS: dict[int, Describer] = {}


def all_word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of every word beyond ASCII over all texts (text, n)."""
    w = texts.select(F.explode(F.split("text", r"\s+")).alias("word"), "n").filter(F.col("word").rlike(r"[^\x00-\x7F]") & ~F.col("word").contains("�"))
    return w.groupBy("word").agg(F.sum("n").alias("n"))


def word_counts(texts: DataFrame, limit: int = MAX_WORDS) -> list[tuple[str, int]]:
    """Words beyond ASCII with their counts over all texts (text, n); the ``limit`` most frequent ones are kept."""
    rows = all_word_counts(texts).orderBy(F.desc("n"), "word").limit(limit)
    return [(r.word, r.n) for r in rows.toLocalIterator()]


def rare_counts(texts: DataFrame, known: Broadcast) -> DataFrame:
    """(text, rare): counts of the words of each text and of its candidates that are not among the ``known`` ones.

    The known ones are the most frequent, so that no word that is joined here is a hot one.
    """

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = known.value[1]
        for b in batches:
            out = [(t, w) for t in b.column("text").to_pylist() if "�" not in t for w in {w for x in (t, *(c for _, _, c in candidates(t))) for w in _WORD.findall(x) if w not in counts}]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([w for _, w in out], pa.string())], names=["text", "word"])

    need = texts.select("text").mapInArrow(unknown, "text string, word string")
    return need.join(all_word_counts(texts), "word").groupBy("text").agg(F.collect_list(F.struct("word", "n")).alias("rare"))


def suspicious(c: Column) -> Column:
    """A text of ASCII alone holds no trace of a wrong decoding."""
    return c.rlike(r"[^\x00-\x7F]")


def find_garbled(rows: DataFrame, key: str = "line_id", columns: tuple[str, ...] = ("description", "vendor_name"), max_words: int = MAX_WORDS) -> DataFrame:
    """Every cell that is the result of a wrong decoding: key, column_name, text, chain, restored.

    ``restored`` is NULL where characters were lost (U+FFFD). NULL, blank and ASCII cells are never found; repeated rows each
    give a row. Each distinct text is judged once: a hot text costs one row after the map side, and only garbled ones, which
    are few, are joined back. The dictionaries are bounded by ``max_words`` and their bytes; word counts are exact: of words
    beyond that bound they are joined to the texts that need them.
    """
    cells = rows.select(key, *columns).unpivot([key], list(columns), "column_name", "text").filter(suspicious(F.col("text")))
    texts = cut(cells.groupBy("text").agg(F.count(F.lit(1)).alias("n")))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-texts.count() // TEXTS_A_TASK))
    counts = word_counts(texts, max_words + 1)
    whole, counts = len(counts) <= max_words, counts[:max_words]
    known = rows.sparkSession.sparkContext.broadcast((build_dictionaries(counts), dict(counts)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = _DESCRIBERS.get(id(known.value))
        if describer is None:
            _DESCRIBERS.clear()
            describer = _DESCRIBERS[id(known.value)] = Describer(*known.value)
        for b in batches:
            texts, chains, fixed = [], [], []
            for t, rare in zip(b.column("text").to_pylist(), b.column("rare").to_pylist()):
                describer.rare = {r["word"]: r["n"] for r in rare or ()}
                if "�" in t:
                    chain, out = "lost", None
                else:
                    chain, out = describer.repair(t)
                if chain:
                    texts.append(t)
                    chains.append(chain)
                    fixed.append(out)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(chains, pa.string()), pa.array(fixed, pa.string())], names=["text", "chain", "restored"])

    if whole:
        judged = texts.select("text", F.lit(None).cast("array<struct<word:string,n:bigint>>").alias("rare"))
    else:
        judged = texts.select("text").join(rare_counts(texts, known), "text", "left")
    found = judged.repartition(tasks).mapInArrow(judge, "text string, chain string, restored string")
    return cells.join(found, "text").select(key, "column_name", "text", "chain", "restored")


def garbled_cells(rows: DataFrame) -> DataFrame:
    """(line_id, column_name) of the garbled cells."""
    return find_garbled(rows).select("line_id", "column_name")
