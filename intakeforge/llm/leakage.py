"""Evaluation texts inside training texts: a generalised suffix automaton of the test items, streamed over every document."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[a-z0-9]+")
#: Characters of test text in one automaton, which take some 50 times as much memory in each worker process; more items are
#: worked through in blocks of this size, each over all documents. The rows do not depend on it.
MAX_BLOCK_CHARS = 4_000_000


def _ascii_lower(text: str) -> str:
    return text.translate(_TO_LOWER)


# Only ASCII letters change: others, such as the Kelvin sign, must not become ASCII letters.
_TO_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    """Runs of ASCII letters or digits in lower case."""
    return _WORD.findall(_ascii_lower(text or ""))


class SuffixAutomaton:
    """Generalised suffix automaton over the words of several texts.

    ``heads[state]`` is the state whose strings are the suffixes of just ``least`` words of the state's strings (or -1 if
    these are shorter); ``items[head]`` are the texts in which such a string occurs.
    """

    def __init__(self, texts: list[tuple[int, list[str]]], least: int) -> None:
        self.least = least
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        ends: list[tuple[int, int]] = []
        for item, tokens in texts:
            last = 0
            for w in tokens:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                ends.append((last, item))
        n = len(self.next)
        self.heads = [-1] * n
        for s in sorted(range(n), key=self.length.__getitem__):
            if self.length[s] >= least:
                up = self.link[s]
                self.heads[s] = self.heads[up] if up >= 0 and self.length[up] >= least else s
        found: dict[int, set[int]] = {}
        for s, item in ends:
            # Of a text's longest strings all shorter suffixes occur in it too.
            if self.heads[s] >= 0:
                found.setdefault(self.heads[s], set()).add(item)
        self.items = {s: tuple(sorted(v)) for s, v in found.items()}

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the strings of q that are one longer than those of p."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # known from an earlier text
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def stream(self, tokens: list[str]) -> Iterator[tuple[int, int, int]]:
        """(position, longest match that ends there, head) wherever the match has ``least`` words or more."""
        state = length = 0
        ids, nxt, link, lens, heads, least = self.ids, self.next, self.link, self.length, self.heads, self.least
        for k, w in enumerate(tokens):
            c = ids.get(w)
            if c is None:
                state = length = 0
                continue
            while state and c not in nxt[state]:
                state = link[state]
                length = lens[state]
            if c in nxt[state]:
                state = nxt[state][c]
                length += 1
            else:
                state = length = 0
            if length >= least:
                # Suffix links shorten the match step by step; the state of exactly ``least`` words is its head.
                yield k, length, heads[state]

    def leaks(self, tokens: list[str]) -> dict[int, list[int]]:
        """For each item found: [words covered, longest match, first word, last word] of the document."""
        out: dict[int, list[int]] = {}
        until: dict[int, int] = {}
        for k, length, head in self.stream(tokens):
            for item in self.items.get(head, ()):
                begin = k - self.least + 1
                r = out.setdefault(item, [0, 0, begin, k])
                r[0] += k - max(begin - 1, until.get(item, -1))
                until[item] = k
                r[3] = k
                # The longest match may belong to another item that shares its end; runs are counted per item.
                run = r[4] + 1 if len(r) > 4 and r[5] == k - 1 else self.least
                r[4:] = [run, k]
                r[1] = max(r[1], run)
        return {i: r[:4] for i, r in out.items()}


SCHEMA = "doc_id long, item_id long, n_words int, words_leaked int, longest int, first_word int, last_word int"


Block = tuple[str, list[tuple[int, str]]]


def _blocks(items: DataFrame, limit: int) -> Iterator[Block]:
    """Test items in blocks of bounded text, each with a digest of its own, one at a time; an item is never split."""
    block: list[tuple[int, str]] = []
    size, digest = 0, hashlib.sha256()
    for r in items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        if block and size + len(r.text) > limit:
            yield digest.hexdigest(), block
            block, size, digest = [], 0, hashlib.sha256()
        block.append((r.item_id, r.text))
        digest.update(f"{r.item_id} {len(r.text)} {r.text}".encode("utf-8", "surrogatepass"))
        size += len(r.text)
    yield digest.hexdigest(), block


def find_leaks(documents: DataFrame, items: DataFrame, least: int = 12, block_chars: int = MAX_BLOCK_CHARS) -> DataFrame:
    """Every (document, item) where the document holds ``least`` or more running words of the item.

    Output: doc_id, item_id, n_words of the document, words_leaked (covered by such runs), longest run, first and last
    word leaked. NULL or blank texts hold nothing; items shorter than ``least`` words cannot leak; repeated rows of a
    document each give their rows; items of equal text are all reported. A narrow pass per block of test items: no shuffle,
    whole documents, nothing gathered from the corpus.
    """
    sc = documents.sparkSession.sparkContext
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    result = None
    for block in _blocks(items, block_chars):
        known = sc.broadcast(block)
        part = docs.mapInArrow(_scan(known, least), SCHEMA)
        result = part if result is None else result.unionByName(part)
    return result


_AUTOMATA: dict[tuple[str, int], SuffixAutomaton] = {}


def _automaton(block: Block, least: int) -> SuffixAutomaton:
    """Built once per worker process, which serves many tasks."""
    digest, items = block
    if (digest, least) not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[digest, least] = SuffixAutomaton([(i, words(t)) for i, t in items], least)
    return _AUTOMATA[digest, least]


def _scan(known, least: int):  # noqa: ANN001, ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(known.value, least)
        for b in batches:
            rows: list[list[int]] = [[] for _ in range(7)]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                tokens = words(text)
                if len(tokens) < least:
                    continue
                for item, (covered, longest, first, last) in automaton.leaks(tokens).items():
                    for column, x in zip(rows, (doc, item, len(tokens), covered, longest, first, last)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), *[pa.array(c, pa.int32()) for c in rows[2:]]], names=["doc_id", "item_id", "n_words", "words_leaked", "longest", "first_word", "last_word"])

    return scan


def leaked_pairs(documents: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, item_id) of every leak, once each."""
    return find_leaks(documents, items, least).select("doc_id", "item_id").distinct()


Spans = list[tuple[int, int]]


def leaked_spans(automaton: SuffixAutomaton, tokens: list[str]) -> Spans:
    """(first, last) word of every stretch that leaked, whatever its item, in order; stretches that touch are one."""
    return merged((k - length + 1, k) for k, length, _ in automaton.stream(tokens))


def merged(spans: Iterable[tuple[int, int]]) -> Spans:
    out: Spans = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def without_spans(text: str, spans: Spans) -> str:
    """The text with each span of words replaced by one space; all else is kept as it is."""
    at = [m.span() for m in _WORD.finditer(_ascii_lower(text))]
    parts, keep = [], 0
    for first, last in spans:
        parts += [text[keep : at[first][0]], " "]
        keep = at[last][1]
    return "".join(parts) + text[keep:]


def remove_leaks(documents: DataFrame, items: DataFrame, least: int = 12, max_coverage: float = 0.5, block_chars: int = MAX_BLOCK_CHARS) -> DataFrame:
    """Every document with ``clean_text``: leaked spans cut out, or NULL where they cover more than ``max_coverage``.

    Output: doc_id, n_words, words_removed, clean_text. NULL texts stay NULL with no words. Text around a span is kept as
    it is, the span is replaced by one space. The spans of all blocks of test items are found in the original text, united and
    cut once, so that the result does not depend on the blocks. One block is a narrow pass; spans of several are joined to
    their documents by id and text.
    """
    sc = documents.sparkSession.sparkContext
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.withColumn("text_hash", F.sha2("text", 256))
    blocks = _blocks(items, block_chars)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.mapInArrow(_clean(sc.broadcast(first), least, max_coverage), CLEAN)
    found = keyed.filter("text IS NOT NULL").mapInArrow(_spans(sc.broadcast(first), least), SPANS)
    while second is not None:
        found = found.unionByName(keyed.filter("text IS NOT NULL").mapInArrow(_spans(sc.broadcast(second), least), SPANS))
        second = next(blocks, None)
    found = found.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    on = keyed["doc_id"].eqNullSafe(found["doc_id"]) & (keyed["text_hash"] == found["text_hash"])
    return keyed.join(found, on, "left").select(keyed["doc_id"], "text", "spans").mapInArrow(_clean(None, least, max_coverage), CLEAN)


SPANS = "doc_id long, text_hash string, spans array<struct<first:int,last:int>>"
CLEAN = "doc_id long, n_words int, words_removed int, clean_text string"
_SPAN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _spans(known, least: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(known.value, least)
        for b in batches:
            found = [leaked_spans(automaton, words(t)) for t in b.column("text").to_pylist()]
            hit = [k for k, spans in enumerate(found) if spans]
            spans = pa.array([[{"first": f, "last": t} for f, t in found[k]] for k in hit], _SPAN)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(hit, pa.int64())), b.column("text_hash").take(pa.array(hit, pa.int64())), spans], names=["doc_id", "text_hash", "spans"])

    return run


def _clean(known, least: int, max_coverage: float):  # noqa: ANN001, ANN202
    """Cuts the spans of a block, or without one those that come with the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(known.value, least) if known is not None else None
        for b in batches:
            texts = b.column("text").to_pylist()
            given = b.column("spans").to_pylist() if automaton is None else [None] * len(texts)
            counts, removed, clean = [], [], []
            for text, own in zip(texts, given):
                tokens = words(text)
                spans = leaked_spans(automaton, tokens) if automaton is not None else merged((s["first"], s["last"]) for s in own or ())
                n = sum(t - f + 1 for f, t in spans)
                counts.append(len(tokens))
                removed.append(n)
                clean.append(None if text is None or n > max_coverage * len(tokens) else without_spans(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int32()), pa.array(removed, pa.int32()), pa.array(clean, pa.string())], names=["doc_id", "n_words", "words_removed", "clean_text"])

    return run
