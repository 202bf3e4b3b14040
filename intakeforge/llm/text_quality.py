"""Per-document text statistics and the kind of a text: prose, list, table or junk.

Every line gets a kind from its neighbours: tables by delimiters or column gaps that align vertically over several lines,
lists by the period with which line edges of one make come back, or indents do (line-length autocorrelation tells these from
wrapped prose), junk by words, symbols and repetition. The kind that holds most of the text is the kind of the document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The list of frequent words is sent to every task; a longer one is an error, not a cut.
MAX_COMMON_WORDS = 100_000
KINDS = ("prose", "list", "table", "junk")

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TOKEN = re.compile(r"\S+")
#: Beyond ASCII: symbols, and digits.
_WIDE_SYMBOL, _WIDE_DIGIT = re.compile(r"[^\x00-\x7f\w\s]"), re.compile(r"(?![0-9])\d")
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_HEXDUMP = re.compile(r"^\s*[0-9a-fA-F]{4,16}[: ]\s*(?:[0-9a-fA-F]{2}\s+){3,}")
_RULER = re.compile(r"^\s*([^\w\s])\1{4,}\s*$")
_BORDER = re.compile(r"^\s*[+|][-+=|: ]{2,}[+|]\s*$")
_SENTENCE_END = re.compile(r"[.!?…:;,]['\"”’)\]]*\s*$")
_MARKUP = re.compile(r"&[a-z]{2,6};|</?[a-z]+ ?/?>|\\u[0-9a-f]{4}|%[0-9A-F]{2}|\{\{|\}\}")
_GAP = re.compile(r"\S(\s{2,})(?=\S)")
#: Delimiters of tables; a comma also stands in prose, so its alignment has to be on several cells.
_DELIMITERS = (("|", 1), ("\t", 1), (";", 1), (",", 2))


def dense_length(text: str) -> int:
    """Characters that are no white space."""
    return sum(map(len, text.split()))


def count_symbols(text: str) -> int:
    """Characters that are no letters, digits and white space; underscores count. ASCII signs are counted one by one, which is
    far faster than to match them."""
    n = sum(map(text.count, _SIGNS))
    return n if text.isascii() else n + len(_WIDE_SYMBOL.findall(text))


def count_digits(text: str) -> int:
    n = sum(map(text.count, "0123456789"))
    return n if text.isascii() else n + len(_WIDE_DIGIT.findall(text))


def autocorrelation(lengths: list[int], lag: int) -> float:
    """Of the line lengths; 1 where all are equal, 0 where there are too few."""
    n = len(lengths)
    if n <= lag + 1:
        return 0.0
    mean = sum(lengths) / n
    var = sum((x - mean) ** 2 for x in lengths)
    if var == 0:
        return 1.0
    return sum((lengths[i] - mean) * (lengths[i + lag] - mean) for i in range(n - lag)) / var


def least_period(values: list) -> int:
    """Least number of places after which all values repeat, 0 where none does within half their number (prefix function)."""
    n = len(values)
    back = [0] * n
    for i in range(1, n):
        k = back[i - 1]
        while k and values[i] != values[k]:
            k = back[k - 1]
        back[i] = k + (values[i] == values[k])
    p = n - back[-1] if n else 0
    return p if 0 < p <= n // 2 else 0


def indentation_period(lines: list[str]) -> int:
    """Least period after which the indents repeat, 0 where they don't, there are too few lines or there is no indent."""
    indents = [len(x) - len(x.lstrip()) for x in lines]
    return least_period(indents) if len(indents) >= 4 and any(indents) else 0


def opening(line: str) -> str | None:
    """The make of a line's first sign group: letters as ``a``, digits as ``9``, other signs as they are; None for a plain word.

    A group is signs alone, or one short run of letters or digits that signs end or enclose: ``-``, ``9.``, ``(a)``, ``[]``.
    A letter ``o`` that stands alone is a typed bullet.
    """
    line = line.lstrip()
    if line[:1] == "[" and "]" in line[1:3]:
        return "[]"
    first, _, rest = line.partition(" ")
    if not rest.strip() or len(first) > 6:
        return None
    core = first.strip("().]:")
    if not any(c.isalnum() for c in first):
        return first
    if first == "o":
        return first
    if core.isalnum() and core != first and first[-1] in ").:]" and (core.isdigit() and len(core) <= 3 or len(core) == 1 or len(core) <= 4 and not core.lower().strip("ivxlc")):
        return first.replace(core, "9" if core.isdigit() else "a", 1)
    return None


def closing(line: str) -> str | None:
    """The make of a line's end: ``;``, or a number after a colon or an equals sign; None for any other."""
    line = line.rstrip()
    if line.endswith(";"):
        return ";" if len(line) < 120 else None
    head, sign, tail = line.rpartition(":" if ":" in line else "=")
    tail = tail.strip().lstrip("+-").removesuffix("%").rstrip().replace(",", "").replace(".", "")
    return ": 9" if sign and tail.isdigit() and head.strip() and len(head) < 200 else None


def periodic(keys: list[str | None], least: int) -> list[bool]:
    """Lines whose make comes back with its period, ``least`` times or more; with a period above 1 the lines between as well.

    The period of a make is the most frequent distance of one of its lines to the next (the shortest of these on ties).
    """
    places: dict[str, list[int]] = {}
    for i, k in enumerate(keys):
        if k is not None:
            places.setdefault(k, []).append(i)
    out = [False] * len(keys)
    for own in places.values():
        if len(own) < least:
            continue
        gaps = Counter(b - a for a, b in zip(own, own[1:]))
        period = min(gaps, key=lambda g: (-gaps[g], g))
        run = [own[0]]
        for a, b in zip(own, [*own[1:], -1]):
            if b - a == period:
                run.append(b)
                continue
            if len(run) >= (least if period == 1 else max(3, least)):
                for i in range(run[0], run[-1] + 1):
                    out[i] = True
            run = [b]
    return out


def table_lines(lines: list[str]) -> list[bool]:
    """Lines inside a run of three or more with aligned delimiters or column gaps."""
    n = len(lines)
    out = [bool(_BORDER.match(x)) for x in lines]
    for d, least in _DELIMITERS:
        counts = [x.count(d) for x in lines]
        i = 0
        while i < n:
            j = i
            while j < n and (counts[j] == counts[i] >= least or (j > i and _BORDER.match(lines[j]))):
                j += 1
            if j - i >= 3 and counts[i] >= least:
                rows = lines[i:j]
                # One delimiter at the very end of each line makes a list, not columns.
                inner = [x.rstrip()[:-1].count(d) for x in rows] if d == ";" else counts[i:j]
                cells = [len(c.split()) for x in rows for c in x.split(d)]
                if min(inner) >= least and (d in "|\t" or sum(cells) / len(cells) <= 2.5):
                    for k in range(i, j):
                        out[k] = True
            i = max(j, i + 1)
    starts = [{m.end() for m in _GAP.finditer(x)} for x in lines]
    heads = [i for i in range(n) if starts[i]]
    i = 0
    while i < n:
        j = i
        while j < n and starts[j] and (j == i or starts[j] & starts[j - 1]):
            j += 1
        if j - i >= 3:
            for k in range(i, j):
                out[k] = True
            # Rows whose last cells are empty end a run although they belong to it.
            while j < n and lines[j].strip() and heads and len(lines[j]) <= max(map(len, lines[i:j])) and (starts[j] or len(lines[j].split()) <= 2):
                out[j] = True
                j += 1
        i = max(j, i + 1)
    return out


def list_lines(lines: list[str], taken: list[bool]) -> list[bool]:
    """Lines whose edges come back with a period, or whose indents do: items with a marker, of one ending, or nested ones."""
    n = len(lines)
    open_ = [None if t else opening(x) for x, t in zip(lines, taken)]
    close = [None if t else closing(x) for x, t in zip(lines, taken)]
    out = [(a or b) and not t for a, b, t in zip(periodic(open_, 2), periodic(close, 3), taken)]
    # Lines without markers whose indents repeat (nested items) are a list too, unless their lengths run on as prose does.
    free = [i for i in range(n) if not taken[i] and not out[i]]
    inner = [lines[i] for i in free]
    if len(inner) >= 6 and indentation_period(inner) > 1 and max(map(len, inner)) < 60 and autocorrelation([len(x) for x in inner], 1) < 0.6:
        for i in free:
            out[i] = True
    return out


def is_junk_text(text: str, common: frozenset[str], least_words: int = 12, words: list[str] | None = None) -> bool:
    """Whether a stretch of text is no language: blobs, markup, repetition, menus, words in no order or random signs.

    ``words`` are those of the text in lower case, where they are known already.
    """
    dense = "".join(text.split())
    if not dense:
        return False
    tokens = _TOKEN.findall(text)
    words = _WORD.findall(text.lower()) if words is None else words
    symbols = count_symbols(text)
    letters = len(dense) - symbols - count_digits(text)
    if len(dense) >= 40 and symbols / len(dense) > 0.3 and letters / len(dense) < 0.6:
        return True
    if sum(len(m.group()) for m in _MARKUP.finditer(text)) > 0.3 * len(dense):
        return True
    if max(map(len, tokens)) > 60 and sum(len(t) for t in tokens if len(t) > 60) > 0.5 * len(dense) and "://" not in text:
        return True
    if len(words) >= least_words:
        known = sum(w in common for w in words) / len(words)
        counts = Counter(words)
        distinct = len(counts) / len(words)
        if counts.most_common(1)[0][1] > 0.4 * len(words) or (len(words) >= 30 and distinct < 0.15 and known < 0.3):
            return True
        ends = len(re.findall(r"[.!?,;:](?:\s|$)", text))
        if known < 0.25 and symbols / len(dense) > 0.18 or known < 0.12 and symbols / len(dense) > 0.12 and ends < 0.5 * symbols:
            return True
        if text.count(" | ") >= 0.15 * len(words):
            return True
        # Words without order: hardly any punctuation, few of the words that hold sentences together, many repeats.
        if ends <= len(words) / 60 and (known < 0.15 or distinct < 0.45 and len(words) >= 40) and not any(a in common and b in common for a, b in zip(words, words[1:])):
            return True
        if ends <= len(words) / 60 and known < 0.15:
            return True
        if len(words) >= 20 and known < 0.08 and distinct < 0.75 and len(re.findall(r"[.!?](?:\s|$)", text)) <= len(words) / 40:
            return True
    elif len(words) >= 6 and text.count(" | ") >= 0.5 * len(words):
        return True
    elif len(dense) >= 40 and words and sum(w in common for w in words) == 0 and symbols / len(dense) > 0.2:
        return True
    return False


def analyse(text: str, common: frozenset[str]) -> tuple:
    """All statistics of one text, the share of its characters of each kind, and its kind."""
    lines = [x for x in text.splitlines() if x.strip()]
    words = _WORD.findall(text.lower())
    dense = dense_length(text)
    symbols = count_symbols(text)
    lengths = [len(x) for x in lines]
    tables = table_lines(lines)
    lists = list_lines(lines, tables)
    weight = dict.fromkeys(KINDS, 0)
    rest: list[str] = []
    run: list[str] = []
    for line, t, li in zip(lines, tables, lists):
        size = dense_length(line)
        if _HEXDUMP.match(line) or _RULER.match(line):
            weight["junk"] += size
        elif t or li:
            weight["table" if t else "list"] += size
        else:
            run.append(line)
            continue
        if run:
            rest.append("\n".join(run))
            run = []
    if run:
        rest.append("\n".join(run))
    if rest:
        # A stretch is judged on its own where it is long enough, else with the other stretches.
        whole = "\n".join(rest)
        all_words = words if len(rest) == 1 and weight["list"] + weight["table"] + weight["junk"] == 0 else None
        for part in rest:
            size = dense_length(part)
            alone = size >= 60 or len(_WORD.findall(part)) >= 12
            weight["junk" if is_junk_text(part if alone else whole, common, words=all_words) else "prose"] += size
    # A heading over a list or a table is part of it.
    if weight["prose"] and len(rest) == 1 and len(rest[0].split()) <= 3 and weight["list"] + weight["table"] > 0:
        weight["list" if weight["list"] >= weight["table"] else "table"] += weight["prose"]
        weight["prose"] = 0
    total = max(1, sum(weight.values()))
    kind = max(KINDS, key=lambda k: weight[k])
    n = len(words)
    return (
        n,
        len(lines),
        sum(map(len, words)) / n if n else None,
        symbols / dense if dense else None,
        sum(bool(_SENTENCE_END.search(x)) for x in lines) / len(lines) if lines else None,
        sum(w in common for w in words) / n if n else None,
        autocorrelation(lengths, 1),
        indentation_period(lines),
        weight["prose"] / total,
        weight["list"] / total,
        weight["table"] / total,
        weight["junk"] / total,
        kind,
    )


FIELDS = [
    ("n_words", "int"),
    ("n_lines", "int"),
    ("mean_word_length", "double"),
    ("symbol_ratio", "double"),
    ("punctuated_lines", "double"),
    ("common_share", "double"),
    ("length_autocorrelation", "double"),
    ("indentation_period", "int"),
    ("prose_share", "double"),
    ("list_share", "double"),
    ("table_share", "double"),
    ("junk_share", "double"),
    ("text_class", "string"),
]
_ARROW = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def text_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row per document with text: doc_id, the statistics of `FIELDS` and text_class.

    NULL and blank texts have no row. Ratios over nothing are NULL. Repeated rows each give a row; whole texts are read; ties
    between kinds go to prose, then list, then table. A narrow pass without shuffle.
    """
    rows = common_words.select("word").filter("word IS NOT NULL").distinct().limit(MAX_COMMON_WORDS + 1).collect()
    if len(rows) > MAX_COMMON_WORDS:
        raise ValueError(f"more than {MAX_COMMON_WORDS} common words")
    common = documents.sparkSession.sparkContext.broadcast(frozenset(r.word.lower() for r in rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [analyse(t, common.value) for t in b.column("text").to_pylist()]
            columns = list(zip(*found)) if found else [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, FIELDS)]], names=["doc_id", *[f for f, _ in FIELDS]])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike(r"\S"))
    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{f} {t}" for f, t in FIELDS))


def not_prose(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, text_class) of the documents that are no prose."""
    return text_statistics(documents, common_words).filter("text_class <> 'prose'").select("doc_id", "text_class")


