"""Sentence boundaries across languages and scripts.

The method: semi-Markov dynamic programming. A block of text (a paragraph or list entry) is cut
into whole sentence spans so that the sum of the spans' scores is greatest. A span's score adds up
its length, the word that opens the next one, its closing word and mark, and the quotations and brackets that it
leaves open or closes without having opened them, or that it ends with without being whole; the program weighs
them against each other over the whole block. Candidates for ends are marks that can close a sentence, within
quotations too, and, between two Thai characters, blanks. There are no labelled sentences to fit weights to,
so the weights are parameters set by hand, below.

Blocks come from the layout of a commit message: its first line, trailer lines, list entries
and blank lines bound sentences whatever stands there.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOUND = "doc long, sent_start int, sent_end int"

# Abbreviations after which a sentence goes on.
NEVER_LAST = frozenset(
    "dr prof mr mrs st sr sra dra srta mme mlle fr hr hrn frl e.g i.e cf vs approx aprox incl fig figs sec secs eq eqs no nos vol ch pp p.ej "
    "abb abschn nr ca bzw vgl s.o z.b d.h u.a z d h i e ej ex p v "
    "рис проф см ср стр т.е напр им ул "
    "βλ σχ κ κα δρ π.χ δηλ "
    "डॉ श्री "
    "د أ "
    "jan feb mar apr aug sept sep oct nov dec gen col lt rev hon jr viz ed eds art núm núms pág págs tel av ee".split()
)
# Abbreviations that close a sentence if the next word opens one.
MAYBE_LAST = frozenset("etc usw p.m a.m u.s u.k e.u inc ltd co corp jr al m r uu г д т.д т.п тыс млн κ.λπ κτλ δευτ min u.ä o.ä bros dept univ".split())
# Abbreviations that only a number follows.
BEFORE_NUMBER = frozenset("no nr nos fig sec abb abschn eq vol ch p pp art núm jan feb mar apr aug sept sep oct nov dec".split())
# Months after a German ordinal.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
# Keys of trailer lines without "-by" or another hyphen.
TRAILER_KEYS = frozenset("fixes closes refs cc link bug resolves see change-id ref references relates reverts issue".split())

_TRAILER = re.compile(r"([A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*): \S")
_PICKED = re.compile(r"\(cherry[- ]picked from commit [0-9a-f]+\)$")
_LIST = re.compile(r"[ \t]*(?:[-*]|\d+\.)[ \t]+(?=\S)")
_OPEN, _CLOSE = "([{（［【〔「『《〈", ")]}）］】〕」』》〉"
_CLOSERS = _CLOSE + "\"”“»«’"
_WIDE = "。！？｡"
# A run of marks that may end a sentence, with the quotation marks and brackets that it closes.
_MARK = re.compile(f"(?:[.!?…؟۔।॥;;]+|[{_WIDE}][{_WIDE}!?]*)(?:[ \\n\u00a0\u202f]?»(?=[\\s.,;:!?)]|$)|[{re.escape(_CLOSERS)}])*")
_THAI_BLANK = re.compile(r"(?<=[฀-๿])[ \t \n]+(?=[฀-๿])")
_TOKEN_END = re.compile(r"\S*$")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_CODE = re.compile(r"`|v\d+\.\d|\w*[a-z0-9][A-Z]\w*|\w+_\w*|\w+\(\)|\w+(?:\.\w+)*\(|https?://|[\w-]+/[\w./-]+|\w+\.(?:py|js|c|h|md|yaml|json|txt)\b")
_BLANKS = " \t\n\r  　​"
_NONE = -1e9
#: Characters from which on a span loses two thousandths for each.
_LONG = 400
#: What a span loses, in thousandths, for each quotation or bracket that it leaves open at an end.
_CROSSED = 8000


def pairs_of(text: str) -> list[int]:
    """For each character the depth of matched quotations and brackets around the place after it."""
    opened: list[tuple[str, int]] = []
    spans = []

    def close(kinds: str, at: int) -> bool:
        for k in range(len(opened) - 1, -1, -1):
            if opened[k][0] in kinds:
                spans.append((opened[k][1], at))
                del opened[k:]
                return True
        return False

    for i, c in enumerate(text):
        if c in _OPEN:
            opened.append((_CLOSE[_OPEN.index(c)], i))
        elif c in _CLOSE:
            close(c, i)
        elif c in "„‚":
            opened.append(("“”", i))
        elif c in "“”":
            if not close("“”", i) and c == "“":
                opened.append(("“”", i))
            elif c == "“" and spans and spans[-1][1] == i and text[spans[-1][0]] == "“":
                spans.pop()  # a second opening mark: it starts anew
                opened.append(("“”", i))
        elif c in "«»":
            before = i == 0 or text[i - 1] in _BLANKS or text[i - 1] in _OPEN
            after = i + 1 == len(text) or text[i + 1] in _BLANKS
            opens = before and (c == "«" or not after)
            if opens:
                opened.append(("»" if c == "«" else "«", i))
            elif not close(c, i):
                close("«»", i)
        elif c == '"':
            if not close('"', i):
                opened.append(('"', i))
    depth = [0] * (len(text) + 1)
    for a, b in spans:
        depth[a] += 1
        depth[b] -= 1
    at = 0
    for i in range(len(text)):
        at += depth[i]
        depth[i] = at
    return depth[: len(text)]


def _opening(text: str, at: int) -> float:
    """How well a sentence may open at a place (of a character that is no blank)."""
    if at >= len(text):
        return 0.0
    i = at
    while i < len(text) and text[i] in "\"“„«»‘'¿¡([（「『":
        i += 1
        while i < len(text) and text[i] in "   ":
            i += 1
    quoted = 0.5 if i > at else 0.0
    if i >= len(text):
        return -3.0
    c = text[i]
    if _CODE.match(text, i):
        return 0.6
    if c.isupper() or c.istitle():
        return 1.5 + quoted
    if c.islower():
        return -6.0 + (1.0 if text[at] in "¿¡" else 0.0)
    if c.isdigit():
        return 0.2 + quoted
    if c.isalpha():
        return 0.8
    return 0.3 if c in "#@/*-" and c != "-" else -6.0


def _word_before(text: str, end: int) -> str:
    """The token that ends at a place."""
    start = end
    while start > 0 and text[start - 1] not in _BLANKS:
        start -= 1
    return text[start:end]


class Cut:
    """A place where a sentence may end, and the next one begin."""

    __slots__ = ("end", "next", "score", "quote_start", "greek", "depth")

    def __init__(self, end: int, following: int, score: float, quote_start: int = -1, greek: bool = False, depth: int = 0):
        self.end, self.next, self.score, self.quote_start, self.greek, self.depth = end, following, score, quote_start, greek, depth


def _closing(text: str, start: int, marks: str, following: int, spaced: bool) -> tuple[float, bool]:
    """(score of a sentence's end by its last word and marks, whether it takes a Greek sentence)."""
    first = marks[0]
    opening = _opening(text, following)
    if opening < -5 and text[following].islower() and start and text[start - 1].isalpha() and not (text[start - 1].islower() or text[start - 1].isupper()):
        opening = 0.6  # after a script without capitals a small letter says nothing
    if first in _WIDE:
        return 4.0, False
    if first in "؟۔।॥":
        return (3.5 if opening > -5 or not text[following].islower() else -2.0), False
    if first in ";;":
        return (2.5 + opening if first == ";" or start and (_GREEK.match(text[start - 1]) or text[start - 1].isalnum()) else _NONE), first == ";"
    if "…" in marks or "..." in marks:
        return 0.3 + opening, False
    if "!" in marks or "?" in marks:
        return 2.5 + opening, False
    word = _word_before(text, start).lstrip("\"“„«»‘'([{（「『¿¡")
    low = word.lower()
    nxt = re.compile(r"\w*").match(text, following).group()
    if low in BEFORE_NUMBER and not nxt[:1].isdigit() and low in ("no", "sec", "p", "art", "fig"):
        return 2.0 + opening, False
    if low in NEVER_LAST or word == "Ms":
        return -8.0, False
    if len(word) == 1 and word.isupper():  # an initial, before a name
        return -8.0, False
    if low in MAYBE_LAST:
        return (0.6 if opening >= 0 else -1.0) + opening, False
    if "." in word and all(len(x) == 1 and x.isalpha() for x in word.split(".")):
        return -0.5 + opening, False
    if word.isdigit() and nxt.lower() in MONTHS:
        return -8.0, False
    return 2.0 + opening, False


def cuts(text: str, depth: list[int]) -> list[Cut]:
    """Candidates in a block; the last one is its end."""
    out = []
    n = len(text)
    for m in _MARK.finditer(text):
        end = m.end()
        if end >= n:
            continue
        spaced = text[end] in _BLANKS
        wide = m.group()[0] in _WIDE
        if not spaced and not wide:
            continue
        following = end
        while following < n and text[following] in _BLANKS:
            following += 1
        if following >= n:
            continue
        last = end - 1
        inside = depth[last]  # how many quotations and brackets are open there
        marks = m.group().rstrip(_CLOSERS + _BLANKS)
        score, greek = _closing(text, m.start(), marks, following, spaced)
        quote_start = -1
        if end - m.start() > len(marks) and not inside:  # closers: where does what they close begin?
            i = last
            while i > 0 and depth[i - 1] > 0:
                i -= 1
            quote_start = i
            if not depth[i] and i == last:
                quote_start = -1
        if wide and text[following] in "，、,；;：:—」』）)”»":
            score = -8.0
        out.append(Cut(end, following, score, quote_start, greek, inside))
    for m in _THAI_BLANK.finditer(text):
        out.append(Cut(m.start(), m.end(), 4.0, depth=depth[m.start() - 1]))
    out.sort(key=lambda c: c.end)
    out.append(Cut(n, n, 0.0))
    return out


def _length(text_len: int) -> int:
    """Sentences of a few words and more are likelier than fragments; very long ones are not. In thousandths."""
    if text_len < 4:
        return -1500
    return 0 if text_len < _LONG else -2 * (text_len - _LONG)


def _unbalanced(text: str, cut: Cut) -> int:
    """What a sentence loses, in thousandths, that opens before the quotation that it ends with."""
    if cut.quote_start < 0 or cut.next >= len(text):
        return 0
    c = text[cut.next]
    before = text[:cut.quote_start].rstrip(_BLANKS)[-1:]
    if not (c.isupper() or c in "\"“„«»¿¡(" or c.isdigit()) and not _CODE.match(text, cut.next) or c == "—":
        # Scripts without capitals: a quotation ends the sentence if it is all of it, or follows a colon.
        return 8000 if before not in (":", "：") else 0
    if not c.isupper() and _CODE.match(text, cut.next):
        return 4000 if before not in (":", "：") and text[cut.quote_start] not in "(（[" else 0
    return 0


def segment(text: str) -> list[tuple[int, int]]:
    """Sentences of a block by dynamic programming over whole spans, exact at any number of candidates.

    Scores are whole thousandths, so that sums don't depend on their order; of equal ones the latest start wins.
    A span of _LONG characters or more loses in proportion to its length, so of all starts that far back the
    one with the greatest score + 2 start is best for every end, and is kept as candidates go by. Only
    nearer starts are tried one by one, and those from the opening of a quotation that the span ends with.
    Time is in proportion to length, and to that of quotations once for each that is nested in another.
    """
    depth = pairs_of(text)
    ends = cuts(text, depth)
    if len(ends) == 1:
        return [(0, len(text))]
    starts = [0] + [c.next for c in ends[:-1]]
    greek = [m.start() for m in _GREEK.finditer(text)]
    # A boundary within quotations leaves them open on both sides; the start's share is in best already.
    best: list[int | None] = [0] + [None] * len(ends)  # None: no sentence ends there
    back = [0] * (len(ends) + 1)
    top: list[int] = []  # of the starts up to each, that with the greatest best + 2 start
    for j, cut in enumerate(ends):
        k = top[-1] if top else 0
        top.append(j if best[j] is not None and best[j] + 2 * starts[j] >= best[k] + 2 * starts[k] else k)
        if cut.score <= -6 and j + 1 < len(ends):
            continue
        last = j
        if cut.greek:  # only a sentence with a Greek letter ends here
            n = bisect_left(greek, cut.end)
            if not n:
                continue
            last = bisect_right(starts, greek[n - 1], 0, j + 1) - 1
        low, loss = bisect_right(starts, cut.end - _LONG, 0, last + 1), _unbalanced(text, cut)
        if loss:
            low = min(low, bisect_left(starts, cut.quote_start, 0, last + 1))
        score = round(cut.score * 1000) - 2 * _CROSSED * cut.depth
        for i in (*range(last, low - 1, -1), *top[max(low - 1, 0) : low]):
            if best[i] is not None:
                s = best[i] + score + _length(cut.end - starts[i]) - (loss if cut.quote_start > starts[i] else 0)
                if best[j + 1] is None or s > best[j + 1]:
                    best[j + 1], back[j + 1] = s, i
    out, j = [], len(ends)
    while j:
        out.append((starts[back[j]], ends[j - 1].end))
        j = back[j]
    return out[::-1]


def _is_trailer(line: str) -> bool:
    line = line.strip(_BLANKS)
    if _PICKED.match(line):
        return True
    m = _TRAILER.match(line)
    if not m:
        return False
    key = m.group(1).lower()
    return key in TRAILER_KEYS or "-" in key and key[0].isalpha() and m.group(1)[0].isupper()


def blocks(message: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of the blocks of a message; a whole block is one sentence."""
    at, first = 0, True
    open_at = -1  # start of the block that lines go on
    last = 0  # its end so far
    for line in message.split("\n"):
        start, end = at, at + len(line)
        at = end + 1
        if not line.strip(_BLANKS):
            if open_at >= 0:
                yield open_at, last, False
                open_at = -1
            continue
        if first:
            first = False
            yield start, end, True
            continue
        if _is_trailer(line):
            if open_at >= 0:
                yield open_at, last, False
                open_at = -1
            yield start, end, True
            continue
        m = _LIST.match(line)
        if m:
            if open_at >= 0:
                yield open_at, last, False
            open_at = start + m.end()
        elif open_at < 0:
            open_at = start
        last = end
    if open_at >= 0:
        yield open_at, last, False


def sentences(message: str | None) -> list[tuple[int, int]]:
    """Spans of the sentences of a commit message, without blanks at either end."""
    out = []
    for start, end, whole in blocks(message or ""):
        text = message[start:end]
        for a, b in [(0, len(text))] if whole else segment(text):
            while a < b and text[a] in _BLANKS:
                a += 1
            while b > a and text[b - 1] in _BLANKS:
                b -= 1
            if a < b:
                out.append((start + a, start + b))
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, starts, ends = [], [], []
        for doc, at, message in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for a, b in sentences(message):
                docs.append(doc)
                starts.append(at + a)
                ends.append(at + b)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc", "sent_start", "sent_end"])


def sentence_spans(docs: DataFrame, doc: str, text: str, start: str, end: str) -> DataFrame:
    """doc, sent_start, sent_end: one row per sentence of text[start:end], as offsets into text
    in code points, end exclusive. Only the messages leave the JVM, and nothing is shuffled.

    Null or empty texts and spans, and spans of nothing but blanks, give no rows. A span that
    starts before the text or ends after it is cut to it. Repeated rows give repeated sentences.
    """
    low = F.greatest(F.col(start), F.lit(0))
    message = F.substring(F.col(text), low + 1, F.greatest(F.col(end) - low, F.lit(0)))
    spans = docs.where(F.col(text).isNotNull() & (F.col(end) > low)).select(F.col(doc).cast("long").alias("doc"), low.cast("int").alias("low"), message.alias("message"))
    return spans.mapInArrow(_rows, FOUND)
