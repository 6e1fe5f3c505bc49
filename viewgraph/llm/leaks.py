"""Evaluation passages in training text.

The method: pigeonhole edit matching. A passage is any run of `words` words of an item. With at
most e word edits it falls into e + 1 pieces of which one is untouched, so documents are scanned once for exact hits
of pieces, and around each hit Myers' bit-parallel distance says how well the passages match. Words are
symbols, so layout, case and punctuation cost nothing.

Equal passages of any number of items are one, and items are put to the hits at the end. A piece that many passages
share, such as a licence line, is not held against all of them: around a hit, an index of passages and of
passages without one word yields those that can be within one edit, so work follows the text and the matches.
(With two edits or more, all distinct passages with the piece are held against the text.)

The items are the query set: they come in blocks of a bounded number of words. An index is made once for
each block and broadcast as arrays; documents are read once, by narrow tasks without any shuffle, and meet
one block after another. Copies of a document, long documents and hot sources therefore weigh no more than their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import words_of

#: Words of items in a block; its index takes some 200 bytes for each.
BLOCK_WORDS = 500_000
#: Bytes of documents that a task has as words at a time.
PORTION_BYTES = 4_000_000
#: Passages that Myers' distance is taken of at a time.
VERIFY = 200_000
FOUND = "item long, doc long, errors int"


def myers(pattern: list[int], text: list[int]) -> list[int]:
    """Least edit distance of pattern to any part of text that ends at each symbol of text."""
    m = len(pattern)
    at: dict[int, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = ones, 0, m, []
    for c in text:
        eq = at.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & ones
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & ones
        mh = mh << 1 & ones
        pv = mh | ~(xv | ph) & ones
        mv = ph & xv
        out.append(score)
    return out


def least_distances(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each row, the least of myers(pattern, text): the same recurrence over all rows at once. Patterns have up to 63 symbols."""
    m, u = patterns.shape[1], np.uint64
    ones, top, one = u((1 << m) - 1), u(1 << (m - 1)), u(1)
    pv, mv = np.full(len(patterns), ones), np.zeros(len(patterns), u)
    score = np.full(len(patterns), m)
    best = score.copy()
    places = one << np.arange(m, dtype=u)
    for k in range(texts.shape[1]):
        eq = ((patterns == texts[:, k : k + 1]) * places).sum(1, dtype=u)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & ones
        mh = pv & xh
        score = score + ((ph & top) != 0) - ((mh & top) != 0)
        best = np.minimum(best, score)
        ph, mh = ph << one & ones, mh << one & ones
        pv, mv = mh | ~(xv | ph) & ones, ph & xv
    return best


_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


class Hashes:
    """64-bit hashes of all runs of a text, from prefix sums. They only propose; what they propose is verified."""

    def __init__(self, codes: np.ndarray, of_code: np.ndarray):
        n = len(codes)
        powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
        self.back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _BACK, np.uint64)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(of_code[codes] * powers[:n], dtype=np.uint64)])

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.back[at]

    def without(self, at: np.ndarray, length: int, gone: int) -> np.ndarray:
        """Of runs with the word at a place in them taken out."""
        s = self.sums
        return (s[at + gone] - s[at] + (s[at + length] - s[at + gone + 1]) * _BACK) * self.back[at]


def _runs(codes: np.ndarray, length: int) -> np.ndarray:
    """Starts of runs of so many known words."""
    known = np.concatenate([[0], np.cumsum(codes != 0)])
    n = max(0, len(codes) - length + 1)
    return np.flatnonzero(known[length:][:n] - known[:n] == length)


class Lookup:
    """Passages by key, sorted."""

    def __init__(self, keys: np.ndarray, passages: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.passages = keys[order], passages[order].astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in keys, passage) of all entries with these keys."""
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = high - low
        entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(keys)), n), self.passages[entry]


class PassageIndex:
    """The distinct passages of a block of items, their pieces, and the items that have them."""

    def __init__(self, items: list[tuple[int, list[str]]], words: int, errors: int):
        self.words, self.errors = words, errors
        self.piece = words // (errors + 1)
        self.offsets = [j * self.piece for j in range(errors)] + [words - self.piece]
        self.vocabulary: dict[str, int] = {}
        parts, ids = [], []
        for item, text in items:
            if len(text) >= words:  # a shorter item has no passage
                parts += [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text], [0]]
                ids.append(item)
        flat = np.concatenate([np.array(x, np.int64) for x in parts]) if parts else np.zeros(0, np.int64)
        self.of_code = np.random.default_rng(20).integers(1, 1 << 63, len(self.vocabulary) + 1, dtype=np.uint64)
        starts = _runs(flat, words)
        item_at = np.cumsum(flat == 0)[starts] if len(starts) else starts
        rows = np.ascontiguousarray(flat[starts[:, None] + np.arange(words)].astype(np.int32))
        _, first, passage = np.unique(rows.view(f"V{4 * words}").ravel(), return_index=True, return_inverse=True)
        self.patterns = rows[first]
        self._fold(passage.ravel(), np.array(ids, np.int64)[item_at] if ids else item_at)
        at, every = starts[first], np.arange(len(first))
        hashes = Hashes(flat, self.of_code)
        self.pieces = [Lookup(hashes.of(at + o, self.piece), every) for o in self.offsets]
        if errors <= 1:
            self.whole = Lookup(hashes.of(at, words), every)
        if errors == 1:
            self.without = Lookup(np.concatenate([hashes.without(at, words, d) for d in range(words)]), np.tile(every, words))
            for piece in self.pieces:
                piece.keys, piece.passages = np.unique(piece.keys), None  # only whether a piece occurs counts

    def _fold(self, passage: np.ndarray, item: np.ndarray) -> None:
        """Passages with the same items share one list of them."""
        pairs = np.unique(np.stack([passage, item], 1), axis=0) if len(passage) else np.zeros((0, 2), np.int64)
        cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
        seen: dict[bytes, int] = {}
        lists = []
        self.list_of = np.zeros(len(self.patterns), np.int64)
        for k, part in enumerate(np.split(pairs[:, 1], cuts) if len(pairs) else []):
            n = seen.setdefault(part.tobytes(), len(lists))
            if n == len(lists):
                lists.append(part)
            self.list_of[k] = n
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.items = np.concatenate(lists) if lists else np.zeros(0, np.int64)

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place where a passage may start, give or take the errors, passage) around exact hits of pieces.

        codes has at least words + errors + 1 zeros at both ends."""
        n, size, last = self.words, self.piece, self.words - self.piece
        hashes, starts = Hashes(codes, self.of_code), _runs(codes, size)
        keys = hashes.of(starts, size)
        at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]

        def propose(where: Lookup, keys: np.ndarray, places: np.ndarray) -> None:
            k, passage = where.find(keys)
            at.append(places[k])
            found.append(passage)

        for j, (offset, piece) in enumerate(zip(self.offsets, self.pieces)):
            if self.errors > 1:
                propose(piece, keys, starts - offset)
                continue
            k = np.searchsorted(piece.keys, keys)
            hit = np.flatnonzero(piece.keys[np.minimum(k, len(piece.keys) - 1)] == keys) if len(piece.keys) else k[:0]
            a = starts[hit] - offset
            propose(self.whole, hashes.of(a, n), a)
            if not self.errors:
                continue
            # One edit outside the piece: a word less, another word, or a word more.
            head = j == 0
            propose(self.without, hashes.of(a if head else a + 1, n - 1), a)
            for d in range(size, n) if head else range(last):
                propose(self.without, hashes.without(a, n, d), a)
            for d in range(size, n) if head else range(1, last + 1):
                propose(self.whole, hashes.without(a if head else a - 1, n + 1, d), a)
        return np.concatenate(at), np.concatenate(found)

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, passage, errors) of candidates whose distance by Myers is within the errors."""
        at, passage = self.candidates(codes)
        errors = np.zeros(len(at), np.int64)
        reach = np.arange(-self.errors, self.words + self.errors)
        for a in range(0, len(at), VERIFY):
            part = slice(a, a + VERIFY)
            errors[part] = least_distances(self.patterns[passage[part]], codes[at[part][:, None] + reach])
        near = np.flatnonzero(errors <= self.errors)
        return at[near], passage[near], errors[near]

    def leaks(self, docs: list[int], texts: list[list[str]]) -> pa.RecordBatch | None:
        """item, doc, errors of documents given as words."""
        get = self.vocabulary.get
        gap = np.zeros(self.words + self.errors + 1, np.int64)  # no passage spans two documents
        parts, bounds = [gap], [len(gap)]
        for words in texts:
            parts += [np.fromiter(map(get, words, repeat(0)), dtype=np.int64, count=len(words)), gap]
            bounds.append(bounds[-1] + len(words) + len(gap))
        at, passage, errors = self.matches(np.concatenate(parts))
        if not len(at):
            return None
        # A place may lie before its document by as many words as there are errors, which is within the gap before it.
        doc = np.searchsorted(np.array(bounds), at + self.errors, "right") - 1
        rows = _least_of(np.stack([doc, self.list_of[passage]], 1), errors)
        n = self.sizes[rows[:, 1]]
        first = (np.cumsum(self.sizes) - self.sizes)[rows[:, 1]]
        item = self.items[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        rows = _least_of(np.stack([np.repeat(rows[:, 0], n), item], 1), np.repeat(rows[:, 2], n))
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 1]), pa.array(np.array(docs, np.int64)[rows[:, 0]]), pa.array(rows[:, 2].astype(np.int32))], names=["item", "doc", "errors"])


def _least_of(keys: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """Distinct rows of keys, with the least errors of each as one more column."""
    order = np.lexsort((errors, keys[:, 1], keys[:, 0]))
    keys, errors = keys[order], errors[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, bool)
    return np.column_stack([keys[new], errors[new]])


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """Documents some PORTION_BYTES at a time, whatever their number and length; a longer one comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0)
        start, held = 0, 0
        for at, size in enumerate(sizes.to_pylist()):
            if at > start and held + size > PORTION_BYTES:
                part = batch.slice(start, at - start)
                yield part.column(0).to_pylist(), part.column(1).to_pylist()
                start, held = at, 0
            held += size
        if start < batch.num_rows:
            part = batch.slice(start)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def leaked_passages(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, words: int = 13, max_errors: int = 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item, doc, errors: which documents hold a passage of `words` consecutive words of
    which items with at most max_errors word edits. errors is the fewest of any passage, 0 if one
    stands exactly.

    Null and empty texts hold nothing, and items of fewer words than a passage are no passage.
    Repeated rows of a document or item give one row. Rows with a null id are left out.
    """
    if not 0 <= max_errors < words // 2 or words > 63:
        raise ValueError("max_errors must be under half of words, and words at most 63")
    spark = docs.sparkSession
    blocks: list[Broadcast] = []
    for block in _blocks(items, item, item_text, block_words):
        blocks.append(spark.sparkContext.broadcast(PassageIndex([(i, words_of(t)) for i, t in block], words, max_errors)))
    if not blocks:
        return spark.createDataFrame([], FOUND)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _portions(batches):
            wordy = [words_of(t) for t in texts]
            for shared in blocks:
                rows = shared.value.leaks(ids, wordy)
                if len(blocks) > 1 and getattr(shared, "_path", None):
                    shared.__dict__.pop("_value", None)  # of several blocks a worker holds one; the next portion loads it from the executor's file
                if rows is not None:
                    yield rows

    source = docs.where(F.col(doc).isNotNull() & (F.length(text) > 0)).select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    return source.mapInArrow(scan, FOUND).groupBy("item", "doc").agg(F.min("errors").alias("errors"))


def _blocks(items: DataFrame, item: str, text: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items, some block_words words (taken as six characters) at a time; the driver holds one block."""
    rows = items.where(F.col(item).isNotNull() & (F.length(text) > 0)).select(F.col(item).cast("long"), F.col(text)).distinct()
    block, held = [], 0
    for row in rows.toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1]) // 6 + 1
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block
