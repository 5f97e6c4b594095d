"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are numbered by the vocabulary of the items.  The automaton recognises
every run of words that occurs in any item; document words stream through it and
the longest matching length at each word tells which windows end there.  Stretches
whose two- or three-word grams rule out a whole window are not walked: the matching
length there stays below the window, so nothing can be lost.

Items beyond ``BLOCK_WORDS`` words are split into blocks with an automaton each, so
that what is sent to the executors stays bounded; the blocks' hits are united.

Null texts have no words; an item without words matches nothing.  Words of items whose id is
null are hit and count in n_hit and contaminated like any other; n_items and items_sha256 are of the items
with an id.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtrace.operators.staging import stage

from .rows import chunks, only, original, split, with_columns

WINDOW = 13
#: A document is contaminated if hits make up one word in this many, or more.
ONE_IN = 20
#: Words of items in one automaton; about 200 bytes each.
BLOCK_WORDS = 500_000
#: Automata that workers hold at once.
ALIVE = 2
#: Bytes that are part of words, in lower case; all others separate.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class ItemAutomaton:
    """Suffix automaton over the words of many items, with the items of each window."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        coded = [(item, [number(w, len(self.vocabulary)) for w in text]) for item, text in items if text]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, text in coded:
            last = 0
            for word in text:
                last = self._extend(last, word)
        self._mark(coded)
        self._grams(coded)

    def _extend(self, last: int, word: int) -> int:
        """State of the item's words so far after one more word; states of earlier items are shared."""
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            known = nxt[last][word]
            return known if length[known] == length[last] + 1 else self._clone(last, word, known)
        state = self._state({}, length[last] + 1)
        at = last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = state
            at = link[at]
        if at < 0:
            link[state] = 0
        else:
            known = nxt[at][word]
            link[state] = known if length[known] == length[at] + 1 else self._clone(at, word, known)
        return state

    def _clone(self, at: int, word: int, known: int) -> int:
        copy = self._state(dict(self.next[known]), self.length[at] + 1)
        self.link[copy] = self.link[known]
        self.link[known] = copy
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _state(self, edges: dict[int, int], length: int) -> int:
        self.next.append(edges)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def _mark(self, coded: list[tuple[int, list[int]]]) -> None:
        """Items by the state that stands for their windows: full windows and short whole items.

        Every state knows the suffix state that holds its windows and the nearest one with a
        short item, so that a word costs the same in texts of one repeated word.
        """
        order = np.argsort(self.length, kind="stable").tolist()  # a suffix link leads to a shorter state
        self.holder = list(range(len(self.next)))
        for state in order[1:]:
            if self.length[self.link[state]] >= self.window:
                self.holder[state] = self.holder[self.link[state]]
        self.items: dict[int, set[int]] = {}
        short: dict[tuple[int, int], set[int]] = {}
        for item, text in coded:
            named = set() if item is None else {item}
            if len(text) < self.window:
                state = 0
                for word in text:
                    state = self.next[state][word]
                short.setdefault((state, len(text)), set()).update(named)
                continue
            for state, matched in self.walk(text):
                if matched >= self.window:
                    self.items.setdefault(self.holder[state], set()).update(named)
        self.short_at: dict[int, list[tuple[int, set[int]]]] = {}
        for (state, size), found in short.items():
            self.short_at.setdefault(state, []).append((size, found))
        self.nearest = [-1] * len(self.next)
        if short:
            for state in order[1:]:
                self.nearest[state] = state if state in self.short_at else self.nearest[self.link[state]]

    def walk(self, coded: list[int]) -> Iterator[tuple[int, int]]:
        """State and longest matching length after each word; -1 is a word that no item has."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for word in coded:
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                matched += 1
            yield state, matched

    def ends(self, state: int, matched: int) -> Iterator[tuple[int, set[int]]]:
        """Windows that end here: their sizes and items."""
        if matched >= self.window:
            yield self.window, self.items.get(self.holder[state], set())
        state = self.nearest[state]
        while state > 0:  # fewer steps than the window has words
            for size, items in self.short_at[state]:
                if size <= matched:
                    yield size, items
            state = self.nearest[self.link[state]]

    BITS = 20

    def _grams(self, coded: list[tuple[int, list[int]]]) -> None:
        """A table of gram hashes: a window of n words is a run of n - gram + 1 grams in it."""
        self.least = min([len(t) for _, t in coded if len(t) < self.window], default=self.window)
        self.gram = min(3, self.least)
        self.table = np.zeros(1 << self.BITS, bool)
        for _, text in coded:
            self.table[self._hashes(np.asarray(text, np.int64))] = True

    def _hashes(self, coded: np.ndarray) -> np.ndarray:
        n = max(0, len(coded) - self.gram + 1)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.gram):
                out = (out + coded[i : i + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return (out >> np.uint64(64 - self.BITS)).astype(np.int64)

    def stretches(self, coded: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words that may hold a window: long enough runs of known grams."""
        known = self.table[self._hashes(coded)]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
        wide = ends - starts >= self.least - self.gram + 1
        return [(int(a), int(b) + self.gram - 1) for a, b in zip(starts[wide], ends[wide])]

    def hits(self, numbered: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Disjoint ranges of words inside windows, and the items of the windows."""
        spans: list[list[int]] = []
        items: set[int] = set()
        last = None
        for start, end in self.stretches(numbered):
            for i, (state, matched) in enumerate(self.walk(numbered[start:end].tolist()), start + 1):
                widest = 0
                for size, found in self.ends(state, matched):
                    widest = max(widest, size)
                    if found is not last:  # neighbouring windows are often of the same items
                        items |= found
                        last = found
                if widest:
                    if spans and i - widest <= spans[-1][1]:
                        spans[-1] = [min(spans[-1][0], i - widest), i]
                        while len(spans) > 1 and spans[-2][1] >= spans[-1][0]:
                            spans[-2:] = [[min(spans[-2][0], spans[-1][0]), i]]
                    else:
                        spans.append([i - widest, i])
        return [tuple(s) for s in spans], items

    def texts(self, many: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int]], set[int]]]:
        """Hits of several texts; the gram test runs over all of them at once."""
        lengths = np.fromiter(map(len, many), np.int64, len(many))
        get = self.vocabulary.get
        flat = np.fromiter((get(w, -1) for text in many for w in text), np.int64, int(lengths.sum()))
        ends = np.cumsum(lengths)
        ranges = self.stretches(flat)
        touched = {bisect_left(ends, a + 1) for a, _ in ranges} if ranges else set()
        for a, b in ranges:  # a run may go on into the next texts
            i = bisect_left(ends, a + 1)
            while i + 1 < len(many) and ends[i] < b:
                i += 1
                touched.add(i)
        for i, end in enumerate(ends.tolist()):
            yield self.hits(flat[end - int(lengths[i]) : end]) if i in touched else ([], set())


def blocks(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[ItemAutomaton]:
    """Automata over the items (item_id, text), read row by row and closed at ``block_words`` words; one at least."""
    held, size, closed = [], 0, 0
    for item, text in only(items, "item_id", "text").where("text is not null").toLocalIterator():
        if not (found := words(text)):
            continue
        held.append((item, found))
        size += len(found)
        if size >= block_words:
            yield ItemAutomaton(held, window)
            held, size, closed = [], 0, closed + 1
    if held or not closed:
        yield ItemAutomaton(held, window)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


HITS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.LongType())),
]


def matches(documents: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of ``documents`` and, last, n_words, spans and items.

    ``spans`` are word ranges inside windows, as start and end in turn; ``items`` the
    item_ids of those windows.  Every block of items is one more narrow pass over the
    same rows, nothing is shuffled; the rows are written every ``ALIVE`` blocks.
    """
    context = documents.sparkSession.sparkContext
    width = len(documents.columns)
    frame = documents
    alive = []
    for number, automaton in enumerate(blocks(items, window, block_words)):
        if len(alive) == ALIVE:
            frame = stage(frame)
            for old in alive:
                old.destroy()
            alive = []
        sent = context.broadcast(automaton)
        alive.append(sent)
        inputs = ["text"] if not number else [frame.columns[documents.columns.index("text")], *frame.columns[-2:]]
        frame = with_columns(frame, inputs, HITS, _one_block(sent))
        if number:  # the newest three columns take the place of the ones before
            frame = frame.select(*frame.columns[:width], *frame.columns[-3:]).toDF(*(f"c{i}" for i in range(width + 3)))
    return frame


def _one_block(sent):
    def compute(texts, spans=None, items=None):
        automaton = sent.value
        n_words, all_spans, all_items = [], [], []
        for start, end in chunks(texts):
            split_texts = [words(t) for t in texts[start:end]]
            for i, (found, ids) in enumerate(automaton.texts(split_texts), start):
                if spans is not None:
                    found = merged([*found, *zip(spans[i][::2], spans[i][1::2])])
                    ids = ids | set(items[i])
                all_spans.append([x for span in found for x in span])
                all_items.append(sorted(ids))
            n_words += map(len, split_texts)
        return n_words, all_spans, all_items

    return compute


def report(documents: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A word inside any window is hit, also of items without an id.  Repeated and null doc_ids pass through.
    """
    rows = only(documents, "doc_id", "text")
    made = split(matches(rows, items, window, block_words), ["doc_id", "text", *(f.name for f in HITS)], ["doc_id", "n_words", "spans", "items"])
    steps = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    n_hit = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return made.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (ONE_IN * n_hit >= F.col("n_words"))).alias("contaminated"),
        "spans",
    )


def drop_contaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``documents`` without the contaminated ones: there the spans exceed the coverage limit, so the whole text goes.

    Texts that stay are unchanged; ``without_spans`` cuts the spans themselves.
    """
    made = matches(documents, items)
    n_words, spans = (F.col(c) for c in made.columns[-3:-1])
    n_hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return original(made.where(~((n_hit > 0) & (ONE_IN * n_hit >= n_words))), documents)


def without_spans(documents: DataFrame, items: DataFrame, min_words: int = WINDOW, window: int = WINDOW) -> DataFrame:
    """``documents`` with every hit span of at least ``min_words`` words cut out of ``text``."""
    made = matches(documents, items, window)
    width = len(documents.columns)
    plain = made.toDF(*(f"c{i}" for i in range(width)), "n", "spans", "items").drop("n", "items")
    at = documents.columns.index("text")
    cut = with_columns(plain, [f"c{at}", "spans"], [T.StructField("kept", T.StringType())], lambda t, s: [[_cut(a, b, min_words) for a, b in zip(t, s)]])
    kept = cut.columns[-1]
    return cut.select(*(F.col(kept if i == at else f"c{i}").alias(n) for i, n in enumerate(documents.columns)))


def _cut(text: str | None, spans: list[int], min_words: int) -> str | None:
    wide = [(a, b) for a, b in zip(spans[::2], spans[1::2]) if b - a >= min_words]
    if not wide:
        return text
    raw = text.encode()
    folded = raw.translate(FOLD)
    edges = np.flatnonzero(np.diff(np.frombuffer(b" " + folded + b" ", np.uint8) != 0x20))
    out, at = [], 0
    for a, b in wide:
        out.append(raw[at : edges[2 * a]])
        at = int(edges[2 * b - 1])
    return (b"".join(out) + raw[at:]).decode()
