"""SentencePiece encoding and decoding with merge-type vocabularies.

A text is cut into *units* that no piece of the vocabulary can span.  Each
distinct unit is encoded once with an agenda of adjacent symbol pairs, best score
first, and compared with the sentencepiece library in the same Arrow batch; the
first text of each batch is compared whole.  A difference is an error, never a
silent wrong result.

Null and empty texts have no ids and decode to the empty text.
"""

from __future__ import annotations

import hashlib
import re
import string
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import chunks, only, split, with_columns

SPACE = "▁"
#: Units kept between batches of a task, and their characters.
KEPT_UNITS, KEPT_CHARS = 500_000, 8_000_000
#: Units up to this length keep their agenda in a list, longer ones in a heap.
SHORT = 48
NEVER = float("inf")


class PieceCodec:
    """Encoder and decoder for one model with merge scores, byte fallback and a leading space."""

    def __init__(self, model: str):
        self.library = p = sentencepiece.SentencePieceProcessor(model_file=model)
        size = p.get_piece_size()
        self.pieces = [p.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if p.is_control(i) or p.is_unknown(i) or p.is_byte(i)}
        self.special, self.unknown = special, p.unk_id()
        self.ids = {s: i for i, s in enumerate(self.pieces) if i not in special}
        self.cost = {s: -p.get_score(i) for s, i in self.ids.items() if len(s) > 1}
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i in range(size) if p.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        cuts_words = not any(SPACE in s.lstrip(SPACE) for s in self.ids)
        cuts_lines = not any("\n" in s for s in self.ids)
        if not (cuts_words and cuts_lines):
            raise ValueError("a piece spans words or lines: this vocabulary cannot be encoded by units")
        # no piece has one of these marks right after a letter or digit, so words end before them
        joined = {b for s in self.ids for a, b in zip(s, s[1:]) if a.isalnum()}
        ends = "".join(c for c in string.punctuation if c != "_" and c not in joined)
        inner = f"[^{SPACE}\n{re.escape(ends)}]+"
        mark = f"[{re.escape(ends)}]"
        self.units = re.compile(
            f"\n|{SPACE}*(?:{inner}|{mark})(?:{inner}|(?<![^\\W_]){mark})*|{SPACE}+" if ends else f"\n|{SPACE}*{inner}|{SPACE}+"
        ).findall
        self.number = [f"{i},".encode() for i in range(size)]
        self.spelled = [None if i in special else s.replace(SPACE, " ") for i, s in enumerate(self.pieces)]
        self.coded: dict[str, bytes] = {}
        #: Decoded units, of those that do not decode to their own characters.
        self.altered: dict[str, str] = {}
        self.chars = 0

    def marked(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def merge(self, unit: str) -> list[int]:
        """Ids of a unit: the pair with the best score is joined first, the left one of equals."""
        symbols = self.joined(unit) if len(unit) <= SHORT else self.joined_by_heap(unit)
        out = list(map(self.ids.get, symbols))
        if None not in out:
            return out
        out = []
        for s in symbols:
            if (known := self.ids.get(s)) is not None:
                out.append(known)
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode())
            else:
                out.append(self.unknown)
        return out

    def joined(self, unit: str) -> list[str]:
        """The agenda as a list beside the symbols: entry i is the cost of the pair (i, i + 1)."""
        symbols, cost = list(unit), self.cost.get
        agenda = [cost(a + b, NEVER) for a, b in zip(unit, unit[1:])]
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)
            symbols[i] = pair = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + pair, NEVER)
            if i < len(agenda):
                agenda[i] = cost(pair + symbols[i + 1], NEVER)
        return symbols

    def joined_by_heap(self, unit: str) -> list[str]:
        """The agenda as a heap, for long units; entries that merges have made stale are skipped."""
        symbols, cost = list(unit), self.cost
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(cost[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in cost]
        heapify(agenda)
        while agenda:
            _, i, pair = heappop(agenda)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := pair + symbols[k]) in cost:
                    heappush(agenda, (cost[p], i, p))
            h = before[i]
            if h >= 0 and (p := symbols[h] + pair) in cost:
                heappush(agenda, (cost[p], h, p))
        return [s for s in symbols if s]

    def spell(self, ids: list[int]) -> str:
        """Text of ids, the leading space included; runs of byte pieces are UTF-8."""
        parts = [self.spelled[i] for i in ids]
        if None not in parts:
            return "".join(parts)
        out = bytearray()
        for i in ids:
            if i in self.of_byte:
                out.append(self.of_byte[i])
            elif i not in self.special:
                out += self.spelled[i].encode()
            elif i == self.unknown:
                out += " ⁇ ".encode()
        return out.decode(errors="replace")

    def decode(self, ids: list[int]) -> str:
        return self.spell(ids).removeprefix(" ")

    def learn(self, units: set[str]) -> None:
        """Encodes units that are new, compares them with the library and keeps them."""
        new = [u for u in units if u not in self.coded]
        if not new:
            return
        led = [u.startswith(SPACE) for u in new]
        number = self.number.__getitem__
        # the library puts a space before a text; a line break keeps it apart from other units
        asked = [u[1:] if lead else "\n" + u for u, lead in zip(new, led)]
        for unit, lead, expected in zip(new, led, self.library.encode([a.replace(SPACE, " ") for a in asked], num_threads=1)):
            ids = self.merge(unit)
            if ids != (self.lone(unit) if unit == SPACE else expected if lead else expected[2:]):
                raise ValueError(f"ids of {unit!r} differ from the library's")
            self.coded[unit] = b"".join(map(number, ids))
            if (text := self.spell(ids)) != unit.replace(SPACE, " "):
                self.altered[unit] = text
            self.chars += len(unit)

    def decoded(self, units: list[str]) -> str:
        """Text of the ids of units, each decoded when it was learned."""
        if not self.altered.keys().isdisjoint(units):
            units = [self.altered.get(u, u) for u in units]
        return "".join(units).replace(SPACE, " ").removeprefix(" ")

    def forget(self) -> None:
        self.coded, self.altered, self.chars = {}, {}, 0

    def lone(self, unit: str) -> list[int]:
        """The library encodes the empty text to nothing; before a line break the space shows."""
        return self.library.encode("\n")[:1]

    def encode_all(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """Ids of each text as decimal numbers joined by commas, and the decoded texts."""
        coded, plain = [], []
        for start, end in chunks(texts):
            if len(self.coded) > KEPT_UNITS or self.chars > KEPT_CHARS:
                self.forget()
            parts = [self.units(self.marked(t)) if t else [] for t in texts[start:end]]
            self.learn(set().union(*parts))
            coded += [b"".join(map(self.coded.__getitem__, p))[:-1] for p in parts]
            plain += [self.decoded(p) for p in parts]
        first = next((i for i, t in enumerate(texts) if t), None)
        if first is not None:
            ids = self.library.encode(texts[first])
            if numbers(coded[first]).tolist() != ids or self.library.decode(ids) != plain[first]:
                raise ValueError("a text differs from the library's")
        return coded, plain


def numbers(coded: bytes) -> np.ndarray:
    return np.fromstring(coded, dtype=np.int32, sep=",") if coded else np.empty(0, np.int32)


@cache
def codec(model: str) -> PieceCodec:
    return PieceCodec(model)


FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]
IDS = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]


def encode(documents: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): n_tokens, ids_sha256, decoded_sha256
    and, if asked for, ids and the decoded text.

    ``model`` is the path of the vocabulary, the same on every executor.  Rows are
    independent: repeated and null doc_ids pass through.
    """

    def compute(texts):
        coded, plain = codec(model).encode_all(texts)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        out = [
            [c.count(b",") + 1 if c else 0 for c in coded],
            [digest(c) for c in coded],
            [digest(p.encode()) for p in plain],
        ]
        return out + [[numbers(c) for c in coded], plain] if with_ids else out

    rows = only(documents, "doc_id", "text")
    fields = FIELDS + IDS * with_ids
    names = ["doc_id", *(f.name for f in fields)]
    made = with_columns(rows, ["text"], fields, compute, lambda: codec(model).forget())
    return split(made, ["doc_id", "text", *names[1:]], names)
