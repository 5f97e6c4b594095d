"""Quality rules by tokeniser fertility: how well public vocabularies fit a text.

A text's words, joined by single spaces, are encoded with a byte-level vocabulary
(tiktoken) and each word with a piece vocabulary that falls back to bytes
(sentencepiece).  Measured are characters per token under both, the share of tokens
that are fallback bytes, and the entropy of the tokens: in windows of ``SPAN`` tokens,
relative to the largest a window can have, so that long and short texts compare.

Each measure has a band of accepted values for each language, or for the script where
a language is null or rare, or for all texts where the script is rare too.  Bands come
from the quartiles over all distinct texts that pass the base rules: the median, less
or plus ``WIDTH`` times its distance to the quartile.  Texts of few tokens vary more, so
their bands are wider.  A text outside a band is rejected, and so is one that
fails a base rule (too few words, too many repeated windows).

Words are runs without ASCII white space; of words beyond ``LONGEST`` characters, stretches
of that length are words to the vocabularies.  Null and empty texts have no words: all
counts and measures are 0 and they fail the base rules.  Repeated rows are judged each,
but count once in the bands.  Where too few texts are there for any band, only the base
rules judge.  Columns other than doc_id, text and lang (optional) play no part.
"""

from __future__ import annotations

import base64
import math
import re
from collections import defaultdict
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtrace.operators.staging import stage

from .rows import chunks, only, split, with_columns

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = "#*$%&|<>"
#: Base rules: words of a repeated window, least words, largest share of repeated words in percent.
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
#: Tokens of an entropy window, and characters of a word that are encoded at once.
SPAN, LONGEST = 128, 1000
#: Bands: quartile distances, tokens from which a text's band is not widened, and least distances in grid steps.
WIDTH, STEADY, LEAST = 6.0, 512, 2
#: Distinct texts that a band needs, and the share of all of them (so there are at most 1,000 languages with a band).
MIN_TEXTS, MIN_SHARE = 200, 0.001
#: Measures are counted on a grid of this step, which makes quartiles exact and histograms small.
STEP = 0.001
#: Words that a task remembers.
KEPT = 300_000

#: First code points of runs of one script, fixed values of the Unicode block list; letters elsewhere are "other".
SCRIPTS = [
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0780, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other"), (0x0B80, "Tamil"), (0x0C00, "other"),
    (0x0E00, "Thai"), (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0x4DC0, "other"),
    (0x4E00, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"), (0x20000, "Han"),
    (0x32000, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})
STARTS = np.array([s for s, _ in SCRIPTS])
CODES = np.array([-1, *(NAMES.index(name) for _, name in SCRIPTS)])
#: Code points in this range that are no letters.
PLAIN = np.array([not (0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0xC0 and c not in (0xD7, 0xF7)) for c in range(0x250)])

MEASURES = ["byte_chars", "piece_chars", "fallback", "entropy"]


class Words:
    """What both vocabularies make of words; a task remembers the words it has met."""

    def __init__(self, ranks: str, pattern: str, pieces: str):
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        self.bytes = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.sizes = np.zeros(max(known.values()) + 1, np.int64)
        self.sizes[list(known.values())] = list(map(len, known))
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.chars = self.n_pieces = self.n_fallback = self.tokens = np.empty(0, np.int64)
        self.ends = np.zeros(1, np.int64)  # of the words' tokens

    def codes(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The words of each text as numbers."""
        if len(self.number) > KEPT:
            self.forget()
        old = len(self.number)
        out = [np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)) for words in texts]
        if new := list(islice(reversed(self.number), len(self.number) - old))[::-1]:
            self._learn(new)
        return out

    def _learn(self, words: list[str]) -> None:
        tokens = np.array(self.bytes.encode_ordinary(" " + " ".join(words)), np.int64)
        # a token never goes over a space, so the words' sizes tell their tokens
        spans, at = np.cumsum([len(w.encode()) + 1 for w in words]), np.cumsum(self.sizes[tokens])
        ends = np.searchsorted(at, spans) + 1
        pieces = self.pieces.encode(words, num_threads=1)
        sizes = np.fromiter(map(len, pieces), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        fallback = self.is_byte[np.fromiter(chain.from_iterable(pieces), np.int64, int(sizes.sum()))]
        self.chars = np.concatenate([self.chars, np.fromiter(map(len, words), np.int64, len(words))])
        self.n_pieces = np.concatenate([self.n_pieces, sizes])
        self.n_fallback = np.concatenate([self.n_fallback, np.bincount(owner, fallback, len(words)).astype(np.int64)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends])
        self.tokens = np.concatenate([self.tokens, tokens])

    def tokens_of(self, codes: np.ndarray) -> np.ndarray:
        """The byte-level tokens of words in their order."""
        starts = self.ends[codes]
        sizes = self.ends[codes + 1] - starts
        before = np.cumsum(sizes) - sizes
        return self.tokens[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


@lru_cache(maxsize=2)
def vocabularies(ranks: str, pattern: str, pieces: str) -> Words:
    return Words(ranks, pattern, pieces)


def repeated_words(code: np.ndarray, size: int = WINDOW) -> int:
    """Words (numbered) inside windows of ``size`` (a power of two) words found twice or more, first included."""
    n = len(code) - size + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):  # different hashes are different windows, so most texts end here
        mixed = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        hashes = np.zeros(n, np.uint64)
        for i in range(size):
            hashes = hashes * np.uint64(0x100000001B3) + mixed[i : i + n]
    hashes.sort()
    if not (hashes[1:] == hashes[:-1]).any():
        return 0
    width = 1
    while width < size:  # windows of twice the width are pairs of windows, numbered anew
        _, code = np.unique(code, return_inverse=True)
        code = code[:-width] * (int(code.max()) + 1) + code[width:]
        width *= 2
    _, code = np.unique(code, return_inverse=True)
    often = np.bincount(code)[code] > 1
    edges = np.zeros(n + size, np.int64)
    edges[:n] += often
    edges[size:] -= often
    return int((np.cumsum(edges)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(lines) - len(set(lines))


def script(text: str) -> str | None:
    """The script of most letters (the first by name of equals), None without letters."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    low = points < len(PLAIN)
    letters = points[~(low & PLAIN[np.where(low, points, 0)])]
    codes = CODES[np.searchsorted(STARTS, letters, side="right")]
    codes = codes[codes >= 0]
    return NAMES[int(np.bincount(codes).argmax())] if len(codes) else None


def entropy(ids: np.ndarray, span: int = SPAN) -> float:
    """Mean entropy of windows of ``span`` tokens relative to the largest possible, by their tokens; the last may be shorter.

    A window of one token says nothing and is left out; a text of one token has 1.
    """
    window = np.arange(len(ids)) // span
    keys, counts = np.unique(window * (int(ids.max(initial=0)) + 1) + ids, return_counts=True)
    sizes = np.bincount(window)
    wide = sizes > 1
    if not wide.any():
        return 1.0
    of = keys // (int(ids.max(initial=0)) + 1)
    bits = np.log2(sizes) - np.bincount(of, counts * np.log2(counts), len(sizes)) / sizes
    return float((bits[wide] / np.log2(sizes[wide]) * sizes[wide]).sum() / sizes[wide].sum())


def cut(words: list[str]) -> list[str]:
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")),
    *(T.StructField(n, T.DoubleType()) for n in MEASURES),
    T.StructField("script", T.StringType()),
]


NOTHING = (0, 0, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, None)


def measures(texts: list[str | None], known: Words) -> list[tuple]:
    """The values of ``FIELDS`` for each text."""
    words = [WORD.findall(t) if t else [] for t in texts]
    pieces_of = list(map(cut, words))
    out = []
    for text, own, units, codes in zip(texts, words, pieces_of, known.codes(pieces_of)):
        if not own:
            out.append(NOTHING)
            continue
        tokens = known.tokens_of(codes)
        chars, pieces = int(known.chars[codes].sum()), int(known.n_pieces[codes].sum())
        if len(units) > len(own):  # repeated windows are of whole words
            number: dict[str, int] = {}
            codes_of_words = np.array([number.setdefault(w, len(number)) for w in own], np.int64)
        else:
            codes_of_words = codes
        fallback = int(known.n_fallback[codes].sum()) / max(1, pieces)
        out.append((
            len(own), chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated_words(codes_of_words), len(tokens),
            chars / len(tokens), chars / max(1, pieces), fallback, entropy(tokens), script(text),
        ))
    return out


def measured(documents: DataFrame, ranks: str, pattern: str, pieces: str) -> DataFrame:
    """doc_id, text, lang (null where ``documents`` has none) and ``FIELDS`` of every row.

    ``ranks`` and ``pieces`` are paths of vocabulary files that every executor has, ``pattern`` splits words for ``ranks``.
    """
    names = ["doc_id", "text", "lang"] if "lang" in documents.columns else ["doc_id", "text"]

    def compute(texts):
        known = vocabularies(ranks, pattern, pieces)
        rows = [row for a, b in chunks(texts) for row in measures(texts[a:b], known)]
        return list(zip(*rows))

    made = with_columns(only(documents, *names), ["text"], FIELDS, compute, vocabularies.cache_clear)
    named = split(made, [*names, *(f.name for f in FIELDS)], [*names, *(f.name for f in FIELDS)])
    return named if "lang" in names else named.withColumn("lang", F.lit(None).cast("string"))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def groups() -> list[F.Column]:
    """Names of the groups that a text's bands may come from; the first that has bands gives them."""
    return [F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("script:"), "script"), F.lit("all")]


def bands(texts: DataFrame) -> DataFrame:
    """(group, quartiles map<measure, array>) over the distinct texts (key, lang, script, measures) that pass the base rules.

    Only groups with ``MIN_TEXTS`` texts and ``MIN_SHARE`` of all have bands, so that there are at
    most 1,000 languages and the few scripts, however many distinct values ``lang`` has.
    """
    distinct = texts.where(~F.col("base_failed")).groupBy("key", "lang", "script").agg(*(F.first(m).alias(m) for m in MEASURES))
    steps = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.round(F.col(m) / STEP).cast("long").alias("at")) for m in MEASURES)))
    counted = (
        distinct.select(F.explode(F.array_compact(F.array(*groups()))).alias("group"), *MEASURES)
        .select("group", steps.alias("s"))
        .groupBy("group", "s.measure", "s.at")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    quartiles = F.expr("percentile(at, array(0.25, 0.5, 0.75), n)")
    parts = stage(counted.groupBy("group", "measure").agg(F.sum("n").alias("n"), quartiles.alias("quartiles")))
    every = parts.where("group = 'all'").agg(F.max("n")).first()[0] or 0
    wide = parts.where(F.col("n") >= max(MIN_TEXTS, math.ceil(MIN_SHARE * every)))
    return stage(wide.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("measure", "quartiles"))).alias("quartiles")))


def outside(quartiles: F.Column) -> F.Column:
    """Names of the measures outside their bands: fallback too high, entropy too low, characters per token either."""
    tokens = F.greatest(F.lit(1.0), F.col("n_tokens").cast("double"))
    width = F.lit(WIDTH) * F.sqrt(F.greatest(F.lit(1.0), F.lit(float(STEADY)) / tokens))
    distance = lambda d: width * F.greatest(F.lit(float(LEAST)), d)

    def bad(measure: str, low: bool, high: bool) -> F.Column:
        q, at = F.try_element_at(quartiles, F.lit(measure)), F.round(F.col(measure) / STEP)
        out = (F.lit(low) & (at < q[1] - distance(q[1] - q[0]))) | (F.lit(high) & (at > q[1] + distance(q[2] - q[1])))
        return F.when(out, F.lit(measure))

    sides = [("byte_chars", True, True), ("piece_chars", True, True), ("fallback", False, True), ("entropy", True, False)]
    return F.array_compact(F.array(*(bad(*side) for side in sides)))


def judge(documents: DataFrame, ranks: str, pattern: str, pieces: str) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text, lang if there): counts, measures, base_failed, reasons and kept.

    ``reasons`` names the measures outside their bands; ``kept`` is whether there are none and the base rules hold.
    """
    made = measured(documents, ranks, pattern, pieces)
    rows = made.withColumn("key", F.xxhash64("text")).drop("text").withColumn("base_failed", base_failed())
    rows = stage(rows)
    found = bands(rows)  # few rows, see there
    for i, name in enumerate(groups()):
        known = F.broadcast(found.select(F.col("group").alias(f"group{i}"), F.col("quartiles").alias(f"quartiles{i}")))
        rows = rows.join(known, name == F.col(f"group{i}"), "left")
    quartiles = F.coalesce(*(f"quartiles{i}" for i in range(len(groups()))))
    none = F.array().cast("array<string>")
    reasons = F.when(F.col("base_failed") | quartiles.isNull(), none).otherwise(outside(quartiles))
    columns = ["doc_id", "lang", *(f.name for f in FIELDS), "base_failed"]
    judged = rows.select(*columns, reasons.alias("reasons"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
