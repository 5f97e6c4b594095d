"""Language identification word by word with a linear-chain conditional random field.

A word's emission is the sum of learned weights of its features: affixes and inner
character n-grams (hashed), and the word itself where the learned lexicon has it.
Learned transitions join neighbouring words; forward-backward gives each word's
probability of each language, also in code-switched text.  A document takes the
language with the largest mean probability over all its words; that mean is the score.

Training reads text and lang of a bounded sample: at most ``DOCUMENTS`` distinct texts of
each language in expectation, chosen by the hash of the text, with ``FRAGMENTS``
stretches of ``STRETCH`` words spread over each text.  All languages take part; the
driver holds some 1.5 MB of weights for each.  Prediction reads whole texts.

A text is rejected by ``keep_identified`` if its words are unlike those of every learned
language: too few of their three-character runs were seen in training, measured against how
many a new text of these languages has (the Good-Turing estimate of the sample).

A text that is null, empty or without letters is ``und`` with score 0, and so is every
text when there is nothing to learn from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtrace.operators.sizing import broadcast_if_small
from sigtrace.operators.staging import stage

from .rows import chunks, only, original, split, with_columns

UNKNOWN = "und"
#: Bounds of the training sample: distinct texts of a language, stretches of a text, words of a
#: stretch, and characters of a word.
DOCUMENTS, FRAGMENTS, STRETCH, LETTERS = 500, 4, 32, 64
#: Buckets of hashed n-grams, a power of two, and the largest n; both word ends count as characters.
BUCKETS, LONGEST = 1 << 16, 4
#: Words of the lexicon: seen this often in the sample.
LEXICON_COUNT = 5
EPOCHS, BATCH, RATE, DECAY = 4, 64, 0.1, 1e-4
#: Word emissions kept between batches of a task, and words whose n-grams are looked up at once.
KEPT, SLICE = 250_000, 10_000
#: Documents whose words have a mean largest probability below this are rejected; however many languages share
#: a document, it stays where its words are clear.
MIN_SCORE = 0.4
#: Least share of known runs in a document's words, of the share that new texts of the learned languages have.
MIN_KNOWN = 0.75

WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def gram_hashes(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, and the word that each belongs to."""
    lengths = np.fromiter(map(len, many), np.int64, len(many)) + 2
    flat = np.frombuffer("".join([f"^{w}$" for w in many]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(many)), lengths)
    code = np.zeros(len(flat), np.uint64)
    hashes, owners = [], []
    with np.errstate(over="ignore"):
        for n in range(1, LONGEST + 1):
            size = max(0, len(flat) - n + 1)
            code = code[:size] * np.uint64(0x100000001B3) + flat[n - 1 : n - 1 + size]
            inside = owner[:size] == owner[n - 1 : n - 1 + size]
            mixed = (code[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            hashes.append((mixed >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1))
            owners.append(owner[:size][inside])
    return np.concatenate(hashes), np.concatenate(owners)


def runs(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The three-character runs of all words, both ends included, as numbers, and the word that each belongs to."""
    lengths = np.fromiter(map(len, many), np.int64, len(many)) + 2
    flat = np.frombuffer("".join([f"^{w}$" for w in many]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(many)), lengths)
    inside = owner[:-2] == owner[2:]
    shift = np.uint64(21)  # code points have 21 bits
    return (((flat[:-2] << shift | flat[1:-1]) << shift) | flat[2:])[inside], owner[:-2][inside]


@dataclass
class Field:
    """A trained model; ``kept`` is a task's memory of emissions and shares of known runs."""

    languages: list[str]
    grams: np.ndarray
    lexicon: dict[str, int]
    lexical: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    #: Runs seen in training, sorted, and the share of known runs to expect of a new text.
    seen: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    expected: float = 0.0
    kept: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None
    shares: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "kept": {}, "table": None, "shares": None}

    def known(self, many: list[str]) -> np.ndarray:
        """Share of the runs of each word that were seen in training."""
        found, owner = runs(many)
        at = np.minimum(np.searchsorted(self.seen, found), max(0, len(self.seen) - 1))
        hit = self.seen[at] == found if len(self.seen) else np.zeros(len(found), bool)
        return np.bincount(owner, hit, len(many)) / np.bincount(owner, minlength=len(many))

    def emissions(self, many: list[str]) -> np.ndarray:
        """Log weights of each language for each word, scaled by the number of its n-grams."""
        hashes, owner = gram_hashes(many)
        out = np.stack([np.bincount(owner, w, len(many)) for w in self.grams[hashes].T], axis=1)
        out /= np.bincount(owner, minlength=len(many))[:, None] ** 0.5
        known = [(i, self.lexicon[w]) for i, w in enumerate(many) if w in self.lexicon]
        if known:
            at, entry = np.array(known).T
            out[at] += self.lexical[entry]
        return out

    def numbered(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Words as rows of ``table``, which holds exp(emission); new words are added."""
        if len(self.kept) > KEPT or self.table is None:
            self.forget()
        new = list(set().union(*texts).difference(self.kept))
        if new:
            self.kept.update(zip(new, range(len(self.kept), len(self.kept) + len(new))))
            made = np.vstack([self.emissions(new[i : i + SLICE]) for i in range(0, len(new), SLICE)])
            self.table = np.vstack([self.table, np.exp(made - made.max(axis=1, keepdims=True))])
            self.shares = np.concatenate([self.shares, *(self.known(new[i : i + SLICE]) for i in range(0, len(new), SLICE))])
        get = self.kept.__getitem__
        return [np.fromiter(map(get, t), np.int64, len(t)) for t in texts]

    def forget(self) -> None:
        self.kept, self.table, self.shares = {}, np.empty((0, len(self.languages))), np.empty(0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[float]]:
        """Languages, their scores, how sure the words are (the mean of each word's largest probability), and how well
        known: the mean share of known runs, relative to the expected one.

        Without languages nothing speaks against a text that has words, which is as sure and known as can be.
        """
        names, scores, sure, known = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not self.languages:
            some = [float(bool(t and WORD.search(t))) for t in texts]
            return names, scores, some, some
        for a, b in chunks(texts):
            found = {i: w for i in range(a, b) if (w := words(texts[i]))}
            rows = self.numbered(list(found.values()))
            for i, mass, peak in zip(found, *self.marginals(rows)):
                best = int(mass.argmax())
                names[i], scores[i], sure[i] = self.languages[best], min(1.0, float(mass[best])), min(1.0, float(peak))
            for i, row in zip(found, rows):
                known[i] = min(1.0, float(self.shares[row].mean()) / max(self.expected, 1e-9))
        return names, scores, sure, known

    def marginal_means(self, rows: list[np.ndarray]) -> np.ndarray:
        """Mean probability of each language over the words of each text."""
        return self.marginals(rows)[0]

    def marginals(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Means over the words of each text: of each language's probability, and of the largest one."""
        if not rows:
            return np.empty((0, len(self.languages))), np.empty(0)
        lengths = np.array([len(r) for r in rows])
        order = np.argsort(-lengths, kind="stable")
        emission = TimeMajor([rows[i] for i in order], self.table)
        sums, peaks = np.zeros((len(rows), len(self.languages))), np.zeros(len(rows))
        for _, gamma in forward_backward(emission, np.exp(self.transitions), np.exp(self.start)):
            sums[: len(gamma)] += gamma
            peaks[: len(gamma)] += gamma.max(axis=1)
        out, largest = np.empty_like(sums), np.empty_like(peaks)
        out[order] = sums / lengths[order][:, None]
        largest[order] = peaks / lengths[order]
        return out, largest


class TimeMajor:
    """Sequences, longest first, read step by step: at step t only those longer than t."""

    def __init__(self, rows: list[np.ndarray], table: np.ndarray):
        lengths = np.array([len(r) for r in rows])
        self.active = len(rows) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        self.starts = np.concatenate(([0], np.cumsum(self.active)))
        self.rows = np.empty(int(lengths.sum()), np.int64)
        for j, r in enumerate(rows):
            self.rows[self.starts[: len(r)] + j] = r
        self.table = table

    def __len__(self) -> int:
        return len(self.active)

    def at(self, t: int) -> np.ndarray:
        return self.table[self.rows[self.starts[t] : self.starts[t + 1]]]


def forward_backward(emission: TimeMajor, move: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(step, probability of each label for the active sequences), from the last step to the first."""
    steps = len(emission)
    forward = np.empty((len(emission.rows), len(start)))
    a = emission.at(0) * start
    for t in range(steps):
        if t:
            a = (a[: emission.active[t]] @ move) * emission.at(t)
        a = a / a.sum(axis=1, keepdims=True)
        forward[emission.starts[t] : emission.starts[t + 1]] = a
    b = np.ones((0, len(start)))
    for t in range(steps - 1, -1, -1):
        n = emission.active[t]
        if t + 1 < steps:
            b = (b * emission.at(t + 1)) @ move.T
            b /= b.sum(axis=1, keepdims=True)
        if len(b) < n:  # sequences that end here
            b = np.vstack([b, np.ones((n - len(b), len(start)))])
        gamma = forward[emission.starts[t] : emission.starts[t + 1]] * b
        yield t, gamma / gamma.sum(axis=1, keepdims=True)


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(documents: DataFrame, per_language: int = DOCUMENTS) -> list[tuple[str, list[str]]]:
    """(lang, words of a stretch) of the training documents; bounded, see the module text."""
    known = only(documents, "doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id"))
    )
    # copies count once, so that a text with many of them takes no other text's place
    texts = known.select("lang", F.xxhash64("text", F.lit(1)).alias("text")).distinct()
    shares = stage(texts.groupBy("lang").agg((F.lit(per_language) / F.count(F.lit(1))).alias("share")))
    drawn = known.withColumn("draw", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30)))
    # the hash decides, so that a text is always in or always out
    chosen = drawn.join(broadcast_if_small(shares), "lang").where(F.col("draw") < F.col("share") * (1 << 30)).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, stretches = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                spread = np.linspace(0, max(0, len(found) - STRETCH), FRAGMENTS).astype(int)
                for at in dict.fromkeys(spread.tolist()):
                    if part := [w[:LETTERS] for w in found[at : at + STRETCH]]:
                        langs.append(lang)
                        stretches.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(stretches, pa.list_(pa.string()))], names=["lang", "words"])

    # copies of a text share its hash and come in together: each stretch counts once
    rows = stage(chosen.mapInArrow(cut, "lang string, words array<string>").distinct())
    return sorted((lang, list(part)) for lang, part in rows.collect())


def train(stretches: list[tuple[str, list[str]]], seed: int = 7) -> Field:
    """Fits all weights by gradient ascent on the conditional likelihood (AdaGrad, small batches).

    Each training sequence lays one to three stretches end to end, often of different
    languages, so that transitions are learned from switches as well.
    """
    languages = sorted({lang for lang, _ in stretches})
    k = len(languages)
    number = {lang: i for i, lang in enumerate(languages)}
    counts = Counter(w for _, part in stretches for w in part)
    lexicon = {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= LEXICON_COUNT))}
    model = Field(languages, np.zeros((BUCKETS, k)), lexicon, np.zeros((len(lexicon), k)), np.zeros((k, k)), np.zeros(k))
    if k == 0:
        return model
    model.seen, model.expected = familiar([part for _, part in stretches])
    rng = np.random.default_rng(seed)
    weights = [model.grams, model.lexical, model.transitions, model.start]
    squares = [np.full_like(w, 1e-6) for w in weights]
    vocabulary = sorted(counts)
    place = {w: i for i, w in enumerate(vocabulary)}
    hashes, owner = gram_hashes(vocabulary)
    by_word = np.argsort(owner, kind="stable")
    hashes, owner = hashes[by_word], owner[by_word]
    bounds = np.searchsorted(owner, np.arange(len(vocabulary) + 1))
    scale = 1 / np.sqrt(np.diff(bounds))
    entry = np.array([lexicon.get(w, -1) for w in vocabulary])
    for _ in range(EPOCHS):
        shuffled = [stretches[i] for i in rng.permutation(len(stretches))]
        sequences = []
        while shuffled:
            n = int(rng.integers(1, 4))
            taken, shuffled = shuffled[:n], shuffled[n:]
            sequences.append(([place[w] for _, p in taken for w in p], [number[x] for x, p in taken for _ in p]))
        for at in range(0, len(sequences), BATCH):
            batch = sorted(sequences[at : at + BATCH], key=lambda s: -len(s[0]))
            used, inverse = np.unique(np.concatenate([s[0] for s in batch]), return_inverse=True)
            picks = np.concatenate([np.arange(bounds[u], bounds[u + 1]) for u in used])
            of = np.repeat(np.arange(len(used)), np.diff(bounds)[used])
            logits = np.stack([np.bincount(of, w, len(used)) for w in model.grams[hashes[picks]].T], axis=1) * scale[used][:, None]
            lexical = entry[used] >= 0
            logits[lexical] += model.lexical[entry[used][lexical]]
            table = np.exp(logits - logits.max(axis=1, keepdims=True))
            cuts = np.cumsum([len(s[0]) for s in batch])[:-1]
            steps = TimeMajor(np.split(inverse, cuts), table)
            labels = TimeMajor([np.array(s[1]) for s in batch], np.eye(k))
            by_word_error, moves, start = gradients(steps, labels, model, len(used))
            gram_error = np.zeros_like(model.grams)
            np.add.at(gram_error, hashes[picks], (by_word_error * scale[used][:, None])[of])
            lexical_error = np.zeros_like(model.lexical)
            lexical_error[entry[used][lexical]] = by_word_error[lexical]
            for w, s, g in zip(weights, squares, (gram_error, lexical_error, moves, start)):
                g = g / len(batch) - DECAY * w
                s += g * g
                w += RATE * g / np.sqrt(s)
    return model


def familiar(stretches: list[list[str]]) -> tuple[np.ndarray, float]:
    """All runs of the stretches, sorted, and the share of its runs that a new stretch would find among them.

    By Good and Turing that is one less the share of runs that only one stretch has; half at least, for tiny samples.
    """
    found, owner = runs([w for part in stretches for w in part])
    of = np.repeat(np.arange(len(stretches)), list(map(len, stretches)))[owner]
    order = np.lexsort((of, found))
    found, of = found[order], of[order]
    first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    last = np.concatenate((first[1:], [len(found)])) - 1
    alone = of[first] == of[last]
    return found[first], max(0.5, 1 - float((last - first + 1)[alone].sum()) / len(found))


def gradients(steps: TimeMajor, labels: TimeMajor, model: Field, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Observed minus expected counts: by word, of transitions and of first labels."""
    k = len(model.languages)
    move = np.exp(model.transitions)
    by_word, moves, start = np.zeros((n_words, k)), np.zeros((k, k)), np.zeros(k)
    gammas = {}
    for t, gamma in forward_backward(steps, move, np.exp(model.start)):
        truth = labels.at(t)
        np.add.at(by_word, steps.rows[steps.starts[t] : steps.starts[t + 1]], truth - gamma)
        gammas[t] = gamma
        if t == 0:
            start += (truth - gamma).sum(axis=0)
        if t + 1 in gammas:
            after = gammas.pop(t + 1)
            n = len(after)
            moves += truth[:n].T @ labels.at(t + 1) - pair_counts(gamma[:n], after, move)
    return by_word, moves, start


def pair_counts(before: np.ndarray, after: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Expected transitions whose margins are the given probabilities (scaled to them in turn)."""
    pair = before[:, :, None] * move[None] * after[:, None, :]
    for _ in range(3):
        pair *= (before / np.maximum(pair.sum(axis=2), 1e-300))[:, :, None]
        pair *= (after / np.maximum(pair.sum(axis=1), 1e-300))[:, None, :]
    return pair.sum(axis=0)


def fit(documents: DataFrame, per_language: int = DOCUMENTS) -> Field:
    return train(sample(documents, per_language))


FIELDS = [T.StructField("lang_pred", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("score", "sure", "known"))]


def labelled(documents: DataFrame, model: Field) -> DataFrame:
    """All columns of ``documents`` and, last, lang_pred, score, sure and known (see ``Field.judge``)."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return with_columns(documents, ["text"], FIELDS, lambda texts: sent.value.judge(texts), lambda: sent.value.forget())


def identify(documents: DataFrame, model: Field | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``documents`` (doc_id, text, lang).

    Without a model one is fitted to the rows that are not held out.
    """
    rows = only(documents, "doc_id", "text")
    made = split(labelled(rows, model or fit(documents)), ["doc_id", "text", *(f.name for f in FIELDS)], ["doc_id", "lang_pred", "score"])
    return made.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(documents: DataFrame, min_score: float = MIN_SCORE, min_known: float = MIN_KNOWN) -> DataFrame:
    """``documents`` without those that have no letters, whose words are unlike every learned language (``known`` below
    ``min_known``) or have no clear one (``sure`` below ``min_score``).  A null ``lang`` becomes the predicted one.

    Where no document has a lang there is nothing to learn from, and all with letters stay, with a null lang.
    """
    made = labelled(documents, fit(documents))
    predicted, _, sure, known = (F.col(c) for c in made.columns[-4:])
    kept = made.where((sure > 0) & (sure >= min_score) & (known >= min_known))
    at = documents.columns.index("lang")
    lang = F.coalesce(F.col(f"c{at}"), F.when(predicted != UNKNOWN, predicted)).alias(f"c{at}")
    return original(kept.select(*(lang if i == at else F.col(c) for i, c in enumerate(kept.columns))), documents)
