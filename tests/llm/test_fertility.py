import math
import random
import re

import numpy as np
import pytest
import sentencepiece

from sigtrace.llm import fertility
from sigtrace.llm.queries import PATTERN, PIECES, RANKS

from .helpers import documents, odd_columns

SYLLABLES = ["ba", "re", "ti", "on", "the", "ing", "lo", "mu"]


def brute_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def odd_texts(rng):
    loop = "a b c d e f g h i"
    return [
        None, "", " \t\n", "one", "　  x y", "a" * 5000 + " b", "é́ 漢字 かな слово " * 30, "\U0001f600" * 40,
        loop, f"{loop} {loop}", " ".join(["x"] * 9), " ".join(["x"] * 8), " ".join(["x"] * 7), "l\nl\n\n\nl \nl\n x\n x",
        "#1 *a* $5 50% a&b |c| <d>", "w\x1cv w\x85v\r\nw\x1cv", "\n".join([prose(rng, 12)] * 5), prose(rng, 40) + " " + prose(rng, 3) * 40,
    ]


def test_counts_equal_brute_force(spark):
    rng = random.Random(3)
    texts = odd_texts(rng) + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    df = odd_columns(documents(spark, list(enumerate(texts)) + [(None, "one"), (3, "one")]))
    rows = fertility.judge(df, RANKS, PATTERN, PIECES).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        n, chars, symbols, dup, repeated = brute_counts("one" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated)
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n)
        assert not (r.kept and r.base_failed) and r.kept == (not r.base_failed and not r.reasons)


def test_measures_equal_the_libraries():
    rng = random.Random(5)
    known = fertility.Words(RANKS, PATTERN, PIECES)
    encoding, model = known.bytes, sentencepiece.SentencePieceProcessor(model_file=PIECES)
    names = [f.name for f in fertility.FIELDS]
    texts = [t for t in odd_texts(rng) if t and t.strip(" \t\n")]
    texts += ["a\u00a0\u00a0 b \u2003 \u2003\u2003 c\u2003", "it's we'll 'd '", "\u3000" * 30 + " x", "\x1c \x85 y"]
    texts += [prose(rng, rng.randint(1, 400)) for _ in range(30)]
    for text, values in zip(texts, fertility.measures(texts, known)):
        got = dict(zip(names, values))
        units = [w[i : i + 1000] for w in re.findall("[^\x20\x09-\x0d]+", text) for i in range(0, len(w), 1000)]
        ids = encoding.encode_ordinary("".join(" " + u for u in units))
        each = [i for u in units for i in model.encode(u)]
        chars = sum(map(len, units))
        assert got["n_tokens"] == len(ids)
        assert got["byte_chars"] == chars / len(ids) and got["piece_chars"] == chars / len(each)
        assert got["fallback"] == sum(map(model.is_byte, each)) / len(each)
        bits = size = 0
        for window in (w for i in range(0, len(ids), 128) if len(w := ids[i : i + 128]) > 1):
            h = -sum(window.count(t) / len(window) * math.log2(window.count(t) / len(window)) for t in set(window))
            bits, size = bits + h / math.log2(len(window)) * len(window), size + len(window)
        assert got["entropy"] == pytest.approx(bits / size if size else 1.0)


def test_script():
    assert fertility.script("abc слово") == "Cyrillic" and fertility.script("éñ ß 123") == "Latin"
    assert fertility.script("漢字漢 かな") == "Han" and fertility.script("12 !? ×÷") is None and fertility.script("") is None


def test_repeated_windows_at_their_edges():
    count = lambda words: fertility.repeated_words(np.array([ord(w) for w in words]))
    words = "abcdefgh"
    assert count(words) == 0 and count(words + "a") == 0 and count("") == 0
    assert count(words * 2) == 16 and count("x" * 9) == 9
    assert count(words + "z" + words + words[:3]) == 16


@pytest.fixture
def corpus():
    """Two languages of unlike fertility, and junk of four kinds in one of them."""
    rng = random.Random(9)
    french = "éà çê où près être garçon déjà".split()
    clean = [(i, prose(rng, rng.randint(30, 300)), "en") for i in range(300)]
    clean += [(300 + i, " ".join(rng.choice(french) + rng.choice(SYLLABLES) for _ in range(rng.randint(30, 300))), "fr") for i in range(300)]
    noise = lambda n: " ".join("".join(rng.choice("กข一Жא☃") for _ in range(6)) for _ in range(n))
    junk = [noise(80), prose(rng, 80).upper().replace(" ", "!!@@ "), " ".join(f"ba{'#' * (i % 40)}" for i in range(200)), " ".join("qzxj"[i % 3 :] for i in range(120))]
    return clean, [(900 + i, t, "en") for i, t in enumerate(junk)]


def test_bands_keep_clean_texts_of_each_language_and_reject_others(spark, corpus):
    clean, junk = corpus
    rows = clean + junk + [(1000 + i, clean[0][1], "en") for i in range(200)]  # copies weigh nothing in the bands
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in fertility.judge(df, RANKS, PATTERN, PIECES).collect()}
    assert np.mean([kept[i] for i, *_ in clean]) > 0.99
    assert not any(kept[i] for i, *_ in junk)
    assert kept[1000] == kept[0]


def test_rare_and_missing_languages_take_the_band_of_their_script(spark, corpus):
    clean, junk = corpus
    rows = [(i, t, None if i % 2 else f"x{i}") for i, t, _ in clean[:300] + junk]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    by_lang = {r.doc_id: r.kept for r in fertility.judge(df, RANKS, PATTERN, PIECES).collect()}
    without = {r.doc_id: r.kept for r in fertility.judge(df.drop("lang"), RANKS, PATTERN, PIECES).collect()}
    assert by_lang == without
    assert np.mean([by_lang[i] for i, *_ in clean[:300]]) > 0.99 and not any(by_lang[i] for i, *_ in junk[1:])


def test_empty_table_and_too_few_texts_for_bands(spark):
    assert fertility.judge(documents(spark, []), RANKS, PATTERN, PIECES).count() == 0
    rows = [(1, "word " * 8 + " ".join(map(str, range(30)))), (2, "too few")]
    assert {r.doc_id: r.kept for r in fertility.judge(documents(spark, rows), RANKS, PATTERN, PIECES).collect()} == {1: True, 2: False}


def test_a_very_long_text_and_a_very_long_word(spark):
    text = "x" * 300_000 + " " + "word next " * 100_000
    row = fertility.judge(documents(spark, [(1, text)]), RANKS, PATTERN, PIECES).first()
    assert (row.n_words, row.word_chars, row.n_repeat_words) == (200_001, 300_000 + 800_000, 200_000)
