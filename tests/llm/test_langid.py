import random
from itertools import product

import numpy as np
import pytest

from sigtrace.llm import langid as L

from .helpers import full_documents, odd_columns

SYLLABLES = {"xx": ["ka", "ko", "ki", "tu"], "yy": ["sel", "mel", "rin", "don"], "zz": ["ñu", "ña", "gé", "pé"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)) + "."


def corpus(rng, n=400):
    return [(i, text(rng, lang := list(SYLLABLES)[i % 3], rng.randint(3, 60)), lang) for i in range(n)]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    model = L.Field(["a", "b", "c"], np.zeros((1, 3)), {}, np.zeros((0, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    model.table = np.exp(rng.normal(size=(9, 3)))
    rows = [rng.integers(0, 9, n) for n in (1, 4, 2, 5, 4)]
    for row, mean in zip(rows, model.marginal_means(rows)):
        total = np.zeros(3)
        for labels in product(range(3), repeat=len(row)):
            weight = np.exp(model.start[labels[0]] + sum(model.transitions[a, b] for a, b in zip(labels, labels[1:])))
            weight *= np.prod([model.table[w, x] for w, x in zip(row, labels)])
            for x in labels:
                total[x] += weight
        assert np.allclose(mean, total / total.sum())


def test_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(2)
    model = L.Field(["a", "b"], np.zeros((1, 2)), {}, np.zeros((0, 2)), rng.normal(size=(2, 2)) / 4, rng.normal(size=2) / 4)
    logits = rng.normal(size=(5, 2))
    rows, labels = [np.array([0, 3, 1, 2]), np.array([4, 0])], [np.array([0, 1, 1, 0]), np.array([1, 1])]

    def likelihood():
        total = 0
        for row, truth in zip(rows, labels):
            weight = lambda y: model.start[y[0]] + sum(logits[w, x] for w, x in zip(row, y)) + sum(model.transitions[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
            total += weight(truth) - np.log(sum(np.exp(weight(y)) for y in product(range(2), repeat=len(row))))
        return total

    steps = L.TimeMajor(rows, np.exp(logits))
    by_word, moves, start = L.gradients(steps, L.TimeMajor(labels, np.eye(2)), model, 5)
    for array, slope in ((logits, by_word), (model.transitions, moves), (model.start, start)):
        for at in np.ndindex(array.shape):
            array[at] += 1e-5
            up = likelihood()
            array[at] -= 2e-5
            down = likelihood()
            array[at] += 1e-5
            assert abs((up - down) / 2e-5 - slope[at]) < 5e-3


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(4)
    rows = corpus(rng)
    odd = [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 !!", "xx"), (1003, text(rng, "yy", 20_000), None), (1004, text(rng, "zz", 9), None), (None, text(rng, "xx", 9), "xx")]
    df = full_documents(spark, [(i, t) for i, t, _ in rows + odd], {i: g for i, _, g in rows + odd})
    got = {r.doc_id: r for r in L.identify(odd_columns(df)).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [(got[i].lang_pred == g) for i, _, g in rows if got[i].held_out]
    assert len(held) > 100 and sum(held) / len(held) > 0.97
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "yy" and got[1004].lang_pred == "zz" and got[None].lang_pred == "xx" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())


def test_code_switched_words_are_labelled():
    rng = random.Random(6)
    stretches = [(g, L.words(text(rng, g, 30))) for g in SYLLABLES for _ in range(60)]
    model = L.train(stretches)
    assert (np.diag(model.transitions) > model.transitions.mean()).all()
    mixed = text(rng, "xx", 30) + " " + text(rng, "yy", 10)
    names, scores = model.predict([mixed])
    assert names == ["xx"] and 0.65 < scores[0] < 0.85
    assert model.predict([mixed]) == (names, scores)  # the memory of emissions changes nothing


def test_nothing_to_learn_from(spark):
    df = full_documents(spark, [(0, "some text"), (1, None)], {0: None, 1: None})
    assert [(r.lang_pred, r.score) for r in L.identify(df).collect()] == [("und", 0.0)] * 2
    assert L.identify(df.limit(0)).count() == 0


def test_rejected_documents_go(spark):
    rng = random.Random(8)
    rows = corpus(rng, 150)
    df = full_documents(spark, [(i, t) for i, t, _ in rows] + [(500, "12 ??"), (501, None)], {**{i: g for i, _, g in rows}, 500: "xx", 501: "xx"})
    kept = L.keep_identified(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in rows}


def test_copies_do_not_crowd_out_other_texts(spark):
    rng = random.Random(12)
    rows = [(i, text(rng, "xx", 12), "xx") for i in range(200)] + [(i, "sel mel rin don", "yy") for i in range(1000, 3000)]
    rows += [(i, text(rng, "yy", 12), "yy") for i in range(3000, 3100)]
    df = full_documents(spark, [(i, t) for i, t, _ in rows], {i: g for i, _, g in rows})
    drawn = L.sample(df, per_language=40)
    count = lambda g: len({tuple(part) for lang, part in drawn if lang == g})
    assert 20 < count("xx") < 80 and 20 < count("yy") < 80


def test_every_language_is_learnt(spark):
    rows = [(i, f"word{chr(97 + g // 26)}{chr(97 + g % 26)} " * 5, f"l{g:03}") for g in range(90) for i in (3 * g, 3 * g + 100_000)]
    df = full_documents(spark, [(i, t) for i, t, _ in rows], {i: g for i, _, g in rows})
    known = {r.lang for r in df.where(~L.is_held_out(df.doc_id)).select("lang").distinct().collect()}
    assert len(known) > 64 and {lang for lang, _ in L.sample(df)} == known


def test_documents_in_many_languages_stay(spark, monkeypatch):
    syllables = {**SYLLABLES, "vv": ["bra", "bru", "bro"], "ww": ["whi", "whe", "who"]}
    monkeypatch.setattr(f"{__name__}.SYLLABLES", syllables)
    rng = random.Random(13)
    rows = [(i, text(rng, lang := list(syllables)[i % 5], 30), lang) for i in range(300)]
    mixed = [(1000 + i, " ".join(text(rng, g, 12) for g in syllables), None) for i in range(5)]
    df = full_documents(spark, [(i, t) for i, t, _ in rows + mixed], {i: g for i, _, g in rows + mixed})
    assert all(r.score < L.MIN_SCORE for r in L.identify(df).where("doc_id >= 1000").collect())
    assert {r.doc_id for r in L.keep_identified(df).collect()} == {i for i, _, _ in rows + mixed}


def test_without_any_lang_documents_pass_through(spark):
    df = full_documents(spark, [(0, "some text"), (1, None), (2, "12 ??"), (3, "héé")], {i: None for i in range(4)})
    assert sorted(r.doc_id for r in L.keep_identified(df).collect()) == [0, 3]


def junk(rng, n=40):
    """Random letters, a foreign alphabet, encoded bytes and markup."""
    word = lambda alphabet: "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 10)))
    latin, greek = "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω"
    out = [" ".join(word(latin) for _ in range(rng.randint(6, 60))) for _ in range(n)]
    out += [" ".join(word(greek) for _ in range(rng.randint(6, 60))) for _ in range(n)]
    out += ["".join(rng.choice(latin + latin.upper() + "0123456789+/") for _ in range(600)) for _ in range(n)]
    return out + [f'<div class="x{i}"><span style="font-size:{i}px">&nbsp;</span><a href="https://w.test/q?id={i}">' * 3 for i in range(n)]


def test_junk_is_rejected_and_clean_texts_stay(spark):
    rng = random.Random(21)
    rows = corpus(rng, 400)
    switched = [(5000 + i, text(rng, list(SYLLABLES)[i % 3], 15) + " " + text(rng, list(SYLLABLES)[(i + 1) % 3], 15), None) for i in range(40)]
    bad = [(6000 + i, t, None) for i, t in enumerate(junk(rng))]
    every = rows + switched + bad
    df = full_documents(spark, [(i, t) for i, t, _ in every], {i: g for i, _, g in every})
    kept = {r.doc_id: r.lang for r in L.keep_identified(df).collect()}
    clean = [i for i, *_ in rows + switched]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)
    assert sum(i in kept for i, *_ in bad) <= 0.1 * len(bad)
    assert all(kept[i] == g for i, _, g in rows if i in kept)  # a known lang stays
    assert all(kept[i] in SYLLABLES for i, *_ in switched if i in kept)  # a missing one is filled in


def test_expected_share_of_known_runs():
    seen, share = L.familiar([["aa", "ab"], ["aa"]])
    found, _ = L.runs(["aa", "ab"])
    assert seen.tolist() == sorted(set(found.tolist())) and share == pytest.approx(1 - 2 / 6)
    model = L.train([("x", ["aa", "ab"]), ("x", ["aa"])])
    assert model.known(["aa", "ab", "aab", "zzz"]).tolist() == pytest.approx([1.0, 1.0, 2 / 3, 0.0])
