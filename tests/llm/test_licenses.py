import hashlib
import os
import random
import re
import textwrap

import pytest

from sigtrace.llm import licenses as L

from .helpers import documents, odd_columns

SPELLINGS = {
    "licence": "license", "sub license": "sublicense", "non commercial": "noncommercial", "copyright owner": "copyright holder",
    "organisation": "organization", "favour": "favor", "judgement": "judgment", "per cent": "percent", "https ": "http ",
}
OTHER = "holder owner notice license licence law statement interest protection act and or".split()


def owner(line):
    """Whether a line names an owner or reserves rights."""
    plain = line.strip(" \t*/#;-.!")
    if plain.lower().rstrip(".") == "all rights reserved" or plain.startswith("©"):
        return True
    if re.match(r"\([cC]\)\s.*\d{4}", plain):
        return True
    head, _, rest = plain.partition(" ")
    rest = rest.lstrip()
    if head.lower().rstrip(":") != "copyright":
        return False
    if any(rest.lower().startswith(w) for w in OTHER):
        return False
    if re.match(r"\([cC]\)|©|\d{4}|<?(yyyy|year)", rest):
        return True
    return head.rstrip(":") in ("Copyright", "COPYRIGHT") and bool(re.match(r"by |[A-Z<\[{]", rest))


def canonical(text):
    """Canonical lines of a text, in Python."""
    out = []
    for line in text.split("\n"):
        t = line.lower().replace("©", " copyright ").replace("(c)", " copyright ")
        t = re.sub(" +", " ", "".join(c if c.isalnum() else " " for c in t))
        for a, b in SPELLINGS.items():
            t = t.replace(a, b)
        out.append("" if owner(line) else t.strip(" "))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def known_digests():
    out = {}
    for name, text in L.KNOWN:
        out.setdefault(sha(" ".join(x for x in canonical(text) if x)), set()).add(name)
    for name, _, _, digest in L.DIGESTS:
        out.setdefault(digest, set()).add(name)
    return out


def brute(rows):
    known, out = known_digests(), []
    for doc, text in rows:
        lines = [(i, x) for i, x in enumerate(canonical(text), 1) if x] if text is not None else []
        units = [(0, text.count("\n") + 1, lines)] if lines else []
        units += [(lines[i][0], lines[j][0] - lines[i][0] + 1, lines[i : j + 1]) for i in range(len(lines)) for j in range(i, min(len(lines), i + 60))]
        for at, n, unit in units:
            digest = sha(" ".join(x for _, x in unit))
            out += [(doc, at, n, name, digest) for name in known.get(digest, ())]
    return sorted(out, key=str)


MIT = next(t for i, t in L.KNOWN if t.startswith("MIT License"))
TEXTS = [
    "Released under the MIT License.",
    "RELEASED   under\tthe 'MIT' licence!",
    "Intro\n\n  Licensed under CC BY-NC 4.0.\nCopyright (c) 2020 Someone\nlicensed under the apache licence, version 2.0",
    "Copyright © 2019, 2020 A. Person\nAll rights reserved.\n\nReleased under\nthe MIT License.",
    "Copyright (c) 2021 B\n" + MIT.replace(". ", ".\n"),
    "See also: Released under the MIT License.",
    "Copyright 2020 nobody",
    "",
    None,
    "x" * 200_000 + "\nReleased under the MIT License.",
    "# code\n# Copyright (c) Microsoft Corporation.\n# " + "\n# ".join(textwrap.wrap(MIT, 70)) + "\n\nimport os",
    "Released under the MIT License.\n" * 50,
    "copyright notice and\nCopyright license.\nCOPYRIGHT HOLDERS BE\n(c) You must\n(c) 2020 X",
    "\n".join(textwrap.wrap(MIT, 40)[:-1]),
]


def test_equals_brute_force(spark):
    rows = list(enumerate(TEXTS))
    got = [tuple(r) for r in L.scan(odd_columns(documents(spark, rows))).collect()]
    expected = brute(rows)
    assert sorted(got, key=str) == expected
    # the MIT text is known with and without its title, so two runs of lines in texts 4 and 10 are if the title is a line
    assert {(d, at) for d, at, *_ in got if d < 4} == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 3), (2, 5), (3, 0), (3, 4)}
    assert (4, 0) in {(d, at) for d, at, *_ in got} and (10, 3) in {(d, at) for d, at, *_ in got}
    assert not {d for d, *_ in got} & {5, 6, 7, 8, 12, 13} and sum(d == 11 for d, *_ in got) == 50
    assert L.scan(documents(spark, rows * 2)).count() == 2 * len(expected)
    assert L.scan(documents(spark, [])).count() == 0


COMMON = "/usr/share/common-licenses"
FULL = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
OWNERS = ["Copyright (c) Microsoft Corporation.", "Copyright (c) Facebook, Inc. and its affiliates", "© Jane Doe 2020", "Copyright 2019-2021 The Authors\nAll rights reserved."]


def texts_of_licences():
    short = {i: t for i, t in L.KNOWN if len(t) > 500}
    full = {}
    for file, name in FULL.items():
        if os.path.isfile(f"{COMMON}/{file}"):
            with open(f"{COMMON}/{file}", encoding="utf-8") as f:
                full[name] = f.read()
    return {**short, **full}


def test_whole_licences_with_owners_and_inside_a_file(spark):
    """Every licence under four kinds of owner lines: as a text of its own, and as a comment before code."""
    rng = random.Random(2)
    rows, expected = [], set()
    for name, text in texts_of_licences().items():
        for line in OWNERS:
            whole, inside = len(rows), len(rows) + 1
            rows.append((whole, f"{line}\n\n{text.upper() if rng.random() < 0.3 and 'opyright' not in text else text}"))
            rows.append((inside, "#!/bin/sh\n" + "\n".join(f" * {x}" for x in f"{line}\n{text}".split("\n")) + "\n\nint main() {}\n"))
            expected |= {(whole, 0, name), (inside, None, name)}
    got = {(r.doc_id, r.line, r.license_id) for r in L.scan(documents(spark, rows)).collect()}
    seen = {(d, at if at == 0 else None, name) for d, at, name in got}
    assert expected <= seen and len(expected) >= 4 * 2 * 6


def test_digests_are_those_of_the_texts(spark):
    if not os.path.isdir(COMMON):
        pytest.skip("no licence texts here")
    known = {d: (name, words) for name, _, words, d in L.DIGESTS}
    for name, text in texts_of_licences().items():
        if name in FULL.values() and not any(i == name and len(t) > 500 for i, t in L.KNOWN):
            words = " ".join(x for x in canonical(text) if x)
            assert known[sha(words)] == (name, len(words.split(" ")))


def test_own_licence_tables_and_native_plan(spark):
    digest = sha("my own terms")
    known = spark.createDataFrame([("own", digest, 1)], "license_id string, digest string, DIGEST int")
    docs = documents(spark, [(1, "My own terms.\nother"), (2, "a b\nMy\nown terms.\nand more of\nit all")])
    out = L.scan(docs, known)
    assert [tuple(r) for r in out.collect()] == [(1, 1, 1, "own", digest)]
    texts = spark.createDataFrame([("own", "My own terms"), ("long", "own terms and more of it"), ("none", "..")], "license_id string, text string")
    found = L.scan(docs, L.known_texts(texts))
    assert sorted((r.doc_id, r.line, r.n_lines, r.license_id) for r in found.collect()) == [(1, 1, 1, "own"), (2, 2, 2, "own")]
    assert L.scan(docs, L.known_texts(texts.limit(0))).count() == 0
    for df in (out, found, L.scan(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
