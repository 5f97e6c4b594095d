import fnmatch
import random

from pyspark.sql import functions as F

from sigtrace.functions import glob_literals, glob_to_regex, suffix_key
from sigtrace.functions.globs import is_pieces, pieces_match

FIXED = [
    ("*.example.com", r"(?s)^.*\.example\.com\z"),
    ("mail?.x", r"(?s)^mail.\.x\z"),
    ("[!ab]c", r"(?s)^[^ab]c\z"),
    ("a[b", r"(?s)^a\[b\z"),
]


def python_match(text, glob):
    """fnmatchcase, with the negation mark it also uses ('!')."""
    return fnmatch.fnmatchcase(text, glob)


def random_globs(rng, n):
    parts = ["a", "b", "c", ".", "*", "?", "[ab]", "[!ab]", "[a-c]", "[c-a]", "[", "]", "[]a]", "[!]a]", "-", "^", "\\",
             "[a-]", "[&&b]", "[[a]", "[^a]", "(", "+", "$", "{", "|", "[!c-a]", "é", "[é-ü]"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(n)]


def random_texts(rng, n):
    return ["".join(rng.choice("abc.-^\\[]&(+é\n") for _ in range(rng.randint(0, 6))) for _ in range(n)]


def test_fixed_translations(spark):
    for glob, regex in FIXED:
        assert spark.range(1).select(glob_to_regex(F.lit(glob))).first()[0] == regex


def test_regex_agrees_with_fnmatch(spark):
    rng = random.Random(7)
    globs, texts = random_globs(rng, 400), random_texts(rng, 80)
    g = spark.createDataFrame([(x,) for x in globs], "g string").select("g", glob_to_regex(F.col("g")).alias("re"))
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    got = {(r.g, r.t) for r in g.join(t, F.expr("t rlike re")).collect()}
    want = {(x, y) for x in globs for y in texts if python_match(y, x)}
    assert got == want


def test_literals_and_suffix(spark):
    def literals(g):
        return spark.range(1).select(glob_literals(F.lit(g))).first()[0]

    def suffix(g):
        return spark.range(1).select(suffix_key(F.lit(g))).first()[0]

    assert literals("blog.*.net") == ["blog.", ".net"]
    assert literals("*[0-9]@mail?.x") == ["", "", "@mail", ".x"]
    assert literals("a[b") == ["a[b"]
    assert suffix("*.evil.com") == "evil.com"
    assert suffix("*.evil.*") is None and suffix("*.") is None and suffix("evil") is None


def test_pieces_agree_with_fnmatch(spark):
    rng = random.Random(11)
    word = lambda parts, n: "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    globs = list({word(["a", "b", "ab", "*", "*", ".", "é", "\\", "$", "(", "\U0001f600"], 8) for _ in range(600)})
    texts = list({word("ab.é\\$(\n\U0001f600", 8) for _ in range(150)})
    g, t = (spark.createDataFrame([(x,) for x in v], f"{n} string") for n, v in (("g", globs), ("t", texts)))
    got = {(r.g, r.t) for r in g.join(t, is_pieces(F.col("g")) & pieces_match(F.col("t"), F.col("g"))).collect()}
    want = {(x, y) for x in globs for y in texts if fnmatch.fnmatchcase(y, x)}
    assert (sorted(got - want)[:5], sorted(want - got)[:5]) == ([], []) and len(got) > 500
    assert [r[0] for r in spark.createDataFrame([("a?",), ("[a]",), ("a*",)], "g string").select(is_pieces(F.col("g"))).collect()] == [False, False, True]
