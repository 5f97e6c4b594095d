import hashlib
import random
import re
import time

import duckdb
import pytest

from sigtrace.llm import decontaminate as D
from sigtrace.llm.oracle import ORACLE
from sigtrace.llm.queries import QUERIES

from .helpers import documents, full_documents, lower, odd_columns

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(items, text, window=13):
    words, hit, found = WORD.findall(lower(text)), set(), set()
    for item, item_text in items:
        own = WORD.findall(lower(item_text))
        if not own:
            continue
        n = min(window, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found |= {item} - {None}
    return words, hit, found


def test_automaton_equals_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        letters = rng.choice([["a", "b"], ["a", "b", "c", "d"], list("abcdefg")])
        window = rng.choice([3, 4, 5])
        items = [(i, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))) for i in [*range(rng.randint(0, 5)), None]]
        texts = [" ".join(rng.choice(letters + ["z"]) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        automaton = D.ItemAutomaton([(i, D.words(t)) for i, t in items], window)
        for text, (spans, found) in zip(texts, automaton.texts([D.words(t) for t in texts])):
            _, hit, expected = brute(items, text, window)
            assert {i for a, b in spans for i in range(a, b)} == hit and found == expected and spans == D.merged(spans)


PASSAGE = " ".join(f"Word{i}" for i in range(30))
ITEMS = [(2, PASSAGE), (10, "only four words here"), (3, None), (4, "..."), (5, PASSAGE + " and more"), (None, "null id item"), (2, "second text of two")]
TEXTS = [
    (0, PASSAGE), (1, "x " * 2000 + PASSAGE), (2, "x " * 300 + PASSAGE.upper().replace(" ", "-!\n")), (3, " ".join(PASSAGE.split()[:12])),
    (4, "ONLY four; words here"), (5, None), (6, ""), (7, "null id item"), (8, "é" + PASSAGE), (9, "second text of two " * 3), (9, "second text of two " * 3), (None, PASSAGE),
]


@pytest.mark.parametrize("block_words", [500_000, 5])
def test_report(spark, block_words):
    items = odd_columns(spark.createDataFrame(ITEMS, "item_id long, text string"))
    got = D.report(odd_columns(documents(spark, TEXTS)), items, block_words=block_words).collect()
    assert len(got) == len(TEXTS)
    expected = []
    for doc, text in TEXTS:
        words, hit, found = brute(ITEMS, text)
        ids = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        expected.append((doc, len(words), len(hit), len(found), ids, bool(hit) and 20 * len(hit) >= len(words)))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(expected, key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.report(documents(spark, []), none).count() == 0
    assert [tuple(r)[1:4] for r in D.report(documents(spark, [(1, "a b")]), none).collect()] == [(2, 0, 0)]


def test_contaminated_documents_go_and_others_stay_unchanged(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = full_documents(spark, TEXTS)
    kept = D.drop_contaminated(df, items)
    assert kept.columns == df.columns
    assert sorted(kept.collect(), key=str) == sorted([r for r in df.collect() if r.doc_id in (1, 3, 5, 6)], key=str)


def test_spans_are_cut_out(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.without_spans(full_documents(spark, [(0, f"before, {PASSAGE}. after"), (1, None), (2, "clean é")]), items)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(0, "before, . after"), (1, None), (2, "clean é")]


def test_few_automata_are_alive_at_once(spark):
    from sigtrace.llm import decontaminate

    texts = [" ".join(f"b{i}w{j}" for j in range(15)) for i in range(5)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(0, texts[1]), (1, " ".join(texts)), (2, "none of them")], "doc_id long, text string")
    one, many = (sorted(decontaminate.report(docs, items, block_words=n).collect()) for n in (500_000, 10))
    assert one == many and [(r.n_hit, r.n_items) for r in many] == [(15, 1), (75, 5), (0, 0)]
    plan = decontaminate.matches(docs, items, block_words=10)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("MapInArrow") <= decontaminate.ALIVE


def test_query_and_sql_agree_on_items_without_an_id(spark, tmp_path):
    tables = {"documents": documents(spark, [t for t in TEXTS if t[0] is not None]), "benchmark": spark.createDataFrame(ITEMS, "item_id long, text string")}
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(ORACLE["op6_decontamination"])
    names = [d[0] for d in want.description]
    got = sorted(map(tuple, QUERIES["op6_decontamination"](spark, str(tmp_path)).select(*names).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)
    assert {r[0]: r[names.index("n_hit")] for r in got}[7] == 3


def test_one_repeated_word_costs_no_more_than_others():
    """Items and texts of one word: seconds, where a search along all suffixes takes minutes."""
    start = time.monotonic()
    zeros = [b"0"] * 200_000
    automaton = D.ItemAutomaton([(1, zeros), (2, [b"0"] * 5)])
    [(spans, found)] = automaton.texts([zeros])
    assert spans == [(0, 200_000)] and found == {1, 2}
    assert time.monotonic() - start < 60
