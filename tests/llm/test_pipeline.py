import random

import corpus_pipeline
from sigtrace.llm import langid, sentencepieces
from sigtrace.llm.queries import PIECES

from .helpers import odd_columns
from .test_decontaminate import PASSAGE
from .test_langid import corpus


def test_every_stage_takes_effect(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, t, g, "s", len(t)) for i, t, g in corpus(rng, 200)]
    first = rows[0][1]
    extra = [(900, first, "xx", "s", 1), (901, first.upper(), "xx", "s", 1), (902, "123 456", "xx", "s", 1), (903, None, "xx", "s", 0), (904, PASSAGE, "xx", "s", 1)]
    secret = (905, rows[3][1] + " password=abcdef123", rows[3][2], "s", 1)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows + extra + [secret], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    held = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        held.append({r.doc_id: r.text for r in kept.collect()})
    assert not {902, 903} & set(held[0]) and {900, 901} <= set(held[0])
    assert not {900, 901} & set(held[1]) and 0 in held[1]
    assert 904 not in held[2] and set(held[1]) - set(held[2]) <= {904}
    assert "abcdef123" not in held[3].get(905, "") and set(held[3]) == set(held[2])
    final = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    codec = sentencepieces.codec(PIECES)
    assert final == {i: codec.library.encode(t) for i, t in held[3].items()}
    assert len(corpus_pipeline.STAGES) == 5 and langid.MIN_SCORE < 0.5


def test_empty_tables_nulls_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("empty", []), ("odd", [(None, None, None, None, None), (1, "", "xx", "s", 0), (None, "sel mel", "xx", "s", 7), (2, "sel mel", "xx", "s", 7), (2, "sel mel", "xx", "s", 7)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        final = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert [r.doc_id for r in final.collect()] == ([2] if rows else [])
        docs = odd_columns(spark.read.parquet(f"{tmp_path}/{name}/documents.parquet"))
        for stage_name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, docs, f"{tmp_path}/{name}")
            assert stage_name.startswith("Sentence") or kept.columns == docs.columns
            kept.collect()
