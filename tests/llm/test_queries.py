"""Registered queries of the numbered operators on the smallest tables."""

import re

import pytest

from checks.compare import connect, rows_of
from sigtrace.llm.oracle import ORACLE
from sigtrace.llm.queries import QUERIES

#: Columns that the contract of an operator names, in its order.
CONTRACT = {
    1: "query_id rank vec_id score",
    2: "doc_id size text_crc32 law shard slot grown_shard",
    3: "doc_id fingerprint component_id",
    4: "doc_id n_assign n_access n_hex base_sha256 spans",
    5: "page_id host path rule verdict",
    6: "doc_id n_words n_hit n_items items_sha256 contaminated",
    7: "doc_id n_tokens ids_sha256 decoded_sha256",
    9: "doc_id held_out lang_pred score",
    11: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    12: "anchor_id positive_id rank negative_id positive_score negative_score",
    13: "vec_id component n deviation whitened explained identity_error",
}
EXPECTED = {1: "embeddings", 5: "pages", 8: "pages", 13: "embeddings"}
#: Rows of a result for each row of its table.
TIMES = {13: 16}


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_and_columns(spark, sf_dir, name):
    number = int(re.match(r"op(\d+)_", name)[1])
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert set(CONTRACT.get(number, "").split()) <= set(got.columns)
    if name in ORACLE:
        want = connect(sf_dir).execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)
    elif number != 8:
        table = spark.read.parquet(f"{sf_dir}/{EXPECTED.get(number, 'documents')}.parquet")
        assert len(got) == table.count() * TIMES.get(number, 1)
