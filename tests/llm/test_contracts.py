"""Each query of the package with its own parameters: columns, one row a document, and laws that hold of the result."""

from __future__ import annotations

import os

import pytest

from readlake.llm import queries
from readlake.llm.common import documents

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")

COLUMNS = {
    "op1_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op2_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op3_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_substring_dedup": "doc_id bigint, start bigint, stop bigint, words bigint, kept_in bigint",
    "op5_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op9_quality": "doc_id bigint, expected_grade double, tail_probability double, kept boolean",
    "op10_preferences": "pair_id bigint, prompt string, prompt_turns int, chosen string, rejected string, usable boolean",
    "op11_permutation_index": "query_id bigint, rank int, vec_id bigint, score double",
    "op12_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
}


@pytest.mark.parametrize("name", queries.queries())
def test_contract(spark, name):
    df = queries.queries()[name](spark, DATA).cache()
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in (x.split()[0] for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
    n = documents(spark, DATA).count()
    if name in ("op2_exact_dedup", "op3_sharding", "op5_simhash", "op6_toxicity", "op8_byte_bpe", "op9_quality"):
        assert df.count() == df.select("doc_id").distinct().count() == n
    if name == "op1_packing":
        assert df.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).filter("`sum(length)` <> `max(doc_tokens)`").isEmpty() and df.select("doc_id").distinct().count() == n
    if name == "op6_toxicity":
        assert df.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").isEmpty()
    if name == "op4_substring_dedup":
        text = documents(spark, DATA).withColumnRenamed("doc_id", "id")
        assert df.join(text, df.doc_id == text.id).filter("start >= stop or start < 0 or stop > char_length(text) or kept_in > doc_id").isEmpty()
    if name in queries.oracle_sql():
        import duckdb

        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
        got = con.execute(queries.oracle_sql()[name])
        at = [[d[0] for d in got.description].index(c) for c in sorted(df.columns)]
        assert sorted(repr(tuple(r[i] for i in at)) for r in got.fetchall()) == sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
    df.unpersist()
