"""The registered queries and the pipeline over the smallest tables, against brute force."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from mnemoframe.llm import byte_bpe, stages
from mnemoframe.llm.common import table
from mnemoframe.llm.queries import ORACLES, QUERIES
from plain import jaccard_components, personal, sha, without_repeats, words

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not there")


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


def test_sql_of_the_mix(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = db.execute(ORACLES["op6_source_mix"]).fetchdf()
    got = QUERIES["op6_source_mix"](spark, FOLDER).toPandas()[list(want.columns)]
    assert got.sort_values("doc_id").values.tolist() == want.sort_values("doc_id").values.tolist()


def test_queries_equal_brute_force(spark, texts):
    run = lambda name: QUERIES[name](spark, FOLDER).collect()
    base = {r.doc_id: r.base_sha256 for r in run("op1_pii")}
    assert base == {i: sha(",".join(personal(t))) for i, t in texts}
    assert sorted(tuple(r) for r in run("op3_substrings")) == without_repeats(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run("op9_jaccard")} == jaccard_components(texts)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run("op10_byte_bpe")}
    for i, text in texts:
        ids = reference.encode_ordinary(text)
        assert bpe[i] == (len(ids), sha(",".join(map(str, ids))), sha(text))
    files = {r.doc_id: (r.start, r.n_tokens) for r in run("op7_token_files")}
    at = 0
    for i, _ in texts:
        assert files[i][0] == at
        at += files[i][1]


def test_held_out_accuracy(spark):
    docs = table(spark, FOLDER, "documents").select("doc_id", "lang")
    got = QUERIES["op2_language"](spark, FOLDER).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_vectors_equal_brute_force(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet'").fetchall()
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in QUERIES["op5_vectors"](spark, FOLDER).collect()}
    assert got == {i: n for (i, _), n in zip(rows, links)}


def test_stages(spark, texts):
    docs = table(spark, FOLDER, "documents")
    odd = docs.limit(0).union(spark.createDataFrame(
        [(None, None, None, None, None), (10_000, "", "en", "s", 0), (10_001, "123 !", None, None, 5), (10_002, "mail x@y.org", None, None, 12)],
        docs.schema))
    start = docs.union(docs.filter("doc_id = 3")).union(odd).withColumn("extra", F.lit(1))
    known = stages.keep_known_languages(spark, start, FOLDER)
    assert known.columns == list(stages.COLUMNS)
    assert sorted(r.doc_id for r in known.select("doc_id").collect()) == sorted([i for i, _ in texts] + [3, 10_002])
    once = stages.drop_near_duplicates(spark, known, FOLDER)
    component = jaccard_components([*texts, (10_002, "mail x@y.org")], 5, 80)
    kept = {i for i, (_, c) in component.items() if i == c}
    rows = {r.doc_id: r for r in once.collect()}
    assert once.count() == len(rows) and set(rows) == kept and once.columns == list(stages.COLUMNS)
    clean = {r.doc_id: r for r in stages.redact_personal_data(spark, once, FOLDER).collect()}
    assert set(clean) == kept and clean[10_002].text == "mail [email]" and clean[10_002].n_chars == 12
    for i, text in texts:
        if i in kept and not personal(text):
            assert clean[i].text == text or re.search(r"\[(email|ip|card|phone)\]", clean[i].text)
    mixed = stages.mix_sources(spark, once, FOLDER)
    assert mixed.columns == list(stages.COLUMNS)
    before = sum(len(words(r.text)) for r in rows.values())
    after = sum(len(words(r.text)) for r in mixed.collect())
    assert abs(after - before) < 0.15 * before
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    out = stages.encode_tokens(spark, mixed, FOLDER)
    assert out.count() == mixed.count()
    digests = {hashlib.sha256(r.text.encode()).hexdigest() for r in rows.values()}
    assert {r.decoded_sha256 for r in out.collect()} <= digests


def test_stages_of_an_empty_table(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and got.count() > 100
