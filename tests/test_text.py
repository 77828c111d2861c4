import base64
import hashlib
import hmac
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoframe.functions import hashing, text as tx, vectors
from mnemoframe.operators import extraction as ex


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def facts_of(spark, text):
    rows = spark.createDataFrame([(1, text)], "id long, content string")
    return [(r.content, r.importance) for r in
            ex.extract(rows).orderBy("position").collect()]


@pytest.mark.parametrize("line,content,importance", [
    ("I am a software engineer.", "User is a software engineer", 0.85),
    ("I'm a data scientist.", "User is a data scientist", 0.85),
    ("My name is Alice.", "User's name is Alice", 0.9),
    ("I work at Google.", "User works at Google", 0.8),
    ("user: I work for Microsoft.", "User works at Microsoft", 0.8),
    ("I live in New York.", "User lives in New York", 0.7),
    ("I'm from Paris.", "User is from Paris", 0.7),
    ("I like pizza.", "User likes pizza", 0.6),
    ("I enjoy hiking.", "User likes hiking", 0.6),
    ("I hate mornings.", "User dislikes mornings", 0.6),
    ("I'm allergic to peanuts.", "User is allergic to peanuts", 0.95),
    ("I think that it rains.", "User thinks it rains", 0.3)])
def test_statement_rules(spark, line, content, importance):
    assert facts_of(spark, line) == [(content, importance)]


def test_accented_letter_before_i_is_a_word_edge(spark):
    assert facts_of(spark, "éi like tea") == [("User likes tea", 0.6)]


def test_contacts_come_first_and_repeats_drop_out(spark):
    got = facts_of(spark, "I like tea.\nuser: I like tea.\nmail a@b.co or a@b.co, $5 on 1/2/2024")
    assert got == [("User's email is a@b.co", 0.8), ("Mentioned date: 1/2/2024", 0.8),
                   ("Mentioned monetary amount: $5", 0.8), ("User likes tea", 0.6)]


def test_whole_long_text_is_read(spark):
    filler = "word. " * 20000
    assert facts_of(spark, filler + "\nI live in Oslo.") == [("User lives in Oslo", 0.7)]


def test_segments_match_greedy_packing(spark):
    text = " ".join(f"Sentence number {i} has {'x' * (i * 37 % 300)}." for i in range(60))

    def pack(size):
        done, current = [], ""
        for sentence in re.split(r"(?<=[.!?])\s+", text):
            if current and len(current) + len(sentence) > size:
                done.append(current.strip())
                current = sentence
            else:
                current = f"{current} {sentence}" if current else sentence
        return done + ([current.strip()] if current.strip() else [])

    assert one(spark, tx.segments(F.lit(text), 800)) == pack(800)


def test_every_segment_has_a_window(spark):
    rows = spark.createDataFrame([(1, "short"), (2, "A sentence here. " * 600), (3, "")],
                                 "id long, content string")
    got = {}
    for r in ex.windows(rows).collect():
        got.setdefault(r.id, []).append(r)
    assert [(r.segment, r.context_window) for r in got[1]] == [("short", "short")]
    assert [(r.segment, r.total) for r in got[3]] == [("", 1)]
    assert sorted(r["index"] for r in got[2]) == list(range(got[2][0].total)) and got[2][0].total > 10
    assert sum(r.segment.count("sentence") for r in got[2]) == 600
    first = min(got[2], key=lambda r: r["index"])
    assert "Earlier" not in first.context_window and "Later" in first.context_window



@pytest.mark.parametrize("raw,want", [
    ("- The  Big Plan's", "big plan"), ("**Acme!)", "acme"), ("When the cat", "cat"),
    ("!!!", ""), ("their New   Car", "new car")])
def test_entity_name(spark, raw, want):
    assert one(spark, tx.normalized_entity_name(F.lit(raw))) == want


def test_entity_name_candidates(spark):
    got = one(spark, tx.entity_name_candidates(F.lit("Is clean.ai my tool?")))
    assert {"user", "clean", "ai", "clean ai", "clean.ai", "my tool", "is clean.ai my tool?",
            "is clean ai my tool?"} <= set(got)
    assert one(spark, tx.entity_name_candidates(F.lit("? !"))) == []


def test_hmac_matches_standard_library(spark):
    for secret in ("s", "k" * 64, "long" * 40):
        got = one(spark, hashing.hmac_sha256(F.lit('{"a":1}'), F.lit(secret)))
        assert got == hmac.new(secret.encode(), b'{"a":1}', hashlib.sha256).hexdigest()


def test_input_hash_is_of_compact_json(spark):
    want = hashlib.sha256('{"type":"raw_text","data":"a\\"b"}'.encode()).hexdigest()
    assert one(spark, hashing.input_hash(F.lit("raw_text"), F.lit('a"b'))) == want


def test_query_variants(spark):
    assert one(spark, tx.query_variants(F.lit("What is my name?"))) == [
        "What is my name?", "what is user's name?", "my name"]


def test_hmac_with_pads_made_once_a_secret(spark):
    secrets = spark.createDataFrame([("s",), ("k" * 64,), ("long" * 40,)], "secret string").select(
        "secret", hashing.hmac_pads(F.col("secret")).alias("pads"))
    got = {r.secret: r.x for r in secrets.crossJoin(spark.range(1)).select(
        "secret", hashing.hmac_sha256(F.lit("é"), pads=F.col("pads")).alias("x")).collect()}
    assert got == {s: hmac.new(s.encode(), "é".encode(), hashlib.sha256).hexdigest() for s in got} and len(got) == 3


def test_int8_vectors_equal_numpy(spark):
    raws = [b"", bytes(5), bytes(range(256)), b"\x80\x7f\xff\n\r", bytes(i * 7 % 256 for i in range(5000))]
    rows = spark.createDataFrame([(n, base64.b64encode(r).decode()) for n, r in enumerate(raws)] + [(9, None)], "n int, t string")
    df = rows.select("n", vectors.decode_int8(F.col("t")).alias("v"))
    assert "Python" not in df._jdf.queryExecution().toString()  # no batch of vectors in a Python worker
    got = {r.n: r.v for r in df.collect()}
    assert got.pop(9) is None
    for n, raw in enumerate(raws):
        v = np.frombuffer(raw, dtype=np.int8).astype(np.float64) if raw else np.zeros(0)
        length = np.sqrt((v * v).sum())
        assert got[n] == (v / length if length else v).astype(np.float32).tolist()
