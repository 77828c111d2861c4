"""Token alignment, license statements and Merkle manifests against brute force."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemoframe.llm import alignment, licenses, merkle
from mnemoframe.llm.queries import QUERIES
from plain import alignment as plain_alignment, license_finds, license_words, merkle as plain_merkle, sha
from test_llm_operators import frame, odd_texts, rows_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokenizers():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = alignment._byte_decoder()
    names = {i: t for t, i in a.get_vocab().items()}

    def bytes_a(i):
        return bytes(byte[c] for c in names[i])

    def bytes_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    return lambda t: a.encode(t, add_special_tokens=False).ids, lambda t: b.encode(t), bytes_a, bytes_b


def token_texts(seed=5):
    rnd = random.Random(seed)
    parts = ["the", "The", "ation", "ing", "x", "é", "中文", "🙂", " ", "  ", "\n", " \n ", "\t", " ", "　", "'s", ".", ",", "12", "<|endoftext|>",
             "<s>", "<unk>", "<0x41>", " ", "\x00", "é", "ﬁ", "of the", " and"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.choice([1, 3, 8, 40]))) for _ in range(300)]
    return out + ["a▁b", "▁", "plain words then ▁ here", " ", "  ", "\n", "a ", " a", "a  ", "aaaaaaaaa" * 400, "中" * 3000]


def test_alignment_equals_brute_force(spark, monkeypatch):
    texts = odd_texts() + token_texts()
    for size in (alignment.BLOCK_BYTES, 2000):  # one block a task, and many
        monkeypatch.setattr(alignment, "BLOCK_BYTES", size)
        got = alignment.align(frame(spark, texts), A, B)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
        want = plain_alignment(list(enumerate(texts)), *tokenizers())
        assert rows_of(got) == sorted(want, key=repr)
    assert any(w[1] for w in want) and any(not w[1] and texts[w[0]] for w in want)
    assert alignment.align(frame(spark, texts).limit(0), A, B).count() == 0


def test_alignment_of_repeated_and_missing_ids(spark):
    texts = ["one two three", "one two three", None, "", "one"]
    got = alignment.align(frame(spark, texts, ids=[7, 7, None, 7, None]), A, B)
    want = plain_alignment(list(zip([7, 7, None, 7, None], texts)), *tokenizers())
    assert rows_of(got) == sorted(want, key=repr)
    only = alignment.align(frame(spark, [None, "", None]), A, B)
    assert rows_of(only) == [(i, 0, 0, 0, 0, 0, 0, "") for i in range(3)]


def test_group_cuts_are_the_common_ends():
    rnd = random.Random(3)
    for chance in (0.02, 0.3, 0.9):
        for size in (0, 1, 2, 700):
            a = sorted({size, *(x for x in range(1, size) if rnd.random() > chance)} - {0})
            b = sorted({size, *(x for x in range(1, size) if x in a and rnd.random() > chance or rnd.random() < chance / 3)} - {0})
            x, y = (np.array(v, dtype=np.int32) for v in (a, b))
            common, at_a, at_b = np.intersect1d(x, y, return_indices=True)
            cut_a, cut_b = alignment.group_cuts(x, y)
            assert cut_a.tolist() == (at_a + 1).tolist() and cut_b.tolist() == (at_b + 1).tolist()


def license_texts():
    rnd = random.Random(8)
    listed = [w for t in licenses.PHRASES + licenses.STATEMENTS for w in t.words] + ["x", "é", "of", "and", "CC-BY", "Reserved."]
    out = odd_texts()
    for n in range(200):
        body = [rnd.choice(listed) for _ in range(rnd.choice([1, 3, 9, 60]))]
        if n % 3 == 0:
            body[len(body) // 2:len(body) // 2] = rnd.choice(licenses.STATEMENTS).text.split(" ")
        out.append(rnd.choice([" ", ", ", "\n", "/"]).join(body))
    return out + ["cc by", "CC-BY", "ccby", "all rights reserved all rights reserved", "All\x00Rights\x7fReserved", "cc cc by by",
                  "word " * 30_000 + "All rights reserved."]


def test_licenses_equal_brute_force(spark):
    texts = license_texts()
    templates = licenses.PHRASES + licenses.STATEMENTS
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    for n, text in enumerate(texts):
        assert got[n].n_words == len(license_words(text))
        assert {tuple(f) for f in got[n].found} == license_finds(text, templates), n
        assert len(got[n].found) == len({tuple(f) for f in got[n].found})
    assert licenses.scan(frame(spark, texts).limit(0)).count() == 0
    repeated = licenses.scan(frame(spark, ["cc by", "cc by", None], ids=[1, 1, None])).collect()
    assert sorted((r.doc_id or 0, len(r.found)) for r in repeated) == [(0, 0), (1, 1), (1, 1)]


def test_license_templates_are_arguments(spark):
    own = (licenses.Template("own", "alpha beta gamma delta epsilon", share=0.6), licenses.Template("two", "beta gamma", phrase=True))
    texts = ["alpha x beta y gamma", "alpha beta", "beta gamma delta", "gamma beta", None]
    got = {r.doc_id: {tuple(f) for f in r.found} for r in licenses.scan(frame(spark, texts), own).collect()}
    assert got == {n: license_finds(t, own) for n, t in enumerate(texts)}
    with pytest.raises(ValueError):
        licenses.scan(frame(spark, texts), (licenses.Template("none", " ,"),))


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string").repartition(
        3).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("count", [0, 1, 9, 700, 9000])
def test_manifest_equals_brute_force(spark, tmp_path, count):
    rnd = random.Random(count)
    texts = odd_texts()
    rows = [(n if n % 50 else None, rnd.choice(["a", "b", None]), rnd.choice(["en", "de", "é", None, "en", "en"]) if count < 700 else ("en", None)[n % 40 == 0],
             n % 7 or None, texts[n % len(texts)] if n < 80 else f"Text {n} Z", "x", "y") for n in range(count)]
    rows += rows[:count // 10]  # repeated rows
    got = QUERIES["op13_merkle"](spark, documents(spark, str(tmp_path), rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain_merkle([r[:5] for r in rows])
    assert rows_of(got) == sorted(want, key=repr)
    if count >= 70:
        assert {w[-1] for w in want} == {True, False}


def test_proof_leads_to_the_root(spark):
    leaves = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("lang"),
                                     merkle.row_digest(F.col("id")).alias("leaf"))
    proved = merkle.manifest(leaves, "lang", "doc_id")
    assert proved.filter(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert proved.filter(merkle.folded(F.lit(sha("other")), F.col("proof")) == F.col("root")).count() == 0


def test_queries_over_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = [(*w[:-1], sha(w[-1]) if w[-1] else "") for w in plain_alignment(rows, *tokenizers())]
    got = QUERIES["op11_token_alignment"](spark, folder)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == sorted(want, key=repr)
    for row in QUERIES["op12_licenses"](spark, folder).collect():
        finds = license_finds(dict(rows)[row.doc_id], licenses.PHRASES + licenses.STATEMENTS)
        starts = [f[1] for f in finds if f[4]]
        assert (row.n_base, row.first_word, row.last_word) == (len(starts), min(starts, default=None), max(starts, default=None))
        assert row.base_labels == ",".join(sorted({f[0] for f in finds if f[4]}))
        assert row.labels == ",".join(sorted({f[0] for f in finds}))
        assert row.score == max((f[3] for f in finds), default=0.0)
