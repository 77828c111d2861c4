"""Each operator on rows made to be awkward, against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from mnemoframe.llm import (
    byte_bpe, common, fingerprints, fm_index, jaccard, language, mixing, pii, stages, substrings, token_files, toxicity, vectors)
from plain import jaccard_components, personal, sha, shingles, without_repeats, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row string, key string, grams int"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def frame(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    sources = [f"s{i % 3}" if i % 4 else None for i in range(len(texts))] if sources is None else sources
    return spark.createDataFrame(
        [(i, t, "en" if n % 2 else None, s, None, "x", "x", "x", 1) for n, (i, t, s) in enumerate(zip(ids, texts, sources))],
        SCHEMA).repartition(3)


def odd_texts(seed=0, count=60):
    """Null, empty and blank texts, marks, copies, shared passages and one very long text."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "中文", "🙂", "The", "THE", "a.b,c", "+1 (555) 123-4567", "x@y.org", "10.0.0.1", "4111 1111 1111 1111"]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(35))
    out = [None, "", " \t\n", "a", "a b", " ", "...", "1234 5678", passage, passage]
    for n in range(count):
        body = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 5, 30, 80]))]
        if n % 5 == 0:
            body[len(body) // 2:len(body) // 2] = passage.split(" ")
        out.append((" " if n % 3 else "\n").join(body))
        if n % 7 == 0:
            out.append(out[-1] + " more")
            out.append(out[-2])
    out.append(" ".join(rnd.choice(vocabulary) for _ in range(20_000)))
    out.append("same " * 300)
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_personal_data(spark):
    rnd = random.Random(1)
    parts = ["@", ".", "-", "+", "a.b", "x9", "1", "22", "255", "256", "4111 1111 1111 1111", " ", "(", ")", "é", "🙂", "a@b.co", "1.2.3.4", "+1 (555) 123-4567", "\n"]
    texts = odd_texts() + ["".join(rnd.choice(parts) for _ in range(rnd.choice([3, 10, 40]))) for _ in range(300)]
    texts += ["a" * 10_000, "1." * 3000, "a@b" + ".c" * 2000, "9" * 4000, "x" * 40_000]
    found = {r.doc_id: r.spans for r in pii.find(frame(spark, texts)).collect()}
    assert len(found) == len(texts)
    for n, text in enumerate(texts):
        base = [f"{s.kind}:{s.start}:{s.end}" for s in found[n] if s.base]
        assert base == personal(text), n
        for s in found[n]:
            if not s.base:
                assert all(o.end <= s.start or o.start >= s.end for o in found[n] if o.base)
    assert pii.find(frame(spark, texts).limit(0)).count() == 0


def test_personal_data_that_strict_patterns_miss(spark):
    texts = [f"w{i} call +1 ({200 + i}) 555-{1000 + i} or write n{i}@mail.org" for i in range(400)]
    texts.append("call (743) 555-3824 now")
    spans = pii.find(frame(spark, texts)).filter(F.col("doc_id") == 400).first().spans
    assert [(s.kind, s.start, s.end, s.base) for s in spans] == [("phone", 5, 19, False)]


def test_personal_data_that_touches_no_strict_span(spark):
    rnd = random.Random(15)
    texts, want = [], []
    for i in range(900):
        spans = [("email", f"n{i} [at] mail{i % 7} [dot] org"), ("ip", f"2001:db8::{i:x}:1"), ("phone", f"({100 + i}) 555-{1000 + i}"),
                 (None, f"at 1{i % 10}:30:45:{i % 60:02d} or"), ("phone", f"0049 {100 + i} {2000 + i}")][i % 5:][:1]
        kind, value = spans[0]
        before = " ".join(rnd.choice(["some", "words", "é"]) for _ in range(rnd.choice([1, 4]))) + " "
        texts.append(f"{before}{value}. Next")
        want.append([(kind, len(before), len(before) + len(value), False)] if kind else [])
    found = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in pii.find(frame(spark, texts)).collect()}
    assert [found[i] for i in range(900)] == want


def test_redaction(spark):
    df = frame(spark, ["mail x@y.org and é 10.0.0.1", "nothing"]).select("doc_id", "text")
    found = pii.find(df).select(F.col("doc_id").alias("id"), "spans")
    out = df.join(found, F.col("id") == F.col("doc_id")).select("doc_id", pii.redact(F.col("text"), F.col("spans")))
    assert rows_of(out) == [(0, "mail [email] and é [ip]"), (1, "nothing")]


def test_language(spark):
    vocabulary = {"aa": ["the", "and", "of", "tion"], "bb": ["der", "und", "ich", "ein"], "cc": ["que", "los", "ción", "ará"]}
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(vocabulary[k]) for _ in range(rnd.choice([3, 60]))), k) for i, k in enumerate(list(vocabulary) * 60)]
    rows += [(900, None, "aa"), (901, "", None), (902, "12 !?", None), (903, "the " * 40_000, None), (900, None, "aa"), (None, "der und", None)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got.count() == len(rows)
    by_id = {r.doc_id: r for r in got.collect()}
    for i, text, lang in rows[:180]:
        assert by_id[i].lang_pred == lang and 0 <= by_id[i].score <= 1
        assert by_id[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert [by_id[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "aa", "bb"]
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.identify(none).first().lang_pred == "und"
    assert language.identify(none.limit(0)).count() == 0
    assert language.codewords(12).shape[0] == 12 and len({tuple(c) for c in language.codewords(12)}) == 12


def test_languages_that_were_not_learned_are_dropped(spark):
    rnd = random.Random(16)
    vocabulary = {"aa": ["the", "and", "of", "tion"], "bb": ["der", "und", "ich", "ein"], "cc": ["que", "los", "ción", "ará"], "dd": ["och", "att", "jag", "är"]}
    made = lambda words: " ".join(rnd.choice(words) for _ in range(60))
    rows = [(i, made(vocabulary[k]), k, "s", 0) for i, k in enumerate(list(vocabulary) * 60)]
    rows += [(1000 + i, made(["привет", "мир", "хорошо", "сегодня"]), None, "s", 0) for i in range(20)]
    rows += [(2000 + i, "".join(rnd.choice("bcdfghjkqvwxz ") for _ in range(180)), None, "s", 0) for i in range(20)]
    rows += [(3000 + i, made(vocabulary["aa"]), None, "s", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in stages.keep_known_languages(spark, docs, "").collect()}
    assert left >= {i for i, *_ in rows if i < 1000 or i >= 3000}
    assert len(left) <= 262


@pytest.mark.parametrize("many", [2, 2000])
def test_repeated_passages(spark, monkeypatch, many):
    monkeypatch.setattr(substrings, "MANY", many)
    monkeypatch.setattr(substrings, "INDEXED", 500)
    texts = odd_texts(3)
    got = [(r.doc_id, r.n_words, r.n_removed, sha(r.kept)) for r in substrings.remove(frame(spark, texts)).collect()]
    assert sorted(got) == without_repeats(list(enumerate(texts)))


def test_repeated_passages_of_odd_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = substrings.remove(frame(spark, [text, text, text, "short"], [None, 5, 5, 6]))
    assert sorted((r.doc_id or -1, r.n_removed) for r in got.collect()) == [(-1, 0), (5, 30), (5, 30), (6, 0)]
    assert substrings.remove(frame(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("many,parts", [(0, 1), (2000, 1), (2000, 8)])
def test_rows_that_stand_twice_keep_their_words(spark, monkeypatch, many, parts):
    monkeypatch.setattr(substrings, "MANY", many)
    text = [" ".join(f"{c}{i}" for i in range(30)) for c in "xyz"]
    # 5 stands twice without an earlier copy, in 6 part of it stands again before other words
    docs = frame(spark, [text[0] + " " + text[1], text[0] + " " + text[1], text[0] + " " + text[2], text[2]], [5, 5, 6, 7]).repartition(parts)
    got = sorted((r.doc_id, r.n_removed) for r in substrings.remove(docs).collect())
    assert got == [(5, 0), (5, 0), (6, 30), (7, 30)]


def test_index_finds_repeated_patterns():
    rnd = np.random.default_rng(4)
    for top in (1, 2, 9):
        symbols = np.append(rnd.integers(1, top + 1, 400), 0)
        index = fm_index.FmIndex(symbols, 6)
        hit, low = index.repeated(symbols, np.arange(394), 6)
        grams = [tuple(symbols[i:i + 6]) for i in range(394)]
        assert hit.tolist() == [i for i in range(394) if grams.count(grams[i]) > 1]
        groups = {}
        for i, at in zip(hit, low):
            assert groups.setdefault(at, grams[i]) == grams[i]
        assert len(groups) == len({grams[i] for i in hit})


def test_toxicity(spark):
    rnd = random.Random(5)
    plain = [f"v{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        body = [rnd.choice(plain) for _ in range(rnd.choice([10, 100]))]
        if i % 5 == 0:
            for _ in range(4):
                body[rnd.randrange(len(body))] = rnd.choice(["vile", "scum"])
        rows.append((i, " ".join(body)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "vile scum " + "v1 " * 20_000), (1000, None)]
    labels += [(1, None), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rated = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.rate_documents(docs, rated)
    assert got.count() == len(rows)
    by_id = {r.doc_id: r for r in got.collect()}
    held = [i for i in range(600) if by_id[i].held_out]
    assert sum(by_id[i].predicted == int(i % 5 == 0) for i in held) / len(held) > 0.97
    assert by_id[1000].predicted == by_id[1001].predicted == 0 and by_id[1000].score == by_id[1001].score
    p = by_id[1002].passages[0]
    assert rows[-2][1].encode()[p.start:p.end] == b"vile scum"
    none = toxicity.rate_documents(docs, rated.limit(0))
    assert none.filter("score = 0 and predicted = 0").count() == len(rows)
    assert toxicity.rate_documents(docs.limit(0), rated).count() == 0


def test_maximal_segments():
    assert [(a, b, round(s, 9)) for a, b, s in toxicity.segments(np.array([4., -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]))] == [
        (0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]


def test_vectors(spark):
    rnd = np.random.default_rng(6)
    base = rnd.standard_normal((40, 20))
    x = [b + e * rnd.standard_normal(20) for b in base for e in (0.05, 0.1, 0.2, 0.3)]
    x += [x[0], 3 * x[0], x[5], [0.0] * 20, [float("nan")] + [1.0] * 19, None, [None] + [1.0] * 19, [], [1.0, 2.0], [1.0, 2.0]]
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 7) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    got = {r.vec_id: r for r in vectors.link(df).collect()}
    good = {i: np.array(v) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    edges = [(i, j) for i in unit for j in unit if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    from plain import least_reachable
    component = least_reachable(range(len(rows)), edges)
    assert len(edges) > 50
    for i in range(len(rows)):
        assert got[i].n_links == sum(i in e for e in edges), i
        assert (got[i].component_id, got[i].kept) == (component[i], component[i] == i)
    assert vectors.link(df.limit(0)).count() == 0


def test_many_copies_and_chunks_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 16)
    monkeypatch.setattr(vectors, "CELL", 20)
    rnd = np.random.default_rng(7)
    x = rnd.standard_normal(64) + 0.02 * rnd.standard_normal((90, 64))
    x = np.concatenate([x, np.repeat(x[:1], 30, axis=0), rnd.standard_normal((40, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.link(df).collect()}
    assert all(got[i] == ((119, 0) if i < 120 else (0, i)) for i in range(160))


def test_mix(spark):
    texts = odd_texts(8)
    docs = frame(spark, texts, sources=[["b", "a", None, "ç", "tiny"][0 if i % 3 else i % 5] for i in range(len(texts))])
    got = mixing.mix(docs).toPandas()
    sizes = {i: len(words(t)) for i, t in enumerate(texts)}
    assert dict(zip(got.doc_id, got["size"])) == sizes
    assert (got.taken <= 3 * got["size"]).all() and got.target.notna().all()
    per = got.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert (abs(per.taken - per.target) <= 10).all()
    assert (per.target <= 3 * per.source_size).all() and abs(per.target.sum() - per.source_size.sum()) < 1e-3
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert again.sort_values("doc_id").taken.tolist() == got.sort_values("doc_id").taken.tolist()
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(frame(spark, [None, ""])).filter("taken = 0 and target = 0").count() == 2


def test_mix_targets(spark):
    sized = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100), ("d", 1), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    assert got["d"] == 3 and got[None] == 0
    assert abs(got["a"] - 298 * 5 / 8) < 1e-3 and abs(got["b"] - 298 * 2 / 8) < 1e-3 and abs(got["c"] - 298 / 8) < 1e-3


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = odd_texts(9) + ["İstanbul Σσς", "it's, We'LL 'S", "á,b", "\x1c\x85 x"]
    docs = frame(spark, texts)
    token_files.write(token_files.encode(docs, path, 1), str(tmp_path / "out"), keys=docs)
    got = {r.doc_id: (r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.read(spark, str(tmp_path / "out")).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert got[i] == (start, ids), i
        start += len(ids)
    none = docs.limit(0)
    token_files.write(token_files.encode(none, path, 1), str(tmp_path / "none"), keys=none)
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0
    twice = frame(spark, ["a", "a", "b"], [None, 3, 3])
    token_files.write(token_files.encode(twice, path, 1), str(tmp_path / "twice"), keys=twice)
    assert sorted((r.doc_id or -1, r.start) for r in token_files.read(spark, str(tmp_path / "twice")).collect()) == [(-1, 0), (3, 2), (3, 4)]


def test_damaged_records_are_noticed():
    data = bytearray(token_files.framed(b"payload"))
    assert bytes(token_files.unframed(memoryview(bytes(data)), 0)[0]) == b"payload"
    for place in (0, 9, 14, len(data) - 1):
        broken = bytearray(data)
        broken[place] ^= 1
        with pytest.raises(ValueError):
            token_files.unframed(memoryview(bytes(broken)), 0)


def test_fingerprints(spark):
    texts = odd_texts(10)
    got = {r.doc_id: r for r in fingerprints.compare(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    by_text = {}
    for i, text in enumerate(texts):
        text, following = text or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        assert got[i].n_chars == len(text)
        assert got[i].edited == text[:len(text) - half] + following[:half], i
        assert by_text.setdefault(text, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert got[i].near_next == pytest.approx(_likeness(got[i].fingerprint, got[(i + 1) % len(texts)].fingerprint))
        assert bool(got[i].fingerprint) == bool(words(text))
    one = fingerprints.compare(frame(spark, ["a b c d e f g h"])).first()
    assert one.edited == "a b c d a b c d"[:8] + "a b c d" and one.near_next == 1
    assert fingerprints.compare(frame(spark, ["a"]).limit(0)).count() == 0
    tied = fingerprints.compare(frame(spark, ["b", "a", None], [4, 4, None]))
    assert tied.count() == 3


def _likeness(a, b):
    least = sorted(set(a) | set(b))[:fingerprints.SIZE]
    return sum(h in set(a) and h in set(b) for h in least) / len(least) if least else 1.0


def test_anchors_do_not_depend_on_context(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    df = spark.createDataFrame([(passage,), ("x y z " + passage + " and more words",)], "text string")
    a, b = ({x.hash for x in r.out} for r in fingerprints.anchors(df, "text", "out").collect())
    assert a <= b


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard(spark, n, percent):
    texts = odd_texts(11, 120)
    rnd = random.Random(12)
    base = [f"u{i}" for i in range(60)]
    for _ in range(60):  # a chain of near copies
        base = list(base)
        base[rnd.randrange(60)] = f"e{rnd.randrange(10**6)}"
        texts.append(" ".join(base))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(frame(spark, texts), n, percent).collect()}
    assert got == jaccard_components(list(enumerate(texts)), n, percent)
    assert got[0][0] == 0 and shingles(None, 3) == frozenset()


def test_jaccard_of_odd_tables(spark):
    got = jaccard.link(frame(spark, ["a b c d", "a b c d", "x", "a b c d", None], [7, 3, 3, None, None]))
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got.collect()) == [
        (-1, 0, -1), (-1, 2, 3), (3, 1, 3), (3, 2, 3), (7, 2, 3)]
    assert jaccard.link(frame(spark, ["a"]).limit(0)).count() == 0
    assert jaccard.link(frame(spark, [None, ""])).count() == 2


def bpe_texts():
    rnd = random.Random(13)
    parts = [" ", "\n", "\t", "a", "the", "ing", "'s", "é", "ß", "中", "🙂", "0", "12", "!!", "\u3000", "\u00a0", "aaaa", "  ", "\n\n", "tion", "ation", "zq"]
    return odd_texts(14) + ["".join(rnd.choice(parts) for _ in range(rnd.choice([3, 20, 80]))) for _ in range(500)] + [
        "a" * 30_000, "ab" * 9000, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9000))]


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, r"[^\s]{1,3}|\s+", r"(?s:.{1,7})"])
def test_byte_bpe(spark, monkeypatch, pattern):
    ranks = byte_bpe.read_ranks(RANKS)
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = bpe_texts()
    docs = frame(spark, texts)
    monkeypatch.setattr(byte_bpe, "KEPT_PAIRS", 300)  # forget often
    monkeypatch.setattr(byte_bpe, "KEPT_UNITS", 200)
    monkeypatch.setattr(byte_bpe, "_CHUNK_BYTES", 5000)
    encoded = byte_bpe.encode(docs, RANKS, pattern, decoded=True)
    out = {r.doc_id: r for r in encoded.collect()}
    assert len(out) == len(texts)
    for n, text in enumerate(texts):
        assert out[n].ids == reference.encode_ordinary(text or ""), n
        assert bytes(out[n].decoded).decode() == (text or "")
    again = byte_bpe.decode(encoded.select("doc_id", "ids"), RANKS).collect()
    assert all(bytes(r.decoded) == bytes(out[r.doc_id].decoded) for r in again)
    assert byte_bpe.encode(docs.limit(0), RANKS, pattern, decoded=True).count() == 0


def test_byte_bpe_decoding_of_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    token = {i: b for b, i in byte_bpe.read_ranks(RANKS).items()}
    got = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(rows, RANKS).collect()}
    assert got == {1: b"", 2: b"", 3: token[0] + token[1]}
    with pytest.raises(Exception, match="does not have"):
        byte_bpe.decode(spark.createDataFrame([(1, [10 ** 6])], "doc_id long, ids array<int>"), RANKS).collect()


def test_components_of_a_long_chain(spark):
    from mnemoframe.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 499), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[500] == got[499] == 499


def test_word_hashes_do_not_depend_on_the_batch(spark):
    import pyarrow as pa

    a = common.Words(pa.array(["one two", None, "three"])).hashes()
    b = common.Words(pa.array(["x three", "two  one"])).hashes()
    assert a[0] == b[3] and a[1] == b[2] and a[2] == b[1] and len(set(a.tolist())) == 3
