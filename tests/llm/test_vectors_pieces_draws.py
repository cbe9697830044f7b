"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsmill.llm import queries, resampling, sentencepieces, whitening
from newsmill.llm.wordcache import vocabulary

BIG = 1 << 60


# 11
def vectors(n=40, d=5, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d))).astype(np.float32).tolist()


def plain_whitening(rows, components=16):
    """rows: (id, vector); exact whole numbers and numpy on the distinct ones."""
    x = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = (np.array(fit, object) * n - np.array(s, object)).astype(float) / n
    v = c.T @ c / n
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    out = {}
    for i, y in x.items():
        far = [n * a - b for a, b in zip(y, s, strict=True)]
        out[i] = (sum(a * a for a in far), (np.array(far, float) / n) @ directions / np.sqrt(values))
    return n, out, values / np.trace(v)


def test_whitening_query(spark, tmp_path):
    rows = [(BIG + 2 * k + 1, v) for k, v in enumerate(vectors())]
    rows += [(7, rows[0][1]), (7, rows[0][1]), (8, rows[1][1])]  # copies count once in the fit
    bad = [(90, None), (91, [1.0, None, 1.0, 1.0, 1.0]), (92, [float("nan")] * 5), (93, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (94, [1.0]), (95, [])]
    spark.createDataFrame([*rows, (None, rows[2][1]), *bad], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = queries.QUERIES["op11_whitening"](spark, str(tmp_path))
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    n, want, shares = plain_whitening(dict(rows).items())
    got = df.collect()
    assert len(got) == 5 * (len(rows) + 1) and {r.n for r in got} == {n} and all(r.identity_error < 1e-9 for r in got)
    assert {r.vec_id for r in got} == {i for i, _ in rows} | {None}
    sign = {}
    for r in got:
        deviation, white = want[rows[2][0] if r.vec_id is None else r.vec_id]
        assert r.deviation == deviation and math.isclose(r.explained, shares[r.component - 1], rel_tol=1e-9)
        ratio = round(r.whitened / white[r.component - 1], 6)
        assert abs(ratio) == 1 and sign.setdefault(r.component, ratio) == ratio


def test_whitening_of_few_and_extreme_vectors(spark):
    schema = "vec_id long, embedding array<double>, x string, Whitened int, deviation int"
    one = spark.createDataFrame([(1, [0.5, 2.0], "a", 1, 1), (2, [0.5, 2.0], "b", 1, 1)], schema)
    rows, found = whitening.whiten(one)
    assert found.n == 1 and [(r.vec_id, r.x, r.deviation, r.whitened) for r in rows.orderBy("vec_id").collect()] == [(1, "a", 0, []), (2, "b", 0, [])]
    rows, found = whitening.whiten(one.where("false"))
    assert found.n == 0 and rows.count() == 0 and rows.columns == ["vec_id", "embedding", "x", "deviation", "whitened"]
    far = spark.createDataFrame([(1, [1e300, 0.0], "", 0, 0), (2, [-1e300, 0.0], "", 0, 0), (3, [0.0, 0.0], "", 0, 0)], schema)
    rows, found = whitening.whiten(far)
    assert found.identity_error < 1e-9 and len(found.values) == 1  # one direction alone varies
    assert {r.vec_id: r.deviation for r in rows.collect()} == {1: None, 2: None, 3: 0}  # (3 * 2^42)^2 is no long


def test_whitening_is_exact_at_large_counts():
    w = whitening.Whitening(10**9, np.array([1_000_000, 999_990]), np.array([10**9 - 1, 5]))
    x = np.array([[1_000_064, 999_000], [1_000_000, 999_990]])
    want = [sum((10**9 * a - (m * 10**9 + r)) ** 2 for a, m, r in zip(v, (1_000_000, 999_990), (10**9 - 1, 5), strict=True)) for v in x.tolist()]
    assert want[0] >= 1 << 63 and w.deviations(x) == [None, want[1]]


# 12
@pytest.fixture(scope="module")
def coder():
    return sentencepieces.Pieces(vocabulary(sentencepieces.TOKENIZER), check=False)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(sentencepieces.TOKENIZER))


def test_pieces_equal_the_library(coder, library):
    rng = random.Random(3)
    letters = "aabcdeth  inon\n\t\x00▁éß中文😀🫠</s>123.,'　\xa0\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(5000)]
    texts += ["a" * 3000, " " * 77, "the" * 2000, "<s>", "<0x0A>", "▁▁ ▁ ", "", " ", "x" * 200_000, "the cat " * 20_000, "￿\U0010ffff"]
    want = library.encode(texts)
    assert [np.frombuffer(x, "<i4").tolist() for x in coder.encode(texts)] == want
    assert list(map(coder.decode, want)) == list(map(library.decode, want))


def test_any_ids_decode_as_the_library_does(coder, library):
    rng = random.Random(4)
    ids = [0, 1, 2, 3, 13, 35, 259, 264, 28705, *range(130, 259)]
    for _ in range(5000):
        some = [rng.choice(ids) for _ in range(rng.randrange(9))]
        assert coder.decode(some) == library.decode(some), some


def test_a_difference_from_the_library_is_an_error():
    coder = sentencepieces.Pieces(vocabulary(sentencepieces.TOKENIZER))
    assert coder.encode(["the cat", "\nthe\n cat "])
    del coder.rank["▁international"]
    with pytest.raises(ValueError, match="differ"):
        coder.encode(["international"])


def test_chunks_beyond_the_cache(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "CACHE_CHUNKS", 3)
    coder = sentencepieces.Pieces(vocabulary(sentencepieces.TOKENIZER))
    for texts in (["one two three four", "b " * 9], ["one five", "c" * 100], ["c" * 100, "one"]):
        assert [np.frombuffer(x, "<i4").tolist() for x in coder.encode(texts)] == library.encode(texts)
        assert len(coder.known) <= 3


def test_pieces_query(spark, tmp_path, library):
    texts = [None, "", " \n", "one\ttwo  three", "Ünter 中文 🫠", "long " * 30_000, "one\ttwo  three"]
    rows = [(BIG + 1, texts[3], "x"), (None, texts[4], "y"), *((k, t, None) for k, t in enumerate(texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.QUERIES["op12_sentencepiece"](spark, str(tmp_path))
    assert df.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]

    def want(i, text):
        ids = library.encode(text or "")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))

    assert Counter(map(tuple, df.collect())) == Counter(want(i, t) for i, t, _ in rows)
    whole = sentencepieces.encode(docs.withColumn("text2", F.lit(1)))
    assert whole.columns == ["doc_id", "text", "text2", "ids", "decoded"] and whole.where("doc_id = 3").first().decoded == texts[3]
    assert sentencepieces.encode(docs.where("false")).count() == 0


# 13
def plain_draw(docs, target):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda w: [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    found = [(i, len(words(x)), [bucket(f) for f in runs(words(x))]) for i, x in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(bucket(f) for x in target for f in runs(words(x)))
    big_s, big_t = s.total() + 10000, t.total() + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t)))
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((o for o in out if o[1] >= 20), key=lambda o: (-o[4], o[0] is None, o[0] or 0))
    for rank, o in enumerate(fit[: 5 * len(fit) // 100], 1):
        o[5] = rank
    return Counter((i, *rest) for i, _, *rest in out)


def some_texts():
    rng = random.Random(8)
    vocabulary_ = ["the", "of", "Ünter", "naïve", "CAT", "dog's", "x9", "中文", "a_b", "Éclair"] + [f"w{k}" for k in range(300)]
    return [" ".join(rng.choice(vocabulary_) for _ in range(rng.choice([1, 2, 3, 19, 20, 21, 60, 200]))) + rng.choice(["", "\n", "."]) for _ in range(150)], rng


@pytest.mark.parametrize("part_words", [3, 100, resampling.PART_WORDS])
def test_draw(spark, part_words):
    """Parts of three words cut every text; the whole table is one unit otherwise."""
    texts, rng = some_texts()
    texts = [*texts, None, "", " .,", texts[5] * 20]
    rows = [(BIG + 2 * k + 1, t) for k, t in enumerate(texts)] + [(None, texts[3]), (None, None), (5, texts[7]), (5, texts[7]), (6, texts[7])]
    if part_words == 3:
        rows = rows[:12] + rows[-8:]
    target = [*texts[:4], "the of", None, ""]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, row string, unit int")
    found = resampling.weights(docs.repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), part_words)
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in resampling.drawn(found).collect())
    assert got == plain_draw(rows, target)


def test_draw_of_a_hot_row(spark):
    """A third of all rows are one; ties in score go by doc_id, and a range may begin inside the hot row."""
    texts, _ = some_texts()
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000, texts[8] + " " + "more " * 20)] * 75
    found = resampling.weights(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(texts[0],)], "text string"))
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in resampling.drawn(found, min_words=20).collect()) == plain_draw(rows, texts[:1])


def test_draw_query(spark, tmp_path):
    texts, _ = some_texts()
    spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", texts[0])], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = queries.QUERIES["op13_resampling"](spark, str(tmp_path))
    assert df.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert Counter(map(tuple, df.collect())) == plain_draw(list(enumerate(texts)), texts[:1])


def test_draw_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    none = docs.where("false")
    assert resampling.drawn(resampling.weights(none, none)).count() == 0
    assert [tuple(r) for r in resampling.drawn(resampling.weights(docs, none)).collect()] == list(plain_draw([(1, "one two")], []))


def test_packed_numbers():
    for a in ([], [0], [255, 0], [256], [1 << 40, 3], range(1000)):
        a = np.array(a, np.int64)
        assert resampling.unpacked(resampling.packed(a)).tolist() == a.tolist()


def test_joined_crcs():
    rng = random.Random(2)
    a = [rng.randbytes(rng.randrange(30)) for _ in range(300)]
    b = [rng.randbytes(rng.choice([0, 1, 7, 64, 5000])) for _ in range(300)]
    of = lambda x: np.array(list(map(zlib.crc32, x)), np.uint32)
    assert resampling.joined(of(a), of(b), np.array(list(map(len, b)))).tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]
