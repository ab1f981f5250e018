"""Whitening, byte-level encoding and ranked search against plain linear algebra, the library and brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from samples import ODD, WORDS, prose
from tokenizers import Tokenizer

from slotward.llm import byte_bpe, common, ranked_search, whitening

BYTES = public_tokenizers.path("byte_bpe_50k.json")


# --- whitening -------------------------------------------------------------------------------

def brute_whitening(vectors, size=32):
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    z = n * x - s
    values, axes = np.linalg.eigh((z.T @ z).astype(float) / n**3)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(int((values > 1e-12 * max(values[0], 1e-300)).sum()), size)
    return (z.astype(float) / n) @ axes[:, :k] / np.sqrt(values[:k]), (z * z).sum(axis=1), values[:k] / values.sum()


@pytest.mark.parametrize("spectrum", ["even", "steep", "equal", "flat"])
def test_divide_and_conquer_gives_eigenvectors(spectrum):
    rng = np.random.default_rng(3)
    for d in (1, 2, 3, 17):
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        values = {"even": np.arange(1.0, d + 1), "steep": 10.0 ** -np.arange(d), "equal": np.repeat([1.0, 4.0], [d // 2, d - d // 2]), "flat": np.zeros(d)}[spectrum]
        m = (q * values) @ q.T
        m = (m + m.T) / 2
        got, axes = whitening.divided(m)
        assert np.allclose(got, np.sort(values)[::-1], atol=1e-13) and (np.diff(got) <= 0).all()
        assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-13) and np.allclose((axes * got) @ axes.T, m, atol=1e-13)


def test_polar_factor_is_the_sign():
    m = np.diag([3.0, 1e-9, -1e-9, -2.0])
    assert np.allclose(whitening.polar_sign(m), np.diag([1.0, 1, -1, -1]), atol=1e-9)


def test_whitening_equals_plain_linear_algebra(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(60, 6)) * [9, 3, 1, 1, 0.2, 0]).tolist()
    vectors += [vectors[0]] * 40  # repeated rows
    odd = [None, [], [1.0] * 5 + [None], [1.0] * 5 + [float("nan")], [float("inf")] + [1.0] * 5, [1.0] * 7]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(None, vectors[1], "y")] + [(500 + i, v, "z") for i, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string")
    kept = [*vectors, vectors[1]]
    want, deviation, explained = brute_whitening(kept)
    got = whitening.components(table).toPandas()
    assert len(got) == len(kept) * want.shape[1] and want.shape[1] == 5 and got["vec_id"].isna().sum() == 5
    assert got["n"].eq(len(kept)).all() and got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1
    known = got.dropna().sort_values(["vec_id", "component"])
    w = known["whitened"].to_numpy().reshape(len(vectors), -1)
    sign = np.sign((w * want[:-1]).sum(axis=0))
    assert np.allclose(w * sign, want[:-1], atol=1e-9)
    assert known["deviation"].tolist()[::5] == deviation[:-1].tolist()
    assert np.allclose(known["explained"].to_numpy()[:5], explained, rtol=1e-9)
    usable = whitening.remaining(table, "embedding")
    wide = whitening.whitened(usable, whitening.fit(usable, size=2), name="out").filter("vec_id = 7").first()
    assert wide["whitened"] == "x" and np.allclose(np.array(wide["out"]) * sign[:2], want[7, :2], atol=1e-9)


def test_whitening_of_large_entries_and_few_rows(spark):
    kind = "vec_id long, embedding array<double>"
    large = [(1, [2.0**40, 1.0]), (2, [-(2.0**40), 5.0]), (3, [0.0, 2.0]), (4, [3.0, 2.0**55 * 2])]
    got = whitening.components(spark.createDataFrame(large, kind)).toPandas()
    assert set(got["vec_id"]) == {1, 2, 3} and got["n"].eq(3).all() and got["identity_error"].max() < 1e-6
    assert got["component"].tolist() == [1, 1, 1]  # the other direction is below 2^-44 of the first
    assert got["deviation"].isna().sum() == 2  # beyond 64 bits
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        assert whitening.components(spark.createDataFrame(few, kind)).count() == 0


# --- byte-level encoding ---------------------------------------------------------------------

SIGNS = ["'", "'s", "'re", "'S", " ", "  ", "\n", "\t", "a", "Word", "9", "é", "日本", "😀", "!", "?!", "\xa0", "　", "<|endoftext|>", "<|", "٣", "é", "\r\n", "\x00"]


def library(texts):
    tokenizer = Tokenizer.from_file(BYTES)
    ids = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return ids, [tokenizer.decode(i, skip_special_tokens=False) for i in ids]


def test_encoder_equals_the_library():
    rng = random.Random(7)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(300)]
    texts += ["a" * 3000 + "b" * 77, "", "x" * 65, "qqz" * 40]
    encoder, (want, back) = byte_bpe.Encoder(BYTES), library(texts)
    got = [ids.tolist() for ids in encoder.encode([t.encode() for t in texts])]
    assert got == want and [encoder.vocabulary.decode(i) for i in got] == back == texts


def test_certain_cuts_are_never_inside_a_token():
    vocabulary = byte_bpe.Vocabulary(BYTES)
    assert 0.5 < vocabulary.certain.mean() < 1
    added = set(vocabulary.added.values())
    for i, token in enumerate(vocabulary.surface):
        if i not in added:
            assert not any(vocabulary.certain[a * 256 + b] for a, b in zip(token, token[1:]))


def test_long_texts_are_divided_without_effect(monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE", 500)
    monkeypatch.setattr(byte_bpe, "KEPT", 50)
    texts = ["it's word here " * 300 + "<|endoftext|>" + "q" * 2000 + " we're  ok", "", "z", " ".join(prose(4, 900)), "é " * 900]
    got = [ids.tolist() for ids in byte_bpe.Encoder(BYTES).encode([t.encode() for t in texts])]
    assert got == library(texts)[0]


def test_encoding_keeps_rows_and_columns(frame):
    long = "some words " * 300_000  # 3 MB
    rows = [(1, "Hello world, it's 42 é 😀\n\n ok<|endoftext|>!"), (2, "x" * 5000), (3, long), *ODD]
    docs = frame(rows, odd=False).withColumnRenamed("lang", "ids")
    ids, texts = library([t or "" for _, t in rows])
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = collections.Counter((i, len(x), digest(",".join(map(str, x))), digest(t)) for (i, _), x, t in zip(rows, ids, texts))
    assert collections.Counter(tuple(r) for r in byte_bpe.digests(docs, BYTES).collect()) == want
    encoded = byte_bpe.encoded(docs, BYTES)
    assert encoded.columns == docs.columns  # the column of that name is replaced
    back = byte_bpe.decoded(encoded.drop("text"), BYTES)
    assert collections.Counter((r["doc_id"], r["text"], r["source"]) for r in back.collect()) == collections.Counter((i, t or "", "s") for i, t in rows)
    assert byte_bpe.digests(frame([], odd=False), BYTES).count() == 0


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


# --- ranked search ---------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def brute_ranking(docs, items, k=50):
    terms = lambda text: [w.translate(LOWER) for w in TERM.findall(text or "")]
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    documents, length = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scores = set(terms(text)), []
        for doc, c, n in held:
            m = 100 - 50 + (50 * n * documents) // length
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return collections.Counter(out)


@pytest.mark.parametrize(("bytes_", "batch", "k"), [(16_000_000, 64, 50), (3000, 1, 4), (1, 3, 7)])
def test_search_equals_brute_force(spark, frame, monkeypatch, bytes_, batch, k):
    # Worker processes are forked with the patched values for blocks; batches are passed through the module as well.
    rng = random.Random(9)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", bytes_)
    monkeypatch.setattr(ranked_search, "BATCH", batch)
    rows = [(1000 - i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 5, 30, 200])))) for i in range(90)]
    rows += [(2000 + i, "River STONE river stone") for i in range(9)] + [(3, "ÄÖ äö Äö river_stone 7"), (3, "river"), (4, "word " * 200_000)]
    items = [(1, "River, stone! garden"), (2, None), (3, "nothing known"), (4, " ".join(WORDS)), (4, "river"), (None, "Äö x y z"), (6, "word word stone"), (7, "")]
    docs = frame(rows).repartition(3)
    queries = spark.createDataFrame(items, "item_id long, text string")
    got = ranked_search.search(ranked_search.index(docs), queries, k)
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_ranking([*rows, *ODD], items, k)


def test_search_in_turns_and_of_empty_tables(spark, frame, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERY_BYTES", 12)
    items = spark.createDataFrame([(i, w) for i, w in enumerate(WORDS)], "item_id long, text string")
    rows = [(i, " ".join(prose(i, 5)) + " " + WORDS[i % 16]) for i in range(40)]
    postings = ranked_search.index(frame(rows, odd=False))
    assert collections.Counter(tuple(r) for r in ranked_search.search(postings, items).collect()) == brute_ranking(rows, list(enumerate(WORDS)))
    assert ranked_search.search(postings, items.limit(0)).count() == 0
    assert ranked_search.search(ranked_search.index(frame([], odd=False)), items).count() == 0


def test_search_leaves_most_intervals_closed():
    rng = np.random.default_rng(2)
    n = 20_000
    impact = np.concatenate([rng.integers(1, 100, n), rng.integers(1, 100, n)])
    impact[[77, n + 77, 500]] = 10_000
    held = {b"a": n, b"b": n}
    queries = ranked_search.Queries([(1, "a b")], held, n, n)
    ranges = ranked_search.Ranges(impact, np.arange(2 * n), n, n)
    seen = []
    best = ranges.best
    ranges.best = lambda a, b: seen.append(len(a)) or best(a, b)
    found = ranked_search.best_first(ranges, np.array([0, n, 2 * n]), queries, 2)
    assert found.doc.tolist() == [77, 500] and sum(seen) < 500


def test_whole_table_of_the_smallest_scale(spark, sf):
    docs, items = (common.table(spark, sf, name) for name in ("documents", "benchmark"))
    got = ranked_search.search(ranked_search.index(docs), items)
    rows, asked = ([tuple(r) for r in t.collect()] for t in (docs.select("doc_id", "text"), items.select("item_id", "text")))
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_ranking(rows, asked)
