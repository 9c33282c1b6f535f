"""Encoding (8) against the library and by round trip; packing (9) by its invariants."""

import os
import random

import pytest

from quillon.llm import bpe, p8_encode, p9_pack

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no vocabulary files here")

ALPHABET = ["a", "b", "th", "ing", " ", "  ", "\n", "'s", "1", "42", "é", "日本", "ไทย", "🙂", "<|endoftext|>", "\u200b", "!?", "\u00a0"]


def _texts(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    lib.encode_special_tokens = True
    enc = bpe.Encoder()
    for t in _texts(800) + ["x" * 5000, "ab" * 3000]:
        assert enc.encode(t) == lib.encode(t, add_special_tokens=False).ids
        assert enc.count(t) == len(enc.encode(t))


def test_round_trip():
    enc = bpe.Encoder()
    back = {v: k for k, v in enc.vocab.ranks.items()}
    for t in _texts(200, 1):
        assert b"".join(back[i] for i in enc.encode(t)).decode() == t


def test_prefixes_grow():
    vocab = bpe.vocabulary()
    whole = "unbelievable".encode()
    grown = bpe.Prefixes(vocab)
    for i in range(len(whole)):
        grown.append(whole[i : i + 1])
        assert grown.ids() == bpe.Prefixes(vocab, whole[: i + 1]).ids()


def test_edits_equal_encoding_anew():
    enc, rng, texts = bpe.Encoder(), random.Random(5), _texts(60, 2)
    for t in texts:
        e = bpe.EditableText(enc, t)
        for _ in range(6):
            a = rng.randint(0, len(e.text))
            b = rng.randint(a, len(e.text))
            e.replace(a, b, rng.choice(texts)[: rng.randint(0, 6)])
            assert e.ids() == enc.encode(e.text)
        e.append(" more")
        assert e.ids() == enc.encode(e.text)


def test_empty_and_null_have_no_ids(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "Hello world", 9), (3, "Hello world", 9), (None, " ", 9)], "doc_id long, text string, ids int")
    got = sorted(((r["doc_id"] or 0, list(r["ids"])) for r in p8_encode.encode(df, "doc_id", "text").collect()))
    assert got == [(0, [220]), (1, []), (2, []), (3, [15496, 995]), (3, [15496, 995])]
    assert p8_encode.encode(df.limit(0), "doc_id", "text").count() == 0


def test_best_fit_is_tight_and_bounded():
    rng = random.Random(1)
    fit, load, seen = p9_pack.BestFit(100, 8), {}, {}
    for _ in range(5000):
        size = rng.randint(1, 100)
        at, place, offset = fit.put(size)
        assert offset == load.get(at, 0) and place == seen.get(at, 0) and len(fit.filled) <= 8
        load[at] = load.get(at, 0) + size
        seen[at] = place + 1
        assert load[at] <= 100
    assert sum(load.values()) / (100 * len(load)) > 0.9


def test_full_pieces_close_nothing():
    fit = p9_pack.BestFit(10, 4)
    for size in (3, 4, 5, 8):  # 3 and 4 share a container
        fit.put(size)
    open_before = dict(fit.filled)
    assert fit.put(10)[1:] == (0, 0) and fit.filled == open_before


def test_copies_of_a_key_spread_over_chunks(spark):
    df = spark.createDataFrame([("same", 40)] * 4000 + [(None, 60)] * 2000, "k string, n int")
    out = p9_pack.pack(df, "k", "n", 100, 8, 50).toPandas()
    chunks = out["container_id"].astype("int64") // 2**32
    assert chunks.nunique() == 56 and chunks.value_counts().max() < 3 * len(out) / 56
    assert len(out) == 6000 and out.groupby("container_id")["n_tokens"].sum().max() <= 100


def test_packing_keeps_every_token(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 5, 40, 100, 101, 250, rng.randint(1, 99)]), "x") for i in range(900)] + [(7, 30, "x"), (None, 12, "x"), (8, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, place string")
    out = p9_pack.pack(df, "doc_id", "n_tokens", 100, 16, 50).toPandas()
    filled = out.dropna(subset=["container_id"])
    assert filled["n_tokens"].sum() == sum(n or 0 for _, n, _ in rows)
    boxes = filled.groupby("container_id")
    assert boxes["n_tokens"].sum().max() <= 100 and boxes["n_tokens"].sum().mean() > 90
    for _, box in boxes:
        box = box.sort_values("place")
        assert list(box["place"]) == list(range(len(box))) and list(box["offset"]) == list(box["n_tokens"].cumsum() - box["n_tokens"])
    whole = {i: n for i, n, _ in rows if n and n <= 100 and i not in (7, None)}
    assert all((filled["doc_id"] == i).sum() == 1 for i in list(whole)[:100])
    assert out["container_id"].isna().sum() == sum(not n for _, n, _ in rows)
    again = p9_pack.pack(df, "doc_id", "n_tokens", 100, 16, 50).toPandas()
    order = ["doc_id", "piece_no", "container_id", "place"]
    assert again.sort_values(order).reset_index(drop=True).equals(out.sort_values(order).reset_index(drop=True))


def test_packing_nothing(spark):
    assert p9_pack.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), "doc_id", "n_tokens").count() == 0
