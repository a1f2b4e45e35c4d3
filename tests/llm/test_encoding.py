import os
import random

import pytest

from skeinwork.llm import encoding as E

pytestmark = pytest.mark.skipif(not os.path.isdir(E.TOKENIZERS), reason="no tokenizers")
PIECES = ["aaaa", "hello", "<|endoftext|>", "我的", "é", "​", "1234567", "   ", "\n\n", "!!!", "kafenrennu0q17", "😀", " ", "\t", "don't"]


@pytest.fixture(scope="module")
def tokenizer():
    return E.load(E.tokenizer_source())


def plain(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def test_tree_equals_whole(tokenizer):
    rng = random.Random(0)
    for _ in range(400):
        text = "".join(rng.choice(PIECES) * rng.randint(1, 30) for _ in range(rng.randint(1, 25)))
        assert E.encode_text(tokenizer, text, rng.choice([3, 8, 33])) == plain(tokenizer, text)


def test_join_of_any_halves(tokenizer):
    rng = random.Random(1)
    for _ in range(300):
        piece = "".join(rng.choice(["aaaa", "in", "ing", "th", "e", "er", "qu", "zz"]) for _ in range(rng.randint(2, 60)))
        cut = rng.randrange(1, len(piece))
        parts = [E.encode_piece(tokenizer, piece[:cut]), E.encode_piece(tokenizer, piece[cut:])]
        assert E.join(tokenizer, *parts) == E.encode_piece(tokenizer, piece)


def test_table(spark, tokenizer):
    texts = [None, "", " ", "hello world", "<|endoftext|>", "x" * 50_000, "ab " * 9_000 + "\n\n\n" + "z" * 7_000 + "!!", "我" * 30_000, "hello world"]
    rows = [(i, t, "clash", [9]) for i, t in enumerate(texts)] + [(5, texts[5], "c", [1]), (None, "hi", "c", [1]), (None, "y" * 40_000, "c", [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, ids array<int>")
    got = sorted(((r["doc_id"], tuple(r["ids"])) for r in E.encode(df, "doc_id", "text", long_text=1000, half_limit=200).collect()), key=str)
    want = sorted(((i, tuple(plain(tokenizer, t or ""))) for i, t, _, _ in rows), key=str)
    assert got == want
    assert all(tokenizer.decode(ids) == rows[i][1] for i, ids in got if i == 6)


def test_empty_table_and_schema(spark):
    out = E.encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert out.count() == 0 and out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]


def test_other_tokenizers_are_encoded_whole(spark):
    path = os.path.join(E.TOKENIZERS, "word_bpe_49k.json")
    assert not E.is_plain_byte_bpe(E.tokenizer_source(path))
    df = spark.createDataFrame([(1, "Hello " * 5000), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: len(r["ids"]) for r in E.encode(df, "doc_id", "text", path).collect()} == {1: 5000, 2: 0}
