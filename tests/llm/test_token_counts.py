import random

import pytest

from calorway.llm import token_counts as T

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
ALPHABET = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "a", "Bc", "é", "ß", "1", "٣", "!", "?!", "中", "😀", "　", "x" * 30,
            "\x85", "​", " ' ", "<|endoftext|>", "<|endof"]


def lib(texts):
    return [len(e.ids) for e in tokenizers.Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", None, " ", "a" * 300, "\n\n x"]
    want = lib([t or "" for t in texts])
    for chunk, some in ((T.CHUNK, len(texts)), (5, 40)):
        texts, want = texts[-some:], want[-some:]
        df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "route_id long, text string, tokens long")
        got = {r[0]: tuple(r)[1:] for r in T.count_tokens(df, PATH, chunk=chunk).collect()}
        assert [got[i][1] for i in range(len(texts))] == want
        assert all(got[i] == (len((t or "").encode()), want[i], want[i] > 512) for i, t in enumerate(texts))


def test_chunk_maps_compose_at_any_cut():
    rng = random.Random(2)
    table, counter = T.compiled(PATH)
    for _ in range(40):
        text = "".join(rng.choice(ALPHABET[:-2]) for _ in range(12))
        for size in (1, 2, 5):
            cuts = [(text[i:i + size], T.chunk_map(text[i:i + size], text[i + size:i + size + 2], table, counter)) for i in range(0, len(text), size)]
            assert T.compose_chunks(cuts, counter) == lib([text])[0]


def test_empty_table(spark):
    assert T.count_tokens(spark.createDataFrame([], "route_id long, text string"), PATH).count() == 0
