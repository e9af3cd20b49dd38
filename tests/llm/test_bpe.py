import random

import pytest

from svlattice.llm import bpe, encode

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.vocabulary_path()
pytestmark = pytest.mark.skipif(not __import__("os").path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


def texts():
    rng = random.Random(1)
    letters = " abcdeinrst\n\t\r'sdmtl1239._-é漢字кириллица　😀́<|>\x00\x7f"
    yield from ("".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000))
    yield from ("<|endoftext|> a", " " * 500, "a" * 3000, "ab" * 2000, "I'll we've it's", "\n\n\n  x", "漢" * 900, "=" * 777, "1" * 1000)


def test_ids_equal_the_public_tokenizer(public):
    e = bpe.encoder(PATH)
    for t in texts():
        assert e.encode(t) == public.encode(t, add_special_tokens=False).ids, repr(t[:80])
        assert e.count(t) == len(e.encode(t))


def test_transducer_equals_merging_and_small_tables(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 50)
    monkeypatch.setattr(bpe, "MOST_WORDS", 10)
    e = bpe.Encoder(bpe.encoder(PATH).transducer.ranks)
    rng = random.Random(2)
    for _ in range(400):
        w = bytes(rng.choice(b"abetionsr \xe6\xbc\xa2") for _ in range(rng.randint(0, 25)))
        assert list(e.transducer.encode(w)) == e.transducer._merge(w)
    assert e.encode("some words and some more words and so on") == bpe.encoder(PATH).encode("some words and some more words and so on")


def test_streaming_decode():
    e = bpe.encoder(PATH)
    d = bpe.Decoder(e.transducer.ranks)
    for t in texts():
        assert d.decode(e.encode(t)) == t
    rng = random.Random(3)
    for _ in range(2000):
        data = bytes(rng.choice((0x41, 0xE6, 0xBC, 0xA2, 0xF0, 0x9F, 0x98, 0x80, 0xC3, 0xED, 0xFF)) for _ in range(rng.randint(0, 12)))
        m = bpe.Utf8Machine()
        assert "".join(m.feed(data[i : i + 1]) for i in range(len(data))) + m.close() == data.decode("utf-8", "replace")


def test_tables_with_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", "z"), (1, "a b", None)], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode.token_ids(df, "doc_id", "text", PATH).collect())
    assert got == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert sorted(r.n_tokens for r in encode.token_counts(df, "doc_id", "text", PATH).collect()) == [0, 0, 2, 2]
    assert encode.token_ids(df.limit(0), "doc_id", "text", PATH).count() == 0
