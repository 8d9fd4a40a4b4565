import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapeloom.llm.byte_bpe import VOCABULARIES, decode_ids, encode_texts, load, read_vocabulary

BPE = load(read_vocabulary())
LIBRARY = Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
LIBRARY.encode_special_tokens = True


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60))
def test_against_library(text):
    assert BPE.encode(text) == expected(text)
    assert BPE.decode(BPE.encode(text)) == text.encode()


def test_hard_pieces():
    rng = random.Random(1)
    letters = " \t\n\r\x1c\x85　'sabdlre0123é漢🚀½_-<|endoftext|>"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert BPE.encode(text) == expected(text)
    for text in ("a" * 100_000, " " * 30_000, "ab" * 30_000, "é" * 20_000, "<|endoftext|>"):
        assert BPE.encode(text) == expected(text)


def test_table(spark):
    texts = [None, "", " ", "repeated", "repeated", "long " * 50_000, "<|endoftext|> x"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = encode_texts(df)
    assert encoded.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: expected(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in decode_ids(encoded).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert encode_texts(df.limit(0)).count() == 0
