import hashlib
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratacube.llm.bpe import WordBpe, encode_digests, encode_texts
from stratacube.llm.token_counts import count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "", None, " ", "Hello world, it's 12 o'clock!", "ΑΣ ΟΔΟΣ Σ", "İstanbul ﬁ ǅ", "école café", "a<|endoftext|>b <|startoftext|> <|endoftext|", "<|endoftext|><|endoftext|>",
    "tab\tnew\nline\x0b\x1c\x85 x", "漢字かな 한국어 ᄒ", "😀👍🏽 z‍y", "Ᲊ՘Ɤ old", "x" * 3000, "é" * 500, "aaaa'sb're don'T", "\x00\x7f\xad", "123 ４５ ² Ⅷ", "नमस्ते ไทย עברית العربية",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encode_and_decode_equal_the_library(library):
    bpe = WordBpe(PATH)
    for text in HARD:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert bpe.encode(text or "") == want, text
        assert bpe.decode(want) == library.decode(want, skip_special_tokens=False), text


def test_tables(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(HARD)] + [(0, HARD[3], "dup"), (0, HARD[3], "dup")], "doc_id long, text string, n_tokens string").repartition(3)
    want = sorted((i, *_digests(library, t)) for i, t in [*enumerate(HARD), (0, HARD[3]), (0, HARD[3])])
    assert sorted(map(tuple, encode_digests(docs, PATH).collect())) == want
    counts = count_tokens(docs, PATH, limit=5)
    assert counts.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r.doc_id, r.n_tokens) for r in counts.collect()) == [x[:2] for x in want]
    for r in counts.filter("doc_id = 4").collect():
        assert r.n_bytes == len(HARD[4].encode()) and r.over_limit == (r.n_tokens > 5)
    got = {r.doc_id: (r.ids, r.decoded) for r in encode_texts(docs.filter("n_tokens = 'x'"), PATH).collect()}
    assert all(ids == library.encode(HARD[i] or "", add_special_tokens=False).ids for i, (ids, _) in got.items())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert encode_digests(docs, PATH).count() == 0 and count_tokens(docs, PATH).count() == 0


def _digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_frequent_pre_tokens_are_counted_over_all(spark, monkeypatch):
    """Whole texts of all documents, tasks that run out of counters, a bound that takes or leaves what is equally frequent."""
    from stratacube.llm import token_counts

    texts = [" ".join(["often"] * 8 + ["some"] * 4 + [f"w{chr(97 + i)}q{chr(97 + k)}" for k in range(26)]) for i in range(20)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert token_counts.frequent(docs, PATH, 2) == ["often", "some"] and token_counts.frequent(docs, PATH, 1) == ["often"]
    assert token_counts.frequent(docs.filter("false"), PATH, 5) == []
    assert len(token_counts.frequent(docs, PATH, 10**6)) > 50
