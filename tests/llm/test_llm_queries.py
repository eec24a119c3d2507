"""The registered queries over whole small tables: against SQL where there is some, else against plain code."""

import hashlib
import re
import struct
import zlib

import parity
import public_tokenizers
import pytest
from test_fingerprints import brute as fingerprints
from test_pii import luhn
from test_secret_scan import brute as secrets
from tokenizers import Tokenizer

from stratacube.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    assert parity.compare(spark, parity.duck(SF), SF, queries.QUERIES[name], queries.ORACLE[name]) == ""


def test_op1(spark, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op1_langid"](spark, SF).collect()}
    assert got.keys() == {i for i, *_ in docs}
    langs = {lang for *_, lang in docs}
    for i, text, _ in docs:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.lang_pred in langs if re.search(r"[^\W\d_]", text or "") else r.lang_pred == "und"
    out = [got[i].lang_pred == lang for i, _, lang in docs if got[i].held_out]
    assert sum(out) / len(out) > 0.9


def test_op2(spark, docs):
    got = sorted([tuple(r)[:7] for r in queries.QUERIES["op2_fingerprints"](spark, SF).collect()], key=str)
    assert got == fingerprints([(i, t) for i, t, _ in docs])


def test_op3(spark, docs):
    assert sorted(tuple(r)[:5] for r in queries.QUERIES["op3_secret_scan"](spark, SF).collect()) == secrets([(i, t) for i, t, _ in docs])


def test_op4(spark, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op4_pii"](spark, SF).collect()}
    assert got.keys() == {i for i, *_ in docs}
    private = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+|(?<![0-9A-Za-z])[0-9]{16}(?![0-9A-Za-z])|\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}|(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z])")
    seen = {}
    for i, text, _ in docs:
        old, new = private.findall(text), private.findall(got[i].text)
        old = [x for x in old if not re.fullmatch("[0-9]{16}", x) or luhn(x)]
        if not old:
            assert got[i].text == text or sum(tuple(got[i])[2:]) > 0
        for x in old:
            assert x not in got[i].text, (i, x)
        if len(old) == len(new):
            for x, y in zip(old, new, strict=True):
                assert seen.setdefault(x, y) == y
    assert seen


def test_op7_and_op9(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    counts = {r.doc_id: r for r in queries.QUERIES["op7_token_counts"](spark, SF).collect()}
    codes = {r.doc_id: r for r in queries.QUERIES["op9_bpe"](spark, SF).collect()}
    assert counts.keys() == codes.keys() == {i for i, *_ in docs}
    for i, text, _ in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert tuple(counts[i])[1:] == (len((text or "").encode()), len(ids), len(ids) > 2048)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(codes[i])[1:] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
