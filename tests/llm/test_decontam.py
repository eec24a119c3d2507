import hashlib
import random
import re

import pytest

from stratacube.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench, window):
    items = [(str(i), split(t)) for i, t in bench if i is not None]
    out = []
    for doc, text in docs:
        w = split(text)
        hit, names = set(), set()
        for item, iw in items:
            n = min(window, len(iw))
            for a in range(len(iw) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == iw[a : a + n]:
                        hit |= set(range(b, b + n))
                        names.add(item)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def made(seed):
    r = random.Random(seed)
    vocab = ["a", "b", "The", "the", "c9", "é", "日本", "z", "q", "rare", "Rarer"]
    text = lambda n: " ".join(r.choices(vocab, [9, 9, 5, 5, 3, 2, 2, 2, 1, 1, 1], k=n))
    bench = [(i, text(r.choice([1, 2, 3, 5, 12, 30]))) for i in range(12)] + [(None, "a b"), (20, None), (21, ""), (22, "?!"), (3, text(4)), (100, "a a a a a a a a a a a a a")]
    docs = [(i, text(r.choice([0, 1, 4, 40, 200]))) for i in range(40)]
    for i in range(12):
        t = bench[i][1]
        docs.append((100 + i, f"{text(5)}, {t.upper()}; {text(3)} {t}"))
    return [*docs, (7, None), (8, ""), (8, docs[3][1]), (9, "a " * 50)], bench


@pytest.mark.parametrize("chunk", [decontam.CHUNK_BYTES, 60])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(decontam, "CHUNK_BYTES", chunk)
    docs, bench = made(1)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, n int")
    got = decontam.digests(decontam.scan(d, b, 4))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = brute(docs, bench, 4)
    assert sorted(map(tuple, got.collect())) == want
    clean = decontam.without_contaminated(d, b, 4)
    assert clean.columns == d.columns and clean.count() == sum(not x[-1] for x in want)


def test_window_of_ten(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    docs = [(1, f"x {passage} y"), (2, passage.replace("w5", "no")), (3, "W0 " + passage[3:])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, passage)], "item_id long, text string")
    assert sorted((r.doc_id, r.n_hit) for r in decontam.digests(decontam.scan(d, b)).collect()) == [(1, 14), (2, 0), (3, 14)]


def test_empty(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontam.scan(d, b).count() == 0
    assert tuple(decontam.digests(decontam.scan(one, b)).first()) == (1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)
    assert decontam.without_contaminated(one, b).count() == 1
