import hashlib
import random

import numpy as np
import pytest

from stratacube.llm import fingerprints as fp


def slow_walk(e, text):
    """Step by step: what the walk shows."""
    shown, i, t = [], 0, 0
    goes = e.stays.reshape(fp.CLASSES, fp.PERIOD) == 1
    classes, symbols, *_ = e.characters([text])
    while i < len(text):
        shown.append(symbols[i])
        if goes[classes[i] // fp.PERIOD, t % fp.PERIOD]:
            i += 1
        t += 1
    return shown


@pytest.mark.parametrize("together", [1, 4, 64])
def test_walk_equals_step_by_step(monkeypatch, together):
    monkeypatch.setattr(fp, "TOGETHER", together)
    e = fp.Embedding()
    texts = ["", "a", "héllo wörld", "x" * 400, "日本語 😀 text", "ab" * 3000]
    classes, symbols, first, lens = e.characters(texts)
    reached, end = e.walk(classes, first, lens, np.zeros(len(texts)))
    for k, t in enumerate(texts):
        shown = slow_walk(e, t)
        assert end[k] == len(shown)
        a = first[k]
        level, n, got = e.sample(reached[a : a + lens[k]], symbols[a : a + lens[k]], int(end[k]))
        assert n == len(shown) and got.tolist() == [shown[s] for s in e.levels.steps[level] if s < n]


def brute(rows):
    """By sorting and the operator's own embedding of one text at a time."""
    e = fp.Embedding()

    def one(text):
        classes, symbols, first, lens = e.characters([text])
        reached, end = e.walk(classes, first, lens, np.zeros(1))
        return e.sample(reached, symbols, int(end[0]))

    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        f, g = one(text), one(edited)
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), fp.written(f), fp.written(g), e.likeness(f, g), e.likeness(f, one(after))))
    return sorted(out, key=str)


@pytest.mark.parametrize("batch", [fp.BATCH_ROWS, 3])
def test_equals_one_at_a_time(spark, monkeypatch, batch):
    monkeypatch.setattr(fp, "BATCH_ROWS", batch)
    r = random.Random(4)
    rows = [(r.randrange(10**12) if i % 2 else i, "".join(r.choices("abcdefgh éß日", k=r.choice([0, 1, 2, 50, 900])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "z" * 20_000), (503, "same"), (503, "same"), (503, "other"), (None, "no id"), (-5, "minus")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, bucket string").repartition(5)
    got = fp.fingerprint(docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_few_rows(spark):
    one = spark.createDataFrame([(9, "abcd")], "doc_id long, text string")
    x = fp.fingerprint(one).first()
    assert x.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and x.near_next == 1.0
    assert fp.fingerprint(one.filter("false")).count() == 0


def plain_likeness(e, a, b):
    """From the definition: steps sampled one by one, at the first level that keeps at most SAMPLES of each walk."""
    shown = [slow_walk(e, t) for t in (a, b)]
    if not all(shown):
        return float(len(shown[0]) == len(shown[1]))
    bits = [int(x) for x in fp.mixed(np.arange(max(map(len, shown)), dtype=np.uint64) + np.uint64(0xABCDEF))]
    at = lambda n, level: [s for s in range(n) if bits[s] % 2**level == 0]
    level = max(next(k for k in range(64) if len(at(len(x), k)) <= fp.SAMPLES) for x in shown)
    steps = [at(len(x), level) for x in shown]
    most = max(map(len, steps))
    if not most:
        return float(len(shown[0]) == len(shown[1]))
    same = sum(shown[0][s] == shown[1][s] for s in set(steps[0]) & set(steps[1]))
    return max(0.0, (same / most - 1 / 16) / (15 / 16))


def test_likeness_equals_plain():
    e, r = fp.Embedding(), random.Random(12)

    def one(text):
        classes, symbols, first, lens = e.characters([text])
        reached, end = e.walk(classes, first, lens, np.zeros(1))
        return e.sample(reached, symbols, int(end[0]))

    texts = ["", "a", "ab"] + ["".join(r.choices("etaoin shrdlu", k=n)) for n in (5, 90, 200, 1500)]
    texts += [edited(r, t, 0.03) for t in texts]
    for a in texts:
        for b in texts:
            assert e.likeness(one(a), one(b)) == pytest.approx(plain_likeness(e, a, b)), (a[:20], b[:20])


def test_likeness_follows_edits():
    e, r = fp.Embedding(), random.Random(2)
    base = "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=4000))

    def one(text):
        classes, symbols, first, lens = e.characters([text])
        reached, end = e.walk(classes, first, lens, np.zeros(1))
        return e.sample(reached, symbols, int(end[0]))

    def edited(n):
        t = list(base)
        for _ in range(n):
            k = r.randrange(len(t))
            t[k : k + 1] = r.choice(["", "x", "xy"])
        return "".join(t)

    likes = [np.mean([e.likeness(one(base), one(edited(n))) for _ in range(5)]) for n in (0, 2, 400)]
    assert likes[0] == 1.0 and likes[1] > 0.8 and likes[2] < 0.5
    assert fp.read(fp.written(one(base)))[2].tolist() == one(base)[2].tolist()


def test_edit_distance():
    r = random.Random(3)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for _ in range(200):
        a, b = ("".join(r.choices("abc", k=r.randrange(12))) for _ in range(2))
        assert fp.distance(a, b) == plain(a, b), (a, b)


def test_near_copies(spark):
    r = random.Random(5)
    texts = ["".join(r.choices("abcdefghijklmnop ", k=2500)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t[:1200] + "!" + t[1203:]) for i, t in enumerate(texts)] + [(200, texts[0]), (300, None), (301, "")]
    got = {x.doc_id: x.class_id for x in fp.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: i for i in range(20)}, **{100 + i: i for i in range(20)}, 200: 0, 300: 300, 301: 300}


def edited(r, t, share):
    """t with that share of its characters changed, left out or doubled."""
    t = list(t)
    for k in r.sample(range(len(t)), int(share * len(t))):
        t[k] = r.choice(["#", "", t[k] * 2])
    return "".join(t)


def test_all_pairs_on_request(spark):
    """With one band that all share, whose leader is a copy of none of the others or of one, nothing is missed."""
    r = random.Random(8)
    texts = ["".join(r.choices("abcdefghijklmnop ", k=600)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, edited(r, t, 0.03)) for i, t in enumerate(texts)]
    brute = {i: min(j for j, u in rows if fp.are_copies(t, u, 0.05)) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in fp.near_copies(docs, every=True).collect()} == brute and len(set(brute.values())) == 12
    banded = {x.doc_id: x.class_id for x in fp.near_copies(docs).collect()}
    assert sum(banded[i] == brute[i] for i, _ in rows) >= 0.9 * len(rows)


def recall(share, lengths, each=40):
    """By length: the share of texts that meet an edited copy of theirs in a band; the share of unrelated texts that meet."""
    r, e = random.Random(4), fp.Embedding()
    words = ["".join(r.choices("etaoinshrdlucmfwyp", k=r.randint(2, 9))) for _ in range(3000)]

    def keys(text):
        classes, symbols, first, lens = e.characters([text])
        reached, end = e.walk(classes, first, lens, np.zeros(1))
        return {*e.bands(reached, symbols, int(end[0])).tolist()}

    met, strangers = {}, []
    for n in lengths:
        texts = [" ".join(r.choices(words, k=n))[: n * 4] for _ in range(each)]
        bands = [keys(t) for t in texts]
        met[n * 4] = float(np.mean([bool(b & keys(edited(r, t, share))) for t, b in zip(texts, bands, strict=True)]))
        strangers += [bool(a & b) for i, a in enumerate(bands) for b in bands[:i]]
    return met, float(np.mean(strangers))


def test_recall_of_bands():
    met, strangers = recall(0.045, (60, 300, 1000))
    assert min(met.values()) >= 0.9 and strangers < 0.001, (met, strangers)


def test_bound_never_loses_a_copy():
    r = random.Random(9)
    for _ in range(100):
        a = "".join(r.choices("abcde ", k=r.randrange(2, 400)))
        b = list(a)
        for _ in range(r.randrange(12)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = r.choices("abcz", k=r.randrange(2))
        b = "".join(b)
        na, nb, x, y = np.int64(len(a)), np.int64(len(b)), *(np.frombuffer(fp.profile(t), np.uint8).astype(np.int16) for t in (a, b))
        assert not fp.are_copies(a, b, 0.05) or fp.possible(na, x, nb, y, 0.05)
