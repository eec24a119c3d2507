import zlib

import numpy as np
import pytest

from stratacube.llm import langid

DOCS = "/root/testdata/sf0.01/documents.parquet"


def hashes(ws):
    """Subwords' hashes by word, in any order."""
    out = [[] for _ in ws]
    for h, word in langid.blocks(ws):
        for x, w in zip(h.tolist(), word.tolist(), strict=True):
            out[w].append(x)
    return [sorted(x) for x in out]


def test_subwords_stay_inside_words(monkeypatch):
    both = hashes(["ab", "x", "a" * 500])
    assert list(map(len, both)) == [6, 3, 3 * 502 - 6] and both == [hashes([w])[0] for w in ["ab", "x", "a" * 500]]
    monkeypatch.setattr(langid, "BLOCK", 7)  # blocks cut words, not subwords
    assert hashes(["ab", "x", "a" * 500]) == both


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS)


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(docs, rows=2000)


def test_held_out_accuracy_and_rejection(docs, model):
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    out = got[got["held_out"]]
    assert (out["lang_pred"] == out["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all() and got["rejected"].mean() < 0.02
    # calibrated: the mean score is close to the share that is right
    assert abs(out["score"].mean() - (out["lang_pred"] == out["lang"]).mean()) < 0.05


def test_odd_rows(spark, model):
    rows = [(1, None, "a"), (2, "", "a"), (3, "123 ,.!", "a"), (4, "the " * 30_000, "a"), (5, "é", "a"), (5, "é", "a"), (None, "the and of", "a"), (6, "x" * 5000, None), (7, "Ⅷ²½", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (1, 2, 3, 7))
    assert by[4].lang_pred == "en" and not by[4].rejected
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and {4} <= {r.doc_id for r in kept.collect()}


def test_scores_do_not_depend_on_the_cache(model, monkeypatch):
    texts = ["der die das und", "the of and", "le la les et", None] * 5
    want = langid.Scorer(model).predict(texts)
    monkeypatch.setattr(langid, "CACHE_CELLS", 1)
    monkeypatch.setattr(langid, "TOGETHER", 2)
    small = langid.Scorer(model)
    assert [small.predict([t])[0][0] for t in texts] == [x[0] for x in want]
    assert np.allclose([small.predict([t])[0][1] for t in texts], [x[1] for x in want])


def test_no_rows(spark, model):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    nothing = langid.fit(empty)
    assert langid.identify(empty, model).count() == 0
    one = spark.createDataFrame([(1, "the", "en")], "doc_id long, text string, lang string")
    assert langid.identify(one, nothing).first().lang_pred == "und"


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_noise_is_rejected_at_every_size(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    model = langid.fit(docs)
    rng = np.random.default_rng(3)
    held = [w for t in docs.filter(~langid.learnable()).orderBy("doc_id").limit(300).toPandas()["text"] if len(w := langid.words(t or "")) >= 20]
    scorer = langid.Scorer(model)
    share = lambda texts: np.mean([x[2] for x in scorer.predict([" ".join(ws) for ws in texts])])
    shuffled = ["".join(rng.permutation(list("".join(ws)))) for ws in held]
    ends = [np.cumsum([len(w) for w in ws]).tolist() for ws in held]
    assert share(held) < 0.01
    assert share([[s[a:z] for a, z in zip([0, *e], e, strict=False)] for s, e in zip(shuffled, ends, strict=True)]) > 0.99
    for first in (0x4E00, 0x430, 0xAC00):  # Han, Cyrillic, Hangul
        assert share([["".join(chr(first + (ord(c) % 26)) for c in w) for w in ws] for ws in held]) > 0.99


def test_few_rows_reject_noise():
    base = "the quick brown fox jumps over the lazy dog and runs away from the old house near the river"
    model = langid.train([("en", base), ("en", base + " again"), ("de", "der schnelle braune fuchs springt über den faulen hund")] * 3)
    got = langid.Scorer(model).predict([base, "жил был у бабушки серенький козлик"])
    assert [x[2] for x in got] == [False, True]


def test_forty_rows_are_calibrated_and_one_row_is_learnt():
    rng = np.random.default_rng(5)
    vocab = {"aa": ["lo", "mira", "tolen", "sabe", "quor"], "bb": ["zyx", "wunth", "krag", "vost", "hjem"]}
    rows = [(lang, " ".join(rng.choice(ws, 12))) for lang, ws in vocab.items() for _ in range(20)]
    model = langid.train(rows)
    assert model.familiar > 0 and model.reject_below > 0
    scorer = langid.Scorer(model)
    assert [x[0] for x in scorer.predict([text for _, text in rows])] == [lang for lang, _ in rows]
    assert [x[2] for x in scorer.predict(["lo mira tolen", "жил был у", "pfff gggg iiii"])] == [False, True, True]
    alone = langid.Scorer(langid.train(rows[:1]))
    assert alone.predict(["lo mira"])[0][0] == "aa"


def test_every_language_is_learnt(spark):
    """More languages than the sample has rows for: each has some."""
    rng = np.random.default_rng(6)
    words = {f"l{k:03}": ["".join(chr(0x4E00 + 40 * k + int(c)) for c in rng.integers(0, 40, 3)) for _ in range(6)] for k in range(120)}
    rows = [(i, " ".join(rng.choice(ws, 8)), lang) for i, (lang, ws) in enumerate((lang, ws) for lang, ws in words.items() for _ in range(4))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=100)
    learnt = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5}
    assert model.langs == sorted(learnt)


def test_a_long_run_of_letters_is_one_word(model):
    assert langid.words("é" * 100_000) == ["é" * 100_000]
    lang, score, _ = langid.Scorer(model).predict(["the of and " * 2000 + "x" * 300_000])[0]
    assert lang == "en" and 0 < score <= 1


def plain_prediction(model, text):
    """Language, score and rejection of one text, subword by subword."""
    means = []
    for w in langid.words(text or ""):
        chars, scores, seen = f"<{w}>", [], []
        for n in langid.SIZES:
            for i in range(len(chars) - n + 1):
                h = n
                for c in chars[i : i + n]:
                    h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 29
                scores.append(model.scores[(h >> 17) % langid.BUCKETS])
                seen.append(h in model.known_set)
        means.append([*np.mean(scores, axis=0), np.mean(seen)])
    if not means:
        return "und", 0.0, True
    *mean, familiar = np.mean(means, axis=0)
    e = np.exp((np.array(mean) + model.bias) / model.temperature)
    p = e / e.sum()
    return model.langs[int(p.argmax())], float(p.max()), bool(p.max() < model.reject_below or familiar < model.familiar)


def test_equals_plain_python(spark, docs, model):
    """All texts of the smallest table, and odd ones."""
    model.known_set = set(model.known.tolist())
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(10**6 + i, t) for i, t in enumerate([None, "", "é", "жил был", "zzzz qqqq", "a" * 300, "12 3"])]
    rows = small.union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r.doc_id: r for r in langid.identify(rows, model).collect()}
    texts = [(i, t) for i, t in rows.collect() if len(t or "") < 6_000]
    assert len(texts) > 150
    for i, text in texts:
        lang, score, rejected = plain_prediction(model, text)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-4), i
        assert got[i].rejected == rejected or min(abs(score - model.reject_below), 1e-4) < 1e-4 or i >= 10**6
