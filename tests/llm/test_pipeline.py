"""The pipeline against plain code, stage by stage, over the smallest tables."""

import public_tokenizers
import pytest
from test_decontam import brute as contaminated
from test_line_dedup import brute as lines_left
from test_minhash import brute as near
from tokenizers import Tokenizer

import corpus_pipeline
from stratacube.llm import langid
from stratacube.llm import line_dedup as ld

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        out.append(after.collect())
        docs = after
    return out


def test_language_id(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    texts = [r.text for r in stages[0]]
    kept = {r.doc_id for r, (_, _, bad) in zip(stages[0], langid.Scorer(model).predict(texts), strict=True) if not bad}
    assert {r.doc_id for r in stages[1]} == kept and len(kept) > 0.95 * len(texts)
    assert [tuple(r) for r in stages[1]] == [tuple(r) for r in stages[0] if r.doc_id in kept]


def test_lines(stages):
    want = {i: t for i, _, _, t in lines_left([(r.doc_id, r.source, r.text) for r in stages[1]], ld.RATIO)}
    assert {r.doc_id: r.text for r in stages[2]} == want


def test_near_dedup(stages):
    want = {x[0] for x in near([(r.doc_id, r.text) for r in stages[2]], 5) if x[3]}
    assert {r.doc_id for r in stages[3]} == want


def test_decontamination(spark, stages):
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    # Words decide only where a document shares ten words with an item; others are left out to keep the loops short.
    grams = {tuple(w[i : i + 5]) for _, t in bench for w in [t.lower().split()] for i in range(len(w) - 4)}
    some = [r for r in stages[3] if any(tuple(w[i : i + 5]) in grams for w in [r.text.lower().split()] for i in range(len(w) - 4))]
    bad = {x[0] for x in contaminated([(r.doc_id, r.text) for r in some], bench, 10) if x[-1]}
    assert {r.doc_id for r in stages[4]} == {r.doc_id for r in stages[3]} - bad and bad


def test_encoding(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in stages[4]}
    assert len(stages[5]) == len(texts)
    for r in stages[5]:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(list(r.asDict()) == columns for rows in stages[:5] for r in rows[:1])


def test_odd_rows(spark, tmp_path):
    """Nulls, repeats, long texts, clashing names, an empty table: each stage gives what its docstring says."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _gone int, _dedup int, kept int"
    spark.createDataFrame([(1, "an item of the benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"word{chr(97 + i % 26)} of the and" for i in range(20_000))
    plain = "the and of the with that from this and those of them"
    odd = [(1, None, None, None, None), (None, plain, "en", "s", 1), (2, "", "en", "s", 0), (3, plain, "en", None, 3), (3, plain, "en", None, 3), (4, long, "en", "s", 4), (6, long + " more", "en", "t", 4), (7, plain + " an item of the benchmark", None, "s", 5)]
    # language: null and empty go; lines: nothing repeats on two pages; near: 6 copies 4; decontamination: 7 goes
    want = [[3, 3, 4, 6, 7, None], [3, 3, 4, 6, 7, None], [3, 3, 4, 7, None], [3, 3, 4, None], [3, 3, 4, None]]
    by_id = lambda x: (x is None, x)
    for rows, ids in (([], [[]] * 5), (odd, want)):
        docs = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], schema)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            after = stage(spark, docs, str(tmp_path))
            assert k == 4 or after.columns == docs.columns
            got = after.collect()
            assert sorted((r.doc_id for r in got), key=by_id) == ids[k], name
            assert k == 4 or all((r._gone, r._dedup, r.kept) == (7, 8, 9) for r in got)
            docs = after


def test_run_leaves_one_table(spark):
    from stratacube import scratch

    since = scratch.mark()
    out = corpus_pipeline.run(spark, SF)
    assert len(scratch._made[since:]) == 1 and "stage-decontamination" in scratch._made[-1]
    assert out.count() > 0
