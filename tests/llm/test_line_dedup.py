from collections import defaultdict

from stratacube.llm import line_dedup

FOOT = "All rights reserved"


def brute(rows, ratio, least=2):
    pages, on = defaultdict(set), defaultdict(set)
    for _, host, text in rows:
        if host is not None and text is not None:
            pages[host].add(text)
            for line in text.split("\n"):
                on[host, line.strip(" ")].add(text)
    out = []
    for i, host, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if host is None or not x.strip(" ") or len(on[host, x.strip(" ")]) < least or len(on[host, x.strip(" ")]) <= ratio * len(pages[host])]
        out.append((i, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return out


def test_equals_brute_force(spark):
    rows = [(i, "big", f"page {i}\n {FOOT} \n\nbody {i}\nbody {i}") for i in range(30)]
    rows += [(100 + i, "copies", "same\npage") for i in range(20)]  # one page, whatever its copies
    rows += [(200 + i, "rare", f"p {i}" + ("\nonce in a while" if i < 5 else "")) for i in range(60)]
    rows += [(300, None, FOOT), (301, "big", None), (302, "big", ""), (303, "big", FOOT), (303, "big", FOOT), (304, "", "x\n" * 5000), (305, "big", f"{FOOT}\n{FOOT}\nx\r")]
    docs = spark.createDataFrame([(i, s, t, 1, "c") for i, s, t in rows], "doc_id long, source string, text string, _lines int, _host string").repartition(5)
    got = line_dedup.drop_lines(docs, ratio=0.1)
    key = lambda r: (r[0], r[3] or "")
    assert sorted([(r.doc_id, r._dedup.n_lines, r._dedup.n_dropped, r.text) for r in got.collect()], key=key) == sorted(brute(rows, 0.1), key=key)
    clean = line_dedup.cleaned(docs)
    assert clean.schema == docs.schema and clean.count() == len(rows)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "h", "x\ny", 7, 8, 9), (2, "h", "x\nz", 7, 8, 9)], "doc_id long, source string, text string, _dedup int, _mine int, _ROW int")
    out = line_dedup.drop_lines(docs)
    assert out.columns == [*docs.columns, "_dedup_"] and sorted(r.text for r in out.collect()) == ["y", "z"]
    assert line_dedup.cleaned(docs).schema == docs.schema and {r._dedup for r in line_dedup.cleaned(docs).collect()} == {7}


def test_small_hosts_and_ties(spark):
    """A line on all three pages of a host goes; one on one page stays; one just at the ratio stays."""
    rows = [(i, "three", f"{FOOT}\nown {i}") for i in range(3)] + [(10 + i, "forty", f"p {i}" + ("\nat the ratio" if i < 4 else "") + ("\nabove" if i < 5 else "")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sorted(r.text for r in line_dedup.cleaned(docs).collect())
    assert got == sorted([f"own {i}" for i in range(3)] + [f"p {i}" + ("\nat the ratio" if i < 4 else "") for i in range(40)])


def test_long_text(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, "h", f"{long}\n{FOOT}"), (2, "h", FOOT), (3, "h", "z")], "doc_id long, source string, text string")
    assert {r.doc_id: r.text for r in line_dedup.cleaned(docs).collect()} == {1: long, 2: "", 3: "z"}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert line_dedup.cleaned(docs).count() == 0


def test_no_text_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = line_dedup.cleaned(docs)._jdf.queryExecution().toString()
    assert "PythonUDF" not in plan and "CartesianProduct" not in plan
