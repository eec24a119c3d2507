import random
import re

import numpy as np
import pytest

from stratacube.llm import minhash
from stratacube.llm.components import components


def sets(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + min(size, len(w))]) for i in range(len(w) - min(size, len(w)) + 1)} if w else set()


def brute(docs, size):
    s = {i: sets(t, size) for i, t in docs}
    up = {i: i for i in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if s[a] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted((i, len(s[i]), root(i), root(i) == i) for i in s)


def made(seed, groups=12):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs, i = [], 0
    for g in range(groups):
        n = r.choice([1, 2, 4, 5, 6, 9, 30, 120, 400])
        base = r.choices(vocab, k=n)
        for _ in range(r.choice([1, 2, 3, 40 if g == 3 else 6])):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.3:
                w = w[: max(1, len(w) - r.randrange(1 + len(w) // 8))]
            base = w if r.random() < 0.6 else base  # chains: ends that are no links themselves
            docs.append((i * 7 % 1009, " ".join(w).upper() if r.random() < 0.2 else "\t".join(w)))
            i += 1
    return docs


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 3), (3, 1024)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = [*made(seed), (2000, None), (2001, ""), (2002, " \x0b "), (2003, "one"), (2004, "ONE"), (2005, "a a a a a a a a"), (2006, "a a a a a"), (2007, "x " * 3000)]
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, kept int").repartition(6)
    got = minhash.near_duplicates(d, 4)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == brute(docs, 4)
    if block == 3:
        left = minhash.deduplicated(d, 4)
        assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == sorted(x[0] for x in brute(docs, 4) if x[3])


def test_estimate_is_close():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.8, 0.95):
        n = 4000
        both = int(2 * n * share / (1 + share))
        pool = np.unique(minhash.mixed(rng.integers(1, 2**63, 2 * n - both, dtype=np.uint64)))
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n:]]))
        assert abs(minhash.estimate(minhash.registers(a), minhash.registers(b), np.int64(n), np.int64(n)) - share) < 0.16


def test_collision_follows_the_sizes():
    rng = np.random.default_rng(7)
    for n, m in ((2000, 2000), (4000, 1000)):
        equal = np.mean([minhash.registers(np.sort(rng.integers(1, 2**64, n, dtype=np.uint64))) == minhash.registers(np.sort(rng.integers(1, 2**64, m, dtype=np.uint64))) for _ in range(3000)])
        assert 0.5 < equal / minhash.collision(np.int64(n), np.int64(m)) < 2


def template(n, size=60, own=10):
    """Texts of one template with a similarity of 0.7 or so: no two are links."""
    r = random.Random(n)
    base = [f"t{i}" for i in range(size)]
    return [(i, " ".join(base[:30] + [f"x{r.randrange(10**9)}" for _ in range(own)] + base[30:])) for i in range(n)]


def test_templates_do_not_grow_with_their_square(spark, monkeypatch):
    """Rows that the last step compares: as many as there are copies, whatever the template's size."""
    monkeypatch.setattr(minhash, "BLOCK", 32)
    seen = []
    whole = minhash.dealt
    monkeypatch.setattr(minhash, "dealt", lambda rows, group, blocks: (seen.append(whole(rows, group, blocks).count()) if group == "family" else None, whole(rows, group, blocks))[1])
    for n in (100, 400):
        docs = template(n) + [(10_000 + i, t.replace("t3 ", "t3x ")) for i, t in template(n)[:20]]
        got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()
        assert {r.doc_id: r.component_id for r in got} == {i: i - 10_000 if i >= 10_000 else i for i, _ in docs}
    assert len(seen) <= 2 and all(x <= 200 for x in seen), seen


def test_prefixes_lose_no_link(spark):
    """parted() keeps together what reaches the similarity, at any number of counters."""
    r = random.Random(11)
    pool = list(range(1, 400))
    sets = []
    for i in range(0, 120, 2):
        a = set(r.sample(pool, r.choice([1, 5, 10, 40])))
        b = set(a)
        for _ in range(len(a) // 10):
            b.discard(r.choice(sorted(b)))
        sets += [(0, i, i, sorted(a)), (0, i + 1, i + 1, sorted(b))]
    member = spark.createDataFrame(sets, "family long, component long, node long, set array<long>")
    got = {x.component: x.family for x in minhash.parted(member, (80, 100)).collect()}
    for _, i, _, a in sets:
        for _, j, _, b in sets:
            if i < j and 100 * len({*a} & {*b}) >= 80 * len({*a} | {*b}):
                assert got[i] == got[j]


def test_clashing_names_and_long_texts(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    d = spark.createDataFrame([(1, long, 1, 2), (2, long + " end", 1, 2), (3, "z", 1, 2)], "doc_id long, text string, _gone int, component int")
    left = minhash.deduplicated(d)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_small_sets_agree_as_often_as_they_are_alike():
    rng = np.random.default_rng(1)
    same = []
    for _ in range(300):
        pool = np.unique(minhash.mixed(rng.integers(1, 2**63, 5, dtype=np.uint64)))
        same.append((minhash.registers(pool) == minhash.registers(np.delete(pool, rng.integers(5)))).mean())
    assert abs(np.mean(same) - 0.8) < 0.05


def test_repeated_and_empty_rows(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(d, 4).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, None, True), (3, 0, 3, True)], key=str)
    assert minhash.near_duplicates(d.filter("false"), 4).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 300), (300, 200)] + [(500, i) for i in range(501, 700)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 150: 150, 200: 150, 300: 150, **dict.fromkeys(range(500, 700), 500)}
