"""Benchmark decontamination as a prefix-filtered set join.

A window is a run of ``window`` consecutive words of a benchmark item (a shorter item is one window). Its shingles are
the runs of three words in it (of one or two where the window is as short). The corpus is read once to count how often
each benchmark shingle occurs; that orders them by rarity. A window is contained in a document only if all its shingles
are, so the necessary prefix is its rarest shingle alone: that one token per window is joined against the corpus, on
the map side. A match gives the place where the window would start; length and positional bounds drop those that leave
the document, and the rest are compared word by word.

The join's table grows with the benchmark, not with the corpus. A benchmark above CHUNK_BYTES is dealt into chunks of
about that size, each with its own pass, so the broadcast stays bounded and the result is the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacube.llm.common import map_batches, map_rows, slices, stored, utf8

WINDOW, SHINGLE = 10, 3
#: Benchmark text of one broadcast table.
CHUNK_BYTES = 4 << 20
#: Places compared at once.
BLOCK = 200_000

#: Lower-cases A-Z, keeps 0-9, a-z and all bytes of non-ASCII characters, and makes the rest spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


@dataclass
class Windows:
    """The windows of one chunk of the benchmark, as word numbers (1..) in rows padded with 0."""

    vocab: dict[bytes, int]
    rows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]
    width: int = field(init=False)

    def __post_init__(self):
        self.width = len(self.vocab) + 1

    @classmethod
    def of(cls, benchmark: list[tuple[str, bytes]], window: int) -> Windows:
        vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], dict[str, None]] = {}
        for item, raw in benchmark:
            ids = [vocab.setdefault(w, len(vocab) + 1) for w in words(raw)]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                found.setdefault(tuple(ids[i : i + n]), {})[item] = None
        rows = np.zeros((len(found), window), np.int64)
        for k, key in enumerate(found):
            rows[k, : len(key)] = key
        return cls(vocab, rows, np.array([len(k) for k in found], np.int64), [list(x) for x in found.values()])

    def codes(self, ids: np.ndarray, size: int) -> np.ndarray:
        """A number for each run of ``size`` words along the last axis; -1 where a word isn't one of the benchmark."""
        n = ids.shape[-1] - size + 1
        if n <= 0:
            return np.zeros((*ids.shape[:-1], 0), np.int64)
        out, known = ids[..., :n].astype(np.int64), ids[..., :n] > 0
        for k in range(1, size):
            part = ids[..., k : k + n]
            out = out * self.width + part
            known = known & (part > 0)
        return np.where(known, out, -1)

    def shingles(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By shingle size: the numbers of windows that use it, and their shingles' codes (-1: none)."""
        size = np.minimum(self.lengths, SHINGLE)
        return {int(s): (np.flatnonzero(size == s), self.codes(self.rows[size == s], int(s))) for s in np.unique(size)}

    def all_codes(self) -> dict[int, np.ndarray]:
        return {s: (u := np.unique(c))[u >= 0] for s, (_, c) in self.shingles().items()}


class Stream:
    """The words of several documents as one row of numbers, with a gap after each document."""

    def __init__(self, table: Windows, texts: list[bytes]):
        get, parts, sizes = table.vocab.get, [], []
        gap = np.zeros(1, np.int64)
        for raw in texts:
            w = words(raw)
            sizes.append(len(w))
            parts += [np.fromiter(map(get, w, repeat(0)), np.int64, len(w)), gap]
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])[:-1] if sizes else np.zeros(0, np.int64)
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)


def located(values: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in found a value of the sorted values occurs, and which."""
    if not len(values) or not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(values, found)
    at[at == len(values)] = 0
    hit = np.flatnonzero(values[at] == found)
    return hit, at[hit]


class Prefixes:
    """Each window's rarest shingle, by code: the tokens that are joined."""

    def __init__(self, table: Windows, counts: dict[int, np.ndarray]):
        self.table, self.by_size = table, {}
        codes = table.all_codes()
        for size, (numbers, c) in table.shingles().items():
            known = codes[size]
            weight = np.where(c >= 0, counts[size][np.searchsorted(known, np.maximum(c, 0)).clip(0, len(known) - 1)], np.iinfo(np.int64).max)
            offset = weight.argmin(axis=1)
            code = c[np.arange(len(c)), offset]
            order = np.argsort(code, kind="stable")
            values, first = np.unique(code[order], return_index=True)
            self.by_size[size] = values, np.append(first, len(order)), numbers[order], offset[order]

    def places(self, s: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """document, start and window of every occurrence of a window."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows, lengths = self.table.rows, self.table.lengths
        padded = np.concatenate([s.ids, np.zeros(rows.shape[1], np.int64)])
        for size, (values, first, numbers, offsets) in self.by_size.items():
            at, which = located(values, self.table.codes(s.ids, size))
            many = first[which + 1] - first[which]
            for lo, hi in blocks(many, BLOCK):
                m = many[lo:hi]
                k = np.repeat(first[which[lo:hi]], m) + ranks(m)
                window, start = numbers[k], np.repeat(at[lo:hi], m) - offsets[k]
                doc = np.searchsorted(s.starts, np.repeat(at[lo:hi], m), "right") - 1
                fits = (start >= s.starts[doc]) & (start + lengths[window] <= s.starts[doc] + s.sizes[doc])
                window, start, doc = window[fits], start[fits], doc[fits]
                same = np.ones(len(start), bool)
                for j in range(rows.shape[1]):
                    same &= (padded[start + j] == rows[window, j]) | (j >= lengths[window])
                out.append((doc[same], start[same], window[same]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(map(np.concatenate, zip(*out, strict=True)))


def blocks(many: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of entries whose counts add up to about ``most`` each."""
    if not len(many):
        return []
    group = (np.cumsum(many) - many) // most
    cut = np.flatnonzero(np.diff(group)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(many)], strict=True))


def ranks(many: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of many, one after the other."""
    return np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)


def hits(join: Prefixes, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per text: its words, the runs of words [start, end) inside occurring windows, and the items they are from."""
    s = Stream(join.table, texts)
    doc, start, window = join.places(s)
    out: list[tuple[int, list[tuple[int, int]], list[str]]] = [(int(n), [], []) for n in s.sizes]
    if len(doc):
        edge = np.zeros(len(s.ids) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + join.table.lengths[window], -1)
        inside = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])
        turn = np.diff(inside)
        begins, ends = np.flatnonzero(turn > 0), np.flatnonzero(turn < 0)
        for d, a, b in zip((np.searchsorted(s.starts, begins, "right") - 1).tolist(), begins.tolist(), ends.tolist(), strict=True):
            out[d][1].append((a - int(s.starts[d]), b - int(s.starts[d])))
        for d, w in np.unique(np.stack([doc, window], 1), axis=0).tolist():
            out[d][2].extend(join.table.items[w])
    return [(n, runs, sorted(set(items))) for n, runs, items in out]


def rarity(docs: DataFrame, text_col: str, tables: Windows) -> dict[int, np.ndarray]:
    """How often each shingle of the benchmark occurs in all documents, by shingle size, in the order of all_codes()."""
    codes = tables.all_codes()
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def count(batches):
        t = shared.value
        known = t.all_codes()
        sums = {s: np.zeros(len(v), np.int64) for s, v in known.items()}
        for batch in batches:
            for part in slices(batch):
                ids = Stream(t, utf8(part.column(0))).ids
                for s, v in known.items():
                    sums[s] += np.bincount(located(v, t.codes(ids, s))[1], minlength=len(v))
        for s, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s), pa.int32()), pa.array(known[s][at], pa.int64()), pa.array(n[at], pa.int64())], ["size", "code", "n"])

    rows = map_batches(docs.select(F.col(text_col).cast("string").alias("text")), count, "size int, code long, n long").groupBy("size", "code").agg(F.sum("n").alias("n")).toPandas()
    out = {s: np.zeros(len(v), np.int64) for s, v in codes.items()}
    for s, v in codes.items():
        mine = rows[rows["size"] == s]
        out[s][np.searchsorted(v, mine["code"].to_numpy(np.int64))] = mine["n"].to_numpy(np.int64)
    return out


def joins(docs: DataFrame, items: DataFrame, window: int, text_col: str, item_col: str, item_text: str):
    """The prefix tables of the benchmark, one per chunk of bounded size."""
    bench = items.filter(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    for k in range(chunks):
        part = bench.filter(F.pmod(F.xxhash64("item"), F.lit(chunks)) == k) if chunks > 1 else bench
        table = Windows.of([(r["item"], r["text"].encode("utf-8")) for r in part.toLocalIterator()], window)
        if len(table.rows):
            yield Prefixes(table, rarity(docs, text_col, table))


RUNS = "array<struct<start:long,end:long>>"


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (of words inside occurrences, [start, end)) and items (ids as sorted strings) per row of docs.

    Null and empty texts have no words and no hits; null items or item ids are left out; an item twice counts once;
    repeated documents give repeated rows; an empty benchmark hits nothing, an empty table gives an empty one. Texts of any
    length are looked at as a whole. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.withColumns({"n_words": F.lit(0).cast("long"), "runs": F.array().cast(RUNS), "items": F.array().cast("array<string>")})
    empty = Prefixes(Windows.of([], window), {})
    tables = joins(docs, items, window, text_col, item_col, item_text)
    join, after = next(tables, empty), None
    while join is not None:
        after = next(tables, None)
        shared = docs.sparkSession.sparkContext.broadcast(join)

        def make(shared=shared):
            def act(part: pa.RecordBatch) -> pa.RecordBatch:
                found = hits(shared.value, utf8(part.column(1)))
                runs = [merged(old, new) for old, (_, new, _) in zip(part.column(3).to_pylist(), found, strict=True)]
                names = [sorted({*old, *new}) for old, (*_, new) in zip(part.column(4).to_pylist(), found, strict=True)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([n for n, *_ in found], pa.int64()), pa.array(runs, kind), pa.array(names, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "runs", "items"])

            return act

        out = map_rows(out, make, f"doc_id long, text string, n_words long, runs {RUNS}, items array<string>")
        out = stored(out, "decontam") if after is not None else out
        join = after
    return out.drop("text")


def merged(old: list[dict], new: list[tuple[int, int]]) -> list[dict]:
    """Runs of two passes as one list of disjoint ones."""
    out: list[dict] = []
    for a, b in sorted([(x["start"], x["end"]) for x in old] + new):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def digests(found: DataFrame) -> DataFrame:
    """The columns of the contract from scan()'s."""
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs without any word inside an occurrence of a benchmark window, all columns as they were, whatever their names.

    Null and empty texts stay; of long texts every word is looked at. Null items and ids are left out, an item twice is as
    one; repeated rows have one fate; an empty table or benchmark takes nothing away.
    """
    out = docs
    for join in joins(docs, items, window, text_col, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(join)
        at = docs.columns.index(text_col)

        def make(shared=shared):
            def act(part: pa.RecordBatch) -> pa.RecordBatch:
                clean = [not runs for _, runs, _ in hits(shared.value, utf8(part.column(at)))]
                return part.filter(pa.array(clean, pa.bool_()))

            return act

        out = map_rows(out, make, docs.schema)
    return out


#: DuckDB: all windows of items against all runs of as many words.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
b AS (SELECT item_id, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT item_id, w, least(10, len(w)) AS l FROM b WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, l, array_to_string(w[k:k + l - 1], ' ') AS g FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM s)),
z AS (SELECT r, l, k, array_to_string(w[k:k + l - 1], ' ') AS g FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, (SELECT DISTINCT l FROM i) WHERE len(w) >= l)),
m AS (SELECT z.r, z.l, z.k, i.item_id FROM z JOIN i USING (l, g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + l)) AS p FROM m) GROUP BY r),
t AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
