"""Token counts by a two-tier lookup on the map side.

The first tier is a broadcast table from frequent pre-tokens to their number of tokens; the second is a worker's own
cache, filled by encoding what the first lacks. The counts don't depend on what the first tier holds: it only saves work.

What is frequent is counted over the whole texts of all documents. A task keeps a bounded number of counters; where they
run out, the least ones go (so a pre-token's count may be too low, but not that of one that is frequent in the task). It
hands on its TASK_ENTRIES most frequent ones, and only these are added up; the pre-tokens of texts are never shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacube.llm.bpe import CACHE_ENTRIES, Memo, WordBpe, codec
from stratacube.llm.common import dropped, id_text, map_batches, map_rows, slices, stored

#: Entries of the first tier; counters of a task and entries that it hands on.
TABLE_ENTRIES, TASK_COUNTERS, TASK_ENTRIES = 65_536, 200_000, 32_768


def frequent(docs: DataFrame, path: str, entries: int) -> list[str]:
    """The most frequent pre-tokens of all documents, ``entries`` at most; those of about one frequency are all in or all out.

    A histogram of the frequencies says from which on they fit, so no task sends the driver more than is wanted in all.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = codec(path).bpe, Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    for piece, special in bpe.pieces(text or ""):
                        if not special:
                            seen.update(bpe.pre_tokens(piece))
                if len(seen) > 2 * TASK_COUNTERS:
                    seen = Counter(dict(seen.most_common(TASK_COUNTERS)))
        top = seen.most_common(TASK_ENTRIES)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    found = stored(map_batches(docs.select("text"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    octave = F.floor(F.log2("n") * 16).cast("int")
    least, total = None, 0
    for r in sorted(found.groupBy(octave.alias("octave")).agg(F.count("*").alias("words")).collect(), reverse=True):
        total += r["words"]
        if total > entries:
            break
        least = r["octave"]
    out = [] if least is None else sorted(found.filter(octave >= least).select("word").toArrow().column("word").to_pylist())
    dropped(found)
    return out


def frequent_lengths(docs: DataFrame, path: str, entries: int = TABLE_ENTRIES) -> bytes:
    """A compact table of frequent pre-tokens: words and one byte of length each, deflated."""
    bpe: WordBpe = codec(path).bpe
    lengths = {w: n for w in frequent(docs, path, entries) if (n := len(bpe.merge(w))) < 256 and not {"\n", "\0"} & set(w)}
    return zlib.compress("\n".join(lengths).encode("utf-8") + b"\0" + bytes(lengths.values()))


class TwoTier(dict):
    """pre-token -> tokens: the broadcast table, then a worker's bounded cache."""

    def __init__(self, table: bytes, bpe: WordBpe):
        words, lengths = zlib.decompress(table).split(b"\0", 1) if table else (b"", b"")
        super().__init__(zip(words.decode("utf-8").split("\n"), lengths, strict=False))
        self.misses = Memo(lambda w: len(bpe.merge(w)), CACHE_ENTRIES)

    def __missing__(self, word: str) -> int:
        return self.misses[word]


_tables: dict[tuple[str, int], TwoTier] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for each row.

    A null text counts as empty: 0 bytes, 0 tokens, not over; whole texts of any length are counted, just ``limit`` tokens
    aren't over it; a null id stays null. Repeated rows give repeated results; other columns are ignored, whatever their
    names; an empty table gives an empty one.
    """
    rows = id_text(docs, id_col, text_col)
    table = rows.sparkSession.sparkContext.broadcast(frequent_lengths(rows, path))

    def make():
        bpe = codec(path).bpe
        key = (path, zlib.crc32(table.value))
        if key not in _tables:
            _tables.clear()
            _tables[key] = TwoTier(table.value, bpe)
        get = _tables[key].__getitem__

        def count(text: str) -> int:
            return sum(1 if special else sum(map(get, bpe.pre_tokens(piece))) for piece, special in bpe.pieces(text))

        def act(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in part.column(1).to_pylist()]
            n = [count(t) for t in texts]
            size = [len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts]
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return act

    return map_rows(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
