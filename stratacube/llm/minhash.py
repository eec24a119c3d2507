"""Near-duplicate documents by HyperMinHash.

A document is its set of distinct word shingles, hashed to 64 bits. The hash's range is cut into REGISTERS buckets;
each keeps the least hash that falls there, as its number of leading zeros and the MANTISSA bits after them (two bytes).
A bucket without a hash takes that of a bucket with one, chosen by a fixed random order of its own, so equal sets agree
everywhere and similar sets agree with a chance equal to their similarity, however small they are.

1. Documents with equal sets are one class; from here on a class stands for them.
2. Banding: BANDS runs of ROWS registers are keys. Classes that share a key are candidates.
3. Each bucket of a key has a leader (the class that is first in a fixed random order). Each class is tried against the
   leader that it shares most buckets with: the share of equal registers, corrected for chance collisions of registers,
   estimates the similarity; pairs far below the threshold go. The rest are confirmed on their full sets. Links make
   components.
4. A pair that no leader has joined can still be a link. Where a bucket holds several components, classes of different
   components are compared by registers, in blocks of bounded size, a bucket of any size being dealt over many tasks.
   A task reports at most one pair of components per component. What these pairs connect is a family.
5. A family of more than one block may be documents of one template that aren't links, so it is cut by prefixes: with shingles ordered by
   rarity, two sets that reach the similarity, and so have so many in common for their sizes, share one of their first.
   How many first ones that are follows from the own size and the least size in a class of partners' sizes. Components
   that share such a shingle stay together; the others part. In what is left all full sets (hashes, not texts) are
   compared across components, in blocks, and a spanning forest of the links is reported.

So every pair that shares a key is either confirmed, refuted, or known to be in one component already. With 32 bands of
4, a pair at the threshold of 0.8 shares no key with a chance below 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacube.llm.bpe import Memo
from stratacube.llm.common import dropped, free, id_text, map_batches, map_rows, slices, stored, utf8
from stratacube.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, MANTISSA = 32, 4, 10
REGISTERS = BANDS * ROWS
#: Mean share of a cell's width in the place of its values, over one halving: 1 / (2 ln 2).
CELL = 0.7213
#: Counters of shingles that order them by rarity within families.
COUNTERS = 1 << 18
#: Sizes of one class differ by this factor at most.
SIZE_CLASS = 1.08
#: The estimate refutes a pair only this far below the threshold: its standard error is 0.03 to 0.042 at any size from
#: ESTIMATE_FROM on, so a link is refuted with a chance below 1e-6. Smaller sets are never refuted by it.
MARGIN, ESTIMATE_FROM = 0.21, 10
#: Classes, and shingles of their sets, in one block of step 4.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Pairs that one copy of a document's text serves; bits of the bitmap of wanted ids.
PER_SALT, MAX_BITS = 64, 1 << 27

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: For each register, the order in which it borrows from buckets that have a hash.
BORROW = mixed(np.arange(1, REGISTERS * REGISTERS + 1, dtype=np.uint64)).reshape(REGISTERS, REGISTERS)
STARTS = np.array([-(-(k << 64) // REGISTERS) for k in range(REGISTERS)], np.uint64)

#: Words whose hashes a task keeps.
CACHE_WORDS = 100_000


def word_hashes() -> Memo:
    """A task's cache; it goes with the task."""
    return Memo(xxhash.xxh3_64_intdigest, CACHE_WORDS)


def shingle_set(raw: bytes, size: int, hashes: Memo) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of ``size`` words; all its words as one if they are fewer."""
    words = raw.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h + w[k : k + len(h)]) * _MULTIPLIERS[k % len(_MULTIPLIERS)]
        h ^= h >> np.uint64(31)
    return np.unique(mixed(h))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The REGISTERS registers (uint16) of a sorted set that isn't empty."""
    at = np.searchsorted(hashes, STARTS)
    end = np.append(at[1:], len(hashes))
    full = at < end
    # The place of the bucket's least hash within the bucket, as 64 bits.
    place = (hashes[np.minimum(at, len(hashes) - 1)] - STARTS) * np.uint64(REGISTERS)
    exponent = np.frexp(place.astype(np.float64) + 0.5)[1]
    zeros = np.clip(64 - exponent, 0, 62)
    bits = (place << zeros.astype(np.uint64) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | bits).astype(np.uint16)
    if not full.all():
        have = np.flatnonzero(full)
        lack = np.flatnonzero(~full)
        from_ = have[BORROW[np.ix_(lack, have)].argmin(axis=1)]
        # With its origin, else equal registers of different buckets would meet in one.
        out[lack] = (out[from_] ^ mixed(from_.astype(np.uint64) + np.uint64(77)).astype(np.uint16)).astype(np.uint16)
    return out


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, class (16 bytes: a digest of the set; null if empty), regs (bytes)."""

    def make():
        hashes = word_hashes()

        def act(part: pa.RecordBatch) -> pa.RecordBatch:
            n, classes, regs = [], [], []
            for raw in utf8(part.column(1)):
                s = shingle_set(raw, shingle, hashes)
                n.append(len(s))
                classes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "class", "regs"])

        return act

    return map_rows(docs, make, "doc_id long, n_shingles long, class binary, regs binary")


def collision(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How often registers of sets without a common element are equal, by the sets' sizes.

    A bucket's least value of n shingles spread over the buckets has density n exp(-n x), a cell at x the width CELL * x *
    2^-MANTISSA on average; the integral of both densities over the cell's width is this.
    """
    na, nb = na.astype(np.float64), nb.astype(np.float64)
    return CELL * 2.0**-MANTISSA * na * nb / np.maximum(na + nb, 1) ** 2


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity from registers (along the last axis), corrected for those that are equal by chance."""
    by_chance = collision(na, nb)
    return np.maximum(0.0, ((a == b).mean(axis=-1) - by_chance) / (1 - by_chance))


def kept_by_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs may reach the similarity, by their sizes (exactly) and their registers (with a wide margin)."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    return (small >= similarity * large - 1e-9) & ((small < ESTIMATE_FROM) | (estimate(a, b, na, nb) >= similarity - MARGIN))


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def band_keys(classes: DataFrame, *columns: str) -> DataFrame:
    """node, key and other columns: a row per band of each class, by DataFrame functions."""
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * width + 1, F.lit(width))))
    return classes.select("node", *columns, F.explode(keys).alias("key"))


def shared_buckets(classes: DataFrame) -> DataFrame:
    """key, node, leader: a row per class and bucket that holds others as well; the leader is first in a fixed random order."""
    order = F.struct(F.xxhash64("node").alias("o"), F.col("node"))
    keyed = band_keys(classes)
    leaders = keyed.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(leaders.select("key", F.col("first.node").alias("leader")), "key").select("key", "node", "leader")


def best_leader(buckets: DataFrame) -> DataFrame:
    """a, b: for each class the leader that it shares most buckets with, one pair per class.

    The number of shared buckets rises with the similarity; step 4 takes up the other leaders' components if this one fails.
    """
    shared = buckets.filter("node <> leader").groupBy("leader", "node").agg(F.count("*").alias("n"))
    return shared.groupBy(F.col("node").alias("b")).agg(F.max(F.struct("n", "leader")).alias("best")).select(F.col("best.leader").alias("a"), "b")


def estimated(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b that kept_by_estimate() leaves."""
    c = classes.select("node", "n_shingles", "regs")
    rows = pairs.join(c.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("regs").alias("ra")), "a").join(c.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("regs").alias("rb")), "b")

    def make():
        def act(part: pa.RecordBatch) -> pa.RecordBatch:
            ok = kept_by_estimate(matrix(part.column(3)), matrix(part.column(5)), part.column(2).to_numpy(), part.column(4).to_numpy(), similarity)
            return part.select(["a", "b"]).filter(pa.array(ok))

        return act

    return map_rows(rows.select("a", "b", "na", "ra", "nb", "rb"), make, "a long, b long")


class Forest:
    """Which of some components have been joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether they weren't one before."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def dealt(rows: DataFrame, group: str, blocks: DataFrame) -> DataFrame:
    """rows (group, node, component, ...) dealt into the blocks of their group: block, probe, is_major added.

    blocks: group, major (its largest component), blocks. Each class lives in one block; those outside the largest
    component go to all blocks as probes as well. Comparing each block's probes with those that live there covers all
    pairs of different components.
    """
    rows = rows.join(blocks, group).withColumn("is_major", F.col("component") == F.col("major"))
    home = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks"))).withColumn("probe", F.lit(False))
    away = rows.filter(~F.col("is_major")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))).withColumn("probe", F.lit(True))
    return home.unionByName(away).drop("major", "blocks")


def weak_links(buckets: DataFrame, classes: DataFrame, comps: DataFrame, similarity: float) -> DataFrame:
    """a, b: components with classes that share a key and pass kept_by_estimate(); per block, each with one it hangs together with."""
    known = classes.join(comps, "node", "left").select("node", "n_shingles", "regs", F.coalesce("component", "node").alias("component"))
    keyed = buckets.select("key", "node").join(known.select("node", "component"), "node")
    shares = keyed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed_up = shares.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("k")).filter("k > 1")
    mixed_up = mixed_up.select("key", F.col("top.component").alias("major"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = dealt(keyed, "key", mixed_up).join(known.select("node", "n_shingles", "regs"), "node").select("key", "block", "node", "component", "is_major", "probe", "n_shingles", "regs")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "key", "block").sortWithinPartitions("key", "block", "probe")

    def run(batches):
        at, block = None, Block(similarity)
        for batch in batches:
            for part in slices(batch):
                for rows_of_block in groups(iter([part]), 2):  # those that live in the block come first, then its probes
                    here = rows_of_block.column(0)[0].as_py(), rows_of_block.column(1)[0].as_py()
                    if here != at:
                        if (found := block.pairs()).num_rows:
                            yield found
                        at, block = here, Block(similarity)
                    block.take(rows_of_block)
        if (found := block.pairs()).num_rows:
            yield found

    return map_batches(rows, run, "a long, b long").distinct()


def groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Rows with the same first ``width`` columns (they come one after the other), as tables."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(width)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and tuple(keys[lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(keys[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


class Block:
    """Which components of one block may belong together. It holds those that live there; probes pass by."""

    def __init__(self, similarity: float):
        self.similarity, self.forest, self.parts, self.home = similarity, Forest(), [], None

    def take(self, rows: pa.Table) -> None:
        comp, size = (rows.column(c).to_numpy() for c in ("component", "n_shingles"))
        probe, major = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("probe", "is_major"))
        regs = matrix(rows.column("regs").combine_chunks())
        if not probe.all():
            self.parts.append(tuple(x[~probe] for x in (comp, size, major, regs)))
        for x in np.flatnonzero(probe).tolist():
            if not self.parts:
                return  # only probes: no class lives in this block
            if self.home is None:
                self.home = tuple(map(np.concatenate, zip(*self.parts, strict=True)))
            comps, sizes, majors, all_ = self.home
            to = np.flatnonzero((comps != comp[x]) & (majors | (comps > comp[x])))
            if len(to):
                ok = kept_by_estimate(regs[x][None, :], all_[to], np.full(len(to), size[x]), sizes[to], self.similarity)
                for c in np.unique(comps[to[ok]]).tolist():
                    self.forest.join(int(comp[x]), c)

    def pairs(self) -> pa.RecordBatch:
        """Each component with the smallest one that it hangs together with."""
        return pairs_batch([(r, c) for c in list(self.forest.up) if (r := self.forest.root(c)) != c])


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) whose id may be among ids, so that others need not be shuffled.

    A bitmap of hashed ids decides: 16 bits an id, MAX_BITS at most, so the broadcast is bounded. What it lets pass in
    error goes in the join that follows.
    """
    bits = min(MAX_BITS, 1 << max(16, (16 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(bits))
    words = ids.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(doc_id, 9), {bits}), 64) as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bitmap = np.zeros(bits >> 6, np.int64)
    bitmap[words.column("w").to_numpy()] = words.column("m").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def make():
        def act(part: pa.RecordBatch) -> pa.RecordBatch:
            h = part.column(2).to_numpy()
            return part.select(["doc_id", "text"]).filter(pa.array((shared.value[h >> 6] >> (h & 63)) & 1 == 1))

        return act

    return map_rows(docs.filter("doc_id is not null").select("doc_id", "text", at.alias("h")), make, "doc_id long, text string")


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """a, b of those pairs of documents whose full sets have den * intersection >= num * union; with both counts.

    The text of a goes where its pairs are, once for PER_SALT of them, and the texts of the b's pass by it one at a
    time. So a document with very many pairs is dealt over many tasks, and a task holds the sets of one pair.
    """
    num, den = similarity
    spark = pairs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    pairs = pairs.select("a", "b").join(many, "a").select("a", "b", F.pmod(F.xxhash64("b", F.lit(3)), F.ceil(F.col("n") / PER_SALT)).cast("long").alias("salt"))
    texts = texts_of(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    wanted = pairs.select(F.col("b").alias("doc_id"), "a", "salt", "b").union(pairs.select("a", "salt").distinct().select(F.col("a").alias("doc_id"), "a", "salt", F.lit(None).cast("long").alias("b")))
    rows = wanted.join(texts, "doc_id").select("a", "salt", "b", "text").repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        head, of, hashes = None, None, word_hashes()
        for batch in batches:
            for part in slices(batch):
                found = []
                for a, b, raw in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), utf8(part.column(3)), strict=True):
                    s = shingle_set(raw, shingle, hashes)
                    if b is None:
                        head, of = s, a
                        continue
                    assert of == a, "the row of a pair's first document comes first"
                    same = len(np.intersect1d(head, s, assume_unique=True))
                    whole = len(head) + len(s) - same
                    if whole and den * same >= num * whole:
                        found.append((a, b, same, whole))
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in (zip(*found, strict=True) if found else ((),) * 4)], ["a", "b", "inter", "whole"])

    return map_batches(rows, run, "a long, b long, inter long, whole long")


class Postings:
    """Sets by shingle, to intersect one set with all of them at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        everything = np.concatenate(sets)
        order = np.argsort(everything, kind="stable")
        self.owner = owner[order]
        self.values, first = np.unique(everything[order], return_index=True)
        self.first = np.append(first, len(order))

    def intersections(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.values, s)
        at[at == len(self.values)] = 0
        at = at[self.values[at] == s]
        many = self.first[at + 1] - self.first[at]
        places = np.arange(int(many.sum())) + np.repeat(self.first[at] - (np.cumsum(many) - many), many)
        return np.bincount(self.owner[places], minlength=len(self.sizes))


def lists(column: pa.Array) -> list[np.ndarray]:
    """The sets in a column of arrays."""
    values, ends = column.flatten().to_numpy().astype(np.uint64), np.cumsum([0, *(n or 0 for n in column.value_lengths().to_pylist())])
    return [values[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False)]


def full_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, set (sorted hashes) of the documents that are nodes; of a few others as well."""

    def make():
        hashes = word_hashes()

        def act(part: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(raw, shingle, hashes).view(np.int64) for raw in utf8(part.column(1))]
            ends = np.cumsum([0, *map(len, sets)])
            return pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], ["node", "set"])

        return act

    return map_rows(texts_of(docs, nodes.select(F.col("node").alias("doc_id"))), make, "node long, set array<long>")


def prefix_sizes(n: int, similarity: tuple[int, int]) -> list[tuple[int, int, int]]:
    """For a set of n: by pair of size classes, its side (0: lower, 1: higher, 2: one class) and how many first shingles it shows to the other side."""
    num, den = similarity
    if not n:
        return []
    sizes = np.arange(-(-num * n // den), den * n // num + 1)
    classes = np.floor(np.log(sizes) / np.log(SIZE_CLASS) + 1e-9).astype(np.int64)
    mine = int(classes[np.searchsorted(sizes, n)])
    out = []
    for c, at in zip(*np.unique(classes, return_index=True), strict=True):
        common = -(-num * (n + int(sizes[at])) // (num + den))  # that both have, at least, if the partner has its class's least size
        if common <= n:
            side = 2 if c == mine else int(mine > c)
            out.append((min(mine, int(c)) << 32 | max(mine, int(c)), side, n - common + 1))
    return out


def parted(member: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """component, family: families cut where no two sets of different components share a shingle of their prefixes.

    member: family, component, node, set. Any order of shingles that all sets keep to is right; rarity keeps the prefixes
    of what only shares a template apart. It comes from counters that hashes share, so their number is bounded.
    """
    num, den = similarity
    low = np.uint64(COUNTERS - 1)

    def count(batches):
        sums = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in slices(batch):
                np.add(sums, np.bincount((part.column(0).flatten().to_numpy().view(np.uint64) & low).astype(np.int64), minlength=COUNTERS), out=sums)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["at", "n"])

    counts = np.zeros(COUNTERS, np.int64)
    found = map_batches(member.select("set"), count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    shared = member.sparkSession.sparkContext.broadcast(counts)

    def make():
        prefixes: dict[int, list[tuple[int, int, int]]] = {}

        def act(part: pa.RecordBatch) -> pa.RecordBatch | None:
            tokens, pairs, sides, at = [], [], [], []
            for row, s in enumerate(lists(part.column(2))):
                n = len(s)
                if n not in prefixes:
                    prefixes[n] = prefix_sizes(n, similarity)
                order = s[np.lexsort((s, shared.value[(s & low).astype(np.int64)]))].view(np.int64)
                for pair, side, k in prefixes[n]:
                    tokens.append(order[:k])
                    pairs += [pair] * k
                    sides += [side] * k
                    at += [row] * k
            if not tokens:
                return None
            return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(pairs, pa.int64()), pa.array(sides, pa.int32()), pa.array(np.concatenate(tokens))], ["family", "component", "pair", "side", "token"])

        return act

    key = ["family", "pair", "token"]
    tokens = map_rows(member.select("family", "component", "set"), make, "family long, component long, pair long, side int, token long").distinct()
    first = tokens.groupBy(*key).agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("side").alias("low"), F.max("side").alias("high"))
    first = first.filter("least <> most AND (low <> high OR low = 2)").drop("most", "low", "high")  # a side alone has no partners
    edges = tokens.join(first, key).filter("component <> least").select(F.col("least").alias("a"), F.col("component").alias("b")).distinct()
    return components(edges).select(F.col("node").alias("component"), F.col("component").alias("family"))


def blocked(member: DataFrame) -> DataFrame:
    """family, major (its largest component), blocks of families (member: family, component, n_shingles) with several components."""
    shares = member.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    several = shares.groupBy("family").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("k")).filter("k > 1")
    return several.select("family", F.col("top.component").alias("major"), F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))


def family_links(families: DataFrame, classes: DataFrame, comps: DataFrame, docs: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """a, b: links between full sets of different components of a family (families: component, family); per block, a spanning forest.

    What is made on the way stays until the result has been written.
    """
    num, den = similarity
    spark = families.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = classes.select("node", "n_shingles").join(comps, "node", "left").select("node", "n_shingles", F.coalesce("component", "node").alias("component"))
    member = known.join(families, "component")
    sets = stored(full_sets(docs, member.select("node"), shingle).dropDuplicates(["node"]), "sets")
    # What fits into one block is compared there at once; prefixes part what doesn't.
    large = stored(blocked(member).filter("blocks > 1").select("family"), "large")
    used = [sets, large]
    if not large.isEmpty():
        used.append(parted(member.join(large, "family", "left_semi").join(sets, "node").select("family", "component", "node", "set"), similarity))
        member = known.join(families.join(large, "family", "left_anti").unionByName(used[-1]), "component")
    rows = dealt(member.drop("n_shingles"), "family", blocked(member)).join(sets, "node").select("family", "block", "probe", "node", "component", "is_major", "set")
    rows = rows.repartition(n, "family", "block").sortWithinPartitions("family", "block", "probe")

    def run(batches):
        of, home, sets, postings, forest = None, [], [], None, Forest()
        for batch in batches:
            for part in slices(batch):
                links = []
                for family, block, probe, node, comp, s in zip(*(part.column(k).to_pylist() for k in range(5)), lists(part.column(6)), strict=True):
                    if (family, block) != of:
                        of, home, sets, postings, forest = (family, block), [], [], None, Forest()
                    if not probe:
                        home.append((node, comp))
                        sets.append(s)
                        continue
                    if not sets:
                        continue  # no class of the family lives in this block
                    postings = postings or Postings(sets)
                    same = postings.intersections(s)
                    for k in np.flatnonzero(den * same >= num * (postings.sizes + len(s) - same)).tolist():
                        if forest.join(comp, home[k][1]):
                            links.append((node, home[k][0]))
                if links:
                    yield pairs_batch(links)

    out = stored(map_batches(rows, run, "a long, b long"), "links")
    for one in used:
        dropped(one)
    return out


def near_links(classes: DataFrame, docs: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """node, component of all classes that are linked with another (steps 2 to 5). Tables made on the way are deleted."""
    share = similarity[0] / similarity[1]
    used: list[DataFrame] = []

    def keep(df: DataFrame, what: str) -> DataFrame:
        used.append(stored(df, what))
        return used[-1]

    buckets = keep(shared_buckets(classes), "buckets")
    first = estimated(best_leader(buckets), classes, share)
    links = keep(confirmed(keep(first, "pairs"), docs, shingle, similarity).select("a", "b"), "links")
    comps = components(links)
    weak = keep(weak_links(buckets, classes, comps, share), "weak")
    if not weak.isEmpty():
        families = components(weak).select(F.col("node").alias("component"), F.col("component").alias("family"))
        late = family_links(families, classes, comps, docs, shingle, similarity)
        used += [families, late]
        if not late.isEmpty():
            used.append(comps)
            comps = components(links.union(late))
    for one in used:
        dropped(one)
    return comps


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id) per row of docs.

    similarity is a fraction: documents are linked if den * intersection >= num * union of their shingle sets. A null or
    empty text, or one without words, has an empty set and is linked with nothing. Ids should be unique: rows that share
    an id share a node, and a row with a null id is its own, kept and linked with nothing. Other columns are ignored; an
    empty table gives an empty one.
    """
    rows = id_text(docs, id_col, text_col)
    sketch = stored(sketches(rows, shingle), "sketches")
    classes = sketch.filter("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    classes = stored(classes, "classes")
    comps = near_links(classes, rows, shingle, similarity)
    key = lambda c: F.coalesce(c, F.encode(F.concat(F.lit("-"), F.col("doc_id").cast("string")), "utf-8"))  # noqa: E731  empty sets must not meet in one task
    named = classes.select("class", F.col("node")).join(comps, "node", "left").select(F.col("class").alias("_class"), F.coalesce("component", "node").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles", "class").join(named, key(F.col("class")) == F.col("_class"), "left")
    same = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", same.alias("component_id"), F.coalesce(F.col("doc_id") == same, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the smallest id of each group of near duplicates, all columns as they were, whatever their names.

    Rows that repeat a kept id all stay, as do rows with a null id and null, empty or wordless texts. Texts of any length
    are compared as a whole. A tie in similarity (just at the threshold) is a link. An empty table stays empty.
    """
    name = free("_gone", docs.columns)
    gone = near_duplicates(docs, shingle, similarity, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    gone = stored(gone, "gone")  # its size is known before the join: texts needn't be shuffled if it is small
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")


#: DuckDB: exact similarity of all pairs of different sets that share a shingle, and components by recursion.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_sort(list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] FOR i IN range(1, len(ws) - 2)])) END AS sh FROM w),
h AS (SELECT doc_id, sh, len(sh) AS n, CASE WHEN len(sh) > 0 THEN md5(array_to_string(sh, chr(10))) END AS c FROM s),
k AS (SELECT c, min(doc_id) AS node, any_value(sh) AS sh, any_value(n) AS n FROM h WHERE c IS NOT NULL GROUP BY c),
e AS (SELECT node, n, unnest(sh) AS g FROM k),
f AS (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM e),
p AS (SELECT x.node AS a, y.node AS b FROM f x JOIN f y ON x.g = y.g AND x.node <> y.node WHERE x.m > 1 AND y.m > 1
      GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT node AS a, node AS b FROM k UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
l AS (SELECT a, min(b) AS component FROM r GROUP BY a)
SELECT doc_id, h.n::BIGINT AS n_shingles, coalesce(l.component, doc_id) AS component_id, doc_id = coalesce(l.component, doc_id) AS kept
FROM h LEFT JOIN k USING (c) LEFT JOIN l ON k.node = l.a
"""
