"""Document fingerprints by a randomised edit embedding.

All texts take the same random walk: at step t the walk shows the character it is at, and a random bit of (t, character)
says whether it goes on to the next one. Texts that differ by few edits fall back into step after each, so the edit
distance of texts becomes the Hamming distance of what they show. A fingerprint keeps a sample of the shown characters,
four bits of each. The samples are nested: level l has the steps whose hash ends in l zero bits; a text takes the first
level at which it shows at most SAMPLES, and fingerprints of different levels meet at the coarser one.

Candidates for near copies come from banding: a band is what a text shows at WIDTH steps in a row, 4 * WIDTH bits, as
edits put texts out of step for a while, not here and there. Bands begin at steps that a hash samples, nested like the
others; a text takes the first level that gives it at most BANDS. Two texts meet in a band if they show the same in it.
Every two texts that meet are verified by the edit distance of their whole texts, refuted by a bound on it (lengths,
counts of hashed runs of three characters), or in one component already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacube.llm.common import id_text, map_batches, map_rows, slices, stored
from stratacube.llm.components import components
from stratacube.llm.minhash import BLOCK, Forest, dealt, groups, mixed, pairs_batch, texts_of

SAMPLES, BANDS, WIDTH = 256, 64, 20
#: Steps after which the walk's random bits repeat, and classes of characters that share them.
PERIOD, CLASSES = 8192, 256
#: Two sampled symbols are equal by chance this often.
CHANCE = 1 / 16
#: Counts of a text's profile, characters in a run; characters of the texts in one block of the last verification.
PROFILE, RUN, BLOCK_CHARS = 512, 3, 4_000_000
#: Texts walked at once: characters, rows. With fewer than TOGETHER left, each goes on by itself, which is faster then.
BATCH_CHARS, BATCH_ROWS, TOGETHER = 2_500_000, 2_048, 64


def _stays() -> np.ndarray:
    """[CLASSES * PERIOD]: for how many steps the walk stays at a character of the class that it reaches at a step."""
    t = np.arange(CLASSES * PERIOD, dtype=np.uint64)
    goes = ((mixed(t + np.uint64(1)) >> np.uint64(40)) & np.uint64(1)).astype(bool).reshape(CLASSES, PERIOD)
    goes[~goes.any(axis=1), 0] = True
    out = np.zeros((CLASSES, PERIOD), np.int32)
    away = np.argmax(goes, axis=1).astype(np.int32) + 1
    for j in range(PERIOD - 1, -1, -1):
        away = np.where(goes[:, j], 1, away + 1).astype(np.int32)
        out[:, j] = away
    return out.reshape(-1)


def _by_character(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(codes.astype(np.uint64) + np.uint64(0x51ED27))
    return ((h >> np.uint64(8)) % np.uint64(CLASSES)).astype(np.int32) * PERIOD, ((h >> np.uint64(32)) & np.uint64(15)).astype(np.uint8)


class Levels:
    """The sampled steps of each level, and those at which bands begin, as far as they have been asked for."""

    def __init__(self):
        self.upto = 0
        self.reach(1 << 15)

    def reach(self, end: int) -> None:
        if end <= self.upto:
            return
        self.upto = max(end, 2 * self.upto)
        h = mixed(np.arange(self.upto, dtype=np.uint64) + np.uint64(0xABCDEF))
        self.steps = [np.arange(self.upto, dtype=np.int32)]
        level = 1
        while len(self.steps[-1]) > 1:
            low = np.uint64((1 << level) - 1)
            self.steps.append(self.steps[-1][(h[self.steps[-1]] & low) == 0])
            level += 1
        h = mixed(h)
        self.starts = [np.arange(self.upto, dtype=np.int32)]
        while len(self.starts[-1]) > 1:
            low = np.uint64((1 << len(self.starts)) - 1)
            self.starts.append(self.starts[-1][(h[self.starts[-1]] & low) == 0])

    def count(self, level: int, end: int) -> int:
        """How many steps of the level are before end."""
        self.reach(end)
        return int(np.searchsorted(self.steps[level], end)) if level < len(self.steps) else 0

    def bands(self, end: int) -> np.ndarray:
        """Where the bands of a walk begin that has so many steps: the first level with at most BANDS that fit in."""
        self.reach(end)
        for starts in self.starts:
            n = int(np.searchsorted(starts, end - WIDTH, "right"))
            if n <= BANDS:
                return starts[:n]
        return self.starts[-1][:0]

    def level_of(self, end: int) -> int:
        self.reach(end)
        level = 0
        while self.count(level, end) > SAMPLES:
            level += 1
        return level


class Embedding:
    def __init__(self):
        self.stays = _stays()
        self.stays_list: list[int] | None = None
        self.classes, self.symbols = _by_character(np.arange(1 << 16))
        self.levels = Levels()

    def characters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes and symbols of all characters, each text's first, each text's length."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(codes) and codes.max() >= 1 << 16:
            classes, symbols = _by_character(codes)
        else:
            classes, symbols = self.classes[codes], self.symbols[codes]
        return classes, symbols, np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64), lens

    def walk(self, classes: np.ndarray, first: np.ndarray, lens: np.ndarray, since: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The step at which each character is reached, and each text's end; all texts move on together."""
        order = np.argsort(-lens, kind="stable")
        n, at, step = lens[order], first[order].copy(), since[order].astype(np.int32)
        reached = np.zeros(len(classes), np.int32)
        active = int(np.searchsorted(-n, 0))  # those with a character
        a, b, c = (np.empty(len(n), np.int32) for _ in range(3))
        stays, mask = self.stays, np.int32(PERIOD - 1)
        i = 0
        while active >= TOGETHER:
            upto = int(n[active - 1])
            p, s, x, y = at[:active], step[:active], a[:active], b[:active]
            for _ in range(upto - i):
                reached[p] = s
                np.take(classes, p, out=x, mode="clip")
                np.bitwise_and(s, mask, out=y)
                np.add(x, y, out=x)
                np.take(stays, x, out=y, mode="clip")
                np.add(s, y, out=s)
                np.add(p, 1, out=p)
            i = upto
            active = int(np.searchsorted(-n, -i))
        if active and self.stays_list is None:
            self.stays_list = stays.tolist()
        for k in range(active):  # few long texts are left: each by itself
            a, z = int(at[k]), int(first[order[k]] + n[k])
            reached[a:z], step[k] = self.walk_on(classes[a:z], int(step[k]))
        end = np.empty(len(n), np.int64)
        end[order] = step
        return reached, end

    def walk_on(self, classes: np.ndarray, step: int) -> tuple[list[int], int]:
        """walk() for the rest of one text."""
        stays, mask, out = self.stays_list, PERIOD - 1, []
        put = out.append
        for c in classes.tolist():
            put(step)
            step += stays[c + (step & mask)]
        return out, step

    def sample(self, reached: np.ndarray, symbols: np.ndarray, end: int) -> tuple[int, int, np.ndarray]:
        """level, end and the symbols shown at the level's steps, of a text's characters."""
        level = self.levels.level_of(end)
        steps = self.levels.steps[level][: self.levels.count(level, end)]
        return level, end, symbols[np.searchsorted(reached, steps, "right") - 1] if len(steps) else symbols[:0]

    def likeness(self, x: tuple, y: tuple) -> float:
        """1 for equal fingerprints; the share of equal symbols, less what chance gives, else."""
        (lx, ex, sx), (ly, ey, sy) = x, y
        if ex == 0 or ey == 0:
            return float(ex == ey)
        level = max(lx, ly)
        sx, sy = self.coarser(sx, lx, ex, level), self.coarser(sy, ly, ey, level)
        most, both = max(len(sx), len(sy)), min(len(sx), len(sy))
        if not most:
            return float(ex == ey)
        share = float((sx[:both] == sy[:both]).sum()) / most
        return max(0.0, (share - CHANCE) / (1 - CHANCE))

    def coarser(self, symbols: np.ndarray, level: int, end: int, to: int) -> np.ndarray:
        if to == level:
            return symbols
        steps = self.levels.steps[to][: self.levels.count(to, end)]
        return symbols[np.searchsorted(self.levels.steps[level], steps)]

    def bands(self, reached: np.ndarray, symbols: np.ndarray, end: int) -> np.ndarray:
        """Keys of the bands of a text's characters. They name the step, not the level, so texts of two levels meet in what they share."""
        starts = self.levels.bands(end)
        steps = (starts[:, None] + np.arange(WIDTH)).reshape(-1)
        shown = symbols[np.searchsorted(reached, steps, "right") - 1].reshape(-1, WIDTH) if len(steps) else np.zeros((0, WIDTH), np.uint8)
        return mixed(((shown.astype(np.uint64) + np.uint64(1)) * _BY_PLACE).sum(axis=1, dtype=np.uint64) ^ mixed(starts.astype(np.uint64) + np.uint64(1))).astype(np.int64)


#: A factor for each step of a band.
_BY_PLACE = mixed(np.arange(1, WIDTH + 1, dtype=np.uint64)) | np.uint64(1)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def written(f: tuple) -> str:
    return f"{f[0]}:{f[1]}:{_HEX[f[2]].tobytes().decode()}"


def read(fingerprint: str) -> tuple[int, int, np.ndarray]:
    level, end, symbols = fingerprint.split(":")
    return int(level), int(end), np.array([int(c, 16) for c in symbols], np.uint8)


_embedding: list[Embedding] = []


def embedding() -> Embedding:
    if not _embedding:
        _embedding.append(Embedding())
    return _embedding[0]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(e: Embedding, ids: list[int | None], texts: list[str], emit: int) -> Iterator[pa.RecordBatch]:
    """Results of the first ``emit`` texts; the text after each is its next."""
    classes, symbols, first, lens = e.characters(texts)
    reached, end = e.walk(classes, first, lens, np.zeros(len(texts), np.int64))
    f = [e.sample(reached[a : a + n], symbols[a : a + n], int(z)) for a, n, z in zip(first.tolist(), lens.tolist(), end.tolist(), strict=True)]
    cuts = [len(t) - len(t) // 2 for t in texts[:emit]]
    tails = [texts[i + 1][: len(texts[i]) // 2] for i in range(emit)]
    classes2, symbols2, first2, lens2 = e.characters(tails)
    since = np.array([reached[a + c] if c < n else z for a, c, n, z in zip(first.tolist(), cuts, lens.tolist(), end.tolist(), strict=False)], np.int64)
    reached2, end2 = e.walk(classes2, first2, lens2, since)
    out = []
    for i in range(emit):
        a, c, b, m = int(first[i]), cuts[i], int(first2[i]), int(lens2[i])
        edited = e.sample(np.concatenate([reached[a : a + c], reached2[b : b + m]]), np.concatenate([symbols[a : a + c], symbols2[b : b + m]]), int(end2[i]))
        digest = hashlib.sha256((texts[i][:c] + tails[i]).encode("utf-8", "surrogatepass")).hexdigest()
        out.append((ids[i], len(texts[i]), digest, written(f[i]), written(edited), e.likeness(f[i], edited), e.likeness(f[i], f[i + 1])))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, tail, doc_id, text) in their order; a bucket ends with the text that follows it."""
    e = embedding()
    ids: list[int | None] = []
    texts: list[str] = []
    of, size, closed = None, 0, False
    for batch in batches:
        for part in slices(batch):
            for bucket, tail, doc, text in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                if bucket != of:
                    of, closed = bucket, False
                    assert not ids, "each bucket ends with a tail row"
                if closed:
                    continue  # another row of the same id as the tail
                ids.append(doc)
                texts.append(text or "")
                size += len(texts[-1])
                if tail or size >= BATCH_CHARS or len(ids) >= BATCH_ROWS:
                    if len(ids) > 1:
                        yield from _rows(e, ids, texts, len(ids) - 1)
                    ids, texts, closed = ([], [], True) if tail else (ids[-1:], texts[-1:], False)
                    size = sum(map(len, texts))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: SCHEMA, of the whole text and of the edited text.

    The edited text has its last n_chars // 2 code points replaced by the first as many (or all) of the next document in
    descending id; after the last comes the first. Rows with one id follow each other in the order of their texts, null
    texts (they count as empty) first; null ids come last of all. Two empty texts are alike (1), an empty and another one
    not (0). Other columns are ignored; an empty table gives an empty one.

    The ids are cut into ranges of about equal counts; each range's texts meet, sorted, in one task that streams over
    them. The first row of each range goes to the range before it as well. So texts are shuffled once, and what comes to
    the driver is one id per range.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * n
    cuts = rows.select("doc_id").filter("doc_id is not null").approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.1 / ranges)
    edges = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        known = np.searchsorted(edges, ids.fillna(-(2**63)).to_numpy(np.int64), "left")
        return pd.Series((len(edges) - known).astype(np.int32)).where(ids.notna().to_numpy(), len(edges) + 1)

    ids = rows.select("doc_id").withColumn("bucket", bucket("doc_id"))
    heads = sorted((r["bucket"], r["id"]) for r in ids.groupBy("bucket").agg(F.max("doc_id").alias("id")).collect())  # at most one per range
    placed = rows.withColumn("bucket", bucket("doc_id"))
    tails = [(a, b[1]) for (a, _), b in zip(heads, heads[1:] + heads[:1], strict=True)]
    follow = spark.createDataFrame(tails, "to int, head long")
    ends = rows.join(F.broadcast(follow), F.col("doc_id").eqNullSafe(F.col("head"))).select(F.col("to").alias("bucket"), F.lit(1).alias("tail"), "doc_id", "text")
    spread = placed.select("bucket", F.lit(0).alias("tail"), "doc_id", "text").unionByName(ends).repartition(n, "bucket")
    return map_batches(spread.sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text")), _stream, SCHEMA)


def banded(rows: DataFrame) -> DataFrame:
    """node, n_chars, profile, bands of each row (doc_id, text), without a shuffle."""

    def make():
        e = embedding()

        def act(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column(1).to_pylist()
            bands, lo = [], 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BATCH_CHARS):
                    size += len(texts[hi])
                    hi += 1
                classes, symbols, first, lens = e.characters(texts[lo:hi])
                reached, end = e.walk(classes, first, lens, np.zeros(hi - lo, np.int64))
                bands += [e.bands(reached[a : a + n], symbols[a : a + n], int(z)) for a, n, z in zip(first.tolist(), lens.tolist(), end.tolist(), strict=True)]
                lo = hi
            ends = np.cumsum([0, *map(len, bands)])
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands)))
            return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([profile(t) for t in texts], pa.binary()), keys], ["node", "n_chars", "profile", "bands"])

        return act

    return map_rows(rows, make, "node long, n_chars long, profile binary, bands array<long>")


def profile(text: str) -> bytes:
    """How often the text's runs of RUN characters have each of PROFILE hashes, 255 at most."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(codes) - RUN + 1)
    h = np.zeros(n, np.uint64)
    for k in range(RUN):
        h = mixed(h + codes[k : k + n] + np.uint64(1))
    return np.minimum(np.bincount((h % np.uint64(PROFILE)).astype(np.int64), minlength=PROFILE), 255).astype(np.uint8).tobytes()


def profiles(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PROFILE).astype(np.int16)


def possible(na: np.ndarray, a: np.ndarray, nb: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Which pairs may be near copies: an edit changes a length by 1 and a profile by 2 * RUN at most, so none is lost."""
    limit = (most * np.maximum(na, nb)).astype(np.int64)
    return (np.abs(na - nb) <= limit) & (np.abs(a - b).sum(axis=-1, dtype=np.int64) <= 2 * RUN * limit)


def distance(a: str, b: str) -> int:
    """The edit distance, by Myers' bit vectors: a column of the table is one number."""
    k = _shared(a, b)  # what both begin and end with costs nothing
    a, b = a[k:], b[k:]
    k = _shared(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not a or not b:
        return max(len(a), len(b))
    m, at = len(a), {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask, last, up, down, out = (1 << m) - 1, 1 << (m - 1), (1 << m) - 1, 0, m
    for c in b:
        same = at.get(c, 0)
        x = (((same & up) + up) ^ up) | same | down
        h, v = down | ~(x | up) & mask, up & x
        if h & last:
            out += 1
        elif v & last:
            out -= 1
        h, v = (h << 1 | 1) & mask, v << 1 & mask
        up, down = v | ~(x | h) & mask, h & x
    return out


def _shared(a: str, b: str) -> int:
    """How many characters both begin with."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        k = (lo + hi + 1) // 2
        lo, hi = (k, hi) if a[lo:k] == b[lo:k] else (lo, k - 1)
    return lo


def are_copies(a: str, b: str, most: float) -> bool:
    limit = int(most * max(len(a), len(b)))
    return abs(len(a) - len(b)) <= limit and distance(a, b) <= limit


def may_be_copies(pairs: DataFrame, nodes: DataFrame, most: float) -> DataFrame:
    """The pairs a, b that possible() leaves; nodes: node, n_chars, profile."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_chars").alias(f"n{c}"), F.col("profile").alias(f"p{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "pa", "nb", "pb")

    def make():
        def act(part: pa.RecordBatch) -> pa.RecordBatch:
            ok = possible(part.column(2).to_numpy(), profiles(part.column(3)), part.column(4).to_numpy(), profiles(part.column(5)), most)
            return part.select(["a", "b"]).filter(pa.array(ok))

        return act

    return map_rows(rows, make, "a long, b long")


def weak_copies(keyed: DataFrame, nodes: DataFrame, comps: DataFrame, most: float) -> DataFrame:
    """a, b: components with texts that share a key and may be copies; per block, each with one it hangs together with."""
    known = nodes.join(comps, "node", "left").select("node", "n_chars", "profile", F.coalesce("component", "node").alias("component"))
    keyed = keyed.join(known.select("node", "component"), "node")
    shares = keyed.groupBy("key", "component").agg(F.count("*").alias("n"))
    several = shares.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("k")).filter("k > 1")
    several = several.select("key", F.col("top.component").alias("major"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = dealt(keyed, "key", several).join(known.drop("component"), "node").select("key", "block", "node", "component", "is_major", "probe", "n_chars", "profile")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for block in groups(batches, 2):
            comp, size = (block.column(c).to_numpy() for c in ("component", "n_chars"))
            probe, major = (block.column(c).to_numpy(zero_copy_only=False) for c in ("probe", "is_major"))
            counts = profiles(block.column("profile").combine_chunks())
            home, forest = np.flatnonzero(~probe), Forest()
            for x in np.flatnonzero(probe).tolist():
                to = home[(comp[home] != comp[x]) & (major[home] | (comp[home] > comp[x]))]
                for c in np.unique(comp[to[possible(size[x], counts[x][None, :], size[to], counts[to], most)]]).tolist():
                    forest.join(int(comp[x]), c)
            found = [(root, c) for c in list(forest.up) if (root := forest.root(c)) != c]
            if found:
                yield pairs_batch(found)

    return map_batches(rows.repartition(n, "key", "block").sortWithinPartitions("key", "block"), run, "a long, b long").distinct()


def late_copies(families: DataFrame, nodes: DataFrame, comps: DataFrame, rows: DataFrame, most: float) -> DataFrame:
    """a, b: verified links between different components of a family (families: component, family); per block, a spanning forest."""
    member = nodes.select("node", "n_chars").join(comps, "node", "left").select("node", "n_chars", F.coalesce("component", "node").alias("component")).join(families, "component")
    shares = member.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("n_chars").alias("s"))
    several = shares.groupBy("family").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("k")).filter("k > 1")
    several = several.select("family", F.col("top.component").alias("major"), F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_CHARS)).cast("int").alias("blocks"))
    wanted = stored(dealt(member.drop("n_chars"), "family", several), "families")
    texts = texts_of(rows, wanted.select(F.col("node").alias("doc_id")).distinct()).distinct().withColumnRenamed("doc_id", "node")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = wanted.join(texts, "node").select("family", "block", "probe", "node", "component", "is_major", "text").repartition(n, "family", "block").sortWithinPartitions("family", "block", "probe")

    def run(batches):
        of, home, forest = None, [], Forest()
        for batch in batches:
            for part in slices(batch):
                links = []
                for family, block, probe, node, comp, major, text in zip(*(part.column(k).to_pylist() for k in range(7)), strict=True):
                    if (family, block) != of:
                        of, home, forest = (family, block), [], Forest()
                    size, counts = np.int64(len(text)), np.frombuffer(profile(text), np.uint8).astype(np.int16)
                    if not probe:
                        home.append((node, comp, major, text, size, counts))
                        continue
                    for other, c, _, t, m, p in home:
                        if forest.root(comp) != forest.root(c) and possible(size, counts, m, p, most) and are_copies(text, t, most):
                            forest.join(comp, c)
                            links.append((node, other))
                if links:
                    yield pairs_batch(links)

    return map_batches(spread, run, "a long, b long")


def near_copies(docs: DataFrame, most: float = 0.05, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """doc_id, class_id: near copies by banded fingerprints, verified by edit distance of at most ``most`` of the longer text.

    Equal texts are one class at once. In each band the class first in a fixed random order leads; the others are
    verified against it, and the verified links' components are the classes. Where a band still holds several
    components, their texts are compared with each other, in blocks of bounded size: what may be copies makes families,
    and in each family all texts of different components are verified. So every two texts that share a band are
    verified, refuted or in one component. A document without copies is its own class. Null and empty texts are copies
    of each other. Ids should be unique; rows with a null id are left out. Whole texts are walked and compared, other
    columns are ignored, an empty table gives an empty one. Copies that share no band are missed (the README has
    figures); every=True gives all texts one band more that all share, so that all pairs are verified or refuted.
    """
    rows = id_text(docs, id_col, text_col).filter("doc_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    classes = rows.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("node"))
    nodes = stored(banded(rows.select("doc_id", "text")).join(classes.select("node"), "node", "left_semi").dropDuplicates(["node"]), "bands")
    keyed = nodes.select("node", F.explode(F.array_append("bands", F.lit(0).cast("long")) if every else F.col("bands")).alias("key"))
    nodes = nodes.drop("bands")
    order = F.struct(F.xxhash64("node").alias("o"), "node")
    leaders = keyed.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("first.node").alias("a"))
    shared = stored(keyed.join(leaders, "key"), "buckets")
    pairs = stored(may_be_copies(shared.filter("a <> node").select("a", F.col("node").alias("b")).distinct(), nodes, most), "pairs")
    texts = stored(texts_of(rows, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()).distinct(), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([are_copies(x, y, most) for x, y in zip(a, b, strict=True)])

    links = stored(both.filter(close("ta", "tb")).select("a", "b"), "links")
    comps = components(links)
    weak = stored(weak_copies(shared.select("key", "node"), nodes, comps, most), "weak")
    if not weak.isEmpty():
        families = components(weak).select(F.col("node").alias("component"), F.col("component").alias("family"))
        late = stored(late_copies(families, nodes, comps, rows, most), "links")
        comps = components(links.union(late))
    named = classes.join(comps, "node", "left").select("sha", F.coalesce("component", "node").alias("class_id"))
    return rows.select("doc_id", F.sha2("text", 256).alias("sha")).join(named, "sha").select("doc_id", "class_id")
