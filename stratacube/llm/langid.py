"""Language identification: averaged hashed subword embeddings under a linear softmax, trained here by SGD in numpy.

A word is the mean of the embeddings of its subwords (runs of 2 to 4 characters, word ends marked, hashed into
BUCKETS); a text is the mean of its words, over the whole text. The softmax over languages is linear in that mean, so
after training each bucket's embedding is folded into one score per language, and a task keeps the scores of the words it
has met. A temperature fitted on rows held out makes the score a calibrated probability.

A text is rejected if too few of its subwords are known, or if its probability is too low. Which subwords are known is
kept apart from the buckets, by 64-bit hashes, so it doesn't fill up as the sample grows. Both bounds are chosen between
held-out rows (whole, their first few words, two languages mixed) and noise made from them (letters shuffled, letters
exchanged for each other, a script that training hasn't seen).

Rows are held out by folds: a fifth at a time is scored by a model of the other four, until CALIBRATION_ROWS have been
scored or all have. So a table of any size is calibrated by the same rule; the model itself learns from all rows.

Training takes a bounded sample of rows (TRAIN_ROWS, or EACH of each language if that is more), and whole texts of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacube.llm.common import map_batches, map_rows, release, slices

BUCKETS, DIM, SIZES = 1 << 15, 16, (2, 3, 4)
#: Bounds of the training sample: rows in all, dealt evenly over the languages; rows of a language that it may have anyway.
TRAIN_ROWS, EACH = 4_000, 20
#: Folds, and rows that are held out before no further fold is.
FOLDS, CALIBRATION_ROWS = 5, 200
#: Passes over the sample, or more until there are LEAST_STEPS steps.
EPOCHS, LEAST_STEPS, RATE, BATCH, COLUMNS = 6, 400, 4.0, 64, 256
#: The bound of the probability where calibration leaves it open.
REJECT_BELOW = 0.35
#: A wrong rejection counts as much as so many kinds of noise kept; words of the short known texts; rows that noise is made from.
REJECT_COST, PIECES, NOISE_ROWS = 20, (3, 8), 400
#: Bounds of a task's cache: numbers in its table, characters of its words. Words and characters that are looked at together.
CACHE_CELLS, CACHE_CHARS, TOGETHER, BLOCK = 1_000_000, 4_000_000, 20_000, 1 << 18
UND = "und"

LETTERS = regex.compile(r"\p{L}+")


def words(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return LETTERS.findall(text.lower())


def blocks(ws: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The 64-bit hashes of all subwords of the words and whose they are, in blocks of bounded size whatever the words' lengths."""
    chars = np.frombuffer("".join(f"<{w}>" for w in ws).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, ws), np.int64, len(ws)) + 2
    ends = np.cumsum(sizes)
    for lo in range(0, len(chars), BLOCK):
        hi = min(lo + BLOCK, len(chars))
        word = np.searchsorted(ends, np.arange(lo, hi), "right")
        left = ends[word] - np.arange(lo, hi)
        part = chars[lo : hi + max(SIZES)].astype(np.uint64)
        for n in SIZES:
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = (h ^ part[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            if len(at):
                yield h, word[at]


def buckets(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(17)) % np.uint64(BUCKETS)).astype(np.int64)


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are among those of a sorted array."""
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.searchsorted(of, values)
    at[at == len(of)] = 0
    return of[at] == values


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # [BUCKETS, languages]: embedding times softmax weights
    bias: np.ndarray
    known: np.ndarray  # sorted hashes of the subwords seen in training
    temperature: float = 1.0
    reject_below: float = 0.0
    familiar: float = 0.0

    def word_scores(self, ws: list[str]) -> np.ndarray:
        """Per word the mean score of its subwords, and in the last column the share of them seen in training."""
        out, n = np.zeros((len(ws), len(self.langs) + 1), np.float32), np.zeros(len(ws), np.int64)
        for h, word in blocks(ws):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first], :-1] += np.add.reduceat(self.scores[buckets(h)], first, axis=0)
            out[word[first], -1] += np.add.reduceat(member(h, self.known).astype(np.float32), first)
            n += np.bincount(word, minlength=len(ws))
        return out / n[:, None]

    def text_means(self, texts: list[list[str]]) -> np.ndarray:
        """Of texts as lists of words: the means over their words."""
        return np.stack([self.word_scores(ws).mean(axis=0, dtype=np.float64) for ws in texts]) if texts else np.zeros((0, len(self.langs) + 1))

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return softmax((logits + self.bias) / self.temperature)


def _bag(ws: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and weights (adding up to 1) of a text's words, and the hashes of its subwords."""
    all_ = list(blocks(ws))
    h, word = (np.concatenate([x[k] for x in all_]) for k in (0, 1))
    weight = (1.0 / (np.bincount(word, minlength=len(ws)) * len(ws)))[word]
    at, where = np.unique(buckets(h), return_inverse=True)
    return at, np.bincount(where, weight).astype(np.float32), np.unique(h)


def noise(texts: list[list[str]], rng: np.random.Generator) -> list[list[str]]:
    """Three texts in no language from each: letters shuffled over the text, exchanged for each other, of an unseen script."""
    letters = sorted(set("".join("".join(ws) for ws in texts)))
    unseen = {ord(c): chr(0xF0000 + i) for i, c in enumerate(letters)}
    out = []
    for ws in texts:
        ends = np.cumsum([len(w) for w in ws]).tolist()
        all_ = "".join(ws)
        shuffled = "".join(all_[i] for i in rng.permutation(len(all_)))
        own = sorted(set(all_))
        other = {ord(c): own[k] for c, k in zip(own, rng.permutation(len(own)), strict=True)}
        out += [[shuffled[a:z] for a, z in zip([0, *ends], ends, strict=False)], [w.translate(other) for w in ws], [w.translate(unseen) for w in ws]]
    return out


def between(good: np.ndarray, bad: np.ndarray, of: int) -> tuple[float, float]:
    """The range of bounds that cost least, if good ones below cost REJECT_COST and bad ones (of ``of``) not below cost 1."""
    cuts = np.unique(np.concatenate([[0.0], good, bad, [1.0]]))
    cost = REJECT_COST * np.searchsorted(np.sort(good), cuts) / len(good) + (len(bad) - np.searchsorted(np.sort(bad), cuts)) / of
    best = int(cost.argmin())
    least = cuts[best - 1] if best else 0.0  # any bound above the cut before costs the same
    upto = cuts[np.flatnonzero(np.isclose(cost, cost[best]))].max()
    return float(least), float(upto)


def fitted(bags: list[tuple], y: np.ndarray, fit: np.ndarray, langs: list[str], rng: np.random.Generator) -> Model:
    """Fit on some of the rows, given as bags and places of their languages."""
    k, fit = len(langs), fit.copy()
    known = np.zeros(0, np.uint64)
    for lo in range(0, len(fit), 256):
        known = np.unique(np.concatenate([known, *(bags[i][2] for i in fit[lo : lo + 256])]))
    # Only buckets in use have an embedding. They lie in blocks, so that each product is too small for BLAS to start threads.
    used = np.unique(buckets(known))
    at = {i: np.searchsorted(used, bags[i][0]) for i in fit.tolist()}
    emb = rng.normal(0, 0.1, (-(-len(used) // COLUMNS), COLUMNS, DIM)).astype(np.float32)
    x, change = np.zeros((len(emb), BATCH, COLUMNS), np.float32), np.empty_like(emb)
    w, b = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    share = np.bincount(y[fit], minlength=k) / max(len(fit), 1)
    a_pass = max(1, -(-len(fit) // BATCH))
    epochs = max(EPOCHS, -(-LEAST_STEPS // a_pass))
    steps, done = epochs * a_pass, 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for lo in range(0, len(fit), BATCH):
            batch = fit[lo : lo + BATCH]
            x[:] = 0
            for row, i in enumerate(batch.tolist()):
                x[at[i] // COLUMNS, row, at[i] % COLUMNS] = bags[i][1]
            bag = x[:, : len(batch)]
            h = (bag @ emb).sum(axis=0)
            p = softmax(h @ w + b)
            p[np.arange(len(batch)), y[batch]] -= 1
            p *= (1 / np.maximum(share[y[batch]] * k, 1e-6))[:, None] / len(batch)
            p = p.astype(np.float32)
            rate = np.float32(RATE * (1 - done / steps))
            gh = rate * DIM * (p @ w.T)
            w -= rate * (h.T @ p)
            b -= rate * p.sum(axis=0)
            np.matmul(bag.transpose(0, 2, 1), gh, out=change)
            emb -= change
            done += 1
    scores = np.zeros((BUCKETS, k), np.float32)
    scores[used] = emb.reshape(-1, DIM)[: len(used)] @ w
    return Model(langs, scores, b, known)


def train(rows: list[tuple[str, str]], seed: int = 1) -> Model:
    """Fit on (language, words joined by spaces) of all rows; temperature and bounds are from rows that models of other rows have scored."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, _ in rows})
    place = {lang: i for i, lang in enumerate(langs)}
    bags = [_bag(text.split(" ")) for _, text in rows]
    y = np.array([place[lang] for lang, _ in rows])
    model = fitted(bags, y, np.arange(len(rows)), langs, rng)
    order, seen = rng.permutation(len(rows)), 0
    logits: list[np.ndarray] = []  # of rows held out: whole, in pieces and mixed; then of noise
    shares: list[np.ndarray] = []
    right: list[tuple[np.ndarray, np.ndarray]] = []
    bad_logits: list[np.ndarray] = []
    bad_shares: list[np.ndarray] = []
    for k in range(FOLDS):
        aside = order[k::FOLDS]
        rest = np.setdiff1d(order, aside)
        if seen >= CALIBRATION_ROWS or not len(aside) or not len(rest):
            break
        seen += len(aside)
        other = fitted(bags, y, rest, langs, rng)
        texts = [rows[i][1].split(" ") for i in aside]
        whole = other.text_means(texts)
        right.append((whole[:, :-1] + other.bias, y[aside]))
        good = other.text_means([ws[:n] for ws in texts for n in PIECES] + mixtures([(rows[i][0], ws) for i, ws in zip(aside, texts, strict=True)]))
        bad = other.text_means(noise([texts[i] for i in rng.permutation(len(texts))[:NOISE_ROWS]], rng))
        for means, into, share in ((np.concatenate([whole, good]), logits, shares), (bad, bad_logits, bad_shares)):
            into.append(means[:, :-1] + other.bias)
            share.append(means[:, -1])
    if not right:
        return model  # a single row: nothing to calibrate by, so nothing is rejected but texts without letters
    z, truth = (np.concatenate(x) for x in zip(*right, strict=True))
    model.temperature = min(np.geomspace(0.05, 20, 60).tolist(), key=lambda t: float(-np.log(np.maximum(softmax(z / t)[np.arange(len(z)), truth], 1e-12)).mean()))
    good, bad = np.concatenate(shares), np.concatenate(bad_shares)
    p, bad_p = (softmax(np.concatenate(x) / model.temperature).max(axis=1) for x in (logits, bad_logits))
    model.familiar = float(np.mean(between(good, bad, len(bad))))
    if len(kept := p[good >= model.familiar]):
        least, upto = between(kept, bad_p[bad >= model.familiar], len(bad))
        model.reject_below = float(np.clip(REJECT_BELOW, least, upto))
    return model


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def mixtures(rows: list[tuple[str, list[str]]]) -> list[list[str]]:
    """Texts of two languages: each row after as many words of the last row of another one, as many as there are rows at most."""
    first: dict[str, list[str]] = {}
    out: list[list[str]] = []
    for lang, ws in rows:
        out += [ws[: len(x)] + x[: len(ws)] for other, x in first.items() if other != lang][: max(0, len(rows) - len(out))]
        first[lang] = ws
    return out


def learnable(id_col: str = "doc_id") -> Column:
    """Whether a row may be learnt from: the CRC-32 of its id as text, mod 5, is not 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 0, F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = TRAIN_ROWS) -> list[tuple[str, str]]:
    """Whole texts, as words joined by spaces, of at most max(rows, EACH for each language) labelled rows, evenly over the languages."""
    pool = docs.filter(learnable(id_col) & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in pool.groupBy("lang").count().collect()}  # as many as there are languages
    if not counts:
        return []
    each = max(EACH, rows // len(counts))
    picked = pool.sampleBy("lang", {lang: min(1.0, 1.2 * each / n + 10 / n) for lang, n in counts.items()}, seed=11)

    def split(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array([" ".join(words(text or "")) for text in part.column(0).to_pylist()], pa.string()), part.column(1)], ["text", "lang"])

    left, out = dict.fromkeys(counts, each), []
    for r in map_batches(picked, split, "text string, lang string").filter("text <> ''").toLocalIterator(prefetchPartitions=True):
        if left[r["lang"]] > 0:
            left[r["lang"]] -= 1
            out.append((r["lang"], r["text"]))
    return sorted(out)


class Scorer:
    """Scores whole texts with a task's cache of word scores, which goes with the task."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self):
        self.number: dict[str, int] = {}
        self.chars = 0
        self.table = np.zeros((1024, len(self.model.langs) + 1), np.float32)

    def sums(self, lists: list[list[str]]) -> list[np.ndarray]:
        """The sums of the scores of each list's words."""
        if len(self.number) * self.table.shape[1] > CACHE_CELLS or self.chars > CACHE_CHARS:
            self.clear()
        if new := list(set().union(*lists).difference(self.number)):
            at = len(self.number)
            if at + len(new) > len(self.table):
                grown = np.zeros((2 * (at + len(new)), self.table.shape[1]), np.float32)
                grown[:at] = self.table[:at]
                self.table = grown
            for lo in range(0, len(new), 8_000):
                self.table[at + lo : at + min(lo + 8_000, len(new))] = self.model.word_scores(new[lo : lo + 8_000])
            self.number.update(zip(new, range(at, at + len(new)), strict=True))
            self.chars += sum(map(len, new))
        get = self.number.__getitem__
        return [self.table[np.fromiter(map(get, ws), np.int64, len(ws))].sum(axis=0, dtype=np.float64) for ws in lists]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, calibrated probability, whether it is rejected; und, 0 and rejected for a text without letters."""
        lists = [words(t) if t else [] for t in texts]
        sums = [np.zeros(len(self.model.langs) + 1) for _ in lists]
        todo, size = [], 0  # parts of texts, TOGETHER words at a time
        for i, ws in enumerate(lists if self.model.langs else []):
            for lo in range(0, len(ws), TOGETHER):
                todo.append((i, ws[lo : lo + TOGETHER]))
                size += len(todo[-1][1])
                if size >= TOGETHER:
                    self._add(sums, todo)
                    todo, size = [], 0
        self._add(sums, todo)
        out: list[tuple[str, float, bool]] = []
        for ws, total in zip(lists, sums, strict=True):
            if not ws or not self.model.langs:
                out.append((UND, 0.0, True))
                continue
            mean = total / len(ws)
            p = self.model.probabilities(mean[:-1])
            best = int(p.argmax())
            out.append((self.model.langs[best], float(p[best]), bool(p[best] < self.model.reject_below or mean[-1] < self.model.familiar)))
        return out

    def _add(self, sums: list[np.ndarray], todo: list[tuple[int, list[str]]]) -> None:
        if todo:
            for (i, _), part in zip(todo, self.sums([ws for _, ws in todo]), strict=True):
                sums[i] += part


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """A model of the labelled rows of docs that may be learnt from; without any, one that rejects everything.

    Rows with a null language, id or text, or a text without letters, teach nothing. Repeated rows count as often as they
    are there. Whole texts of the sampled rows are learnt.
    """
    found = sample(docs, id_col, text_col, lang_col, rows)
    try:
        return train(found) if found else Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), np.zeros(0, np.uint64))
    finally:
        release()


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row, from the whole text alone.

    A null text, or one without a letter, is 'und' with score 0 and rejected, as is every text under a model without
    languages. Whole texts of any length are scored, in parts of bounded size. Ties go to the language that sorts first. A
    null id counts as held out. Repeated rows give repeated results, an empty table an empty one; other columns are ignored,
    whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (~learnable(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def make():
        s = Scorer(shared.value)

        def act(part: pa.RecordBatch) -> pa.RecordBatch:
            found = s.predict(part.column(2).to_pylist())
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

        return act

    return map_rows(rows, make, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, all columns as they were, whatever their names.

    Null and empty texts, those without a letter, and all texts under a model without languages go. Of long texts the
    whole is judged. Equal texts have one fate, so repeated rows stay or go together; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def make():
        s = Scorer(shared.value)
        return lambda part: part.filter(pa.array([not x[2] for x in s.predict(part.column(at).to_pylist())], pa.bool_()))

    return map_rows(docs, make, docs.schema)
