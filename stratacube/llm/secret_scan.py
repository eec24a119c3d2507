"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware control of false discoveries.

Base spans come from three patterns (assign, access, hex), leftmost and not overlapping within a kind.

The battery looks at every run of characters of the base64 alphabets within limits of words. Its encoding is inferred as
the smallest alphabet that holds the run (decimal, hex, lower or upper case, base32, letters, letters and digits,
base64). What is to be shown is that a run isn't language: its hypothesis is "written by people". Under it

* chi-squared: letters (without case) and digits are unequally frequent, so more pairs of places hold equal ones than
  in a random key. The statistic is linear in the number of such pairs, whose mean and variance under language are known;
  the p-value is the chance of as few.
* runs: kinds of characters (digit, lower, upper; a capital before a small letter counts as small) come in long runs.
  The p-value is the chance of as many changes of kind.

Fisher's method joins the two. Both p-values can only get small as a run gets long, so short runs aren't found, by the
tests themselves. Over all documents Benjamini and Hochberg's rule, in a family of its own for each class of length,
keeps the expected share of language among what is reported below FDR; all runs tested count, also those that are never
near. A run shorter than shortest(FDR) can't be told even if it is as random as can be expected, so it isn't looked at.

What is even but ordered (the alphabet, counters) isn't language and isn't random either: a discovery is reported only
if the three tests for "random over its alphabet" (chi-squared, runs above and below the middle, serial correlation),
joined by Fisher's method, don't reject it at GATE. That can only take reports away, so the bound on false ones holds.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacube.llm.common import id_text, map_rows, stored

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Least lengths of a base match: group 2 of assign, whole of access.
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: Share of language among what the battery reports, in each class of length; the gate's level.
FDR, GATE = 0.05, 1e-3
#: Bins of the p-values (by their logarithm).
BINS, PER_DECADE = 400, 10
KINDS = ("assign", "access", "hex", "random")

ALPHABETS = ("0123456789", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: From the smallest.
_SETS = [(frozenset(a), {c: i for i, c in enumerate(a)}) for a in sorted(ALPHABETS, key=len)]
#: Under language, the chances that two and that three symbols are equal: letters of written English, its letters a to f
#: (for hex), digits by Benford's law.
LETTERS, HEX_LETTERS, DIGITS = (0.0655, 0.0066), (0.26, 0.085), (0.1652, 0.0369)
#: Under language, the chance that the kind changes from one character to the next.
CHANGES = 0.1


def normal_tail(z: float) -> float:
    """Two-sided p-value of a standard normal value."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, k: float) -> float:
    """P(chi-squared with k degrees of freedom > x), by Wilson and Hilferty's cube root."""
    if x <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(run: str) -> tuple[float, float, float, float]:
    """p-values of the chi-squared, runs and serial-correlation tests and of all three together."""
    body = run.rstrip("=")
    symbols = set(body)
    code = next((c for s, c in _SETS if symbols <= s), None)
    if code is None or len(body) < 2:
        return 1.0, 1.0, 1.0, 1.0
    v = np.fromiter(map(code.__getitem__, body), np.int64, len(body))
    n, k = len(v), len(code)
    counts = np.bincount(v, minlength=k)
    chi = chi2_tail(float(((counts - n / k) ** 2).sum() * k / n), k - 1)
    high = v >= k / 2
    up = int(high.sum())
    down = n - up
    if up and down:
        mean = 2 * up * down / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        turns = 1 + int((high[1:] != high[:-1]).sum())
        runs = normal_tail((turns - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    d = v - (k - 1) / 2
    serial = normal_tail(float((d[1:] * d[:-1]).sum()) / (math.sqrt(n - 1) * (k * k - 1) / 12))
    least = 1e-300
    together = chi2_fisher(-2 * sum(math.log(max(p, least)) for p in (chi, runs, serial)))
    return chi, runs, serial, together


def chi2_fisher(x: float) -> float:
    """P(chi-squared with 6 degrees of freedom > x), exactly."""
    h = x / 2
    return math.exp(-h) * (1 + h + h * h / 2)


def few_pairs(pairs: float, mean: float, var: float) -> float:
    """P(as few equal pairs or fewer), by Wilson and Hilferty's cube root of a gamma variable of that mean and variance."""
    if mean <= 0:
        return 1.0
    a = mean * mean / var
    z = (((pairs + 0.5) / mean) ** (1 / 3) - (1 - 1 / (9 * a))) * 3 * math.sqrt(a)
    return 0.5 * math.erfc(-z / math.sqrt(2))


@cache
def _moments(n: int, chances: tuple[float, float]) -> tuple[float, float]:
    """Mean and variance of the number of equal pairs among n symbols under language."""
    two, three = chances
    pairs = n * (n - 1) / 2
    return pairs * two, pairs * two * (1 - two) + n * (n - 1) * (n - 2) * (three - two * two)


def many_changes(changes: int, places: int) -> float:
    """P(as many changes of kind or more at so many places); for many places by the normal distribution."""
    if changes <= 0:
        return 1.0
    if places > 1000:
        return 0.5 * math.erfc((changes - 0.5 - places * CHANGES) / math.sqrt(2 * places * CHANGES * (1 - CHANGES)))
    return _upper(places)[changes]


@cache
def _upper(places: int) -> list[float]:
    term = [math.comb(places, k) * CHANGES**k * (1 - CHANGES) ** (places - k) for k in range(places + 1)]
    return np.minimum(1.0, np.cumsum(term[::-1])[::-1]).tolist()


def kinds_of(body: str) -> str:
    """d, l or u for each letter or digit; a capital before a small letter is l; other characters are left out."""
    out = re.sub(r"[A-Z](?=[a-z])|[a-z]", "l", re.sub(r"[^A-Za-z0-9]", "", body))
    return re.sub(r"[0-9]", "d", re.sub(r"[A-Z]", "u", out))


def language(run: str) -> float:
    """The p-value of a run under language: small if its letters and digits are more even, or its kinds change more often."""
    body = run.rstrip("=")
    hexadecimal = not body.strip("0123456789abcdef") or not body.strip("0123456789ABCDEF")
    folded = body.lower()
    pairs = mean = var = 0.0
    for symbols, chances in (("0123456789", DIGITS), ("abcdefghijklmnopqrstuvwxyz", HEX_LETTERS if hexadecimal else LETTERS)):
        counts = [n for c in symbols if (n := folded.count(c))]
        m, v = _moments(sum(counts), chances)
        pairs, mean, var = pairs + sum(n * (n - 1) // 2 for n in counts), mean + m, var + v
    chi = few_pairs(pairs, mean, var) if var > 0 else 1.0
    kinds = kinds_of(body)
    if len(set(kinds)) < 2:
        return max(chi, 1e-300)
    turns = many_changes(sum(map(str.__ne__, kinds, kinds[1:])), len(kinds) - 1)
    both = max(chi, 1e-300) * max(turns, 1e-300)
    return min(1.0, max(both * (1 - math.log(both)), 1e-300))  # P(chi-squared with 4 degrees of freedom > -2 log both)


@cache
def shortest(fdr: float) -> int:
    """The least length at which a run of letters and digits with as many changes and pairs as a random one has is below fdr."""
    for n in range(2, 64):
        letters, digits = n * 52 / 62, n * 10 / 62
        pairs = letters * (letters - 1) / 52 + max(0.0, digits * (digits - 1)) / 20
        m, v = map(sum, zip(_moments(round(letters), LETTERS), _moments(round(digits), DIGITS), strict=True))
        both = few_pairs(pairs, m, v) * many_changes(round(0.42 * (n - 1)), n - 1)
        if both * (1 - math.log(both)) <= fdr:
            return n
    return 64


@cache
def _even(n: int) -> int:
    """The fewest different letters that a run of n letters of one kind needs to be below FDR."""
    mean, var = _moments(n, LETTERS)
    for distinct in range(1, min(n, 26) + 1):
        each, more = divmod(n, distinct)
        pairs = (distinct - more) * each * (each - 1) // 2 + more * each * (each + 1) // 2  # the fewest that so many allow
        if few_pairs(pairs, mean, var) <= FDR:
            return distinct
    return 27


def length_class(n: int) -> int:
    """Classes of length, half an octave each."""
    return int(2 * math.log2(n))


def p_bin(p: float) -> int:
    return min(BINS - 1, int(-math.log10(max(p, 1e-300)) * PER_DECADE))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


@cache
def pattern(least: int) -> re.Pattern:
    return re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{{{least},}}={{0,2}}(?![A-Za-z0-9+/_=-])")


def candidates(text: str, fdr: float = FDR) -> tuple[list[tuple[int, int, int, int]], dict[int, int]]:
    """(start, end, class of length, bin of the p-value) of the runs below fdr that pass the gate, and by class all that were tested."""
    out, tested = [], {}
    for m in pattern(shortest(fdr)).finditer(text):
        run = m[0]
        n = len(run)
        tested[c] = tested.get(c := length_class(n), 0) + 1
        if run.isalpha() and n <= 64 and (run.islower() or run.istitle()) and fdr <= FDR and len(set(run.lower())) < _even(n):
            continue  # a word: as many equal letters as language has
        p = language(run)
        if p <= fdr and battery(run)[3] >= GATE:
            out.append((m.start(), m.end(), c, p_bin(p)))
    return out, tested


def thresholds(counts: dict[tuple[int, int], int], totals: dict[int, int], fdr: float = FDR) -> dict[int, int]:
    """By class of length, the least bin that is reported (Benjamini and Hochberg's step-up rule, each bin as its largest p)."""
    out = {}
    for c, total in totals.items():
        found, least = sum(n for (d, _), n in counts.items() if d == c), BINS
        for b in range(BINS):
            if counts.get((c, b), 0):
                if 10 ** (-b / PER_DECADE) <= fdr * found / total:
                    least = b
                    break
                found -= counts[c, b]
        out[c] = least
    return out


def outside(found: list[tuple[int, int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Those of found that aren't inside one of base; both are in the order of their starts."""
    starts = [a for a, _, _ in base]
    furthest = np.maximum.accumulate([z for _, _, z in base]).tolist() if base else []
    return [x for x in found if not (i := bisect_right(starts, x[0])) or furthest[i - 1] < x[1]]


def scan(docs: DataFrame, fdr: float = FDR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and found: arrays of (start, kind, end) in code points, end exclusive, for each row of docs.

    kind is a place in KINDS; found has the battery's spans that aren't inside a base span. Null and empty texts have
    none; whole texts of any length are looked at; a null id stays null; repeated rows give repeated results and count as
    often in the families of tests; other columns are ignored, whatever their names; an empty table gives an empty one.
    The counts cover all documents; what comes to the driver is a table of classes of length by bins.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    cand = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("size", pa.int32()), ("bin", pa.int32())]))
    many = pa.list_(pa.struct([("size", pa.int32()), ("n", pa.int64())]))

    def make():
        def act(part: pa.RecordBatch) -> pa.RecordBatch:
            base, found, tests = [], [], []
            for text in part.column(1).to_pylist():
                b = base_spans(text) if text else []
                more, tested = candidates(text, fdr) if text else ([], {})
                base.append([{"start": a, "kind": k, "end": z} for a, k, z in b])
                found.append([{"start": a, "end": z, "size": c, "bin": p} for a, z, c, p in outside(more, b)])
                tests.append([{"size": c, "n": n} for c, n in tested.items()])
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(base, span), pa.array(found, cand), pa.array(tests, many)], ["doc_id", "base", "cand", "tests"])

        return act

    spans = "array<struct<start:long,kind:int,end:long>>"
    rows = stored(map_rows(id_text(docs, id_col, text_col), make, f"doc_id long, base {spans}, cand array<struct<start:long,end:long,size:int,bin:int>>, tests array<struct<size:int,n:long>>"), "secrets")
    totals = {r["size"]: r["n"] for r in rows.select(F.explode("tests").alias("c")).groupBy("c.size").agg(F.sum("c.n").alias("n")).collect()}
    counts = {(r["size"], r["bin"]): r["n"] for r in rows.select(F.explode("cand").alias("c")).groupBy("c.size", "c.bin").agg(F.count("*").alias("n")).collect()}
    least = thresholds(counts, totals, fdr)
    bound = F.create_map(*[F.lit(x) for c, b in sorted(least.items() or {0: 0}.items()) for x in (c, b)])
    found = F.filter("cand", lambda x: x["bin"] >= F.element_at(bound, x["size"]))
    return rows.select("doc_id", "base", F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["end"].alias("end"))).alias("found"))


def digests(spans: DataFrame) -> DataFrame:
    """The columns of the contract from scan()'s."""

    def joined(column):
        name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
        return F.concat_ws(",", F.transform(F.array_sort(column), lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))))

    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return spans.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "found")).alias("spans"),
    )
