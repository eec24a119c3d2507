"""Byte-pair encoding and decoding of whole texts for vocabularies with word ends.

Encoding keeps the symbols of a pre-token in a doubly linked list and the possible merges in a heap ordered by
(rank, position); an entry whose symbols have changed since it was pushed is stale and is skipped. Decoding joins the
vocabulary's strings. Results equal those of the public library for the same file.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stratacube.llm.common import id_text, map_rows

#: Blocks whose letters, numbers, spaces and case have been the same in all Unicode versions of the last years. A text
#: with anything else is normalised and split by the library, whose tables decide.
SETTLED = regex.compile(r"[\x00-ԯ֐-ۿऄ-ह฀-ฺḀ-῿ -⁤₠-₿℀-⯿　-鿯가-힣︀-￯\U0001F300-\U0001F64F\U0001F680-\U0001F6C5]*+")
#: Entries of a worker's cache of pre-tokens, which bounds its memory.
CACHE_ENTRIES = 240_000


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the rest from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Memo(dict):
    """A dict that computes what it lacks. It holds two generations of half its size: when the young one is full it becomes
    the old one, and what is asked for again moves back, so frequent keys stay."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.half, self.old = make, max(1, entries // 2), {}

    def __missing__(self, key):
        out = self.old.pop(key, None)
        if out is None:
            out = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class WordBpe:
    """Encoder and decoder of one tokenizer file: NFC, lower case, pattern split, bytes, merges with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.end: str = spec["model"]["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in self.vocab.items()}
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.specials.items()}
        self.special_at = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        #: (left id, right id) -> (rank, id of the merged symbol)
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.byte_ids = [self.vocab[c] for c in byte_characters()]
        self.last_ids = [self.vocab[c + self.end] for c in byte_characters()]
        self.library = None

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings, before they become bytes."""
        if SETTLED.fullmatch(text):
            if not text.isascii():
                if not unicodedata.is_normalized("NFC", text):
                    text = unicodedata.normalize("NFC", text)
                text = text.replace("Σ", "σ")  # each character by itself: no final sigma
            return self.pattern.findall(text.lower())
        if self.library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            self.library = Tokenizer.from_file(self.path).normalizer, pre_tokenizers.Split(Regex(self.pattern.pattern), "removed", True)
        normalizer, split = self.library
        return [x for x, _ in split.pre_tokenize_str(normalizer.normalize_str(text))]

    def merge(self, pre_token: str) -> list[int]:
        """The ids of one pre-token."""
        raw = pre_token.encode("utf-8")
        if not raw:
            return []
        ids = [self.byte_ids[b] for b in raw]
        ids[-1] = self.last_ids[raw[-1]]
        n = len(ids)
        if n == 1:
            return ids
        merges = self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], i, a, b, m[1]) for i, (a, b) in enumerate(pairwise(ids)) if (m := merges.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((merged, ids[k])):
                    heapq.heappush(heap, (m[0], i, merged, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], merged))):
                heapq.heappush(heap, (m[0], h, ids[h], merged, m[1]))
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special strings: (piece, whether it is one)."""
        if not self.special_at or "<" not in text and not any(s in text for s in self.specials):
            return [(text, False)]
        return [(x, x in self.specials) for x in self.special_at.split(text) if x]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece, special in self.pieces(text):
            if special:
                out.append(self.specials[piece])
            else:
                for x in self.pre_tokens(piece):
                    out += self.merge(x)
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings, one space between two (the file names no decoder); unknown ids give nothing."""
        return " ".join(s for i in ids if (s := self.strings.get(i)) is not None)


def packed(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def unpacked(raw: bytes) -> list[int]:
    return memoryview(raw).cast("I").tolist()


class Codec:
    """Whole texts to packed ids and back, with a worker's caches by pre-token."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.packed = Memo(lambda x: packed(bpe.merge(x)))
        self.text_of = Memo(lambda raw: bpe.decode(unpacked(raw)))

    def encode(self, text: str) -> list[bytes]:
        """Packed ids, one item per pre-token or special string."""
        bpe, out = self.bpe, []
        for piece, special in bpe.pieces(text):
            if special:
                out.append(packed([bpe.specials[piece]]))
            else:
                out += map(self.packed.__getitem__, bpe.pre_tokens(piece))
        return out

    def decode(self, parts: list[bytes]) -> str:
        return " ".join(map(self.text_of.__getitem__, parts))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker and file, kept across its tasks."""
    if path not in _codecs:
        _codecs[path] = Codec(WordBpe(path))
    return _codecs[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) for each row; a null or empty text has no ids and decodes to ''.

    Rows keep their number: repeated rows give repeated results, an empty table an empty one. Other columns are ignored.
    """

    def make():
        c = codec(path)

        def act(part: pa.RecordBatch) -> pa.RecordBatch:
            ids, decoded = [], []
            for text in part.column(1).to_pylist():
                parts = c.encode(text or "")
                ids.append(b"".join(parts))
                decoded.append(c.decode(parts))
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            return pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

        return act

    return map_rows(id_text(docs, id_col, text_col), make, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_texts(), with digests in place of ids and text, so nothing of a text's size leaves the worker."""

    def make():
        c = codec(path)

        def act(part: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, decoded = [], [], []
            for text in part.column(1).to_pylist():
                parts = c.encode(text or "")
                raw = b"".join(parts)
                n.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(c.decode(parts).encode("utf-8")).hexdigest())
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return act

    return map_rows(id_text(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
