"""Byte-pair encoding and decoding over a contiguous rank array.

A word short enough for it (nearly all are) is held as an array of part boundaries and, beside it, the rank of each
adjacent pair of parts. The smallest rank is found by scanning, its boundary is deleted, and only the two neighbouring
ranks are looked up again. Words of more than ``SHORT`` symbols take a heap over the same ranks, since scanning grows with
the square of a word's length; both give the same tokens.

The vocabulary file is a parameter. It is read on the driver and sent once to each executor by broadcast; its size is that
of the vocabulary and doesn't grow with the data.

Defined cases: a null or empty text has no tokens; ids and decoded text of equal texts are equal; an empty table gives an
empty result; columns besides those used pass through where asked for.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._common import map_text

SHORT = 192
#: Distinct words whose tokens are remembered by a worker before it starts afresh.
CACHE_WORDS = 150_000
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def lower_by_character(text: str) -> str:
    """Lower case of each character alone: a sigma at a word's end is a sigma."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class WordBpe:
    """A BPE vocabulary with marked word ends, read from a tokenizer's JSON text."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self._names = {i: str(i) for i in self.tokens}
        steps = {x["type"]: x for x in spec["normalizer"]["normalizers"]}
        self._nfc, self._lower = "NFC" in steps, "Lowercase" in steps
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"])
        self._blank = regex.compile(r"\s+")
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._symbols = byte_symbols()
        self._cache: dict[str, list[int]] = {}

    def parts(self, word: str) -> list[str]:
        """The symbols of a word after all merges."""
        symbols = [self._symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.suffix
        return self._scan(symbols) if len(symbols) <= SHORT else self._heap(symbols)

    def _scan(self, s: list[str]) -> list[str]:
        ranks, get = [], self.ranks.get
        ranks = [get(pair, _NEVER) for pair in zip(s, s[1:])]
        while ranks:
            low = min(ranks)
            if low == _NEVER:
                break
            k = ranks.index(low)
            s[k : k + 2] = [s[k] + s[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get((s[k], s[k + 1]), _NEVER)
            if k:
                ranks[k - 1] = get((s[k - 1], s[k]), _NEVER)
        return s

    def _heap(self, s: list[str]) -> list[str]:
        get, n = self.ranks.get, len(s)
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(s, s[1:])) if (r := get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if not alive[k] or j >= n or s[k] != a or s[j] != b:
                continue
            s[k], alive[j], after[k] = a + b, False, after[j]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (r := get((s[x], s[y]))) is not None:
                    heapq.heappush(heap, (r, x, s[x], s[y]))
        return [x for x, on in zip(s, alive) if on]

    def word_ids(self, word: str) -> list[int]:
        ids = self._cache.get(word)
        if ids is None:
            ids = [self.vocab[p] for p in self.parts(word)]
            if len(self._cache) >= CACHE_WORDS:
                self._cache.clear()
            if len(word) <= SHORT:
                self._cache[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Token ids; the strings of special tokens in a text are those tokens."""
        out: list[int] = []
        if not text:
            return out
        for piece in self._cut.split(text) if self._cut else (text,):
            if piece in self.special:
                out.append(self.special[piece])
                continue
            if self._nfc and not unicodedata.is_normalized("NFC", piece):
                piece = unicodedata.normalize("NFC", piece)
            piece = self._blank.sub(" ", piece)
            if self._lower:
                piece = lower_by_character(piece)
            for word in self._words.findall(piece):
                out += self.word_ids(word)
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens, special ones too, joined by blanks: the vocabulary file names no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def id_text(self, ids: list[int]) -> str:
        return " ".join(map(self._names.__getitem__, ids))


_LOADED: dict[int, WordBpe] = {}


def _shared(source) -> WordBpe:
    """The tokenizer of a broadcast vocabulary, made once a worker."""
    text = source.value
    key = hash(text)
    if key not in _LOADED:
        _LOADED[key] = WordBpe(text)
    return _LOADED[key]


def load_vocabulary(spark: SparkSession, path: str):
    """Reads the vocabulary file on the driver and broadcasts its text."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, vocabulary, text_col: str = "text", keep: list[str] | None = None, out_col: str = "ids") -> DataFrame:
    """``keep`` columns and ``out_col``, the token ids of the whole text. A map; nothing is shuffled."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != out_col.lower()]

    def run(texts):
        t = _shared(vocabulary)
        return [[t.encode(x) for x in texts]]

    return map_text(docs, text_col, run, [T.StructField(out_col, T.ArrayType(T.IntegerType()))], keep)


def decode_documents(encoded: DataFrame, vocabulary, ids_col: str = "ids", keep: list[str] | None = None, out_col: str = "decoded") -> DataFrame:
    """``keep`` columns and ``out_col``, the text of the ids in ``ids_col`` (null ids: empty)."""
    keep = [c for c in (encoded.columns if keep is None else keep) if c.lower() != out_col.lower()]

    def run(rows):
        t = _shared(vocabulary)
        return [[t.decode(x or []) for x in rows]]

    return map_text(encoded, ids_col, run, [T.StructField(out_col, T.StringType())], keep)


def code_documents(docs: DataFrame, vocabulary, text_col: str = "text", keep: list[str] | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``keep`` columns, ``ids_col`` and ``out_col``: ids and the text that they decode to, in one pass. Two maps after another would take two workers a task, each with the vocabulary."""
    new = {ids_col.lower(), out_col.lower()}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]

    def run(texts):
        t = _shared(vocabulary)
        ids = [t.encode(x) for x in texts]
        return [ids, [t.decode(x) for x in ids]]

    return map_text(docs, text_col, run, [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(out_col, T.StringType())], keep)


def coding_digest(docs: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of decoded text: both directions run, only the digests leave the worker."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(texts):
        t = _shared(vocabulary)
        n, a, b = [], [], []
        for x in texts:
            ids = t.encode(x)
            n.append(len(ids))
            a.append(sha(t.id_text(ids)))
            b.append(sha(t.decode(ids)))
        return [n, a, b]

    return map_text(docs, text_col, run, fields, [id_col])
