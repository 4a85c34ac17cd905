"""Token counts that follow edits.

A document's pre-tokens hang in the leaves of a segment tree whose nodes hold sums of characters and of tokens. An edit
finds its leaves by character sums, scans pre-tokens again from one before the touched ones until a boundary falls on an
old one behind the edit, counts the tokens of new pre-tokens only, and updates the sums on the paths to the changed
leaves. The scan depends only on the text ahead of it, so a boundary that falls together with an old one ends the region:
counts after an edit equal those of the whole new text.

Defined cases: a null text is an empty text with 0 tokens and takes no edits; edits are applied in the order given, each in
the coordinates of the text at that time; repeated rows are counted each; an empty table gives an empty result; other
columns pass through where asked for.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._common import map_text
from .pii import find_spans

LEAF = 64
CACHE_WORDS = 200_000

Edit = tuple[int, int, str]


class Counter:
    """Pre-tokens of a text and the number of tokens of each, by a rank file and a split pattern."""

    def __init__(self, pattern: str, rank_lines: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_lines.splitlines() if line)}
        self._encode = tiktoken.Encoding("counting", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._pattern = regex.compile(pattern)
        self._known: dict[str, int] = {}

    def match(self, text: str, at: int):
        return self._pattern.match(text, at)

    def cut(self, text: str) -> list[str]:
        return [m.group() for m in self._pattern.finditer(text)]

    def tokens(self, piece: str) -> int:
        n = self._known.get(piece)
        if n is None:
            n = len(self._encode(piece))
            if len(self._known) >= CACHE_WORDS:
                self._known.clear()
            if len(piece) <= 64:
                self._known[piece] = n
        return n


class TokenTree:
    """One document: its text, pre-tokens by leaf, and the sums above them."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.text, self.reread = counter, text, 0
        self._build(counter.cut(text))

    def _build(self, pieces: list[str]) -> None:
        self.leaves = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.sums = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, leaf in enumerate(self.leaves):
            self.chars[self.size + k], self.sums[self.size + k] = sum(map(len, leaf)), sum(map(self.counter.tokens, leaf))
        for k in range(self.size - 1, 0, -1):
            self._add(k)

    def _add(self, k: int) -> None:
        self.chars[k], self.sums[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.sums[2 * k] + self.sums[2 * k + 1]

    @property
    def count(self) -> int:
        return self.sums[1]

    def _find(self, at: int) -> tuple[int, int, int]:
        """(leaf, pre-token in it, its first character) of the pre-token that holds character ``at``; the last one for the text's end."""
        k, first = 1, 0
        while k < self.size:
            k *= 2
            if at >= first + self.chars[k] and self.chars[k + 1]:
                first += self.chars[k]
                k += 1
        leaf = k - self.size
        for j, piece in enumerate(self.leaves[leaf]):
            if at < first + len(piece) or j == len(self.leaves[leaf]) - 1:
                return leaf, j, first
            first += len(piece)
        return leaf, 0, first

    def _next(self, leaf: int, j: int) -> tuple[int, int]:
        j += 1
        while leaf < len(self.leaves) and j >= len(self.leaves[leaf]):
            leaf, j = leaf + 1, 0
        return leaf, j

    def edit(self, start: int, end: int, put: str) -> int:
        """Replaces characters ``start`` to ``end`` by ``put``; returns the new count."""
        old = self.text
        self.text = text = old[:start] + put + old[end:]
        shift = len(put) - (end - start)
        # One pre-token before the one that holds the character before the edit: its end may depend on that character.
        leaf, j, first = self._find(max(0, start - 1))
        if first:
            leaf, j, first = self._find(first - 1)
        at, (far, f), edge = first, (leaf, j), first  # edge: the old boundary that (far, f) begins at
        new: list[str] = []
        while True:
            while far < len(self.leaves) and self.leaves[far] and (edge < end or edge + shift < at):
                edge += len(self.leaves[far][f])
                far, f = self._next(far, f)
            if at == len(text) or (edge >= end and edge + shift == at and at >= start + len(put)):
                break
            m = self.counter.match(text, at)
            new.append(m.group())
            self.reread += m.end() - at
            at = m.end()
        if at == len(text):
            far, f = len(self.leaves), 0
        last = min(far, len(self.leaves) - 1)
        tail = self.leaves[far][f:] if far < len(self.leaves) else []
        if far == leaf:
            changed = {leaf: self.leaves[leaf][:j] + new + tail}
        else:
            changed = {leaf: self.leaves[leaf][:j] + new} | {k: [] for k in range(leaf + 1, last + 1)}
            if far < len(self.leaves):
                changed[far] = tail
        for k, pieces in changed.items():
            self.leaves[k] = pieces
        if len(self.leaves[leaf]) > 4 * LEAF or not self.leaves[leaf] or not self.leaves[-1]:
            self._build([p for x in self.leaves for p in x])
            return self.count
        for k in changed:
            n = self.size + k
            self.chars[n], self.sums[n] = sum(map(len, self.leaves[k])), sum(map(self.counter.tokens, self.leaves[k]))
            while n > 1:
                n //= 2
                self._add(n)
        return self.count


def cleaning_edits(text: str) -> list[Edit]:
    """Edits of a cleaning pass: personal data gives way to its kind's name, and a line equal to an earlier one goes. From the end backwards."""
    edits = [(a, b, f"[{k.upper()}]") for k, spans in find_spans(text).items() for a, b in spans]
    seen, at = set(), 0
    for line in text.split("\n"):
        if line.strip() and line in seen:
            edits.append((at - 1, at + len(line), ""))
        seen.add(line)
        at += len(line) + 1
    out, floor = [], len(text) + 1
    for a, b, put in sorted(edits, key=lambda e: (-e[1], e[0])):
        if b <= floor:
            out.append((a, b, put))
            floor = a
    return out


_COUNTERS: dict[int, Counter] = {}


def load_ranks(spark: SparkSession, pattern: str, path: str):
    """Reads a rank file on the driver and broadcasts it with the split pattern."""
    with open(path, encoding="ascii") as f:
        return spark.sparkContext.broadcast((pattern, f.read()))


def count_with_edits(docs: DataFrame, ranks, edits: Callable[[str], list[Edit]] = cleaning_edits, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, n_tokens (before), n_edits, n_tokens_after, n_reread (characters scanned again). A map; nothing is shuffled."""
    names = ["n_tokens", "n_edits", "n_tokens_after", "n_reread"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]

    def run(texts):
        key = hash(ranks.value)
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(*ranks.value)
        out = []
        for text in texts:
            tree = TokenTree(text or "", _COUNTERS[key])
            before, todo = tree.count, edits(text or "")
            for e in todo:
                tree.edit(*e)
            out.append((before, len(todo), tree.count, tree.reread))
        return list(zip(*out)) or [[] for _ in names]

    return map_text(docs, text_col, run, [T.StructField(n, T.LongType()) for n in names], keep)
