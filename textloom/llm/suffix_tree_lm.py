"""Language-model scoring with a probabilistic suffix tree over words.

States of the tree are contexts of 1 to ``DEPTH`` words that occur ``MIN_CONTEXT`` times or more in training, whatever the
size of the corpus, and that pass a divergence test: occurrences times the Kullback-Leibler divergence of the words that
follow (those seen less than ``MIN_ENTRY`` times lumped together) from what the context's parent, itself without its first
word, says of them, must be at least ``MIN_DIVERGENCE`` nats. A state keeps the counts of all next words seen ``MIN_ENTRY``
times or more; the rest of its mass goes to the distribution of the longest state below it, so each state's distribution
sums to one. A word is scored by the longest state that is a suffix of the words before it; a root without context gives
the smoothed word frequencies.

Counts cover all training documents and grow with the corpus; none of them goes to the driver. Texts are cut into blocks, which stay
where they are written (a bucketed table). Level by level, each block asks for the totals of its own distinct (context,
word) pairs. Its questions are packed by the part of the key space that answers them: the part merges what all blocks
say of a pair, tests the part's contexts, numbers the pairs that may be contexts of the next level, and answers each
block. Numbers, not hashes, name contexts and words from the second level on, so pairs are exact; words are
named by 64-bit hashes. Pairs that can't have ``MIN_ENTRY`` occurrences, as the shorter pair has fewer, aren't asked for.

Skew: a pair reaches its part at most once from a block. The pairs of a hot context are dealt to several parts by their
words; what these find is added up on the driver and broadcast to the blocks. A hot context has more than a 2 ** -20 of all
tokens, so these are at most 2 ** 21 rows of 40 bytes a level, 84 MB at any size of the corpus.

Defined cases: a null text is an empty text, one end token; a null id is in training; repeated rows are trained on and
scored as often as they occur; with no training documents every token has the probability 1 of an empty model; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import delete_folder, discard, drop_old_shuffles, materialize, prepare, shared_dir

DEPTH = 3
MIN_CONTEXT = 2
MIN_ENTRY = 2
MIN_DIVERGENCE = 4.0
#: Added to the mass that a state leaves to its parent.
BACKOFF = 1.0
#: Bytes of text whose words are counted and looked up together.
BLOCK_BYTES = 5 << 20
#: Tokens whose pairs one part answers for, and occurrences of a context beyond which several parts do: ``HOT``, or all
#: training tokens over 2 ** ``HOT_SHARE`` if that is more.
PART_TOKENS = 1 << 23
HOT = 1 << 20
HOT_SHARE = 20
#: Steps a nat in which a parent's log-probabilities are sent to the divergence test.
GRAIN = 16


def held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id's text falls on ``fold``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % folds == fold


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of longs as compressed byte planes of their distances from their least; :func:`unpack` reads them."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, np.int64)
        low = a.min() if len(a) else np.int64(0)
        far = (a - low).view(np.uint64)
        width = (int(far.max()).bit_length() + 7) // 8 if len(a) else 0
        out.append(struct.pack("<qqB", len(a), int(low), width))
        out.append(far.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(packed: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(packed), 0, []
    while at < len(raw):
        n, low, width = struct.unpack_from("<qqB", raw, at)
        at += 17
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out.append(planes.view(np.int64).ravel() + np.int64(low))
        at += n * width
    return out


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences between neighbours, the first from 0; ``np.cumsum`` undoes it."""
    return np.diff(a, prepend=np.int64(0))


def _part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key (unsigned): ranges of keys, so that sorted keys are sorted by part."""
    return (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _scattered(a: np.ndarray) -> np.ndarray:
    """Numbers as well-mixed unsigned keys."""
    with np.errstate(over="ignore"):
        z = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(27))


class Model(NamedTuple):
    """What every task needs to know: sums over training, the rules, and the number of parts."""

    tokens: int
    distinct: int
    ends: int
    parts: int
    depth: int
    min_context: int
    min_entry: int
    min_divergence: float
    hot: int


class Blocks(NamedTuple):
    """Texts cut into blocks, as a table bucketed by block, the blocks' words, the number of buckets, and the names of the tables that belong to it."""

    table: DataFrame
    words: DataFrame
    buckets: int
    owned: list[str]


def _bucketed(rows: DataFrame, buckets: int, owned: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` written in the shared folder, bucketed by block, so that joins on it need no shuffle, in a folder for each value of ``by``."""
    spark = prepare(rows.sparkSession)
    name = f"suffix_tree_{uuid.uuid4().hex}"
    writer = rows.write.partitionBy(*by) if by else rows.write
    writer.bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    owned.append(name)
    return spark.table(name)


def cut_blocks(docs: DataFrame, id_col: str, text_col: str, held_col: str, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """A row for each block: its documents' ids, sizes and word codes, its distinct words in the order of their hashes, and their training counts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0

        def fresh():
            return [], [], [], []

        ids, held, sizes, texts = fresh()
        volume = 0

        def done():
            # Words with the end of a text, which no word equals, behind each text.
            found = pa.concat_arrays([x for t in texts for x in (t, pa.array([b""]))]).dictionary_encode()
            flat, known = found.indices.to_numpy(), found.dictionary.to_pylist()
            end = known.index(b"")
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
            hashes[end] = np.uint64((1 << 64) - 1)
            order = np.argsort(hashes)
            order = np.r_[order[order != end], end]
            # Codes of words count from 1 in the order of their hashes; one past them is the end token.
            code = np.empty(len(known), np.int32)
            code[order] = np.arange(1, len(known) + 1)
            flat = code[flat]
            train = np.repeat(~np.array(held, bool), np.array(sizes) + 1)
            counts = np.bincount(flat[train], minlength=len(known) + 1)
            block = (part << 32) + serial
            words = {"block": block, "packed": pack(_steps(hashes[order[:-1]].view(np.int64)), counts[1:-1]), "kind": "words"}
            whole = {"block": block, "ids": ids, "held": held, "packed": pack(sizes, flat), "trained": int(train.sum()), "ends": int(counts[-1]), "size": len(flat), "kind": "texts"}
            return pa.RecordBatch.from_pylist([whole, words], schema=schema)

        for batch in batches:
            for doc, text, out in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = (text or "").encode("utf-8", "surrogatepass").lower()
                found = raw.split()
                ids.append(doc)
                held.append(out)
                sizes.append(len(found))
                texts.append(pa.array(found, pa.binary()))
                volume += len(raw) + 64
                if volume >= block_bytes:
                    yield done()
                    ids, held, sizes, texts = fresh()
                    volume, serial = 0, serial + 1
        if ids:
            yield done()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = _parse_datatype_string(f"block long, ids array<{kind}>, held array<boolean>, packed binary, trained long, ends long, size long, kind string")
    schema = to_arrow_schema(out)
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{held_col}`"))
    buckets, owned = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()), []
    table = _bucketed(rows.mapInArrow(run, out), buckets, owned, ("kind",))
    return Blocks(table.where("kind = 'texts'").withColumnRenamed("packed", "texts"), table.where("kind = 'words'").select("block", "packed"), buckets, owned)


class _Asked(NamedTuple):
    """A block's distinct (context, word) pairs of a level, in the order in which they are sent."""

    part: np.ndarray
    state: np.ndarray
    count: np.ndarray
    #: Numbered from 1; 0 asks for the context alone.
    word: np.ndarray
    #: Tokens with a context, the pair of each, and a token of each pair.
    at: np.ndarray
    pair: np.ndarray
    some: np.ndarray


def _distinct(keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in the order of the keys, and the number of each key among them. Keys are at least 0 and below ``top``."""
    bits = len(keys).bit_length()
    if top << bits < 1 << 63:  # sorted with their places in the low bits, which is many times faster than sorting places
        keys = (keys << bits) | np.arange(len(keys))
        keys.sort()
        order = keys & ((1 << bits) - 1)
        keys >>= bits
    else:
        order = np.argsort(keys)
        keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], number


class _Words(NamedTuple):
    """A block's words by code (0: none), with their places in the order of their numbers."""

    number: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, number: np.ndarray) -> _Words:
        place = np.empty(len(number), np.int64)
        place[np.argsort(number, kind="stable")] = np.arange(len(number))
        return cls(number, place)


def _ask(at: np.ndarray, place: np.ndarray, state: np.ndarray, count: np.ndarray, code: np.ndarray, words: _Words, first: bool, model: Model) -> _Asked:
    """Pairs of the tokens ``at``, which have contexts: ``place`` numbers a token's context in ``state`` (-1: none) and
    ``count``; ``code`` is its word's code, or 0 to ask for the context alone."""
    may = np.flatnonzero(state >= 0)
    if first:  # by part, then in the order of numbers; answers to pairs come in this order
        may = may[np.lexsort((state[may], state[may] % model.parts))]
    ordered = np.zeros(len(state), np.int64)
    ordered[may] = np.arange(len(may))
    width = len(words.number)
    some, pair = _distinct(ordered[place] * width + words.place[code], len(may) * width)
    own, word, some = ordered[place[some]], words.number[code[some]], at[some]
    part, state, count = (state[may] % model.parts)[own], state[may][own], count[may][own]
    if (count > model.hot).any():
        salt = (_scattered(word) >> np.uint64(33)).astype(np.int64) % (count // model.hot + 1)
        part = np.where(count > model.hot, (part + salt) % model.parts, part)
        order = np.argsort(part, kind="stable")
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        part, state, count, word, pair, some = part[order], state[order], count[order], word[order], back[pair], some[order]
    return _Asked(part, state, count, word, at, pair, some)


def _answered(answers: list, decode) -> list[np.ndarray]:
    """The arrays of a block's answers, those of all parts together, by part; ``decode(part, *arrays)`` reads the numbers in them."""
    told = [decode(a["part"], *unpack(a["packed"])) for a in sorted(answers or [], key=lambda a: a["part"])]
    return [np.concatenate(x) for x in zip(*told)]


def _walk(row: dict, levels: list, hot: list, model: Model):
    """A block with the answers of its levels so far. Returns its documents' words, the tokens' probabilities by the longest
    state of those levels, and what it asks on the next level; behind the last, the tokens' totals and probabilities by the root."""
    sizes, codes = unpack(row["texts"])
    codes = codes.astype(np.int32)
    total, number = _answered(levels[0], lambda part, total, rank: (total, np.where(rank < 0, -1, 1 + rank * model.parts + part))) or [np.zeros(0, np.int64)] * 2
    total, number = np.r_[0, total, model.ends], np.r_[-1, number, 0 if model.ends else -1]
    width = len(total) - 1
    chance = (total + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)) if model.tokens else np.ones(width + 1)
    p = chance[codes]
    words = _Words.of(number + 1)
    asks = np.where(total >= model.min_entry, np.arange(width + 1, dtype=np.int32), 0)[codes]
    may = total >= model.min_context
    may[width] = False
    # Tokens that have a context, and its place among the level's candidates.
    at = np.flatnonzero(may[codes[:-1]]) + 1
    place, state, count = codes[at - 1], np.where(may, number, -1), total
    for level in range(1, model.depth + 1):
        asked = _ask(at, place, state, count, asks[at], words, level == 1, model)
        if level == len(levels):
            return sizes, p, asked
        spare, got, ids = _read_pairs(asked, levels[level], hot[level], model)
        mass = asked.count + BACKOFF
        own, left = np.where(spare >= 0, got / mass, 0.0), np.where(spare >= 0, (spare + BACKOFF) / mass, 1.0)
        p[at] = own[asked.pair] + left[asked.pair] * p[at]
        asks = np.zeros(len(codes), np.int32)
        asks[at] = np.where(got >= model.min_entry, codes[asked.some], 0)[asked.pair]
        ids[asked.word == words.number[width]] = -1
        go = np.flatnonzero((ids >= 0)[asked.pair])
        at, place, state, count = at[go] + 1, asked.pair[go], ids, got
    return sizes, p, (total[codes], chance[codes])


def _runs(a: np.ndarray) -> np.ndarray:
    """Starts of runs of equal neighbours."""
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)


def _read_pairs(asked: _Asked, answers: list, hot: tuple, model: Model):
    """For each pair asked: its context's spare mass (-1: not a state), its total, and its number (-1: no context of the next level)."""
    told = _answered(answers, lambda part, spare, total, steps: (spare, total, np.cumsum(steps) * model.parts + part))
    if not told:
        return [np.zeros(0, np.int64)] * 3
    spares, total, numbers = told
    ids = np.full(len(total), -1)
    ids[total >= model.min_context] = numbers
    heads = _runs_of(asked)
    spare = np.repeat(spares, np.diff(np.r_[heads, len(total)]))
    if (spares == -2).any():
        where = spare == -2
        spare[where] = hot[1][np.searchsorted(hot[0], asked.state[where])]
    return spare, total, ids


def _runs_of(asked: _Asked) -> np.ndarray:
    """Starts of the runs of one context within one part."""
    return np.zeros(0, np.int64) if not len(asked.part) else np.flatnonzero(np.r_[True, (asked.part[1:] != asked.part[:-1]) | (asked.state[1:] != asked.state[:-1])])


def _joined(blocks: Blocks, columns: list[str], levels: list[DataFrame]) -> DataFrame:
    """Blocks with the answers of each level; bucketed tables, joined where they lie."""
    rows = blocks.table.select("block", *columns)
    for k, answers in enumerate(levels):
        rows = rows.join(answers.select("block", F.col("answers").alias(f"level{k}")).hint("merge"), "block", "left")
    return rows


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}


_QUESTIONS = "part int, block long, packed binary"
_ANSWERS = "block long, part int, packed binary, tally long"


def _slices(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    heads = _runs(part)
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(part)]):
        yield int(part[a]), slice(a, b)


def _ask_words(blocks: Blocks, parts: int) -> DataFrame:
    def run(batches):
        for row in _rows(batches):
            hashes, counts = unpack(row["packed"])
            hashes = np.cumsum(hashes)
            for part, s in _slices(_part_of(hashes.view(np.uint64), parts)):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([row["block"]]), pa.array([pack(_steps(hashes[s]), counts[s])], pa.binary())], names=["part", "block", "packed"])

    return blocks.words.mapInArrow(run, _QUESTIONS)


def _ask_pairs(blocks: Blocks, levels: list[DataFrame], hot: list, model: Model) -> DataFrame:
    shared, told = blocks.table.sparkSession.sparkContext.broadcast(hot), len(levels)

    def run(batches):
        for row in _rows(batches):
            sizes, p, asked = _walk(row, [row[f"level{k}"] for k in range(told)], shared.value, model)
            train = np.repeat(~np.array(row["held"], bool), sizes + 1)
            n = np.bincount(asked.pair[train[asked.at]], minlength=len(asked.part))
            grain = np.rint(-GRAIN * np.log(p[asked.some])).astype(np.int64)
            for part, s in _slices(asked.part):
                state, heads = asked.state[s], _runs(asked.state[s])
                word = asked.word[s]
                steps = _steps(word)
                steps[heads] = word[heads]
                packed = pack(_steps(state[heads] // model.parts), state[heads] % model.parts, np.diff(np.r_[heads, len(state)]), asked.count[s][heads], steps, n[s], grain[s])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([row["block"]]), pa.array([packed], pa.binary())], names=["part", "block", "packed"])

    return _joined(blocks, ["held", "texts"], levels).mapInArrow(run, _QUESTIONS)


def _answer(questions: DataFrame, model: Model, merge) -> DataFrame:
    """Brings each part's questions together and has ``merge(part, messages)`` answer them: packed answers, in order, and rows about the part itself."""

    def run(batches):
        part, blocks, messages = None, [], []

        def done():
            answers, own = merge(part, [unpack(m) for m in messages], model)
            rows = [(b, part, a, 0) for b, a in zip(blocks, answers)] + [(-1 - part, part, *own)]
            for at in range(0, len(rows), 64):
                some = list(zip(*rows[at : at + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int64()), pa.array(some[1], pa.int32()), pa.array(some[2], pa.binary()), pa.array(some[3], pa.int64())], names=["block", "part", "packed", "tally"])

        for batch in batches:
            for p, block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if p != part:
                    if part is not None:
                        yield from done()
                    part, blocks, messages = p, [], []
                blocks.append(block)
                messages.append(packed.as_py())
        if part is not None:
            yield from done()

    return questions.repartition(model.parts, "part").sortWithinPartitions("part").mapInArrow(run, _ANSWERS)


def _cut(arrays: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(arrays, np.cumsum(sizes)[:-1])


def merge_words(part: int, messages: list, model: Model) -> tuple[list[bytes], tuple]:
    """Totals of the part's words, and numbers, the most frequent first, for those that may be contexts or entries. The tally is the number of training words."""
    keys = np.concatenate([np.cumsum(m[0]) for m in messages])
    found, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, np.concatenate([m[1] for m in messages]), len(found)).astype(np.int64)
    rank = np.empty(len(found), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(found))
    # A word's number is 1 + rank * parts + part; the rank is what is sent.
    rank[total < min(model.min_context, model.min_entry)] = -1
    sizes = [len(m[0]) for m in messages]
    return [pack(t, i) for t, i in zip(_cut(total[place], sizes), _cut(rank[place], sizes))], (pack(), int((total > 0).sum()))


def divergence(count: np.ndarray, held: np.ndarray, known: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Occurrences times divergence from the parent: ``known`` sums n * log(n / count / p) over the entries, ``mass`` their p, ``held`` their n."""
    rest = count - held
    with np.errstate(divide="ignore", invalid="ignore"):
        other = rest * np.log(rest / count / np.maximum(1 - mass, 1e-12))
    return known + np.where(rest > 0, other, 0.0)


def merge_pairs(part: int, messages: list, model: Model) -> tuple[list[bytes], tuple]:
    """Totals of the part's pairs, tests of its contexts, and numbers for those pairs that may be contexts. What is known of hot contexts goes into the part's own row."""
    runs = [m[2] for m in messages]
    heads = np.concatenate([np.cumsum(m[0]) * model.parts + m[1] for m in messages])
    state = np.repeat(heads, np.concatenate(runs))
    steps, n, grain = (np.concatenate([m[k] for m in messages]) for k in (4, 5, 6))
    # Words are told by their distances within a context.
    sizes = np.concatenate(runs)
    first = np.cumsum(sizes) - sizes
    word = np.cumsum(steps)
    word -= np.repeat(word[first] - steps[first], sizes)
    states, first, head_at = np.unique(heads, return_index=True, return_inverse=True)
    count = np.concatenate([m[3] for m in messages])[first]
    place = np.repeat(head_at, np.concatenate(runs))
    words = int(word.max(initial=0)) + 1
    some, pair = _distinct(place * words + word, len(states) * words)
    total = np.bincount(pair, n, len(some)).astype(np.int64)
    total[(total < model.min_entry) | (word[some] == 0)] = 0
    kept = np.flatnonzero(total)
    own = place[some[kept]]
    logp = -grain[some[kept]] / GRAIN
    held = np.bincount(own, total[kept], len(states)).astype(np.int64)
    known = np.bincount(own, total[kept] * (np.log(total[kept] / count[own]) - logp), len(states))
    mass = np.bincount(own, np.exp(logp), len(states))
    spare = np.where((held > 0) & (divergence(count, held, known, mass) >= model.min_divergence), count - held, -1)
    hot = np.flatnonzero(count > model.hot)
    spare[hot] = -2
    number = np.full(len(some), -1)
    may = total >= model.min_context
    number[may] = np.arange(may.sum())
    sizes = [int(r.sum()) for r in runs]
    answers = []
    for s, t, i in zip(_cut(spare[head_at], [len(r) for r in runs]), _cut(total[pair], sizes), _cut(number[pair], sizes)):
        # A pair's number is its place * parts + part; what is sent are the steps between places.
        answers.append((s, t, _steps(i[t >= model.min_context])))
    about = pack(states[hot], count[hot], held[hot], known[hot].view(np.int64), mass[hot].view(np.int64)) if len(hot) else None
    return [pack(*a) for a in answers], (about, 0)


def _by_block(answers: DataFrame, blocks: Blocks) -> DataFrame:
    """The answers of a level, a row for each block, bucketed as the blocks are."""
    rows = answers.repartition(blocks.buckets, "block").groupBy("block").agg(F.collect_list(F.struct("part", "packed")).alias("answers"), F.sum("tally").alias("tally"))
    return _bucketed(rows, blocks.buckets, blocks.owned)


def _hot_spares(answers: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and spare masses of the contexts dealt to several parts; see the module's text for their bound."""
    told = [unpack(a["packed"]) for r in answers.where("block < 0 and exists(answers, a -> a.packed is not null)").select("answers").toLocalIterator() for a in r["answers"]]
    if not told:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    state, count, held, known, mass = (np.concatenate(x) for x in zip(*told))
    states, first, at = np.unique(state, return_index=True, return_inverse=True)
    count, held = count[first], np.bincount(at, held, len(states)).astype(np.int64)
    known, mass = (np.bincount(at, x.view(np.float64), len(states)) for x in (known, mass))
    return states, np.where((held > 0) & (divergence(count, held, known, mass) >= model.min_divergence), count - held, -1)


class Tree(NamedTuple):
    """The model's sums, and for each level the answers by block and the spare masses of hot contexts."""

    model: Model
    levels: list[DataFrame]
    hot: list[tuple[np.ndarray, np.ndarray]]


def learn(blocks: Blocks, depth: int = DEPTH, min_context: int = MIN_CONTEXT, min_entry: int = MIN_ENTRY, min_divergence: float = MIN_DIVERGENCE, hot: int = HOT) -> Tree:
    """The tree of the blocks' training documents. The driver gets sums, and what it is told of hot contexts."""
    spark = blocks.table.sparkSession
    sums = blocks.table.agg(F.sum("trained").alias("n"), F.sum("ends").alias("ends"), F.sum("size").alias("size")).first()
    ends = sums["ends"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(sums["size"] or 0) // PART_TOKENS))
    tokens = sums["n"] or 0
    hot = max(hot, tokens >> HOT_SHARE)
    model = Model(tokens, 0, ends, parts, depth, min_context, min_entry, min_divergence, hot)
    words = _by_block(_answer(_ask_words(blocks, parts), model, merge_words), blocks)
    distinct = words.agg(F.sum("tally")).first()[0] or 0
    model = model._replace(distinct=distinct + (ends > 0))
    delete_folder(spark, f"{shared_dir(spark)}/{blocks.owned[0]}/kind=words")
    drop_old_shuffles(spark)
    levels, spares = [words], [(np.zeros(0, np.int64),) * 2]
    for _ in range(depth):
        levels.append(_by_block(_answer(_ask_pairs(blocks, levels, spares, model), model, merge_pairs), blocks))
        spares.append(_hot_spares(levels[-1], model))
        drop_old_shuffles(spark)
    return Tree(model, levels, spares)


def score_blocks(blocks: Blocks, tree: Tree, id_col: str) -> DataFrame:
    """A row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind = blocks.table.schema["ids"].dataType.elementType.simpleString()
    model, levels = tree.model, len(tree.levels)
    shared = blocks.table.sparkSession.sparkContext.broadcast(tree.hot)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for k in range(batch.num_rows):
                row = next(_rows([batch.drop_columns(["ids"]).slice(k, 1)]))
                sizes, p, (seen, root) = _walk(row, [row[f"level{i}"] for i in range(levels)], shared.value, model)
                bounds = np.cumsum(sizes + 1)
                per_doc = lambda x: np.add.reduceat(x, np.r_[0, bounds[:-1]])
                columns = [
                    batch.column(at)[k].values,
                    pa.array(row["held"]),
                    pa.array(np.diff(bounds, prepend=0)),
                    pa.array(per_doc((seen > 0).astype(np.int64))),
                    pa.array(np.full(len(bounds), model.tokens, np.int64)),
                    pa.array(per_doc(np.log10(root))),
                    pa.array(per_doc(np.log10(p))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _joined(blocks, ["ids", "held", "texts"], tree.levels).mapInArrow(run, schema)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1) -> DataFrame:
    """Learns from the documents outside ``fold`` and scores all of them. The result is written, and what led to it removed."""
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), held_out(id_col, folds, fold).alias("__held"))
    blocks = cut_blocks(rows, id_col, text_col, "__held")
    tree = learn(blocks)
    scores = materialize(score_blocks(blocks, tree, id_col), "scores")
    for name in blocks.owned:
        discard(docs.sparkSession, name)
    return scores
