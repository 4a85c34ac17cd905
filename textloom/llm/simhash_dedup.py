"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments, so of two fingerprints that differ in at most five bits one segment
differs in at most one. Each segment is indexed once for every bit of it, with that bit wiped out (one-wildcard
variants, 64 a fingerprint): two segments that differ in at most one bit share a variant. Fingerprints that share a
variant meet by its value and are verified on all 64 bits. A document may have several fingerprints (``words``), of hashes
mixed in different ways; it then links with another if any of them does, which finds more copies that differ in many shingles.

Only distinct fingerprints are indexed, so exact copies cost nothing. What meets under one variant is not paired off:
a bucket yields no more links than it has members (a spanning forest of its verified links). A bucket beyond
``HOT_BUCKET`` members is cut again by one-wildcard variants of what its segment leaves over, 42 or 43 bits in three parts;
what is still beyond is dealt to several tasks block pair by block pair. Classes are found by large-star and
small-star rounds over the links, on the cluster.

Defined cases: a null text has no words, so its fingerprint is zero, and zero links like any other; a row without id gets
a class from those it links with, or null if none has an id; repeated rows come back as often as they occur; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checked_broadcast, free_name, let_go, map_text, materialize, trim

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: What the stage of a pipeline takes: words of a shingle, bits in which fingerprints may differ, fingerprints.
STAGE_SHINGLE = 5
STAGE_BITS = 5
STAGE_WORDS = 4
#: (first bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
HOT_BUCKET = 2048
#: Classes, and keys of copies to be left out, are broadcast up to this many rows; more are joined by shuffling.
BROADCAST_ROWS = 200_000


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """The hashes for one of the fingerprints: themselves for the first, mixed with a number of its own for another."""
    if not word:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(word) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprints(text: str | None, shingle: int = SHINGLE, seed: int = SEED, words: int = 1) -> np.ndarray:
    """The SimHashes of the text's word shingles, unsigned; 0 without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(words, np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(found) - shingle + 1)
    ones = np.zeros((words, 64), np.int64)
    for at in range(0, n, 65536):  # bounded memory for very long texts
        h = np.fromiter((digest(b" ".join(found[i : i + shingle]), seed) for i in range(at, min(n, at + 65536))), np.uint64)
        for w in range(words):
            ones[w] += np.unpackbits(_mixed(h, w).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The first SimHash of the text."""
    return int(fingerprints(text, shingle, seed)[0])


def fingerprint_documents(docs: DataFrame, text_col: str, keep: list[str], shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """``keep`` columns, fps (the fingerprints as signed longs) and node, a number for all of them; one pass over the texts, no shuffle."""

    def run(texts):
        found = np.array([fingerprints(t, shingle, SEED, words) for t in texts], np.uint64).reshape(-1).view(np.int64)
        return [pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) + 1, words, dtype=np.int32)), pa.array(found))]

    rows = map_text(docs, text_col, run, [T.StructField("fps", T.ArrayType(T.LongType()))], keep)
    return rows.withColumn("node", F.col("fps")[0] if words == 1 else F.xxhash64("fps"))


def _wiped(value: Column, parts, bit: Column) -> Column:
    """Number of the variant of ``value`` (a long, as SQL) that wipes ``bit``, with what is left of the part that has it."""
    first = mask = F.lit(None)
    for a, n in parts:
        inside = (bit >= a) & (bit < a + n)
        first = F.when(inside, F.lit(a)).otherwise(first)
        mask = F.when(inside, F.lit((1 << n) - 1).cast("long")).otherwise(mask)
    return F.call_function("shiftrightunsigned", value, first).bitwiseAND(mask).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit - first)))


def variant_keys(nodes: DataFrame, words: int = 1) -> DataFrame:
    """key, fp, node: the one-wildcard variants of the three segments of each fingerprint, 64 rows each."""
    rows = nodes.select("node", F.posexplode("fps").alias("word", "fp")).withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(63))))
    name = F.call_function("shiftleft", (F.col("word") * 64 + F.col("bit")).cast("long"), F.lit(32))
    return rows.select(name.bitwiseOR(_wiped(F.col("fp"), SEGMENTS, F.col("bit"))).alias("key"), "fp", "node")


def _finer_keys(keyed: DataFrame) -> DataFrame:
    """The rows of hot buckets under keys of their own: one-wildcard variants of three parts of the bits beside the key's segment."""
    bit = F.call_function("shiftrightunsigned", "key", F.lit(32)) % 64
    parts = None
    for a, n in SEGMENTS:
        rest = [b for b in range(64) if not a <= b < a + n]
        cuts = [0, len(rest) // 3, 2 * len(rest) // 3, len(rest)]
        own = F.array(*[F.struct(F.lit(sum(1 << b for b in rest[x:y] if b < 63) - ((1 << 63) if 63 in rest[x:y] else 0)).cast("long").alias("mask"), F.array(*[F.lit(b) for b in rest[x:y]]).alias("bits")) for x, y in zip(cuts, cuts[1:])])
        parts = F.when((bit >= a) & (bit < a + n), own).otherwise(parts if parts is not None else F.lit(None))
    rows = keyed.select("key", "fp", "node", F.explode(parts).alias("part")).select("*", F.explode("part.bits").alias("bit"))
    wiped = F.col("fp").bitwiseAND(F.col("part.mask")).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))))
    return rows.select(F.xxhash64("key", "bit", wiped).alias("key"), "fp", "node")


def _bits(a: np.ndarray, b) -> np.ndarray:
    """Differing bits; of unsigned numbers, as a negative one would be counted by its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of links that connect what is within ``bits`` in one bucket: at most one for each member."""
    links, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            near = _bits(fps[rest], fps[x := queue.pop()]) <= bits
            if near.any():
                found = rest[near]
                links.append((np.full(len(found), x), found))
                queue.extend(found)
                rest = rest[~near]
    return links


def _bipartite(fps: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of links between two blocks of one bucket, at most two for each member; links inside a block are found elsewhere."""
    links = []
    while len(a) and len(b):
        x, a = a[0], a[1:]
        near = _bits(fps[b], fps[x]) <= bits
        if not near.any():
            continue
        found, b = b[near], b[~near]
        links.append((np.full(len(found), x), found))
        # Members of a that reach what was found join it here, so that their own links to it need no second look.
        queue = list(found)
        while queue and len(a):
            close = _bits(fps[a], fps[y := queue.pop()]) <= bits
            for z in a[close]:
                links.append((np.array([y]), np.array([z])))
                more = _bits(fps[b], fps[z]) <= bits
                if more.any():
                    links.append((np.full(int(more.sum()), z), b[more]))
                    queue.extend(b[more])
                    b = b[~more]
            a = a[~close]
    return links


def _link_sorted(keys: np.ndarray, fps: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places of links within runs of equal keys. Small runs are compared at growing distances, all runs at once; others one by one."""
    left, right = [], []
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    for k in np.flatnonzero(sizes > 16):
        for a, b in _forest(fps[starts[k] : starts[k] + sizes[k]], bits):
            left.append(a + starts[k])
            right.append(b + starts[k])
    few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 16), sizes))
    for d in range(1, 16):
        few = few[few + d < len(keys)]
        few = few[keys[few + d] == keys[few]]
        if not len(few):
            break
        ok = few[_bits(fps[few], fps[few + d]) <= bits]
        left.append(ok)
        right.append(ok + d)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _as_links(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], axis=1), axis=0) if len(left) else np.zeros((0, 2), np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])


def _link_buckets(bits: int):
    """Reads (key, fp) or (key, fp, node) sorted by key and carries an unfinished bucket, of at most ``HOT_BUCKET`` members, to the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(__name__)
        held, rows = [], 0

        def links(keys, fps, nodes):
            left, right = _link_sorted(keys, fps, bits)
            return _as_links(nodes[left], nodes[right])

        for batch in batches:
            held.append([batch.column(min(i, batch.num_columns - 1)).to_numpy(zero_copy_only=False) for i in range(3)])
            rows += batch.num_rows
            if rows < 100_000:
                continue
            columns = [np.concatenate(x) for x in zip(*held)]
            whole = int(np.searchsorted(columns[0], columns[0][-1]))
            if whole:
                yield links(*(c[:whole] for c in columns))
            held, rows = [[c[whole:] for c in columns]], rows - whole
        if rows:
            yield links(*(np.concatenate(x) for x in zip(*held)))
        held = columns = batch = None
        trim()

    return run


def _link_blocks(bits: int):
    """Reads (key, i, j, block, fp, node) sorted by the first three; links block i with block j of the key, or i with itself."""

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(__name__)
        now, rows = None, []

        def done():
            blocks, fps, nodes = (np.array(x, np.int64) for x in zip(*rows))
            links = _forest(fps, bits) if now[1] == now[2] else _bipartite(fps, np.flatnonzero(blocks == now[1]), np.flatnonzero(blocks == now[2]), bits)
            empty = [(np.zeros(0, np.int64),) * 2]
            left, right = (np.concatenate(x) for x in zip(*(links or empty)))
            return _as_links(nodes[left], nodes[right])

        for batch in groups:
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (key, i, j):
                    if now:
                        yield done()
                    now, rows = (key, i, j), []
                rows.append(row)
        if now:
            yield done()

    return run


_LINKS = "src long, dst long"


def _hot(keyed: DataFrame) -> DataFrame:
    return materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_BUCKET), "hot")


def find_links(nodes: DataFrame, max_bits: int = MAX_BITS, words: int = 1) -> DataFrame:
    """src < dst: verified links that connect exactly what links of at most ``max_bits`` bits connect. ``nodes``: distinct (node, fps)."""
    if max_bits >= 2 * len(SEGMENTS):
        raise ValueError(f"three segments find fingerprints that differ in at most {2 * len(SEGMENTS) - 1} bits")
    columns = ["key", "fp"] if words == 1 else ["key", "fp", "node"]
    keyed, links = variant_keys(nodes, words), None

    def add(more):
        nonlocal links
        links = more if links is None else links.unionByName(more)

    for finer in (_finer_keys, None):
        hot = _hot(keyed)
        few = hot.isEmpty()
        cold = keyed if few else keyed.join(checked_broadcast(hot.select("key"), BROADCAST_ROWS), "key", "left_anti")
        add(cold.select(columns).repartition("key").sortWithinPartitions("key").mapInArrow(_link_buckets(max_bits), _LINKS))
        if few:
            return links.distinct()
        if finer:
            keyed = finer(keyed.join(checked_broadcast(hot.select("key"), BROADCAST_ROWS), "key", "left_semi"))
    crowd = keyed.join(hot, "key").withColumn("blocks", F.ceil(F.col("n") / HOT_BUCKET).cast("int")).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    crowd = crowd.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    crowd = crowd.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "node")
    add(crowd.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_link_blocks(max_bits), _LINKS))
    return links.distinct()


def connect(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, root: the smallest node of each node's component, for every node that has a link.

    Large-star and small-star rounds: every node sends its neighbours to its smallest neighbour, until nothing moves. A
    node's smallest neighbour is an aggregate joined back, so a node with very many neighbours is never one task's group.
    """
    edges = materialize(links.select(F.greatest(src, dst).alias("v"), F.least(src, dst).alias("u")).where("u <> v").distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u"))).where("u <> v").distinct()
        edges = materialize(small, "small-star")
        sign = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v))")).first()
        if sign == last:
            break
        last = sign
    roots = edges.groupBy("v").agg(F.min("u").alias("root"))
    return roots.select(F.col("v").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def classes_of(printed: DataFrame, max_bits: int, words: int) -> DataFrame:
    """node, root: the class of each node that links with another; ``printed`` has fps and node of each row."""
    nodes = materialize(printed.groupBy("node").agg(F.first("fps").alias("fps")), "nodes")
    return materialize(connect(find_links(nodes, max_bits, words)), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, words: int = 1) -> DataFrame:
    """doc_id, fp (the first fingerprint), component_id: a row for each document; the class is named by its smallest id."""
    printed = materialize(fingerprint_documents(docs, text_col, [id_col], shingle, words).withColumnRenamed(id_col, "doc_id"), "fingerprints")
    least = printed.groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = materialize(least.join(classes_of(printed, max_bits, words), "node", "left"), "rooted")
    # Only what links has a class to look up; the least ids of the classes are few rows beside it.
    named = rooted.where("root is not null").groupBy("root").agg(F.min("least").alias("named"))
    found = rooted.join(checked_broadcast(materialize(named, "named"), BROADCAST_ROWS), "root", "left")
    found = found.select("node", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("named")).alias("component_id"))
    return printed.join(found, "node").select("doc_id", F.col("fps")[0].alias("fp"), "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = STAGE_SHINGLE, max_bits: int = STAGE_BITS, words: int = STAGE_WORDS) -> DataFrame:
    """``docs`` without near-duplicates: one row of each class stays, that with the smallest id, null ids last.

    Rows are told apart by hashes of all their columns, not by their ids: different texts under one id are different
    rows, and of rows that are equal in all columns one stays. The columns stay as they are.
    """
    key, twin, count = (free_name(docs.columns, x) for x in ("row_key", "row_twin", "row_count"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(key, F.xxhash64(*columns)).withColumn(twin, F.xxhash64(F.lit(SEED), *columns))
    printed = fingerprint_documents(keyed, text_col, [id_col, key, twin], shingle, words)
    printed = materialize(printed.select(F.col(f"`{id_col}`").alias("id"), F.col(key).alias("k"), F.col(twin).alias("t"), "fps", "node"), "fingerprints")
    roots = classes_of(printed, max_bits, words)
    rows = printed.groupBy("k", "t").agg(F.first("node").alias("node"), F.first("id").alias("id"), F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "k", "t")
    rooted = materialize(rows.join(roots, "node", "left").select("k", "t", "id", "n", F.coalesce("root", "node").alias("root")), "rooted")
    first = rooted.groupBy("root").agg(F.min(place).alias("first")).select("first.k", "first.t")
    gone = materialize(rooted.join(first, ["k", "t"], "left_anti").select("k", "t"), "gone").withColumnsRenamed({"k": key, "t": twin})
    kept = keyed.join(checked_broadcast(gone, BROADCAST_ROWS), [key, twin], "left_anti")
    equal = materialize(rooted.where("n > 1").join(first, ["k", "t"], "left_semi").select("k", "t"), "equal").withColumnsRenamed({"k": key, "t": twin})
    if not equal.isEmpty():
        equal = checked_broadcast(equal, BROADCAST_ROWS)
        kept = kept.join(equal, [key, twin], "left_anti").unionByName(kept.join(equal, [key, twin], "left_semi").dropDuplicates([key, twin]))
    return kept.select(*columns)
