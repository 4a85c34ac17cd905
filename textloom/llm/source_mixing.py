"""Mixing sources to target weights, with DataFrame and SQL functions only.

Each source's documents, in hashed order, make one long stream of words, cut into blocks of ``block_words``. The mix takes
as many whole passes of the stream as the target holds, and of the next pass as many blocks as are left, the last of them
in part, so a source gives exactly its target, rounded down. Which blocks these are is drawn: a seeded permutation (a
swap-or-not shuffle, which is one to one for any number of blocks) puts a pass's blocks in places, and the first places
are taken. A splitting tree deals the places to output shards: its root holds every source's exact block
quota, and each node gives its left half a draw from the multivariate hypergeometric distribution (source by source,
each a hypergeometric quantile of a hashed uniform number) and the rest to its right half, so quotas add up exactly at
every level. A shard then owns, of each source, a range of places that no other shard has, the blocks drawn
to them, and puts its pieces in hashed order.

Positions in a stream are prefix sums over a tree of hash prefixes (256 children a node), so a source with a third of all
rows is summed in many tasks. Rows are told apart by hashes of all their columns, not by their ids.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, the last; equal rows are
rows of their own, and so are rows that share an id or have none; with no words at all every target and share is 0; an
empty table gives an empty result; other columns are not read, and :func:`mixed_documents` passes them through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import checked_broadcast, free_name, materialize

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 17
BLOCK_WORDS = 4096
SHARD_BLOCKS = 1024
#: Documents meant to share a leaf of the tree of hash prefixes; decides the tree's depth only.
LEAF_ROWS = 2000
#: Sources (and shards' quota rows) are broadcast up to this many rows; more are joined by shuffling.
BROADCAST_SOURCES = 20_000
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rounds of the shuffle that permutes a pass's blocks.
ROUNDS = 8


def order_key(id_col: str, text_col: str, seed: int) -> Column:
    """A document's place in the hashed order of its source: md5 of seed, id and the text's md5."""
    parts = [F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def document_sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, source, size (words), the hashed order key, and twin, a hash of all columns, of each document."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        order_key(id_col, text_col, seed).alias("key"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("twin"),
    )


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """rank, source, source_size, target: the weighted shares of all words, none above ``max_repeats`` times its source.

    ``sources`` has a row for each source. Filling up by weight with caps has a closed form: in the order of cap per
    weight, the first source that the level of the rest doesn't fill sets the level for all behind it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (F.lit(max_repeats) * F.col("source_size")).cast("long"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    filled = ranked.withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "below": F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "behind": F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "place": F.row_number().over(by_cap),
        }
    ).withColumn("level", (F.col("total") - F.col("below")) / F.col("behind"))
    filled = filled.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level"))).over(everything)["level"])
    return filled.select("rank", "source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def _prefix(level: int) -> Column:
    return F.substring("key", 1, 2 * level)


def stream_positions(sized: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """``sized`` with its source's rank, size and target, a position in the source's stream, and (leaf, seq), which name a row within its source."""
    leaf_sums = sized.groupBy("rank", _prefix(depth).alias("leaf")).agg(F.sum("size").alias("words"))
    starts = None
    for level in range(1, depth + 1):
        sums = leaf_sums.groupBy("rank", F.substring("leaf", 1, 2 * level).alias("node")).agg(F.sum("words").alias("words"))
        parent = F.substring("node", 1, 2 * level - 2)
        before = Window.partitionBy("rank", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("parent", parent).withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
        if starts is not None:
            up = starts.select("rank", F.col("node").alias("parent"), F.col("start").alias("base"))
            sums = sums.join(up, ["rank", "parent"]).withColumn("start", F.col("start") + F.col("base"))
        starts = sums.select("rank", "node", "start")
    in_leaf = Window.partitionBy("rank", "leaf").orderBy("key", "twin")
    rows = sized.withColumn("leaf", _prefix(depth)).withColumns({"seq": F.row_number().over(in_leaf), "ahead": F.coalesce(F.sum("size").over(in_leaf.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    rows = rows.join(starts.withColumnRenamed("node", "leaf"), ["rank", "leaf"])
    return rows.withColumn("pos", F.col("start") + F.col("ahead")).drop("start", "ahead")


def hypergeometric_sql(total: str, good: str, draws: str, uniform: str) -> str:
    """SQL for a number of ``good`` ones among ``draws`` of ``total`` (SQL longs), drawn with the ``uniform`` number (0 to 1).

    Probabilities relative to the mode's come from the ratio of neighbours, walking up from the mode and down from below
    it; in that order of the numbers the first whose sum reaches the uniform share of all is the draw. The walk ends 12
    standard deviations from the mode, beyond which is less than a double resolves.
    """
    n, k, d = total, good, draws
    spread = f"cast(ceil(12D * sqrt(greatest(0D, cast({d} as double) * {k} * ({n} - {k}) * ({n} - {d}) / (cast({n} as double) * {n} * greatest(1, {n} - 1))))) + 8 as bigint)"
    least, most = f"greatest(0, {d} - ({n} - {k}))", f"least({d}, {k})"
    mode = f"least({most}, greatest({least}, cast(floor((cast({d} as double) + 1) * ({k} + 1) / ({n} + 2)) as bigint)))"
    step = "(hs, hx) -> named_struct('w', hs.w * {r}, 's', hs.s + hs.w * {r}, 'x', if(hs.s < {t}, hx, hs.x))"
    up = f"aggregate(if(hv.high > hv.mode, sequence(hv.mode + 1, hv.high), array()), named_struct('w', 1D, 's', 1D, 'x', hv.mode), {step.format(r=f'(({k} - hx + 1D) * ({d} - hx + 1D) / (hx * ({n} - {k} - {d} + hx + 0D)))', t='{t}')})"
    down = f"aggregate(if(hv.low < hv.mode, sequence(hv.mode - 1, hv.low, -1), array()), named_struct('w', 1D, 's', 0D, 'x', hv.mode), {step.format(r=f'((hx + 1D) * ({n} - {k} - {d} + hx + 1D) / (({k} - hx) * ({d} - hx + 0D)))', t='{t}')})"
    return (
        f"aggregate(array(named_struct('mode', {mode}, 'spread', {spread})), 0L, (ha, hm) -> "
        f"aggregate(array(named_struct('mode', hm.mode, 'low', greatest({least}, hm.mode - hm.spread), 'high', least({most}, hm.mode + hm.spread))), 0L, (hb, hv) -> "
        f"aggregate(array(named_struct('up', {up.format(t='0D')}.s, 'down', {down.format(t='0D')}.s)), 0L, (hc, hu) -> "
        f"if({uniform} * (hu.up + hu.down) <= hu.up, {up.format(t=f'{uniform} * (hu.up + hu.down)')}.x, {down.format(t=f'{uniform} * (hu.up + hu.down) - hu.up')}.x))))"
    )


def split_quotas(nodes: DataFrame, seed: int) -> DataFrame:
    """One level of the tree: each row (node, start, quota), the last two arrays by source, becomes two whose quotas add up to its own."""
    uniform = f"((xxhash64({seed}, node, si) & 9007199254740991L) + 0.5D) / 9007199254740992D"
    draw = hypergeometric_sql("st.rest", "quota[si]", "st.left", uniform)
    total = "aggregate(quota, 0L, (qa, qb) -> qa + qb)"
    left = (
        f"aggregate(sequence(0, size(quota) - 1), named_struct('rest', {total}, 'left', ({total} + 1) div 2, 'drawn', cast(array() as array<bigint>)), "
        f"(st, si) -> aggregate(array(if(st.rest = 0 or quota[si] = 0, 0L, {draw})), st, (sx, sd) -> named_struct('rest', sx.rest - quota[si], 'left', sx.left - sd, 'drawn', array_append(sx.drawn, sd))), "
        f"st -> st.drawn)"
    )
    halves = (
        f"transform(array({left}), sl -> array(named_struct('node', 2 * node, 'start', start, 'quota', sl), "
        f"named_struct('node', 2 * node + 1, 'start', zip_with(start, sl, (za, zb) -> za + zb), 'quota', zip_with(quota, sl, (za, zb) -> za - zb))))[0]"
    )
    return nodes.selectExpr(f"inline({halves})")


def quota_sql(block_words: int) -> dict[str, str]:
    """SQL for what a source of ``source_size`` words gives towards ``target``: words, whole passes, blocks of a pass (whole
    ones and all), whole blocks and words of the block in part in the last pass, and the quota of places."""
    b = block_words
    words = "cast(floor(target) as bigint)"
    full = f"if(source_size = 0, 0L, {words} div source_size)"
    rest = f"({words} - ({full}) * source_size)"
    return {
        "words": words, "full": full, "blocks": f"source_size div {b}", "all_blocks": f"cast(ceil(source_size / {b}) as bigint)",
        "whole": f"{rest} div {b}", "part": f"{rest} % {b}", "quota": f"({full}) * cast(ceil(source_size / {b}) as bigint) + cast(ceil({rest} / {b}) as bigint)",
    }


def shuffled_sql(x: str, n: str, name: str, rounds: int = ROUNDS) -> str:
    """SQL that permutes 0 to ``n`` - 1 by swap-or-not: in each round x and key - x (modulo n) change places or not, as a hash of the larger says."""
    key = f"cast(conv(substr(md5(concat({name}, ':', hi)), 1, 12), 16, 10) as bigint) % {n}"
    partner = f"pmod({key} - hx, {n})"
    swap = f"substr(md5(concat({name}, ':', hi, ':', greatest(hx, {partner}))), 1, 1) >= '8'"
    return f"aggregate(sequence(0, {rounds - 1}), {x}, (hx, hi) -> if({swap}, {partner}, hx))"


def deal_blocks(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """rank, place, shard: the shard of each place of each source's quota. The splitting tree's leaves, unrolled."""
    quotas = targets.selectExpr("rank", f"{quota_sql(block_words)['quota']} as quota")
    root = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "quota"))).alias("q"), F.sum("quota").alias("n"))
    blocks = root.first()["n"] or 0
    depth = max(0, math.ceil(math.log2(max(1, blocks) / shard_blocks)))
    nodes = root.selectExpr("0L as node", "transform(q, x -> 0L) as start", "transform(q, x -> x.quota) as quota")
    for level in range(depth):
        nodes = split_quotas(nodes, seed)
        if level % 4 == 3 or level == depth - 1:  # keeps plans short, and spreads the nodes as they grow in number
            nodes = materialize(nodes.repartition(2 ** min(max(0, level - 4), 12), "node"), "quotas")
    own = nodes.selectExpr("node as shard", "explode(filter(transform(quota, (v, i) -> named_struct('rank', i, 'first', start[i], 'n', v)), x -> x.n > 0)) as own")
    return own.selectExpr("own.rank as rank", "explode(sequence(own.first, own.first + own.n - 1)) as place", "shard")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """A row for each document: doc_id, size, rank, source_size, target, pos, leaf, seq, key, twin; written once in the shared folder, without texts."""
    sized = materialize(document_sizes(docs, id_col, source_col, text_col, seed), "sizes")
    rows = sized.count()
    depth = max(1, math.ceil(math.log(max(1, rows) / LEAF_ROWS, 256)))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sources, weights, max_repeats), "targets")
    named = targets.select("rank", F.col("source").alias("named"), "source_size", "target")
    ranked = sized.join(checked_broadcast(named, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("named"))).drop("named", "source")
    return materialize(stream_positions(ranked, targets, depth), "positions")


def mix_pieces(plan: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The mix: rank, leaf, seq, doc_id, key, twin, copy, from_word, to_word, shard, shard_order. Words count from 0, the end is exclusive."""
    targets = plan.groupBy("rank").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    quota = quota_sql(block_words)
    copies = plan.where(F.col("size") > 0).selectExpr("*", *[f"{quota[c]} as {c}" for c in ("words", "full", "blocks", "all_blocks", "whole", "part")], f"explode(sequence(0, {max_repeats} - 1)) as copy").where("copy * source_size < words")
    pieces = copies.selectExpr("*", f"explode(sequence(pos div {block_words}, (pos + size - 1) div {block_words})) as block")
    drawn = shuffled_sql("block", "blocks", f"concat('{seed}:', rank, ':', copy)")
    # The block at the end of a pass, shorter than the others, keeps the last place.
    pieces = pieces.selectExpr("*", f"if(block < blocks, {drawn}, blocks) as own")
    end = f"if(copy < full or own < whole, (block + 1) * {block_words}, if(own = whole, block * {block_words} + part, 0))"
    pieces = pieces.selectExpr(
        "rank", "leaf", "seq", "doc_id", "key", "twin", "copy", "copy * all_blocks + own as place",
        f"greatest(pos, block * {block_words}) - pos as from_word", f"least(pos + size, {end}) - pos as to_word",
    ).where("from_word < to_word")
    dealt = deal_blocks(targets, block_words, shard_blocks, seed)
    found = pieces.join(dealt, ["rank", "place"]).drop("place")
    return found.withColumn("shard_order", F.xxhash64(F.lit(seed), "rank", "leaf", "seq", "copy", "from_word"))


def taken_words(plan: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: what the pieces take of each document, 0 included."""
    key = ["rank", "leaf", "seq", "doc_id"]
    rows = plan.select(*key, F.col("size"), "source_size", "target", F.lit(0).cast("long").alias("taken"))
    got = pieces.select(*key, F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("source_size"), F.lit(None).cast("double").alias("target"), (F.col("to_word") - F.col("from_word")).alias("taken"))
    both = rows.unionByName(got).groupBy(*key).agg(F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"))
    return both.select("doc_id", "size", "source_size", "target", "taken")


def fragments(pieces: DataFrame) -> DataFrame:
    """``pieces`` with those joined that follow each other in one copy of a document; shard and order are those of the first."""
    one = Window.partitionBy("rank", "leaf", "seq", "copy").orderBy("from_word")
    new = (F.col("from_word") != F.lag("to_word", 1, -1).over(one)).cast("int")
    grouped = pieces.withColumn("new", new).withColumn("run", F.sum("new").over(one))
    return grouped.groupBy("rank", "leaf", "seq", "copy", "run").agg(
        F.first("key").alias("key"), F.first("twin").alias("twin"), F.min("from_word").alias("from_word"), F.max("to_word").alias("to_word"),
        F.min(F.struct("from_word", "shard", "shard_order")).alias("at"),
    ).select("key", "twin", "from_word", "to_word", "at.shard", "at.shard_order")


def words_between(text: Column, start: Column, end: Column) -> Column:
    """The part of ``text`` from its ``start``-th word, counted from 0, up to its ``end``-th, with what stands between them."""
    found = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.array_join(F.slice(found, (start + 1).cast("int"), (end - start).cast("int")), "")
    return F.when(start > 0, F.regexp_replace(part, r"^[\x20\x09-\x0D]+", "")).otherwise(part)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix as documents with the same columns: a row for each run of words that is taken of a document, as often as it
    is taken. Whole passes give whole texts, white space around them included; drawn blocks may cut a text. Rows lie by shard, in the shard's order.

    Rows that share an id, or have none, are rows of their own, each with what the plan takes of it; rows without words are not taken.
    """
    plan = plan_mix(docs, id_col, source_col, text_col)
    taken = fragments(mix_pieces(plan))
    key, twin, shard, order, start, end = (free_name(docs.columns, x) for x in ("order_key", "row_twin", "shard", "shard_order", "from_word", "to_word"))
    taken = taken.select(F.col("key").alias(key), F.col("twin").alias(twin), F.col("from_word").alias(start), F.col("to_word").alias(end), F.col("shard").alias(shard), F.col("shard_order").alias(order))
    keyed = docs.withColumn(key, order_key(id_col, text_col, SEED)).withColumn(twin, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    # Equal rows have one text: it is joined once with what is taken of them all.
    equal = materialize(plan.groupBy("key", "twin").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias(key), F.col("twin").alias(twin)), "equal")
    if not equal.isEmpty():
        equal = checked_broadcast(equal, BROADCAST_SOURCES)
        keyed = keyed.join(equal, [key, twin], "left_anti").unionByName(keyed.join(equal, [key, twin], "left_semi").dropDuplicates([key, twin]))
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD_PATTERN)), F.lit(0))
    a, b, text = F.col(f"`{start}`"), F.col(f"`{end}`"), F.col(f"`{text_col}`")
    cut = F.when((a == 0) & (b >= size), text).otherwise(words_between(text, a, b))
    rows = keyed.join(taken, [key, twin]).select(*[cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], shard, order)
    return rows.repartition(shard).sortWithinPartitions(shard, order).drop(shard, order)
