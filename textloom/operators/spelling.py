"""Spelling against a lexicon: unknown words, suggestions, splits of compounds, corrections.

Suggestions meet on deletion keys, a word and each of its forms with one letter left out, so candidates within one edit
share a key and no word is compared with the whole lexicon; distances of candidates are then measured exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as tk


def lexicon(texts: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """word, n: alphabetic words of a corpus seen at least ``least`` times."""
    words = texts.select(F.explode(tk.tokens(F.col(text))).alias("word")).where(F.col("word").rlike(r"^\p{L}+$"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def unknown_words(texts: DataFrame, words: DataFrame, text: str = "text") -> DataFrame:
    """word, n: alphabetic words of more than two letters that the lexicon lacks."""
    found = texts.select(F.explode(tk.tokens(F.col(text))).alias("word")).where(F.col("word").rlike(r"^\p{L}{3,}$"))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(words.select("word"), "word", "left_anti")


def deletion_keys(word: Column, letters: int = 1) -> Column:
    """A word and its forms with up to ``letters`` letters left out."""

    def shorter(w: Column) -> Column:
        one = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return F.when(F.length(w) > 0, one).otherwise(F.array().cast("array<string>"))

    level = keys = F.array(word)
    for _ in range(letters):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        keys = F.concat(keys, level)
    return F.array_distinct(keys)


def suggestions(unknown: DataFrame, words: DataFrame, furthest: int = 1) -> DataFrame:
    """word, suggestion, distance, n: lexicon words within ``furthest`` edits. Words so near share a form with that many letters left out."""
    a = unknown.select("word", F.explode(deletion_keys(F.col("word"), furthest)).alias("k"))
    b = words.select(F.col("word").alias("suggestion"), "n", F.explode(deletion_keys(F.col("word"), furthest)).alias("k"))
    pairs = a.join(b, "k").select("word", "suggestion", "n").distinct()
    return pairs.withColumn("distance", F.levenshtein("word", "suggestion")).where(F.col("distance") <= furthest)


def best_suggestion(found: DataFrame) -> DataFrame:
    """word, suggestion: the nearest, then the most frequent, then the first by letters."""
    order = Window.partitionBy("word").orderBy("distance", F.desc("n"), "suggestion")
    return found.withColumn("k", F.row_number().over(order)).where("k = 1").select("word", "suggestion", "distance")


def expanded(dictionary: DataFrame, rules: DataFrame) -> DataFrame:
    """word: the words of a dictionary (word, flags: one letter a flag) with all forms that affix rules give.

    ``rules``: flag, kind (PFX or SFX), strip, add, condition (a regular expression, anchored at the affix's side), cross. Forms
    with a prefix and a suffix are made where both rules have ``cross``. Empty ``strip`` takes nothing off.
    """
    flagged = dictionary.select("word", F.explode(F.filter(F.split("flags", ""), lambda x: x != "")).alias("flag"))

    def apply(words: DataFrame, kind: str) -> DataFrame:
        own = rules.where(F.col("kind") == kind)
        met = words.join(own, "flag")
        if kind == "SFX":
            fits = F.expr("regexp(word, concat('(?:', condition, ')$')) and endswith(word, strip) and length(word) > length(strip)")
            form = F.expr("concat(substring(word, 1, length(word) - length(strip)), `add`)")
        else:
            fits = F.expr("regexp(word, concat('^(?:', condition, ')')) and startswith(word, strip) and length(word) > length(strip)")
            form = F.expr("concat(`add`, substring(word, length(strip) + 1))")
        return met.where(fits).select("word", form.alias("form"), "cross")

    suffixed, prefixed = apply(flagged, "SFX"), apply(flagged, "PFX")
    both = suffixed.where("cross").select(F.col("word").alias("root"), F.col("form").alias("word")).join(flagged.withColumnRenamed("word", "root"), "root").select("word", "flag")
    crossed = apply(both, "PFX").where("cross")
    return dictionary.select("word").unionByName(suffixed.select(F.col("form").alias("word"))).unionByName(prefixed.select(F.col("form").alias("word"))).unionByName(crossed.select(F.col("form").alias("word"))).distinct()


def compound_splits(unknown: DataFrame, words: DataFrame, least: int = 4) -> DataFrame:
    """word, left_part, right_part: the split into two lexicon words of ``least`` letters and more with the longest left part."""
    cuts = unknown.where(F.length("word") >= 2 * least).select("word", F.explode(F.sequence(F.lit(least), F.length("word") - least)).alias("i"))
    parts = cuts.select("word", "i", F.expr("substring(word, 1, i)").alias("left_part"), F.expr("substring(word, i + 1)").alias("right_part"))
    known = words.select("word")
    ok = parts.join(known.withColumnRenamed("word", "left_part"), "left_part", "left_semi").join(known.withColumnRenamed("word", "right_part"), "right_part", "left_semi")
    return ok.groupBy("word").agg(F.max_by(F.struct("left_part", "right_part"), "i").alias("s")).select("word", "s.left_part", "s.right_part")


def mark_unknown(texts: DataFrame, unknown: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, word, marked: each unknown word of a text, and the text with its first occurrence in angle brackets. Words of one repeated letter are skipped."""
    found = texts.select(key, text, F.explode(F.array_distinct(tk.tokens(F.col(text)))).alias("word")).where(~F.col("word").rlike(r"^(.)\1*$"))
    met = found.join(unknown.select("word"), "word", "left_semi")
    at = F.expr(f"regexp_instr(lower({text}), concat('(?<![\\\\p{{L}}\\\\p{{N}}_])', word, '(?![\\\\p{{L}}\\\\p{{N}}_])'))")
    return met.withColumn("at", at).where("at > 0").select(key, "word", F.expr(f"overlay({text} placing concat('<', word, '>') from at for length(word))").alias("marked"))


def apply_corrections(texts: DataFrame, corrections: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with ``corrected`` and ``changed`` (other than in case and punctuation); ``[NO RESPONSE]`` is no correction."""
    c = corrections.where("correction <> '[NO RESPONSE]'").groupBy("original").agg(F.max("correction").alias("correction"))
    joined = texts.join(c, F.col(text) == F.col("original"), "left").withColumn("corrected", F.coalesce("correction", text))
    bare = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N} ]", "")
    return joined.withColumn("changed", bare(F.col(text)) != bare(F.col("corrected"))).drop("original", "correction")


def greedy_batches(rows: DataFrame, shard: str, order: str, cost: str, budget: int, most: int) -> DataFrame:
    """``rows`` with ``batch``: rows in order fill a batch up to ``budget`` and ``most`` rows; a row beyond the budget is alone.

    Filling is one step after another, so it is done shard by shard, over a stream of sorted rows of which a few are in memory at a time.
    """
    import pyarrow as pa

    at = [rows.columns.index(c) for c in (shard, cost)]

    def fill(batches):
        now, batch, used, n = (), 0, 0, 0
        for rows in batches:
            out = []
            for s, c in zip(*(rows.column(i).to_pylist() for i in at)):
                c = c or 0
                if now != (s,):
                    now, batch, used, n = (s,), 0, 0, 0
                elif used + c > budget or n >= most:
                    batch, used, n = batch + 1, 0, 0
                used, n = used + c, n + 1
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.int64())], names=[*rows.schema.names, "batch"])

    schema = rows.schema.add("batch", "long")
    return rows.repartition(shard).sortWithinPartitions(shard, order).mapInArrow(fill, schema)
