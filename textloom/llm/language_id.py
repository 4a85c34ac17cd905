"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and what stands between letters becomes one blank; n-grams of 1 to ``MAX_N`` characters are hashed
to ``BUCKETS`` buckets. Training counts are summed by (language, bucket) on the cluster. The matrix of
log-probabilities, buckets times languages, is broadcast in slices of ``SLICE`` languages (32 MB each), one map over the
texts for each, so any number of languages is learnt. A batch of texts is scored as one sparse matrix of counts, rows one behind the other, against the slice.

The fit reads at most about ``TRAIN_ROWS`` labelled rows, or ``LEAST_ROWS`` a language if that is more, picked by a hash of
the row: the documented bound. Each language gives the same share of that bound, all its rows if it has fewer; its prior is its share of all labelled rows.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no labelled rows at all every text is
``und``; ties go to the language first by code point; repeated rows are scored each; other columns pass through where
asked for, and clashing ones are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checked_broadcast, free_name, map_text, materialize

MAX_N = 4
BUCKETS = 1 << 15
TRAIN_ROWS = 60_000
LEAST_ROWS = 100
#: Languages scored together, and counts times languages worked on at a time.
SLICE = 256
WORK = 1 << 21
#: Languages with their shares are broadcast up to this many rows; more are joined by shuffling.
BROADCAST_LANGUAGES = 50_000
SMOOTHING = 0.05
UNDETERMINED = "und"

_CHUNK = 1 << 20
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngram_buckets(text: str) -> np.ndarray | None:
    """Counts of the text's n-grams by bucket; ``None`` if it has no letter."""
    counts, seen, table = np.zeros(BUCKETS, np.int64), False, _letters()
    text = f" {text.lower()} "
    tail, after_letter = np.zeros(0, np.uint64), True
    for at in range(0, len(text), _CHUNK):  # bounded memory for very long texts; the tail carries n-grams over the cut
        points = np.frombuffer(text[at : at + _CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = table[points]
        seen = seen or bool(letter.any())
        clean = np.where(letter, points, 32)[letter | np.r_[after_letter, letter[:-1]]].astype(np.uint64)
        points, known, after_letter = np.r_[tail, clean], len(tail), letter[-1]
        code, found = np.zeros(len(points), np.uint64), []
        for n in range(min(MAX_N, len(points))):
            code = code[: len(points) - n] * np.uint64(0x9E3779B97F4A7C15) + points[n:] + np.uint64(n + 1)
            found.append((code[max(0, known - n) :] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49))
        if found:
            counts += np.bincount(np.concatenate(found).view(np.int64), minlength=BUCKETS)
        tail = points[-(MAX_N - 1) :]
    return counts if seen else None


class Model(NamedTuple):
    """The learnt languages in the order of code points, their log priors, and the counts (who, what, n) by language and bucket, which stay on the cluster."""

    langs: list[str]
    prior: np.ndarray
    counts: DataFrame | None

    def matrix(self, first: int, last: int) -> np.ndarray:
        """Log-probabilities of the languages from ``first`` up to ``last``, a row for each bucket."""
        sums = np.zeros((BUCKETS, last - first))
        got = self.counts.where(F.col("who").between(first, last - 1)).toPandas()
        sums[got["what"].to_numpy(np.int64), got["who"].to_numpy(np.int64) - first] = got["n"].to_numpy(np.float64)
        return (np.log(sums + SMOOTHING) - np.log(sums.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_rows: int = TRAIN_ROWS) -> Model:
    """Learns from the rows with a language and a text."""
    lang, text = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`")
    chance = F.xxhash64(*[F.col(f"`{c}`") for c in labelled.columns]).bitwiseAND(F.lit((1 << 63) - 1))
    rows = labelled.select(text.alias("text"), lang.alias("lang"), chance.alias("chance")).where("text is not null and lang is not null")
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(known, key=lambda x: x.encode())
    if not langs:
        return Model([], np.zeros(0), None)
    each = max(LEAST_ROWS, max_rows // len(langs))
    shares = [(x, k, min((1 << 63) - 1, each * ((1 << 63) - 1) // known[x])) for k, x in enumerate(langs)]
    shares = labelled.sparkSession.createDataFrame(shares, "lang string, who long, share long")
    rows = rows.join(checked_broadcast(shares, BROADCAST_LANGUAGES), "lang").where("chance <= share").select("text", "who")

    def count(batches):
        sums: dict[int, np.ndarray] = {}

        def done():
            for who, n in sums.items():
                what = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(what), who)), pa.array(what), pa.array(n[what])], names=["who", "what", "n"])
            sums.clear()

        for batch in batches:
            for text, who in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (counts := ngram_buckets(text)) is not None:
                    sums[who] = sums[who] + counts if who in sums else counts
            if len(sums) > SLICE:
                yield from done()
        yield from done()

    counted = rows.mapInArrow(count, "who long, what long, n long").groupBy("who", "what").agg(F.sum("n").alias("n"))
    total = sum(known.values())
    return Model(langs, np.log(np.array([known[x] for x in langs], float) / total), materialize(counted, "ngrams"))


def score_batch(texts: list[str | None], prior: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Log-likelihood with prior of each text and language; not a number where a text is null or has no letter."""
    logs = np.full((len(texts), len(prior)), np.nan)
    places, counts, owners, held = [], [], [], 0

    def done():
        starts = np.cumsum([0, *map(len, places)])[:-1]
        sums = np.add.reduceat(np.concatenate(counts)[:, None] * matrix[np.concatenate(places)], starts, axis=0, dtype=np.float64)
        logs[owners] = sums + prior
        places.clear()
        counts.clear()
        owners.clear()

    for i, text in enumerate(texts):
        found = ngram_buckets(text) if text else None
        if found is None:
            continue
        at = np.flatnonzero(found)
        places.append(at)
        counts.append(found[at].astype(np.float32))
        owners.append(i)
        held += len(at) * len(prior)
        if held >= WORK:
            done()
            held = 0
    if places:
        done()
    return logs


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (the posterior of the predicted language)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {"lang_pred", "score"}]
    best, top, mass = (free_name(docs.columns, x) for x in ("best", "top", "mass"))
    # Best language so far, its logarithm, and the sum of all likelihoods over its own.
    rows = docs.withColumns({best: F.lit(-1), top: F.lit(float("-inf")), mass: F.lit(0.0)})
    fields = [T.StructField("b", T.IntegerType()), T.StructField("t", T.DoubleType()), T.StructField("m", T.DoubleType())]
    for first in range(0, len(model.langs), SLICE):
        last = min(len(model.langs), first + SLICE)
        shared = docs.sparkSession.sparkContext.broadcast((model.prior[first:last], model.matrix(first, last)))

        def run(texts, befores, tops, masses, first=first, shared=shared):
            logs = score_batch(texts, *shared.value)
            b, t, m = np.array(befores), np.array(tops, float), np.array(masses, float)
            some = np.flatnonzero(~np.isnan(logs).any(axis=1))
            if len(some):
                own = logs[some]
                high = own.argmax(axis=1)
                here = own[np.arange(len(some)), high]
                with np.errstate(invalid="ignore"):
                    peak = np.maximum(t[some], here)
                    m[some] = np.where(np.isinf(t[some]), 0, m[some] * np.exp(t[some] - peak)) + np.exp(own - peak[:, None]).sum(axis=1)
                b[some] = np.where(here > t[some], high + first, b[some])
                t[some] = peak
            return [pa.array(b.astype(np.int32)), pa.array(t), pa.array(m)]

        again = list(dict.fromkeys([*keep, text_col])) if last < len(model.langs) else keep
        rows = map_text(rows, text_col, run, fields, again, [best, top, mass]).withColumnsRenamed({"b": best, "t": top, "m": mass})
    names = checked_names(docs, model, best)
    chosen = rows.join(names, best, "left") if model.langs else rows.withColumn("lang_pred", F.lit(None).cast("string"))
    pred = F.coalesce(F.col("lang_pred"), F.lit(UNDETERMINED))
    return chosen.select(*[F.col(f"`{c}`") for c in keep], pred.alias("lang_pred"), F.when(F.col(best) < 0, 0.0).otherwise(1 / F.col(mass)).alias("score"))


def checked_names(docs: DataFrame, model: Model, best: str) -> DataFrame | None:
    """The languages' names by number, broadcast if they are few."""
    if not model.langs:
        return None
    return checked_broadcast(docs.sparkSession.createDataFrame(list(enumerate(model.langs)), f"`{best}` int, lang_pred string"), BROADCAST_LANGUAGES)
