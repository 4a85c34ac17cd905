"""Quality rules with host-level verdicts.

Each document is measured by a few rules. One, the base rule, rejects a document by itself; what fails only another
(``RULES``) is rejected if its host is known for it. Failures of each rule are added up by host, each host's failure rate
is shrunk towards the rate of all hosts by a beta prior fitted to the hosts themselves (method of moments), and the
verdicts go back to the documents. A host is strict on a rule if its shrunk rate is above the mean of the hosts' shrunk
rates by more than their standard deviation. All of a host is refused only if its shrunk rate of base failures, less two posterior
standard deviations, is above ``HOST_LIMIT``: a few bad pages refuse no host, and a small host needs more than a bad start.

Defined cases: a null text is a text without words (it fails); a null host is a host of its own; repeated rows are
measured and counted as often as they occur; an empty table gives an empty result; columns besides those used pass
through, and a column that clashes with a new one is replaced by the new one (:func:`kept_documents` returns the input's own columns only).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checked_broadcast, free_name, map_text, materialize

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
HOST_LIMIT = 0.5
#: Hosts under verdict are broadcast up to this many rows; more are joined by shuffling.
BROADCAST_HOSTS = 50_000
#: Rules that reject a document only where its host is strict, as SQL over the measures.
RULES = {
    "many_symbols": "10 * n_symbols > word_chars",
    "repeated_lines": "20 * n_dup_lines > n_words",
    "odd_words": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
}
#: Rates nearer than this are equal.
TIE = 1e-9
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: From this many words on, windows are compared as numbers, which take less memory than tuples.
LONG = 20_000

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
]


def _pair_up(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, equal exactly for equal pairs."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of ``WINDOW`` words which occurs twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if len(words) < LONG:
        windows = list(zip(*(words[k:] for k in range(WINDOW))))
        first: dict[tuple, int] = {}
        hits = []
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                hits += (j, i)
        if not hits:
            return 0
        starts = np.zeros(n, bool)
        starts[hits] = True
    else:
        known: dict[bytes, int] = {}
        codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        code = codes[:n]
        for k in range(1, WINDOW):
            code = _pair_up(code, codes[k : k + n])
        starts = np.bincount(code)[code] > 1
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[k : k + n] |= starts
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """The rule counts of one text, and whether it fails the base rules."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeats = repeated_words(words)
    return (
        n,
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n,
    )


def measure_documents(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with the rule counts; one pass over the texts, no shuffle."""
    names = {f.name.lower() for f in FIELDS}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    return map_text(docs, text_col, lambda texts: list(zip(*map(measure, texts))) or [[] for _ in FIELDS], FIELDS, keep)


def host_verdicts(measured: DataFrame, host_col: str) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk, of base failures), refused, and strict, a struct of a flag for each of ``RULES``: one row for each host, null among them.

    The counts are summed on the map side first, so one host with a third of all rows is a few rows in the shuffle.
    """
    failed = {"n_failed": F.col("base_failed"), **{name: F.expr(rule) for name, rule in RULES.items()}}
    sums = [F.sum(c.cast("long")).alias(name) for name, c in failed.items()]
    hosts = materialize(measured.groupBy(F.col(f"`{host_col}`").alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), *sums), "host-sums")
    of = [x for name in failed for x in (F.sum(name).alias(f"f_{name}"), F.var_samp(F.col(name) / F.col("n_docs")).alias(f"v_{name}"))]
    s = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("n_docs").alias("n"), *of).first()
    priors = {name: fit_prior(s["k"], s["n"] or 0, s[f"f_{name}"] or 0, s[f"v_{name}"]) for name in failed}

    def posterior(name):
        a, b = priors[name]
        return F.col(name) + F.lit(a), F.col("n_docs") - F.col(name) + F.lit(b)

    alpha, beta = posterior("n_failed")
    total = alpha + beta
    rate = alpha / total
    refused = rate - 2 * F.sqrt(alpha * beta / (total * total * (total + 1))) > HOST_LIMIT
    shrunk = {}
    for name in RULES:
        alpha_of, beta_of = posterior(name)
        shrunk[name] = alpha_of / (alpha_of + beta_of)
    spread = hosts.agg(*[f(c).alias(f"{x}_{name}") for name, c in shrunk.items() for x, f in (("m", F.avg), ("d", F.stddev_samp))]).first()
    strict = [(c > F.lit((spread[f"m_{name}"] or 0.0) + (spread[f"d_{name}"] or 0.0) + TIE)).alias(name) for name, c in shrunk.items()]
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), refused.alias("refused"), F.struct(*strict).alias("strict"))


def fit_prior(k: int, n: int, failed: int, variance: float | None) -> tuple[float, float]:
    """Beta parameters with the mean of all documents and the spread of the hosts' rates; between 2 and 1000 documents' worth."""
    mean = min(max((failed + 0.5) / (n + 1), 1e-6), 1 - 1e-6)
    if k < 2 or variance is None or math.isnan(variance) or variance <= 0:
        weight = 1000.0 if k > 1 else 2.0
    else:
        weight = min(max(mean * (1 - mean) / variance - 1, 2.0), 1000.0)
    return mean * weight, (1 - mean) * weight


def judge_documents(docs: DataFrame, host_col: str = "source", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with rule counts, ``host_rate`` and ``kept``.

    The measured rows are written once in the shared folder (the texts only if kept), then read for the hosts' sums and
    again for the join. Only refused and rated hosts travel to the documents; a counted, small table of them is
    broadcast, a large one is joined by shuffling, where adaptive execution splits a hot host.
    """
    keep = list(dict.fromkeys([*(docs.columns if keep is None else keep), host_col]))
    new = {"host_rate", "kept"}
    measured = materialize(measure_documents(docs, text_col, [c for c in keep if c.lower() not in new]), "quality")
    key, rate, refused, strict = (free_name(measured.columns, x) for x in ("host", "host_rate", "refused", "strict"))
    verdicts = materialize(host_verdicts(measured, host_col), "hosts").select(F.col("host").alias(key), F.col("rate").alias(rate), F.col("refused").alias(refused), F.col("strict").alias(strict))
    joined = measured.join(checked_broadcast(verdicts, BROADCAST_HOSTS), F.col(f"`{host_col}`").eqNullSafe(F.col(f"`{key}`")), "left")
    bad = F.col("base_failed") | F.coalesce(F.col(f"`{refused}`"), F.lit(False))
    for name, rule in RULES.items():
        bad = bad | (F.expr(rule) & F.coalesce(F.col(f"`{strict}`")[name], F.lit(False)))
    return joined.withColumn("kept", ~bad).drop(key, refused, strict)


def kept_documents(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, whatever these are named."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    kept = judge_documents(renamed, own[host_col], own[text_col]).where("kept")
    return kept.select(*[F.col(n).alias(c) for c, n in own.items()])
