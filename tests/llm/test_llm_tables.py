"""The operators over tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and the queries."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from pyspark.sql import functions as F

from textloom.llm import bpe, html_extraction, language_id, pii, quality_rules, queries, simhash_dedup, source_mixing, suffix_tree_lm, token_counts, vector_search
from textloom.llm._common import prepare, read_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, ids string, fp string, score string, pii string, n_tokens string, lang_pred string"
LONG = " ".join(f"word{i % 977} and more" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    tail = (None, "x", "y", "z", "p", "q", "r")
    same = "one two three four five six seven eight nine ten eleven"
    rows = [
        (0, None, None, None), (1, "", "en", "a"), (2, "  \n\t ", "en", "a"), (3, same, "en", "a"), (3, same, "en", "a"), (4, same.upper(), "de", None),
        (5, LONG, "de", "b"), (None, "der die das und ist nicht", "de", "b"), (6, "a@b.c\n\na@b.c " * 3, None, ""), (7, "日本語 текст ß", "xx", "c"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *tail) for i, t, lang, s in rows], SCHEMA.replace("kept boolean", "kept string"))


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false").checkpoint() if False else odd.where("1 = 0")


def test_quality(spark, odd, none):
    got = quality_rules.judge_documents(odd)
    rows = got.collect()
    assert len(rows) == 10 and [f for f in got.columns if f == "kept"] == ["kept"]
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["base_failed"] and not by[0]["kept"] and by[3]["n_words"] == 11 and not by[3]["base_failed"]
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality_rules.judge_documents(none).count() == 0


def test_quality_refuses_a_bad_host_only(spark):
    good = " ".join(f"w{k}" for k in range(40))
    rows = [(i, "bad" if i < 300 else f"h{i % 20}", "no" if i < 290 else f"{good} {i}") for i in range(900)]
    got = quality_rules.judge_documents(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert not any(kept[i] for i in range(300)) and all(kept[i] for i in range(300, 900))


def test_a_strict_host_rejects_what_fails_its_rule(spark):
    """Pages of symbols go where many of the host's pages have them, and stay at other hosts."""
    words = " ".join(f"word{k}" for k in range(40))
    rows = [(i, f"h{i % 20}", f"{words} {i}" + (" " + "#$%" * 60 if (i % 20 == 3 and i < 600) or i % 97 == 0 else "")) for i in range(2000)]
    got = {r["doc_id"]: r for r in quality_rules.judge_documents(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    gone = {i for i, r in got.items() if not r["kept"]}
    assert gone == {i for i, _, t in rows if "#" in t and i % 20 == 3}


def test_kept_documents_keep_their_columns(spark, odd):
    rows = [(i, "a", " ".join(f"w{k}" for k in range(20)) if i else "no", 777, "x", 5) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_words long, kept string, c0 int")
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(rows[1:])
    assert quality_rules.kept_documents(odd).columns == odd.columns


def test_host_verdicts_change_results(spark):
    """On the given documents some rows are rejected by their host only."""
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    rows = queries.op9_quality_rules(spark, path)
    assert rows.where("not kept and not base_failed").count() > 0 and rows.where("kept").count() > 8000


def test_host_prior_is_bounded():
    for k, n, f, v in ((0, 0, 0, None), (1, 5, 5, None), (3, 10, 0, 0.0), (3, 10, 5, 0.2), (3, 10, 10, float("nan"))):
        a, b = quality_rules.fit_prior(k, n, f, v)
        assert 0 < a and 0 < b and a + b <= 1000.0001


def test_pii(odd, none):
    rows = pii.pii_digest(odd).collect()
    assert len(rows) == 10
    mail = next(r for r in rows if r["doc_id"] == 6)
    text = "a@b.c\n\na@b.c " * 3
    want = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"a@b\.c", text))
    assert mail["n_email"] == 6 and mail["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and mail["spans"] == want
    assert next(r for r in rows if r["doc_id"] == 0)["spans"] == ""
    red = pii.redact_documents(odd)
    assert red.columns == odd.columns and next(r for r in red.collect() if r["doc_id"] == 6)["text"].count("[EMAIL]") == 6
    assert pii.pii_digest(none).count() == 0


def test_bpe_round_trip(spark, odd, none):
    voc = bpe.load_vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    both = bpe.decode_documents(bpe.encode_documents(odd, voc), voc).collect()
    digest = {r["doc_id"]: r for r in bpe.coding_digest(odd, voc).collect()}
    for r in both:
        d = digest[r["doc_id"]]
        assert d["n_tokens"] == len(r["ids"])
        assert d["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert d["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.coding_digest(none, voc).count() == 0


def test_token_counts(spark, odd, none):
    ranks = token_counts.load_ranks(spark, public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    counter = token_counts.Counter(*ranks.value)
    for r in token_counts.count_with_edits(odd, ranks, keep=["doc_id", "text"]).collect():
        text = r["text"] or ""
        assert r["n_tokens"] == sum(map(counter.tokens, counter.cut(text)))
        for a, b, put in token_counts.cleaning_edits(text):
            text = text[:a] + put + text[b:]
        assert r["n_tokens_after"] == sum(map(counter.tokens, counter.cut(text)))
    assert token_counts.count_with_edits(none, ranks).count() == 0


def test_language(spark, odd, none):
    model = language_id.train(odd)
    got = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[0]["score"] == 0.0
    assert got[3]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    empty = language_id.train(none)
    assert {r["lang_pred"] for r in language_id.predict(odd, empty).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0


def test_language_bound_is_kept(spark):
    rows = spark.createDataFrame([(f"text number {i} de la", "fr") for i in range(4000)] + [("ein seltener Satz", "de")], "text string, lang string")
    model = language_id.train(rows, max_rows=500)
    assert model.langs == ["de", "fr"] and np.allclose(np.exp(model.matrix(0, 2)).sum(axis=0), 1, atol=1e-3)
    spaces = {r["who"]: r["n"] for r in model.counts.where(F.col("what") == int(np.flatnonzero(language_id.ngram_buckets("x") * (np.arange(language_id.BUCKETS) == naive_bucket(" ")))[0])).collect()}
    assert 100 < spaces[1] / 6 < 500 and spaces[0] >= 4  # a share of the many, all of the few


def naive_bucket(gram):
    code, whole = 0, (1 << 64) - 1
    for n, c in enumerate(gram, 1):
        code = (code * 0x9E3779B97F4A7C15 + ord(c) + n) & whole
    return (code * 0xD6E8FEB86659FD93 & whole) >> 49


def test_languages_by_naive_bayes(spark):
    """Any number of languages, ties and rare ones, against the formula over dictionaries of n-grams."""
    rng = np.random.default_rng(1)
    word = lambda k: "".join(chr(97 + c) for c in np.random.default_rng(k).integers(0, 26, 5))
    texts = [(f"l{k:03}", " ".join(word(10 * k + j) for j in rng.integers(0, 10, 12))) for k in range(300) for _ in range(1 + k % 2)]
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts)] + [(9000 + i, t, lang) for i, (_, t) in enumerate(texts[:2]) for lang in ("tie a", "tie b")]
    docs = prepare(spark).createDataFrame([(*r, "x", 0) for r in rows] + [(9999, "1 2 3", None, "x", 0), (9998, None, "l001", "x", 0)], "doc_id long, text string, lang string, best string, score int")

    def grams(text):
        clean = re.sub(r"[^a-z]+", " ", f" {text.lower()} ")
        return Counter(naive_bucket(clean[i : i + n]) for n in range(1, 5) for i in range(len(clean) - n + 1))

    sums, n = {}, Counter(lang for _, _, lang in rows)
    for _, t, lang in rows:
        sums.setdefault(lang, Counter()).update(grams(t))
    masses = {x: sum(c.values()) for x, c in sums.items()}

    def logs(text):
        g = grams(text)
        return {x: math.log(n[x] / len(rows)) + sum(c * math.log((sums[x][b] + 0.05) / (masses[x] + 0.05 * language_id.BUCKETS)) for b, c in g.items()) for x in sums}

    got = {r["doc_id"]: r for r in language_id.predict(docs, language_id.train(docs, max_rows=10**6), keep=["doc_id", "best"]).collect()}
    assert len(got) == docs.count() - 2 and {got[9999]["lang_pred"], got[9998]["lang_pred"]} == {"und"}
    for i, t, _ in rows[::23] + rows[-4:]:
        want = logs(t)
        top = max(want.values())
        assert got[i]["lang_pred"] == min(x for x, v in want.items() if v > top - 1e-6)
        assert got[i]["score"] == pytest.approx(1 / sum(math.exp(v - top) for v in want.values()), rel=1e-3)


def brute_components(rows):
    fps = [simhash_dedup.fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {}
    for (d, _), c in zip(rows, comp):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return sorted((str(d), f"{f:016x}", str(least.get(c))) for (d, _), f, c in zip(rows, fps, comp))


def near_copies(n=120):
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in rng.integers(0, 5000, 200)]
    rows = [(1000 - i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :])) for i, k in enumerate(rng.integers(0, 200, n))]
    return rows + [(i, " ".join(f"v{k}" for k in rng.integers(0, 5000, 60))) for i in range(60)] + [(2000, None), (2001, ""), (None, ""), (1000, rows[0][1])]


@pytest.mark.parametrize("hot", [2048, 8])
def test_near_duplicates(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash_dedup, "HOT_BUCKET", hot)
    rows = near_copies()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int")
    got = simhash_dedup.near_duplicates(docs).select("doc_id", simhash_dedup.hex_fingerprint().alias("f"), "component_id").collect()
    assert sorted((str(a), f, str(c)) for a, f, c in got) == brute_components(rows)


def one_of_each(rows, id_at=0, text_at=1):
    """Rows that stay, by all pairs: of each class the first by id, nulls last, once."""
    rows = list(dict.fromkeys(rows))
    fps = [simhash_dedup.fingerprints(r[text_at], simhash_dedup.STAGE_SHINGLE, words=simhash_dedup.STAGE_WORDS) for r in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (np.bitwise_count(fps[i] ^ fps[j]) <= simhash_dedup.STAGE_BITS).any():
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    return [[r for r, c in zip(rows, comp) if c == k] for k in dict.fromkeys(comp)]


@pytest.mark.parametrize("hot", [2048, 8])
def test_one_of_each_stays(spark, odd, none, monkeypatch, hot):
    monkeypatch.setattr(simhash_dedup, "HOT_BUCKET", hot)
    far = [" ".join(f"{c}{k}" for k in range(50)) for c in "abc"]
    odd_rows = [(5, far[0]), (5, far[1]), (3, far[1]), (6, far[2]), (6, far[2]), (None, far[2]), (None, "only here, with no id at all"), (None, None), (7, "")]
    rows = [*near_copies(40), *odd_rows]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, row_key string, fps int")
    kept = simhash_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    classes = one_of_each(rows)
    assert sum(got.values()) == len(classes)
    for c in classes:
        ids = [d for d, _ in c if d is not None]
        stays = [r for r in c if got[r]]
        assert len(stays) == 1 and got[stays[0]] == 1 and (not ids or stays[0][0] == min(ids))
    assert simhash_dedup.keep_one_of_each(odd).where("doc_id = 3").count() == 1
    assert simhash_dedup.keep_one_of_each(none).count() == 0
    assert simhash_dedup.near_duplicates(none).count() == 0


def test_stage_finds_copies_that_differ(spark):
    """Copies of five-word shingles about 0.9 alike are nearly all found, those 0.6 alike are left alone."""
    rng, rows = np.random.default_rng(8), []
    for i in range(150):
        base = [f"w{k}" for k in rng.integers(0, 20_000, 200)]
        rows.append((10 * i, " ".join(base)))
        for more, cut in ((1, 2), (2, 10)):
            text = base.copy()
            for k in rng.choice(200, cut, replace=False):
                text[k] = f"z{rng.integers(0, 20_000)}"
            rows.append((10 * i + more, " ".join(text)))
    kept = {r["doc_id"] for r in simhash_dedup.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(10 * i + 1 in kept for i in range(150)) <= 30 and sum(10 * i + 2 in kept for i in range(150)) >= 140


def test_chain_of_links_is_one_class(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "src long, dst long")
    got = {r["node"]: r["root"] for r in simhash_dedup.connect(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert simhash_dedup.connect(links.where("src < 0")).count() == 0


def test_mixing(spark, odd, none):
    plan = source_mixing.plan_mix(odd)
    pieces = source_mixing.mix_pieces(plan, block_words=64, shard_blocks=16)
    got = source_mixing.taken_words(plan, pieces).collect()
    assert len(got) == 10
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
    sources = {(r["source_size"], r["target"]) for r in got}
    assert sum(t for _, t in sources) == pytest.approx(sum(r["size"] for r in got))
    for size, target in sources:
        assert sum(r["taken"] for r in got if (r["source_size"], r["target"]) == (size, target)) == pytest.approx(target, abs=1)
    assert sorted(map(str, got)) == sorted(map(str, source_mixing.taken_words(source_mixing.plan_mix(odd), pieces).collect()))
    spans = sorted((r["rank"], r["leaf"], r["seq"], r["copy"], r["from_word"], r["to_word"]) for r in pieces.collect())
    assert all(a[:4] != b[:4] or a[5] <= b[4] for a, b in zip(spans, spans[1:]))
    assert source_mixing.mixed_documents(odd).columns == odd.columns
    assert source_mixing.mixed_documents(none).count() == 0


def test_shards_hold_equal_blocks(spark):
    targets = spark.createDataFrame([(0, 3000.0, 1000), (1, 0.0, 0), (2, 900.5, 900)], "rank int, target double, source_size long")
    dealt = source_mixing.deal_blocks(targets, block_words=10, shard_blocks=50).collect()
    assert len(dealt) == 390 == len({(r["rank"], r["place"]) for r in dealt})
    sizes = Counter(r["shard"] for r in dealt)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    share = Counter(r["shard"] for r in dealt if r["rank"] == 2)
    assert sum(share.values()) == 90 and len(set(share.values())) > 1  # drawn, not dealt evenly


def test_words_between(spark):
    df = spark.createDataFrame([("  a\n b\tc",)], "t string")
    cut = lambda a, b: df.select(source_mixing.words_between(F.col("t"), F.lit(a), F.lit(b))).first()[0]
    assert cut(0, 2) == "  a\n b" and cut(1, 3) == "b\tc" and cut(2, 3) == "c"


def shuffled(x, n, name):
    """The swap-or-not shuffle, restated."""
    for i in range(source_mixing.ROUNDS):
        key = int(hashlib.md5(f"{name}:{i}".encode()).hexdigest()[:12], 16) % n
        partner = (key - x) % n
        if hashlib.md5(f"{name}:{i}:{max(x, partner)}".encode()).hexdigest()[0] >= "8":
            x = partner
    return x


@pytest.mark.parametrize("n", [1, 2, 7, 24, 168, 1000])
def test_blocks_are_permuted(spark, n):
    rows = [r[0] for r in spark.range(n).selectExpr(source_mixing.shuffled_sql("id", str(n) + "L", "'17:3:0'")).collect()]
    assert rows == [shuffled(x, n, "17:3:0") for x in range(n)] and sorted(rows) == list(range(n))
    if n > 100:
        steps = Counter((b - a) % n for a, b in zip(rows, rows[1:]))
        assert len(steps) > n / 8  # no fixed stride


def brute_mix(rows, block):
    """(text or part of it) as often as the mix has it, for (id, text, source) rows, without shards."""
    size = lambda t: len((t or "").encode().split())
    text_md5 = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size(r[1]) for r in rows if r[2] == s) for s in names]
    target, fixed = [0.0] * len(names), set()
    while True:
        weight = sum(1 + k % 3 for k in range(len(names)) if k not in fixed)
        rest = sum(sizes) - sum(3 * sizes[k] for k in fixed)
        over = {k for k in range(len(names)) if k not in fixed and (1 + k % 3) * rest / weight > 3 * sizes[k]}
        target = [3.0 * sizes[k] if k in fixed else (1 + k % 3) * rest / weight for k in range(len(names))]
        if not over:
            break
        fixed |= over
    out = Counter()
    for rank, s in enumerate(names):
        if not sizes[rank]:
            continue
        words, at = math.floor(target[rank]), 0
        passes, rest = divmod(words, sizes[rank])
        order = sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"17:{'' if r[0] is None else r[0]}:{text_md5(r[1])}".encode()).hexdigest())
        blocks, taken = sizes[rank] // block, set()
        for w in range(sizes[rank]):
            b = w // block
            own = shuffled(b, blocks, f"17:{rank}:{passes}") if b < blocks else blocks
            if own < rest // block or own == rest // block and w % block < rest % block:
                taken.add(w)
        for r in order:
            found, n = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", r[1] or ""), size(r[1])
            out[(r[0], r[1], r[2])] += passes * (n > 0)
            run = []
            for k in range(n + 1):
                if k < n and at + k in taken:
                    run.append(k)
                elif run:
                    whole = len(run) == n
                    text = r[1] if whole else "".join(found[run[0] : run[-1] + 1])
                    out[(r[0], text if whole or not run[0] else text.lstrip(" \t\n\v\f\r"), r[2])] += 1
                    run = []
            at += n
    return +out


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_mixed_documents(spark, monkeypatch, block):
    """Rows without ids, rows that share an id, equal rows and clashing names: every row gives what the plan takes of it."""
    monkeypatch.setattr(source_mixing.mix_pieces, "__defaults__", (block, 4, 3, 17))
    rng = np.random.default_rng(block)
    text = lambda n: "  " * (n % 2) + " \n".join(f"w{x}" for x in rng.integers(0, 99, n))
    same = text(30)
    rows = [(None, text(50), "a"), (1, text(5), "a"), (1, text(100), "a"), (2, text(45), "a"), (3, same, "b"), (3, same, "b"), (4, None, "b"), (5, "", None), (6, text(400), "c"), (None, text(9), None), (None, None, None)]
    docs = spark.createDataFrame([(i, t, s, 7) for i, t, s in rows], "doc_id long, text string, source string, shard int")
    mixed = source_mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
    assert got == brute_mix(rows, block)


def test_shares_above_the_cap_are_given_to_others(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 10)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_mixing.source_targets(sources).collect()}
    assert got["b"] == got["c"] == got[None] == 30.0 and got["a"] == pytest.approx(940)


def test_lm(spark, odd, none):
    rows = suffix_tree_lm.score_documents(odd).collect()
    assert len(rows) == 10 and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    texts = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    fold = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 5 == 1
    count = Counter()
    for d, t in texts:
        if not fold(d):
            count.update([*(t or "").encode().lower().split(), 0])
    n, v = sum(count.values()), len(count)
    for (d, t), r in zip(sorted(texts, key=str), sorted(rows, key=lambda r: str((r["doc_id"], next(t for a, t in texts if a == r["doc_id"]))))):
        words = [*(t or "").encode().lower().split(), 0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(words), sum(count[w] > 0 for w in words), n, fold(d))
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
    assert suffix_tree_lm.score_documents(none).count() == 0


def _suffix_tree_scores(texts, depth, least, entry, cut):
    """Scores by dictionaries of n-grams, and the states' numbers by length."""
    m = suffix_tree_lm
    grams, docs = [Counter() for _ in range(depth + 2)], []
    for i, text in texts:
        w = [*(text or "").encode().lower().split(), None]
        docs.append((i, w))
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for k in range(len(w)):
                for n in range(1, min(depth + 1, k + 1) + 1):
                    grams[n][tuple(w[k + 1 - n : k + 1])] += 1
    total, distinct = sum(grams[1].values()), len(grams[1])
    follow = {}
    for n in range(2, depth + 2):
        for g, c in grams[n].items():
            if c >= entry:
                follow.setdefault(g[:-1], {})[g[-1]] = c
    states = {}

    def prob(before, w, most):
        p = (grams[1][(w,)] + 0.5) / (total + 0.5 * (distinct + 1)) if total else 1.0
        for k in range(1, min(most, len(before)) + 1):
            if (s := before[len(before) - k :]) in states:
                spare, c = states[s]
                p = (follow[s].get(w, 0) + (spare + m.BACKOFF) * p) / (c + m.BACKOFF)
        return p

    for n in range(1, depth + 1):
        new = {}
        for g, c in grams[n].items():
            if c >= least and g in follow:
                known = mass = held = 0.0
                for w, t in follow[g].items():
                    q = -round(-m.GRAIN * math.log(prob(g, w, n - 1))) / m.GRAIN
                    known, mass, held = known + t * (math.log(t / c) - q), mass + math.exp(q), held + t
                rest = c - held
                if known + (rest * math.log(rest / c / max(1 - mass, 1e-12)) if rest else 0) >= cut:
                    new[g] = (rest, c)
        states.update(new)
    scores = {i: sum(math.log10(prob(tuple(w[max(0, k - depth) : k]), w[k], depth)) for k in range(len(w))) for i, w in docs}
    return scores, Counter(map(len, states)), states, follow


@pytest.mark.parametrize("rules", [(4, 2, 2, 4.0, 1 << 24), (3, 3, 2, 1.0, 40), (1, 2, 2, 9.0, 1 << 24)])
def test_lm_scores_by_the_tree(spark, sf, rules):
    """Whole texts against dictionaries, in many blocks that share words and pairs; with contexts dealt to several parts, too."""
    depth, least, entry, cut, hot = rules
    docs = read_table(prepare(spark), sf, "documents")
    want, sizes, _, _ = _suffix_tree_scores([tuple(r) for r in docs.select("doc_id", "text").collect()], depth, least, entry, cut)
    assert set(sizes) == set(range(1, depth + 1))
    blocks = suffix_tree_lm.cut_blocks(docs.repartition(3).select("doc_id", "text", suffix_tree_lm.held_out("doc_id", 5, 1).alias("h")), "doc_id", "text", "h", 40_000)
    tree = suffix_tree_lm.learn(blocks, depth, least, entry, cut, hot)
    assert blocks.table.count() > 6 and (any(len(x) for x, _ in tree.hot) == (hot == 40))
    for r in suffix_tree_lm.score_blocks(blocks, tree, "doc_id").collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-9)


def test_least_count_of_a_context_is_fixed(spark):
    """What follows a pair seen twice is told from chance, however many other words the corpus has."""
    for others in (10, 300):
        rows = [(i, f"alpha beta gamma u{i} v{i}") for i in (0, 2)] + [(100 + i, " ".join(f"x{(i * 400 + k) % 20_011}" for k in range(400))) for i in range(others)]
        docs = prepare(spark).createDataFrame([*rows, (5, "alpha beta gamma"), (6, "beta alpha gamma")], "doc_id long, text string")
        got = {r["doc_id"]: r for r in suffix_tree_lm.score_documents(docs).collect()}
        assert got[5]["base_score"] == got[6]["base_score"] and got[5]["score"] > got[6]["score"] + 1


def test_states_follow_the_input_and_sum_to_one(spark):
    rng, found = np.random.default_rng(3), []
    for size in (200, 800):
        texts = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 60) if k < 5000)) for i in range(size)]
        _, sizes, states, follow = _suffix_tree_scores(texts, 2, 2, 2, 4.0)
        found.append(sum(sizes.values()))
        assert all(sum(follow[s].values()) + spare == c for s, (spare, c) in states.items())
    assert found[1] > found[0] > 0


def test_packed_arrays():
    for a in ([], [5], [-(1 << 63), (1 << 63) - 1, 0], list(range(70_000))):
        got = suffix_tree_lm.unpack(suffix_tree_lm.pack(np.array(a, np.int64), np.array([7])))
        assert got[0].tolist() == a and got[1].tolist() == [7]


def test_contexts_help_on_held_out_texts(spark, sf):
    rows = [r for r in queries.op6_suffix_tree_lm(spark, sf).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) >= sum(r["base_score"] for r in rows)


def test_search(spark):
    prepare(spark)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 16)).astype(np.float32).astype(float)
    x[200:400] = x[200]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (1000, [0.0] * 16, 0), (1100, [math.nan] * 16, 0), (1200, [1.0, 2.0], 0), (5, x[5].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in vector_search.search(table).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 700, 100))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and q not in {v for _, v, _ in found}
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        hits += len(set(best) & {v for _, v, _ in found})
        assert all(s == pytest.approx(d[v], abs=1e-9) for _, v, s in found)
    assert [v for _, v, _ in sorted(got[200])] == list(range(201, 211)) and [v for _, v, _ in sorted(got[300])] == list(range(200, 210))
    assert hits >= 0.9 * 70
    assert vector_search.search(table.where("vec_id < 0")).count() == 0
    few = vector_search.search(table.where("vec_id in (0, 1, 2)")).collect()
    assert {(r["query_id"], r["vec_id"]) for r in few} == {(0, 1), (0, 2)}


def test_search_takes_every_row(spark):
    """Ids that several rows share, equal rows, equal vectors and vectors of two lengths, against all pairs of rows."""
    rng = np.random.default_rng(2)
    rows = [(i % 7 * 100 if i % 3 else i, rng.integers(0, 3, 4).astype(float).tolist()) for i in range(60)] + [(100, [1.0, 2.0]), (200, [1.0, 2.0]), (200, [1.0, 2.0]), (3, [4.0, 2.0]), (None, [1.0, 1.0])]
    table = prepare(spark).createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in vector_search.search(table).collect())
    part = [(i, np.array(v)) for i, v in rows if i is not None and any(v)]
    want = Counter()
    for at, (q, v) in enumerate(part):
        if q % 100 == 0:
            near = sorted((float(np.linalg.norm(w - v)), i) for k, (i, w) in enumerate(part) if k != at and len(w) == len(v))[:10]
            want.update((q, rank, i, round(d, 9)) for rank, (d, i) in enumerate(near, 1))
    assert got == want


def test_search_recall_on_the_given_vectors(spark, sf):
    rows = read_table(prepare(spark), sf, "embeddings").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found = queries.op10_vector_search(spark, sf).collect()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.linalg.norm(x - x[ids == q][0], axis=1)
        best = [ids[i] for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits += len(set(best) & {r["vec_id"] for r in found if r["query_id"] == q})
        total += len(best)
    assert hits / total >= 0.9


def test_pages(spark):
    rows = [(1, "u", None, "t", 1), (2, "u", "", "t", 1), (2, None, "<p>x", None, None), (3, "u", "<p>" + "long text. " * 50_000, "t", 1)]
    got = html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long"), keep=["page_id", "url"]).collect()
    assert [r["text"] for r in got[:2]] == ["", ""] and all(r["n_chars"] == len(r["text"]) for r in got)


def test_extraction_over_all_pages(spark, sf):
    """The query over the whole table, against the blocks inside each page's article element."""
    html = {r["page_id"]: (r["url"], r["html"]) for r in read_table(prepare(spark), sf, "pages").collect()}
    rows = queries.op1_html_extraction(spark, sf).collect()
    assert sorted((r["page_id"], r["url"]) for r in rows) == sorted((i, u) for i, (u, _) in html.items())
    right = 0
    for r in rows:
        page = html[r["page_id"]][1] or ""
        article = re.search(r"<article[^>]*>(.*?)</article>", page, re.S)
        want = "\n\n".join(b.text for b in html_extraction.leaf_blocks(article.group(1) if article else ""))
        right += r["text"] == want
        assert r["n_chars"] == len(r["text"])
    assert right >= 0.99 * len(rows)


def test_language_accuracy_on_held_out_texts(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in read_table(spark, sf, "documents").collect()}
    held = [r for r in queries.op2_language_id(spark, sf).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


@pytest.mark.parametrize("name", ["op3_source_mixing", "op9_quality_rules"])
def test_queries_with_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf)
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    at = [want.columns.index(c) for c in names]
    assert sorted(tuple(str(r[c]) for c in names) for r in got.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
