"""The corpus pipeline against a plain restatement of its stages."""

from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers

from textloom.llm import bpe, pii, quality_rules, simhash_dedup
from textloom.llm._common import prepare, read_table

from test_llm_tables import brute_mix, one_of_each


@pytest.fixture(scope="module")
def coder():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return bpe.WordBpe(f.read())


def after(rows, good, coder):
    """Rows (doc_id, source, ids, decoded) of the stages behind the quality rules, from (id, text, source, ...) rows of those that ``good`` keeps."""
    kept = [min(c, key=lambda r: (r[0] is None, r[0] or 0)) for c in one_of_each([r for r in rows if good(r)])]
    mixed = brute_mix([(r[0], pii.redact(r[1]), r[2]) for r in kept], 4096)
    out = Counter()
    for (i, text, source), n in mixed.items():
        ids = coder.encode(text)
        out[(i, source, tuple(ids), coder.decode(ids))] += n
    return out


def result(df):
    return Counter((r["doc_id"], r["source"], tuple(r["ids"]), r["decoded"]) for r in df.collect())


def run_on(spark, docs):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        names = docs.columns
        docs = stage(spark, docs, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
            docs = corpus_pipeline.materialize(docs, "stage")
    return docs


def test_pipeline(spark, sf, coder):
    docs = read_table(prepare(spark), sf, "documents")
    keeps = {r["doc_id"] for r in quality_rules.judge_documents(docs).where("kept").collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    want = after(rows, lambda r: r[0] in keeps, coder)
    assert len(keeps) > 150 and sum(want.values()) > 100
    assert result(corpus_pipeline.run(spark, sf)) == want


def test_odd_rows(spark, coder):
    """Null ids, ids that several texts share, equal rows, null texts and sources, and columns with the operators' own names."""
    text = lambda a, n=30: " ".join(f"{a}{k}" for k in range(n))
    rows = [
        (None, text("a", 50), "s"), (None, text("b"), "s"), (1, text("c", 12), "s"), (1, text("d", 200), "s"), (5, text("e"), None), (3, text("e"), None),
        (5, text("f"), "t"), (6, text("g"), "t"), (6, text("g"), "t"), (7, None, "t"), (8, "", None), (9, text("h") + " mail a.b@example.org now", "u"), (None, None, None),
    ]
    docs = spark.createDataFrame([(*r, 777, "no", 1, "x") for r in rows], "doc_id long, text string, source string, n_words long, kept string, lang int, shard string")
    got = run_on(spark, docs)
    assert result(got) == after(rows, lambda r: not quality_rules.measure(r[1])[5], coder)
    assert {r["doc_id"] for r in got.collect()} >= {1, 3, 5, 6, 9}
    assert run_on(spark, docs.where("1 = 0")).count() == 0


def test_encoding_takes_one_worker_a_task(spark, coder):
    import public_tokenizers

    from textloom.llm import bpe

    rows = [(1, "s", "en", "The  Café\n<unk> x"), (2, None, None, None), (None, "s", "de", ""), (4, "s", "en", "word " * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    found = corpus_pipeline.encoded(spark, docs, "")
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    vocabulary = bpe.load_vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    apart = bpe.decode_documents(bpe.encode_documents(docs, vocabulary, keep=["doc_id", "source", "lang"]), vocabulary)
    assert sorted(map(str, found.drop("n_tokens").collect())) == sorted(map(str, apart.collect()))
    assert all(r["n_tokens"] == len(r["ids"]) for r in found.collect())


def test_workers_let_go_what_other_operators_left(coder):
    from textloom.llm import _common, bpe, pii

    bpe._LOADED[1] = coder
    list(pii.anchors("a@b"))
    _common.let_go("textloom.llm.bpe")
    assert bpe._LOADED == {1: coder} and not pii._AUTO
    _common.let_go("textloom.llm.simhash_dedup")
    assert not bpe._LOADED and pii.find_spans("a@b.de")["email"] == [(0, 6)]
