"""Queries against their SQL on small tables made for what once differed."""

import duckdb

import __spark_entry__ as entry


def differ(spark, folder, query, **tables):
    """Rows of the query that its SQL hasn't, and the other way round. ``tables``: (rows, schema)."""
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    found = entry.queries()[query](spark, str(folder))
    columns = found.columns
    plain = lambda x: tuple(plain(y) for y in x) if isinstance(x, list | tuple) else x
    ours = {plain(tuple(r)) for r in found.collect()}
    sql = {plain(r) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[query]})").fetchall()}
    return ours - sql, sql - ours


TURNS = "conv_id long, turn long, role string, text string"


def test_concepts_keep_sharp_s(spark, tmp_path):
    words = ["enkeitß und", "\ufb01ne x", "\u1fb3 y", "\u0149a", "plain", None, "", "ß"]
    rows = [(3 * k, 0, "user", w) for k, w in enumerate(words)] + [(3 * k + 1, 0, "user", w) for k, w in enumerate(words)]
    assert differ(spark, tmp_path, "atomic_concepts", conversations=(rows, TURNS)) == (set(), set())


def test_labels_keep_sharp_s_and_count_texts_about_errors(spark, tmp_path):
    texts = ["aß", "groß", "gross", "GROSS", "iß aß das", "\ufb01n \ufb01ne", "Processing error.", "na", "", None, "x"]
    rows = [(k // 2, k % 2, "user", t) for k, t in enumerate(texts)]
    assert differ(spark, tmp_path, "segment_stats", conversations=(rows, TURNS)) == (set(), set())


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_windows_of_documents_in_blocks(spark, tmp_path, monkeypatch):
    """Many small blocks, keys that come again, null keys and texts, short texts, repeated words."""
    from textloom.operators import blocks, distribution

    monkeypatch.setattr(blocks, "BLOCK_TOKENS", 20)
    monkeypatch.setattr(blocks, "BATCH_ROWS", 3)
    monkeypatch.setattr(distribution, "CELLS", 16)
    monkeypatch.setattr(distribution, "window_terms", None)  # the row for each window and term isn't made
    words = ["der", "die", "the", "Of", "el", "los", "Straße", "le", "a1", "b_2", "von", "and"]
    texts = [" ".join(words[(k * j + j // 3) % len(words)] for j in range(k % 9)) for k in range(60)]
    rows = [(k, t, ("de", "en", "es", "fr", "xx")[k % 5], "s", len(t)) for k, t in enumerate(texts)]
    rows += [(7, "die Die die von el", "de", "s", 1), (7, "die", "de", "s", 1), (8, None, "en", "s", 0), (None, "the of", "en", "s", 1), (None, "el", "es", "s", 1), (99, "", "en", "s", 0)]
    for query in ("approx_distribution", "approx_distribution_tokens", "distribution_chart", "token_heat_table"):
        assert differ(spark, tmp_path, query, documents=(rows, DOCS)) == (set(), set()), query


def test_word_vectors_in_blocks(spark, tmp_path, monkeypatch):
    """Vectors of several lengths, with nulls, empty or null; keys that come again and null keys."""
    from textloom.functions import vectors
    from textloom.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_TOKENS", 20)
    monkeypatch.setattr(blocks, "BATCH_ROWS", 3)
    monkeypatch.setattr(vectors, "mean_vectors", None)  # the row for each word and document isn't made
    rows = [(k, " ".join(f"w{(k * j) % 17}" for j in range(k % 8)), "en", "s", 1) for k in range(40)]
    rows += [(3, "w1 w1 w5", "en", "s", 1), (None, "w1 w2", "en", "s", 1), (None, "w3", "en", "s", 1), (50, None, "en", "s", 0), (51, "w0 w0 nothing", "en", "s", 0)]
    vecs = [(k, [float(k), k / 7, -1.0 * k]) for k in range(9)] + [(9, None), (10, []), (11, [1.0, None, 3.0]), (12, [2.0]), (13, [None, 0.5])]
    assert differ(spark, tmp_path, "word_vector_mean", documents=(rows, DOCS), embeddings=(vecs, "vec_id long, embedding array<float>")) == (set(), set())


def test_parts_of_a_block_are_whole_documents(monkeypatch):
    import pyarrow as pa

    from textloom.operators import blocks

    monkeypatch.setattr(blocks, "PART_TOKENS", 5)
    texts, sizes = [1, 2, 1, 1, 3], [3, 1, 4, 9, 1, 2, 2, 2]
    row = {"keys": pa.array([10, 11, 12, 13, 14]), "texts": pa.array(texts), "sizes": pa.array(sizes), "codes": pa.array(range(24)), "found": "all"}
    parts = list(blocks._parts(row))
    assert len(parts) > 2 and all(p["found"] == "all" and sum(p["texts"].to_pylist()) == len(p["sizes"]) and sum(p["sizes"].to_pylist()) == len(p["codes"]) for p in parts)
    assert all([x for p in parts for x in p[c].to_pylist()] == row[c].to_pylist() for c in ("keys", "texts", "sizes", "codes"))


def test_outliers_with_texts_of_no_language(spark, tmp_path):
    """A null language gives no topic, and its words have no part in a term's total."""
    texts = ["uno dos tres", "one two three three", "dos two", "tres tres one", "two uno", "three dos uno"]
    rows = [(k, t, ("es", "en", None)[k % 3], "s", len(t)) for k, t in enumerate(texts)]
    assert differ(spark, tmp_path, "reduce_outliers_ctfidf", documents=(rows, DOCS)) == (set(), set())
