"""The operators' cores against brute force, without Spark."""

import random
import time
import re
import string

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from textloom.llm import bpe, html_extraction, language_id, pii, quality_rules, simhash_dedup, token_counts, vector_search

ODD = "abcABC'stredvml09 \t\n\x0b\x1c\x85\xa0　Σςσİßéèüﬁ你好글😀_-!?.,%$#<|endoftext|>​́ª½\x00@+()12345"


@pytest.fixture(scope="module")
def word_bpe():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return bpe.WordBpe(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=ODD, max_size=60))
def test_bpe_is_the_librarys(word_bpe, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert word_bpe.encode(text) == ids
    assert word_bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", None, "x" * 1000, "ab" * 700, "<|endoftext|>a<|startoftext|>", "Σας ΣΑΣ", "İ"])
def test_bpe_edges(word_bpe, library, text):
    assert word_bpe.encode(text) == library.encode(text or "", add_special_tokens=False).ids


def test_bpe_scan_and_heap_agree(word_bpe):
    rng = random.Random(0)
    for _ in range(200):
        w = [word_bpe._symbols[b] for b in "".join(rng.choice("abeinrst") for _ in range(rng.randint(1, 60))).encode()]
        w[-1] += "</w>"
        assert word_bpe._scan(list(w)) == word_bpe._heap(list(w))


def base_spans(text):
    ok = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[ -]", "", m)) <= 19 and pii.luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c in string.digits for c in m) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if f(m.group())] for k, (p, f) in ok.items()}


@settings(max_examples=600, deadline=None)
@given(parts=st.lists(st.sampled_from([*"@a.-+ 0159(x\n١", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "a@b.c", "+1 (212) 555-1234", "..", "token = "]), max_size=25))
def test_pii_base_spans_are_the_patterns(parts):
    text = "".join(parts)
    found = pii.find_spans(text)
    assert {k: found[k] for k in pii.BASE_KINDS} == base_spans(text)


def test_pii_adds_logins_accounts_and_secrets():
    text = 'ftp://bob:pw@host x IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678 token = "ab8ca1b325bc4f85"'
    found = pii.find_spans(text)
    pick = lambda k: [text[a:b] for a, b in found[k]]
    assert pick("login") == ["bob:pw"]
    assert pick("account") == ["DE89 3704 0044 0532 0130 00", "12345678"]
    assert pick("secret") == ["ab8ca1b325bc4f85"]
    assert pii.redact("mail a@b.c now") == "mail [EMAIL] now" and pii.redact(None) is None and pii.redact("") == ""


def test_pii_finds_accounts_far_behind_a_cue_and_ipv6():
    cue = "IBAN of the customer, ref AB12 3456: "
    iban = "MT84 MALT 0110 0001 2345 MTLC AST0 01S"
    got = pii.find_spans(cue + iban + " thanks")["account"]
    assert [(cue + iban)[a:b] for a, b in got] == [iban]
    for text, want in (("My account is 12345678.", "12345678"), ("account number is: 998877665", "998877665")):
        assert [text[a:b] for a, b in pii.find_spans(text)["account"]] == [want]
    for text, want in (("host 2001:db8:85a3::8a2e:370:7334 up", ["2001:db8:85a3::8a2e:370:7334"]), ("at 12:30:45 std::vector a::b ::", []), ("fe80:1:2::1: and 2001:db8:0:0:0:0:0:1", ["fe80:1:2::1", "2001:db8:0:0:0:0:0:1"])):
        assert [text[a:b] for a, b in pii.find_spans(text)["ipv6"]] == want


def test_pii_leaves_clean_text_alone():
    text = "Version 1.2.3 of 2024-01-02 costs 1,234.50; see section 4.5.6 and page 12 + 3. The account of events is a secret token of thanks."
    assert not any(pii.find_spans(text).values())


def brute_repeats(words):
    n, at = len(words), {}
    for i in range(n - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)})


@settings(max_examples=200, deadline=None)
@given(words=st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40))
def test_repeated_words(words):
    want = brute_repeats(words)
    assert quality_rules.repeated_words(words) == want
    long, quality_rules.LONG = quality_rules.LONG, 1
    try:
        assert quality_rules.repeated_words(words) == want
    finally:
        quality_rules.LONG = long


def test_measure_edges():
    assert quality_rules.measure(None) == (0, 0, 0, 0, 0, True)
    assert quality_rules.measure("é b\x1cc #$\n\n x \n x ")[:4] == (4, 9, 2, 1)
    assert quality_rules.measure("x\ny\nx\n \n ")[3] == 1


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(text=st.text(alphabet="abÀ \n\x1c", max_size=60))
def test_fingerprint(text):
    assert simhash_dedup.fingerprint(text) == brute_fingerprint(text)


def parts_of(nodes, links):
    p = {x: x for x in nodes}

    def top(a):
        while p[a] != a:
            a = p[a]
        return a

    for a, b in links:
        a, b = top(a), top(b)
        p[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


@pytest.mark.parametrize("n", [2, 10, 60, 300])
def test_bucket_links_connect_what_all_pairs_connect(n):
    rng = np.random.default_rng(n)
    f = rng.integers(0, 2**63, size=6, dtype=np.int64)[rng.integers(0, 6, n)]
    for _ in range(6):
        f = f ^ (np.int64(1) << rng.integers(0, 63, n)) * rng.integers(0, 2, n)
    f = np.unique(np.where(rng.random(n) < 0.3, ~f, f))
    want = parts_of(f.tolist(), [(a, b) for i, a in enumerate(f.tolist()) for b in f[i + 1 :].tolist() if bin((a ^ b) & (2**64 - 1)).count("1") <= 4])
    links = simhash_dedup._forest(f, 4)
    assert sum(len(a) for a, _ in links) < len(f) + 1
    assert parts_of(f.tolist(), [(int(f[a]), int(f[b])) for x, y in links for a, b in zip(x, y)]) == want
    half = rng.random(len(f)) < 0.5
    here, there = np.flatnonzero(half), np.flatnonzero(~half)
    inside = [(at[x], at[y]) for at in (here, there) for x, y in simhash_dedup._forest(f[at], 4)]
    both = [*inside, *simhash_dedup._bipartite(f, here, there, 4)]
    both = [(f[x], f[y]) for x, y in both]
    assert parts_of(f.tolist(), [(int(a), int(b)) for x, y in both for a, b in zip(x, y)]) == want


def test_ngrams_need_a_letter():
    assert language_id.ngram_buckets("12 !? 3") is None and language_id.ngram_buckets("") is None
    assert np.array_equal(language_id.ngram_buckets("Aa, bb!"), language_id.ngram_buckets("aa?? 7 bb"))
    whole = language_id.ngram_buckets("abc " * 1000)
    size, language_id._CHUNK = language_id._CHUNK, 4
    try:
        assert np.array_equal(whole, language_id.ngram_buckets("abc " * 1000))
    finally:
        language_id._CHUNK = size


PAGES = [
    ("<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>News</a></li></ul></nav><div class='ad'>Buy this thing now, it is cheap.</div><article><h1>A title &amp; more</h1><p>The   first\nparagraph, which is long enough to be read as text. It goes on.</p><p><b>Second<br>one</b> is here and it says something too.</p></article><footer>&copy; site</footer></body></html>",
     "A title & more\n\nThe first paragraph, which is long enough to be read as text. It goes on.\n\nSecond one is here and it says something too."),
    ("", ""), (None, ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_extraction(page, text):
    assert html_extraction.extract(page, html_extraction.trained_field()) == text


LEAD = "brown fox isn't lazy and jumps over the fence of the old farm every morning. It does so for no reason that anyone knows."


@pytest.mark.parametrize("start", ['The <a href="x>quick</a> ', "The <span class=a'>quick</span> ", "The <a href=x title=don't>quick</a> ", "The <a href='it\"s' class=\"b>c\">quick</a> ", "The <b x=>quick</b> ", "The <b/x/ =y>quick</b> "])
def test_markup_never_reaches_the_text(start):
    page = f"<html><body><article><h1>A title of this page</h1><p>{start}{LEAD}</p><p>Another paragraph that is long enough to be one, as it goes on.</p></article></body></html>"
    field = html_extraction.trained_field()
    assert html_extraction.extract(page, field) == f"A title of this page\n\nThe quick {LEAD}\n\nAnother paragraph that is long enough to be one, as it goes on."


def test_comments_and_nameless_footers_are_left_out():
    field = html_extraction.trained_field()
    text = "The first paragraph says what there is to say, and it says it at some length. It goes on."
    talk = "<section class='comments'><h3>Comments</h3><div class='comment'><p>Great article, thanks for it.</p></div></section>"
    assert html_extraction.extract(f"<body><article><h1>Title here</h1><p>{text}</p><p>{text}</p>{talk}</article></body>", field) == f"Title here\n\n{text}\n\n{text}"
    page = f"<body><div><h1>Title here</h1><p>{text}</p><p>{text}</p><p>{text}</p></div><div><p>Copyright 2020 all rights reserved</p></div></body>"
    assert html_extraction.extract(page, field) == "\n\n".join(["Title here", text, text, text])


HOSTILE = {
    "tags in a quote": "<a " * 330_000 + '"', "open quotes": '<a href="x>y' * 90_000, "nested": "<div>x" * 170_000, "nested names": "".join(f"<div class=c{'abcdefgh'[k % 8]}{'xyz'[k % 3]}q>x" for k in range(55_000)),
    "inline": "<i><div>" + "<b>" * 100_000 + "</i>x" * 100_000, "raw": "<script>" + "</script " * 100_000, "comments": "<!--" * 250_000, "many raw": "<svg></sv" * 110_000, "less": "<" * 1_000_000, "spaces": "<a" + " " * 1_000_000, "references": "&amp" * 250_000, "shuts": "</p" * 330_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_time_in_proportion(name):
    field, page = html_extraction.trained_field(), HOSTILE[name]
    began = time.process_time()
    html_extraction.extract(page, field)
    assert time.process_time() - began < 8


def test_extraction_on_pages_not_trained_on():
    field, right, total = html_extraction.trained_field(), 0, 0
    for page, labels in html_extraction.labelled_pages(150, seed=99):
        got = field.decode(html_extraction.features(html_extraction.leaf_blocks(page)))
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_is_the_best_of_all_labellings():
    import itertools

    field = html_extraction.ChainField()
    rng = random.Random(5)
    field.weights = {f"f{k}": [rng.uniform(-1, 1), rng.uniform(-1, 1)] for k in range(6)}
    field.pairs = [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
    for n in range(1, 7):
        page = [[f"f{rng.randrange(6)}" for _ in range(2)] for _ in range(n)]
        e = field.emissions(page)
        score = lambda y: sum(e[i][v] for i, v in enumerate(y)) + sum(field.pairs[a][b] for a, b in itertools.pairwise(y))
        assert tuple(field.decode(page)) == max(itertools.product((0, 1), repeat=n), key=score)
        single, _ = field.marginals(page)
        z = sum(np.exp(score(y)) for y in itertools.product((0, 1), repeat=n))
        want = sum(np.exp(score(y)) for y in itertools.product((0, 1), repeat=n) if y[0] == 1) / z
        assert single[0][1] == pytest.approx(want)


@pytest.mark.parametrize("page", ["<p>a<p>b</div></p>", "<a href='x>y'>t</a", "<script>if (a<b) </script x>z", "<!-- <p>x", "a < b &lt; c &#x41; &nope;", "<![CDATA[x]]>y", "<div" * 5, "x" * 100000, "<b" + "'" * 50])
def test_broken_markup_is_read(page):
    html_extraction.extract(page, html_extraction.trained_field())


@pytest.fixture(scope="module")
def counter():
    with open(P.path("byte_bpe_50k.tiktoken"), encoding="ascii") as f:
        return token_counts.Counter(P.PATTERN, f.read())


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="ab 's\n\t1.é", max_size=400), edits=st.lists(st.tuples(st.integers(0, 500), st.integers(0, 40), st.text(alphabet="ab 's\n1", max_size=12)), max_size=6))
def test_counts_after_edits_are_those_of_the_new_text(counter, text, edits):
    leaf, token_counts.LEAF = token_counts.LEAF, 4
    try:
        tree = token_counts.TokenTree(text, counter)
        for at, n, put in edits:
            a = min(at, len(text))
            b = min(len(text), a + n)
            text = text[:a] + put + text[b:]
            tree.edit(a, b, put)
            assert tree.text == text
            assert [p for x in tree.leaves for p in x] == counter.cut(text)
            assert tree.count == len(counter._encode(text))
    finally:
        token_counts.LEAF = leaf


def test_an_edit_reads_little_again(counter):
    text = "the quick brown fox jumps over the lazy dog. " * 2000
    tree = token_counts.TokenTree(text, counter)
    tree.edit(40_000, 40_005, "cat")
    assert tree.reread < 60


def test_scan_finds_what_brute_force_finds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 32))
    turned = x @ (t := vector_search.rotation(32))
    hits = 0
    for i in range(50):
        places, far = vector_search.scan(x[i], x[i] @ t, x, turned, 11)
        d = np.linalg.norm(x - x[i], axis=1)
        hits += len(set(places[:11]) & set(np.argsort(d)[:11]))
        assert np.allclose(far, d[places])
    assert hits / 550 >= 0.95
