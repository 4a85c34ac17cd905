"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the runs of text that no block-level tag interrupts, each with its ancestors' tags and
class words, which blocks share through the nodes of the tree. Reading takes time in proportion to the page, whatever its markup. Features come from the ancestors and from the text (length, links, punctuation, place). The field has two
labels, article and other; its weights are learnt by stochastic gradient on the log-likelihood of labelled pages, and a
page is decoded by Viterbi. Scripts, styles, the head and comments of the markup are never blocks.

No labelled pages exist, so :func:`labelled_pages` makes them: invented text in page layouts of many kinds, where each
block's label is known because the layout placed it. The model is small, is trained on the driver from ``TRAIN_PAGES``
such pages with a fixed seed, and is sent to the workers; nothing is learnt from the pages it extracts.

Defined cases: null or empty html gives an empty text; text without any tag is a block as well; broken and cut-off markup
is read by the rules of HTML as far as it goes, but for a quote that is never closed, whose tag ends at the next ``>``; repeated rows are extracted each; other columns pass through where asked for.
"""

from __future__ import annotations

import html as entities
import math
import random
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import map_text

TRAIN_PAGES = 800
EPOCHS = 8
SEED = 11

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_RAW = frozenset("script style noscript template iframe svg math object canvas".split())
#: Tags whose opening ends an open tag of the second kind.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOUNDARY = frozenset("article aside body div footer form header html main nav ol section table td th ul blockquote dl".split())
_ENDS_P = _BOUNDARY - {"html", "body", "td", "th"} | frozenset("h1 h2 h3 h4 h5 h6 pre hr address fieldset figure".split())

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTR_NAME = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE_VALUE = re.compile(r"[^\s>]*")
_NAMING = frozenset(("class", "id", "role"))
_CLASS_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_CUES = re.compile(r"\b(cookies?|copyright|privacy|newsletter|subscribe|sign in|log ?in|rights reserved|advertisement|comments?|share|menu|related|search)\b|[©·|»›]", re.I)


class Node:
    """An open tag; ``names`` has the features of itself and its ancestors, ``block_tag`` is the innermost tag of a block."""

    __slots__ = ("tag", "names", "block_tag", "scope")

    def __init__(self, tag: str, words: list[str], above: Node | None, known) -> None:
        own = {f"word:{w}" for w in words}
        if tag not in _INLINE:
            own.add(f"in:{tag}")
        if known is not None:
            own = {x for x in own if x in known}
        names = above.names if above else frozenset()
        self.tag, self.names = tag, names if own <= names else names | own
        self.block_tag = tag if tag not in _INLINE else above.block_tag if above else "none"
        #: Open tags since the last one that closing tags don't reach across, counted.
        self.scope: dict[str, int] = {} if tag in _BOUNDARY or not above else above.scope


class Block:
    __slots__ = ("text", "names", "parent", "linked")

    def __init__(self, text: str, node: Node | None, linked: int):
        self.text, self.linked = text, linked
        self.names, self.parent = (node.names, node.block_tag) if node else (frozenset(), "none")


class _Reader:
    """Reads tags from a page; remembers which quotes don't come again, so that no search is made twice."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag(self, at: int) -> tuple[int, list[str], bool]:
        """From behind a tag's name: where the tag ends, the words of its class, id and role, and whether it closes itself."""
        page, end, words = self.page, len(self.page), []
        while True:
            gap = at
            at = _GAP.match(page, at).end()
            if at >= end:
                return end, words, False
            if page[at] == ">":
                return at + 1, words, at > gap and page[at - 1] == "/"
            name = _ATTR_NAME.match(page, at)
            at = name.end()
            equals = _EQUALS.match(page, at)
            if not equals:
                continue
            at = equals.end()
            quote = page[at] if at < end else ""
            if quote == '"' or quote == "'":
                shut = self.find(quote, at + 1)
                if shut < 0:
                    shut = self.find(">", at)
                    return (shut + 1 if shut >= 0 else end), words, False
                value, at = page[at + 1 : shut], shut + 1
            else:
                bare = _BARE_VALUE.match(page, at)
                value, at = bare.group(), bare.end()
            if name.group().lower() in _NAMING:
                words += _CLASS_WORD.findall(value.lower())

    def skip(self, what: str, at: int) -> int:
        found = self.find(what, at)
        return len(self.page) if found < 0 else found + len(what)


def leaf_blocks(page: str | None, known=None) -> list[Block]:
    """The page's leaf blocks in order, white space collapsed, character references decoded. Only ancestors' features among ``known`` are kept, if it is given."""
    blocks: list[Block] = []
    stack: list[Node] = []
    open_tags: dict[str, int] = {}
    pieces: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
            pieces.clear()
            if text and not open_tags.get("head") and not open_tags.get("title"):
                blocks.append(Block(text, stack[-1] if stack else None, min(linked, len(text))))
        linked = 0

    def close(tag: str) -> None:
        if not (open_tags if tag in _BOUNDARY else stack[-1].scope if stack else {}).get(tag):
            return
        while True:
            node = stack.pop()
            open_tags[node.tag] -= 1
            if node.tag not in _BOUNDARY:
                node.scope[node.tag] -= 1
            if node.tag == tag:
                return

    page = page or ""
    reader, at, end = _Reader(page), 0, len(page)
    while at < end:
        start = reader.find("<", at)
        stop = start if start >= 0 else end
        if stop > at:
            pieces.append(page[at:stop])
            if open_tags.get("a"):
                linked += stop - at
        if start < 0:
            break
        if page.startswith("<!--", start):
            at = start + 5 if page.startswith(">", start + 4) else reader.skip("-->", start + 4)
            continue
        if page.startswith("<![CDATA[", start):
            at = reader.skip("]]>", start)
            continue
        shuts = page.startswith("</", start)
        name = _TAG_NAME.match(page, start + 1 + shuts)
        if not name:
            if shuts or page.startswith(("<!", "<?"), start):
                at = reader.skip(">", start)
            else:
                pieces.append("<")
                at = start + 1
            continue
        tag = name.group().lower()
        at, words, itself = reader.tag(name.end())
        if shuts:
            if tag not in _INLINE:
                flush()
            close(tag)
            continue
        if tag in _RAW:
            if not itself or tag in ("script", "style"):
                at = _raw_end(reader, tag, at)
            pieces.append(" ")
            continue
        if tag in _INLINE:
            if tag == "br":
                pieces.append(" ")
        else:
            flush()
            if tag in _ENDS_P:
                close("p")
            for other in _ENDS.get(tag, ()):
                close(other)
            if tag == "body":
                close("head")
        if tag in _VOID:
            continue
        node = Node(tag, words, stack[-1] if stack else None, known)
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag not in _BOUNDARY:
            node.scope[tag] = node.scope.get(tag, 0) + 1
    flush()
    return blocks


def _raw_end(reader: _Reader, tag: str, at: int) -> int:
    """Where the content of a tag like ``script``, which has no markup of its own, ends, closing tag included."""
    if f"</{tag}" in reader.gone:
        return len(reader.page)
    shut = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(reader.page, at)
    if not shut:
        reader.gone.add(f"</{tag}")
        return len(reader.page)
    return reader.skip(">", shut.end())


def features(blocks: list[Block]) -> list[list[str]]:
    """The names of the features that hold for each block."""
    out = []
    total = len(blocks)
    headed = False
    for i, b in enumerate(blocks):
        n = len(b.text)
        words = b.text.count(" ") + 1
        dense = b.linked / n
        f = ["bias", f"len{min(9, int(math.log2(words + 1)))}", f"link{int(dense * 4)}", f"parent:{b.parent}", f"place{i * 5 // total}", f"stops{min(3, b.text.count('. ') + (b.text[-1] in '.!?…'))}"]
        f += b.names
        f.append(f"{f[1]}&{f[2]}")
        f.append(f"{f[1]}&{f[5]}")
        headed = headed or "in:h1" in b.names
        f.append("after-h1" if headed else "before-h1")
        if n < 400:
            f += [f"cue:{c.lower()}" for c in {m.group() for m in _CUES.finditer(b.text)}]
        out.append(f)
    return out


class ChainField:
    """Two labels (0 other, 1 article); weights by feature as [other, article], and by pair of labels."""

    def __init__(self):
        self.weights: dict[str, list[float]] = {}
        self.pairs = [[0.0, 0.0], [0.0, 0.0]]

    def emissions(self, page: list[list[str]]) -> list[tuple[float, float]]:
        get, zero = self.weights.get, [0.0, 0.0]
        out = []
        for names in page:
            a = b = 0.0
            for f in names:
                w = get(f, zero)
                a += w[0]
                b += w[1]
            out.append((a, b))
        return out

    def decode(self, page: list[list[str]]) -> list[int]:
        """The most likely labels (Viterbi); ties go to ``other``."""
        scores = self.emissions(page)
        if not scores:
            return []
        t = self.pairs
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            to_a = (a + t[0][0], b + t[1][0])
            to_b = (a + t[0][1], b + t[1][1])
            back.append((int(to_a[1] > to_a[0]), int(to_b[1] > to_b[0])))
            a, b = max(to_a) + x, max(to_b) + y
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def marginals(self, page: list[list[str]]) -> tuple[list[tuple[float, float]], list[list[list[float]]]]:
        """Probabilities of each block's labels, and of each neighbouring pair's (forward and backward sums, scaled)."""
        e = [(math.exp(a - max(a, b)), math.exp(b - max(a, b))) for a, b in self.emissions(page)]
        t = [[math.exp(x) for x in row] for row in self.pairs]
        n = len(e)
        fwd = [e[0]]
        for i in range(1, n):
            p = fwd[-1]
            v = [(p[0] * t[0][y] + p[1] * t[1][y]) * e[i][y] for y in (0, 1)]
            s = v[0] + v[1]
            fwd.append((v[0] / s, v[1] / s))
        bwd = [(1.0, 1.0)]
        for i in range(n - 1, 0, -1):
            q = bwd[-1]
            v = [sum(t[x][y] * e[i][y] * q[y] for y in (0, 1)) for x in (0, 1)]
            s = v[0] + v[1]
            bwd.append((v[0] / s, v[1] / s))
        bwd.reverse()
        single = []
        for f, b in zip(fwd, bwd):
            s = f[0] * b[0] + f[1] * b[1]
            single.append((f[0] * b[0] / s, f[1] * b[1] / s))
        double = []
        for i in range(1, n):
            m = [[fwd[i - 1][x] * t[x][y] * e[i][y] * bwd[i][y] for y in (0, 1)] for x in (0, 1)]
            s = sum(map(sum, m))
            double.append([[v / s for v in row] for row in m])
        return single, double

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-3, seed: int = SEED) -> None:
        """Stochastic gradient ascent on the regularised log-likelihood, with a step of its own for each weight."""
        rng = random.Random(seed)
        seen: dict[str, float] = {}
        for _ in range(epochs):
            rng.shuffle(pages)
            for page, labels in pages:
                if not page:
                    continue
                single, double = self.marginals(page)
                for names, y, p in zip(page, labels, single):
                    g = (y == 1) - p[1]
                    if abs(g) < 1e-3:
                        continue
                    for f in names:
                        w = self.weights.setdefault(f, [0.0, 0.0])
                        s = seen[f] = seen.get(f, 0.1) + g * g
                        step = rate * (g - decay * w[1]) / math.sqrt(s)
                        w[0] -= step
                        w[1] += step
                for k, m in enumerate(double):
                    for x in (0, 1):
                        for y in (0, 1):
                            self.pairs[x][y] += 0.02 * ((labels[k] == x and labels[k + 1] == y) - m[x][y])


# Invented pages for training.

_MENU = ("nav", "div.menu", "div#navigation", "ul.navbar", "div.breadcrumbs", "div.topnav", "nav.main-menu")
_HEAD = ("header", "div.header", "div#masthead", "div.site-title", "header.banner")
_ADS = ("div.ad", "div.ads", "div.advert", "aside.sponsored", "div.promo", "div.banner", "section.advertisement", "div#ad-slot", "ins.adsbygoogle")
_SIDE = ("aside", "div.sidebar", "div#secondary", "div.widget", "aside.related", "div.recommended", "section.trending")
_NOTES = ("div.cookie-banner", "div.notice", "div#consent", "div.popup", "div.modal", "div.alert", "section.notification", "div.gdpr", "dialog", "div.cookie-notice")
_FEET = ("footer", "div.footer", "div#bottom", "div.copyright", "footer.site-footer", "div.legal")
_FORMS = ("form", "form.search", "div.newsletter", "form.login", "div.subscribe", "form.signup")
_TALK = ("div#comments", "section.comments", "ol.commentlist", "div.comment-thread", "div.responses", "section#discussion", "div.replies")
_BODY = ("article", "main", "div.content", "div#main", "div.post", "div.entry-content", "section.story", "article.post", "div.article-body", "div#content", "div", "main article", "div.container div.text", "section")
_SYLLABLES = "an en on th er re ou ing ed ti st ha le ma ko ri so ver ge un sch de la que ment pa vi tion ó ß é".split()


_NOTICE_TEXTS = ("We use cookies to make this site work. Accept", "By using this site you agree to our privacy policy.", "Subscribe to our newsletter", "Please sign in to read more", "Accept all cookies")
_FOOT_TEXTS = ("Copyright 2020 all rights reserved", "All rights reserved.", "\u00a9 2019 %s", "Terms of use and privacy policy", "Copyright (c) %s", "Contact us | Imprint | Privacy", "Powered by %s")


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], []
        #: A page whose blocks have no names: what they are, text and place have to tell.
        self.nameless = rng.random() < 0.2

    def words(self, n: int) -> str:
        r = self.rng
        made = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
        for k in range(n):
            if r.random() < 0.08:
                made[k] += r.choice(",.!?;")
        return " ".join(made)

    def sentence(self, low: int, high: int) -> str:
        return self.words(self.rng.randint(low, high)).capitalize() + "."

    def wrap(self, spec: str, fill) -> None:
        tags = []
        if self.nameless:
            spec = self.rng.choice(("div", "div", "div div", "section"))
        for part in spec.split():
            m = re.match(r"(\w+)(?:([.#])(.+))?", part)
            tag, kind, name = m.groups()
            attr = f' {"class" if kind == "." else "id"}="{name}"' if kind else ""
            if self.rng.random() < 0.15 and not kind:
                attr = f' class="{self.rng.choice("abcdefgh")}{self.rng.randint(1, 99)}"'
            self.out.append(f"<{tag}{attr}>")
            tags.append(tag)
        fill()
        for tag in reversed(tags):
            self.out.append(f"</{tag}>")

    def put(self, tag: str, text: str, label: int, link: bool = False, shut: bool = True) -> None:
        inner = f'<a href="/{text[:5]}">{text}</a>' if link else text
        self.out.append(f"<{tag}>{inner}" + f"</{tag}>" * shut if tag else inner)
        self.labels.append(label)

    def menu(self) -> None:
        def fill():
            self.out.append("<ul>")
            for _ in range(self.rng.randint(3, 8)):
                self.put("li", self.words(self.rng.randint(1, 3)), 0, True)
            self.out.append("</ul>")

        self.wrap(self.rng.choice(_MENU), fill)

    def plain(self, kinds: tuple[str, ...], low: int, high: int, most: int = 3) -> None:
        def fill():
            n = self.rng.randint(1, most)
            for k in range(n):
                self.put(self.rng.choice(("p", "div", "p", "h3", "li") if n > 1 else ("p", "div", "")), self.sentence(low, high) + self.rng.choice(("", "", " &copy; 2020", " &middot; menu")), 0, self.rng.random() < 0.3)

        self.wrap(self.rng.choice(kinds), fill)

    def phrase(self, kinds: tuple[str, ...], phrases: tuple[str, ...]) -> None:
        """Blocks of the words that notices and footers are made of."""

        def fill():
            for text in self.rng.sample(phrases, self.rng.randint(1, 2)):
                self.put(self.rng.choice(("p", "div", "span" if self.rng.random() < 0.1 else "p")), text.replace("%s", self.words(2)), 0)

        self.wrap(self.rng.choice(kinds), fill)

    def form(self) -> None:
        def fill():
            for tag in self.rng.sample(("label", "button", "p", "legend", "div"), self.rng.randint(1, 3)):
                self.put(tag, self.words(self.rng.randint(1, 8)), 0)
                self.out.append(self.rng.choice(('<input type="text">', '<input name="q"/>', "")))

        # Labels and buttons are block boundaries here, as they are for the reader of a form.
        self.wrap(self.rng.choice(_FORMS), fill)

    def talk(self) -> None:
        def fill():
            if self.rng.random() < 0.5:
                self.put("h3", "Comments", 0)
            for _ in range(self.rng.randint(1, 5)):
                self.wrap(self.rng.choice(("li.comment", "div.comment", "article.comment", "div.reply")), lambda: [self.put("p", self.sentence(3, 60), 0) for _ in range(self.rng.randint(1, 3))])

        self.wrap(self.rng.choice(_TALK), fill)

    def article(self) -> None:
        r = self.rng

        def fill():
            if r.random() < 0.8:
                title = lambda: self.put(r.choice(("h1", "h1", "h2")), self.words(r.randint(2, 14)), 1)
                if r.random() < 0.15:
                    self.wrap(r.choice(("header", "div.entry-header", "hgroup")), title)
                else:
                    title()
            for _ in range(r.randint(1, 14)):
                kind = r.random()
                if self.nameless and kind >= 0.92:
                    kind *= 0.9
                if kind < 0.1:
                    self.put("p", self.words(r.randint(1, 4)) + r.choice(("", ".", "!", ":", " ***", "#")), 1, shut=r.random() < 0.9)
                elif kind < 0.62:
                    self.put("p", self.sentence(1 if r.random() < 0.2 else 12, 90), 1, shut=r.random() < 0.9)
                elif kind < 0.72:
                    self.out.append(f"<p><b>{self.sentence(4, 30)}<br>")
                    self.labels.append(1)
                    self.put("p", self.sentence(5, 60), 1)
                elif kind < 0.8:
                    self.put(r.choice(("h2", "h3", "blockquote", "pre", "figcaption")), self.words(r.randint(2, 25)), 1)
                elif kind < 0.86:
                    self.out.append("<ul>")
                    for _ in range(r.randint(2, 5)):
                        self.put("li", self.sentence(2, 14), 1)
                    self.out.append("</ul>")
                elif kind < 0.92:
                    self.put("div", self.sentence(10, 60), 1)
                elif kind < 0.95:
                    self.plain(_ADS, 3, 40, 2)
                elif kind < 0.97:
                    self.plain(("div.related", "div.share", "aside", "div.social"), 1, 8)
                else:
                    self.out.append('<script>if (a < b) { x("</p>") }</script>')

            # Licence lines that close a text belong to it, where the article says that it is one.
            if not self.nameless and r.random() < 0.15:
                self.put("p", r.choice(_FOOT_TEXTS + _NOTICE_TEXTS).replace("%s", self.words(2)), 1)
            # Readers' comments within the article, too.
            if not self.nameless and r.random() < 0.25:
                self.talk()

        self.wrap(r.choice(_BODY), fill)

    def page(self) -> str:
        r = self.rng
        self.out.append(f"<!DOCTYPE html><html><head><title>{self.words(5)}</title><style>p{{margin:0}}</style></head><body>")
        before = [x for x, p in ((self.menu, 0.8), (lambda: self.plain(_HEAD, 1, 8), 0.4), (lambda: self.plain(_ADS, 3, 40, 2), 0.5), (lambda: self.plain(_NOTES, 5, 50, 2), 0.4), (self.form, 0.25), (lambda: self.plain(_SIDE, 2, 40), 0.2)) if r.random() < p]
        after = [x for x, p in ((self.talk, 0.45), (lambda: self.plain(_SIDE, 2, 40), 0.4), (lambda: self.plain(_ADS, 3, 40, 2), 0.3), (self.form, 0.25), (self.menu, 0.2), (lambda: self.plain(_NOTES, 5, 50, 2), 0.2)) if r.random() < p]
        if self.nameless:
            before = [x for x, p in ((self.menu, 0.8), (lambda: self.plain(_HEAD, 1, 5, 1), 0.3), (lambda: self.phrase(_NOTES, _NOTICE_TEXTS), 0.4)) if r.random() < p]
            after = [x for x, p in ((self.menu, 0.3), (lambda: self.phrase(_NOTES, _NOTICE_TEXTS), 0.3)) if r.random() < p]
        r.shuffle(before)
        r.shuffle(after)
        for x in before:
            x()
        self.article()
        for x in after:
            x()
        if r.random() < 0.85:
            if self.nameless or r.random() < 0.3:
                self.phrase(_FEET, _FOOT_TEXTS)
            else:
                self.plain(_FEET, 3, 20, 2)
        self.out.append("</body></html>" if r.random() < 0.9 else "")
        return "".join(self.out)


def labelled_pages(n: int, seed: int = SEED) -> list[tuple[str, list[int]]]:
    """Invented pages, each with the labels of its leaf blocks."""
    rng, made = random.Random(seed), []
    while len(made) < n:
        w = _Writer(rng)
        page = w.page()
        if len(leaf_blocks(page)) == len(w.labels):  # a layout that runs two placed texts together isn't labelled
            made.append((page, w.labels))
    return made


_MODEL: list[ChainField] = []


def trained_field() -> ChainField:
    """The model, trained once in a process."""
    if not _MODEL:
        field = ChainField()
        field.fit([(features(leaf_blocks(p)), y) for p, y in labelled_pages(TRAIN_PAGES)])
        _MODEL.append(field)
    return _MODEL[0]


def extract(page: str | None, field: ChainField) -> str:
    """The article's blocks, joined by blank lines."""
    blocks = leaf_blocks(page, field.weights)
    return "\n\n".join(b.text for b, y in zip(blocks, field.decode(features(blocks))) if y)


def extract_pages(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, field: ChainField | None = None) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars``. A map over the pages; nothing is shuffled."""
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() not in {"text", "n_chars"}]
    shared = pages.sparkSession.sparkContext.broadcast(field or trained_field())

    def run(rows):
        texts = [extract(x, shared.value) for x in rows]
        return [texts, [len(x) for x in texts]]

    return map_text(pages, html_col, run, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], keep)
