"""Personal data by anchor expansion.

An Aho-Corasick automaton walks each whole text once and reports anchors: at-signs, plus-digit, digit pairs, URL schemes
and identifier cues. From each anchor a small deterministic parser grows the span to its boundaries and checks it.

Kinds that agree with the base patterns (email, ip, card, phone; leftmost, not overlapping within a kind, failing matches
dropped) come first; the method adds ``login`` (user information in a URL), ``account`` (an IBAN, checked by its remainder
mod 97, or a number behind a cue such as "account" or "ssn"), ``secret`` (a long value behind a cue such as "token") and
``ipv6`` (an address of three groups or more).

Defined cases: a null text is an empty text; equal texts give equal spans; an empty table gives an empty result; columns
besides those used pass through where asked for.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "account", "secret", "ipv6")

Span = tuple[int, int]

_DIGITS = "0123456789"
_SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://")
_ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "passport", "konto", "cuenta", "compte")
_SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE_RUN = re.compile(r"[\x20().0-9-]*")
_DOTTED = frozenset(_DIGITS + ".")
_DOT_RUN = re.compile(r"[0-9.]*")
_CARD_RUN = re.compile(r"(?:[\x20-]?[0-9])*")
_USERINFO = re.compile(r"[^\s/@?#\"'<>]{1,256}@")
_IBAN_START = re.compile(r"[A-Z]{2}[0-9]{2}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")
#: How far behind its cue an IBAN may start.
_IBAN_REACH = 48
_HEX = frozenset("0123456789abcdefABCDEF:")
_HEX_RUN = re.compile(r"[0-9a-fA-F:]{0,40}")
_CUED_NUMBER = re.compile(r"(?:\s*(?:number|no\.?|nr\.?|#|is|ist|es|est)(?![A-Za-z]))*\s*[:=#]?\s*[\"']?([A-Z]{0,3}[0-9][0-9-]{4,32}[0-9])(?![A-Za-z0-9])", re.I)
_CUED_SECRET = re.compile(r"[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_\-+/=.]{12,})")


def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    words = {"@": ("at", 1), ":": ("colon", 1)}
    for a in _DIGITS:
        words["+" + a] = ("plus", 2)
        for b in _DIGITS:
            words[f"{a}.{b}"] = ("dot", 3)
            for gap in ("", " ", "-"):
                words[f"{a}{gap}{b}"] = ("digits", 2 + len(gap))
    for cues, what in ((_SCHEMES, "scheme"), (_ACCOUNT_CUES, "account"), (_SECRET_CUES, "secret")):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                words[form] = (what, len(form))
    for k, v in words.items():
        auto.add_word(k, v)
    auto.make_automaton()
    return auto


_AUTO: list[ahocorasick.Automaton] = []


def anchors(text: str):
    """(kind, start, end) of each anchor, by end."""
    if not _AUTO:
        _AUTO.append(_automaton())
    for last, (what, n) in _AUTO[0].iter(text):
        yield what, last - n + 1, last + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> Span | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    m = _DOMAIN.match(text, at + 1)
    return (start, m.end()) if m else None


def _run_start(text: str, at: int, floor: int, allowed: frozenset[str]) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def _ips(text: str, start: int, end: int) -> list[Span]:
    """Addresses in a run of digits and dots: four parts at a time, as far as single dots join them."""
    found, at = [], start
    for piece in text[start:end].split(".."):
        parts, p = piece.split("."), at
        at += len(piece) + 2
        bounds = []
        for x in parts:
            if x:
                bounds.append((p, p + len(x)))
            p += len(x) + 1
        for k in range(0, len(bounds) - 3, 4):
            four = bounds[k : k + 4]
            if all(len(v := text[a:b].lstrip("0")) <= 3 and int(v or "0") <= 255 for a, b in four):
                found.append((four[0][0], four[3][1]))
    return found


def _card_start(text: str, at: int, floor: int) -> int:
    """Where the run begins whose digits, joined by single blanks or dashes, reach ``at``."""
    while at > floor:
        if text[at - 1] in _DIGITS:
            at -= 1
        elif at - 1 > floor and text[at - 1] in " -" and text[at - 2] in _DIGITS:
            at -= 2
        else:
            break
    return at


def _phone(text: str, plus: int) -> Span | None:
    run = _PHONE_RUN.match(text, plus + 2)
    end = run.end()
    while end > plus + 2 and text[end - 1] not in _DIGITS:
        end -= 1
    return (plus, end) if end > plus + 3 else None


def _iban_ok(value: str) -> bool:
    v = value.replace(" ", "")
    if not 15 <= len(v) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def find_spans(text: str | None) -> dict[str, list[Span]]:
    """Spans by kind, in order; code points, end exclusive."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not text:
        return found
    mail_end = ip_end = card_end = phone_end = colon_end = 0
    for what, start, end in anchors(text):
        if what == "digits":
            if start < card_end:
                continue
            begin = _card_start(text, start + 1, card_end)
            card_end = _CARD_RUN.match(text, begin + 1).end()
            digits = [c for c in text[begin:card_end] if c in _DIGITS]
            if 13 <= len(digits) <= 19 and luhn("".join(digits)):
                found["card"].append((begin, card_end))
        elif what == "at":
            if start >= mail_end and (span := _email(text, start, mail_end)):
                found["email"].append(span)
                mail_end = span[1]
        elif what == "dot":
            if start >= ip_end:
                begin = _run_start(text, start, ip_end, _DOTTED)
                ip_end = _DOT_RUN.match(text, begin).end()
                found["ip"] += _ips(text, begin, ip_end)
        elif what == "plus":
            if start >= phone_end and (span := _phone(text, start)):
                phone_end = span[1]
                if 9 <= sum(c in _DIGITS for c in text[span[0] : span[1]]) <= 15:
                    found["phone"].append(span)
        elif what == "scheme":
            if m := _USERINFO.match(text, end):
                if ":" in m.group():
                    found["login"].append((end, m.end() - 1))
        elif what == "colon":
            stop = found["ipv6"][-1][1] if found["ipv6"] else 0
            if start >= max(stop, colon_end):
                begin = _run_start(text, start, max(stop, start - 4), _HEX)
                colon_end = _HEX_RUN.match(text, begin).end()
                if span := _ipv6(text, begin, colon_end):
                    found["ipv6"].append(span)
        elif what == "account":
            stop = found["account"][-1][1] if found["account"] else 0
            if start >= stop:
                if span := _cued_iban(text, end):
                    found["account"].append(span)
                elif m := _CUED_NUMBER.match(text, end):
                    found["account"].append(m.span(1))
        else:
            stop = found["secret"][-1][1] if found["secret"] else 0
            if start >= stop and (m := _CUED_SECRET.match(text, end)):
                found["secret"].append(m.span(1))
    found["account"].sort()
    return found


def _cued_iban(text: str, at: int) -> Span | None:
    """The first account number that passes its check among those that start within reach of a cue's end."""
    for start in _IBAN_START.finditer(text, at, min(len(text), at + _IBAN_REACH + 4)):
        m = _IBAN.match(text, start.start())
        if m and (good := _longest_iban(m.group())):
            return m.start(), m.start() + len(good)
    return None


def _ipv6(text: str, start: int, end: int) -> Span | None:
    """A whole run of groups and colons that is an address of three groups or more; a colon behind it isn't part of it."""
    while end > start and text[end - 1] == ":" and text[end - 2 : end] != "::":
        end -= 1
    around = text[start - 1 : start] + text[end : end + 1]
    value = text[start:end]
    if any(c.isalnum() for c in around) or sum(map(bool, value.split(":"))) < 3:
        return None
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return None
    return start, end


def _longest_iban(run: str) -> str:
    for n in range(len(run), 14, -1):
        if run[n - 1] != " " and _iban_ok(run[:n]):
            return run[:n]
    return ""


def redact(text: str | None, found: dict[str, list[Span]] | None = None) -> str | None:
    """``text`` with each span (overlapping ones as one) replaced by ``[KIND]``; null stays null."""
    if text is None:
        return None
    found = find_spans(text) if found is None else found
    spans = sorted((a, -b, k) for k, v in found.items() for a, b in v)
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        b = -b
        if a >= at:
            out += (text[at:a], f"[{k.upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:]


def listed(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def find_pii(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``pii``: an array of (kind, start, end). A map over the texts; nothing is shuffled."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "pii"]

    def run(texts):
        return [[[{"kind": k, "start": a, "end": b} for k, v in find_spans(t).items() for a, b in v] for t in texts]]

    return map_text(docs, text_col, run, [T.StructField("pii", T.ArrayType(_SPAN))], keep)


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced; the same columns in the same order."""
    rest = [c for c in docs.columns if c != text_col]
    return map_text(docs, text_col, lambda texts: [[redact(t) for t in texts]], [T.StructField(text_col, T.StringType())], rest).select(*[F.col(f"`{c}`") for c in docs.columns])


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, the digest of the base spans and all spans of each document, from the spans that :func:`find_pii` gives.

    The arrays are few and short, so the digest columns are made from them by built-in functions.
    """
    found = find_pii(docs, text_col, [id_col])
    pick = lambda k: F.filter("pii", lambda s: s["kind"] == k)
    show = lambda kinds: F.array_join(F.transform(F.flatten(F.array(*[pick(k) for k in kinds])), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        F.col(f"`{id_col}`"),
        *[F.size(pick(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(show(BASE_KINDS), 256).alias("base_sha256"),
        show(KINDS).alias("spans"),
    )


def digest_of(text: str | None) -> str:
    """The digest of one text's base spans."""
    return hashlib.sha256(listed(find_spans(text), BASE_KINDS).encode()).hexdigest()
