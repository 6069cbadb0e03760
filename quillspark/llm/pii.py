"""Personal data: detectors on the text as it is, and on a deobfuscated copy whose spans map back.

The base detectors find e-mail addresses, IPv4 addresses, card numbers (Luhn) and international
phone numbers. The method then runs transducers over the text, each of which rewrites pieces
and keeps, for every character of its output, the source span it came from:

1. characters: look-alike letters, full-width and other digits, dashes and spaces become ASCII; invisible characters go;
2. spelled digits: "five five five" becomes "5 5 5", "plus" before a digit becomes "+";
3. disguises: "name [at] host [dot] tld", "name at host dot tld", "10[.]0[.]0[.]1".

The base detectors run again on the output, and what they find is mapped to source characters
and added unless it overlaps a base span of the same kind.

Scale: one pass, no shuffle. The detectors are linear in the text: each digit run, sign or ``@`` is looked at once.
Texts without any trigger (most) skip the transducers.

Edge cases: a null or empty text has no spans (and the digest of the empty string); repeated rows are judged alike; an
empty table gives an empty result; other columns are not read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from quillspark.llm.common import columns_of

KINDS = ("email", "ip", "card", "phone")

# --- base detectors ---------------------------------------------------------

_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def find_emails(text: str) -> list[tuple[int, int]]:
    """An address starts at the first local character before its ``@`` that no earlier address holds."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1  # no later local part reaches over this sign
        at = text.find("@", max(at + 1, free))
    return found


def _is_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def find_ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(map(_is_byte, m.groups()))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def find_cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def find_phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m.group())) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base detectors, by start, then kind."""
    out = [("email", s, e) for s, e in find_emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", s, e) for s, e in find_ips(text)]
        out += [("card", s, e) for s, e in find_cards(text)]
        if "+" in text:
            out += [("phone", s, e) for s, e in find_phones(text)]
    out.sort(key=_order)
    return out


def _order(span: tuple[str, int, int]):
    return span[1], KINDS.index(span[0]), span[2]


# --- transducers ------------------------------------------------------------

#: Letters of other scripts that look like an ASCII letter.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ⅼ": "l",
    "。": ".", "․": ".", "٫": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@",
    "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ",
}
#: Spelled digits.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
               "seven": "7", "eight": "8", "nine": "9"}

#: Top-level domains that a fully spelled address ("name at host dot tld") may end in; prose has "at the dot on".
SPELLED_TLDS = frozenset(
    "com org net edu gov mil int info biz io co ai app dev me tv uk ie us ca au nz de at ch fr be nl lu es pt it ro pl cz sk hu bg gr "
    "dk se no fi ee lv lt ru ua tr in cn jp kr br mx ar za eu".split())


def _char_table() -> dict[int, str]:
    """LOOKALIKES, and by rule every character whose compatibility form is one ASCII character, or that is a decimal digit."""
    table = {}
    for cp in [*range(0x0600, 0x0E60), *range(0x2070, 0x2500), *range(0xFE50, 0xFF5F), *range(0x1D400, 0x1D800)]:
        c = chr(cp)
        digit = unicodedata.decimal(c, None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and "!" <= plain <= "~":
            table[cp] = plain
    return table | {ord(k): v for k, v in LOOKALIKES.items()}


_CHARS = _char_table()
#: Everything that the first transducer could change lies here; one range test a character.
_UNUSUAL = re.compile("[\u00a0\u00ad\u0131\u0250-\U0010ffff]")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_SPELLED = "|".join(DIGIT_WORDS)
_ITEM = rf"(?:{_SPELLED}|[0-9]++)(?![^\W_])"
_RUN = re.compile(rf"(?<![^\W_])(?:plus[\s-]+)?{_ITEM}(?:[\s,.-]{{1,3}}{_ITEM})+", re.I)
_RUN_PART = re.compile(rf"plus[\s-]+|{_SPELLED}|,\s?", re.I)
_SPELLED_ONE = re.compile(rf"(?<![^\W_])(?:{_SPELLED})(?![^\W_])", re.I)
_BRACKET_AT = re.compile(r"\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?", re.I)
_BRACKET_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?", re.I)
_BARE_AT = re.compile(r"(?<=[A-Za-z0-9_%+-])\s+at\s+(?=[A-Za-z0-9])", re.I)
_BARE_HOST = re.compile(r"[A-Za-z0-9-]++(?:\s+dot\s+[A-Za-z0-9-]++)++", re.I)
_MIXED_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\s+dot\s+)[A-Za-z0-9-]++)++", re.I)
_LAST_LABEL = re.compile(r"(?:\.|\s)([A-Za-z]{2,})\Z")
_BARE_LOCAL = re.compile(r"(?:[A-Za-z0-9_%+-]+\s+dot\s+)*[A-Za-z0-9._%+-]+\Z", re.I)
_BARE_DOT = re.compile(r"\s+dot\s+", re.I)
_NUMBER_DOT = re.compile(r"(?<=[0-9])\s+(?:dot|point)\s+(?=[0-9])", re.I)
#: A local part has 64 characters at most; spelled dots make it somewhat longer.
_LOCAL_REACH = 256


class Tape:
    """A rewritten text with the source span of each of its characters."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text = text
        self.starts, self.ends = starts, ends  # None: every character stands for itself

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replaces disjoint, ordered [start, end) pieces; each new character stands for its whole piece."""
        if not edits:
            return self
        old_starts = np.arange(len(self.text)) if self.starts is None else self.starts
        old_ends = old_starts + 1 if self.ends is None else self.ends
        text, starts, ends, at = [], [], [], 0
        for s, e, new in edits:
            text += [self.text[at:s], new]
            starts += [old_starts[at:s], np.full(len(new), old_starts[s])]
            ends += [old_ends[at:s], np.full(len(new), old_ends[e - 1])]
            at = e
        text.append(self.text[at:])
        starts.append(old_starts[at:])
        ends.append(old_ends[at:])
        return Tape("".join(text), np.concatenate(starts), np.concatenate(ends))

    def wide(self, at: int) -> bool:
        """Whether a character stands for a longer piece."""
        return self.starts is not None and bool(self.ends[at] - self.starts[at] > 1)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (int(self.starts[start]), int(self.ends[end - 1]))


def plain_characters(t: Tape) -> Tape:
    if t.text.isascii() or not _UNUSUAL.search(t.text):
        return t
    t = t.rewrite([(*m.span(), "") for m in _INVISIBLE.finditer(t.text)])
    return Tape(t.text.translate(_CHARS), t.starts, t.ends)


def plain_digits(t: Tape) -> Tape:
    low = t.text.lower()
    if sum(low.count(w) for w in DIGIT_WORDS) < 2:
        return t
    edits = []
    for run in _RUN.finditer(t.text):
        if not _SPELLED_ONE.search(t.text, *run.span()):
            continue
        for p in _RUN_PART.finditer(t.text, *run.span()):
            w = p.group().lower()
            edits.append((*p.span(), "+" if w.startswith("plus") else " " if w.startswith(",") else DIGIT_WORDS[w]))
    return t.rewrite(edits)


def _spelled_hosts(t: Tape) -> Tape:
    """Spelled dots of hosts after an ``@`` become dots; the last label has two letters or more."""
    text, edits = t.text, []
    at = text.find("@")
    while at >= 0:
        host = _MIXED_HOST.match(text, at + 1) if at and text[at - 1] in _LOCAL_SET else None
        if host and _LAST_LABEL.search(host.group()):
            edits += [(*d.span(), ".") for d in _BARE_DOT.finditer(text, at + 1, host.end())]
        at = text.find("@", host.end() if host else at + 1)
    return t.rewrite(edits)


def plain_signs(t: Tape) -> Tape:
    text = t.text
    if any(c in text for c in "[({<"):
        t = t.rewrite([(*m.span(), "@") for m in _BRACKET_AT.finditer(text)])
        t = t.rewrite([(*m.span(), ".") for m in _BRACKET_DOT.finditer(t.text)])
    bracketed, text = t.text != text, t.text
    low = text.lower()
    if "dot" in low and "@" in text:
        t = _spelled_hosts(t)
        text = t.text
    if "dot" in low or bracketed:
        edits = []
        for m in _BARE_AT.finditer(text):
            host = _BARE_HOST.match(text, m.end())
            if host and host.group().split()[-1].lower() not in SPELLED_TLDS:
                host = None
            if not host and bracketed:  # one bracketed dot is sign enough
                host = _MIXED_HOST.match(text, m.end())
                if host and not (_LAST_LABEL.search(host.group()) and any(text[i] == "." and t.wide(i) for i in range(*host.span()))):
                    host = None
            if not host or (edits and m.start() < edits[-1][1]):
                continue
            left = text[max(0, m.start() - _LOCAL_REACH):m.start()]
            local = _BARE_LOCAL.search(left)
            base = m.start() - (len(left) - local.start()) if local else m.start()
            floor = edits[-1][1] if edits else 0
            if local:
                edits += [(*d.span(), ".") for d in _BARE_DOT.finditer(text, max(base, floor), m.start())]
            edits.append((*m.span(), "@"))
            edits += [(*d.span(), ".") for d in _BARE_DOT.finditer(text, m.end(), host.end())]
        t = t.rewrite(edits)
    if "dot" in low or "point" in low:
        t = t.rewrite([(*m.span(), ".") for m in _NUMBER_DOT.finditer(t.text)])
    return t


def all_spans(text: str | None) -> tuple[list, list]:
    """(base spans, base and added spans) of a text, each by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    t = plain_signs(plain_digits(plain_characters(Tape(text))))
    if t.text == text:
        return base, base
    added = []
    for kind, s, e in base_spans(t.text):
        a, b = t.source(s, e)
        if not any(k == kind and x < b and a < y for k, x, y in base):
            added.append((kind, a, b))
    return base, sorted(base + added, key=_order)


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row of ``docs`` (doc_id, text).

    The four counts are of base spans; ``spans`` holds all, ``n_added`` those that the transducers revealed.
    """
    import pyarrow as pa

    d = columns_of(docs, "doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator) -> Iterator:
        for b in batches:
            counts, digest, spans, added = [[] for _ in KINDS], [], [], []
            for text in b.column("text"):
                base, every = all_spans(text.as_py())
                for c, k in zip(counts, KINDS):
                    c.append(sum(x[0] == k for x in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                added.append(len(every) - len(base))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()),
                 pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    return d.mapInArrow(scan, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS)
                        + ", base_sha256 string, spans string, n_added long")


def mask_pii(text: str | None) -> str | None:
    """The text with every found span replaced by its kind in angle brackets (overlapping spans: the first)."""
    if text is None:
        return None
    out, at = [], 0
    for kind, s, e in all_spans(text)[1]:
        if s < at:
            continue
        out += [text[at:s], f"<{kind}>"]
        at = e
    return "".join([*out, text[at:]])
